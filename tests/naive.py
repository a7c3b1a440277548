"""Plain restatements of the rules, for differential tests."""

from seqlattice.functions.kmers import AMBIGUOUS, murmur3_int

SWAP = str.maketrans("ACGT", "TGCA")


def hashes(seq, k):
    seq = seq.upper()
    kmer = [seq[i : i + k] for i in range(len(seq) - k + 1)]
    return [min(murmur3_int(x.encode()), murmur3_int(x[::-1].translate(SWAP).encode())) for x in kmer]


def ranges(n, w, k, delta):
    """Slices by walking along the sequence: counter at the last k-mer of the window before."""
    d, at, out = w * delta, w - k + 1, [(0, min(n, round(w - k + 1 + w * delta)))]
    while at <= n - w:
        out.append((max(0, round(at + 1 - d)), min(n, round(at + w + 1 + d))))
        at += w
    if at <= n - 2:
        out.append((max(0, round(at + 1 - d)), n))
    return out


def sketches(seq, w, k, delta, s=1, ambiguous=False):
    h = hashes(seq, k)
    drop = set() if ambiguous else {murmur3_int(a.encode() * k) for a in AMBIGUOUS}
    return [{x for x in h[lo:hi] if x % s == 0} - drop for lo, hi in ranges(len(h), w, k, delta)]


def value(a, b, wide_a, wide_b, identity, k):
    ca = len(a & wide_b) / len(a) if a else 0
    if not ca or ca ** (1.0 / k) < identity / 100:
        return 0
    cb = len(b & wide_a) / len(b) if b else 0
    return max(ca, cb) ** (1.0 / k) * 100


def self_pairs(seq, w, k, identity, delta, s=1, ambiguous=False):
    core, wide = sketches(seq, w, k, 0, s, ambiguous), sketches(seq, w, k, delta, s, ambiguous)
    out = {(i, i): 100.0 for i, x in enumerate(core) if x or ambiguous}
    for i in range(len(core)):
        for j in range(i + 1, len(core)):
            if v := value(core[i], core[j], wide[i], wide[j], identity, k):
                out[i, j] = round(v, 6)
    return out


def cross_pairs(query, reference, w, k, identity, delta, s=1):
    q, qw, r, rw = (sketches(x, w, k, d, s) for x in (query, reference) for d in (0, delta))
    out = {}
    for i in range(len(q)):
        for j in range(len(r)):
            if v := value(r[j], q[i], rw[j], qw[i], identity, k):
                out[i, j] = round(v, 6)
    return out
