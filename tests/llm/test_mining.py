"""Collocations, token alignment and packing against brute force."""

import hashlib
import random
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlattice.llm import alignment, collocations, packing

tok = pytest.importorskip("public_tokenizers")

WORDS = "the of tea cup red Blue a A é 中".split()


def lines(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, odd white space, special strings, ties and repeated rows."""
    texts = [None, "", " \n\t ", "one", "Two words ", lines(1, 60), lines(1, 60), lines(2, 9000), "é中😀 \x0b x", "x" * 5000, "<|endoftext|> <s>▁", "a\x1cb  c", "  lead\r\nand tail "]
    out = [(i, t, "en" if i % 3 else None) for i, t in enumerate(texts)]
    return [*out, (None, lines(3, 50), "en"), (5, texts[5], "en"), (None, None, None)]


@pytest.fixture
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in ("block", "own", "codes", "known", "n", "id", "a", "f", "phrase", "rank", "piece", "part", "nth", "length", "docs", "units", "sequence_id")})


# collocations


def slow_phrases(rows, least, longest, inside, top):
    found, words = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            ws = re.findall(r"[^ \t]+", piece)
            words[lang or "und"] += len(ws)
            for k in range(1, longest + 1):
                found[lang or "und"].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in found.items():
        frequent = {p: n for p, n in f.items() if n >= least and len(p) > 1}
        got = []
        for p, a in frequent.items():
            holders = (q for q in frequent if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if any(100 * frequent[q] >= inside * a for q in holders):
                continue
            score, _, left, right = min((1000 * a * words[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            got.append((score, a, " ".join(p), left, right))
        got.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, left, right, words[lang], s) for i, (s, a, p, left, right) in enumerate(got[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "longest", "inside", "top"), [(1 << 18, 5, 100, 2000), (7, 5, 100, 2000), (50, 3, 60, 10)])
def test_phrases_equal_brute_force(docs, rows, block, longest, inside, top):
    got = collocations.mine(docs, 4, longest, inside, top, block)
    assert sorted(map(tuple, got.collect())) == slow_phrases(rows, 4, longest, inside, top) != []


def test_phrases_of_many_languages(spark):
    rows = [(i, lines(i % 7, 40), f"l{i % 50}") for i in range(150)]
    got = collocations.mine(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 3, block=16)
    assert sorted(map(tuple, got.collect())) == slow_phrases(rows, 3, 5, 100, 2000)


def test_scores_are_exact(spark):
    big = [(4 * 10**15 + 7, 9 * 10**15 + 1, 8 * 10**16 + 3, 10**18 - 1)]
    df = spark.createDataFrame(big, "a long, l long, r long, n long")
    score = collocations.lowest_cut(F.col("a"), F.array("l"), F.array("r"), F.col("n"))["score"]
    a, left, right, n = big[0]
    assert df.select(score).first()[0] == 1000 * a * n // (left * right)


def test_phrases_stay_in_their_blocks(docs, rows, monkeypatch):
    calls, semi = [], collocations._semi_joined
    monkeypatch.setattr(collocations, "_semi_joined", lambda *args: calls.append(1) or semi(*args))
    monkeypatch.setattr(collocations, "FILTER_BITS", 64)  # lets nearly all through
    got = collocations.mine(docs, 4, block=50)
    assert sorted(map(tuple, got.collect())) == slow_phrases(rows, 4, 5, 100, 2000) != [] and len(calls) == 1  # of words only


def test_phrases_are_counted_in_parts(docs, rows, monkeypatch):
    """Many small parts and gatherings give the same; a group of two words takes few bytes of the shuffle."""
    monkeypatch.setattr(collocations, "PART", 5)
    monkeypatch.setattr(collocations, "GATHERED", 20)
    got = collocations.mine(docs, 4, block=50)
    assert sorted(map(tuple, got.collect())) == slow_phrases(rows, 4, 5, 100, 2000) != []


@pytest.mark.parametrize("k", [2, 5])
def test_packed_groups(k):
    rng = np.random.default_rng(k)
    matrix, counts = (rng.zipf(1.2, (200_000, k)) % 60_000).astype(np.int32), rng.zipf(2.0, 200_000)
    matrix[:3], counts[0] = [[2**31 - 1] * k, [0] * k, [2**31 - 1] * k], 2**40
    want = Counter()
    for row, n in zip(matrix.tolist(), counts.tolist()):
        want[tuple(row)] += n
    rows, sums = collocations._summed(matrix, counts)
    packed = collocations._pack(rows, sums)
    assert len(packed) < (2 * k + 1) * len(rows)
    rows, sums = collocations._unpack(packed, len(rows), k)
    assert dict(zip(map(tuple, rows.tolist()), sums.tolist())) == want


def test_groups_of_a_block_are_one_packed_value(spark, docs, monkeypatch):
    """No relation of two words and more has a row with an array of groups; they lie sorted in few bytes."""
    kept, written = collocations.persisted, {}
    monkeypatch.setattr(collocations, "persisted", lambda df, label: written.setdefault(label, df) and kept(df, label))
    texts = [(i, lines(i, 3000), "en") for i in range(4)]
    collocations.mine(spark.createDataFrame(texts, "doc_id long, text string, lang string").coalesce(1), 4)
    for k in range(2, 6):
        relation = written[f"occurrences-{k}"]
        assert {f.name: f.dataType.simpleString() for f in relation.schema} == {"block": "bigint", "own": "int", "codes": "binary", "n": "int", "packed": "binary"}
    occurrences = collocations.occurrences(spark.createDataFrame(texts, "doc_id long, text string, lang string").coalesce(1), 5)
    word = F.transform("words", lambda w, i: F.shiftleft(i.cast("long"), 32) + i)
    pairs = collocations.joined(occurrences.select("block", "own", "codes", word.alias("known")), 1).collect()
    assert len(pairs) == 1
    names, counts = collocations._unpack(pairs[0].packed, pairs[0].n, 2)
    want = Counter()
    for _, text, _ in texts:
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = [x.lower() if x.isascii() else x for x in re.findall(r"[^ \t]+", piece)]
            want.update(zip(words, words[1:]))
    assert names.tolist() == sorted(names.tolist()) and sorted(counts.tolist()) == sorted(want.values()) and len(pairs[0].packed) < 16 * pairs[0].n


def test_no_phrases(docs):
    assert collocations.mine(docs.filter("false")).count() == 0
    assert collocations.mine(docs, least=10**6).count() == 0


def test_phrase_sql(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang").toPandas())
    want = con.sql(collocations._op11_sql(4)).fetchall()
    got = collocations.mine(docs, 4)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == sorted(want)


# alignment


def slow_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders

    a_tok, b_tok = Tokenizer.from_file(tok.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=tok.path("piece_bpe_32k.model"))
    a_tok.encode_special_tokens = True
    import base64

    ranks = dict(map(bytes.split, open(tok.path("byte_bpe_50k.tiktoken"), "rb")))
    a_bytes = {int(i): base64.b64decode(t) for t, i in ranks.items()}
    b_bytes = lambda i: bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()
    counts, parts = Counter(), []
    for doc_id, text, *_ in rows:
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        spelt = (" " + text).encode() if text else b""
        if not text or b"".join(map(a_bytes.get, a)) != spelt or b"".join(map(b_bytes, b)) != spelt:
            parts.append((doc_id, 0, 0, [], []))
            continue
        ends = lambda ids, f: list(np.cumsum([len(f(i)) for i in ids]))
        ae, be = ends(a, a_bytes.get), ends(b, b_bytes)
        both = sorted(set(ae) & set(be))
        groups = ["|".join(",".join(str(i) for i, e in zip(ids, es) if p < e <= q) for ids, es in ((a, ae), (b, be))) for p, q in zip([0, *both], both)]
        links = [(i, j) for e in both for i, j in [(a[ae.index(e)], b[be.index(e)])]]
        counts.update(links)
        parts.append((doc_id, len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    del decoders
    return sorted((str(d), na, nb, len(g), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, na, nb, g, x in parts)


@pytest.mark.parametrize("block", [1 << 18, 20])
def test_alignment_equals_brute_force(docs, rows, block):
    short = [r for r in rows if len(r[1] or "") < 8000]
    got = alignment.aligned(docs.filter(F.coalesce(F.length("text"), F.lit(0)) < 8000), tok.path("byte_bpe_50k.json"), tok.path("piece_bpe_32k.model"), tok.PATTERN, block=block)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == slow_alignment(short)


def test_units_are_encoded_as_whole_texts():
    v = alignment.Vocabularies(open(tok.path("byte_bpe_50k.json"), encoding="utf-8").read(), open(tok.path("piece_bpe_32k.model"), "rb").read(), tok.PATTERN)
    v.a.encode_special_tokens = True
    rng, letters = random.Random(5), ["a", "b", " ", "  ", "\n", "'s", "é", "12", ".", "你", "\t", "Z<|endoftext|>", "\r"]
    assert v.by_units
    for _ in range(500):
        text = " " + "".join(rng.choice(letters) for _ in range(rng.randrange(1, 30)))
        a, b = v.encode(v.units(text))
        assert sum(a, []) == v.a.encode(text, add_special_tokens=False).ids and sum(b, []) == v.b.encode(text[1:])


def test_coalescing_of_any_intervals():
    rng = np.random.default_rng(3)
    for _ in range(300):
        def side():
            cuts = np.sort(rng.choice(60, 2 * rng.integers(1, 12), replace=False))
            return cuts[::2], cuts[1::2]

        (s, e), (t, f) = side(), side()
        g, h = alignment.coalesce(s, e, t, f)
        x, y = alignment.overlaps(s, e, t, f)
        assert sorted(zip(x, y, strict=True)) == [(i, j) for i in range(len(s)) for j in range(len(t)) if s[i] < f[j] and t[j] < e[i]]
        assert all(g[i] == h[j] for i, j in zip(x, y, strict=True))
        parent = list(range(len(s) + len(t)))
        find = lambda i: i if parent[i] == i else find(parent[i])
        for i, j in zip(x, y, strict=True):
            parent[find(i)] = find(len(s) + j)
        assert len({find(i) for i in range(len(parent))}) == len({*g, *h})


def test_links_by_overlap(spark):
    df = spark.createDataFrame([(1, "unbelievable tokenisations"), (2, "plain")], "doc_id long, text string")
    paths = tok.path("byte_bpe_50k.json"), tok.path("piece_bpe_32k.model"), tok.PATTERN
    got = {r.doc_id: r for r in alignment.aligned(df, *paths, rule="overlap").collect()}
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups for r in got.values())  # two tilings of the same bytes


def test_no_alignment_of_no_rows(docs):
    assert alignment.aligned(docs.filter("false"), tok.path("byte_bpe_50k.json"), tok.path("piece_bpe_32k.model"), tok.PATTERN).count() == 0


# packing


def slow_bins(lengths, size):
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect_left(rooms, x)
        room = rooms.pop(at) if at < len(rooms) else size
        n += room == size
        if room > x:
            insort(rooms, room - x)
    return n


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(200):
        size = rng.choice([8, 30, 100])
        counts = {rng.randrange(1, size + 1): rng.randrange(1, 40) for _ in range(rng.randrange(1, 12))}
        used = defaultdict(list)
        for length, first, after, each, sequence, at in packing.plan(counts, size):
            for rank in range(first, after):
                i = rank - first
                used[sequence + i // each].append((at + i % each * length, length, rank))
        assert Counter((n, r) for x in used.values() for _, n, r in x) == Counter((n, r) for n, c in counts.items() for r in range(c))
        for x in used.values():
            x.sort()
            assert x[0][0] == 0 and all(a + n == b for (a, n, _), (b, *_) in zip(x, x[1:])) and x[-1][0] + x[-1][1] <= size
        assert len(used) == slow_bins([n for n, c in counts.items() for _ in range(c)], size)
        assert len(packing.plan(counts, size)) <= (1 + 3 * size) * (2 * size) ** 0.5


def test_plan_does_not_grow_with_the_corpus():
    few, many = ({n: c * (1 + n % 5) for n in range(1, 2049)} for c in (10, 10**9))
    assert len(packing.plan(many)) < 2 * len(packing.plan(few)) < 40_000


@pytest.mark.parametrize("size", [2048, 10])
def test_packing(docs, rows, size):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tok.path("word_bpe_49k.json"))
    want, lengths = [], []
    for doc_id, text, _ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), size)):
            own = ids[start : start + size]
            lengths.append(len(own))
            want.append((str(doc_id), piece, start, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))))
    found = packing.packed(docs, tok.path("word_bpe_49k.json"), size, with_ids=True)
    got = found.collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length, r.ids))
    for x in by.values():
        x.sort()
        assert [o for o, *_ in x] == [sum(n for _, n, _ in x[:i]) for i in range(len(x))] and sum(n for _, n, _ in x) <= size
    assert len(by) == slow_bins(lengths, size)
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(found).collect()}
    assert whole == {k: b"".join(bytes(i) for *_, i in x) for k, x in by.items()}


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = tok.path("word_bpe_49k.json")
    t, words = Tokenizer.from_file(path), packing.WordIds(open(path, encoding="utf-8").read())
    rng, letters = random.Random(4), ["a", "B", " ", "\n", "\x1c", "'s", "'LL", "é", "é", "İ", "Σ", "12", ".,", "你", " ", " ", "<|endoftext|>", "<|", "x1y", "́"]
    for _ in range(1000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 25)))
        assert words.text(text) == b"".join(i.to_bytes(4, "little") for i in t.encode(text, add_special_tokens=False).ids), repr(text)


def test_nothing_to_pack(docs):
    assert packing.packed(docs.filter("false"), tok.path("word_bpe_49k.json")).count() == 0
