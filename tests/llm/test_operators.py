import hashlib
import itertools
import math
import random
import re
import struct
import textwrap
import time
import zlib
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from seqlattice.llm import bpe, decontam, langid, license_scan, pii, quality, sharding, simhash, toxicity, warc
from seqlattice.llm.common import CLEANUP, discard, held_out, persisted, scratch
from seqlattice.llm.components import components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Nulls, empty and long texts, ties and repeated rows."""
    texts = [None, "", " \n\t ", "one", "Two words", prose(1, 40), prose(1, 40), prose(1, 40).upper(), prose(2, 5000), "é中😀 \x0b x", prose(3, 60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(None, prose(1, 40)), (5, texts[5]), (None, None)]


@pytest.fixture
def docs(spark, odd):
    df = spark.createDataFrame(odd, "doc_id long, text string")
    return df.withColumns({"id": F.lit("clash"), "size": F.lit(1), "spans": F.lit("x"), "h": F.lit(0), "score": F.lit(0)})


@pytest.fixture
def empty(docs):
    return docs.filter("false")


# sharding


def test_shards(docs, odd):
    rows = sharding.assign_shards(docs, 3).collect()
    data = lambda t: (t or "").encode()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(i), len(data(t)) + 8, zlib.crc32(data(t))) for i, t in odd)
    by = Counter(r.shard for r in rows)
    assert max(by.values()) - min(by.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in by.items())


def test_shards_ignore_the_layout(spark, docs):
    key = lambda df: sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in sharding.assign_shards(df, 4).collect())
    assert key(docs) == key(docs.repartition(7, "text"))


def test_scopes_of_threads_are_apart(spark):
    """A scope deletes tables of its own thread only."""
    with scratch():
        with ThreadPoolExecutor(1) as pool:
            other = pool.submit(lambda: persisted(spark.range(3), "other")).result()
        own = persisted(spark.range(4), "own")
        assert own.count() == 4
    assert other.count() == 3
    discard(other)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|not exist"):
        spark.read.schema(own.schema).parquet(own._seqlattice_path).count()


def test_the_setting_for_shuffle_files_returns(spark):
    setting, counts = spark.conf.get(CLEANUP), spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    with scratch():
        assert persisted(counts, "counts").count() == counts.count() == 7
        with ThreadPoolExecutor(4) as pool:
            list(pool.map(lambda i: persisted(counts, f"counts-{i}"), range(4)))
        assert spark.conf.get(CLEANUP) == setting and counts.count() == 7


def test_writes_leave_no_shuffle_files(spark):
    files = lambda: {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    before = files()
    with scratch():
        persisted(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
        for _ in range(50):
            if not (left := files() - before):
                break
            time.sleep(0.1)
        assert not left


def test_attached_shards(spark, docs, empty):
    """One row for each row, repeated ones included, with the places that ``assign_shards`` gives."""
    extra = spark.createDataFrame([(None, None, f"x{i % 3}") for i in range(40)] + [(5, "same", "y")] * 30, "doc_id long, text string, id string")
    df = docs.unionByName(extra, allowMissingColumns=True).withColumns({"shard": F.lit("clash"), "nth": F.lit(1), "key": F.lit("k"), "row": F.lit(0)})
    got = sharding.attach_shards(df, 5)
    assert got.columns == [c for c in df.columns if c != "shard"] + ["shard", "slot"]
    rows = got.collect()
    key = lambda r: (str(r.doc_id), zlib.crc32((r.text or "").encode()), r.shard, r.slot)
    assert sorted(map(key, rows)) == sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in sharding.assign_shards(df, 5).collect())
    assert Counter(map(repr, got.drop("shard", "slot").collect())) == Counter(map(repr, df.drop("shard").collect()))
    assert sharding.attach_shards(empty).count() == 0


def test_no_shards_for_no_rows(empty):
    assert sharding.assign_shards(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1001])
def test_permutation(spark, n):
    df = sharding.permute(spark.range(n), "id", F.lit(n).cast("long"), "p")
    rows = sharding.permute(df, "p", F.lit(n).cast("long"), "q", inverse=True).collect()
    assert sorted(r.p for r in rows) == list(range(n)) and all(r.q == r.id for r in rows)


def test_hot_groups_are_cut(spark):
    rows = sharding.row_numbers(spark.range(1000).select(F.lit(1).alias("k")), ["k"], buckets=8, chunk=64).collect()
    assert sorted(r.row for r in rows) == list(range(1000))


# near-duplicates


def slow_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """Least id of each fingerprint's component, by looking at all pairs."""
    root = {p: p for p, _ in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in list(root):
        for b in list(root):
            if (a ^ b).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    ids = {}
    for p, i in prints:
        ids.setdefault(find(p), []).append(i)
    return {p: min((i for i in ids[find(p)] if i is not None), default=None) for p in root}


def test_near_duplicates(docs, odd):
    prints = [(slow_fingerprint(t), i) for i, t in odd]
    expected = slow_components(prints)
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in got) == sorted((str(i), p, expected[p]) for p, i in prints)


def test_one_of_each(docs, empty):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    # no words; the short ones; one prose of three forms; the long one; the other prose
    assert sorted((str(r.doc_id) for r in kept.collect()), key=str) == ["0", "10", "3", "4", "5", "8", "9"]
    assert simhash.one_of_each(empty).count() == 0


def test_similar_sets_are_one_component(spark, docs, odd, empty, monkeypatch):
    rng = random.Random(6)
    texts = [t for _, t in odd]
    for i in range(12):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(900)) for _ in range(rng.choice([9, 60, 200]))]
        texts += [" ".join(base)] + [" ".join(w if rng.random() > share else "other" for w in base) for share in (0.01, 0.02, 0.04, 0.08)]
    grams = lambda w: {tuple(w[max(0, i) : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def check(texts):
        sets = [grams((t or "").encode().lower().split()) for t in texts]
        root = list(range(len(sets)))
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a == b or 5 * len(a & b) >= 4 * len(a | b):
                    low, high = sorted((root[i], root[j]))
                    root = [low if r == high else r for r in root]
        got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=5, similarity=0.8).collect()
        assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root)) and len(set(root)) < len(set(map(frozenset, sets)))

    check(texts)
    monkeypatch.setattr(simhash, "ALL", 2)
    monkeypatch.setattr(simhash, "HUBS", 1)
    monkeypatch.setattr(simhash, "NEXT", 1)
    monkeypatch.setattr(simhash, "BLOCK", 3)
    monkeypatch.setattr(simhash, "SAMPLE", 2)
    shared = " ".join(base)
    more = [" ".join([*base[:150], *(rng.choice("abc") + str(rng.randrange(90)) for _ in range(n))]) for n in (0, 5, 15, 30, 50, 90) for _ in range(5)]
    check(texts + more + [shared + " " + t for t in texts[:8] if t])
    assert simhash.one_of_each(docs, width=5, similarity=0.8).columns == docs.columns
    assert simhash.one_of_each(empty, width=5, similarity=0.8).count() == 0


def test_links_join_all_within_two_bits(spark):
    rng = random.Random(4)
    base = rng.getrandbits(63)
    fps = {base} | {base ^ (1 << a) ^ (1 << b) for a, b in [(0, 1), (5, 9), (63, 2), (7, 7), (63, 62)]} | {rng.getrandbits(63) for _ in range(20)} | {base ^ 0b111}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= 2 for r in edges.collect())
    root = {r.node % 2**64: r.root for r in components(edges).collect()}
    least = slow_components([(f, f) for f in fps])
    groups = Counter(least.values())
    assert {f for f in fps if groups[least[f]] > 1} == set(root)
    assert len(set(root.values())) == sum(n > 1 for n in groups.values())


def test_components_of_a_long_chain(spark):
    rows = components(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200)], "a long, b long")).collect()
    assert {r.root for r in rows} == {0, 100} and len(rows) == 43


# WARC


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 2000
    pages = [(1, "http://a", big), (2, "http://b", big), (9, None, big), (3, "http://c", "small"), (4, "http://d", "small"), (5, "e", None), (6, "f\r\nX: y", "é" * 600), (None, "g", big), (9, "h", big), (7, "i", ""), (None, None, None), (8, "j", "é" * 600), (2, "http://b", big)] + [(None, f"u{i % 7}", big) for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    files = warc.write(df, f"file://{tmp_path}/w", shard_bytes=3000, file_bytes=400)
    rows = warc.read(spark, files, f"file://{tmp_path}/w").collect()
    assert sorted((str(r.page_id), r.payload_bytes) for r in rows) == sorted((str(i), len((h or "").encode())) for i, _, h in pages)
    for r in rows:
        same = [i for i, _, h in pages if hashlib.sha1((h or "").encode()).hexdigest() == r.payload_digest]
        keeper = max((i for i in same if i is not None), default=None)
        revisit = r.payload_bytes >= 1000 and len(same) > 1 and r.page_id != keeper
        assert (r.record_type, r.refers_to) == (("revisit", keeper) if revisit else ("response", None))
        assert revisit or hashlib.sha1(r.payload).hexdigest() == r.payload_digest
    ids = [r.record_id for r in rows]
    at = {r.record_id: r for r in rows}
    assert len(set(ids)) == len(ids) == len(pages)
    for r in rows:
        assert (r.refers_to_record is None) == (r.record_type == "response")
        if r.refers_to_record:
            named = at[r.refers_to_record]
            assert (named.record_type, named.page_id, named.payload_digest) == ("response", r.refers_to, r.payload_digest)
    first = next(warc.members((tmp_path / "w" / files.first().file).open("rb")))
    assert warc.parse(first)["warc-type"] == "warcinfo"
    listed = {r.file: r.sha256 for r in files.collect()}
    on_disk = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in (tmp_path / "w").glob("*.warc.gz")}
    assert listed == on_disk and len(listed) > 2 and not (tmp_path / "w" / warc.TEMPORARY).exists()
    assert sorted(warc.listed(spark, f"file://{tmp_path}/w").collect()) == sorted(files.collect())
    again = warc.write(df.repartition(5), f"file://{tmp_path}/v", shard_bytes=3000, file_bytes=400)
    assert {r.file: r.sha256 for r in again.collect()} == listed
    assert warc.read(spark, warc.write(df.filter("false"), f"file://{tmp_path}/n"), f"file://{tmp_path}/n").count() == 0
    assert warc.listed(spark, f"file://{tmp_path}/n").count() == 0


def test_warc_attempts(spark, tmp_path):
    """Attempts that are repeated or killed after any of their steps: what manifests name is there, whole, at every moment."""
    folder = f"file://{tmp_path}"
    records = [warc.record(i, f"u{i}", b"x" * 900, hashlib.sha1(b"x" * 900).hexdigest(), 900) for i in range(5)]
    (tmp_path / warc.TEMPORARY).mkdir()

    def attempt(name, steps, shard="shard-a", data=records):
        """Take ``steps`` records, then be killed; without a number of steps, finish."""
        writer = warc._Shard(folder, shard, 400, name)
        for r in data[:steps]:
            writer.add(r)
        return writer.close() if steps is None else None

    def whole():
        for r in warc.listed(spark, folder).collect():
            data = (tmp_path / r.file).read_bytes()
            assert (hashlib.sha256(data).hexdigest(), len(data)) == (r.sha256, r.bytes)
        return warc.read(spark, warc.listed(spark, folder), folder).count()

    attempt("killed", 3)
    attempt("other", 4, shard="shard-b")
    assert list(tmp_path.glob("*.warc.gz")) and whole() == 0  # files, but no manifest
    done = attempt("second", None)
    assert whole() == 5
    before = {p.name: p.stat().st_ino for p in tmp_path.glob("shard-a*")}
    for k in range(len(records) + 1):
        attempt(f"late-{k}", k)
        assert whole() == 5
    assert attempt("repeated", None) == done
    assert {p.name: p.stat().st_ino for p in tmp_path.glob("shard-a*")} == before  # not one was replaced
    with pytest.raises(FileExistsError):
        attempt("foreign", None, data=records[::-1])
    assert whole() == 5


# models


def test_toxicity(spark, docs, empty):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        text = prose(i, rng.randint(20, 60))
        rows.append((i, text + (f". You {rng.choice(['gorblat', 'snivlok'])} {prose(i + 999, 3)}." if toxic else "."), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    scored = toxicity.score(df.select("doc_id", "text", "toxic", held_out(F.col("doc_id")).alias("out")), model).filter("out").collect()
    assert len(scored) > 50
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in scored) >= 0.95 * len(scored)
    hits = [r for r in scored if r.toxic and r.score >= 0.5]
    assert sum("gorblat" in r.worst or "snivlok" in r.worst for r in hits) >= 0.9 * len(hits)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got) and {r.worst for r in got if r.doc_id == 0} == {None}
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic").filter("false")).score(-40.0) < 0.01


def test_langid(spark, docs, empty):
    speech = {"aa": "ka lo mi tun sar".split(), "bb": "xeq zhu wyv qop jaz".split(), "cc": "ñeé öst üld ßag äck".split()}
    rng = random.Random(2)
    rows = [(i, lang, " ".join("".join(rng.sample(parts, 2)) for _ in range(30))) for i, (lang, parts) in enumerate(list(speech.items()) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.fit(df)
    found = langid.identify(df.select("doc_id", F.col("lang").alias("truth"), "text"), model).collect()
    assert sum(r.lang_pred == r.truth for r in found) >= 0.98 * len(found)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert (got[0].lang_pred, got[0].score) == ("und", 0.0) and got[2].lang_pred == "und" and got[5].lang_pred in speech
    long = ["½ ²", "2024 _", "".join(rng.choice(speech["bb"]) for _ in range(200_000)), "नमस्ते"]
    assert [x[0] for x in model.predict_all(long)][:3] == ["und", "und", "bb"] and langid.counted_words(long[3]).total() == 1
    assert langid.identify(empty, model).count() == 0 and langid.fit(df.filter("false")).predict("abc")[0] == "und"


def test_licences(spark, docs, empty):
    model = license_scan.Model([prose(i, 25).split() for i in range(300)])
    texts = [prose(1, 30) + "\nReleased under the MIT License.\n" + prose(2, 10), prose(3, 50), "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3.", None, ""]
    rows = license_scan.licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.families for r in rows] == ["mit", "", "cc-by-nc", "apache,gpl", "", ""] and rows[3].n_licence == 2
    assert license_scan.licences(docs, model).count() == docs.count() and license_scan.licences(empty, model).count() == 0


def test_frequent_notice_is_found(spark):
    notice = "Released under the MIT License."
    rows = [(i, prose(i, 25) + (f"\n{notice}" if i % 3 == 0 else "")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = license_scan.licences(docs, license_scan.Model(license_scan.background(docs))).collect()
    assert {r.doc_id: r.families for r in got} == {i: "mit" if i % 3 == 0 else "" for i, _ in rows}
    model = license_scan.Model([notice.lower().rstrip(".").split() + prose(i, 200).split() for i in range(300)])
    assert len(model.templates) == sum(len(license_scan.TEMPLATES[c]) for c in license_scan.FAMILIES)


@pytest.mark.parametrize("width", [40, 60, 76])
def test_wrapped_notices_are_found(spark, width):
    model = license_scan.Model([prose(i, 25).split() for i in range(300)])
    notices = [(c, t) for c in ("bsd", "gpl", "isc", "lgpl", "mit") for t in license_scan.TEMPLATES[c] if len(t) > 90]
    wrapped = [f"{prose(1, 9)}\n\n" + "\n".join(f" * {x}" for x in textwrap.wrap(t, width)) + f"\n\n{prose(2, 9)}" for _, t in notices]
    both = wrapped[0].replace(prose(2, 9), "Released under the ISC License.")
    rows = license_scan.licences(spark.createDataFrame(list(enumerate([*wrapped, both])), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert {c for c, _ in notices} == {"bsd", "gpl", "isc", "lgpl", "mit"}
    assert [(r.families, r.n_licence, r.n_unknown) for r in rows] == [(c, 1, 0) for c, _ in notices] + [("bsd,isc", 2, 0)]


# personal data

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def slow_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans(spark, docs, empty):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab.@-_+1234 ()😀é,%") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += ["".join(rng.choice("0123456789.+ -") for _ in range(60)) for _ in range(400)]
    texts += ["a@b.c_d@e.f x@y.z@w.v", "1" * 3000, "a@" + "b." * 9000 + "c", None, "", "4111 1111-1111 1111", "999.1.1.1 1.2.3.4.5 +1 (555) 555-0100"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.fit(df)
    for r in pii.find(df.select("doc_id", F.col("text").alias("t")), model, "t").collect():
        assert [(c.s, c.k, c.e) for c in r.spans if c.base] == slow_spans(texts[r.doc_id]), texts[r.doc_id]
    assert pii.find(docs.drop("spans"), model).count() == docs.count() and pii.find(empty, pii.fit(empty)).count() == 0


def test_added_spans_and_redaction(spark):
    rng = random.Random(5)
    rows = [(i, f"write to ann{i}@mail.com or call +1 (555) 555-{rng.randint(1000, 9999)} now", 1) for i in range(200)]
    rows.append((200, "mail me: joe (at) example (dot) com, call (456) 555-2186", 1))
    rows.append((201, None, None))
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in pii.redact(df, pii.fit(df)).collect()}
    assert got[0].text == "write to [EMAIL] or call [PHONE] now" and got[0].n_chars == len(got[0].text)
    assert got[200].text == "mail me: [EMAIL], call [PHONE]" and got[201].text is None


def test_long_texts(spark):
    rng = random.Random(9)
    pieces = ["joe{}@mail.com", "10.0.{}.7", "+1 (555) 555-{:04d}", "über {}", "4111 1111 1111 1111,", "call (456) 555-{:04d}", "\n😀"]
    text = " ".join(rng.choice(pieces).format(i % 250) for i in range(4000))
    model = pii.fit(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    df = spark.createDataFrame([(1, text, 0)], "doc_id long, text string, n_chars long")
    found = pii.find(df, model).first().spans
    base = slow_spans(text)
    assert [(c.s, c.k, c.e) for c in found if c.base] == base and len(base) > 6 * pii.RUN
    assert not any(a < c.e and c.s < b for c in found if not c.base for a, _, b in base)
    at, out = 0, []
    for c in found:
        if c.s >= at:
            out += [text[at : c.s], f"[{pii.KINDS[c.k].upper()}]"]
        at = max(at, c.e)
    row = pii.redact(df, model).first()
    assert row.text == "".join(out) + text[at:] and row.n_chars == len(row.text)


def loose_spans(seed, n):
    """Texts, the spans in them that only the looser patterns can find, and decoys like them."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    rows = []
    for i in range(n):
        good = rng.choice([
            ("mail to ", "email", f"ann{i} (at) example.com"), ("contact ", "email", f"joe.{i}[at]mail[dot]org"), ("phone ", "phone", f"(4{digits(2)}) 555-{digits(4)}"),
            ("tel. ", "phone", f"5{digits(2)}-555-{digits(4)}"), ("card ", "card", "4111.1111.1111.1111"), ("host ", "ip", ":".join(f"{rng.randrange(4096, 65536):x}" for _ in range(8))),
        ])
        bad = rng.choice([("part ", f"9{digits(3)}.{digits(4)}.{digits(4)}.0000"), ("page ", "look (at) this"), ("code ", f"0{digits(2)}.1{digits(2)}.{digits(4)}")])
        text = f"{prose(i, 12)} {good[0]}{good[2]}, {prose(i + 1, 5)} and {bad[0]}{bad[1]} {prose(i + 2, 6)}; write to user{i}@mail.com or +1 (555) 555-{digits(4)}"
        rows.append((i, text, text.index(good[2]), good[1], text.index(good[2]) + len(good[2])))
    return rows


def added_quality(spark, rows):
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = {(r.doc_id, c.s, pii.KINDS[c.k], c.e) for r in pii.find(df, pii.fit(df)).collect() for c in r.spans if not c.base}
    true = {(i, s, kind, e) for i, _, s, kind, e in rows}
    return len(found & true) / len(found), len(found & true) / len(true)


def test_added_spans_are_right(spark):
    precision, recall = added_quality(spark, loose_spans(1, 300))
    assert precision >= 0.9 and recall >= 0.9, (precision, recall)


# decontamination


def slow_leaks(tokens, item):
    """True if some alignment agrees in enough positions of a stretch of the item."""
    n, length = len(item), min(len(item), decontam.STRETCH)
    needed = n if n < decontam.VERBATIM else -(-4 * length // 5)
    for start in range(1 - n, len(tokens)):
        equal = [0 <= start + j < len(tokens) and tokens[start + j] == t for j, t in enumerate(item)]
        if n and max(sum(equal[i : i + length]) for i in range(n - length + 1)) >= needed:
            return True
    return False


def test_leaks_equal_brute_force(spark):
    rng = random.Random(11)
    token = lambda: f"v{rng.randrange(40)}"
    items = [[token() for _ in range(n)] for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 15, 16, 19, 20, 21, 33, 60)] + [[]]
    items[0], items[1] = ["only"], ["only", "two"]
    texts = []
    for i in range(400):
        item = items[i % len(items)]
        spoilt = [token() if rng.random() < rng.choice([0, 0.1, 0.2, 0.25]) else w for w in item]
        lo = rng.randrange(len(item) + 1) if rng.random() < 0.2 else 0
        texts.append([token() for _ in range(rng.randrange(12))] + spoilt[lo:] + [token() for _ in range(rng.randrange(12))])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    expected = {i: [j for j, item in enumerate(items) if slow_leaks(t, item)] for i, t in enumerate(texts)}
    assert {r.doc_id: list(r["items"]) for r in decontam.contamination(df, bench).collect()} == expected
    assert 100 < sum(map(bool, expected.values())) < 400
    limit, decontam.BITS = decontam.BITS, 64  # a bitmap that is full
    try:
        assert {r.doc_id: list(r["items"]) for r in decontam.contamination(df, bench).collect()} == expected
    finally:
        decontam.BITS = limit


def test_some_seed_meets_every_leak():
    for n in range(decontam.BLOCK + decontam.SECOND, decontam.STRETCH + 1):
        most = n - -(-4 * n // 5) if n >= decontam.VERBATIM else 0
        for spoilt in itertools.combinations(range(n), most):
            whole = [i not in spoilt for i in range(n)]
            threes = [i for i in range(n - 2) if all(whole[i : i + 3])]
            assert any(0 <= i + g <= n - 2 and all(whole[i + g : i + g + 2]) for i in threes for g in decontam.SEEDS), (n, spoilt)


def test_decontamination(spark, docs, empty):
    rng = random.Random(6)
    item = [f"w{rng.randint(0, 10**6)}" for _ in range(30)]
    spoilt = [w if i not in (4, 9, 15, 21) else "other" for i, w in enumerate(item)]
    lead = prose(1, 30).split()
    texts = [" ".join(lead + item + lead), " ".join(lead + spoilt), " ".join(lead + item[:8] + lead), prose(4, 100), " ".join(item).upper() + "!", None, ""]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None)], "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [(r.contaminated, list(r["items"])) for r in decontam.contamination(df, bench).orderBy("doc_id").collect()] == [(x, [7] if x else []) for x in (True, True, False, False, True, False, False)]
    assert sorted(r.doc_id for r in decontam.without_leaks(df, bench).collect()) == [2, 3, 5, 6]
    assert decontam.without_leaks(docs, bench).columns == docs.columns and decontam.contamination(docs, bench.filter("false")).count() == docs.count()
    assert decontam.contamination(empty, bench).count() == 0


def test_any_two_substitutions_are_found(spark):
    item = [f"t{i}" for i in range(12)]
    pairs = [(a, b) for a in range(12) for b in range(a, 12)]
    texts = [" ".join("x" if i in p else w for i, w in enumerate(item)) for p in pairs]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = decontam.contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench)
    assert got.filter("contaminated").count() == len(pairs)


# tokens


@pytest.fixture(scope="module")
def codec():
    pytest.importorskip("public_tokenizers")
    return bpe.Codec.load(*bpe.public_vocabulary())


def test_bpe_equals_the_library(codec):
    tiktoken = pytest.importorskip("tiktoken")
    library = tiktoken.Encoding("own", pat_str=codec.pattern, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice("aaabbeé  \n\t's中文😀<|endoftext|>0123--==__ the THE") for _ in range(rng.randint(0, 60)))
        assert codec.encode(text) == library.encode_ordinary(text) and codec.decode(codec.encode(text)) == text.encode()


def test_bpe_appends_and_edits(codec):
    rng = random.Random(2)
    for _ in range(60):
        data = bytes(rng.choice(b"aabcinthe-=  ") for _ in range(rng.randint(0, 300)))
        cut = rng.randint(0, len(data))
        grown = bpe.Prefixes(codec, data[:cut])
        grown.append(data[cut:])
        assert grown.ids() == bpe.Prefixes(codec, data).ids()
        stop, new = rng.randint(cut, len(data)), bytes(rng.choice(b"thein ab") for _ in range(rng.randint(0, 9)))
        grown.edit(cut, stop, new)
        assert grown.last == bpe.Prefixes(codec, data[:cut] + new + data[stop:]).last


def test_bpe_hands_on_small_parts(codec, monkeypatch):
    """What a task holds of its results follows neither from the rows of a batch nor from the size of a partition."""
    monkeypatch.setattr(bpe, "CACHE", 50)
    texts = [prose(i % 40, 300) for i in range(1500)] + [None, "", prose(1, 200_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got, last = [], max(len(t or "") for t in texts)
    for part in bpe._encoded(iter([batch]), codec, ["doc_id", "ids", "decoded"]):
        assert part.num_rows == 1 or sum(map(len, part.column(1).to_pylist()[:-1])) + sum(map(len, part.column(2).to_pylist()[:-1])) < bpe.GATHERED
        got += part.to_pylist()
    assert len(got) == len(texts) and last > 2**20
    assert [(x["doc_id"], x["decoded"]) for x in got] == [(i, (t or "").encode()) for i, t in enumerate(texts)]
    want = {t: struct.pack(f"<{len(i := codec.encode(t or ''))}I", *i) for t in set(texts)}
    assert [x["ids"] for x in got] == [want[t] for t in texts]


def test_bpe_asks_for_few_prefixes(codec, monkeypatch):
    """Words with common beginnings take under half the look-ups of trying every prefix, with the same ids, however little is remembered."""

    class Counted(dict):
        asked = 0

        def get(self, *args):
            Counted.asked += 1
            return super().get(*args)

    rng = random.Random(5)
    parts = "er en the ing tion ble and ou ea wh ü é 中 ea& x".split()
    words = [" " + "".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(4000)]
    words += ["", *(w * 9 for w in words[:50])]  # the latter are long
    ranks, want = codec.ranks, []
    monkeypatch.setattr(codec, "ranks", Counted(ranks))
    monkeypatch.setattr(codec, "_tails", Counted(codec._tails))
    for word in words:
        last = [-1]
        codec.extend(word.encode(), last)
        want.append(codec.read_back(last))
    every, Counted.asked = Counted.asked, 0
    codec._prefixes.clear()
    assert [codec.encode_piece(w.encode()) if w else [] for w in words] == want
    assert 0 < Counted.asked < every / 2
    monkeypatch.setattr(bpe, "PREFIXES", 3)
    assert [codec.encode_piece(w.encode()) if w else [] for w in words] == want
    with pytest.raises(ValueError):
        bpe.Codec({b"a": 0, b"b": 1, b"ab": 2}, "(?s).").encode_piece(b"abz")


def test_bpe_tasks_of_a_worker_share_their_pieces(codec):
    shipped = (codec.ranks, codec.pattern, codec.parts)
    assert bpe._kept(shipped) is bpe._kept(shipped) and bpe._kept((*shipped,)).codec.ranks is codec.ranks
    other = ({b"a": 0, b"b": 1}, codec.pattern, None)
    assert bpe._kept(other)["ab"] == struct.pack("<2I", 0, 1) and len(bpe._KEPT) == 2


def test_bpe_rows(codec, docs, odd, empty):
    rows = bpe.round_trip(docs, *bpe.public_vocabulary()).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = []
    for i, t in odd:
        ids = codec.encode(t or "")
        expected.append((str(i), len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((t or "").encode())))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(expected)
    assert bpe.round_trip(empty, *bpe.public_vocabulary()).count() == 0


# quality


def slow_quality(text, model):
    words = WORD.findall(text or "")
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {i + j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    sign = lambda h: h - (1 << 64) if h >> 63 else h
    one = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    two = [xxhash.xxh64_intdigest(struct.pack("<Q", b), xxhash.xxh64_intdigest(struct.pack("<Q", a), 42)) for a, b in zip(one, one[1:])]
    total = sum(model.ratios[sign(h) % quality.BUCKETS] for h in one) + sum(model.ratios[quality.BUCKETS + sign(h) % quality.BUCKETS] for h in two)
    failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again), failed, not failed and total >= model.threshold * len(words))


def test_quality(spark, docs, odd, empty):
    more = [(100 + i, prose(50 + i, 60)) for i in range(30)] + [(200 + i, " ".join(w + "###" for w in prose(90 + i, 60).split())) for i in range(30)]
    more += [(300, "\n".join(["same line here"] * 5 + [prose(7, 30)])), (301, " ".join(["again and again"] * 40)), (302, prose(5, 30) + "\n" + prose(5, 12))]
    rows = odd + more
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(100 + i, 1) for i in range(30)] + [(100, 1), (None, 1)], "doc_id long, quality int")
    ratios = quality.fit(df, labels)
    assert ratios.threshold == quality.NOTHING  # too few to set one
    ratios = quality.Model(ratios.ratios, sorted(r.score for r in quality.judge(df, ratios).collect() if 100 <= (r.doc_id or 0) < 130)[0].__floor__())
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = sorted((str(r.doc_id), *(r[c] for c in cols)) for r in quality.judge(df, ratios).collect())
    assert got == sorted((str(i), *slow_quality(t, ratios)) for i, t in rows)
    kept = {r[0] for r in got if r[-1]}
    assert {str(100 + i) for i in range(30)} <= kept
    scores = {r.doc_id: r.score for r in quality.judge(df, ratios).collect()}
    assert max(scores[200 + i] for i in range(30)) < min(scores[100 + i] for i in range(30))
    assert quality.passing(docs, labels).columns == docs.columns
    assert quality.passing(empty, labels).count() == 0
    assert set(quality.fit(df, labels.filter("false")).ratios) == {0}


def test_quality_threshold(spark):
    rng = random.Random(13)
    good = [(i, prose(i, 60)) for i in range(600)]
    junk = [(1000 + i, " | ".join(rng.choice(WORDS)[: rng.randint(1, 4)] + rng.choice("xyz") for _ in range(60))) for i in range(60)]
    df = spark.createDataFrame(good + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:500]], "doc_id long, quality int")
    model = quality.fit(df, labels)
    ids = labels.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0).alias("held"))
    held = {r.doc_id for r in ids.filter("held").collect()}
    rows = {r.doc_id: r for r in quality.judge(df, model).collect()}
    assert len(held) > quality.LEAST_HELD and model.threshold == math.floor(sorted(rows[i].score for i in held)[int(quality.LOSS * len(held))])
    assert sum(rows[i].kept for i, _ in good[500:]) >= 98 and not any(rows[i].kept for i, _ in junk)
    # the ratios, counted plainly
    one = lambda ids: Counter(w for i in ids for w in dict(good + junk)[i].split())
    raw, target = one(dict(good + junk)), one([i for i, _ in good[:500] if i not in held])
    word = next(iter(target))
    slot = (lambda h: (h - (1 << 64) if h >> 63 else h) % quality.BUCKETS)(xxhash.xxh64_intdigest(word.encode(), 42))
    p = (raw[word] + 0.5) / (raw.total() + 0.5 * quality.BUCKETS)
    assert model.ratios[slot] == round(1000 * math.log((target[word] + quality.PRIOR * p) / (target.total() + quality.PRIOR) / p))


def test_quality_target_is_every_labelled_document(spark):
    n = 24_000
    df = spark.range(2 * n).selectExpr("id AS doc_id", "concat('all ', if(id % 2 = 0, 'good', 'other')) AS text")
    labels = spark.range(n).selectExpr("id * 2 AS doc_id", "1 AS quality")
    assert quality.target_ids(labels).count() == n
    counted = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) != 0).count()
    slot = (lambda h: (h - (1 << 64) if h >> 63 else h) % quality.BUCKETS)(xxhash.xxh64_intdigest(b"good", 42))
    p = (n + 0.5) / (4 * n + 0.5 * quality.BUCKETS)
    assert quality.fit(df, labels).ratios[slot] == round(1000 * math.log((counted + quality.PRIOR * p) / (2 * counted + quality.PRIOR) / p))
