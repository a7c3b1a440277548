import hashlib
import struct

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqlattice.llm import bpe, pii, quality, simhash

from .test_operators import prose, slow_quality


def least_of_alike(texts):
    """Least id that each text reaches through pairs whose sets of five-word shingles are alike by 0.8 or more."""
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in ((i, t.lower().split()) for i, t in texts.items())}
    least = {i: i for i in sets}
    alike = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in sets:
        for i, j in alike:
            least[i] = least[j] = min(least[i], least[j])
    return least


def changed(text, places):
    return " ".join("another" if k in places else w for k, w in enumerate(text.split()))


def test_pipeline_equals_brute_force(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    item = " ".join(f"q{i}" for i in range(25))
    texts = {i: prose(i, 80 + i) for i in range(20)}
    texts |= {20: texts[3], 21: texts[4].upper(), 22: f"{prose(31, 40)} {item} {prose(32, 40)}", 23: f"{prose(33, 40)} bob@mail.com {prose(34, 10)}", 24: "short", 25: None, 26: " ".join(w + "###" for w in prose(9, 60).split())}
    # A chain of near copies, whose ends are not alike; and a text changed in too many places.
    texts |= {27: changed(texts[5], {40}), 28: changed(texts[5], {20, 40}), 29: changed(texts[5], {20, 40, 60, 61}), 30: changed(texts[6], {10, 20, 30, 40, 50})}
    docs = [(i, t, "en", "s", len(t) if t else None) for i, t in texts.items()]
    tables = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame([(i, 1, 0) for i in range(15)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, item)], "item_id long, text string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    ratios = quality.fit(tables["documents"], tables["labels"])
    left = {i: t for i, t in texts.items() if slow_quality(t, ratios)[-1]}
    least = least_of_alike(left)
    left = {i: t for i, t in left.items() if least[i] == i}
    assert {27, 28, 29}.isdisjoint(left) and 30 in left
    left = {i: t for i, t in left.items() if item not in t}
    left = {i: t.replace("bob@mail.com", "[EMAIL]") for i, t in left.items()}
    codec = bpe.Codec.load(*bpe.public_vocabulary())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = {i: (len(ids := codec.encode(t)), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(t.encode())) for i, t in left.items()}
    assert got == expected and {20, 21, 22, 24, 25}.isdisjoint(got) and 23 in got


def test_stages_keep_the_columns(spark):
    df = spark.createDataFrame([(1, prose(1, 60), "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert pii.redact(df, pii.fit(df)).columns == df.columns and [n for n, _ in corpus_pipeline.STAGES][0] == "quality_rules"
    assert dict(pii.redact(df.withColumn("text", F.lit("x a@b.co")), pii.fit(df)).dtypes)["n_chars"] == "bigint"


def test_near_copies_are_dropped(spark):
    words = [f"w{i}" for i in range(112)]
    near = " ".join("other" if i == 50 else w for i, w in enumerate(words))
    df = spark.createDataFrame([(9, near, "en", "s", 5), (4, " ".join(words), "en", "s", 5), (1, prose(1, 60), "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4] and kept.columns == df.columns


def test_stages_take_odd_tables(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int, __at long"
    long = prose(3, 30_000)
    rows = [(1, None, "en", "s", None, "a", 0, 1), (2, "", "en", "s", 0, "a", 0, 1), (None, prose(2, 60), None, None, 5, "b", 1, 2), (7, long, "en", "s", len(long), "a", 0, 1), (7, long, "en", "s", len(long), "a", 0, 1)]
    spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    left = {"quality_rules": 3, "near_duplicates": 3, "decontamination": 5, "personal_data": 5, "tokens": 5}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == left[name], name
        assert name == "tokens" or out.columns == docs.columns


def test_near_copies_go_through_ball_hashing(spark, monkeypatch):
    texts = {i: prose(i, 300) for i in range(8)} | {20 + i: changed(prose(i, 300), {150}) for i in range(8)} | {40: "", 41: " ", 42: None, 43: "one two"}
    df = spark.createDataFrame([(i, t, "en", "s", 5) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    made, ball = [], simhash.ball_pairs
    monkeypatch.setattr(simhash, "ball_pairs", lambda heads: made.append((heads.collect(), ball(heads).collect())) or ball(heads))
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert sorted(r.doc_id for r in kept.collect()) == [*range(8), 40, 43]
    ((heads, pairs),) = made
    marks = {r.fp: r.mark & (1 << 64) - 1 for r in heads if r.n}
    near = {(a, b) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= simhash.RADIUS}
    roots = {f: f for f in marks}
    for _ in marks:
        for a, b in pairs:
            assert (marks[a] ^ marks[b]).bit_count() <= simhash.RADIUS
            roots[a] = roots[b] = min(roots[a], roots[b])
    assert near and all(roots[a] == roots[b] for a, b in near)
