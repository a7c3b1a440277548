"""Quality rules: a hashed n-gram log-likelihood ratio behind two plain rules.

The n-grams are the words and the pairs of neighbouring words. Each is hashed
(XXH64) into its own half of a table of ``2 * BUCKETS`` counts. The raw
multinomial is counted over all documents. The trusted target is all documents
labelled quality 1, found by one join on the id and written once. Most texts that
have no such label stay away from its shuffle by a bitmap of fixed size, never one
that has. The target is smoothed with
``PRIOR`` pseudo-counts drawn from the raw distribution, so with few or no labels
the ratio goes to zero. Ratios are whole milli-nats: a document's sum is exact in
any order. A document is kept if it passes the plain rules and its sum per word
is the threshold or more.

The threshold is not set by hand: a fifth of the target, by another hash of the
id, is not counted but scored, and the threshold is the score that all but
``LOSS`` of those reach (of those that pass the plain rules; rounded down). With
fewer than ``LEAST_HELD`` of them nothing is rejected by score.

Scoring reads one row at a time with no shuffle: the table of ratios (a bounded
number of integers) is a constant of the plan. Counting has a map-side combine
and shuffles at most ``2 * BUCKETS`` rows per task. DataFrame functions only.

Edge cases: null, empty and blank texts have no words and fail the base rules;
a repeated line or window counts inside its own text only; repeated rows and
null ids keep their rows; an empty table gives an empty result; a document has
one verdict however often its score occurs; other columns are kept by
:func:`judge` (names that start with ``__q`` are reserved, columns named as its
own are replaced; :func:`passing` keeps all).
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, persisted, scratch, words

BUCKETS = 1 << 14
#: Bits of the filter of target ids: what is broadcast, 64 a row, whatever the number of labels.
FILTER_BITS = 1 << 24
PRIOR = 20_000.0
#: Share of held-out target documents that the threshold may cost.
LOSS = 0.002
LEAST_HELD = 50
#: Milli-nats a word that no document can have.
NOTHING = -1_000_000
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"


class Model(NamedTuple):
    """Log-likelihood ratio of each bucket, and the least score that is kept, in milli-nats."""

    ratios: list[int]
    threshold: int = NOTHING


def _slot(value: Column, half: int) -> Column:
    return (F.pmod(value, F.lit(BUCKETS)) + half * BUCKETS).cast("int")


def _pairs(h: Column) -> Column:
    """Hash of each word's hash and the next one's."""
    wide = F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1)))
    return F.slice(wide, 1, F.greatest(F.size(h) - 1, F.lit(0)))


def target_ids(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()


def _targets(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (``__id, __text``) whose ids are among ``ids (__tid, __held)``, with ``__held``."""
    place = lambda c: F.xxhash64(c).bitwiseAND(FILTER_BITS - 1)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), place(c).bitwiseAND(63).cast("int"))
    bits = ids.groupBy(F.shiftright(place("__tid"), 6).alias("__word")).agg(F.bit_or(bit("__tid")).alias("__bits"))  # FILTER_BITS / 64 rows at most
    own = F.col("__id").cast(ids.schema["__tid"].dataType)
    near = rows.withColumn("__id", own).join(F.broadcast(bits), F.shiftright(place("__id"), 6) == F.col("__word")).filter(F.col("__bits").bitwiseAND(bit("__id")) != 0)
    return near.join(ids.hint("merge"), F.col("__id") == F.col("__tid")).select("__held", "__text")


def _counts(rows: DataFrame) -> list[int]:
    """How often each bucket occurs in the texts ``__text``."""
    hashed = rows.select(F.transform(words(F.col("__text")), lambda w: F.xxhash64(w)).alias("wh"))
    grams = F.concat(F.transform("wh", lambda h: _slot(h, 0)), F.transform(_pairs(F.col("wh")), lambda h: _slot(h, 1)))
    out = [0] * (2 * BUCKETS)
    for row in hashed.select(F.explode(grams).alias("bucket")).groupBy("bucket").count().collect():  # at most 2 * BUCKETS rows
        out[row["bucket"]] = row["count"]
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0
    ids = target_ids(labels).select(F.col("doc_id").alias("__tid"), held.alias("__held"))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    with scratch():
        target = persisted(_targets(rows, ids), "target")
        raw, trusted = _counts(rows), _counts(target.filter("not __held"))
        out = []
        for half in (0, BUCKETS):
            r, t = raw[half : half + BUCKETS], trusted[half : half + BUCKETS]
            all_raw, all_target = sum(r) + 0.5 * BUCKETS, sum(t)
            base = [(x + 0.5) / all_raw for x in r]
            out += [round(1000 * math.log((y + PRIOR * p) / (all_target + PRIOR) / p)) for y, p in zip(t, base, strict=True)]
        # Not a filter: the optimizer would push it below and evaluate the rules again for every use of a count.
        scores = judge(target.filter("__held"), Model(out), "__text").groupBy(F.when(~F.col("base_failed"), F.floor("score")).alias("score")).count()
        return Model(out, _threshold([(r.score, r["count"]) for r in scores.collect() if r.score is not None]))  # whole milli-nats: as many rows as there are such scores


def _threshold(scores: list[tuple[int, int]]) -> int:
    """The score that all but ``LOSS`` reach; ``scores`` with their numbers."""
    total = sum(n for _, n in scores)
    left = int(LOSS * total)
    for score, n in sorted(scores):
        if total >= LEAST_HELD and left < n:
            return score
        left -= n
    return NOTHING


def repeated_words(hashes: Column, pairs: Column, window: int = WINDOW) -> Column:
    """Words inside windows found twice or more, given a text's word hashes and their :func:`_pairs`. ``window`` is a power of two."""
    let = lambda value, body: F.get(F.transform(F.array(value), body), 0)

    def covered(spans: Column) -> Column:
        marked = F.sort_array(F.transform(spans, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def pick(s: Column) -> Column:
            again = F.filter(s, lambda x, j: F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        gaps = lambda at: F.transform(at, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - p, F.lit(window))))
        total = lambda at: F.aggregate(gaps(at), F.lit(0).cast("long"), lambda a, x: a + x)
        return let(marked, lambda s: let(pick(s), total))

    def widen(h: Column, step: int) -> Column:
        return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))

    def spans(h: Column, step: int) -> Column:
        if step == window:
            return F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long"))
        n = F.size(h) - step
        return let(F.slice(widen(h, step), 1, n), lambda g: spans(g, 2 * step))

    return F.when(F.size(hashes) <= window, F.lit(0).cast("long")).otherwise(spans(pairs, 2))


def judge(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts, the length-normalised score (milli-nats a word) and the verdict."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    df = docs.withColumns({
        "word_chars": F.length(F.translate(text, SPACE_CHARS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "__qlines": lines,
        "__qws": words(text),
    })
    df = df.withColumns({"n_dup_lines": (F.size("__qlines") - F.size(F.array_distinct("__qlines"))).cast("long"), "n_words": F.size("__qws").cast("long"), "__qwh": F.transform("__qws", lambda w: F.xxhash64(w))})
    df = df.withColumn("__qpairs", _pairs(F.col("__qwh")))
    table = F.split(F.lit(",".join(map(str, model.ratios))), ",").cast("array<int>")  # folded to a constant
    total = lambda hashes, half: F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.get(table, _slot(h, half)))
    df = df.withColumns({"n_repeat_words": repeated_words(F.col("__qwh"), F.col("__qpairs")), "__qsum": total("__qwh", 0) + total("__qpairs", 1)}).drop("__qlines", "__qws", "__qwh", "__qpairs")
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    df = df.withColumn("score", F.when(F.col("n_words") > 0, F.col("__qsum") / F.col("n_words")))
    return df.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("__qsum") >= F.lit(model.threshold) * F.col("n_words"), F.lit(False))).drop("__qsum")


def passing(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only."""
    tagged = judge(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(text_col).alias("__text")), fit(docs, labels), "__text")
    # Not a filter: the optimizer would push it below and evaluate the rules again for every use of a count.
    return tagged.select(F.explode(F.when(F.col("kept"), F.array("__row"))).alias("__row")).select("__row.*")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = judge(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
