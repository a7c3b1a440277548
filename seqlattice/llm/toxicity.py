"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Every sentence gets a probability from a
logistic model over hashed words and word beginnings; the bag's score is their
noisy-or, ``1 - prod(1 - p)``. Only document labels are used: the gradient of
the bag's log-likelihood flows back to the sentences, so the model learns which
sentences offend and can point at them. Sentences are whole, texts are never cut.

Training rows: at most ``TRAIN_DOCS`` distinct (id, text) of labelled documents,
by hash of the id, outside the held-out third, of at most ``TRAIN_CHARS``
characters (bounds on what the driver receives, whatever is repeated; scoring has
no such bound). Features are hashed on the executors. Scoring is one pass with no shuffle; the model (``2**BITS`` floats)
is broadcast. A temperature and offset fitted on a part of the training rows
calibrate the score, so that ``THRESHOLD`` is a probability.

Edge cases: a text without words (null, empty) scores the model's lowest value,
the calibrated score of a bag with no evidence; a label given twice counts as
toxic if either is; with no labels at all every score is 0; of sentences that
offend alike the first is ``worst``; repeated rows and null ids keep their rows (a
null id is never held out and never learnt from); an empty table gives an empty
result; :func:`score` replaces input columns named as its own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out

BITS = 18
TRAIN_DOCS = 12_000
TRAIN_CHARS = 20_000
THRESHOLD = 0.7
EPOCHS = 15
#: Features in fewer training documents than this are not learnt.
LEAST_DOCS = 10
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
WORD = re.compile(r"\w+")
#: Longer words are hashed each time instead of remembered.
MEMO_WORD = 64


def _slots(word: str) -> list[int]:
    """Hashed features of a word: itself and its first four and six letters."""
    mask = (1 << BITS) - 1
    out = {zlib.crc32(word.encode()) & mask}
    out.update(zlib.crc32(b"^%d" % n + word[:n].encode()) & mask for n in (4, 6) if len(word) > n)
    return sorted(out)


def sentences(text: str | None) -> list[str]:
    return [x for x in SENTENCE.split(text or "") if x]


def sentence_features(sentence: str, memo: dict | None = None) -> list[int]:
    """Distinct features of a sentence."""
    out: set[int] = set()
    for word in set(WORD.findall(sentence.lower())):
        slots = memo.get(word) if memo is not None else None
        if slots is None:
            slots = _slots(word)
            if memo is not None and len(word) <= MEMO_WORD:
                if len(memo) > 300_000:
                    memo.clear()
                memo[word] = slots
        out.update(slots)
    return sorted(out)


class Model:
    """Weights of the sentence model and the calibration of bags."""

    def __init__(self, weights: np.ndarray, bias: float, scale: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.scale, self.shift = weights, bias, scale, shift

    def sentence_logits(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Logits of sentences, given their features one after another and how many each has."""
        ends = np.cumsum(sizes)
        sums = np.concatenate([[0.0], np.cumsum(self.weights[flat], dtype=np.float64)])
        return self.bias + sums[ends] - sums[ends - sizes]

    def bag_logit(self, logits: np.ndarray) -> float:
        """Logit of the noisy-or; that of one sentence without features if there is none."""
        if not len(logits):
            logits = np.array([self.bias])
        safe = float(np.logaddexp(0, logits).sum())  # -log prod(1 - p)
        return float(np.log(-np.expm1(-safe)) + safe) if safe < 30 else safe

    def score(self, logit: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -40, 40))))


def pack(bags: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Features of a bag's sentences one after another, and the number of each."""
    return np.fromiter((i for bag in bags for i in bag), np.int32), np.fromiter(map(len, bags), np.int32, len(bags))


def train(docs: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = 0.3, ridge: float = 5e-5, seed: int = 7) -> Model:
    """Noisy-or maximum likelihood by mini-batch AdaGrad over packed bags with labels; a fifth of them calibrates."""
    weights, bias, total = np.zeros(1 << BITS, np.float64), -4.0, np.full((1 << BITS) + 1, 1e-8)
    if not docs:
        return Model(weights.astype(np.float32), -40.0)
    spread = np.zeros(1 << BITS, np.int32)
    for flat, _, _ in docs:
        spread[np.unique(flat)] += 1
    packed, rest = [], []
    for i, (flat, sizes, label) in enumerate(docs):
        known = spread[flat] >= LEAST_DOCS
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[known]
        if i % 5 or len(docs) < 5:
            packed.append((flat[known], owner, max(1, len(sizes)), label))
        if i % 5 == 0:
            rest.append((flat[known], np.bincount(owner, minlength=len(sizes)), label))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(packed))
        for lo in range(0, len(order), 64):
            batch = [packed[i] for i in order[lo : lo + 64]]
            sizes = np.array([n for _, _, n, _ in batch])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            flat = np.concatenate([f for f, _, _, _ in batch])
            owner = np.concatenate([o + s for (_, o, _, _), s in zip(batch, starts, strict=True)]).astype(np.int64)
            label = np.array([y for *_, y in batch])
            logit = bias + np.bincount(owner, weights[flat], sizes.sum())
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            safe = np.add.reduceat(np.logaddexp(0, logit), starts)
            # d(-log-likelihood)/d(logit of a sentence): p for a clean bag, -p * P(clean) / P(toxic) for a toxic one
            pull = np.where(label == 1, -1 / np.expm1(np.maximum(safe, 1e-6)), 1.0)
            g = p * np.repeat(pull, sizes) / len(batch)
            used, inverse = np.unique(flat, return_inverse=True)
            gw = np.bincount(inverse, g[owner], len(used)) + ridge * weights[used]
            total[used] += gw**2
            weights[used] -= rate * gw / np.sqrt(total[used])
            gb = g.sum()
            total[-1] += gb**2
            bias -= rate * gb / np.sqrt(total[-1])
    model = Model(weights.astype(np.float32), float(bias))
    model.scale, model.shift = _calibrate(np.array([model.bag_logit(model.sentence_logits(f, n)) for f, n, _ in rest]), np.array([y for *_, y in rest]))
    return model


def _calibrate(logits: np.ndarray, labels: np.ndarray, steps: int = 2000) -> tuple[float, float]:
    """Logistic calibration with smoothed targets; identity where one class is missing."""
    pos, neg = int((labels == 1).sum()), int((labels == 0).sum())
    if not pos or not neg:
        return 1.0, 0.0
    x = np.clip(logits, -20, 20)
    t = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        h = p * (1 - p) + 1e-9
        ga, gb = ((p - t) * x).sum(), (p - t).sum()
        haa, hab, hbb = (h * x * x).sum() + 1e-3, (h * x).sum(), h.sum() + 1e-3
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = max(a - 0.5 * da, 0.05), b - 0.5 * db
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a), float(b)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_DOCS) -> DataFrame:
    """Bounded sample of labelled documents outside the held-out third, with packed features."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(ids), F.col("id") == F.col("doc_id")).filter(F.length("text") <= TRAIN_CHARS)  # at most `limit` ids
    rows = rows.select("id", "label", "text", F.xxhash64("text").alias("th"))
    chosen = rows.select("id", "th").distinct().orderBy(F.xxhash64("id"), "id", "th").limit(limit)
    chosen = chosen.select(F.col("id").alias("__id"), F.col("th").alias("__th"))
    rows = rows.join(F.broadcast(chosen), (F.col("id") == F.col("__id")) & (F.col("th") == F.col("__th")), "left_semi")  # at most `limit` rows
    rows = rows.dropDuplicates(["id", "th"]).select("id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            packed = [pack([sentence_features(x, memo) for x in sentences(t.as_py())]) for t in batch.column(2)]
            columns = [pa.array([x[i].tobytes() for x in packed], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "label", "flat", "sizes"])

    return rows.mapInArrow(run, "id long, label int, flat binary, sizes binary")


def fit(docs: DataFrame, labels: DataFrame, **options) -> Model:
    rows = training_rows(docs, labels, **options).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.id).encode()), r.id, r.flat))
    return train([(np.frombuffer(r.flat, np.int32), np.frombuffer(r.sizes, np.int32), r.label) for r in rows])


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with ``score``, ``worst`` (the most offending sentence) and ``worst_score``."""
    keep = [f for f in df.schema.fields if f.name not in (text_col, "score", "worst", "worst_score")]
    shipped = df.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.scale, model.shift))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = Model(*shipped.value), {}
        for batch in batches:
            out = []
            for text in batch.column(batch.num_columns - 1):
                parts = sentences(text.as_py())
                logits = model.sentence_logits(*pack([sentence_features(x, memo) for x in parts]))
                at = int(np.argmax(logits)) if len(logits) else -1
                out.append((model.score(model.bag_logit(logits)), parts[at] if at >= 0 else None, float(1 / (1 + np.exp(-np.clip(logits[at], -40, 40)))) if at >= 0 else None))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            found = [pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, *found], names=[*(f.name for f in keep), "score", "worst", "worst_score"])

    schema = T.StructType([*keep, T.StructField("score", T.DoubleType()), T.StructField("worst", T.StringType()), T.StructField("worst_score", T.DoubleType())])
    return df.select(*(F.col(f"`{f.name}`") for f in keep), F.col(text_col).cast("string")).mapInArrow(run, schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst")
