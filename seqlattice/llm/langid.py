r"""Language identification by averaged hashed subword embeddings.

A word is the mean of the embeddings of its hashed character n-grams (2 to 4,
with word borders) and of itself; a text is the mean of its words; a linear
softmax over it gives the language. Embeddings and softmax are trained together
by stochastic gradient descent in numpy. A temperature and a rejection level,
fitted on a part of the training rows, calibrate the probability: ``rejected``
marks texts below the level that keeps ``KEEP`` of the right answers.

A word is a run of letters (``\p{L}``) and the marks among them, of any length.

Training rows: distinct (id, language, text) outside the held-out third, of
``TRAIN_CHARS`` characters at most; for each of the ``LANGS`` most frequent
languages those of least hash, at most ``PER_LANG``, and no more than
``TRAIN_DOCS`` over all languages. Further languages are not learnt. Executors
turn the rows into slots and weights, so the driver receives those only, a
bounded number. Prediction reads whole texts in one pass with no shuffle, a few
hundred rows at a time: the distinct words of these rows are scored together.

Edge cases: ``und`` with score 0 where a text is null or has no letter; with no
training rows every text is ``und``; of languages alike in probability the first
by name is taken; repeated rows and null ids keep their rows (a null id is never
held out and never learnt from); an empty table gives an empty result;
:func:`identify` replaces input columns named as its own.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out

BITS = 16
WIDTH = 16
PER_LANG = 1200
LANGS = 300
TRAIN_DOCS = 24_000
TRAIN_CHARS = 20_000
EPOCHS = 4
KEEP = 0.995
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Letters of the words whose subwords are hashed at once; a longer word is hashed alone.
AT_ONCE = 400_000
GRAMS = (2, 3, 4)
PRIME = np.uint64(0x9E3779B97F4A7C15)


def counted_words(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all words' subwords, word by word, and the number of each word's.

    Hashes of all n-grams of one length are computed for all places at once.
    """
    marked = [f"<{w}>" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(marked)), sizes)
    place = np.arange(len(points)) - starts[owner]
    left = sizes[owner] - place
    slots, owners = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = (h ^ points[at + j]) * PRIME
        slots.append(h)
        owners.append(owner[at])
    if len(marked):  # the word itself: a polynomial in the prime
        powers = np.full(sizes.max(), PRIME, np.uint64).cumprod()
        slots.append(np.add.reduceat(points * powers[place], starts) * PRIME)
        owners.append(np.arange(len(marked)))
    flat, who = np.concatenate(slots), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return (flat[order] >> np.uint64(64 - BITS)).astype(np.int32), np.bincount(who, minlength=len(marked))


def _parts(words: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of words of about ``AT_ONCE`` letters."""
    lo = size = 0
    for i, word in enumerate(words):
        if size and size + len(word) > AT_ONCE:
            yield lo, i
            lo, size = i, 0
        size += len(word)
    if size:
        yield lo, len(words)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a text and the weight of each: words weigh by their number, the subwords of a word alike."""
    counts = counted_words(text)
    words, slots, weights = list(counts), [np.zeros(0, np.int32)], [np.zeros(0)]
    for lo, hi in _parts(words):
        s, n = subwords(words[lo:hi])
        slots.append(s)
        weights.append(np.repeat(np.fromiter(map(counts.__getitem__, words[lo:hi]), np.float64, hi - lo) / n, n))
    ids, inverse = np.unique(np.concatenate(slots), return_inverse=True)
    return ids, (np.bincount(inverse, np.concatenate(weights), len(ids)) / max(1, counts.total())).astype(np.float32)


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, level: float):
        """``table``: the logits that each subword gives, i.e. embeddings times softmax weights."""
        self.langs, self.table, self.bias, self.temperature, self.level = langs, table, bias, temperature, level

    def words(self, words: list[str]) -> np.ndarray:
        """Logits of words: the mean of their subwords'."""
        out = np.zeros((len(words), len(self.langs)))
        for lo, hi in _parts(words):
            slots, sizes = subwords(words[lo:hi])
            sums = np.add.reduceat(self.table[slots], np.cumsum(sizes) - sizes, axis=0)
            out[lo:hi] = sums / sizes[:, None]
        return out

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, probability and whether it is rejected, for each text."""
        bags = [counted_words(t) for t in texts]
        index = {w: i for i, w in enumerate(set().union(*bags))} if self.langs else {}
        vectors, found = self.words(list(index)), []
        for bag in bags:
            if not bag or not self.langs:
                found.append(("und", 0.0, True))
                continue
            n = np.fromiter(bag.values(), np.float64, len(bag))
            z = ((n @ vectors[np.fromiter(map(index.__getitem__, bag), np.int64, len(bag))]) / n.sum() + self.bias) / self.temperature
            p = np.exp(z - z.max())
            p /= p.sum()
            best = int(np.argmax(p))
            found.append((self.langs[best], float(min(p[best], 1.0)), bool(p[best] < self.level)))
        return found

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        return self.predict_all([text])[0]


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.5, seed: int = 11) -> Model:
    """``rows``: language, slots and weights of :func:`bag`."""
    rows = [row for row in rows if len(row[1])]
    langs = sorted({lang for lang, _, _ in rows})
    if not langs:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (1 << BITS, WIDTH))
    softmax, bias = np.zeros((WIDTH, len(langs))), np.zeros(len(langs))
    packed = [(ids, part, langs.index(lang)) for lang, ids, part in rows]
    learn = [x for i, x in enumerate(packed) if i % 5] or packed
    rest = [x for i, x in enumerate(packed) if i % 5 == 0]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(learn)):
            ids, part, lang = learn[i]
            mean = part @ vectors[ids]
            z = mean @ softmax + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[lang] -= 1
            back = softmax @ p
            softmax -= step * np.outer(mean, p)
            bias -= step * 0.1 * p
            vectors[ids] -= step * 20 * np.outer(part, back)
    table = (vectors @ softmax).astype(np.float32)
    logits = np.array([part @ table[ids] + bias for ids, part, _ in rest])
    truth = np.array([lang for *_, lang in rest])

    def probabilities(t: float) -> np.ndarray:
        z = logits / t
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    grid = [2.0**k for k in np.arange(-3, 4.01, 0.25)]
    temperature = min(grid, key=lambda t: -np.log(probabilities(t)[np.arange(len(truth)), truth] + 1e-12).mean())
    p = probabilities(temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
    level = float(right[int((1 - KEEP) * len(right))]) if len(right) else 0.0
    return Model(langs, table, bias, float(temperature), level)


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``order, lang, slots, weights``: the bounded sample; rows of equal ``order`` are equal."""
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    known = known.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")) & (F.length("text") <= TRAIN_CHARS))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS)
    each = F.least(F.lit(PER_LANG), F.floor(F.lit(TRAIN_DOCS) / F.count(F.lit(1)).over(Window.partitionBy())))
    part = sizes.select(F.col("lang").alias("l"), each.alias("each"), (each / F.col("count")).alias("share"))
    rows = known.join(F.broadcast(part), F.col("lang") == F.col("l"))  # at most LANGS rows
    # About twice as many as are wanted, then exactly so many: those of least hash.
    rows = rows.withColumn("order", F.shiftrightunsigned(F.xxhash64("id", "lang", "text"), 1)).filter(F.col("order") < 2.0**64 * F.col("share"))
    rows = rows.dropDuplicates(["lang", "order"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    rows = rows.withColumn("place", place).filter(F.col("place") <= F.col("each")).select("order", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [bag(t.as_py()) for t in batch.column(2)]
            columns = [pa.array([x[i].tobytes() for x in bags], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["order", "lang", "slots", "weights"])

    return rows.mapInArrow(run, "order long, lang string, slots binary, weights binary")


def fit(docs: DataFrame, **options) -> Model:
    rows = sorted(training_rows(docs, **options).collect(), key=lambda r: (r.order, r.lang))  # TRAIN_DOCS at most
    return train([(r.lang, np.frombuffer(r.slots, np.int32), np.frombuffer(r.weights, np.float32)) for r in rows])


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with ``lang_pred``, ``score`` and ``rejected``."""
    new = ("lang_pred", "score", "rejected")
    keep = [f for f in df.schema.fields if f.name not in (text_col, *new)]
    shipped = df.sparkSession.sparkContext.broadcast((model.langs, model.table, model.bias, model.temperature, model.level))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shipped.value)
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                found = model.predict_all(part.column(part.num_columns - 1).to_pylist())
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                columns += [pa.array([x[j] for x in found], t) for j, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in keep), *new])

    schema = T.StructType([*keep, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return df.select(*(F.col(f"`{f.name}`") for f in keep), F.col(text_col).cast("string")).mapInArrow(run, schema)


def op6_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
