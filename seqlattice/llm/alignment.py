"""Alignment of the tokens of two tokenizers by interval coalescing.

Each text is encoded twice and every token is a range of the text's bytes. All
ranges of both sides are sorted together by start (``lexsort``), a running
maximum of their ends (``maximum.accumulate``) says how far the ranges so far
reach, and a group ends where a start reaches that maximum. Within a group, the
pairs of ranges that overlap are expanded: each A token meets the run of B tokens
between two binary searches. Links are those pairs, or only those that end
together (``rule``).

Encoding and coalescing are done once for each distinct *unit* that a task
meets: a run of white space with what follows up to the next white space. No
token of either side reaches over the start of a unit (A's split breaks there, no
entry of B's vocabulary has a space or line feed after another character; both
are checked when the vocabularies are read), so a text's groups and links are its
units' in order. A text with other white space, or with U+2581, is one unit.

Corpus-wide numbers of linked id pairs need a second look at every text. The
first one leaves blocks of texts in the shared folder: units by number, and the
block's distinct links with their numbers. These are summed, the block's distinct
links ask for the sums (a join of one row for each block and link, never of one
for each occurrence), and the answers of a block, at most as many as its links,
meet the block again.

Edge cases: null and empty texts, and those whose tokens do not spell a space and
the text, have no tokens: zeros and ''. Special-token strings are plain text.
Repeated rows and null ids keep their rows and count as often as they occur;
texts of any length are read whole; an empty table gives an empty result; columns
but id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import persisted, scratch

#: Units of a block of texts.
BLOCK = 1 << 17
#: Distinct units that a task remembers and the characters one may have; results do not depend on them.
UNITS, REMEMBERED = 200_000, 64

_UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space but space and line feed, what Python alone takes for it, and the mark that B writes for a space.
_ODD = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0  -     　▁]")


def coalesce(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers, from 0, of A's and of B's intervals: connected runs of the union of both."""
    side = np.repeat(np.array([0, 1], np.int8), [len(a_start), len(b_start)])
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(np.append(0, start[order][1:] >= reach[:-1]))[: len(order)]
    return group[: len(a_start)], group[len(a_start) :]


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of intervals that overlap; intervals of a side are in order and apart from each other."""
    first = np.searchsorted(b_end, a_start, "right")
    n = np.maximum(np.searchsorted(b_start, a_end, "left") - first, 0)
    a = np.repeat(np.arange(len(a_start)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


class Vocabularies:
    """Both tokenizers, and the bytes of their ids. ``pattern`` is the split of A's byte-level form."""

    def __init__(self, a_definition: str, b_model: bytes, pattern: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_definition)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        # The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in plain]
        self.letters = [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]
        byte = {c: b for b, c in enumerate(self.letters)}
        vocabulary, special = self.a.get_vocab(), {i for i, t in self.a.get_added_tokens_decoder().items() if t.special}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.b_bytes, inner = [], []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
            if not self.b.is_byte(i) and ("▁" in piece.lstrip("▁") or "\n" in piece):
                inner.append(piece)
        self.by_units = not inner
        self.space = self.b.piece_to_id("▁")
        # A's own vocabulary, merged by rank: for a byte-level vocabulary whose ids follow its merges that is the same encoding.
        self.ranked = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(self.a_bytes) if i not in special}, special_tokens={})

    def units(self, text: str) -> list[str]:
        """What may be encoded apart, of a text that begins with the added space."""
        return _UNIT.findall(text) if self.by_units and not _ODD.search(text) else [text]

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each unit on both sides. B adds a space itself: it takes the unit's own place, or is taken off again."""
        a = list(map(self.ranked.encode_ordinary, units))  # special tokens play no part, so their strings are plain text
        b = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        # Nothing is added to an empty text.
        return a, [[self.space] if u == " " else ids if u[0] == " " else ids[1:] if ids[:1] == [self.space] else [] for u, ids in zip(units, b, strict=True)]


class Units:
    """What is known of each unit: numbers of A and B tokens and of groups, the groups as text, and the linked id pairs (packed)."""

    def __init__(self, vocabularies: Vocabularies, rule: str):
        self.v, self.rule = vocabularies, rule
        self.known: dict[str, tuple[int, int, int, bytes, bytes] | None] = {}
        # An id with what may follow it: "," within its side of a group, "|" after A's last, ";" after B's last, nothing at a unit's end.
        self.words = [str(i).encode() + mark for x in (vocabularies.a_bytes, vocabularies.b_bytes) for i in range(len(x)) for mark in (b",", b"|", b";", b"")]
        self.sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (vocabularies.a_bytes, vocabularies.b_bytes)]

    def learn(self, units: list[str], again: list[bool]) -> list[tuple[int, int, int, bytes, bytes] | None]:
        """Of each unit; None where the tokens do not spell it. Those that came ``again`` are worth remembering."""
        new = [u for u in units if u not in self.known]
        fresh = dict(zip(new, self._aligned(new), strict=True)) if new else {}
        out = [fresh[u] if u in fresh else self.known[u] for u in units]
        if len(self.known) > UNITS:
            self.known.clear()
        self.known.update((u, fresh[u]) for u, x in zip(units, again, strict=True) if x and u in fresh and len(u) <= REMEMBERED)
        return out

    def _aligned(self, units: list[str]) -> list:
        v = self.v
        a_ids, b_ids = v.encode(units)
        spelt = [u.encode() for u in units]
        good = list(range(len(units)))
        length = np.fromiter(map(len, spelt), np.int64, len(units))
        flat, at, whole = [], [], b"".join(spelt)
        for ids, spell, sizes in ((a_ids, v.a_bytes, self.sizes[0]), (b_ids, v.b_bytes, self.sizes[1])):
            flat.append(np.fromiter(chain.from_iterable(ids), np.int64))
            at.append(np.append(0, np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))))
            reach = np.append(0, np.cumsum(sizes[flat[-1]]))[at[-1]]
            if not (np.array_equal(np.diff(reach), length) and b"".join(map(spell.__getitem__, flat[-1].tolist())) == whole):
                good = [i for i in good if b"".join(map(spell.__getitem__, ids[i])) == spelt[i]]
        out: list = [None] * len(units)
        if len(good) < len(units):
            for i, x in zip(good, self._aligned([units[i] for i in good]) if good else [], strict=True):
                out[i] = x
            return out
        (a, b), (a_at, b_at) = flat, at
        # All units' bytes one after another: groups cannot reach from one unit into the next.
        a_end, b_end = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        a_start, b_start = a_end - self.sizes[0][a], b_end - self.sizes[1][b]
        a_group, b_group = coalesce(a_start, a_end, b_start, b_end)
        x, y = overlaps(a_start, a_end, b_start, b_end)
        if self.rule == "end":
            together = a_end[x] == b_end[y]
            x, y = x[together], y[together]
        pairs, link_at = (a[x] << 32 | b[y]).tobytes(), np.searchsorted(x, a_at)
        a_mark = np.append(a_group[1:] != a_group[:-1], True).astype(np.int64)
        b_mark = np.append(b_group[1:] != b_group[:-1], True).astype(np.int64) * 2
        b_mark[b_at[1:] - 1] = 3
        order = np.lexsort((np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a_group, b_group])))
        keys = np.concatenate([a * 4 + a_mark, (b + len(v.a_bytes)) * 4 + b_mark])[order]
        words, word_at = list(map(self.words.__getitem__, keys.tolist())), (a_at + b_at).tolist()
        groups = (a_group[a_at[1:] - 1] - a_group[a_at[:-1]] + 1).tolist()
        n_a, n_b, links = np.diff(a_at).tolist(), np.diff(b_at).tolist(), (link_at * 8).tolist()
        return [(n_a[i], n_b[i], groups[i], b"".join(words[word_at[i] : word_at[i + 1]]), pairs[links[i] : links[i + 1]]) for i in range(len(units))]


_BLOCKS = (
    "block long, docs array<struct<id:{id},n_a:long,n_b:long,n_groups:long,n_links:long,sha:string>>, units binary, codes binary, links binary, pairs binary, a array<int>, b array<int>, n array<long>"
)


def blocks(df: DataFrame, a_path: str, b_path: str, pattern: str, rule: str = "end", block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of aligned texts: ``docs`` (a row a text), ``units`` (how many each text has), ``codes`` (of all units), ``links``
    (how many each distinct unit has), ``pairs`` (their codes), and by pair code the ids ``a, b`` and how often they are linked, ``n``."""
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        shipped = df.sparkSession.sparkContext.broadcast((f.read(), g.read(), pattern))
    ids = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        vocabularies = Vocabularies(*shipped.value)
        known, number = Units(vocabularies, rule), TaskContext.get().partitionId() << 32
        keys: list = []
        counts: list[int] = []
        codes: list[int] = []
        places: dict[str, int] = {}

        def row() -> pa.RecordBatch:
            nonlocal number
            number += 1
            of = np.array(codes, np.int32)
            found = known.learn(list(places), (np.bincount(of, minlength=len(places)) > 1).tolist())
            good = np.array([x is not None for x in found] or [True], bool)
            column = lambda i: np.array([x[i] if x else 0 for x in found] or [0], np.int64)
            lengths = np.array([len(x[4]) // 8 if x else 0 for x in found] or [0], np.int64)
            spelt = [x[3] if x else b"" for x in found]
            at = np.cumsum([0, *counts])
            fine = np.array([n > 0 and bool(good[of[s:e]].all()) for n, s, e in zip(counts, at[:-1], at[1:], strict=True)], bool)
            total = lambda x: np.where(fine, np.append(0, np.cumsum(x[of]))[at[1:]] - np.append(0, np.cumsum(x[of]))[at[:-1]], 0)
            sha = [hashlib.sha256(b";".join(map(spelt.__getitem__, codes[s:e]))).hexdigest() if x else "" for x, s, e in zip(fine, at[:-1], at[1:], strict=True)]
            held, sizes = of[np.repeat(fine, counts)], np.where(fine, counts, 0)
            links = np.frombuffer(b"".join(x[4] for x in found if x), np.int64)
            distinct, places_of = np.unique(links, return_inverse=True)
            often = np.zeros(len(distinct), np.int64)
            np.add.at(often, places_of, np.repeat(np.bincount(held, minlength=len(lengths)), lengths))
            docs = pa.StructArray.from_arrays([pa.concat_arrays(keys), *(pa.array(x, pa.int64()) for x in (total(column(0)), total(column(1)), total(column(2)), total(lengths))), pa.array(sha, pa.string())], ["id", "n_a", "n_b", "n_groups", "n_links", "sha"])
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            packed = [pa.array([x.tobytes()], pa.binary()) for x in (sizes.astype(np.int32), held, lengths.astype(np.int32), places_of.astype(np.int32))]
            lists = [one(pa.array(x)) for x in ((distinct >> 32).astype(np.int32), (distinct & 0xFFFFFFFF).astype(np.int32), often)]
            for x in (keys, counts, codes, places):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([number - 1], pa.int64()), one(docs), *packed, *lists], names=["block", "docs", "units", "codes", "links", "pairs", "a", "b", "n"])

        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                units = vocabularies.units(" " + text) if text else []
                keys.append(batch.column(0).slice(i, 1))
                counts.append(len(units))
                codes.extend([places.setdefault(u, len(places)) for u in units])
                if len(codes) >= block or len(keys) >= block:
                    yield row()
        if keys:
            yield row()

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, T._parse_datatype_string(_BLOCKS.format(id=ids.simpleString())))


def pair_counts(found: DataFrame) -> DataFrame:
    """``a, b, n`` and ``best``: how often two ids are linked in all texts, and whether no other A id is linked more often with that B id."""
    pairs = found.select(F.inline(F.arrays_zip("a", "b", "n"))).groupBy("a", "b").agg(F.sum("n").alias("n"))
    return pairs.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))  # as many rows as A has ids at most


def scored(found: DataFrame, counts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row a text, with how many of its links are the best of their B id and the sum of its links' numbers."""
    asked = found.select("block", F.posexplode(F.arrays_zip("a", "b")).alias("code", "p")).select("block", "code", "p.a", "p.b")
    answers = asked.join(counts, ["a", "b"]).groupBy("block").agg(F.collect_list(F.struct("code", "n", "best")).alias("answers"))  # a block's links at most
    met = found.select("block", "docs", "units", "codes", "links", "pairs").join(answers, "block", "left")
    key = T.StructField(id_col, found.schema["docs"].dataType.elementType["id"].dataType)
    longs = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = T.StructType([key, *(T.StructField(c, T.LongType()) for c in longs), T.StructField("groups_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs = batch.column(0)[i].values
                units, codes, links, pairs = (np.frombuffer(batch.column(c)[i].as_py(), np.int32) for c in range(1, 5))
                n, best = np.zeros((2, int(pairs.max(initial=-1)) + 1), np.int64)
                if (got := batch.column(5)[i].values) is not None:
                    at = got.field("code").to_numpy()
                    n[at], best[at] = got.field("n").to_numpy(), got.field("best").to_numpy(zero_copy_only=False)

                def summed(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
                    running, at = np.append(0, np.cumsum(x)), np.append(0, np.cumsum(sizes))
                    return running[at[1:]] - running[at[:-1]]

                text = [summed(summed(x[pairs], links)[codes], units) for x in (best, n)]
                yield pa.RecordBatch.from_arrays([docs.field("id"), *(docs.field(c) for c in longs[:4]), *map(pa.array, text), docs.field("sha")], names=schema.names)

    return met.select("docs", "units", "codes", "links", "pairs", "answers").mapInArrow(run, schema)


def aligned(df: DataFrame, a_path: str, b_path: str, pattern: str, rule: str = "end", block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: numbers of tokens, groups and links, and how its links stand in the whole corpus."""
    with scratch() as keep:
        found = persisted(blocks(df, a_path, b_path, pattern, rule, block, id_col, text_col), "aligned")
        counts = persisted(pair_counts(found), "pairs")
        return keep(persisted(scored(found, counts, id_col), "alignment"))


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
