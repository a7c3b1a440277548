"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece exactly one token can be the last of the
prefix's encoding. The encoder stores that token per prefix: a candidate that
ends at byte ``i`` and has length ``n`` is the one if it may follow the token
stored for prefix ``i - n``. Reading the stored tokens back from the end gives
the encoding, so bytes can be appended at the price of the new bytes only, and
after an edit only the prefixes from the edit on are computed again, and only
until they agree with the old ones.

Short pieces, which are most of a text, have many prefixes in common and need few
of them: the last token of a prefix only asks for the prefixes before its candidates,
so these are found when they are asked for, longest candidate first, and kept by
their bytes for the pieces that follow.

Whether one token may follow another is decided by undoing merges from the most
recent one backwards: the border between the two survives if no merge across it
would have come before the merges next to it.

Ranks come from a file of a public tokenizer whose path is a parameter; the
driver reads it once and ships it (bounded by the vocabulary, not by the data).
Texts are split by the tokenizer's pattern, every match is encoded separately
and repeated matches are looked up in a bounded cache.

Edge cases: a null text is the empty text: no tokens, digests of no bytes;
special-token strings in a text are ordinary text; memory is bounded by one
text; repeated rows and null ids keep their rows; an empty table gives an empty
result; :func:`encode_texts` replaces input columns named as its own.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries of each half of a worker's cache of pieces, and of its cache of pairs; results do not depend on them.
CACHE = 250_000
PAIRS = 200_000
#: Prefixes whose last token a worker remembers, and the bytes of the longest piece that is encoded with them; results do not depend on these either.
PREFIXES = 200_000
SHORT = 64
#: Bytes of results that a task gathers before it hands them on.
GATHERED = 1 << 20


class Codec:
    """Ranks, the merge behind every token, and encoding and decoding."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, parts: dict[int, tuple[int, int] | None] | None = None):
        self.ranks, self.pattern = ranks, pattern
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int] | None] = parts or {}
        self._span = span = max(ranks.values()) + 1
        self._pairs: dict[int, bool] = {}
        self._prefixes: dict[bytes, int] = {}
        # The same by rank: the halves (-1 for a single byte), and the rank of a merge by its two halves.
        self._left, self._right, self._joined = [-1] * span, [-1] * span, {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if not parts:
                self.parts[rank] = self._last_merge(token, rank)
            if pair := self.parts[rank]:
                self._left[rank], self._right[rank] = pair
                self._joined[pair[0] * span + pair[1]] = rank
        # By what tokens end with: the longest token at the end of that. By token: the next shorter one at its end, -1 if there is none.
        self._tails: dict[bytes, int] = {}
        self._shorter, self._sizes = [-1] * span, [0] * span
        for token, rank in sorted(ranks.items(), key=lambda x: len(x[0])):
            self._sizes[rank] = len(token)
            longest = -1
            for i in range(len(token) - 1, 0, -1):
                longest = self._tails.setdefault(tail := token[i:], ranks.get(tail, longest))
            self._shorter[rank], self._tails[token] = longest, rank
        self._bytes = np.frombuffer(b"".join(self.tokens.get(rank, b"") for rank in range(span)), np.uint8)
        self._lengths = np.array(self._sizes)
        self._starts = np.cumsum(self._lengths) - self._lengths

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as f:
            lines = (line.split() for line in f if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in lines}, pattern)

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens that the merge of this rank joins; all lower ranks are known already."""
        if len(token) == 1:
            return None
        found = [
            (left, right)
            for i in range(1, len(token))
            if (left := self.ranks.get(token[:i], rank)) < rank and (right := self.ranks.get(token[i:], rank)) < rank
        ]
        if len(found) > 1:
            found = [pair for pair in found if self._survives(*pair)]
        if len(found) != 1:
            raise ValueError(f"token {rank} has no unique merge")
        return found[0]

    def _survives(self, left: int, right: int) -> bool:
        """True if the encoding of the two tokens' bytes is these two tokens."""
        lefts, rights, merged, span, limit = self._left, self._right, self._joined.get, self._span, 1 << 62
        while merged(left * span + right, limit) >= limit:
            if left > right:  # undo the merge that made the left one
                limit, left = left, rights[left]
            else:  # merges of one rank go from left to right, so the border's own may still come first
                limit, right = right + 1, lefts[right]
            if left < 0 or right < 0:  # the latest of the two was a single byte, and so is the other
                return True
        return False

    def extend(self, data: bytes, last: list[int], stop: int | None = None) -> None:
        """Fill ``last``, the valid last token of every prefix of ``data``, from where it ends, up to the prefix of ``stop`` bytes.

        The valid token is unique, so the candidates can be tried shortest first.
        """
        rank, pairs, span, known = self.ranks.get, self._pairs, self._span, self._pairs.get
        for end in range(len(last), (len(data) if stop is None else stop) + 1):
            for start in range(end - 1, max(0, end - self.longest) - 1, -1):
                token = rank(data[start:end])
                if token is not None:
                    if not start:
                        break
                    pair = last[start] * span + token
                    fits = known(pair)
                    if fits is None:
                        if len(pairs) > PAIRS:
                            pairs.clear()
                        fits = pairs[pair] = self._survives(last[start], token)
                    if fits:
                        break
            else:
                raise ValueError("bytes cannot be encoded")
            last.append(token)

    def read_back(self, last: list[int]) -> list[int]:
        """The encoding of all the bytes whose prefixes' last tokens are given."""
        out, at, tokens = [], len(last) - 1, self.tokens
        while at:
            out.append(last[at])
            at -= len(tokens[last[at]])
        return out[::-1]

    def last_token(self, prefix: bytes) -> int:
        """The valid last token of a short prefix, of which shorter prefixes are remembered.

        The valid token is unique, so the candidates can be tried longest first, and most prefixes are never asked for.
        """
        tails, span, remembered, pairs, size = self._tails.get, self._span, self._prefixes, self._pairs, len(prefix)
        start = max(0, size - 3)  # about where the longest token begins: from here on, tails are looked for in both directions
        token = tails(prefix[start:])
        while token is None and start < size:
            start += 1
            token = tails(prefix[start:], -1 if start == size else None)
        while start and (longer := tails(prefix[start - 1 :])) is not None:
            start, token = start - 1, longer
        start = size - self._sizes[token]
        while start or token < 0:
            if token < 0:
                raise ValueError("bytes cannot be encoded")
            before = remembered.get(head := prefix[:start])
            if before is None:
                before = self.last_token(head)
            pair = before * span + token
            fits = pairs.get(pair)
            if fits is None:
                if len(pairs) > PAIRS:
                    pairs.clear()
                fits = pairs[pair] = self._survives(before, token)
            if fits:
                break
            token = self._shorter[token]
            start = size - self._sizes[token]
        if len(remembered) >= PREFIXES:
            remembered.clear()
        remembered[prefix] = token
        return token

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tokens of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) <= SHORT:
            out, remembered, sizes = [], self._prefixes.get, self._sizes
            while piece:
                token = remembered(piece)
                if token is None:
                    token = self.last_token(piece)
                out.append(token)
                piece = piece[: -sizes[token]]
            return out[::-1]
        last = [-1]
        self.extend(piece, last)
        return self.read_back(last)

    def encode(self, text: str) -> list[int]:
        return [i for piece in regex.findall(self.pattern, text) for i in self.encode_piece(piece.encode())]

    def decode(self, ids) -> bytes:
        ids, out = np.asarray(ids, np.int64), []
        for i in range(0, len(ids), 1 << 14):  # at most so many tokens' places at once
            some = ids[i : i + (1 << 14)]
            sizes = self._lengths[some]
            ends = np.cumsum(sizes)
            out.append(self._bytes[np.repeat(self._starts[some] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


class Prefixes:
    """The valid last token of every prefix of some bytes; supports appends and edits."""

    def __init__(self, codec: Codec, data: bytes = b""):
        self.codec, self.data, self.last = codec, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.codec.extend(self.data, self.last)

    def edit(self, start: int, stop: int, data: bytes) -> None:
        """Replace bytes ``start:stop``; prefixes up to ``start`` stay, later ones are renewed until they settle."""
        old, shift = self.last, len(data) - (stop - start)
        self.data = self.data[:start] + data + self.data[stop:]
        self.last = old[: start + 1]
        agreed = 0
        for end in range(start + 1, len(self.data) + 1):
            if agreed >= self.codec.longest:  # no later token reaches back to a changed entry
                self.last += old[end - shift :]
                break
            self.codec.extend(self.data, self.last, end)
            same = end - shift > stop and self.last[end] == old[end - shift]
            agreed = agreed + 1 if same else 0

    def ids(self) -> list[int]:
        return self.codec.read_back(self.last)


class _Pieces(dict):
    """Packed ids by piece, bounded: the newest pieces, and those of the time before, which return when they are asked for."""

    def __init__(self, codec: Codec):
        self.codec, self.before = codec, {}
        self.words = [i.to_bytes(4, "little") for i in range(codec._span)]

    def __missing__(self, piece: str) -> bytes:
        packed = self.before.get(piece)
        if packed is None:
            packed = b"".join(map(self.words.__getitem__, self.codec.encode_piece(piece.encode())))
        if len(self) >= CACHE:
            self.before = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = packed
        return packed


#: The newest vocabulary of this process with its caches: a worker's tasks use one after the other.
_KEPT: list = []


def _kept(shipped: tuple) -> _Pieces:
    """The pieces of a vocabulary as :func:`encode_texts` ships it, with what earlier tasks of this process have encoded."""
    if not _KEPT or _KEPT[0] is not shipped:
        _KEPT[:] = [shipped, _Pieces(Codec(*shipped))]
    return _KEPT[1]


def _encoded(batches: Iterator[pa.RecordBatch], codec: Codec, names: list[str], pieces: _Pieces | None = None) -> Iterator[pa.RecordBatch]:
    """``batches`` with ids and decoded bytes in place of the text, their last column; in parts of about ``GATHERED`` bytes, or one text."""
    pieces, find = _Pieces(codec) if pieces is None else pieces, regex.compile(codec.pattern).findall
    for batch in batches:
        texts, start, size = batch.column(batch.num_columns - 1), 0, 0
        ids, decoded = [], []
        for i in range(batch.num_rows):
            packed = b"".join(map(pieces.__getitem__, find(texts[i].as_py() or "")))
            ids.append(packed)
            decoded.append(codec.decode(np.frombuffer(packed, "<u4")))
            size += len(packed) + len(decoded[-1])
            if size >= GATHERED or i + 1 == batch.num_rows:
                head = batch.slice(start, len(ids)).columns[:-1]
                yield pa.RecordBatch.from_arrays([*head, pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=names)
                start, size = i + 1, 0
                ids, decoded = [], []


def encode_texts(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with ``ids`` (little-endian unsigned 32-bit, packed) and ``decoded`` (bytes)."""
    keep = [f for f in df.schema.fields if f.name not in (text_col, "ids", "decoded")]
    loaded = Codec.load(path, pattern)
    shipped = df.sparkSession.sparkContext.broadcast((loaded.ranks, loaded.pattern, loaded.parts))

    names = [*(f.name for f in keep), "ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _kept(shipped.value)
        return _encoded(batches, pieces.codec, names, pieces)

    schema = T.StructType([*keep, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    return df.select(*(F.col(f"`{f.name}`") for f in keep), F.col(text_col).cast("string")).mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of tokens and digests of ids and decoded bytes for every row."""
    packed = encode_texts(df.select(F.col(id_col), F.col(text_col)), path, pattern, text_col)
    return packed.select(id_col, F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), *public_vocabulary())
