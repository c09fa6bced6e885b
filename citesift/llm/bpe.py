"""Byte-level BPE: encode whole texts to ids and back.

Encoding splits a text at the vocabulary's special strings and by its pattern,
then merges each piece with a priority queue of merge ranks over a doubly linked
list of symbols; queue entries whose symbols have changed meanwhile are stale
and skipped. Decoding concatenates the vocabulary's byte strings.

The vocabulary is a file of fixed size, read once on the driver and broadcast.
Texts go through in Arrow batches, one row at a time; pieces are cached per
worker up to ``CACHE_ENTRIES``.

Nulls and empty texts have no ids, null ids decode like none, and no ids decode to the empty text. Rows are
independent: repeated rows, ties, extra columns and an empty table need no
special care, and all other columns pass through.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The usual pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNEVEN = re.compile(r"[^\S \n]|[ \n][ \n]|\0|^[ \n]|[ \n]\Z|[.,][^\w\s]|[^\w][.,]|_[.,]|[.,]_|^[.,]|[.,]\w")
# Pieces remembered per worker, and the longest piece that is remembered.
CACHE_ENTRIES = 800_000
CACHE_LENGTH = 48


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    rest = [b for b in range(256) if b not in letters]
    return letters | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges and special strings of a byte-level BPE file."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        ids = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        letters = byte_letters()
        code = {c: b for b, c in letters.items()}
        self.byte_id = [ids[letters[b]] for b in range(256)]
        # Left id -> right id -> rank; rank -> the merged id.
        self.ranks: dict[int, dict[int, int]] = {i: {} for i in ids.values()}
        self.merged: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[ids[left]][ids[right]] = rank
            self.merged.append(ids[left + right])
        self.bytes: dict[int, bytes] = {i: bytes(code[c] for c in s) for s, i in ids.items()}
        self.bytes.update({i: s.encode() for s, i in self.special.items()})
        self._split = regex.compile(PATTERN)
        strings = sorted(self.special, key=len, reverse=True)
        self._specials = regex.compile("|".join(map(regex.escape, strings))) if strings else None
        self._cache: dict[str, tuple[int, ...]] = {}
        self._numbers = list(range(max(self.bytes) + 1))
        self.names = list(map(str, self._numbers))

    @classmethod
    def read(cls, path: str) -> tuple[str, Vocabulary]:
        with open(path, encoding="utf-8") as f:
            spec = f.read()
        return spec, cls(spec)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece.

        A queue entry is ``rank * n + position``; ``entry`` holds the one that
        counts for each position, all others are stale.
        """
        symbols = list(map(self.byte_id.__getitem__, piece))
        n = len(symbols)
        ranks, merged = self.ranks, self.merged
        entry = [-1] * n
        queue = []
        for i in range(n - 1):
            rank = ranks[symbols[i]].get(symbols[i + 1])
            if rank is not None:
                entry[i] = rank * n + i
                queue.append(entry[i])
        if not queue:
            return symbols
        following = list(range(1, n + 1))
        previous = list(range(-1, n - 1))
        heapify(queue)
        while queue:
            top = heappop(queue)
            i = top % n
            if entry[i] != top:
                continue
            j = following[i]
            k = following[i] = following[j]
            symbol = symbols[i] = merged[top // n]
            symbols[j] = entry[j] = entry[i] = -1
            if k < n:
                previous[k] = i
                rank = ranks[symbol].get(symbols[k])
                if rank is not None:
                    entry[i] = rank * n + i
                    heappush(queue, entry[i])
            h = previous[i]
            if h >= 0:
                rank = ranks[symbols[h]].get(symbol)
                if rank is None:
                    entry[h] = -1
                else:
                    entry[h] = rank * n + h
                    heappush(queue, entry[h])
        return [s for s in symbols if s >= 0]

    def _part(self, part: str) -> tuple[int, ...]:
        ids = []
        for piece in self._split.findall(part):
            ids += self.merge(piece.encode())
        # The same number objects everywhere: an entry is then a tuple of references.
        kept = tuple(map(self._numbers.__getitem__, ids))
        if len(part) <= CACHE_LENGTH:
            if len(self._cache) >= CACHE_ENTRIES:
                self._cache.clear()
            self._cache[part] = kept
        return kept

    def _plain(self, text: str, out: list[int]) -> None:
        # Where white space is single blanks and line ends, and points and commas
        # follow words, the pattern always splits before them, so that the parts
        # between can be looked up whole.
        if _UNEVEN.search(text):
            parts = self._split.findall(text)
        else:
            text = text.replace(" ", "\0 ").replace("\n", "\0\n\0").replace(".", "\0.").replace(",", "\0,")
            parts = text.split("\0")
        get = self._cache.get
        for part in parts:
            ids = get(part)
            out += self._part(part) if ids is None else ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        if self._specials:
            for m in self._specials.finditer(text):
                self._plain(text[at : m.start()], out)
                out.append(self.special[m.group()])
                at = m.end()
        self._plain(text[at:] if at else text, out)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids of a text, SHA-256 of the ids and of the text decoded from them."""
        ids = self.encode(text)
        listed = ",".join(map(self.names.__getitem__, ids)).encode()
        plain = b"".join(map(self.bytes.__getitem__, ids))
        # Only bytes that are no text change in decoding.
        decoded = plain if plain.isascii() else plain.decode("utf-8", "replace").encode()
        return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded).hexdigest()


_READ: dict[int, Vocabulary] = {}


def _vocabulary(spec: str) -> Vocabulary:
    """One per worker and file, with its cache of pieces."""
    key = hash(spec)
    if key not in _READ:
        _READ.clear()
        _READ[key] = Vocabulary(spec)
    return _READ[key]


def _with_column(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``, the ids of the whole ``text``; a column of that name is replaced."""
    df = df.drop(out)
    spec = df.sparkSession.sparkContext.broadcast(Vocabulary.read(path)[0])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(spec.value)
        for batch in batches:
            rows = (
                pa.array(vocabulary.encode(x.as_py() or ""), pa.int32()) for x in batch.column(at)
            )
            yield _append(batch, _lists(rows, len(batch)), out)

    return df.mapInArrow(run, _with_column(df, out, T.ArrayType(T.IntegerType(), False)))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the text that ``ids`` stand for; a column of that name is replaced."""
    df = df.drop(out)
    spec = df.sparkSession.sparkContext.broadcast(Vocabulary.read(path)[0])
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(spec.value)
        for batch in batches:
            texts = [vocabulary.decode(x.values.to_pylist() if x.is_valid else []) for x in batch.column(at)]
            yield _append(batch, pa.array(texts, pa.string()), out)

    return df.mapInArrow(run, _with_column(df, out, T.StringType()))


def round_trip(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: every text encoded and decoded in one pass.

    The digests are those of the ids joined by commas and of the decoded text; ids and texts
    themselves, which ``encode`` and ``decode`` give, need not leave the worker for them.
    """
    spec = df.sparkSession.sparkContext.broadcast(Vocabulary.read(path)[0])
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(spec.value)
        for batch in batches:
            found = [vocabulary.digests(x.as_py() or "") for x in batch.column(1)]
            columns = list(zip(*found)) if found else [(), (), ()]
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names
            )

    kind = T.StructField("doc_id", df.schema[doc_id].dataType)
    rest = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return df.select(df[doc_id].alias("doc_id"), df[text].alias("text")).mapInArrow(run, T.StructType([kind, *rest]))


def _lists(rows: Iterator[pa.Array], n: int) -> pa.Array:
    chunks = list(rows)
    offsets = [0]
    for c in chunks:
        offsets.append(offsets[-1] + len(c))
    values = pa.concat_arrays(chunks) if n else pa.array([], pa.int32())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _append(batch: pa.RecordBatch, column: pa.Array, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])
