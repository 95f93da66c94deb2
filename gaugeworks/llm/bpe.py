"""Byte-level BPE through a sentencepiece model made from the vocabulary alone.

The rank file of a byte-level vocabulary is turned into a sentencepiece BPE
model: each byte becomes one character, each token a piece, its score the
negative rank, the normaliser the identity.  sentencepiece then merges, as the
rank encoder does, the adjacent pair whose join has the lowest rank, leftmost
first.  Texts are cut by the pattern first and each pre-token is encoded by
itself.  Decoding maps ids back to their bytes.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm._words import ranges, slices, span_hashes, texts_of, tidy

#: Each byte b is the character U+0100 + b in the model.
SHIFT = 0x100


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of base64 token and decimal rank."""
    pairs = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def _characters(data: bytes) -> str:
    return (np.frombuffer(data, np.uint8).astype("<u2") + SHIFT).tobytes().decode("utf-16-le")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: bytes, an unsigned number, or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_proto(tokens: list[bytes]) -> bytes:
    """A sentencepiece model: piece 0 is unknown, piece k + 1 the token of k-th lowest rank."""
    unknown, normal, bpe = 2, 1, 2
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)]
    pieces += [_field(1, _characters(t).encode()) + _field(2, -float(k)) + _field(3, normal) for k, t in enumerate(tokens)]
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, 0)
    for special in (41, 42, 43):
        trainer += _varint(special << 3) + _varint((1 << 64) - 1)  # no such piece: -1
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, identity)


#: Kinds of characters: other, letter, number, white space.
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


def _kinds() -> np.ndarray:
    every = np.arange(0x110000, dtype="<u4")
    every[0xD800:0xE000] = 0
    text = every.tobytes().decode("utf-32-le")
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, expression in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for found in regex.finditer(expression, text):
            out[found.start() : found.end()] = kind
    out[0xD800:0xE000] = _OTHER
    return out


class RunSplitter:
    """The public word pattern (contractions, runs of letters, numbers or others with one space before, white space) without a regular-expression engine.

    Texts become arrays of code points; a pre-token begins where the kind of
    character changes, one space moves to the run behind it, and an apostrophe
    takes the contraction's letters.
    """

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self):
        self.kinds = _kinds()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 of all texts, first and end byte of each pre-token, and the pre-tokens of each text."""
        joined = "".join(texts)
        point = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        data = np.frombuffer(joined.encode(), np.uint8)
        bounds = np.cumsum([0, *map(len, texts)])
        n = len(point)
        if not n:
            return data, np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
        kind = self.kinds[point]
        begins = np.empty(n + 1, bool)
        begins[0] = begins[n] = True
        begins[1:n] = kind[1:] != kind[:-1]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        begins |= edge
        run = np.flatnonzero(begins)
        first, end = run[:-1], run[1:]
        # the last of a run of white space goes on its own or, if a space, to the next run
        blank = (kind[first] == _SPACE) & ~edge[end]
        last = end[blank] - 1
        begins[last] = True
        plain = point[last] == 32
        begins[last[plain] + 1] = False
        # a lone apostrophe that begins a pre-token takes s, t, re, ve, m, ll or d
        lone = first[(point[first] == 39) & (end - first == 1) & ~edge[end]]
        lone = lone[begins[lone]]
        if len(lone):
            one = point[lone + 1]
            two = point[np.minimum(lone + 2, n - 1)]
            pair = ~edge[np.minimum(lone + 2, n)]
            size = np.where(np.isin(one, [115, 116, 109, 100]), 1, 0)
            size[pair & (two == 101) & ((one == 114) | (one == 118)) | pair & (one == 108) & (two == 108)] = 2
            lone, size = lone[size > 0], size[size > 0]
            begins[lone + 1] = False
            begins[lone + 1 + size] = True
        mark = np.flatnonzero(begins[:n])
        wide = 1 + (point >= 0x80).astype(np.int64) + (point >= 0x800) + (point >= 0x10000)
        byte = np.concatenate(([0], np.cumsum(wide)))
        start = byte[mark]
        return data, start, np.append(start[1:], byte[n]), np.diff(np.searchsorted(mark, bounds))


class RegexSplitter:
    """Any other pattern."""

    def __init__(self, pattern: str):
        self.pattern = regex.compile(pattern)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        parts = [[m.encode() for m in self.pattern.findall(t)] for t in texts]
        every = [m for part in parts for m in part]
        end = np.cumsum([len(m) for m in every], dtype=np.int64)
        return np.frombuffer(b"".join(every), np.uint8), np.concatenate(([0], end[:-1])).astype(np.int64)[: len(every)], end, np.array([len(p) for p in parts], np.int64)


class Codec:
    """Encodes and decodes Arrow columns.

    ``most`` pre-tokens are remembered at a time, found by a 64-bit hash; their
    bytes are compared, so pre-tokens of one hash never share their ids.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 150_000):
        tokens = sorted(ranks, key=ranks.__getitem__)
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.split, self.most = RunSplitter() if pattern == RunSplitter.pattern else RegexSplitter(pattern), most
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(tokens))
        self.ids = np.array([ranks[t] for t in tokens], np.int32)
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.place = np.full(int(self.ids.max()) + 1, -1, np.int64)
        self.place[self.ids] = np.arange(len(tokens))
        # a pre-token that is a token is that token, whether or not merges reach it
        reached = self.model.encode([_characters(t) for t in tokens])
        self.whole = {t: k for k, (t, got) in enumerate(zip(tokens, reached, strict=True)) if got != [k + 1]}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.known_ids, self.known_start, self.known_size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.raw, self.raw_start, self.raw_size = np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)

    def _pieces(self, new: list[bytes]) -> list[list[int]]:
        """The model's pieces of each pre-token."""
        size = np.array([len(d) for d in new])
        joined, ends = _characters(b"".join(new)), np.cumsum(size)
        found = self.model.encode([joined[i:j] for i, j in zip((ends - size).tolist(), ends.tolist(), strict=True)], num_threads=1)
        if self.whole:
            found = [[self.whole[raw] + 1] if raw in self.whole else got for raw, got in zip(new, found, strict=True)]
        return found

    def _learn(self, keys: list[int], new: list[bytes]) -> None:
        found, size = self._pieces(new), np.array([len(d) for d in new], np.int64)
        count = np.array([len(x) for x in found], np.int64)
        self.raw_start = np.append(self.raw_start, len(self.raw) + np.cumsum(size) - size)
        self.raw_size = np.append(self.raw_size, size)
        self.raw = np.append(self.raw, np.frombuffer(b"".join(new), np.uint8))
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys)), strict=True))
        self.known_start = np.append(self.known_start, len(self.known_ids) + np.cumsum(count) - count)
        self.known_size = np.append(self.known_size, count)
        self.known_ids = np.append(self.known_ids, np.array([i for x in found for i in x], np.int32))

    def encode(self, column) -> pa.ListArray:
        """Texts to lists of ids; null and empty texts to empty lists."""
        if len(self.known) > self.most:
            self._forget()
        data, start, end, per_text = self.split([t or "" for t in column.to_pylist()])
        key, at, which = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        keys = key.tolist()
        if new := [i for i, k in enumerate(keys) if k not in self.known]:
            self._learn([keys[i] for i in new], [data[i:j].tobytes() for i, j in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)])
        place = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[which] if len(keys) else np.empty(0, np.int64)
        count = self.known_size[place]
        pieces = self.known_ids[ranges(self.known_start[place], count)]
        own = data[start[0] : end[-1]] if len(start) and np.array_equal(start[1:], end[:-1]) else data[ranges(start, end - start)]
        if not (np.array_equal(self.raw_size[place], end - start) and np.array_equal(self.raw[ranges(self.raw_start[place], end - start)], own)):
            found = self._pieces([data[i:j].tobytes() for i, j in zip(start.tolist(), end.tolist(), strict=True)])  # two pre-tokens of one hash
            count, pieces = np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], np.int32)
        flat = self.ids[pieces - 1]
        offsets = np.concatenate(([0], np.cumsum(count)))[np.concatenate(([0], np.cumsum(per_text)))]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """Lists of ids to bytes; a null list to empty.  An id outside the vocabulary is an error."""
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.place) or (self.place[ids] < 0).any()):
            raise ValueError("an id is outside the vocabulary")
        at = self.place[ids]
        data = self.blob[ranges(self.start[at], self.size[at])]
        ends = np.concatenate(([0], np.cumsum(self.size[at])))
        lengths = [len(x) if x.is_valid else 0 for x in lists] if lists.null_count else np.diff(lists.offsets.to_numpy())
        bounds = ends[np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))]
        return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


_CODECS: dict = {}


def codec(data: bytes, pattern: str) -> Codec:
    """One codec per process, vocabulary and pattern."""
    key = xxhash.xxh3_128_digest(data), pattern
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(read_ranks(data), pattern)
    return _CODECS[key]


def vocabulary(path: str) -> bytes:
    """The rank file's content; it goes to the executors with the tasks (under 1 MB, whatever the corpus)."""
    with open(path, "rb") as file:
        return file.read()


def _added(df: DataFrame, name: str, kind: T.DataType, over: str, make) -> DataFrame:
    names = [c for c in df.columns if c != name]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, over):
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], make(batch.column(over))], [*names, name])

    return df.mapInArrow(tidy(run), T.StructType([*[df.schema[c] for c in names], T.StructField(name, kind)]))


def encode(df: DataFrame, vocabulary_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the token ids of each text as ``ids_col array<int>``.

    Null and empty texts give an empty list.  A column already named
    ``ids_col`` is replaced; other columns stay as they are.
    """
    data = vocabulary(vocabulary_path)
    return _added(df, ids_col, T.ArrayType(T.IntegerType()), text_col, lambda column: codec(data, pattern).encode(column))


def decode(df: DataFrame, vocabulary_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes of each list of ids as ``bytes_col binary``; a null list gives no bytes."""
    data, names = vocabulary(vocabulary_path), [c for c in df.columns if c != bytes_col]

    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                made = codec(data, pattern).decode(batch.column(ids_col))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], made.cast(pa.binary())], [*names, bytes_col])

    return df.mapInArrow(tidy(run), T.StructType([*[df.schema[c] for c in names], T.StructField(bytes_col, T.BinaryType())]))


def round_trip(df: DataFrame, vocabulary_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", same_col: str = "round_trip") -> DataFrame:
    """``df`` with the ids of each text, and whether they decode to its bytes again (of a null text, to none), in one pass.

    Columns of these two names are replaced.
    """
    data, names = vocabulary(vocabulary_path), [c for c in df.columns if c not in (ids_col, same_col)]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_col):
                both = codec(data, pattern)
                ids = both.encode(batch.column(text_col))
                same = [x == y for x, y in zip(both.decode(ids).to_pylist(), texts_of(batch.column(text_col)), strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], ids, pa.array(same, pa.bool_())], [*names, ids_col, same_col])

    schema = T.StructType([*[df.schema[c] for c in names], T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(same_col, T.BooleanType())])
    return df.mapInArrow(tidy(run), schema)


def id_text(lists: pa.ListArray) -> list[bytes]:
    """Decimal ids joined by commas."""
    ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    top = int(ids.max()) + 1 if len(ids) else 1
    digits = [b"%d," % i for i in range(top)]
    blob = np.frombuffer(b"".join(digits), np.uint8)
    size = np.array([len(d) for d in digits], np.int64)
    start = np.cumsum(size) - size
    data = blob[ranges(start[ids], size[ids])].tobytes() if len(ids) else b""
    ends = np.concatenate(([0], np.cumsum(size[ids])))[lists.offsets.to_numpy()]
    return [data[i : max(i, j - 1)] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def round_trip_digests(df: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id, ``n_tokens`` and the SHA-256 of the ids as text and of the decoded bytes.

    Encodes and decodes inside one Arrow pass, so that neither ids nor texts
    go back to the JVM.  Nothing is shuffled.
    """
    import hashlib

    data = vocabulary(vocabulary_path)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                both = codec(data, pattern)
                ids = both.encode(batch.column("text"))
                texts = both.decode(ids).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int64)),
                        pa.array([hashlib.sha256(x).hexdigest() for x in id_text(ids)]),
                        pa.array([hashlib.sha256(x).hexdigest() for x in texts]),
                    ],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(tidy(run), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
