"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

Rank files (token bytes in base64, rank) are turned into a vocabulary of printable characters, one per byte, and into
merges: the one pair of lower-ranked tokens that each token is made of. A text is cut before white space that follows
another character (no match of the split pattern spans such a place); of a batch, every distinct piece is encoded once by
the library and its ids are copied to all places where it occurs. Decoding reverses the byte table; token bytes are joined
before they are read as UTF-8, so characters split over tokens come out whole.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .stream import tidy, together
from .words import as_strings, offsets_of, pieces, range_hash

#: Bytes of text whose distinct pieces are encoded together (arrays of some 30 times that size are made of them), how many
#: pieces one string given to the library holds, and how many strings it gets at once.
GROUP = 1 << 20
STRING = 256
BATCH = 32
#: Most pieces whose ids a worker keeps from one part to the next.
KNOWN = 400_000
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Cuts before U+0020 only.
BLANK = np.arange(256) == 32


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable Latin-1, else the next one from U+0100."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 255 and b != 173:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def parts_of(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What the merges of lower rank leave of a token: two parts, or more if no merge makes it."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        found = [(ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1)]
        rank, i = min(found)
        if rank >= limit:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


@dataclass
class Part:
    """Rows a to b of a column, cut into pieces: first is a piece of each kind, back the kind of each piece."""

    a: int
    b: int
    data: np.ndarray
    off: np.ndarray
    start: np.ndarray
    size: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    back: np.ndarray


@dataclass
class Known:
    """Pieces that were encoded before, by their hashes in order, with their bytes and ids."""

    hashes: np.ndarray
    start: np.ndarray
    size: np.ndarray
    id_start: np.ndarray
    id_size: np.ndarray
    data: np.ndarray
    ids: np.ndarray


_NOTHING = Known(np.zeros(0, np.uint64), *(np.zeros(0, np.int32) for _ in range(4)), np.zeros(0, np.uint8), np.zeros(0, np.int32))


def _cut(data: np.ndarray, off: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of each piece and a hash of it."""
    cut = np.zeros(len(data), bool)
    if len(data) > 1:
        cut[1:] = before[data[1:]] & ~_SPACE[data[:-1]]
        # not after what may be white space outside ASCII: U+0085, U+00A0 and three-byte characters from E1, E2, E3
        low, two = data[:-1], np.append(np.uint8(0), data[:-2])
        three = np.append(np.zeros(2, np.uint8), data[:-3]) if len(data) > 2 else np.zeros(len(data) - 1, np.uint8)
        cut[1:] &= ~((two == 0xC2) & ((low == 0x85) | (low == 0xA0)) | (low >= 0x80) & (three >= 0xE1) & (three <= 0xE3))
    cut[off[:-1][off[:-1] < len(data)]] = True
    start = np.flatnonzero(cut)
    stop = np.append(start[1:], len(data))[: len(start)]
    return start, range_hash(data, start, stop, 0)


def cut_column(column: pa.Array, before: np.ndarray = _SPACE, size: int = GROUP) -> Iterator[Part]:
    """Parts of a string column for any encoder: pieces do not depend on the vocabulary. Texts are cut before those of the six
    white spaces that before names, where they follow another character. A part has about size bytes, or is one longer text."""
    for a, b in pieces(column, size):
        part = column.slice(a, b - a)
        data, off = offsets_of(part)
        found = [(_cut(*offsets_of(part.slice(c, d - c)), before), off[c]) for c, d in pieces(part)]
        start = np.concatenate([np.zeros(0, np.int64), *(s + o for (s, _), o in found)])
        hashes = np.concatenate([np.zeros(0, np.uint64), *(h for (_, h), _ in found)])
        size = np.diff(np.append(start, len(data)))
        _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        alike = size == size[first[back]]
        alike[alike] = _same(data, start[alike], data, start[first[back]][alike], size[alike])
        other = np.flatnonzero(~alike)
        if len(other):  # pieces that share a hash with another one, but not its bytes, are kinds of their own
            back[other] = len(first) + np.arange(len(other))
            first = np.append(first, other)
        yield Part(a, b, data, off, start, size, hashes, first, back)


class ByteBpe:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        # a task has one core; threads of the library would each keep a heap of their own in the worker
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, chars = load_ranks(path), byte_characters()
        self.char_of_byte = chars
        self.byte_of_char = {c: b for b, c in enumerate(chars)}
        shown = {token: "".join(chars[b] for b in token) for token in ranks}
        merges = [tuple("".join(chars[b] for b in p) for p in parts) for t in sorted(ranks, key=ranks.get) if len(t) > 1 and len(parts := parts_of(t, ranks)) == 2]
        # a match that is itself a token is taken whole
        self.tokenizer = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = bytes(self.byte_of_char[c] for c in shown[t])
        self._tables(tokens)

    def _tables(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self._bytes = _table(tokens)
        self._decimal = _table([b"%d," % i for i in range(len(tokens))])
        self._known = _NOTHING

    def encode_column(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, ids, offsets of each row's ids) for parts of a string column."""
        for part in cut_column(column):
            yield part.a, part.b, *self.encode(part)

    def encode(self, part: Part) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a part, and the first id of each (and the end)."""
        if not len(part.start):
            return np.zeros(0, np.int32), np.zeros(len(part.off), np.int64)
        known, data, start, size, hashes = self._known, part.data, part.start[part.first], part.size[part.first], part.hashes[part.first]
        at = np.minimum(np.searchsorted(known.hashes, hashes), max(len(known.hashes) - 1, 0)).astype(np.int32)
        old = np.zeros(len(start), bool)
        if len(known.hashes):
            old = (known.hashes[at] == hashes) & (known.size[at] == size)
            old[old] = _same(data, start[old], known.data, known.start[at[old]], size[old])
        new = np.flatnonzero(~old)
        ids, first, n = self._encode(part, part.first[new])
        # ids of what was known stand before those of what is new
        id_start, id_size = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
        id_start[old], id_size[old] = known.id_start[at[old]], known.id_size[at[old]]
        id_start[new], id_size[new] = first + len(known.ids), n
        flat = np.concatenate([known.ids, ids])
        self._remember(part, start, size, hashes, flat, id_start, id_size, new)
        out, at = _gather(flat, id_start, id_size, part.back)
        return out, at[np.searchsorted(part.start, part.off)]

    def _remember(self, part: Part, start: np.ndarray, size: np.ndarray, hashes: np.ndarray, flat: np.ndarray, id_start: np.ndarray, id_size: np.ndarray, new: np.ndarray) -> None:
        """Adds the new pieces to those known; if they would be too many, only those of this part stay known."""
        known = self._known
        if len(known.hashes) + len(new) > KNOWN:
            known, new = _NOTHING, np.arange(len(start))[:KNOWN]
            flat, at = _gather(flat, id_start, id_size, new)
            id_start, id_size = at[:-1], id_size[new]
        else:
            id_start, id_size = id_start[new], id_size[new]
        data, at = _gather(part.data, start, size, new)
        every = np.concatenate([known.hashes, hashes[new]])
        _, order = np.unique(every, return_index=True)
        # one after another, and each in the type that is kept, so that little stands beside the old arrays
        rest = ((known.start, at[:-1] + len(known.data)), (known.size, size[new]), (known.id_start, id_start), (known.id_size, id_size))
        rest = [np.concatenate([a, b.astype(np.int32)])[order] for a, b in rest]
        self._known = Known(every[order], *rest, np.concatenate([known.data, data]), flat)

    def _encode(self, part: Part, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of some pieces by the library, the first id of each and how many it has."""
        if not len(first):
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        data, begin, size = part.data, part.start[first], part.size[first]
        # pieces between two cuts can stand one after another in one string; those at an end of a text can't
        inner = _SPACE[data[begin]] & ~_SPACE[data[begin + size - 1]] & ~np.isin(begin + size, part.off)
        order = np.argsort(~inner, kind="stable")
        n = int(inner.sum())
        joined, at = _gather(data, begin, size, order)
        ends = np.append(np.arange(STRING, n, STRING), np.arange(n, len(first)) if n else np.arange(1, len(first)))
        edges = at[np.concatenate([[0], ends, [len(first)]]).astype(np.int64)].tolist()
        raw = joined.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]
        flat = []
        for i in range(0, len(texts), BATCH):  # the library's results are many times the size of their ids
            flat += [np.asarray(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts[i : i + BATCH], add_special_tokens=False)]
        flat = np.concatenate(flat)
        token_start = np.cumsum(self._bytes[2][flat]) - self._bytes[2][flat]
        found = np.append(np.searchsorted(token_start, at[:-1]), len(flat))
        first_id, n_ids = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        first_id[order], n_ids[order] = found[:-1], np.diff(found)
        return flat, first_id, n_ids

    def decode(self, ids: np.ndarray) -> bytes:
        return _gather(*self._bytes, ids)[0].tobytes()

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return _gather(*self._decimal, ids)[0].tobytes()[:-1]

    def offsets(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first character, character after the last) of each token; a token of part of a character covers it."""
        return [(i, a, b) for e in [self.tokenizer.encode(text, add_special_tokens=False)] for i, (a, b) in zip(e.ids, e.offsets, strict=True)]

    def decode_steps(self, ids: list[int]) -> Iterator[str]:
        """The text that each id completes; bytes of an unfinished character wait for the next one."""
        import codecs

        reader = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield reader.decode(self.tokens[i])
        yield reader.decode(b"", True)


def _table(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in rows], np.int64)
    return np.frombuffer(b"".join(rows), np.uint8), np.cumsum(size) - size, size


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[start[i] : start[i] + size[i]] for each i in which, one after another, and where each begins (and the end)."""
    n = size[which]
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    return flat[np.repeat(start[which] - at[:-1], n) + np.arange(at[-1])], at


def _same(data: np.ndarray, start: np.ndarray, other: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of data[start : start + size] are equal to other[at : at + size]."""
    same = np.ones(len(start), bool)
    for a, b in _parts(size):
        which = np.arange(a, b)
        got, edge = _gather(data, start, size, which)
        want, _ = _gather(other, at, size, which)
        if not np.array_equal(got, want):
            wrong = np.append(0, np.cumsum(got != want))
            same[a:b] = wrong[edge[1:]] == wrong[edge[:-1]]
    return same


def _parts(size: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of pieces of about so many bytes."""
    ends, a = np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


@cache
def bpe(path: str, pattern: str) -> ByteBpe:
    """One instance for each Python worker."""
    return ByteBpe(path, pattern)


def _encode_rows(batches: Iterator[pa.RecordBatch], path: str, pattern: str, text_at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    coder = bpe(path, pattern)
    for batch in together(batches, text_at, GROUP):
        for a, b, ids, at in coder.encode_column(as_strings(batch.column(text_at))):
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), lists, pa.array(np.diff(at))], names)


def _decode_rows(batches: Iterator[pa.RecordBatch], path: str, pattern: str, ids_at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    coder = bpe(path, pattern)
    for batch in batches:
        made = [coder.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in batch.column(ids_at)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names)


def _round_trip(batches: Iterator[pa.RecordBatch], path: str, pattern: str, text_at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    coder = bpe(path, pattern)
    for batch in together(batches, text_at, GROUP):
        for a, b, ids, at in coder.encode_column(as_strings(batch.column(text_at))):
            each = [ids[at[d] : at[d + 1]] for d in range(b - a)]
            digests = [[hashlib.sha256(f(x)).hexdigest() for x in each] for f in (coder.decimal, coder.decode)]
            rest = [c.slice(a, b - a) for i, c in enumerate(batch.columns) if i != text_at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(at)), *map(pa.array, digests)], names)


def _with(docs: DataFrame, *fields: T.StructField, without: str = "") -> T.StructType:
    clash = {f.name for f in fields} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    return T.StructType([f for f in docs.schema.fields if f.name != without] + list(fields))


def bpe_encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with ids (array of int, no special tokens) and n_tokens. Null and empty texts have no ids; rows are independent,
    so ties, repeats and empty tables need no care. A column that has the name of a result is refused with a ValueError."""
    schema = _with(docs, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()))
    return docs.mapInArrow(tidy(_encode_rows, path=path, pattern=pattern, text_at=docs.columns.index(text_col), names=schema.names), schema)


def bpe_decode(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """rows with decoded, the bytes that the ids stand for (null ids: null). Cast it to string to read it as UTF-8."""
    schema = _with(rows, T.StructField("decoded", T.BinaryType()))
    return rows.mapInArrow(tidy(_decode_rows, path=path, pattern=pattern, ids_at=rows.columns.index(ids_col), names=schema.names), schema)


def bpe_digests(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs, the text left out, with n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 (the bytes
    decoded from those ids): encoding and decoding in one pass, so that no ids leave the Python worker."""
    schema = _with(docs, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), without=text_col)
    return docs.mapInArrow(tidy(_round_trip, path=path, pattern=pattern, text_at=docs.columns.index(text_col), names=schema.names), schema)
