"""Byte-level BPE encoding and decoding over Arrow batches.

Texts are cut into pre-tokens by the vocabulary's split pattern in numpy, over
code-point classes. Every distinct pre-token is encoded once for a worker by the
``tokenizers`` library, through the byte-to-character table, and its ids are
kept in a store of bounded size; ids of whole texts and offsets are then put
together by array indexing. Decoding maps vocabulary characters back through the
inverse byte table and joins bytes, so that characters split over several ids
come out whole; text is made from the joined bytes only.

Defined results: a null or empty text has no ids; ties and repeated rows are
encoded alike; an empty table gives an empty table; other columns are passed on
and clashing names get a trailing underscore. The operator is narrow.
"""

from __future__ import annotations

import base64
import hashlib
import os
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import HEAVY, byte_view, chunks, fresh, lean
from ._words import hash_spans

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct pre-tokens a worker keeps before it starts afresh.
STORE = 400_000
#: Ids that are decoded at once, always between rows.
IDS = 1 << 18

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves,
    the others for the characters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point, as the pattern's \\p{L}, \\p{N} and \\s see it."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if a < 0xD800 <= b:
                out[a:0xD800], out[0xE000 : b + 1] = kind, kind
            else:
                out[a : b + 1] = kind
    return out


def _contractions(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Length of 's 't 're 've 'm 'll 'd at each position of an apostrophe, or 0."""
    n = len(cp)
    one = np.where(at + 1 < n, cp[np.minimum(at + 1, n - 1)], 0)
    two = np.where(at + 2 < n, cp[np.minimum(at + 2, n - 1)], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = np.zeros(len(at), bool)
    for pair in ("re", "ve", "ll"):
        long |= (one == ord(pair[0])) & (two == ord(pair[1]))
    return np.where(short, 2, np.where(long, 3, 0))


def pretoken_starts(cp: np.ndarray, row_start: np.ndarray) -> np.ndarray:
    """Where pre-tokens start among the code points of some non-empty rows.

    The split pattern in terms of runs of one class: a run is a pre-token; a
    blank right before a run of another class belongs to it; a longer run of
    white space gives up its last character, unless the text ends there; and an
    apostrophe alone, after no blank, with a known ending, is a contraction.
    """
    n = len(cp)
    kind = _classes()[cp]
    first = np.zeros(n + 1, bool)
    first[row_start] = True
    first[n] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # the last white space before another class in the same text
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    start |= last
    joined = np.flatnonzero(last & (cp == 0x20))
    start[joined + 1] = False
    # contractions
    q = np.flatnonzero((cp == 0x27) & start)
    q = q[~first[q + 1]]
    q = q[kind[np.minimum(q + 1, n - 1)] == LETTER]
    size = _contractions(cp, q)
    fits = size > 0
    q, size = q[fits], size[fits]
    end = q + size
    cut = (size == 3) & first[np.minimum(q + 2, n)]  # its last letter is in the next text
    q, end = q[~cut], end[~cut]
    start[q + 1] = False
    # what follows a contraction starts anew, unless the text ends there
    start[end[end < n]] = True
    return np.flatnonzero(start)


class ByteBPE:
    """A byte-level BPE vocabulary given as ranks, run by the tokenizers library."""

    def __init__(self, path: str, store: int = STORE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        shown = byte_characters()
        name = lambda token: "".join(shown[b] for b in token)
        merges = [tuple(map(name, self._parts(t, r, ranks))) for t, r in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1]
        vocabulary = {name(t): r for t, r in ranks.items()}
        self.tokenizer = Tokenizer(models.BPE(vocabulary, merges))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # decoding: from the vocabulary's characters back through the byte table
        back = {c: b for b, c in enumerate(shown)}
        size = max(vocabulary.values()) + 1
        raw = [b""] * size
        for token, i in vocabulary.items():
            raw[i] = bytes(back[c] for c in token)
        self.token_size = np.array([len(x) for x in raw], np.int64)
        self.token_first = np.cumsum(self.token_size) - self.token_size
        self.token_data = np.frombuffer(b"".join(raw), np.uint8)
        self.store = store
        self._clear()

    @staticmethod
    def _parts(token: bytes, rank: int, ranks: dict[bytes, int]) -> list[bytes]:
        """The two parts that lower ranks leave of a token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            low, at = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if low >= rank:
                raise ValueError(f"no merge of lower rank makes {token!r}")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.ids: list[np.ndarray] = []
        self.flat = np.empty(0, np.uint32)
        self.size, self.first = np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        flat, size = [], np.zeros(len(words), np.int64)
        for lo in range(0, len(words), 1000):
            e = self.tokenizer.encode(words[lo : lo + 1000], is_pretokenized=True, add_special_tokens=False)
            flat.append(np.array(e.ids, np.uint32))
            size += np.bincount(np.array(e.word_ids, np.int64) + lo, minlength=len(words))
        base = len(self.size)
        self.known.update(zip(keys.tolist(), range(base, base + len(keys)), strict=True))
        self.flat = np.concatenate([self.flat, *flat])
        self.size = np.concatenate([self.size, size])
        self.first = np.cumsum(self.size) - self.size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and how many each row has."""
        n = len(offsets) - 1
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(n, np.int64)
        cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        byte_at = np.cumsum(width) - width
        full = offsets[:-1][np.diff(offsets) > 0]
        starts = byte_at[pretoken_starts(cp, np.searchsorted(byte_at, full))]
        ends = np.append(starts[1:], len(data))
        code, keys = pd.factorize(hash_spans(data, starts, ends))
        if len(self.known) + len(keys) > self.store and self.known:
            self._clear()
        index = np.fromiter((self.known.get(k, -1) for k in keys.tolist()), np.int64, len(keys))
        new = np.flatnonzero(index < 0)
        if len(new):
            at = np.empty(len(keys), np.int64)
            at[code[::-1]] = np.arange(len(code))[::-1]
            raw = data.tobytes()
            self._learn(keys[new], [raw[a:b].decode() for a, b in zip(starts[at[new]], ends[at[new]], strict=True)])
            index[new] = np.arange(len(self.size) - len(new), len(self.size))
        word = index[code]
        size = self.size[word]
        ids = self.flat[_ranges(self.first[word], size)]
        row = np.searchsorted(offsets[1:], starts, "right")
        return ids, np.bincount(row, size, minlength=n).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows one after the other, and where each row starts."""
        size = self.token_size[ids]
        data = self.token_data[_ranges(self.token_first[ids], size)]
        upto = np.concatenate([[0], np.cumsum(size)])
        return data, upto[np.concatenate([[0], np.cumsum(counts)])]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each id's bytes from the first one's."""
        size = self.token_size[ids]
        return np.cumsum(size) - size


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... of size[0] values, then those of the next."""
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(int(size.sum()))


@lru_cache(maxsize=2)
def codec(path: str | None) -> ByteBPE:
    """One codec for each worker; ``None`` is the default vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return ByteBPE(path)


HEAVY.append(codec)


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` and ``starts``, the byte offset of each id's bytes."""
    names = fresh(docs, "ids", "starts")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.ArrayType(k)) for n, k in zip(names, (T.IntegerType(), T.LongType()), strict=True))])
    at = docs.columns.index(text_col)

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            data, offsets = byte_view(batch.column(at))
            for lo, hi in chunks(offsets):
                part = offsets[lo : hi + 1]
                ids, counts = bpe.encode(data[part[0] : part[-1]], part - part[0])
                upto = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                where = bpe.offsets(ids) - np.repeat(part[:-1] - part[0], counts)
                new = [pa.ListArray.from_arrays(upto, pa.array(x)) for x in (ids.astype(np.int32), where)]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), *new], names=[*batch.schema.names, *names])

    return docs.mapInArrow(lean(run, caches=False), schema)


def _ids_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows one after the other, nulls left out, and where each row starts."""
    flat, counts = lists.flatten(), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    if flat.null_count:
        there = flat.is_valid().to_numpy(zero_copy_only=False)
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[there], minlength=len(counts))
        flat = flat.drop_null()
    return flat.to_numpy(), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def decode(rows: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``rows`` with ``decoded_bytes`` and ``decoded_text``; bytes of a character
    that the ids hold only in part become U+FFFD in the text alone."""
    names = fresh(rows, "decoded_bytes", "decoded_text")
    schema = T.StructType([*rows.schema.fields, T.StructField(names[0], T.BinaryType()), T.StructField(names[1], T.StringType())])
    at = rows.columns.index(ids_col)

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            ids, upto = _ids_of(batch.column(at))
            for lo, hi in chunks(upto, IDS):
                data, ends = bpe.decode(ids[upto[lo] : upto[hi]], np.diff(upto[lo : hi + 1]))
                data = data.tobytes()
                raw = [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                new = [pa.array(raw, pa.binary()), pa.array([x.decode(errors="replace") for x in raw], pa.string())]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), *new], names=[*batch.schema.names, *names])

    return rows.mapInArrow(lean(run, caches=False), schema)


def encode_digest(docs: DataFrame, text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``docs`` without its text, with ``n_tokens`` and hashes of ids and of the
    bytes that these ids decode to; ``with_ids`` adds ``ids``, so that one worker
    and one vocabulary a task encode and decode."""
    kept = [f for f in docs.schema.fields if f.name != text_col]
    names = fresh(docs.drop(text_col), "n_tokens", "ids_sha256", "decoded_sha256")
    schema = T.StructType([*kept, *(T.StructField(n, k) for n, k in zip(names, (T.LongType(), T.StringType(), T.StringType()), strict=True))])
    if with_ids:
        schema.add(*fresh(docs.drop(text_col), "ids"), T.ArrayType(T.IntegerType()))
    at = docs.columns.index(text_col)

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            data, offsets = byte_view(batch.column(at))
            for lo, hi in chunks(offsets):
                part = offsets[lo : hi + 1]
                ids, counts = bpe.encode(data[part[0] : part[-1]], part - part[0])
                back, upto = bpe.decode(ids, counts)
                ends = np.concatenate([[0], np.cumsum(counts)]) * 4
                raw, back = memoryview(ids.astype("<u4").tobytes()), memoryview(back.tobytes())
                sha = lambda view, to: pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(to[:-1], to[1:], strict=True)], pa.string())
                old = [c.slice(lo, hi - lo) for i, c in enumerate(batch.columns) if i != at]
                new = [pa.array(counts), sha(raw, ends), sha(back, upto)]
                if with_ids:
                    new.append(pa.ListArray.from_arrays((ends // 4).astype(np.int32), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([*old, *new], names=schema.fieldNames())

    return docs.mapInArrow(lean(run, caches=False), schema)


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
