"""Line dedup: one occurrence of each group of equal or fuzzily equal lines.

Lines are normalised (A-Z folded, digits as 0, everything between words as one
blank) and hashed; equal normalised lines are one distinct line from the start.
Each distinct line gets a 64-bit SimHash over its words, and block keys by which
it is joined with others:

* By the pigeonhole principle, SimHashes at a distance of d bits agree on one of
  d + 1 blocks. Lines at an edit similarity of 0.8 to 0.95 differ in 5 to 18 bits,
  so blocks of the SimHash itself would have three bits each. The blocks are
  therefore taken from the minima of hashes of a line's words: six blocks of four
  minima. Lines that have a share J of their words in common agree on a block with
  probability 1 - (1 - J^4)^6.
* Lines of at most ``SHORT`` characters have the keys of all strings that are one
  deletion away, which finds every pair within one edit.

Lines that share a block and whose SimHashes differ in at most ``CLOSE`` bits form
a candidate set; sets with the same least line are one. Sets are compared in units
of bounded size, where an edit similarity of ``SIMILARITY`` or more verifies a
link; verified links alone make components. Of each connected group the first
occurrence stays, by document id and line number; all others go.

Lines without a word are left alone. Defined results: a null text stays null; an
empty one stays empty; repeated rows (same id, same text) count as one
occurrence and are treated alike; documents with a null id come last in order;
ties of id go to the lesser line number, then to the lesser key of the row; an
empty table stays empty; other columns are passed on, and clashing names do no
harm. Very long texts and lines are compared whole; a unit then holds two blocks
of one line each. Equality of normalised lines is that of their 64-bit hashes.
"""

from __future__ import annotations

from collections import defaultdict
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import byte_view, chunks, fresh, lean, marked, marks, may_hold, partitions, staged, text_key
from ._groups import components, each_unit, units
from ._words import _BASE, _INVERSE, ALNUM, FOLD, U, _powers, hash_spans, mix, rows_of, spans

#: Most bits that SimHashes of candidates differ in.
CLOSE = 18
SIMILARITY = 0.8
#: Bytes of text in a block of a unit.
BUDGET = 400_000
#: Blocks of a line, and minima in each.
BLOCKS, MINIMA = 6, 4
#: Characters of units whose lines are compared together, and of pairs of lines at once.
TOGETHER, AREA = 4_000_000, 2_000_000
#: Pairs that are worth tables side by side, such tables, and columns between looks at their costs.
MANY, BESIDE, STEP = 24, 128, 16
#: Pairs of a unit that wait for their distances before more are taken.
SOME = 256
#: Characters of a short line.
SHORT = 9
#: Lines of a block that are compared with each other at once; a larger block is
#: a candidate set as a whole, to be cut into units.
HOT = 1024
#: Keys that are dealt at once, buckets that a partition has of them, and keys of a
#: bucket that are held before frequent ones leave.
DEALT, BUCKETS, HELD = 1 << 19, 4, 1 << 21
#: Kinds of characters that are counted apart for a bound of the edit distance.
KINDS = 64

SALTS = mix(np.arange(1, BLOCKS * MINIMA + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
#: The four bits of a number, each in 16 bits of its own.
LANES = np.array([sum((i >> k & 1) << 16 * k for k in range(4)) for i in range(16)], U)
FOLD_DIGITS = FOLD.copy()
FOLD_DIGITS[0x30:0x3A] = 0x30

LINES = "doc_key long, doc_id long, line_no int, line long, sim long, size int, keys binary"
#: Spreads line numbers over the keys of their rows.
PLACE = 1000003
TEXTS = "doc_key long, line_no int, line long, norm string"


def _sequence_hash(h: np.ndarray, first: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Order-dependent hash of h[first:upto] for each pair."""
    n = len(h)
    total = np.zeros(n + 1, U)
    size = 1 << max(10, int(n + 1).bit_length())
    np.cumsum(h * _powers(_BASE, size)[:n], out=total[1:])
    out = (total[upto] - total[first]) * _powers(_INVERSE, size)[first]
    return mix(out ^ ((upto - first).astype(U) * U(0xA0761D6478BD642F)))


def _bit_sums(h: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per group the number of distinct values, and of those with each bit set."""
    key = mix(h + group.astype(U) * U(0x9E3779B97F4A7C15))
    once = ~pd.Series(key).duplicated().to_numpy(bool)
    h, group = h[once], group[once]
    count = np.bincount(group, minlength=n)
    sums = np.zeros((n, 64), np.int32)
    some = np.flatnonzero(count)
    if not len(some):
        return count, sums
    starts = (np.cumsum(count) - count)[some]
    octets = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
    if count.max() < 1 << 16:  # four bits are summed at a time, in 16-bit lanes of one number
        for k in range(16):
            lanes = LANES[octets[:, k // 2] >> 4 * (k % 2) & 15]
            sums[some, 4 * k : 4 * k + 4] = np.add.reduceat(lanes, starts).view(np.uint16).reshape(-1, 4)
    else:
        sums[some] = np.add.reduceat(np.unpackbits(octets, axis=1, bitorder="little"), starts, axis=0, dtype=np.int32)
    return count, sums


def _cut(data: np.ndarray, offsets: np.ndarray):
    """Start, end, row and number of each line of rows with text."""
    newlines = np.flatnonzero(data == 0x0A)
    # a line starts after a newline or with its row, and ends at a newline or with its row
    ls = np.union1d(newlines + 1, offsets[:-1])
    ls = ls[ls < len(data)]
    row = rows_of(ls, offsets)
    le = np.append(ls[1:], len(data))[: len(ls)]
    le = np.where(data[le - 1] == 0x0A, le - 1, le)
    return ls, le, row, (np.searchsorted(newlines, ls) - np.searchsorted(newlines, offsets[row])).astype(np.int32)


def _lines(data: np.ndarray, offsets: np.ndarray):
    """Lines with a word: row, line number, word range; and the words."""
    s, e = spans(data, offsets, ALNUM)
    ls, le, row, no = _cut(data, offsets)
    first, upto = np.searchsorted(s, ls, "left"), np.searchsorted(s, le, "left")
    some = upto > first
    return row[some], no[some], first[some], upto[some], s, e


def line_hashes(data: np.ndarray, offsets: np.ndarray):
    """Row, line number, hash, SimHash (0 for short lines), normalised characters
    and block keys (a flat array and its offsets) of each line."""
    row, no, first, upto, s, e = _lines(data, offsets)
    n = len(row)
    h = hash_spans(data, s, e, FOLD_DIGITS)
    words = upto - first
    inner = np.flatnonzero((data & 0xC0) == 0x80)  # bytes within a character
    chars = np.concatenate([[0], np.cumsum(e - s - np.searchsorted(inner, e) + np.searchsorted(inner, s))])
    size = chars[upto] - chars[first] + words - 1
    line = _sequence_hash(h, first, upto)
    if not n:
        return row, no, line, np.empty(0, U), size.astype(np.int32), np.empty(0, U), np.zeros(1, np.int64)
    # every word of a line with a word is in a line, in order
    counts, sums = _bit_sums(h, np.repeat(np.arange(n), words), n)
    sim = np.packbits((2 * sums > counts[:, None]).astype(np.uint8), axis=1, bitorder="little").view(U)[:, 0]
    starts = np.cumsum(words) - words
    blocks = np.empty((n, BLOCKS), U)
    for b in range(BLOCKS):
        key = np.full(n, b + 1, U)
        for salt in SALTS[b * MINIMA : (b + 1) * MINIMA]:
            key = mix(key * U(0xD1342543DE82EF95) + np.minimum.reduceat(h * salt >> U(32), starts))
        blocks[:, b] = key
    short = size <= SHORT
    sim[short] = 0
    many = np.where(short, 0, BLOCKS)
    flat = [blocks[~short].reshape(-1)]
    if short.any():  # keys of short lines, in place of the blocks
        found = []
        for i in np.flatnonzero(short):
            text = b" ".join(FOLD_DIGITS[data[a:z]].tobytes() for a, z in zip(s[first[i] : upto[i]], e[first[i] : upto[i]], strict=True)).decode()
            near = {text} | {text[:k] + text[k + 1 :] for k in range(len(text))}
            found.append(np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in sorted(near)], U))
            many[i] = len(near)
        at = np.concatenate([[0], np.cumsum(many)])
        keys = np.empty(at[-1], U)
        keys[np.repeat(~short, many)] = flat[0]
        keys[np.repeat(short, many)] = np.concatenate(found)
        flat = [keys]
    return row, no, line, sim, size.astype(np.int32), flat[0], np.concatenate([[0], np.cumsum(many)])


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(text_key(id_col, text_col).alias("k"), F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t"))

    def run(batches):
        for batch in batches:
            keys, ids = batch.column(0), batch.column(1)
            data, offsets = byte_view(batch.column(2))
            for lo, hi in chunks(offsets):
                part = offsets[lo : hi + 1]
                row, no, line, sim, size, flat, upto = line_hashes(data[part[0] : part[-1]], part - part[0])
                at = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(at), ids.take(at), pa.array(no), pa.array(line.view(np.int64)), pa.array(sim.view(np.int64)), pa.array(size),
                        pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((8 * upto).astype(np.int32)), pa.py_buffer(flat)]),
                    ],
                    names=["doc_key", "doc_id", "line_no", "line", "sim", "size", "keys"],
                )

    return rows.mapInArrow(lean(run), LINES)


def normalise(line: bytes) -> str:
    """The normalised form of one line's bytes."""
    data = np.frombuffer(line, np.uint8)
    s, e = spans(data, np.array([0, len(data)]), ALNUM)
    folded = FOLD_DIGITS[data].tobytes()
    return b" ".join(folded[a:b] for a, b in zip(s, e, strict=True)).decode()


def _texts(docs: DataFrame, doc_marks: np.ndarray, place_marks: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Normalised text of lines whose place may be wanted; only those are read as words."""
    sc = docs.sparkSession.sparkContext
    of_docs, of_places = sc.broadcast(doc_marks), sc.broadcast(place_marks)
    rows = docs.select(text_key(id_col, text_col).alias("k"), F.col(f"`{text_col}`").alias("t"))

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(marked(of_docs.value, batch.column(0).to_numpy())))
            keys = batch.column(0).to_numpy()
            data, offsets = byte_view(batch.column(1))
            for lo, hi in chunks(offsets):
                part = offsets[lo : hi + 1]
                piece, part = data[part[0] : part[-1]], part - part[0]
                ls, le, row, no = _cut(piece, part)
                at = np.flatnonzero(marked(of_places.value, keys[lo:hi][row] ^ (no.astype(np.int64) * PLACE)))
                row, no = row[at], no[at]
                wanted = [piece[i:j] for i, j in zip(ls[at], le[at], strict=True)]
                text = np.concatenate([piece[:0], *wanted])
                upto = np.concatenate([[0], np.cumsum([len(w) for w in wanted], dtype=np.int64)])
                some, _, first, last, s, e = _lines(text, upto)
                line = _sequence_hash(hash_spans(text, s, e, FOLD_DIGITS), first, last).astype(np.int64)
                folded = FOLD_DIGITS[text].tobytes()
                norm = [b" ".join(folded[a:b] for a, b in zip(s[f:g], e[f:g], strict=True)).decode() for f, g in zip(first, last, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[lo:hi][row[some]]), pa.array(no[some]), pa.array(line), pa.array(norm, pa.string())],
                    names=["doc_key", "line_no", "line", "norm"],
                )

    return rows.mapInArrow(lean(run), TEXTS)


def _dealt(buckets: int):
    """Deals the keys of ``line``, ``sim`` and ``keys`` into buckets, by key: rows of a
    bucket and its triples of key, line and SimHash, as bytes. A row of Spark's own
    for each key costs several times as much. A line counts once in what is dealt at
    once, so one that is everywhere is no load."""

    def run(batches):
        held, load = [], 0

        def deal():
            line, sim, many, flat = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            once = ~pd.Series(line).duplicated().to_numpy(bool)
            key = flat[np.repeat(once, many)]
            line, sim = (np.repeat(x[once], many[once]) for x in (line, sim))
            bucket = ((key.view(U) >> U(32)) * U(buckets) >> U(32)).astype(np.int32)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
            triples = np.stack([key[order], line[order], sim[order]], axis=1)
            count = np.bincount(bucket, minlength=buckets)
            some = np.flatnonzero(count)
            upto = np.concatenate([[0], np.cumsum(24 * count[some])]).astype(np.int32)
            rows = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(upto), pa.py_buffer(triples)])
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), rows], names=["bucket", "rows"])

        for batch in batches:
            flat, upto = byte_view(batch.column(2))
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.diff(upto) // 8, flat.view(np.int64)))
            load += len(flat) // 8
            if load >= DEALT:
                yield deal()
                load = 0
        if load:
            yield deal()

    return run


def _in_order(triples: np.ndarray) -> np.ndarray:
    """Triples by key and line, each line once for a key."""
    triples = triples[np.lexsort((triples[:, 1], triples[:, 0]))]
    once = np.ones(len(triples), bool)
    once[1:] = (triples[1:, :2] != triples[:-1, :2]).any(axis=1)
    return triples[once]


def _sets(batches):
    """Candidate sets of what ``_dealt`` made, sorted by bucket. Besides the keys of one
    bucket that are not too frequent, a bounded number of triples is held."""
    held, load, most, hot, now = [], 0, HELD, np.empty(0, np.int64), None

    def emit(triples):
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(triples[:, k])) for k in (0, 1)], names=["cluster", "line"])

    def last():
        triples = np.concatenate(held)
        order = np.argsort(triples[:, 0])
        key = triples[order, 0]
        twin = np.zeros(len(key) + 1, bool)
        twin[1:-1] = key[1:] == key[:-1]
        triples = _in_order(triples[order[twin[1:] | twin[:-1]]])  # keys of one line alone make no set
        names = ["key", "line", "sim"]
        yield from _candidates([pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in triples.T], names=names)])

    for batch in batches:
        data, offsets = byte_view(batch.column(1))
        triples, upto = data.view(np.int64).reshape(-1, 3), (offsets // 24).tolist()
        for bucket, lo, hi in zip(batch.column(0).to_pylist(), upto, upto[1:], strict=False):
            if bucket != now:
                if held:
                    yield from last()
                held, load, most, hot, now = [], 0, HELD, hot[:0], bucket
            part = triples[lo:hi]
            if len(hot):
                much = np.isin(part[:, 0], hot)
                if much.any():
                    yield emit(part[much])
                    part = part[~much]
            held.append(part)
            load += len(part)
            if load > most:
                part = _in_order(np.concatenate(held))
                first = np.flatnonzero(np.diff(part[:, 0], prepend=part[0, 0] - 1))
                count = np.diff(first, append=len(part))
                much = np.repeat(count > HOT, count)
                if much.any():
                    yield emit(part[much])
                hot = np.union1d(hot, part[first[count > HOT], 0])
                held = [part[~much]]
                load = len(held[0])
                most = max(HELD, 2 * load)
    if held:
        yield from last()


def _candidates(batches):
    """Candidate sets: for each key of the sorted rows, the lines that are close to
    another one. A set is named by its least line, so that sets of lines that share
    several blocks with it are one, and few pairs are compared twice."""
    empty = np.empty(0, np.int64)
    held, hot = [empty, empty, empty.view(U)], None

    def emit(name, line):
        return pa.RecordBatch.from_arrays([pa.array(name), pa.array(line)], names=["cluster", "line"])

    def sets(key, line, sim):
        near = np.zeros(len(key), bool)
        i, step = np.arange(len(key)), 0
        while len(i):
            step += 1
            i = i[i + step < len(key)]
            i = i[key[i] == key[i + step]]
            close = i[np.bitwise_count(sim[i] ^ sim[i + step]) <= CLOSE]
            near[close] = near[close + step] = True
        key, line = key[near], line[near]
        first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
        return emit(np.repeat(line[first], np.diff(first, append=len(key))), line)

    for batch in batches:
        new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(U)]
        key, line, sim = (np.concatenate([x, y]) for x, y in zip(held, new, strict=True))
        if hot is not None:
            more = int(np.searchsorted(key, hot, "right"))
            yield emit(np.full(more, hot, np.int64), line[:more])
            key, line, sim = key[more:], line[more:], sim[more:]
        if not len(key):
            held = [key, line, sim]
            continue
        # keys that are too frequent are sets as they stand
        first = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        count = np.diff(first, append=len(key))
        much = np.repeat(count > HOT, count)
        last = int(first[-1])
        if much.any():
            yield emit(key[much], line[much])
            hot = key[-1] if much[-1] else None
        done = ~much
        done[last:] = False
        if done.any():
            yield sets(key[done], line[done], sim[done])
        held = [empty, empty, empty.view(U)] if much[-1] else [key[last:], line[last:], sim[last:]]
    if len(held[0]):
        yield sets(*held)


def _least(up: int, down: int, done: int, n: int, m: int) -> int:
    """A lower bound of the distance from the table's column after ``done`` of m
    characters: the least over its n + 1 cells of what the cell has cost and the
    difference of the lengths that are left."""
    width = (n + 7) // 8
    raw = np.frombuffer(up.to_bytes(width, "little") + down.to_bytes(width, "little"), np.uint8)
    bits = np.unpackbits(raw.reshape(2, width), axis=1, count=n, bitorder="little").view(np.int8)
    rest = n - (m - done)  # of the first cell; one less for each next one
    cost = np.cumsum(bits[0] - bits[1], dtype=np.int64)
    cost += np.abs(np.arange(rest - 1, rest - 1 - n, -1))
    return done + min(int(cost.min()), abs(rest))


def _places(a: str) -> dict[str, int]:
    """The places of each character, as bits of a number."""
    kinds = "".join(sorted(set(a)))
    if len(a) < 64 or len(kinds) * len(a) > 1 << 22:
        where: dict[str, int] = defaultdict(int)
        for i, c in enumerate(a):
            where[c] |= 1 << i
        return where
    codes = np.frombuffer(a.encode("utf-32-le"), np.uint32)
    rows = np.packbits(codes == np.frombuffer(kinds.encode("utf-32-le"), np.uint32)[:, None], axis=1, bitorder="little")
    return defaultdict(int, zip(kinds, (int.from_bytes(r.tobytes(), "little") for r in rows), strict=True))


def edit_distance(a: str, b: str, most: float = np.inf) -> int:
    """Levenshtein distance, with the rows of the table as bits of one number. A
    distance above ``most`` may be given as any number above it: at some columns,
    ``_least`` tells whether all ways go beyond."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    where = _places(a)
    # bits from len(a) on are carried over from the last row and stand for nothing
    full, up, down = (1 << len(a)) - 1, (1 << len(a)) - 1, 0
    done, test = 0, 1.5 * most + 16
    while done < len(b):
        if done >= test:
            least = _least(up & full, down, done, len(a), len(b))
            if least > most:
                return least
            test = done + max(24, 1.5 * (most - least))
        upto = min(len(b), max(done + 1, ceil(test))) if test < len(b) else len(b)
        for eq in map(where.__getitem__, b[done:upto]):
            v = ((((eq & up) + up) ^ up) | eq | down) & full
            left = (down | (full ^ (v | up))) << 1 | 1
            up = (v & up) << 1 | (full & ~(v | left))
            down = left & v
        done = upto
    return len(b) + (up & full).bit_count() - down.bit_count()


def _packed(mask: np.ndarray) -> np.ndarray:
    """Rows of 64 n booleans as n rows of words, in which the first is the least bit."""
    return np.ascontiguousarray(np.packbits(mask, axis=1, bitorder="little").view(U).T)


def _words(most: int, diff: int) -> int:
    """Words of a pair's band, of whose bits three of eight are below its diagonal."""
    return max((most - diff) // 2 // 24 + 1, (most + diff) // 2 // 40 + 1)


def _banded(pairs: list[tuple[str, str]], most: list[int], words: int) -> list[int]:
    """Distances of pairs of strings, the longer one first; ``most`` is their
    difference in length or more, and ``_words`` of it ``words`` at most. All tables
    go on by one column at a time, as words of bits (Hyyro's banded form), lane
    beside lane; a lane whose pair is done goes to another.

    A way of at most ``most`` steps stays within (most - diff) / 2 rows below the
    diagonal of the last cell and (most + diff) / 2 above it. Costs never fall along
    a diagonal, so a pair is beyond its bound as soon as that diagonal is. Pairs end
    in equal characters up to a whole number of steps, which changes no distance.
    """
    bits, last = 64 * words, 40 * words - 1
    n, m = (np.array([len(x[i]) for x in pairs]) for i in (0, 1))
    diff, bound = n - m, np.array(most)
    steps = -(-m // STEP)
    codes = np.frombuffer("".join(x + y for x, y in pairs).encode("utf-32-le"), np.uint32)
    number = np.zeros(int(codes.max()) + 1, np.uint32)
    number[codes] = 1
    kinds = np.flatnonzero(number)
    number[kinds] = np.arange(2, len(kinds) + 2)  # 0 equals nothing, 1 is the character at the ends
    code = number[codes].astype(np.uint8 if len(kinds) < 254 else np.uint32)
    # each pair has ``bits`` more characters before its end in a than in b
    b_first = np.cumsum(steps * STEP) - steps * STEP
    a_first = b_first + np.arange(len(pairs)) * bits
    a, b = np.zeros(a_first[-1] + steps[-1] * STEP + bits, code.dtype), np.ones(b_first[-1] + steps[-1] * STEP, code.dtype)
    at = 0
    for i, f, x, y, d, w in zip(a_first.tolist(), b_first.tolist(), n.tolist(), m.tolist(), diff.tolist(), (steps * STEP).tolist(), strict=True):
        a[i + last - d : i + last + y] = code[at : at + x]
        a[i + last + y : i + last + w] = 1
        b[f : f + y] = code[at + x : at + x + y]
        at += x + y
    view = np.lib.stride_tricks.sliding_window_view(a, bits)
    out, lanes, nxt = diff.copy(), np.empty(0, np.int64), 0
    up = down = np.empty((words, 0), U)
    word, bit = divmod(last, 64)
    while True:
        cost = out[lanes]
        on = (cost <= bound[lanes]) & (steps[lanes] > 0)
        if not on.all() or len(lanes) < BESIDE and nxt < len(pairs):
            new = np.arange(nxt, min(len(pairs), nxt + BESIDE - int(on.sum())))
            nxt += len(new)
            fresh_up = _packed(np.arange(bits) >= (last - diff[new])[:, None])
            up, down = np.hstack([up[:, on], fresh_up]), np.hstack([down[:, on], np.zeros_like(fresh_up)])
            lanes = np.concatenate([lanes[on], new])
            seen = np.empty((STEP, len(lanes)), U)
        if not len(lanes):
            return out.tolist()
        i, k = a_first[lanes], b[b_first[lanes] + np.arange(STEP)[:, None]][:, :, None]
        for j in range(STEP):
            eq = _packed(view[i + j] == k[j])
            v = eq & up
            v += up
            if words > 1:  # carries from word to word
                over = v[0] < up[0]
                for w in range(1, words):
                    more = v[w]
                    first = more < up[w]
                    more += over
                    over = first | (over & (more == 0))
            v ^= up
            v |= eq
            v |= down
            left = np.invert(v | up)
            left |= down
            up &= v
            seen[j] = v[word]
            down = v >> U(1)
            if words > 1:
                down[:-1] |= v[1:] << U(63)
            up |= np.invert(down | left)
            down &= left
        out[lanes] += STEP - (seen >> U(bit) & U(1)).sum(axis=0).astype(np.int64)
        a_first[lanes] += STEP
        b_first[lanes] += STEP
        steps[lanes] -= 1


def edit_distances(pairs: list[tuple[str, str]], most: list[float]) -> list[int]:
    """``edit_distance`` of each pair; those whose bands are equally wide are taken
    together where they are many."""
    out, left = [0] * len(pairs), defaultdict(list)
    for i, (a, b) in enumerate(pairs):
        if len(a) < len(b):
            a, b = b, a
        start, end, size = 0, 0, len(b)
        while start < size and a[start] == b[start]:
            start += 1
        while end < size - start and a[-1 - end] == b[-1 - end]:
            end += 1
        a, b = a[start : len(a) - end], b[start : size - end]
        if not b or len(a) - len(b) > most[i]:
            out[i] = len(a) - len(b)
        else:
            bound = min(int(most[i]), len(a))
            left[_words(bound, len(a) - len(b))].append((i, a, b, bound))
    for words, wait in left.items():
        wait.sort(key=lambda x: -len(x[2]))
        lo = 0
        while lo < len(wait):
            hi, load = lo, 0
            while hi < len(wait) and load < AREA:
                load += len(wait[hi][1]) + 64 * words
                hi += 1
            part, lo = wait[lo:hi], hi
            if len(part) < MANY:
                for i, a, b, bound in part:
                    out[i] = edit_distance(a, b, bound)
            else:
                for (i, *_), d in zip(part, _banded([x[1:3] for x in part], [x[3] for x in part], words), strict=True):
                    out[i] = d
    return out


def aligned_cost(a: list[str], b: list[str], ahead: int = 5, most: float = np.inf) -> int:
    """An upper bound of the edit distance of two lines given as words: what one
    alignment costs that goes through both, and where words differ skips the fewest
    (less than ``ahead``) after which the next ones are equal, else replaces one.
    Above ``most`` it may end with what it has cost so far."""
    i, j, n, m, cost = 0, 0, len(a), len(b), 0
    while i < n and j < m:
        x, y = a[i], b[j]
        if x == y:
            i, j = i + 1, j + 1
            continue
        if cost > most:
            return cost
        for k in range(1, ahead):
            if i + k < n and a[i + k] == y:
                cost, i = cost + sum(map(len, a[i : i + k])) + k, i + k
                break
            if j + k < m and x == b[j + k]:
                cost, j = cost + sum(map(len, b[j : j + k])) + k, j + k
                break
            if i + k < n and j + k < m and a[i + k] == b[j + k]:
                cost += max(sum(map(len, a[i : i + k])), sum(map(len, b[j : j + k]))) + k - 1
                i, j = i + k, j + k
                break
        else:
            cost, i, j = cost + max(len(x), len(y)), i + 1, j + 1
    return cost + sum(map(len, a[i:])) + n - i + sum(map(len, b[j:])) + m - j


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    """Whether the edit similarity is ``least`` or more; the cheap bound decides
    most pairs that are, the distance itself all others."""
    most = (1 - least) * max(len(a), len(b)) + 1e-9
    return aligned_cost(a.split(" "), b.split(" "), most=most) <= most or edit_distance(a, b, most) <= most


def _kinds(texts: list[str]) -> np.ndarray:
    """Numbers of characters of each of ``KINDS`` kinds in each text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.repeat(np.arange(len(texts)) * KINDS, size) + codes % KINDS
    return np.bincount(at, minlength=len(texts) * KINDS).reshape(-1, KINDS).astype(np.int32)


def _near(sim: np.ndarray, size: np.ndarray, side: np.ndarray, kinds: np.ndarray, label: np.ndarray):
    """Pairs of a unit's lines that may be similar by their SimHashes, sizes and
    characters, and whose labels are not equal by the time they are looked for. A step
    of an edit changes the sum of the differences of ``kinds`` by two at most, and by
    one if it changes the size."""
    step = max(1, 4096 // len(sim))
    for lo in range(0, len(sim), step):
        i = np.arange(lo, min(lo + step, len(sim)))[:, None]
        meet = np.where(side[i] == 0, np.arange(len(sim)) > i, (side[i] == 1) & (side == 2))
        meet &= np.bitwise_count(sim[i] ^ sim) <= CLOSE
        meet &= label[i] != label
        first, second = np.nonzero(meet)
        first += lo
        a, b = size[first], size[second]
        most = (1 - SIMILARITY) * np.maximum(a, b) + 1e-9
        fit = np.minimum(a, b) >= SIMILARITY * np.maximum(a, b) - 1e-9
        first, second, most = first[fit], second[fit], most[fit]
        for at in range(0, len(first), 1024):
            i, k = first[at : at + 1024], second[at : at + 1024]
            apart = np.abs(kinds[i] - kinds[k]).sum(axis=1) + np.abs(size[i] - size[k])
            fit = apart <= 2 * most[at : at + 1024]
            yield from zip(i[fit].tolist(), k[fit].tolist(), strict=True)


def _linked(unit: dict[str, list], kinds: np.ndarray, a: list[int], b: list[int]):
    """Adds verified links of a unit, as a spanning forest. Yields pairs of texts
    whose distance decides and their bounds, and is sent the distances."""
    line, text, size = unit["line"], unit["norm"], [len(t) for t in unit["norm"]]
    words: list[list[str] | None] = [None] * len(line)
    label = np.arange(len(line))
    group = {i: [i] for i in range(len(line))}
    top = list(range(len(line)))  # the same as label, quicker to read

    def link(i, k):
        x, y = sorted((top[i], top[k]), key=lambda r: len(group[r]))
        if x != y:
            moved = group.pop(x)
            group[y] += moved
            label[moved] = y
            for m in moved:
                top[m] = y
            a.append(line[i])
            b.append(line[k])

    def verdicts():
        left = [x for x in wait if top[x[0]] != top[x[1]]]
        wait.clear()
        got = yield [(text[i], text[k]) for i, k, _ in left], [x[2] for x in left]
        for (i, k, most), d in zip(left, got, strict=True):
            if d <= most:
                link(i, k)

    wait: list[tuple[int, int, float]] = []
    for i, k in _near(np.array(unit["sim"], np.int64).view(U), np.array(size), np.array(unit["side"]), kinds, label):
        if top[i] != top[k]:
            for x in (i, k):
                if words[x] is None:
                    words[x] = text[x].split(" ")
            most = (1 - SIMILARITY) * max(size[i], size[k]) + 1e-9
            if aligned_cost(words[i], words[k], most=most) <= most:
                link(i, k)
                continue
            wait.append((i, k, most))
            if len(wait) >= SOME:
                yield from verdicts()
    if wait:
        yield from verdicts()


def _compare(units: list[dict[str, list]]) -> dict[str, list]:
    """Verified links of units, each as a spanning forest; distances that units
    wait for are taken together."""
    a: list[int] = []
    b: list[int] = []
    kinds = _kinds([t for u in units for t in u["norm"]])
    upto = np.cumsum([0, *(len(u["norm"]) for u in units)]).tolist()
    going, answers = [_linked(u, kinds[i:k], a, b) for u, i, k in zip(units, upto, upto[1:], strict=False)], [None] * len(units)
    while going:
        still, asked = [], []
        for g, x in zip(going, answers, strict=True):
            try:
                asked.append(g.send(x))
                still.append(g)
            except StopIteration:
                pass
        got = iter(edit_distances([p for x, _ in asked for p in x], [m for _, x in asked for m in x]))
        going, answers = still, [[next(got) for _ in x] for x, _ in asked]
    return {"a": a, "b": b}


def links(docs: DataFrame, lines: DataFrame, distinct: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``a`` and ``b``: pairs of distinct lines that connect each group of similar
    ones. ``lines`` has each ``line`` once or more often, with its SimHash and keys;
    ``distinct`` has it once, with ``p``, its first place."""
    n = partitions(docs.sparkSession)
    keyed = lines.select("line", "sim", "keys").mapInArrow(lean(_dealt(BUCKETS * n)), "bucket int, rows binary")
    dealt = keyed.repartition(n, "bucket").sortWithinPartitions("bucket")
    sets = staged(dealt.mapInArrow(lean(_sets), "cluster long, line long").distinct(), "sets")
    members = staged(
        sets.join(distinct.select("line", "p.doc_key", "p.line_no", "p.sim", "p.size"), "line"),
        "members",
    )
    place = members.select(F.col("doc_key").bitwiseXOR(F.col("line_no").cast("long") * PLACE).alias("place"))
    texts = _texts(docs, marks(members, "doc_key"), marks(place, "place"), id_col, text_col).dropDuplicates(["line", "doc_key", "line_no"])
    rows = units(members, "cluster", "line", "size", BUDGET).join(texts, ["line", "doc_key", "line_no"]).select("unit", "side", "line", "sim", "norm")
    return staged(each_unit(rows, _compare, "a long, b long", TOGETHER), "links")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_key`` and ``gone``, the numbers of the lines to remove, for each
    document that loses any."""
    lines = staged(_hashed(docs, id_col, text_col), "lines")
    # the first place of each line, and what depends on the line alone
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "line_no", "doc_key", "sim", "size")
    distinct = staged(lines.groupBy("line").agg(F.min(place).alias("p"), F.count("*").alias("n")), "distinct")
    label = components(links(docs, lines, distinct, id_col, text_col))
    where = distinct.select("line", "n", F.struct("p.n", "p.doc_id", "p.line_no", "p.doc_key").alias("place"))
    # lines that are in a group or more often than once
    known = staged(where.join(label.withColumnRenamed("node", "line"), "line", "left").filter("n > 1 or root is not null"), "known")
    grouped = known.filter("root is not null")
    first = staged(grouped.groupBy("root").agg(F.min("place").alias("keep")), "first")
    kept = known.filter("root is null").select("line", F.col("place").alias("keep")).unionByName(grouped.join(first, "root").select("line", "keep"))
    kept = staged(kept, "kept")  # so that the join with a hot line's occurrences can be split
    here = (F.col("doc_key") == F.col("keep.doc_key")) & (F.col("line_no") == F.col("keep.line_no"))
    gone = lines.select("line", "doc_key", "line_no").join(kept, "line").filter(~here).select("doc_key", "line_no")
    return staged(gone.groupBy("doc_key").agg(F.collect_set("line_no").alias("gone")), "gone")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text that is left, and ``n_removed`` lines.

    Only documents that may lose a line, by a bitmap of fixed size, are shuffled.
    """
    gone = removed_lines(docs, id_col, text_col)
    bitmap = docs.sparkSession.sparkContext.broadcast(marks(gone, "doc_key"))
    k, maybe, cut, removed = fresh(docs, "row_key", "maybe", "gone", "n_removed")
    keyed = docs.withColumn(k, text_key(id_col, text_col)).withColumn(maybe, may_hold(bitmap)(k))
    some = keyed.filter(F.col(maybe)).join(gone.select(F.col("doc_key").alias(k), F.col("gone").alias(cut)), k, "left")
    left = F.array_join(F.filter(F.split(F.col(f"`{text_col}`"), "\n"), lambda _, i: ~F.array_contains(F.col(cut), i)), "\n")
    some = some.withColumn(text_col, F.when(F.col(cut).isNull(), F.col(f"`{text_col}`")).otherwise(left))
    some = some.withColumn(removed, F.coalesce(F.size(cut), F.lit(0)))
    rest = keyed.filter(~F.col(maybe)).withColumn(removed, F.lit(0))
    names = [f"`{c}`" for c in [*docs.columns, removed]]
    return rest.select(*names).unionByName(some.select(*names))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs)
