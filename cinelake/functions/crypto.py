"""Segment decryption. AES runs in Spark's own functions; Arrow UDFs add what
those lack: XOR of bytes, lenient padding, ChaCha20."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FULL = b"\x10" * 16


#: Bytes of an Arrow batch in queries that send whole files through several UDFs.
BATCH = "4m"
#: Blocks of ChaCha20 that are computed at once.
BLOCKS = 4096


def in_small_batches(spark: SparkSession) -> SparkSession:
    """A session like the given one whose Arrow batches have ``BATCH`` bytes. Each
    UDF that waits for another's result holds batches in the JVM and in a worker of
    its own, in each running task."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return own


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column, not copied, and its offsets in them."""
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8), np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]


def _binary(data: np.ndarray, offsets: np.ndarray, valid: np.ndarray) -> pa.Array:
    """A binary column of these bytes."""
    mask = pa.py_buffer(np.packbits(valid, bitorder="little"))
    out = pa.Array.from_buffers(pa.large_binary(), len(valid), [mask, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    return out.cast(pa.binary())


def _valid(*columns: pa.Array) -> np.ndarray:
    """Where none of the columns is null."""
    return np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])


@F.arrow_udf(T.BinaryType())
def xor(a: pa.Array, b: pa.Array) -> pa.Array:
    """Bytes of ``a`` with those of ``b``, up to the shorter one's length."""
    (x, at), (y, bt), valid = _bytes(a), _bytes(b), _valid(a, b)
    size = np.where(valid, np.minimum(np.diff(at), np.diff(bt)), 0)
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(to[-1], np.uint8)
    for i, j, k, n in zip(at.tolist(), bt.tolist(), to.tolist(), size.tolist(), strict=False):
        np.bitwise_xor(x[i : i + n], y[j : j + n], out=out[k : k + n])
    return _binary(out, to, valid)


def strip_padding(data: Column) -> Column:
    """Without PKCS7 padding if it is valid, else unchanged."""
    n = F.octet_length(data)
    last = F.conv(F.hex(F.substring(data, n, F.lit(1))), 16, 10).cast("int")
    pad = F.hex(F.substring(data, n - last + 1, last))
    valid = (n > 0) & last.between(1, 16) & (last <= n) & (pad == F.repeat(F.lpad(F.hex(last), 2, "0"), last))
    return F.when(valid, F.substring(data, F.lit(1), n - last)).otherwise(data)


def aes_cbc(data: Column, key: Column, iv: Column, lenient: bool = True) -> Column:
    """AES-CBC decryption of whole blocks, padding stripped where it is valid.

    A block that decrypts to full padding is appended, so that Spark's padded mode
    gives back all of the data's own bytes.
    """
    n = F.octet_length(data)
    last = F.when(n >= 16, F.substring(data, n - 15, F.lit(16))).otherwise(iv)
    tail = F.substring(F.aes_encrypt(xor(last, F.lit(_FULL)), key, F.lit("ECB"), F.lit("PKCS")), F.lit(1), F.lit(16))
    plain = F.aes_decrypt(F.concat(iv, data, tail), key, F.lit("CBC"), F.lit("PKCS"))
    plain = F.when((n % 16 == 0) & (n > 0), plain).otherwise(F.when(n == 0, data))
    return strip_padding(plain) if lenient else plain


def aes_ecb(data: Column, key: Column, lenient: bool = True) -> Column:
    """AES-ECB decryption of whole blocks, likewise."""
    n = F.octet_length(data)
    tail = F.substring(F.aes_encrypt(F.lit(_FULL), key, F.lit("ECB"), F.lit("PKCS")), F.lit(1), F.lit(16))
    plain = F.when((n % 16 == 0) & (n > 0), F.aes_decrypt(F.concat(data, tail), key, F.lit("ECB"), F.lit("PKCS"))).otherwise(F.when(n == 0, data))
    return strip_padding(plain) if lenient else plain


def counter_block(iv: Column, i: Column) -> Column:
    """The 16-byte counter ``iv + i``; an IV of 8 bytes is the upper half."""
    whole = F.rpad(F.hex(iv), 32, "0")
    half = lambda at: F.conv(F.substring(whole, at, 16), 16, 10).cast("decimal(21,0)")
    limit = F.lit(str(2**64)).cast("decimal(21,0)")
    low = half(17) + i.cast("decimal(21,0)")
    carry = (low >= limit).cast("int").cast("decimal(21,0)")
    text = lambda x: F.lpad(F.conv((x % limit).cast("decimal(20,0)").cast("string"), 10, 16), 16, "0")
    return F.unhex(F.concat(text(half(1) + carry), text(low)))


@F.arrow_udf(T.BinaryType())
def _counters(data: pa.Array, n: pa.Array, iv: pa.Array) -> pa.Array:
    """The counter blocks ``iv``, ``iv + 1`` and so on, for all bytes of ``data``, or
    for ``n`` bytes where it is null."""
    whole, starts = _valid(data), _bytes(data)[1]
    size = np.where(whole, np.diff(starts), n.fill_null(0).to_numpy(zero_copy_only=False))
    valid = _valid(iv) & (whole | _valid(n))
    blocks = np.where(valid, np.maximum(-(-size // 16), 1), 0).astype(np.int64)
    to = np.concatenate([[0], np.cumsum(blocks)])
    out = np.empty((to[-1], 2), ">u8")
    first = np.frombuffer(b"".join((x or b"").ljust(16, b"\0")[:16] for x in iv.to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
    for i in np.flatnonzero(valid).tolist():
        block, (high, low) = out[to[i] : to[i + 1]], first[i]
        count = np.arange(len(block), dtype=np.uint64) + low
        block[:, 1] = count
        block[:, 0] = (count < low).astype(np.uint64) + high
    return _binary(out.reshape(-1).view(np.uint8), to * 16, valid)


def _encrypted(counters: Column, key: Column) -> Column:
    return F.aes_encrypt(counters, key, F.lit("ECB"), F.lit("PKCS"))


def key_stream(n: Column, key: Column, iv: Column) -> Column:
    """At least ``n`` bytes of AES-CTR key stream: all counters encrypted at once."""
    return _encrypted(_counters(F.lit(None).cast("binary"), n, iv), key)


def aes_ctr(data: Column, key: Column, iv: Column) -> Column:
    """AES-CTR of any length."""
    return xor(data, _encrypted(_counters(data, F.lit(None).cast("long"), iv), key))


@F.arrow_udf(T.BinaryType())
def _sealed(data: pa.Array, stream: pa.Array, subsamples: pa.Array) -> pa.Array:
    """Bytes of the data with those of the stream: in the encrypted ranges, one after
    the other, or in the whole where there are no ranges."""
    (x, at), (y, st), valid = _bytes(data), _bytes(stream), _valid(data, stream)
    out = x[at[0] : at[-1]].copy()
    ends, ranges = (at - at[0]).tolist(), subsamples.to_pylist()
    for i in np.flatnonzero(valid).tolist():
        part, key = out[ends[i] : ends[i + 1]], y[st[i] : st[i + 1]]
        if not ranges[i]:
            part ^= key[: len(part)]
            continue
        place = used = 0
        for r in ranges[i]:
            place += r["clear"]
            span = part[place : place + r["encrypted"]]
            span ^= key[used : used + len(span)]
            place, used = place + r["encrypted"], used + r["encrypted"]
    return _binary(out, at - at[0], valid)


def cenc(data: Column, key: Column, iv: Column, subsamples: Column | None = None) -> Column:
    """Common encryption in counter mode: the whole sample, or the encrypted ranges
    of ``subsamples`` (``clear``, ``encrypted`` sizes) as one stream. The key stream
    is made as long as what is encrypted."""
    if subsamples is None:
        return aes_ctr(data, key, iv)
    total = F.aggregate(subsamples, F.lit(0).cast("long"), lambda n, x: n + x["encrypted"])
    n = F.least(total, F.octet_length(data).cast("long"))
    whole = F.when(F.size(subsamples) > 0, F.lit(None).cast("binary")).otherwise(data)
    return _sealed(data, _encrypted(_counters(whole, n, iv), key), subsamples)


def _quarter(x, a, b, c, d):
    for p, q, r, n in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
        x[p] += x[q]
        x[r] ^= x[p]
        x[r] = (x[r] << np.uint32(n)) | (x[r] >> np.uint32(32 - n))


def _rounds(x: np.ndarray) -> None:
    for _ in range(10):
        for i in range(4):
            _quarter(x, i, 4 + i, 8 + i, 12 + i)
        for i in range(4):
            _quarter(x, i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4)


_SIGMA = np.frombuffer(b"expand 32-byte k", np.uint32)


def _chacha20_rows(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, nonces: np.ndarray, counter: int = 0) -> np.ndarray:
    """All rows' bytes with the streams of their keys (8 words) and nonces (3 words)."""
    size = np.diff(offsets)
    upto = np.concatenate([[0], np.cumsum(-(-size // 64))])
    data = data[offsets[0] : offsets[-1]]
    out = np.empty(len(data), np.uint8)
    done = 0
    for lo in range(0, int(upto[-1]), BLOCKS):
        block = np.arange(lo, min(lo + BLOCKS, int(upto[-1])))
        row = np.searchsorted(upto, block, "right") - 1
        no = block - upto[row]
        start = np.empty((16, len(block)), np.uint32)
        start[:4], start[4:12], start[13:] = _SIGMA[:, None], keys[row].T, nonces[row].T
        start[12] = (no + counter).astype(np.uint32)
        x = start.copy()
        _rounds(x)
        x += start
        stream = np.ascontiguousarray(x.T).astype("<u4", copy=False).view(np.uint8)
        stream = stream[np.arange(64) < (size[row] - 64 * no)[:, None]]
        out[done : done + len(stream)] = data[done : done + len(stream)] ^ stream
        done += len(stream)
    return out


def _short(keys: np.ndarray, nonces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and nonces of ChaCha20 for those of XChaCha20 (6 words)."""
    x = np.concatenate([np.repeat(_SIGMA[None], len(keys), 0), keys, nonces[:, :4]], axis=1).T.astype(np.uint32)
    x = np.ascontiguousarray(x)
    _rounds(x)
    return np.concatenate([x[:4], x[12:]]).T, np.concatenate([np.zeros((len(keys), 1), np.uint32), nonces[:, 4:]], axis=1)


def chacha20_bytes(data: bytes, key: bytes, nonce: bytes, counter: int = 0) -> bytes:
    """ChaCha20 with a 12-byte nonce, XChaCha20 with one of 24 (RFC 8439 and its
    extension)."""
    if len(key) != 32 or len(nonce) not in (12, 24):
        raise ValueError("a key of 32 bytes and a nonce of 12 or 24 are needed")
    words, rest = np.frombuffer(key, "<u4")[None], np.frombuffer(nonce, "<u4")[None]
    if len(nonce) == 24:
        words, rest = _short(words, rest)
    return _chacha20_rows(np.frombuffer(data, np.uint8), np.array([0, len(data)]), words, rest, counter).tobytes()


@F.arrow_udf(T.BinaryType())
def _chacha20(data: pa.Array, key: pa.Array, nonce: pa.Array) -> pa.Array:
    k, v = ([x or b"" for x in c.to_pylist()] for c in (key, nonce))
    fits = np.array([len(a) == 32 and len(b) in (12, 24) for a, b in zip(k, v, strict=True)], bool)
    words, rest = np.zeros((len(k), 8), np.uint32), np.zeros((len(k), 3), np.uint32)
    for n in (12, 24):
        at = [i for i in np.flatnonzero(fits).tolist() if len(v[i]) == n]
        if at:
            w = np.frombuffer(b"".join(k[i] for i in at), "<u4").reshape(-1, 8)
            r = np.frombuffer(b"".join(v[i] for i in at), "<u4").reshape(-1, n // 4)
            words[at], rest[at] = (w, r) if n == 12 else _short(w, r)
    x, at = _bytes(data)
    return _binary(_chacha20_rows(x, at, words, rest), at - at[0], _valid(data) & fits)


def chacha20(data: Column, key: Column, nonce: Column) -> Column:
    """ChaCha20 or XChaCha20 by the nonce's length; null for other sizes."""
    return _chacha20(data, key, nonce)


def decrypted(data: Column, method: Column, key: Column, iv: Column) -> Column:
    """A segment's plain bytes by its method; null for one without support."""
    return (
        F.when(method.isNull() | method.isin("", "NONE"), data)
        .when(method == "AES-128", aes_cbc(data, key, iv))
        .when(method == "AES-128-ECB", aes_ecb(data, key))
        .when(method == "CHACHA20", chacha20(data, key, iv))
    )
