"""Binary fields: big-endian numbers, packet and frame headers, packed times.

Positions count bytes from 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sampling rates by the four-bit index of an ADTS header.
SAMPLE_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)


def take(body: Column, at: int | Column, n: int | Column) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    n = F.lit(n) if isinstance(n, int) else n
    return F.substring(body, at.cast("int") + 1, n.cast("int"))


def uint(body: Column, at: int | Column, n: int) -> Column:
    """An unsigned number of up to 7 bytes (8: as it fits a bigint), null beyond the end."""
    raw = take(body, at, n)
    return F.when(F.octet_length(raw) == n, F.conv(F.hex(raw), 16, 10).cast("decimal(20,0)").cast("bigint"))


def text4(body: Column, at: int | Column) -> Column:
    """Four bytes as a box type or handler name."""
    return F.decode(take(body, at, 4), "ISO-8859-1")


def fixed16(body: Column, at: int | Column) -> Column:
    """The whole part of a 16.16 number."""
    return F.shiftright(uint(body, at, 4), 16)


def pack_pts(pts: Column, marker: int = 2) -> Column:
    """33 bits of a time in five bytes, with marker bits."""
    p = pts.cast("bigint")
    b = [
        F.lit(marker << 4).bitwiseOR(F.shiftleft(F.shiftright(p, 30).bitwiseAND(F.lit(7)), 1)).bitwiseOR(F.lit(1)),
        F.shiftright(p, 22).bitwiseAND(F.lit(255)),
        F.shiftleft(F.shiftright(p, 15).bitwiseAND(F.lit(127)), 1).bitwiseOR(F.lit(1)),
        F.shiftright(p, 7).bitwiseAND(F.lit(255)),
        F.shiftleft(p.bitwiseAND(F.lit(127)), 1).bitwiseOR(F.lit(1)),
    ]
    return F.unhex(F.concat(*(F.lpad(F.hex(x), 2, "0") for x in b)))


def unpack_pts(body: Column, at: int | Column = 0) -> Column:
    """The time in five bytes."""
    at = F.lit(at) if isinstance(at, int) else at
    b = [uint(body, at + i, 1) for i in range(5)]
    high = F.shiftleft(F.shiftright(b[0], 1).bitwiseAND(F.lit(7)).cast("bigint"), 30)
    mid = F.shiftleft(b[1], 22).bitwiseOR(F.shiftleft(F.shiftright(b[2], 1), 15))
    return high.bitwiseOR(mid).bitwiseOR(F.shiftleft(b[3], 7)).bitwiseOR(F.shiftright(b[4], 1))


def ts_header(packet: Column) -> Column:
    """Fields of a 188-byte transport packet: sync, pid, pusi, adaptation, counter,
    and where its payload starts."""
    b1, b2, b3 = (uint(packet, i, 1) for i in (1, 2, 3))
    adaptation = F.shiftright(b3, 4).bitwiseAND(F.lit(3))
    start = F.when(adaptation >= 2, 5 + F.coalesce(uint(packet, 4, 1), F.lit(0))).otherwise(4)
    return F.struct(
        (uint(packet, 0, 1) == 0x47).alias("sync"),
        F.shiftleft(b1.bitwiseAND(F.lit(31)), 8).bitwiseOR(b2).cast("int").alias("pid"),
        (b1.bitwiseAND(F.lit(64)) != 0).alias("pusi"),
        adaptation.cast("int").alias("adaptation"),
        b3.bitwiseAND(F.lit(15)).cast("int").alias("counter"),
        start.cast("int").alias("payload_at"),
    )


def adts_header(frame: Column) -> Column:
    """Fields of an ADTS header; null where there is no sync word."""
    b = [uint(frame, i, 1) for i in range(6)]
    size = F.shiftleft(b[3].bitwiseAND(F.lit(3)), 11).bitwiseOR(F.shiftleft(b[4], 3)).bitwiseOR(F.shiftright(b[5], 5))
    index = F.shiftright(b[2], 2).bitwiseAND(F.lit(15))
    rates = F.array(*map(F.lit, SAMPLE_RATES))
    return F.when(
        (b[0] == 0xFF) & (b[1].bitwiseAND(F.lit(0xF0)) == 0xF0),
        F.struct(
            (F.shiftright(b[2], 6) + 1).cast("int").alias("object_type"),
            F.get(rates, index.cast("int")).alias("sample_rate"),
            F.shiftleft(b[2].bitwiseAND(F.lit(1)), 2).bitwiseOR(F.shiftright(b[3], 6)).cast("int").alias("channels"),
            F.when(b[1].bitwiseAND(F.lit(1)) == 1, 7).otherwise(9).alias("header_size"),
            size.cast("int").alias("frame_size"),
        ),
    )


def aac_frame_duration(rate: Column, timescale: int = 90000) -> Column:
    """Time units of an AAC frame of 1024 samples."""
    return F.when(rate > 0, F.floor(F.lit(1024 * timescale) / rate).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def packed_language(body: Column, at: int | Column) -> Column:
    """Three letters of five bits each."""
    v = uint(body, at, 2)
    letter = lambda shift: F.chr(F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 0x60)
    return F.concat(letter(10), letter(5), letter(0))


def big_endian16(number: Column) -> Column:
    """A number as 16 bytes."""
    return F.unhex(F.lpad(F.hex(number.cast("bigint")), 32, "0"))


def segment_format(data: Column) -> Column:
    """``ts`` or ``fmp4`` by the first bytes, else ``unknown``."""
    later = F.exists(F.sequence(F.lit(0), F.lit(187)), lambda i: (take(data, i, 1) == F.lit(b"\x47")) & (take(data, i + 188, 1) == F.lit(b"\x47")))
    return (
        F.when(data.isNull() | (F.octet_length(data) == 0), "unknown")
        .when(take(data, 0, 1) == F.lit(b"\x47"), "ts")
        .when(text4(data, 4).isin("ftyp", "moof", "moov", "styp", "sidx"), "fmp4")
        .when(later, "ts")
        .otherwise("unknown")
    )


def looks_like_ts(data: Column) -> Column:
    """The looser test: a sync byte among the first sixteen."""
    return F.instr(F.hex(take(data, 0, 16)), "47") % 2 == 1


def is_key_frame(codec: Column, nal_header: Column) -> Column:
    """Whether a NAL unit starts a random access point; audio always does."""
    h264 = nal_header.bitwiseAND(F.lit(31)) == 5
    hevc = F.shiftright(nal_header, 1).bitwiseAND(F.lit(63)).isin(19, 20)
    return F.when(codec == "h264", h264).when(codec == "hevc", hevc).otherwise(F.lit(True))
