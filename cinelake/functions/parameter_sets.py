"""Dimensions from H.264 and HEVC sequence parameter sets, as Arrow UDFs.

Fields follow the published syntax of both standards; Exp-Golomb codes are read
from a string of bits after emulation prevention bytes are taken out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Profiles of H.264 with chroma fields.
HIGH_PROFILES = frozenset((100, 110, 122, 244, 44, 83, 86, 118, 128, 138, 139, 134, 135))


def unescaped(data: bytes) -> bytes:
    """Without the 3 of each 0 0 3."""
    out, zeros = bytearray(), 0
    for b in data:
        if zeros >= 2 and b == 3:
            zeros = 0
            continue
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(out)


class Bits:
    """Bits read from the left; EOFError beyond the end."""

    def __init__(self, data: bytes):
        self.text, self.at = "".join(f"{b:08b}" for b in data), 0

    def u(self, n: int) -> int:
        if self.at + n > len(self.text):
            raise EOFError
        self.at += n
        return int(self.text[self.at - n : self.at] or "0", 2)

    def ue(self) -> int:
        zeros = self.text.find("1", self.at) - self.at
        if zeros < 0:
            raise EOFError
        self.at += zeros
        return self.u(zeros + 1) - 1

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k % 2 else -(k // 2)


def _scaling(b: Bits, n: int) -> None:
    last = following = 8
    for _ in range(n):
        if following:
            following = (last + b.se()) % 256
        last = following or last


def avc_size(sps: bytes) -> tuple[int, int]:
    """Width and height of an H.264 set, its NAL header included."""
    b = Bits(unescaped(sps[1:]))
    profile = b.u(8)
    b.u(16)
    b.ue()
    chroma, separate = 1, 0
    if profile in HIGH_PROFILES:
        chroma = b.ue()
        separate = b.u(1) if chroma == 3 else 0
        b.ue(), b.ue(), b.u(1)
        if b.u(1):
            for i in range(12 if chroma == 3 else 8):
                if b.u(1):
                    _scaling(b, 16 if i < 6 else 64)
    b.ue()
    order = b.ue()
    if order == 0:
        b.ue()
    elif order == 1:
        b.u(1), b.se(), b.se()
        for _ in range(b.ue()):
            b.se()
    b.ue(), b.u(1)
    width, units = (b.ue() + 1) * 16, b.ue() + 1
    frames = b.u(1)
    if not frames:
        b.u(1)
    b.u(1)
    height = units * 16 * (2 - frames)
    if b.u(1):
        left, right, top, bottom = b.ue(), b.ue(), b.ue(), b.ue()
        flat = chroma == 0 or separate
        x = 1 if flat or chroma == 3 else 2
        y = (1 if flat or chroma != 1 else 2) * (2 - frames)
        width, height = width - x * (left + right), height - y * (top + bottom)
    return width, height


def hevc_size(sps: bytes) -> tuple[int, int]:
    """Width and height of an HEVC set, its NAL header included."""
    b = Bits(unescaped(sps[2:]))
    b.u(4)
    layers = b.u(3)
    b.u(1)
    b.u(88), b.u(8)
    flags = [(b.u(1), b.u(1)) for _ in range(layers)]
    if layers:
        b.u(2 * (8 - layers))
    for profile, level in flags:
        b.u(88 * profile), b.u(8 * level)
    b.ue()
    chroma = b.ue()
    if chroma == 3:
        b.u(1)
    width, height = b.ue(), b.ue()
    if b.u(1):
        left, right, top, bottom = b.ue(), b.ue(), b.ue(), b.ue()
        width -= (2 if chroma in (1, 2) else 1) * (left + right)
        height -= (2 if chroma == 1 else 1) * (top + bottom)
    return width, height


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def dimensions(sps: pd.Series, codec: pd.Series) -> pd.DataFrame:
    """Width and height of sets by codec, ``h264`` or ``hevc``; null if unreadable."""

    def one(data, kind):
        try:
            return avc_size(data) if kind == "h264" else hevc_size(data) if kind == "hevc" else (None, None)
        except (EOFError, TypeError, IndexError):
            return None, None

    return pd.DataFrame([one(*x) for x in zip(sps, codec, strict=True)], columns=["width", "height"]).astype("Int32")
