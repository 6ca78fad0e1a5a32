"""Repetition coverage: characters inside duplicated n-grams and lines.

For every text the words are hashed, windows of several lengths are rolled over
them in numpy, and the characters that lie in windows found twice or more (the
first included) or in lines that repeat are measured against all word
characters. A text is rejected by the base rule (too short, or over a fifth of
its words in repeated five-word windows) or when a coverage is over its limit.

Defined results: a null or empty text has no words and is rejected; ties and
repeated rows are judged alike, each on its own; an empty table gives an empty
table; other columns are passed on and clashing names get a trailing underscore.
The operator is narrow: no shuffle, one Arrow batch at a time, whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import byte_view, chunks, fresh, lean, per_row
from ._words import SPACED, U, hash_spans, mix, rows_of, spans, table, windows

SYMBOLS = table(*b"#*$%&|<>")
NOT_NEWLINE = ~table(0x0A)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class RepetitionRules:
    """Limits; a coverage is a share of a text's word characters."""

    min_words: int = 10
    window: int = 5
    max_repeat_words_pct: int = 20
    max_ngram_cover: dict[int, float] = field(default_factory=lambda: {6: 0.20, 8: 0.20, 10: 0.20})
    max_line_cover: float = 0.30


def _covered(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Words that lie in an n-word window found twice or more in its text."""
    out = np.zeros(len(h), bool)
    w = windows(h, n)
    if len(w):
        whole = row[: len(w)] == row[n - 1 :]
        key = mix(w + row[: len(w)].astype(U) * U(0x9E3779B97F4A7C15))
        dup = np.zeros(len(w), bool)
        dup[whole] = pd.Series(key[whole]).duplicated(keep=False).to_numpy()
        for k in range(n):
            out[k : k + len(w)] |= dup
    return out


def measure(data: np.ndarray, offsets: np.ndarray, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """Counts and coverages of each row of one piece of a batch."""
    n = len(offsets) - 1
    lead = (data & 0xC0) != 0x80
    starts, ends = spans(data, offsets, SPACED)
    row = rows_of(starts, offsets)
    h = hash_spans(data, starts, ends)
    count = lambda at, by=None: np.bincount(at, by, minlength=n)
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=total[1:])
    chars = total[ends] - total[starts]
    out = {
        "n_words": count(row),
        "word_chars": per_row(lead & SPACED[data], offsets),
        "n_symbols": per_row(SYMBOLS[data], offsets),
        "n_repeat_words": count(row[_covered(h, row, rules.window)]),
    }
    all_chars = np.maximum(out["word_chars"], 1)
    for k in rules.max_ngram_cover:
        at = _covered(h, row, k)
        out[f"cover_{k}"] = count(row[at], chars[at]) / all_chars

    ls, le = spans(data, offsets, NOT_NEWLINE)
    upto = np.searchsorted(starts, le, "left")
    first = np.searchsorted(starts, ls, "left")
    some = upto > first
    ls, le, upto, first = ls[some], le[some], upto[some], first[some]
    lrow = rows_of(ls, offsets)
    key = pd.Series(mix(hash_spans(data, ls, le) + lrow.astype(U) * U(0x9E3779B97F4A7C15)))
    out["n_dup_lines"] = count(lrow[key.duplicated().to_numpy(bool)])
    sums = np.concatenate([[0], np.cumsum(chars)])
    twice = key.duplicated(keep=False).to_numpy(bool)
    out["cover_lines"] = count(lrow[twice], (sums[upto] - sums[first])[twice]) / all_chars
    return out


def _judge(m: dict[str, np.ndarray], rules: RepetitionRules) -> tuple[np.ndarray, np.ndarray]:
    failed = (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_words_pct * m["n_words"])
    bad = failed | (m["cover_lines"] > rules.max_line_cover)
    for k, limit in rules.max_ngram_cover.items():
        bad |= m[f"cover_{k}"] > limit
    return failed, ~bad


def repetition_quality(docs: DataFrame, text_col: str = "text", rules: RepetitionRules | None = None) -> DataFrame:
    """``docs`` with the counts, coverages, ``base_failed`` and ``kept``."""
    rules = rules or RepetitionRules()
    covers = [*(f"cover_{k}" for k in rules.max_ngram_cover), "cover_lines"]
    wanted = [*MEASURES, *covers, "base_failed", "kept"]
    names = fresh(docs, *wanted)
    kinds = [T.LongType()] * len(MEASURES) + [T.DoubleType()] * len(covers) + [T.BooleanType()] * 2
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            data, offsets = byte_view(batch.column(at))
            for lo, hi in chunks(offsets):
                part = offsets[lo : hi + 1]
                m = measure(data[part[0] : part[-1]], part - part[0], rules)
                m["base_failed"], m["kept"] = _judge(m, rules)
                new = [pa.array(m[c].astype(np.int64)) for c in MEASURES]
                new += [pa.array(m[c].astype(np.float64)) for c in covers]
                new += [pa.array(m[c]) for c in ("base_failed", "kept")]
                old = [c.slice(lo, hi - lo) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*old, *new], names=[*batch.schema.names, *names])

    return docs.mapInArrow(lean(run), schema)


def keep_good(docs: DataFrame, text_col: str = "text", rules: RepetitionRules | None = None) -> DataFrame:
    """Only the rows of ``docs`` that the rules keep, with their own columns."""
    judged = repetition_quality(docs, text_col, rules)
    return judged.filter(F.col(f"`{judged.columns[-1]}`")).select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repetition_quality(docs).drop("text")
