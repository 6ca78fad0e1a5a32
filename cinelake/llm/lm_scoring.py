"""LM scoring: cross-entropy difference of matched n-gram models.

A target model (documents chosen by labels) and a background model (all
documents) share vocabulary, order, smoothing and the inventory of word pairs.
Both are bigram models with Dirichlet smoothing towards unigrams:

    p(w | h) = (c(h, w) + mu p(w)) / (c(h) + mu),  p(w) = (c(w) + a) / (N + a V)

with rare words as one class and the ends of texts as a word. A document's score
is the mean over its tokens of the target's loss less the background's. The
log-ratio of the two models then falls apart into a weight for each word (as the
word predicted and as the context of the next) and a correction for each word
pair of the inventory, so that a document's score is a sum of looked-up weights.

Counts cover all documents and grow with them: each task sends one row for each
distinct pair of a few million tokens, and counts are summed after one shuffle.
Words and pairs with fewer than ``min_count`` occurrences are not in the model
(words are then one class of rare ones); the limit is the same at any size of
corpus, so the model grows with its input, and with 1 all that occurs is in it.
The weights are broadcast while they are at most ``MODEL_ROWS`` (128 MB); a larger
model is joined with each document's distinct features instead. Both ways give
the same scores.

Defined results: words are runs of letters and digits of any script, A-Z folded;
a null text or one without words has 0 tokens and a null score; repeated rows
count and are scored alike; without target documents the target model is uniform
up to smoothing; a label row counts once for a document id however often it is
there; an empty table gives no rows; equal counts weigh alike, so there are no
ties to break; very long texts are scored whole; columns of any other name pass
through ``with_target``, where a column ``target`` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import byte_view, chunks, fresh, marks, may_hold, partitions, staged
from ._words import ALNUM, FOLD, U, hash_spans, mix, rows_of, spans

MIN_COUNT = 5
MU, ALPHA = 100.0, 1.0
MODEL_ROWS = 8_000_000
#: Tokens counted together before their rows are sent.
TOKENS = 4_000_000
#: They are counted in 2**SLICE_BITS slices of their keys, one after the other, which
#: are told apart for PIECE tokens at a time.
SLICE_BITS, PIECE = 3, 1 << 19

EDGE = U(0x5851F42D4C957F2D)  # the end of a text, and what precedes its first word
LOW40 = U((1 << 40) - 1)
PAIRS = "word long, before long, n long, nt long"
FEATURES = "row long, key long, is_word boolean, n long"
SCORES = "doc_id long, n_tokens long, ce_difference double"


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, with an edge after each row's last word; rows of them.
    Rows without words have none."""
    s, e = spans(data, offsets, ALNUM)
    h, row = hash_spans(data, s, e, FOLD), rows_of(s, offsets)
    last = np.flatnonzero(np.diff(row, append=-1))
    return np.insert(h, last + 1, EDGE), np.insert(row, last + 1, row[last])


def _before(h: np.ndarray) -> np.ndarray:
    """Short hash of what precedes each token; an edge before the first of a row."""
    return np.concatenate([[EDGE], h[:-1]]) & LOW40


def pair_key(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mix(word.astype(U) * U(0xD1342543DE82EF95) + before.astype(U))


def count_pairs(docs: DataFrame, text_col: str, target_col: str) -> DataFrame:
    """Partial counts of words (``before`` null) and word pairs: ``PAIRS``; ``nt``
    counts the target's."""
    rows = docs.select(F.col(text_col), F.coalesce(F.col(target_col), F.lit(False)).alias("t"))

    def counted(h, b, t, alone):
        code, _ = pd.factorize(h if alone else pair_key(h, b))
        n, nt = np.bincount(code), np.bincount(code[t], minlength=int(code.max(initial=-1)) + 1)
        at = np.empty(len(n), np.int64)
        at[code] = np.arange(len(code))
        before = pa.array(b[at].astype(np.int64), mask=np.full(len(n), alone))
        return pa.RecordBatch.from_arrays([pa.array(h[at].astype(np.int64)), before, pa.array(n), pa.array(nt)], names=["word", "before", "n", "nt"])

    def run(batches):
        held: list = []
        size = 0

        def flush():
            """Counts of what is held, a slice of the keys at a time: equal keys are in
            the same slice, so rows are as few and tables of keys a slice's size."""
            h, t = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            held.clear()
            before = lambda at: h[at - 1] & LOW40  # noqa: E731 (each row ends with an edge, and so do all)
            for alone in (True, False):
                lot = np.empty(len(h), np.uint8)
                for lo in range(0, len(h), PIECE):
                    at = np.arange(lo, min(lo + PIECE, len(h)))
                    lot[at] = (h[at] if alone else pair_key(h[at], before(at))) >> U(64 - SLICE_BITS)
                for k in range(1 << SLICE_BITS):
                    at = np.flatnonzero(lot == k)
                    if len(at):
                        yield counted(h[at], before(at), t[at], alone)

        for batch in batches:
            data, offsets = byte_view(batch.column(0))
            target = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in chunks(offsets):
                part = offsets[lo : hi + 1]
                h, row = _tokens(data[part[0] : part[-1]], part - part[0])
                held.append((h, target[lo:hi][row]))
                size += len(h)
                if size >= TOKENS:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    return rows.mapInArrow(run, PAIRS)


@dataclass(frozen=True)
class Model:
    """``weights`` (``key``, ``weight``; staged) and the constants."""

    weights: DataFrame
    rows: int
    unknown: float


def train(docs: DataFrame, text_col: str = "text", target_col: str = "target", min_count: int = MIN_COUNT) -> Model:
    """Weights of the log-ratio target : background."""
    spark = docs.sparkSession
    counts = count_pairs(docs, text_col, target_col).repartition(partitions(spark), "word", "before")
    counts = counts.groupBy("word", "before").agg(F.sum("n").alias("n"), F.sum("nt").alias("nt"))
    counts = staged(counts.filter(F.col("before").isNull() | (F.col("n") >= min_count)), "counts")
    words, often = counts.filter("before is null").drop("before"), counts.filter("before is not null")
    edge = int(np.array([EDGE]).astype(np.int64)[0])
    known = (F.col("n") >= min_count) | (F.col("word") == edge)
    words = words.withColumn("known", known)
    total = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("nt"), F.lit(0)).alias("nt"),
        F.coalesce(F.sum(F.when(~F.col("known"), F.col("n"))), F.lit(0)).alias("un"), F.coalesce(F.sum(F.when(~F.col("known"), F.col("nt"))), F.lit(0)).alias("unt"),
        F.count(F.when(F.col("known"), 1)).alias("v"),
    ).first()
    v = total.v + 1  # and the class of rare words

    def p(c, n):
        return (c + ALPHA) / (n + ALPHA * v)

    def word_weight(n, nt, log):
        return log(p(nt, total.nt)) - log(p(n, total.n)) - log(nt + MU) + log(n + MU)

    w = words.filter("known").select(F.col("word").alias("key"), word_weight(F.col("n"), F.col("nt"), F.log).alias("weight"))
    often = often.join(words.filter("known").select("word", F.col("n").alias("wn"), F.col("nt").alias("wnt")), "word")
    correction = F.log(1 + F.col("nt") / (MU * p(F.col("wnt"), total.nt))) - F.log(1 + F.col("n") / (MU * p(F.col("wn"), total.n)))

    def keyed(batches):
        for b in batches:
            key = pair_key(b.column(0).to_numpy(), b.column(1).to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), b.column(2)], names=["key", "weight"])

    w = staged(w.unionByName(often.select("word", "before", correction.alias("weight")).mapInArrow(keyed, "key long, weight double")), "weights")
    return Model(w, w.count(), float(word_weight(total.un, total.unt, np.log)))


def _features(data: np.ndarray, offsets: np.ndarray):
    """Token rows and hashes, and pair keys, of one piece of a batch."""
    h, row = _tokens(data, offsets)
    return h, row, pair_key(h, _before(h))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", most: int = MODEL_ROWS) -> DataFrame:
    """``SCORES``: below 0, a text is more like the target than the background.

    The edge is the last token of a text and the context of the first, so every
    token is predicted once and is a context once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    if model.rows > most:
        return _score_by_join(rows, model)
    table = model.weights.toArrow()
    key = table.column(0).to_numpy().view(U)
    order = np.argsort(key)
    given = spark.sparkContext.broadcast((key[order], table.column(1).to_numpy()[order], model.unknown))

    def run(batches):
        keys, weights, unknown = given.value

        def weight(k, other):
            code, distinct = pd.factorize(k)
            at = np.minimum(np.searchsorted(keys, distinct), max(len(keys) - 1, 0))
            found = keys[at] == distinct if len(keys) else np.zeros(len(distinct), bool)
            return np.where(found, weights[at] if len(keys) else 0.0, other)[code]

        for batch in batches:
            data, offsets = byte_view(batch.column(1))
            total, count = [], []
            for lo, hi in chunks(offsets):
                part = offsets[lo : hi + 1]
                h, row, pair = _features(data[part[0] : part[-1]], part - part[0])
                w = weight(h, unknown) + weight(pair, 0.0)
                count.append(np.bincount(row, minlength=hi - lo))
                total.append(np.bincount(row, w, minlength=hi - lo))
            n, s = (np.concatenate(x) if x else np.empty(0) for x in (count, total))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.maximum(n - 1, 0).astype(np.int64)), pa.array(-s / np.maximum(n, 1), mask=n == 0)], names=["doc_id", "n_tokens", "ce_difference"]
            )

    return rows.mapInArrow(run, SCORES)


def _score_by_join(rows: DataFrame, model: Model) -> DataFrame:
    """The same, for a model of any size: distinct features of each document join
    the weights. Rows are numbered in a staged copy, so repeated ones stay apart."""
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "scored")

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = byte_view(batch.column(1))
            for lo, hi in chunks(offsets):
                part = offsets[lo : hi + 1]
                h, row, pair = _features(data[part[0] : part[-1]], part - part[0])
                for key, is_word in ((h, True), (pair, False)):
                    code, _ = pd.factorize(mix(key + row.astype(U) * U(0x9E3779B97F4A7C15)))
                    n = np.bincount(code)
                    at = np.empty(len(n), np.int64)
                    at[code] = np.arange(len(code))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[lo:hi][row[at]]), pa.array(key[at].astype(np.int64)), pa.array(np.full(len(n), is_word)), pa.array(n.astype(np.int64))],
                        names=["row", "key", "is_word", "n"],
                    )

    features = rows.select("row", "text").mapInArrow(run, FEATURES)
    weight = F.coalesce("weight", F.when(F.col("is_word"), F.lit(model.unknown)).otherwise(F.lit(0.0)))
    sums = features.join(model.weights, "key", "left").groupBy("row").agg(F.sum(F.when(F.col("is_word"), F.col("n"))).alias("n"), F.sum(weight * F.col("n")).alias("s"))
    return rows.select("row", "doc_id").join(sums, "row", "left").select(
        "doc_id", F.greatest(F.coalesce(F.col("n") - 1, F.lit(0)), F.lit(0)).alias("n_tokens"), (-F.col("s") / F.col("n")).alias("ce_difference")
    )


def with_target(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``target``: whether the id is in ``chosen``. A bitmap of fixed
    size spares most others the shuffle."""
    docs = docs.drop("target")
    other, maybe = fresh(docs, "chosen_id", "maybe")
    ids = staged(chosen.select(F.col(f"`{id_col}`").cast("long").alias(other)).filter(F.col(other).isNotNull()).distinct(), "chosen")
    given = docs.sparkSession.sparkContext.broadcast(marks(ids, other))
    own = F.col(f"`{id_col}`").cast("long")
    rows = docs.withColumn(maybe, may_hold(given)(F.coalesce(own, F.lit(-1))))
    some = rows.filter(F.col(maybe)).join(ids, own == F.col(other), "left").withColumn("target", F.col(other).isNotNull())
    rest = rows.filter(~F.col(maybe)).withColumn("target", F.lit(False))
    names = [f"`{c}`" for c in [*docs.columns, "target"]]
    return rest.select(*names).unionByName(some.select(*names))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as good and not toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    chosen = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 and toxic = 0")
    model = train(with_target(docs, chosen))
    return score(docs, model).withColumn("ce_difference", F.round("ce_difference", 6))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) AS t,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
k AS (
  SELECT doc_id, t, unnest(list_append(w, '')) AS w, unnest(list_prepend('', w)) AS h FROM d WHERE len(w) > 0),
pair AS (SELECT h, w, count(*)::DOUBLE AS n, count(*) FILTER (t)::DOUBLE AS nt FROM k GROUP BY ALL),
word AS (SELECT w, sum(n) AS n, sum(nt) AS nt, sum(n) >= 5 OR w = '' AS known FROM pair GROUP BY w),
tot AS (
  SELECT sum(n) AS n, sum(nt) AS nt, coalesce(sum(n) FILTER (NOT known), 0) AS un, coalesce(sum(nt) FILTER (NOT known), 0) AS unt,
         count(*) FILTER (known) + 1 AS v FROM word),
ww AS (
  SELECT w, known, CASE WHEN known THEN word.n ELSE un END AS c, CASE WHEN known THEN word.nt ELSE unt END AS ct, tot.n AS tn, tot.nt AS tnt, v FROM word, tot),
wt AS (
  SELECT w, known, (ct + 1) / (tnt + v) AS pt, (c + 1) / (tn + v) AS pb,
         ln((ct + 1) / (tnt + v)) - ln((c + 1) / (tn + v)) - ln(ct + 100) + ln(c + 100) AS weight FROM ww),
pt AS (
  SELECT h, w, ln(1 + nt / (100 * pt)) - ln(1 + n / (100 * pb)) AS fix FROM pair JOIN wt USING (w) WHERE n >= 5 AND known),
s AS (
  SELECT doc_id, count(*) - 1 AS n_tokens, -sum(weight + coalesce(fix, 0)) / count(*) AS x
  FROM k JOIN wt USING (w) LEFT JOIN pt USING (h, w) GROUP BY doc_id)
SELECT doc_id, coalesce(n_tokens, 0)::BIGINT AS n_tokens, round(x, 6) AS ce_difference FROM d LEFT JOIN s USING (doc_id)
"""
