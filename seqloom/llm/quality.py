"""Operator 3, quality classifier: random Fourier features of document statistics.

Statistics of each whole text are standardised by their mean and spread over all
documents, mapped to `N_FEATURES` cosines that approximate a Gaussian kernel, and
scored by ridge regression. The normal equations are summed by task, then by matrix
row, so that only (N_FEATURES + 1)**2 numbers reach the driver. A monotone step
function, fitted by pooling adjacent violators on a histogram of the scores of the
labelled rows, turns them into a probability.

Only rows with crc32(doc_id as text) mod 3 other than 1 are learned from. Inputs of
the score are statistics of the text alone.

Defined cases: null text is the empty text, and is scored; null labels are not
learned from; several labels of one doc_id count as their mean; a null doc_id has no
label and held_out false; without usable labels every score is 0.5; repeated rows get
equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, saved, text_or_empty

N_FEATURES = 256
#: Width of the kernel in standardised units, times the root of the number of statistics.
KERNEL_WIDTH = 0.7
RIDGE = 1.0
SEED = 17
#: Bins of the score histogram that calibration is fitted on.
N_BINS = 2000
FOLDS, HELD_OUT = 3, 1
#: Tasks whose sums are added up together before those of all tasks are.
TASKS_SUMMED = 500

STATISTICS = (
    "log_chars", "log_words", "chars_per_word", "chars_per_line", "upper", "lower", "digit", "space", "beyond_ascii",
    "stops", "commas", "exclamations", "bars", "marks", "top_mark", "distinct_words", "distinct_lines", "distinct_pairs",
    "entropy", "deflated", "upper_words", "ends_in_mark", "longest_word", "top_word",
)

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = np.isin(_BYTES, [9, 10, 13, 32])
_MARK = (_BYTES > 32) & (_BYTES < 127) & ~_UPPER & ~_LOWER & ~_DIGIT
_MARK_SET = frozenset(chr(b) for b in np.flatnonzero(_MARK))


def statistics(text: str) -> list[float]:
    """The statistics of one text, all bounded or logarithmic."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split("\n") if x]
    w = max(1, len(words))
    share = by[by > 0] / n
    marks = by * _MARK
    of_words: dict[str, int] = {}
    for word in words:
        of_words[word] = of_words.get(word, 0) + 1
    pairs = len(set(map(hash, zip(words, words[1:], strict=False)))) if len(words) > 1 else 1
    return [
        np.log1p(n), np.log1p(w), min(n / w, 50.0), np.log1p(n / max(1, len(lines))), by[_UPPER].sum() / n, by[_LOWER].sum() / n,
        by[_DIGIT].sum() / n, by[_SPACE].sum() / n, by[128:].sum() / n, by[46] / n, by[44] / n, by[33] / n, by[124] / n,
        marks.sum() / n, marks.max() / n, len(of_words) / w, len(set(lines)) / max(1, len(lines)), pairs / max(1, w - 1),
        float(-(share * np.log2(share)).sum()), len(zlib.compress(raw, 1)) / (n + 64), sum(map(str.isupper, words)) / w,
        sum(x[-1] in _MARK_SET for x in words) / w, np.log1p(max(map(len, words), default=0)), max(of_words.values(), default=0) / w,
    ]


def statistics_table(docs: DataFrame) -> DataFrame:
    """(doc_id, stats array<double>) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(got, pa.list_(pa.float64()))], names=["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, stats array<double>")


# --- the model --------------------------------------------------------------


class Model:
    """What a scoring task needs: a few arrays, whatever the input's size."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.default_rng(SEED)
        d = len(STATISTICS)
        self.mean, self.spread = mean, spread
        self.directions = rng.standard_normal((d, N_FEATURES)) / (KERNEL_WIDTH * np.sqrt(d))
        self.phases = rng.uniform(0, 2 * np.pi, N_FEATURES)
        self.weights = np.zeros(N_FEATURES + 1)
        self.edges, self.values = np.zeros(1), np.full(1, 0.5)

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -6, 6)
        cosines = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / N_FEATURES)
        return np.hstack([cosines, np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights if len(stats) else np.zeros(0)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.edges, self.values)


def stacked(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, len(STATISTICS))


def summed_rows(rows: DataFrame) -> np.ndarray:
    """Sum (i, values) rows, values being float64 bytes, by i: a matrix."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.float64) for v in table.column("values").to_pylist())
        return pa.table({"i": table.column("i")[:1], "values": pa.array([total.tobytes()], pa.binary())})

    # Of ever so many tasks, no group holds more than some hundreds of rows.
    shared = rows.withColumn("share", F.floor(F.spark_partition_id() / TASKS_SUMMED).cast("int"))
    part = shared.groupBy("i", "share").applyInArrow(add, "i int, values binary")
    got = part.groupBy("i").applyInArrow(add, "i int, values binary").toPandas().sort_values("i")
    return np.stack([np.frombuffer(v, np.float64) for v in got["values"]]) if len(got) else np.zeros((0, 0))


def row_batch(matrix: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(range(len(matrix)), pa.int32()), pa.array([r.tobytes() for r in matrix.astype(np.float64)], pa.binary())], names=["i", "values"])


def isotonic(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The non-decreasing fit of sums / counts by pooling adjacent violators."""
    blocks: list[list[float]] = []  # of sum, count, bins
    for n, s in zip(counts.tolist(), sums.tolist(), strict=True):
        blocks.append([s, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return np.repeat([s / n for s, n, _ in blocks], [k for *_, k in blocks])


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labelled rows outside the held-out fold."""
    spark = stats.sparkSession

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(STATISTICS)))
        for batch in batches:
            x = stacked(batch.column(0))
            total += np.stack([np.full(x.shape[1], len(x)), x.sum(0), (x * x).sum(0)])
        yield row_batch(total)

    sums = summed_rows(stats.select("stats").mapInArrow(moments, "i int, values binary"))
    if not len(sums) or not sums[0, 0]:
        return Model(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    mean = sums[1] / sums[0]
    spread = np.sqrt(np.maximum(sums[2] / sums[0] - mean**2, 1e-12))
    model = Model(mean, np.where(spread > 1e-5, spread, 1.0))

    known = labels.where(F.col("quality").isNotNull() & (crc_mod("doc_id", FOLDS) != HELD_OUT)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    learned = saved(stats.join(known, "doc_id").select("stats", "y"), "op3-learned")
    shared = spark.sparkContext.broadcast(model)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((N_FEATURES + 2, N_FEATURES + 1))
        for batch in batches:
            z, y = shared.value.features(stacked(batch.column(0))), batch.column(1).to_numpy()
            total[:-1] += z.T @ z
            total[-1] += z.T @ y
        if total.any():
            yield row_batch(total)

    total = summed_rows(learned.mapInArrow(equations, "i int, values binary"))
    if not len(total):
        return model
    penalty = np.eye(N_FEATURES + 1) * RIDGE
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(total[:-1] + penalty, total[-1])
    fitted = spark.sparkContext.broadcast(model)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, N_BINS))
        for batch in batches:
            at = np.clip(((fitted.value.raw(stacked(batch.column(0))) + 0.5) / 2 * N_BINS).astype(int), 0, N_BINS - 1)
            total += np.stack([np.bincount(at, minlength=N_BINS), np.bincount(at, batch.column(1).to_numpy(), N_BINS)])
        yield row_batch(total)

    counts, hits = summed_rows(learned.mapInArrow(histogram, "i int, values binary"))
    used = np.flatnonzero(counts)
    model.edges = (used + 0.5) / N_BINS * 2 - 0.5
    model.values = isotonic(counts[used], hits[used])
    return model


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    stats = saved(statistics_table(docs), "op3-stats")
    shared = docs.sparkSession.sparkContext.broadcast(fit(stats, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(stacked(batch.column(1)))
            yield pa.record_batch([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = stats.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier does not reject, with all their columns. The rows are
    written with their statistics, which are computed once."""
    name = "_stats"
    while name in docs.columns:
        name += "_"

    @F.pandas_udf("array<double>")
    def of_text(texts: pd.Series) -> pd.Series:
        return texts.map(statistics)

    rows = saved(docs.withColumn(name, of_text(text_or_empty())), "op3-rows")
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).alias("stats")), labels))

    @F.pandas_udf("double")
    def score(stats: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.stack(stats.to_list()) if len(stats) else np.zeros((0, len(STATISTICS)))))

    return rows.where(score(name) >= 0.5).drop(name)
