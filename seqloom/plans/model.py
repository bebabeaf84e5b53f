"""Tables of the three-state pair model: support, features, log-probabilities, fit.

States: SUB 0 aligns two letters, INS 1 emits a bottom letter against a gap, DEL 2 a top
letter against a gap. Symbols are the letters' ids, then the boundary, then the gap.
All tables are as large as the alphabet squared, times the number of pair statistics.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import NEG, Weights
from ..functions.letters import BOUNDARY, GAP, collapse_indel_state
from ..sources.shared import numbered, saved

SUB, INS, DEL = 0, 1, 2
KEY = ["state1", "stat", "state2", "top_sym", "bot_sym"]
#: A model table above so many numbers is not sent to the executors.
MAX_TABLE = 50_000_000
#: Alphabets up to this size are written into the expression that codes letters.
MAX_LITERALS = 500


def build_alphabet(sequences: DataFrame) -> DataFrame:
    """(letter, letter_id): distinct letters in order, numbered from 0. The boundary is reserved."""
    letters = sequences.select(F.explode("letters").alias("letter")).distinct()
    safe = F.when(F.col("letter") == BOUNDARY, F.raise_error(F.lit("a letter may not be the boundary")).cast("string")).otherwise(F.col("letter"))
    # Distinct letters only: one small window.
    return letters.select(safe.alias("letter")).withColumn("letter_id", (F.dense_rank().over(Window.orderBy("letter")) - 1).cast("int"))


def longest_letter(sequences: DataFrame) -> DataFrame:
    return sequences.select(F.explode("letters").alias("letter")).agg(F.max(F.length("letter")).alias("longest"))


def validate_letters(sequences: DataFrame, alphabet: DataFrame) -> DataFrame:
    """Letters of the sequences that the alphabet lacks, with their number."""
    counted = sequences.select(F.explode("letters").alias("letter")).groupBy("letter").agg(F.count("*").alias("n"))
    return counted.join(alphabet, "letter", "left_anti")


def with_letter_ids(sequences: DataFrame, alphabet: DataFrame) -> DataFrame:
    """sequences with `ids` in place of letters; an unknown letter is an error."""
    rows = alphabet.limit(MAX_LITERALS + 1).collect()
    if len(rows) > MAX_LITERALS:
        # Each row has a name of its own, so that repeated sequences stay apart.
        rows = saved(sequences.withColumn("_row", F.monotonically_increasing_id()), "rows")
        each = rows.select("_row", F.posexplode("letters").alias("_i", "letter")).join(alphabet, "letter", "left")
        known = each.withColumn("letter_id", F.coalesce("letter_id", F.raise_error(F.concat(F.lit("unknown letter "), "letter")).cast("int")))
        ids = known.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "letter_id"))), lambda x: x["letter_id"]).alias("ids"))
        return rows.drop("letters").join(ids, "_row", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>"))).drop("_row")
    known = F.create_map(*[v for r in rows for v in (F.lit(r.letter), F.lit(r.letter_id))])
    found = F.transform("letters", lambda x: F.coalesce(F.try_element_at(known, x), F.raise_error(F.concat(F.lit("unknown letter "), x)).cast("int")))
    return sequences.withColumn("ids", found).drop("letters")


def symbols(alphabet: DataFrame) -> DataFrame:
    """(id, name, kind) of letters, boundary and gap."""
    n = alphabet.agg(F.coalesce(F.max("letter_id") + 1, F.lit(0)).alias("n"))
    return (
        alphabet.select(F.col("letter_id").alias("id"), F.col("letter").alias("name"), F.lit("letter").alias("kind"))
        .union(n.select("n", F.lit(BOUNDARY), F.lit("boundary"))).union(n.select(F.col("n") + 1, F.lit(GAP), F.lit("gap")))
    )


def transition_support(alphabet: DataFrame) -> DataFrame:
    """(state1, state2, top_sym, bot_sym): SUB emits two letters or two boundaries, INS and
    DEL one letter against the gap; INS does not follow DEL."""
    s = symbols(alphabet)
    top = s.select(F.col("id").alias("top_sym"), F.col("kind").alias("top_kind"))
    bot = s.select(F.col("id").alias("bot_sym"), F.col("kind").alias("bot_kind"))
    state2 = (
        F.when((F.col("top_kind") == F.col("bot_kind")) & (F.col("top_kind") != "gap"), SUB)
        .when((F.col("top_kind") == "gap") & (F.col("bot_kind") == "letter"), INS)
        .when((F.col("top_kind") == "letter") & (F.col("bot_kind") == "gap"), DEL)
    )
    # Two alphabets side by side: as many rows as the model table has cells.
    emitted = top.join(bot, F.lit(True)).withColumn("state2", state2).where("state2 is not null")
    before = alphabet.sparkSession.range(3).select(F.col("id").cast("int").alias("state1"))
    return emitted.join(before, ~((F.col("state1") == DEL) & (F.col("state2") == INS))).select("state1", "state2", "top_sym", "bot_sym")


def letter_feature_lookup(table: DataFrame, alphabet: DataFrame, letter_features: DataFrame) -> DataFrame:
    """table with `top_features` and `bot_features` of its symbols; null for gap, boundary
    and letters without any."""
    known = letter_features.join(alphabet, "letter").select("letter_id", "features")
    side = lambda name: known.select(F.col("letter_id").alias(f"{name}_sym"), F.col("features").alias(f"{name}_features"))
    return table.join(side("top"), "top_sym", "left").join(side("bot"), "bot_sym", "left")


#: Features of one's own: transitions (the key, top_name, bot_name) to (the key, feature, value).
Custom = Callable[[DataFrame], DataFrame]


def transition_features(
    alphabet: DataFrame, letter_features: DataFrame | None = None, statistics: DataFrame | None = None, use_letter_pairs: bool = True, use_long_gaps: bool = True, custom: Custom | None = None,
) -> DataFrame:
    """(state1, stat, state2, top_sym, bot_sym, feature, value), those of `custom` as well.

    statistics: (stat, label) of pair-specific models; each feature then also stands with
    the label as its prefix. Differences of unequal vectors have no prefix of their own,
    so that they count twice there."""
    spark = alphabet.sparkSession
    names = symbols(alphabet).select("id", "name")
    rows = transition_support(alphabet)
    rows = rows.join(names.select(F.col("id").alias("top_sym"), F.col("name").alias("top_name")), "top_sym")
    rows = rows.join(names.select(F.col("id").alias("bot_sym"), F.col("name").alias("bot_name")), "bot_sym")
    if letter_features is not None:
        rows = letter_feature_lookup(rows, alphabet, letter_features)
    else:
        rows = rows.withColumns({"top_features": F.lit(None).cast("array<string>"), "bot_features": F.lit(None).cast("array<string>")})
    prefixes = F.array(F.lit(""))
    if statistics is None:
        stats = spark.range(1).select(F.lit(0).alias("stat"), F.lit(None).cast("string").alias("label"))
    else:
        stats, prefixes = statistics.select("stat", "label"), F.array(F.lit(""), F.concat("label", F.lit(",")))
    rows = rows.join(stats, F.lit(True)).withColumn("prefix", F.explode(prefixes))

    pre = F.col("prefix")
    a, b = F.col("top_features"), F.col("bot_features")
    change = lambda d, n: F.concat(F.lit("featChange("), d.cast("string"), F.lit("/"), n.cast("string"), F.lit(")"))
    none = F.array().cast("array<string>")
    below = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    differing = F.transform(F.filter(below(F.size(a)), lambda d: ~a[d].eqNullSafe(b[d])), lambda d: F.concat(pre, change(d, F.size(a))))
    all_of = lambda v: F.transform(below(F.size(v)), lambda d: change(d, F.size(v)))
    dims = F.concat(F.array(F.concat(pre, F.lit("featDimChange("), F.abs(F.size(a) - F.size(b)).cast("string"), F.lit(")"))), all_of(a), all_of(b))
    vectors = F.when(a.isNull() | b.isNull(), none).when(F.size(a) == F.size(b), differing).otherwise(dims)
    first = F.col("top_sym") < F.col("bot_sym")
    low, high = F.when(first, F.col("top_name")).otherwise(F.col("bot_name")), F.when(first, F.col("bot_name")).otherwise(F.col("top_name"))
    parts = [vectors, F.when(F.col("top_sym") == F.col("bot_sym"), F.array(F.concat(pre, F.lit("selfsub")))).otherwise(none)]
    if use_letter_pairs:
        parts.append(F.array(F.concat(pre, F.lit("pair("), low, F.lit(","), high, F.lit(")"))))
    s1, s2 = (collapse_indel_state(F.col(c)).cast("string") for c in ("state1", "state2"))
    parts.append(F.array(F.concat(pre, F.lit("state("), s1, F.lit(")"))))
    if use_long_gaps:
        parts.append(F.array(F.concat(pre, F.lit("statePair("), s1, F.lit(","), s2, F.lit(")"))))
    each = rows.select(*KEY, F.explode(F.concat(*parts)).alias("feature"), F.lit(1.0).alias("value"))
    if custom is not None:
        transitions = rows.select(*KEY, "top_name", "bot_name").distinct()
        each = each.unionByName(custom(transitions).select(*KEY, "feature", F.col("value").cast("double").alias("value")))
    return each.groupBy(*KEY, "feature").agg(F.sum("value").alias("value"))


def transition_logprobs(features: DataFrame, weights: DataFrame) -> DataFrame:
    """(state1, stat, state2, top_sym, bot_sym, logp): softmax of the summed weights over
    the support of each (state1, stat). weights: (feature, weight); absent ones are 0."""
    scored = features.join(weights, "feature", "left").groupBy(*KEY).agg(F.sum(F.col("value") * F.coalesce("weight", F.lit(0.0))).alias("score"))
    by = Window.partitionBy("state1", "stat")
    shifted = scored.withColumn("top", F.max("score").over(by))
    total = F.log(F.sum(F.exp(F.col("score") - F.col("top"))).over(by))
    return shifted.select(*KEY, (F.col("score") - F.col("top") - total).alias("logp"))


def export_model_table(logprobs: DataFrame) -> DataFrame:
    """Every outcome of finite log-probability with its probability."""
    return logprobs.where(F.col("logp") > float("-inf")).select(*KEY, F.exp("logp").alias("probability"))


def weights_of(state1: np.ndarray, state2: np.ndarray, top: np.ndarray, bot: np.ndarray, logp: np.ndarray, n_letters: int) -> Weights:
    """One model as arrays for the recurrences."""
    n = n_letters + 2
    table = np.full((3, 3, n, n), NEG)
    table[state1, state2, top, bot] = logp
    if np.exp(table.max(initial=NEG)) > 1 + 1e-4:
        raise ValueError("a log-probability is above 0")
    only = lambda s: np.where(np.arange(3)[None, :, None, None] == s, table, NEG)
    return Weights(sub=only(SUB), drop=only(DEL)[:, :, :, n - 1], ins=only(INS)[:, :, n - 1, :])


def model_weights(logprobs: DataFrame, n_letters: int) -> dict[int, Weights]:
    """The table as arrays, by pair statistic, for models that are sent to every task."""
    n = n_letters + 2
    n_cells = 9 * n * n * logprobs.select("stat").distinct().count()
    if n_cells > MAX_TABLE:
        raise ValueError(f"a model table of {n_cells} cells is too large to send to the executors; see model_tables")
    rows = logprobs.toPandas()
    return {int(stat): weights_of(part.state1, part.state2, part.top_sym, part.bot_sym, part.logp, n_letters) for stat, part in rows.groupby("stat")}


@dataclass(frozen=True)
class Tables:
    """Models of many pair statistics, which meet their pairs in a shuffle: a row a
    statistic, (stat, cells), with as many cells as one model."""

    rows: DataFrame
    n_letters: int


def model_tables(logprobs: DataFrame, n_letters: int) -> Tables:
    cells = F.collect_list(F.struct("state1", "state2", "top_sym", "bot_sym", "logp"))
    return Tables(logprobs.groupBy("stat").agg(cells.alias("cells")), n_letters)


# --- the fit ----------------------------------------------------------------


def minimise(function, start: np.ndarray, steps: int = 200, tolerance: float = 1e-6, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with halved steps."""
    x = start.copy()
    value, slope = function(x)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(slope).max(initial=0) < tolerance:
            break
        direction, kept = slope.copy(), []
        for s, y, r in reversed(moves):
            a = r * s.dot(direction)
            kept.append(a)
            direction -= a * y
        if moves:
            s, y, r = moves[-1]
            direction *= 1 / (r * y.dot(y))
        for (s, y, r), a in zip(moves, reversed(kept), strict=True):
            direction += s * (a - r * y.dot(direction))
        step, fall = 1.0, slope.dot(direction)
        while True:
            trial = x - step * direction
            new_value, new_slope = function(trial)
            if new_value <= value - 1e-4 * step * fall or step < 1e-12:
                break
            step /= 2
        s, y = trial - x, new_slope - slope
        if s.dot(y) > 1e-12:
            moves = [*moves, (s, y, 1 / s.dot(y))][-memory:]
        if step < 1e-12:
            break
        x, value, slope = trial, new_value, new_slope
    return x


def objective(features: pd.DataFrame, counts: pd.DataFrame, centers: dict[str, float], sigma: float, factors: dict[str, float] | None = None):
    """(names, function): penalised negative log-likelihood and its gradient for weights
    in the order of names. factors multiply the penalty of their features."""
    cells = features[KEY].drop_duplicates().reset_index(drop=True)
    cells["cell"] = np.arange(len(cells))
    context = cells.groupby(["state1", "stat"]).ngroup().to_numpy()
    names = sorted(features.feature.unique())
    number = {f: i for i, f in enumerate(names)}
    at = features.merge(cells, on=KEY)
    row, col, value = at.cell.to_numpy(), at.feature.map(number).to_numpy(), at.value.to_numpy()
    c = cells.merge(counts, on=KEY, how="left").sort_values("cell").expected.fillna(0.0).to_numpy()
    totals = np.bincount(context, c)
    center = np.array([centers.get(f, 0.0) for f in names])
    factor = np.array([(factors or {}).get(f, 1.0) for f in names])

    def function(w: np.ndarray) -> tuple[float, np.ndarray]:
        score = np.bincount(row, value * w[col], len(cells))
        top = np.full(len(totals), NEG)
        np.maximum.at(top, context, score)
        norm = np.log(np.bincount(context, np.exp(score - top[context]))) + top
        logp = score - norm[context]
        gap = c - totals[context] * np.exp(logp)
        away = w - center
        return float(-(c * logp).sum() + (factor * away**2).sum() / (2 * sigma**2)), -np.bincount(col, value * gap[row], len(names)) + factor * away / sigma**2

    return names, function


def m_step(features: DataFrame, suffstats: DataFrame, start: DataFrame | None = None, centers: DataFrame | None = None, sigma: float = 1.0, factors: DataFrame | None = None) -> DataFrame:
    """(feature, weight) that fit the expected counts, with a normal penalty of width
    sigma about the centers, times the factor of the features in (feature, factor). The
    tables are those of the model, small at any number of pairs, and are fitted on the
    driver."""
    spark = features.sparkSession
    as_dict = lambda w, of="weight": dict(w.select("feature", of).toPandas().itertuples(index=False)) if w is not None else {}
    names, function = objective(features.toPandas(), suffstats.select(*KEY, "expected").toPandas(), as_dict(centers), sigma, as_dict(factors, "factor"))
    begin = as_dict(start)
    fitted = minimise(function, np.array([begin.get(f, 0.0) for f in names]))
    return spark.createDataFrame(pd.DataFrame({"feature": names, "weight": fitted}), "feature string, weight double")


# --- the fit in tasks, for models of many pair statistics --------------------


def contexts(features: DataFrame, suffstats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feature, index), and a row for each (state1, stat), saved: the expected counts of its
    cells, the number of features of each, and their indices and values one after another.
    A row is as large as one statistic's model."""
    index = saved(numbered(features.select("feature").distinct(), "index", "feature"), "features")
    cells = features.join(index, "feature").groupBy(*KEY).agg(F.collect_list(F.struct("index", "value")).alias("f"))
    counted = cells.join(suffstats.select(*KEY, "expected"), KEY, "left")
    each = F.collect_list(F.struct(F.coalesce("expected", F.lit(0.0)).alias("c"), "f"))
    rows = counted.groupBy("state1", "stat").agg(each.alias("cells"))
    of = lambda name: F.flatten(F.transform("cells", lambda x: F.transform(x["f"], lambda f: f[name])))
    return index, saved(rows.select(F.transform("cells", lambda x: x["c"]).alias("counts"), F.transform("cells", lambda x: F.size(x["f"])).alias("sizes"), of("index").alias("at"), of("value").alias("values")), "contexts")


def loss_and_gradient(rows: DataFrame, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """The negative log-likelihood of the counts and its gradient, added up in the tasks;
    only vectors as long as the weights come to the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        slope, loss = np.zeros(len(w)), 0.0
        for batch in batches:
            for c, size, at, value in zip(*(col for col in batch.columns), strict=True):
                c, size, at, value = (x.values.to_numpy() for x in (c, size, at, value))
                cell = np.repeat(np.arange(len(c)), size)
                score = np.bincount(cell, value * w[at], len(c))
                top = score.max()
                logp = score - top - np.log(np.exp(score - top).sum())
                loss -= (c * logp).sum()
                slope -= np.bincount(at, value * (c - c.sum() * np.exp(logp))[cell], len(w))
        some = np.nonzero(slope)[0]
        yield pa.record_batch([pa.array(np.append(some, -1)), pa.array(np.append(slope[some], loss))], names=["index", "part"])

    found = rows.mapInArrow(run, "index long, part double").groupBy("index").agg(F.sum("part").alias("part")).toPandas()
    shared.destroy()
    slope = np.zeros(len(weights))
    own = found[found["index"] >= 0]
    slope[own["index"]] = own.part
    return float(found.part[found["index"] < 0].sum()), slope


def m_step_in_tasks(features: DataFrame, suffstats: DataFrame, start: DataFrame | None = None, centers: DataFrame | None = None, sigma: float = 1.0, factors: DataFrame | None = None) -> DataFrame:
    """m_step for models of many pair statistics, whose cells stay in the tasks."""
    spark = features.sparkSession
    index, rows = contexts(features, suffstats)
    rows = rows.persist()

    def vector(table: DataFrame | None, of: str, default: float) -> np.ndarray:
        out = np.full(len(names), default)
        if table is not None:
            own = index.join(table, "feature").select("index", of).toPandas()
            out[own["index"]] = own[of]
        return out

    names = index.orderBy("index").toPandas().feature.tolist()
    center, factor = vector(centers, "weight", 0.0), vector(factors, "factor", 1.0)

    def function(w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, slope = loss_and_gradient(rows, w)
        away = w - center
        return loss + float((factor * away**2).sum()) / (2 * sigma**2), slope + factor * away / sigma**2

    fitted = minimise(function, vector(start, "weight", 0.0))
    rows.unpersist()
    return spark.createDataFrame(pd.DataFrame({"feature": names, "weight": fitted}), "feature string, weight double")


def fit_gradient(features: DataFrame, suffstats: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(feature, gradient) of the negative log-likelihood at given weights, or at zero."""
    index, rows = contexts(features, suffstats)
    at = np.zeros(index.count())
    if weights is not None:
        own = index.join(weights, "feature").select("index", "weight").toPandas()
        at[own["index"]] = own.weight
    _, slope = loss_and_gradient(rows, at)
    found = features.sparkSession.createDataFrame(pd.DataFrame({"index": np.arange(len(slope)), "gradient": slope}), "index long, gradient double")
    return index.join(found, "index").select("feature", "gradient")
