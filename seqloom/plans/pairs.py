"""Pairs of sequences of a group, and what the pair model says of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.kernels import Batch, Weights
from ..sources.shared import few, numbered, saved
from .model import Tables, weights_of

#: Cells of one padded batch of pairs.
BATCH_CELLS = 400_000
#: Sequences of a block: two blocks make up to its square of pairs in one task.
BLOCK = 512
#: Blocks of a group at most: each sequence stands under every block of its group, so that what
#: is shuffled would otherwise grow with the square of a group.
BLOCKS = 32
#: Pairs of one statistic that one task takes, where models meet their pairs in a shuffle.
PER_TASK = 100_000


def blocked(sequences: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """sequences (group_id, ord, ...) twice, for a join on group_id, _i and _j that meets
    each pair once under the blocks of its two sequences: as the earlier one under all
    blocks (own, j) and as the later one under all (i, own). Groups of one block stand there
    once, as they are; a large one is spread over as many keys as it has pairs of blocks."""
    last = few(sequences.groupBy("group_id").agg(F.max("ord").alias("_last")).where(F.col("_last") >= block))
    size = F.greatest(F.lit(block), F.ceil((F.col("_last") + 1) / BLOCKS))
    own, end = (F.coalesce(F.floor(F.col(c) / size).cast("int"), F.lit(0)) for c in ("ord", "_last"))
    known = sequences.join(last, "group_id", "left").withColumns({"_own": F.when(F.col("_last").isNull(), 0).otherwise(own), "_end": end}).drop("_last")
    top = known.withColumns({"_i": F.col("_own"), "_j": F.explode(F.sequence("_own", "_end"))})
    bot = known.withColumns({"_j": F.col("_own"), "_i": F.explode(F.sequence(F.lit(0), "_own"))})
    return top.drop("_own", "_end"), bot.drop("_own", "_end")


def sequence_pairs(coded: DataFrame, statistic: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(group_id, top_id, bot_id, top, bot, stat) for sequences (group_id, sequence_id,
    ord, ids): all pairs of a group, the earlier one on top; those of a large group come
    block by block in many tasks. statistic: an expression over top_id, bot_id, top and bot."""
    first, second = blocked(coded.select("group_id", "sequence_id", "ord", "ids"), block)
    a = first.select("group_id", "_i", "_j", F.col("sequence_id").alias("top_id"), F.col("ord").alias("_a"), F.col("ids").alias("top"))
    b = second.select("group_id", "_i", "_j", F.col("sequence_id").alias("bot_id"), F.col("ord").alias("_b"), F.col("ids").alias("bot"))
    stat = F.lit(0) if statistic is None else statistic
    return in_blocks(a, b).where("_a < _b").select("group_id", "top_id", "bot_id", "top", "bot", stat.cast("int").alias("stat"))


def in_blocks(a: DataFrame, b: DataFrame) -> DataFrame:
    """The join of what `blocked` gave. Files do not tell how many rows stand under all
    blocks, so that no side is broadcast, and blocks are dealt over all tasks."""
    key = ["group_id", "_i", "_j"]
    return spread(a, *key).hint("merge").join(spread(b, *key), key)


def spread(pairs: DataFrame, *key: str) -> DataFrame:
    """The pairs hashed over all tasks: rows of few bytes that take long, which would
    otherwise be brought into few."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def like_pairs(pairs: DataFrame) -> DataFrame:
    """(stat, top, bot, times): equal pairs of sequences once, with their number. Counts and
    the likelihood do not depend on ids; equal pairs meet before the shuffle."""
    counted = pairs.groupBy("stat", "top", "bot").agg(F.count("*").alias("times"))
    return spread(counted, "stat", "top", "bot")


def taxa_pairs(sequences: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id1, id2): distinct pairs of sequence ids that share a group, id1 < id2."""
    first, second = blocked(sequences.select("group_id", "sequence_id", "ord"), block)
    a = first.select("group_id", "_i", "_j", F.col("sequence_id").alias("_a"), F.col("ord").alias("_x"))
    b = second.select("group_id", "_i", "_j", F.col("sequence_id").alias("_b"), F.col("ord").alias("_y"))
    both = in_blocks(a, b).where("_x < _y and _a <> _b")
    return both.select(F.least("_a", "_b").alias("id1"), F.greatest("_a", "_b").alias("id2")).distinct()


def pair_statistic_index(sequences: DataFrame) -> DataFrame:
    """(id1, id2, label, stat): a number for each pair of ids, for pair-specific models."""
    found = numbered(taxa_pairs(sequences), "stat", "id1", "id2")
    return found.select("id1", "id2", F.concat_ws("|", "id1", "id2").alias("label"), F.col("stat").cast("int").alias("stat"))


def with_statistics(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """pairs with the number of their pair of ids."""
    low, high = F.least("top_id", "bot_id"), F.greatest("top_id", "bot_id")
    return pairs.drop("stat").withColumns({"id1": low, "id2": high}).join(index.select("id1", "id2", "stat"), ["id1", "id2"]).select("group_id", "top_id", "bot_id", "top", "bot", "stat")


def reweight_pairs(pairs: DataFrame, odds: DataFrame) -> DataFrame:
    """pairs with the log odds (group_id, top_id, bot_id, x, y, log_odds) of aligned positions
    as two lists, `bonus_at` (cells by rows of top) and `bonus`; others have none, and odds
    of one cell add up."""
    key = ["group_id", "top_id", "bot_id"]
    listed = odds.groupBy(*key).agg(F.collect_list(F.struct("x", "y", "log_odds")).alias("_odds"))
    joined = pairs.join(listed, key, "left")
    at = F.transform("_odds", lambda o: (o["x"] * F.size("bot") + o["y"]).cast("int"))
    return joined.withColumns({"bonus_at": at, "bonus": F.transform("_odds", lambda o: o["log_odds"].cast("double"))}).drop("_odds")


def in_batches(rows: pd.DataFrame, weights: dict[int, Weights] | Tables, boundary: int | None) -> Iterator[tuple[pd.DataFrame, Batch, Weights]]:
    """Pairs of like sizes together, at most BATCH_CELLS padded cells at once. boundary:
    the symbol to append to both sides."""
    if not len(rows):
        return
    end = [] if boundary is None else [boundary]
    tops, bots = [[*t, *end] for t in rows.top], [[*b, *end] for b in rows.bot]
    stats, ns, ms = rows.stat.tolist(), list(map(len, tops)), list(map(len, bots))
    order = np.lexsort((ms, ns, stats)).tolist()
    first = 0
    while first < len(order):
        stat, n, m, last = stats[order[first]], 0, 0, first
        while last < len(order) and stats[order[last]] == stat:
            n2, m2 = max(n, ns[order[last]]), max(m, ms[order[last]])
            if last > first and (n2 + 1) * (m2 + 1) * (last - first + 1) > BATCH_CELLS:
                break
            n, m, last = n2, m2, last + 1
        chosen = order[first:last]
        bonus = None
        if "bonus" in rows.columns:
            bonus = []
            for i in chosen:
                cells, own = rows.bonus_at.iloc[i], rows.bonus.iloc[i]
                odds = None
                if own is not None and len(own):
                    odds = np.zeros((len(tops[i]), len(bots[i])))
                    np.add.at(odds, np.divmod(np.asarray(cells, np.int64), len(bots[i]) - len(end)), np.asarray(own, float))
                bonus.append(odds)
        yield rows.iloc[chosen], Batch.of([tops[i] for i in chosen], [bots[i] for i in chosen], bonus), weights[int(stat)]
        first = last


def with_models(pairs: DataFrame, tables: Tables, per_task: int = PER_TASK) -> DataFrame:
    """The pairs with the models of their statistics, each model's row before its pairs in
    the same task; a statistic of more than `per_task` pairs is dealt over several tasks,
    each with the model's row."""
    counts = pairs.groupBy("stat").agg(F.ceil(F.count("*") / per_task).cast("int").alias("_parts"))
    dealt = pairs.join(counts, "stat").withColumn("_part", F.pmod(F.xxhash64("top", "bot"), F.col("_parts")).cast("int")).drop("_parts")
    models = tables.rows.join(counts, "stat").select("stat", "cells", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    both = models.unionByName(dealt, allowMissingColumns=True)
    return both.repartition("stat", "_part").sortWithinPartitions("stat", "_part", F.col("cells").isNull())


_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}


def per_pairs(pairs: DataFrame, weights: dict[int, Weights] | Tables, boundary: int | None, schema: str, work: Callable) -> DataFrame:
    """Rows that work(rows, batch, weights) gives as a pandas frame for each batch. Models
    are sent to every task, or meet their pairs by statistic."""
    columns = [f.split()[0] for f in schema.split(", ")]
    kinds = pa.schema([(c, _ARROW[k]) for c, k in (f.split() for f in schema.split(", "))])

    def results(rows: pd.DataFrame, models: dict[int, Weights]) -> Iterator[pa.RecordBatch]:
        for part, padded, w in in_batches(rows, models, boundary):
            out = work(part, padded, w)
            if len(out):
                yield pa.RecordBatch.from_pandas(out[columns], kinds, preserve_index=False)

    if isinstance(weights, Tables):
        n_letters = weights.n_letters

        def run_by_model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models: dict[int, Weights] = {}
            for batch in batches:
                names = batch.schema.names
                is_model = np.asarray(batch.column(names.index("cells")).is_valid())
                kept = {models_of: models[models_of] for models_of in list(models)[-1:]}  # the last one goes on
                fresh = batch.filter(pa.array(is_model))
                for stat, cells in zip(fresh.column(names.index("stat")).to_pylist(), fresh.column(names.index("cells")), strict=True):
                    fields = [f.to_numpy() for f in cells.values.flatten()]
                    kept[stat] = kept.pop(stat, None) or weights_of(*fields, n_letters)
                models = kept
                rows = batch.filter(pa.array(~is_model))
                frame = pd.DataFrame({n: rows.column(i).to_pylist() for i, n in enumerate(names) if n not in ("cells", "_part")})
                yield from results(frame, models)

        return with_models(pairs, weights).mapInArrow(run_by_model, schema)

    shared = pairs.sparkSession.sparkContext.broadcast(weights)  # bounded by MAX_TABLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pd.DataFrame({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            yield from results(rows, shared.value)

    return pairs.mapInArrow(run, schema)


def per_distinct(pairs: DataFrame, weights: dict[int, Weights] | Tables, boundary: int | None, schema: str, work: Callable) -> DataFrame:
    """(group_id, top_id, bot_id, top, bot) of all pairs with the columns that work gives for
    each: a row for each of a batch, in its order. What does not depend on ids is found once
    for equal pairs of letters, and joined to all of them."""
    key = ["stat", "top", "bot", *(c for c in ("bonus_at", "bonus") if c in pairs.columns)]
    hashed = pairs.withColumn("_hash", F.xxhash64(*key))  # sorts sooner than lists
    kinds = dict(pairs.dtypes)

    def keyed(rows: pd.DataFrame, batch: Batch, w: Weights) -> pd.DataFrame:
        return pd.concat([rows[["_hash", *key]], work(rows, batch, w).set_index(rows.index)], axis=1)

    once = spread(hashed.select("_hash", *key).distinct(), "_hash")
    found = per_pairs(once, weights, boundary, ", ".join(["_hash long", *(f"{c} {kinds[c]}" for c in key), schema]), keyed)
    named = found.select("_hash", *(F.col(c).alias(f"_{c}") for c in key), *(f.split()[0] for f in schema.split(", ")))
    same = reduce(lambda a, b: a & b, (hashed[c].eqNullSafe(named[f"_{c}"]) for c in key))
    both = hashed.join(named, (hashed["_hash"] == named["_hash"]) & same)
    return both.select("group_id", "top_id", "bot_id", "top", "bot", *(f.split()[0] for f in schema.split(", ")))


def pair_log_likelihood(pairs: DataFrame, weights: dict[int, Weights] | Tables, boundary: int | None) -> DataFrame:
    """(group_id, top_id, bot_id, loglik): log of the summed weight of all paths."""

    def work(rows: pd.DataFrame, batch: Batch, w: Weights) -> pd.DataFrame:
        return pd.DataFrame({"loglik": kernels.log_likelihoods(batch, w)})

    return per_distinct(pairs, weights, boundary, "loglik double", work).select("group_id", "top_id", "bot_id", "loglik")


def inner_cells(rows: pd.DataFrame, chance: np.ndarray, over: float) -> pd.DataFrame:
    """Cells of real letters with a chance above `over`, by rows of top, and their chances:
    a list of each for each pair."""
    n, m = rows.top.map(len).to_numpy(), rows.bot.map(len).to_numpy()
    x, y = np.arange(chance.shape[1]), np.arange(chance.shape[2])
    real = (x[None, :, None] < n[:, None, None]) & (y[None, None, :] < m[:, None, None])
    i, a, b = np.nonzero(real & (chance > over))
    ends = np.searchsorted(i, np.arange(1, len(rows)))
    return pd.DataFrame({"cells": np.split((a * m[i] + b).astype(np.int32), ends), "scores": np.split(chance[i, a, b], ends)})


def cell_posteriors(pairs: DataFrame, weights: dict[int, Weights] | Tables, boundary: int | None, over: float) -> DataFrame:
    """The pairs with the cells, by rows of top, of a chance above `over`, and their chances."""

    def work(rows: pd.DataFrame, batch: Batch, w: Weights) -> pd.DataFrame:
        return inner_cells(rows, kernels.posteriors(batch, w)[0], over)

    return per_distinct(pairs, weights, boundary, "cells array<int>, scores array<double>", work)


def posterior_lists(pairs: DataFrame, weights: dict[int, Weights] | Tables, boundary: int | None, over: float = -1.0) -> DataFrame:
    """The edges of pair_posteriors, a row a pair: (aln_id, seq1, seq2, width, cells, scores),
    where a cell is pos1 * width + pos2."""
    found = cell_posteriors(pairs, weights, boundary, over)
    keep, n, m = F.col("top_id") < F.col("bot_id"), F.size("top"), F.size("bot")
    turned = F.transform("cells", lambda c: (F.pmod(c, m) * n + F.floor(c / m)).cast("int"))
    return found.select(
        F.col("group_id").alias("aln_id"), F.least("top_id", "bot_id").alias("seq1"), F.greatest("top_id", "bot_id").alias("seq2"),
        F.when(keep, m).otherwise(n).alias("width"), F.when(keep, F.col("cells")).otherwise(turned).alias("cells"), "scores",
    )


def pair_posteriors(pairs: DataFrame, weights: dict[int, Weights] | Tables, boundary: int | None, over: float = -1.0) -> DataFrame:
    """Scored edges: the chance that two positions are aligned. over: edges of at most
    this chance are left out before any shuffle."""

    found = cell_posteriors(pairs, weights, boundary, over)
    keep, m = F.col("top_id") < F.col("bot_id"), F.size("bot")
    each = found.select(F.col("group_id").alias("aln_id"), "top_id", "bot_id", keep.alias("_keep"), m.alias("_m"), F.explode(F.arrays_zip("cells", "scores")).alias("_c"))
    x, y = F.floor(F.col("_c.cells") / F.col("_m")).cast("int"), F.pmod("_c.cells", "_m")
    first, second = (lambda a, b: F.when(F.col("_keep"), a).otherwise(b)), (lambda a, b: F.when(F.col("_keep"), b).otherwise(a))
    top, bot = F.col("top_id"), F.col("bot_id")
    return each.select("aln_id", first(top, bot).alias("seq1"), first(x, y).alias("pos1"), second(top, bot).alias("seq2"), second(x, y).alias("pos2"), F.col("_c.scores").alias("score"))


_COUNTS = "state1 int, stat int, state2 int, top_sym int, bot_sym int, expected double"


def expected_counts(pairs: DataFrame, weights: dict[int, Weights] | Tables, boundary: int, n_letters: int) -> DataFrame:
    """(state1, stat, state2, top_sym, bot_sym, expected): posterior numbers of moves over
    all pairs, the boundary's included; added up within a batch, then over tasks. A column
    `times` says how often a pair counts; without it, equal pairs are counted first."""
    if not {"times", "bonus"} & set(pairs.columns):
        pairs = like_pairs(pairs)
    return sum_sufficient_statistics(batch_counts(pairs, weights, boundary, n_letters).where("state1 >= 0"))


def batch_counts(pairs: DataFrame, weights: dict[int, Weights] | Tables, boundary: int, n_letters: int) -> DataFrame:
    """The expected counts of each batch, and as a row of state1 -1 its log-likelihood."""
    n = n_letters + 2

    def work(rows: pd.DataFrame, batch: Batch, w: Weights) -> pd.DataFrame:
        counts = np.zeros((w.n_states, w.n_states, n, n))
        times = rows.times.to_numpy(float) if "times" in rows.columns else np.ones(len(rows))
        _, totals = kernels.posteriors(batch, w, counts, epsilon=n - 1, times=times)
        s1, s2, a, b = (np.append(v, -1).astype(np.int32) for v in np.nonzero(counts > 0))
        expected = np.append(counts[counts > 0], totals @ times)
        return pd.DataFrame({"state1": s1, "stat": np.int32(rows.stat.iloc[0]), "state2": s2, "top_sym": a, "bot_sym": b, "expected": expected})

    return per_pairs(pairs, weights, boundary, _COUNTS, work)


def counts_and_likelihood(pairs: DataFrame, weights: dict[int, Weights] | Tables, boundary: int, n_letters: int) -> tuple[DataFrame, float]:
    """Expected counts and the summed log-likelihood of all pairs, by one pass over them.
    The counts are as large as the model."""
    schema, each = _COUNTS, batch_counts(pairs, weights, boundary, n_letters)
    summed = each.groupBy("state1", "stat", "state2", "top_sym", "bot_sym").agg(F.sum("expected").alias("expected"))
    if isinstance(weights, Tables):  # many statistics: the counts stay in Spark
        kept = saved(summed, "counts")
        return kept.where("state1 >= 0"), float(kept.where("state1 < 0").agg(F.coalesce(F.sum("expected"), F.lit(0.0))).first()[0])
    rows = summed.toPandas()
    loglik = float(rows.expected[rows.state1 < 0].sum())
    return pairs.sparkSession.createDataFrame(rows[rows.state1 >= 0], schema), loglik


def sum_sufficient_statistics(counts: DataFrame) -> DataFrame:
    """Expected counts added up by outcome; only those above 0."""
    return counts.groupBy("state1", "stat", "state2", "top_sym", "bot_sym").agg(F.sum("expected").alias("expected")).where("expected > 0")


_DERIVATION = "ancestors array<int>"


def viterbi_alignment(pairs: DataFrame, weights: dict[int, Weights] | Tables, boundary: int | None, with_states: bool = False) -> DataFrame:
    """(group_id, top_id, bot_id, ancestors): the best path, without the boundary. Of equal
    paths the first by state, then drop, insertion, alignment."""
    schema = _DERIVATION + ", states array<int>" * with_states

    def work(rows: pd.DataFrame, batch: Batch, w: Weights) -> pd.DataFrame:
        found = kernels.viterbi(batch, w)
        cut = 0 if boundary is None else 1
        out = pd.DataFrame({"ancestors": [np.array(a[: len(a) - cut], np.int32) for a, _ in found]})
        return out.assign(states=[np.array(s[: len(s) - cut], np.int32) for _, s in found]) if with_states else out

    return per_distinct(pairs, weights, boundary, schema, work).drop("top", "bot")


def sample_alignments(pairs: DataFrame, weights: dict[int, Weights] | Tables, boundary: int | None, n_draws: int = 1, seed: int = 0) -> DataFrame:
    """(group_id, top_id, bot_id, draw, ancestors) from the posterior. Draws depend on the
    seed and the pair alone, so that a task run again gives them again."""
    keyed = pairs.withColumn("_seed", F.xxhash64(F.lit(seed), "group_id", "top_id", "bot_id"))

    def work(rows: pd.DataFrame, batch: Batch, w: Weights) -> pd.DataFrame:
        found = kernels.samples(batch, w, rows["_seed"].tolist(), n_draws)
        cut = 0 if boundary is None else 1
        each = [(*k, d, np.array(a[: len(a) - cut], np.int32)) for k, draws in zip(rows[["group_id", "top_id", "bot_id"]].itertuples(index=False), found, strict=True) for d, a in enumerate(draws)]
        out = pd.DataFrame(each, columns=["group_id", "top_id", "bot_id", "draw", "ancestors"])
        return out.astype({"draw": np.int32})

    return per_pairs(keyed, weights, boundary, "group_id string, top_id string, bot_id string, draw int, ancestors array<int>", work)


def mbr_alignment(pairs: DataFrame, weights: dict[int, Weights] | Tables, boundary: int | None) -> DataFrame:
    """(group_id, top_id, bot_id, ancestors): the path with the greatest sum of chances of
    its aligned moves."""

    def work(rows: pd.DataFrame, batch: Batch, w: Weights) -> pd.DataFrame:
        cut = 0 if boundary is None else 1
        return pd.DataFrame({"ancestors": [np.array(a[: len(a) - cut], np.int32) for a in kernels.least_risk(batch, w)]})

    return per_distinct(pairs, weights, boundary, _DERIVATION, work).drop("top", "bot")


def derivation_to_edges(derivations: DataFrame) -> DataFrame:
    """Aligned positions of decoded pairs as edges with seq1 < seq2."""
    from ..operators.alignment import canonical_edges

    each = derivations.select(F.col("group_id").alias("aln_id"), F.col("top_id").alias("seq1"), F.col("bot_id").alias("seq2"), F.posexplode("ancestors").alias("pos2", "pos1"))
    return canonical_edges(each.where("pos1 >= 0").select("aln_id", "seq1", "pos1", "seq2", "pos2"))


def table_weights(table: DataFrame, n_symbols: int, n_states: int, start: int = 0, end: int = 0) -> Weights:
    """A homogeneous model of any number of states from (move, state1, state2, a, b, weight):
    plain weights of the moves sub, del (b null) and ins (a null); absent ones are 0."""
    sub = np.zeros((n_states, n_states, n_symbols, n_symbols))
    drop, ins = np.zeros((2, n_states, n_states, n_symbols))
    for r in table.collect():  # as many rows as the user's table
        if r.move == "sub":
            sub[r.state1, r.state2, r.a, r.b] = r.weight
        elif r.move == "del":
            drop[r.state1, r.state2, r.a] = r.weight
        elif r.move == "ins":
            ins[r.state1, r.state2, r.b] = r.weight
        else:
            raise ValueError(f"no such move: {r.move}")
    with np.errstate(divide="ignore"):
        return Weights(np.log(sub), np.log(drop), np.log(ins), start, end)
