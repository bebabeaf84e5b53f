"""Alignments as rows (aln_id, column_id, sequence_id, pos): lookups, sets and order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import graphs
from ..functions.letters import canonical_edge
from ..sources.shared import few, numbered_within, saved, unpacked
from ..sources.views import named_columns

#: Residues of an alignment up to which one task orders its columns.
ALONE = 1_000_000


def column_sizes(columns: DataFrame) -> DataFrame:
    return columns.groupBy("aln_id", "column_id").agg(F.count("*").alias("n"))


def edges_of_alignment(columns: DataFrame) -> DataFrame:
    """Every pair of residues in one column, seq1 < seq2."""
    a = columns.select("aln_id", "column_id", F.col("sequence_id").alias("seq1"), F.col("pos").alias("pos1"))
    b = columns.select("aln_id", "column_id", F.col("sequence_id").alias("seq2"), F.col("pos").alias("pos2"))
    return a.join(b, ["aln_id", "column_id"]).where("seq1 < seq2").select("aln_id", "seq1", "pos1", "seq2", "pos2")


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Edges with seq1 < seq2, other columns kept."""
    others = [c for c in edges.columns if c not in ("seq1", "pos1", "seq2", "pos2")]
    return edges.select(*others, canonical_edge(F.col("seq1"), F.col("pos1"), F.col("seq2"), F.col("pos2")).alias("_e")).select(*others, "_e.*")


def contains_edge(columns: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with `contained`: are both residues in one column?"""
    at = lambda i: columns.select("aln_id", F.col("column_id").alias(f"_c{i}"), F.col("sequence_id").alias(f"seq{i}"), F.col("pos").alias(f"pos{i}"))
    both = edges.join(at(1), ["aln_id", "seq1", "pos1"], "left").join(at(2), ["aln_id", "seq2", "pos2"], "left")
    return both.select(*edges.columns, F.coalesce(F.col("_c1") == F.col("_c2"), F.lit(False)).alias("contained"))


def column_of(columns: DataFrame, residues: DataFrame) -> DataFrame:
    """residues (aln_id, sequence_id, pos) with their column_id."""
    return residues.join(columns, ["aln_id", "sequence_id", "pos"], "left")


def char_at(columns: DataFrame, residues: DataFrame) -> DataFrame:
    """(aln_id, column_id, sequence_id, letter) of residues (group_id, sequence_id, pos, letter)."""
    letters = residues.withColumnRenamed("group_id", "aln_id")
    return columns.join(letters, ["aln_id", "sequence_id", "pos"]).select("aln_id", "column_id", "sequence_id", "letter")


def restrict_alignment(columns: DataFrame, sequence_ids: DataFrame) -> DataFrame:
    """Keep the given (aln_id, sequence_id) and the links among them; unknown ids are ignored."""
    kept = columns.join(sequence_ids.select("aln_id", "sequence_id").distinct(), ["aln_id", "sequence_id"], "left_semi")
    return named_columns(kept, "column_id")


def shared_columns(gold: DataFrame, guess: DataFrame) -> DataFrame:
    """(aln_id, column_id) of gold columns that guess has with the same residues."""
    signed = lambda c: c.groupBy("aln_id", "column_id").agg(F.array_sort(F.collect_list(F.struct("sequence_id", "pos"))).alias("residues"))
    return signed(gold).join(signed(guess).select("aln_id", "residues"), ["aln_id", "residues"], "left_semi").select("aln_id", "column_id")


def spanning_edges(columns: DataFrame) -> DataFrame:
    """The first residue of a column linked with each other one."""
    by = Window.partitionBy("aln_id", "column_id").orderBy("sequence_id")
    first = columns.select("aln_id", F.first("sequence_id").over(by).alias("seq1"), F.first("pos").over(by).alias("pos1"), F.col("sequence_id").alias("seq2"), F.col("pos").alias("pos2"))
    return first.where("seq1 <> seq2")


def column_arcs(columns: DataFrame) -> DataFrame:
    """(aln_id, src, dst): columns that hold successive residues of a sequence."""
    by = Window.partitionBy("aln_id", "sequence_id").orderBy("pos")
    return columns.select("aln_id", F.col("column_id").alias("src"), F.lead("column_id").over(by).alias("dst")).where("dst is not null").distinct()


def initial_linearization(sequences: DataFrame) -> DataFrame:
    """Singletons by their relative place pos / (1 + length), with their rank."""
    rows = sequences.select(F.col("group_id").alias("aln_id"), "sequence_id", F.posexplode("letters").alias("pos", "letter"), (1 + F.size("letters")).alias("_n"))
    placed = rows.select("aln_id", (F.col("pos") / F.col("_n")).alias("_at"), "sequence_id", "pos")
    return numbered_within(placed, "place", "aln_id", "_at", "sequence_id", "pos").select("aln_id", "sequence_id", "pos", F.col("place").cast("int").alias("place"))


def gapped_to_positions(gapped: DataFrame, gap: str = "-") -> DataFrame:
    """(aln_id, sequence_id, col, letter) with gaps to residues (aln_id, sequence_id, col, pos, letter)."""
    by = Window.partitionBy("aln_id", "sequence_id").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    counted = gapped.withColumn("pos", (F.sum((F.col("letter") != gap).cast("int")).over(by) - 1).cast("int"))
    return counted.where(F.col("letter") != gap).select("aln_id", "sequence_id", "col", "pos", "letter")


def crossing_edges(edges: DataFrame) -> DataFrame:
    """Edges of a pair of sequences that cross, or share a position with, the edge before
    them in order of pos1, pos2."""
    by = Window.partitionBy("aln_id", "seq1", "seq2").orderBy("pos1", "pos2")
    before = edges.withColumns({"_p1": F.lag("pos1").over(by), "_p2": F.lag("pos2").over(by)})
    return before.where("pos1 = _p1 or pos2 <= _p2").drop("_p1", "_p2")


def rank_edges(edges: DataFrame) -> DataFrame:
    """Best first: score, then seq1, pos1, seq2, pos2."""
    ranked = numbered_within(edges, "rank", "aln_id", F.desc("score"), "seq1", "pos1", "seq2", "pos2")
    return ranked.withColumn("rank", (F.col("rank") + 1).cast("int"))


def filter_edges_by_score(edges: DataFrame, threshold: float) -> DataFrame:
    return edges.where(F.col("score") > threshold)


def threshold_grid(spark, size: int) -> DataFrame:
    """(k, threshold): 1 - 2**-k for k below size."""
    return spark.range(size).select(F.col("id").cast("int").alias("k"), (1 - F.pow(F.lit(2.0), -F.col("id"))).alias("threshold"))


# --- sets -------------------------------------------------------------------


def split_column(columns: DataFrame, kept: DataFrame) -> DataFrame:
    """Part the columns that hold residues of kept (aln_id, column_id, sequence_id): the
    kept sequences stay together, the others form a new column. The kept ones must be a
    proper, non-empty part of their column."""
    marked = columns.join(kept.select("aln_id", "column_id", "sequence_id", F.lit(True).alias("_kept")).distinct(), ["aln_id", "column_id", "sequence_id"], "left")
    by = Window.partitionBy("aln_id", "column_id")
    n_kept, n = F.count("_kept").over(by), F.count("*").over(by)
    checked = marked.withColumn("_side", F.when((n_kept == n), F.raise_error(F.lit("all sequences of a column are kept")).cast("boolean")).otherwise(F.col("_kept").isNotNull()))
    return named_columns(checked.select("aln_id", "column_id", "sequence_id", "pos", "_side"), "column_id", "_side")


def edge_set_diff(gold: DataFrame, guess: DataFrame) -> DataFrame:
    """Edges of two alignments with `side`: gold, guess or both."""
    key = ["aln_id", "seq1", "pos1", "seq2", "pos2"]
    a, b = edges_of_alignment(gold).withColumn("_a", F.lit(1)), edges_of_alignment(guess).withColumn("_b", F.lit(1))
    side = F.when(F.col("_b").isNull(), "gold").when(F.col("_a").isNull(), "guess").otherwise("both")
    return a.join(b, key, "full").select(*key, side.alias("side"))


def disjoint_columns(pairs: DataFrame | None, columns: DataFrame) -> DataFrame:
    """pairs (aln_id, column_a, column_b) of which no sequence is in both. Without pairs, all
    of an alignment with column_a < column_b, which come from one join and are not shuffled."""
    each = columns.groupBy("aln_id", "column_id").agg(F.collect_set("sequence_id").alias("ids"))
    a = each.select("aln_id", F.col("column_id").alias("column_a"), F.col("ids").alias("_a"))
    b = each.select("aln_id", F.col("column_id").alias("column_b"), F.col("ids").alias("_b"))
    if pairs is None:
        return a.join(unpacked(b), "aln_id").where((F.col("column_a") < F.col("column_b")) & ~F.arrays_overlap("_a", "_b")).select("aln_id", "column_a", "column_b")
    return pairs.join(a, ["aln_id", "column_a"]).join(b, ["aln_id", "column_b"]).where(~F.arrays_overlap("_a", "_b")).select("aln_id", "column_a", "column_b")


def union_alignments(one: DataFrame, two: DataFrame, strict: bool = False, sequences: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Columns of the union of links, with `valid`: false for alignments whose links
    conflict. With strict, a link that both have counts as a conflict too. sequences: those
    of the two alignments; an id with different letters is an error."""
    from .construct import columns_from_edges, validate_alignment

    residues = one.select("aln_id", "sequence_id", "pos").union(two.select("aln_id", "sequence_id", "pos"))
    links = spanning_edges(one).union(spanning_edges(two))
    merged = columns_from_edges(residues, links)
    if sequences is not None:
        letters = union_sequences(*sequences).select(F.col("group_id").alias("aln_id"), "sequence_id", F.posexplode("letters").alias("pos", "_letter"))
        merged = merged.join(letters.drop("_letter"), ["aln_id", "sequence_id", "pos"], "left_semi").select("aln_id", "column_id", "sequence_id", "pos")
    merged = saved(merged, "united")
    found = merged.join(validate_alignment(merged), "aln_id")
    if strict:
        common = edges_of_alignment(one).join(edges_of_alignment(two), ["aln_id", "seq1", "pos1", "seq2", "pos2"], "left_semi").select("aln_id").distinct().withColumn("_common", F.lit(True))
        found = found.join(common, "aln_id", "left").withColumn("valid", F.col("valid") & F.col("_common").isNull()).drop("_common")
    return found


def union_sequences(one: DataFrame, two: DataFrame) -> DataFrame:
    """Sequences of both; one id with different letters is an error."""
    both = one.select("group_id", "sequence_id", "letters").unionByName(two.select("group_id", "sequence_id", "letters"))
    united = both.groupBy("group_id", "sequence_id").agg(F.min("letters").alias("letters"), F.max("letters").alias("_other"))
    same = F.when(F.col("letters") == F.col("_other"), F.col("letters")).otherwise(F.raise_error(F.lit("one sequence id has different letters")).cast("array<string>"))
    return united.select("group_id", "sequence_id", same.alias("letters"))


# --- order ------------------------------------------------------------------


def peeled(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(aln_id, column_id, depth) layer by layer: all columns that wait for no other are
    taken at once, and what they held back waits for fewer. As many rounds as the longest
    path is long; what is left waits for itself, and has no depth."""
    into = arcs.groupBy("aln_id", F.col("dst").alias("column_id")).agg(F.count("*").alias("waiting"))
    rest = saved(nodes.join(into, ["aln_id", "column_id"], "left").select("aln_id", "column_id", F.coalesce("waiting", F.lit(0)).alias("waiting")), "peel")
    out, depth = None, 0
    while True:
        ready = rest.where("waiting = 0").select("aln_id", "column_id")
        if ready.isEmpty():
            break
        layer = ready.withColumn("depth", F.lit(depth))
        out = layer if out is None else out.union(layer)
        freed = arcs.join(ready.withColumnRenamed("column_id", "src"), ["aln_id", "src"]).groupBy("aln_id", F.col("dst").alias("column_id")).agg(F.count("*").alias("n"))
        left = rest.where("waiting > 0").join(freed, ["aln_id", "column_id"], "left")
        rest = saved(left.select("aln_id", "column_id", (F.col("waiting") - F.coalesce("n", F.lit(0))).alias("waiting")), "peel")
        depth += 1
    stuck = rest.withColumn("depth", F.lit(None).cast("int")).select("aln_id", "column_id", "depth")
    return stuck if out is None else out.union(stuck)


#: Residues of small alignments that are worked on together.
_TOGETHER = 200_000


def walked(columns: DataFrame, alone: int = ALONE) -> tuple[DataFrame, DataFrame | None]:
    """(aln_id, column_id, depth, place) of the columns of alignments of at most `alone`
    residues, each walked in one task; (aln_id, column_id, depth) of larger ones, peeled by
    joins over all tasks, or None without any. See column_depths and linearize_columns."""

    def walk(rows: pa.RecordBatch) -> pa.RecordBatch:
        """Of whole alignments, whose residues come by sequence and position."""
        aln, column, sequence = (graphs.coded(rows.column(c)) for c in range(3))
        _, first, node = np.unique(aln * (column.max() + 1) + column, return_index=True, return_inverse=True)
        next_to = (aln[1:] == aln[:-1]) & (sequence[1:] == sequence[:-1])
        depth = graphs.layers(len(first), node[:-1][next_to], node[1:][next_to])
        # Columns are numbered by alignment, then by id.
        own = aln[first]
        order = np.lexsort((np.where(depth < 0, len(first), depth), own))
        place = np.empty(len(first), np.int64)
        place[order] = np.arange(len(first)) - np.searchsorted(own[order], own[order])
        names = [rows.column(c).take(pa.array(first)) for c in (0, 1)]
        return pa.RecordBatch.from_arrays([*names, *(pa.array(v, pa.int32(), mask=depth < 0) for v in (depth, place))], names=["aln_id", "column_id", "depth", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(walk, graphs.whole(batches, _TOGETHER))

    large = few(saved(columns.groupBy("aln_id").agg(F.count("*").alias("n")).where(F.col("n") > alone).select("aln_id"), "large"))
    some = not large.isEmpty()
    small = columns.join(large, "aln_id", "left_anti") if some else columns
    listed = small.select("aln_id", "column_id", "sequence_id", "pos").repartition("aln_id").sortWithinPartitions("aln_id", "sequence_id", "pos")
    found = listed.mapInArrow(run, "aln_id string, column_id string, depth int, place int")
    if not some:
        return found, None
    of_large = lambda df, name: saved(df.join(large, "aln_id", "left_semi"), name)
    return found, peeled(of_large(column_arcs(columns), "arcs"), of_large(columns.select("aln_id", "column_id").distinct(), "nodes"))


def column_depths(columns: DataFrame, alone: int = ALONE) -> DataFrame:
    """(aln_id, column_id, depth): the most columns that a path passes before a column; null
    on or behind a cycle."""
    small, large = walked(columns, alone)
    found = small.select("aln_id", "column_id", "depth")
    return found if large is None else found.union(large)


def linearize_columns(columns: DataFrame, alone: int = ALONE) -> DataFrame:
    """(aln_id, column_id, place): columns in a topological order, by depth and then by id.
    A cycle is an error."""
    cycle = F.raise_error(F.concat(F.lit("the columns form a cycle in "), "aln_id")).cast("int")
    small, large = walked(columns, alone)
    found = small.select("aln_id", "column_id", F.coalesce("place", cycle).alias("place"))
    if large is None:
        return found
    known = large.select("aln_id", "column_id", F.coalesce("depth", cycle).alias("depth"))
    return found.union(numbered_within(known, "place", "aln_id", "depth", "column_id").select("aln_id", "column_id", F.col("place").cast("int").alias("place")))


def render_alignment(columns: DataFrame, sequences: DataFrame, places: DataFrame, only: DataFrame | None = None, gap: str = "-") -> DataFrame:
    """(aln_id, sequence_id, row): letters under their columns, padded to the longest
    letter, with a tab after each cell if letters are longer than one character.
    only: (aln_id, sequence_id) to show; columns without any of them are left out."""
    letters = sequences.select(F.col("group_id").alias("aln_id"), "sequence_id", F.posexplode("letters").alias("pos", "letter"))
    cells = columns.join(letters, ["aln_id", "sequence_id", "pos"]).select("aln_id", "column_id", "sequence_id", "letter")
    ids = sequences.select(F.col("group_id").alias("aln_id"), "sequence_id", F.array_max(F.transform("letters", F.length)).alias("_width"))
    width = ids.groupBy("aln_id").agg(F.max("_width").alias("width"))
    if only is not None:
        ids = ids.join(only.select("aln_id", "sequence_id").distinct(), ["aln_id", "sequence_id"], "left_semi")
        cells = cells.join(only.select("aln_id", "sequence_id").distinct(), ["aln_id", "sequence_id"], "left_semi")
    # Gaps are written between a row's own cells: no row is listed for them.
    used = unpacked(saved(places.join(cells.select("aln_id", "column_id").distinct(), ["aln_id", "column_id"], "left_semi"), "used"))
    used = numbered_within(used, "_at", "aln_id", "place")
    size = used.groupBy("aln_id").agg(F.count("*").cast("int").alias("_n")).join(width, "aln_id")
    placed = cells.join(used.select("aln_id", "column_id", F.col("_at").cast("int").alias("at")), ["aln_id", "column_id"])
    own = placed.groupBy("aln_id", "sequence_id").agg(F.array_sort(F.collect_list(F.struct("at", "letter"))).alias("_own"))
    rows = ids.select("aln_id", "sequence_id").join(size, "aln_id").join(own, ["aln_id", "sequence_id"], "left").withColumn("_own", F.coalesce("_own", F.array().cast("array<struct<at:int,letter:string>>")))

    def cell(letter: Column) -> Column:
        padded = F.rpad(F.coalesce(letter, F.lit(gap)), F.col("width"), " ")
        return F.when(F.col("width") > 1, F.concat(padded, F.lit("\t"))).otherwise(padded)

    before = lambda i: F.coalesce(F.get("_own", i - 1)["at"], F.lit(-1))
    parts = F.transform("_own", lambda c, i: F.concat(F.repeat(cell(F.lit(None).cast("string")), c["at"] - before(i) - 1), cell(c["letter"])))
    end = F.repeat(cell(F.lit(None).cast("string")), F.col("_n") - 1 - before(F.size("_own")))
    return rows.select("aln_id", "sequence_id", F.concat(F.array_join(parts, ""), end).alias("row"))
