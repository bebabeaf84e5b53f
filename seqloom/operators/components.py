"""Residues that links join, however many there are in one alignment.

Alignments of up to HELD rows are closed where they lie, whole ones at a time. Links of
larger ones are contracted by each task to a forest; forests of different tasks are joined
by large-star and small-star steps, which bring every node to the least of its component in
about as many rounds as the logarithm of a component's size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import graphs
from ..sources.shared import few, saved

#: Rows of an alignment that one task takes whole, and links that a task contracts at once.
HELD = 1_000_000
#: Rows of small alignments that are worked on together.
TOGETHER = 200_000

_FOREST = "aln_id string, sequence_id string, pos int, to_id string, to_pos int"


def links_as_rows(links: DataFrame) -> DataFrame:
    return links.select("aln_id", "seq1", F.col("pos1").cast("int").alias("pos1"), "seq2", F.col("pos2").cast("int").alias("pos2"))


def closed(rows: pa.RecordBatch) -> pa.RecordBatch:
    """(aln_id, sequence_id, pos, to_id, to_pos) for links (aln_id, seq1, pos1, seq2, pos2):
    the residues with the least that they are joined to. Rows without seq2 name the residues
    to give, themselves among them; without such rows, linked ones that are not the least."""
    n = rows.num_rows
    aln, ids = graphs.coded(rows.column(0)), graphs.coded(pa.concat_arrays([rows.column(1), rows.column(3)]))
    pos = np.append(*(rows.column(c).fill_null(-1).to_numpy(zero_copy_only=False) for c in (2, 4))).astype(np.int64)
    linked = np.asarray(rows.column(3).is_valid())
    at = np.append(np.arange(n), n + np.flatnonzero(linked))
    of = np.unique(np.append(aln, aln)[at] * (ids.max(initial=0) + 1) + ids[at], return_inverse=True)[1]
    low = pos[at].min(initial=0)
    _, first, node = np.unique(of * (pos[at].max(initial=0) - low + 1) + pos[at] - low, return_index=True, return_inverse=True)
    least = graphs.least_joined(len(first), node[:n][linked], node[n:])
    given = np.zeros(len(first), bool)
    given[node[:n][~linked]] = True
    given = np.flatnonzero(least != np.arange(len(first)) if linked.all() else given)
    names, places = pa.concat_arrays([rows.column(1), rows.column(3)]), pa.array(pos, pa.int32())
    own, to = at[first[given]], at[first[least[given]]]
    columns = [rows.column(0).take(pa.array(own % n)), names.take(pa.array(own)), places.take(pa.array(own)), names.take(pa.array(to)), places.take(pa.array(to))]
    return pa.RecordBatch.from_arrays(columns, names=["aln_id", "sequence_id", "pos", "to_id", "to_pos"])


def large_alignments(rows: DataFrame, held: int) -> DataFrame:
    return few(saved(rows.groupBy("aln_id").agg(F.count("*").alias("n")).where(F.col("n") > held).select("aln_id"), "large"))


def closed_alone(rows: DataFrame) -> DataFrame:
    """`closed` of alignments that a task takes whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(closed, graphs.whole(batches, TOGETHER))

    return rows.repartition("aln_id").sortWithinPartitions("aln_id").mapInArrow(run, _FOREST)


def forests(links: DataFrame, held: int = HELD) -> DataFrame:
    """(aln_id, sequence_id, pos, to_id, to_pos): each linked residue of a task with the
    least one that it is joined to there, itself left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept += [batch] * bool(batch.num_rows)
            if sum(b.num_rows for b in kept) > held:
                yield closed(graphs.as_one(kept))
                kept.clear()
        if kept:
            yield closed(graphs.as_one(kept))

    # By alignment, where a large one is spread over tasks.
    return links_as_rows(links).hint("rebalance", "aln_id").mapInArrow(run, _FOREST)


def stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (aln_id, a, b), b below a."""
    both = edges.union(edges.select("aln_id", F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("aln_id", "a").agg(F.min("b").alias("m"))
    least = least.select("aln_id", "a", F.least("m", "a").alias("m"))
    large = both.join(least, ["aln_id", "a"]).where("b > a and b <> m").select("aln_id", F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("aln_id", "a").agg(F.min("b").alias("m"))
    small = large.join(least, ["aln_id", "a"]).where("b <> m").select("aln_id", F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(least.select("aln_id", "a", F.col("m").alias("b"))).distinct()


def unsettled(edges: DataFrame) -> bool:
    """Is there a node with two lower neighbours, or one that is both above and below another?"""
    up = edges.select("aln_id", F.col("a").alias("v"), F.col("b").alias("up"), F.lit(False).alias("root"))
    down = edges.select("aln_id", F.col("b").alias("v"), F.lit(None).cast(edges.schema["b"].dataType).alias("up"), F.lit(True).alias("root"))
    seen = up.union(down).groupBy("aln_id", "v").agg(F.min("up").alias("low"), F.max("up").alias("high"), F.max("root").alias("root"))
    return not seen.where("low < high or (low is not null and root)").isEmpty()


def components(links: DataFrame, held: int = HELD) -> DataFrame:
    """(aln_id, sequence_id, pos, least) for the linked residues that are not the least of
    their component: least is a struct of the sequence_id and pos of that one."""
    rows = saved(links_as_rows(links), "links")
    large = large_alignments(rows, held)
    if large.isEmpty():
        return named_least(closed_alone(rows))
    small = closed_alone(rows.join(large, "aln_id", "left_anti"))
    return named_least(small).union(components_over_tasks(rows.join(large, "aln_id", "left_semi"), held))


def named_least(found: DataFrame) -> DataFrame:
    return found.select("aln_id", "sequence_id", "pos", F.struct(F.col("to_id").alias("sequence_id"), F.col("to_pos").alias("pos")).alias("least"))


def components_over_tasks(links: DataFrame, held: int = HELD) -> DataFrame:
    """components of large alignments."""
    found = named_least(forests(links, held))
    edges = saved(found.select("aln_id", F.struct("sequence_id", "pos").alias("a"), F.col("least").alias("b")), "forests")
    while unsettled(edges):
        edges = saved(stars(edges), "stars")
    return edges.select("aln_id", "a.sequence_id", "a.pos", F.col("b").alias("least")).distinct()
