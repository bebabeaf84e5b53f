"""Building alignments from links. The greedy merge depends on its order, so that what is
linked of one alignment is built in one task, as its links pass by in order; alignments,
and parts of large ones that no link joins, are spread over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import graphs
from ..functions.letters import ratio
from ..sources.shared import few, saved
from ..sources.views import column_name
from .alignment import ALONE, canonical_edges, column_depths
from .components import HELD, closed_alone, components, components_over_tasks, large_alignments, links_as_rows

#: Sequences of a group from which parts that no link joins are built by themselves.
SPLIT_OVER = 1000
#: Residues of an alignment up to which all pairs of its columns are listed.
LISTED = 4096
#: Residues of an alignment up to which one task holds all its links: half a million of them.
SMALL = 1000
#: What a row of a stream holds, in the order in which one alignment's rows come.
SEQUENCE, INITIAL, NAMED, LINK = range(4)

_STREAM = ("aln_id", "piece", "kind", "seq1", "pos1", "seq2", "pos2", "score")


def validate_alignment(columns: DataFrame, alone: int = ALONE) -> DataFrame:
    """(aln_id, valid): no column has two residues of a sequence, and there is no cycle. The
    first is a case of the second, as a path leads along a sequence from one to the other."""
    return column_depths(columns, alone).groupBy("aln_id").agg((F.count("*") == F.count("depth")).alias("valid"))


def independent_pieces(sequences: DataFrame, edges: DataFrame, over: int = SPLIT_OVER) -> tuple[DataFrame, DataFrame]:
    """sequences and edges with `piece`: parts of groups of more than `over` sequences that
    no edge joins. No path leads from one part to another, so that each is merged by itself."""
    large = few(saved(sequences.groupBy("group_id").agg(F.count("*").alias("_n")).where(F.col("_n") > over).select(F.col("group_id").alias("aln_id")), "large"))
    if large.isEmpty():
        return sequences.withColumn("piece", F.lit("")), edges.withColumn("piece", F.lit(""))
    edges = saved(edges, "links")
    joined = edges.join(large, "aln_id", "left_semi").select("aln_id", "seq1", F.lit(0).alias("pos1"), "seq2", F.lit(0).alias("pos2")).distinct()
    part_of = saved(components(joined).select("aln_id", "sequence_id", F.col("least.sequence_id").alias("_part")), "pieces")
    marked = few(large.withColumn("_large", F.lit(True)))
    named = lambda df, aln, of: (
        df.join(marked.withColumnRenamed("aln_id", aln), aln, "left")
        .join(part_of.select(F.col("aln_id").alias(aln), F.col("sequence_id").alias(of), "_part"), [aln, of], "left")
        .withColumn("piece", F.when(F.col("_large"), F.coalesce("_part", of)).otherwise(F.lit(""))).drop("_large", "_part")
    )
    return named(sequences, "group_id", "sequence_id"), named(edges, "aln_id", "seq1")


def stream(sequences: DataFrame, edges: DataFrame, initial: DataFrame | None = None, reference: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """Rows of all alignments, each alignment's in one task and in order: its sequences, the
    columns of an initial and of a reference alignment, and its links, best first unless not
    `ordered`."""
    piece = lambda df: F.col("piece") if "piece" in df.columns else F.lit("")
    if "rank" in edges.columns:  # an order of their own
        score = -F.col("rank").cast("double")
    else:
        score = F.col("score").cast("double") if "score" in edges.columns else F.lit(0.0)
    none = F.lit(None)
    rows = sequences.select(F.col("group_id").alias("aln_id"), piece(sequences).alias("piece"), F.lit(SEQUENCE).alias("kind"), F.col("sequence_id").alias("seq1"), F.size("letters").alias("pos1"), none.cast("string").alias("seq2"), none.cast("int").alias("pos2"), none.cast("double").alias("score"))
    for kind, columns in ((INITIAL, initial), (NAMED, reference)):
        if columns is not None:
            rows = rows.union(columns.select("aln_id", F.lit(""), F.lit(kind), "sequence_id", F.col("pos").cast("int"), "column_id", none.cast("int"), none.cast("double")))
    rows = rows.union(edges.select("aln_id", piece(edges), F.lit(LINK), "seq1", F.col("pos1").cast("int"), "seq2", F.col("pos2").cast("int"), score))
    order = ("aln_id", "piece", "kind", F.desc_nulls_last("score"), "seq1", "pos1", "seq2", "pos2")[: None if ordered else 3]
    return rows.repartition("aln_id", "piece").sortWithinPartitions(*order).select(*_STREAM)


class Built:
    """One alignment, or piece of one, as columns of residues."""

    def __init__(self, aln_id: str, sequences: list[tuple[str, int]]):
        self.aln_id = aln_id
        self.ids = [s for s, _ in sequences]
        self.number = {s: i for i, s in enumerate(self.ids)}
        self.columns = graphs.Columns([n for _, n in sequences])
        self.together: dict[str, int] = {}
        #: Columns of the reference by residue.
        self.named: dict[int, str] = {}

    def residue(self, sequence_id: str, pos: int) -> int:
        return self.columns.first[self.number[sequence_id]] + pos

    def hold(self, sequence_id: str, pos: int, column_id: str) -> None:
        """Put a residue into a column of the initial alignment."""
        r = self.residue(sequence_id, pos)
        first = self.together.setdefault(column_id, r)
        if not self.columns.merge(first, r) and first != r:
            raise ValueError(f"the initial alignment {self.aln_id} is not valid")

    def name(self, sequence_id: str, pos: int, column_id: str) -> None:
        if sequence_id in self.number:
            self.named[self.residue(sequence_id, pos)] = column_id

    def merge(self, edge: tuple) -> bool:
        return self.columns.merge(self.residue(edge[0], edge[1]), self.residue(edge[2], edge[3]))

    def rows(self) -> Iterator[tuple]:
        """(aln_id, column_id, sequence_id, pos); a column is named for its least residue."""
        for members in self.columns.groups():
            places = sorted((self.ids[s], p) for s, p in map(self.columns.place, members))
            name = f"{places[0][0]}:{places[0][1]}"
            for s, p in places:
                yield self.aln_id, name, s, p


_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
#: Rows that a task hands on at once.
_OUT = 50_000

Take = Callable[[tuple], Iterator[tuple]]


@dataclass
class Links:
    """Successive links of one alignment: their residues, their scores, and their rows."""

    built: Built
    a: list[int]
    b: list[int]
    score: list[float]
    #: (aln_id, seq1, pos1, seq2, pos2, score), made when they are asked for.
    made: Callable[[], pa.RecordBatch]

    @property
    def rows(self) -> pa.RecordBatch:
        return self.made()

    def edges(self) -> Iterator[tuple]:
        """(seq1, pos1, seq2, pos2, score) of each."""
        return zip(*(c.to_pylist() for c in self.rows.columns[1:]), strict=True)

    def with_flags(self, flags: list[bool] | np.ndarray) -> pa.RecordBatch:
        """The links, of one alignment, with a flag each."""
        rows = self.rows
        return pa.RecordBatch.from_arrays([*rows.columns[:5], pa.array(flags, pa.bool_())], names=["aln_id", *_STREAM[3:7], "flag"])


def per_alignment(rows: DataFrame, schema: str, make: Callable[[Built], tuple[Take | None, Callable[[], Iterator[tuple]] | None]]) -> DataFrame:
    """per_links for functions that take one link (seq1, pos1, seq2, pos2, score) at a time."""

    def one_by_one(built: Built):
        take, close = make(built)
        return (lambda links: [row for edge in links.edges() for row in take(edge)]) if take is not None else None, close

    return per_links(rows, schema, one_by_one)


def rows_of(schema: str) -> Callable[[list[tuple]], pa.RecordBatch]:
    """Tuples as a batch of the schema."""
    fields = [f.split() for f in schema.split(", ")]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[]] * len(fields)
        return pa.record_batch([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    return batch_of


def per_links(rows: DataFrame, schema: str, make: Callable[[Built], tuple[Callable[[Links], Iterable[tuple] | pa.RecordBatch] | None, Callable[[], Iterable[tuple]] | None]]) -> DataFrame:
    """Rows that the functions of `make` give for each alignment of a stream: one for the
    links that come by together, some rows or a batch of them, one after the last. What is
    held is one alignment's columns, never its links. Links without sequences are passed over."""
    batch_of, names = rows_of(schema), [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        parts: list[pa.RecordBatch] = []
        held, listed, built, take, close = None, [], None, None, None

        def given() -> Iterator[pa.RecordBatch]:
            """What has come together, small batches as one."""
            if parts:
                yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                parts.clear()
            if out:
                yield batch_of(out)
                out.clear()

        def start() -> None:
            nonlocal built, take, close
            built = Built(held[0], listed)
            take, close = make(built)

        def closed() -> Iterator[pa.RecordBatch]:
            if listed and built is None:
                start()
            if close is not None:
                for row in close():
                    out.append(row)
                    if len(out) >= _OUT:
                        yield from given()

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            # Where another alignment, piece or kind begins.
            differs = np.zeros(n, bool)
            differs[0] = True
            for name in ("aln_id", "piece", "kind"):
                codes = coded(batch.column(name))[0]
                differs[1:] |= codes[1:] != codes[:-1]
            first = np.flatnonzero(differs).tolist()
            ids, kinds = (batch.column(c).take(pa.array(first)).to_pylist() for c in ("aln_id", "kind"))
            pieces = batch.column("piece").take(pa.array(first)).to_pylist()
            residues = Residues(batch)
            for i, j, aln_id, piece, kind in zip(first, [*first[1:], n], ids, pieces, kinds, strict=True):
                if held is None or aln_id != held[0] or piece != held[1]:
                    yield from closed()
                    held, listed, built, take, close = (aln_id, piece), [], None, None, None
                if kind == SEQUENCE:
                    listed.extend(zip(batch.column("seq1")[i:j].to_pylist(), batch.column("pos1")[i:j].to_pylist(), strict=True))
                    continue
                if built is None:
                    if not listed:
                        continue
                    start()
                if kind == LINK:
                    if take is None:
                        continue
                    a, b = residues.of(built, i, j)
                    got = take(Links(built, a, b, residues.score[i:j].tolist(), partial(batch.select(["aln_id", *_STREAM[3:]]).slice, i, j - i)))
                    if isinstance(got, pa.RecordBatch):
                        parts.append(got.rename_columns(names))
                    else:
                        for row in got:
                            out.append(row)
                            if len(out) >= _OUT:
                                yield from given()
                else:
                    put = built.hold if kind == INITIAL else built.name
                    for row in zip(*(batch.column(c)[i:j].to_pylist() for c in ("seq1", "pos1", "seq2")), strict=True):
                        put(*row)
            if len(out) >= _OUT or sum(p.num_rows for p in parts) >= _OUT:
                yield from given()
        yield from closed()
        yield from given()

    return rows.mapInArrow(run, schema)


def coded(column: pa.Array) -> tuple[np.ndarray, list]:
    """Numbers for the values of a column, and the values."""
    found = column.dictionary_encode()
    return found.indices.fill_null(-1).to_numpy(zero_copy_only=False), found.dictionary.to_pylist()


class Residues:
    """The links of a batch of a stream as numbers of residues."""

    def __init__(self, batch: pa.RecordBatch):
        sides = [coded(batch.column(c)) for c in ("seq1", "seq2")]
        self.codes = [c for c, _ in sides]
        self.number = [{s: i for i, s in enumerate(values)} for _, values in sides]
        self.first = [np.full(len(values), -1, np.int64) for _, values in sides]
        self.pos = [batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("pos1", "pos2")]
        self.score = batch.column("score").to_numpy(zero_copy_only=False)

    def of(self, built: Built, i: int, j: int) -> tuple[list[int], list[int]]:
        """Both residues of the links i to j, all of one alignment."""
        out = []
        for codes, number, first, pos in zip(self.codes, self.number, self.first, self.pos, strict=True):
            own = codes[i:j]
            for c in set(own.tolist()) if j - i < len(first) else range(len(first)):
                first[c] = -1
            some = [(c, f) for s, f in zip(built.ids, built.columns.first, strict=True) if (c := number.get(s)) is not None] if len(built.ids) <= j - i else None
            if some is None:  # more sequences than links
                values = list(number)
                some = [(c, built.columns.first[built.number[values[c]]]) for c in set(own.tolist()) if values[c] in built.number]
            for c, f in some:
                first[c] = f
            at = first[own]
            if at.min() < 0:
                raise KeyError(f"a link of {built.aln_id} names a sequence that it has not")
            out.append((at + pos[i:j]).tolist())
        return out[0], out[1]


def packed(edges: DataFrame) -> bool:
    """Do edges come as lists, a row a pair of sequences: (aln_id, seq1, seq2, width, cells,
    scores), where a cell is pos1 * width + pos2?"""
    return "cells" in edges.columns


def listed_links(edges: DataFrame, over: float | None = None) -> DataFrame:
    """A row for each link of a score above `over`, seq1 < seq2."""
    if packed(edges):
        each = edges.select("aln_id", "seq1", "seq2", "width", F.explode(F.arrays_zip("cells", "scores")).alias("_c"))
        edges = each.select("aln_id", "seq1", F.floor(F.col("_c.cells") / F.col("width")).cast("int").alias("pos1"), "seq2", F.pmod("_c.cells", "width").alias("pos2"), F.col("_c.scores").alias("score"))
    return canonical_edges(edges if over is None else edges.where(F.col("score") > over))


def of_each(sequences: DataFrame, edges: DataFrame, schema: str, make: Callable, initial: DataFrame | None = None, reference: DataFrame | None = None, ordered: bool = True, over: float | None = None, apart: bool = False, small: int = SMALL) -> DataFrame:
    """What `make` gives (see per_links) for each alignment, from its links of a score above
    `over`. Links of alignments of up to `small` residues stay where they were made, if they
    were made by alignment, and are put in order there; those of larger ones pass by in
    `stream`, `apart` in the pieces that no link joins."""
    sizes = saved(sequences.groupBy("group_id").agg(F.sum(F.size("letters")).alias("_n")).groupBy((F.col("_n") > small).alias("_large")).agg(F.collect_list(F.when(F.col("_n") > small, F.col("group_id"))).alias("ids")), "sizes")
    kinds = {r["_large"] for r in sizes.select("_large").collect()}
    if True not in kinds:
        return per_table(sequences, edges, schema, make, initial, reference, ordered, over)
    parts = []
    large = few(sizes.where("_large").select(F.explode("ids").alias("aln_id")))
    of = lambda df, how, name="aln_id": df if df is None or False not in kinds else df.join(large.withColumnRenamed("aln_id", name), name, how)
    if False in kinds:
        rest = (of(df, "left_anti") for df in (initial, reference))
        parts.append(per_table(of(sequences, "left_anti", "group_id"), of(edges, "left_anti"), schema, make, *rest, ordered, over))
    s, e = of(sequences, "left_semi", "group_id"), listed_links(of(edges, "left_semi"), over)
    parts.append(per_links(stream(*(independent_pieces(s, e) if apart else (s, e)), of(initial, "left_semi"), of(reference, "left_semi"), ordered), schema, make))
    return reduce(DataFrame.union, parts)


def per_table(sequences: DataFrame, edges: DataFrame, schema: str, make: Callable, initial: DataFrame | None, reference: DataFrame | None, ordered: bool, over: float | None) -> DataFrame:
    """of_each for alignments whose links one task holds. Spark brings the two sides of an
    alignment together, and shuffles links only if they are not parted by alignment yet."""
    none = F.lit(None)
    rows = sequences.select(F.col("group_id").alias("aln_id"), F.lit(SEQUENCE).alias("kind"), F.col("sequence_id").alias("seq1"), F.size("letters").alias("pos1"), none.cast("string").alias("column_id"))
    for kind, columns in ((INITIAL, initial), (NAMED, reference)):
        if columns is not None:
            rows = rows.union(columns.select("aln_id", F.lit(kind), "sequence_id", F.col("pos").cast("int"), "column_id"))
    if packed(edges):
        links = edges.select("aln_id", "seq1", "seq2", "width", "cells", "scores")
    else:
        kept = listed_links(edges, over)
        score = -F.col("rank").cast("double") if "rank" in kept.columns else F.col("score").cast("double") if "score" in kept.columns else F.lit(0.0)
        links = kept.select("aln_id", "seq1", F.col("pos1").cast("int").alias("pos1"), "seq2", F.col("pos2").cast("int").alias("pos2"), score.alias("score"))
    batch_of, names = rows_of(schema), [f.split()[0] for f in schema.split(", ")]

    def each(key: tuple, own: pa.Table, linked: pa.Table) -> pa.Table:
        listed, held = [], {INITIAL: [], NAMED: []}
        for kind, *row in zip(*(own.column(c).to_pylist() for c in ("kind", "seq1", "pos1", "column_id")), strict=True):
            listed.append(tuple(row[:2])) if kind == SEQUENCE else held[kind].append(row)
        out: list = []
        if listed:
            built = Built(key[0].as_py(), sorted(listed))
            take, close = make(built)
            for kind, put in ((INITIAL, built.hold), (NAMED, built.name)):
                for row in held[kind]:
                    put(*row)
            found = as_links(built, linked, ordered, over) if linked.num_rows and take is not None else None
            if found is not None:
                got = take(found)
                if isinstance(got, pa.RecordBatch):
                    return pa.Table.from_batches([got.rename_columns(names)])
                out.extend(got)
            if close is not None:
                out.extend(close())
        return pa.Table.from_batches([batch_of(out)])

    return rows.groupBy("aln_id").cogroup(links.groupBy("aln_id")).applyInArrow(each, schema)


def as_links(built: Built, linked: pa.Table, ordered: bool, over: float | None) -> Links | None:
    """Links of one alignment, or lists of them, best first unless not `ordered`."""
    rows = linked.combine_chunks().to_batches()[0]
    column = {n: rows.column(n) for n in rows.schema.names}
    if "cells" in column:
        times = np.diff(column["cells"].offsets.to_numpy())
        cells, score = column["cells"].flatten().to_numpy(), column["scores"].flatten().to_numpy()
        of = np.repeat(np.arange(rows.num_rows), times)
        pos = list(np.divmod(cells, column["width"].to_numpy()[of]))
        kept = np.flatnonzero(score > over) if over is not None else np.arange(len(score))
        of, pos, score = of[kept], [p[kept] for p in pos], score[kept]
    else:
        of, pos, score = np.arange(rows.num_rows), [column[f"pos{i}"].to_numpy() for i in (1, 2)], column["score"].to_numpy(zero_copy_only=False)
    if not len(of):
        return None
    firsts = []
    for name in ("seq1", "seq2"):
        values = column[name].dictionary_encode()
        ids = values.dictionary.to_pylist()
        if any(i not in built.number for i in ids):
            raise KeyError(f"a link of {built.aln_id} names a sequence that it has not")
        firsts.append(np.array([built.columns.first[built.number[i]] for i in ids])[values.indices.to_numpy()][of])
    ends = [f + p for f, p in zip(firsts, pos, strict=True)]
    if ordered:
        # Residues are numbered by sequence and position.
        order = np.lexsort((ends[1], ends[0], np.where(np.isnan(score), np.inf, -score)))
        of, score, ends = of[order], score[order], [e[order] for e in ends]

    def made() -> pa.RecordBatch:
        at, (a, b) = pa.array(of), (e - f[order] if ordered else e - f for e, f in zip(ends, firsts, strict=True))
        arrays = [pa.array([built.aln_id] * len(of), pa.string()), column["seq1"].take(at), pa.array(a, pa.int32()), column["seq2"].take(at), pa.array(b, pa.int32()), pa.array(score)]
        return pa.RecordBatch.from_arrays(arrays, names=["aln_id", *_STREAM[3:]])

    return Links(built, ends[0].tolist(), ends[1].tolist(), score.tolist(), made)


_COLUMNS = "aln_id string, column_id string, sequence_id string, pos int"


def consensus_alignment(sequences: DataFrame, edges: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Columns after adding the edges with score > threshold, best first, where they fit.
    Residues and alignments without any edge come out as single columns."""

    def make(built: Built):
        def take(links: Links):
            built.columns.merge_all(links.a, links.b)
            return ()

        return take, built.rows

    return of_each(sequences, edges, _COLUMNS, make, over=threshold, apart=True)


def max_recall_alignment(sequences: DataFrame, edges: DataFrame) -> DataFrame:
    """All edges of positive score that fit, best first."""
    return consensus_alignment(sequences, edges, 0.0)


def consensus_grid(sequences: DataFrame, edges: DataFrame, thresholds: list[float]) -> DataFrame:
    """consensus_alignment for each threshold, with column `threshold`. What is accepted
    above a threshold is a prefix of what is accepted above a lower one, so that one run
    at the least threshold serves all: links come best first, and the columns are given
    out before the first link that a threshold leaves out."""
    falling = sorted(set(thresholds), reverse=True)

    def make(built: Built):
        left = list(falling)

        def given(down_to: float | None):
            while left and (down_to is None or left[0] >= down_to):
                t = left.pop(0)
                for row in built.rows():
                    yield t, *row

        def take(links: Links):
            done = 0
            while left and left[0] >= links.score[-1]:
                # Up to the first link that the threshold leaves out.
                first = next(i for i in range(done, len(links.score)) if left[0] >= links.score[i])
                built.columns.merge_all(links.a[done:first], links.b[done:first])
                done = first
                yield from given(links.score[first])
            built.columns.merge_all(links.a[done:], links.b[done:])

        return take, lambda: given(None)

    return of_each(sequences, edges, "threshold double, " + _COLUMNS, make, over=min(thresholds), apart=True)


def try_adding_edges(sequences: DataFrame, edges: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """edges with `accepted`, added one after another in order of `rank` (or score) to an
    initial alignment. An edge already implied is not accepted."""

    def make(built: Built):
        return lambda links: links.with_flags(built.columns.merge_all(links.a, links.b)), None

    return of_each(sequences, edges, "aln_id string, seq1 string, pos1 int, seq2 string, pos2 int, accepted boolean", make, initial)


def is_valid_addition(sequences: DataFrame, edges: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """edges with `valid`: would each, alone, be accepted by the initial alignment? Links are
    not put in order, and looked up in what is found once for all columns of an alignment of
    up to LISTED residues."""

    def make(built: Built):
        columns, found = built.columns, []

        def take(links: Links) -> pa.RecordBatch:
            if not found and len(columns.column) <= min(LISTED, 8 * len(links.a)):
                found.extend(columns.blocked())
            if found:
                blocked, at = found
                return links.with_flags(~blocked[at[links.a], at[links.b]])
            return links.with_flags([columns.allowed(a, b) for a, b in zip(links.a, links.b, strict=True)])

        return take, None

    links = edges.select("aln_id", "seq1", "pos1", "seq2", "pos2")
    return of_each(sequences, links, "aln_id string, seq1 string, pos1 int, seq2 string, pos2 int, valid boolean", make, initial, ordered=False)


def columns_from_edges(residues: DataFrame, edges: DataFrame, held: int = HELD) -> DataFrame:
    """The transitive closure of links as columns, checked for nothing. Alignments of at most
    `held` residues and links are closed whole, others over all tasks."""
    links = links_as_rows(edges).where("seq2 is not null")
    nodes = residues.select("aln_id", "sequence_id", F.col("pos").cast("int").alias("pos"))
    rows = saved(nodes.select("aln_id", F.col("sequence_id").alias("seq1"), F.col("pos").alias("pos1"), F.lit(None).cast("string").alias("seq2"), F.lit(None).cast("int").alias("pos2")).union(links), "links")
    large = large_alignments(rows, held)
    some = not large.isEmpty()
    alone = closed_alone(rows.join(large, "aln_id", "left_anti") if some else rows)
    out = alone.select("aln_id", column_name(F.col("to_id"), F.col("to_pos")).alias("column_id"), "sequence_id", "pos")
    if not some:
        return out
    spread = rows.join(large, "aln_id", "left_semi")
    least = components_over_tasks(spread.where("seq2 is not null"), held)
    nodes = spread.where("seq2 is null").select("aln_id", F.col("seq1").alias("sequence_id"), F.col("pos1").alias("pos")).distinct()
    found = nodes.join(least, ["aln_id", "sequence_id", "pos"], "left")
    name = column_name(F.coalesce("least.sequence_id", "sequence_id"), F.coalesce("least.pos", "pos"))
    return out.union(found.select("aln_id", name.alias("column_id"), "sequence_id", "pos"))


def merges(sequences: DataFrame, edges: DataFrame, reference: DataFrame) -> DataFrame:
    """(aln_id, k, score, gained, shared): accepted edges of any score, best first; the
    edges that each closes, and how many of these the reference has."""

    def make(built: Built):
        columns, k = built.columns, 0

        def take(links: Links):
            nonlocal k
            for a, b, score in zip(links.a, links.b, links.score, strict=True):
                if not columns.may_fit(a, b):
                    continue
                left, right = list(columns.members[columns.column[a]]), list(columns.members[columns.column[b]])
                if not columns.merge(a, b):
                    continue
                k += 1
                in_left: dict = {}
                for r in left:
                    in_left[built.named.get(r)] = in_left.get(built.named.get(r), 0) + 1
                shared = sum(in_left.get(built.named[r], 0) for r in right if r in built.named)
                yield built.aln_id, k, score, len(left) * len(right), shared

        return take, None

    return of_each(sequences, edges, "aln_id string, k int, score double, gained long, shared long", make, reference=reference)


def roc_sample_points(accepted: DataFrame, n_points: int) -> DataFrame:
    """Of (aln_id, k, ...) every interval-th row and the last; interval is the number of
    rows over n_points, at least 1."""
    # A window, so that what gives the rows is run once.
    known = accepted.withColumn("_total", F.max("k").over(Window.partitionBy("aln_id")))
    interval = F.greatest(F.floor(F.col("_total") / n_points), F.lit(1))
    known = known.where((F.col("k") == F.col("_total")) | (F.col("k") % interval == 0))
    return known.select(*accepted.columns)


def roc_curve(sequences: DataFrame, edges: DataFrame, reference: DataFrame, n_points: int = 10) -> DataFrame:
    """(aln_id, k, precision, recall, posterior) along the best-first merge, without a threshold."""
    from .metrics import n_edges

    by = Window.partitionBy("aln_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    path = merges(sequences, edges, reference).withColumns({"gained": F.sum("gained").over(by), "shared": F.sum("shared").over(by)})
    points = roc_sample_points(path, n_points).join(n_edges(reference), "aln_id", "left")
    total = F.coalesce("n_edges", F.lit(0))
    return points.select("aln_id", "k", ratio(F.col("shared"), F.col("gained")).alias("precision"), ratio(F.col("shared"), total).alias("recall"), F.col("score").alias("posterior"))
