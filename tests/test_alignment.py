"""Alignments: a known scenario, and random inputs against a slow checker."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions import graphs
from seqloom.operators import alignment as A
from seqloom.operators import construct as C
from seqloom.operators import metrics as M

SEQS = {"seq-0": "ACA", "seq-1": "CC", "seq-2": "ACC"}
E = {
    "e0": ("seq-0", 1, "seq-1", 0), "e1": ("seq-1", 0, "seq-2", 1), "e2": ("seq-0", 1, "seq-2", 1), "e3": ("seq-0", 0, "seq-2", 2), "e4": ("seq-1", 1, "seq-2", 2),
}
SCORES = {"e0": 100.0, "e1": -5.0, "e2": 10.5, "e3": 1000.0, "e4": -10.0}
EDGE = "aln_id string, seq1 string, pos1 int, seq2 string, pos2 int"


def sequences_of(spark, groups):
    return spark.createDataFrame([(g, s, list(x)) for g, seqs in groups.items() for s, x in seqs.items()], "group_id string, sequence_id string, letters array<string>")


@pytest.fixture(scope="module")
def seqs(spark):
    return sequences_of(spark, {"g": SEQS}).cache()


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame([("g", *E[k], s) for k, s in SCORES.items()], EDGE + ", score double").cache()


def added(spark, seqs, names, initial=None):
    edges = spark.createDataFrame([("g", *E[k], i) for i, k in enumerate(names)], EDGE + ", rank int")
    got = C.try_adding_edges(seqs, edges, initial).collect()
    return [next(r.accepted for r in got if (r.seq1, r.pos1, r.seq2, r.pos2) == E[k]) for k in names]


@pytest.fixture(scope="module")
def align(spark, seqs):
    """e0, e1, e4 accepted."""
    residues = seqs.select(F.col("group_id").alias("aln_id"), "sequence_id", F.posexplode("letters").alias("pos", "l")).drop("l")
    return C.columns_from_edges(residues, spark.createDataFrame([("g", *E[k]) for k in ("e0", "e1", "e4")], EDGE)).cache()


@pytest.fixture(scope="module")
def msa(seqs, scores):
    return C.max_recall_alignment(seqs, scores).cache()


def test_adding(spark, seqs, align):
    assert added(spark, seqs, ["e0", "e1", "e3", "e4"]) == [True, True, False, True]
    assert added(spark, seqs, ["e2", "e3"], align) == [False, False]
    held = A.contains_edge(align, spark.createDataFrame([("g", *E["e2"]), ("g", *E["e3"])], EDGE)).collect()
    assert {(r.seq1, r.pos1, r.seq2, r.pos2): r.contained for r in held} == {E["e2"]: True, E["e3"]: False}
    valid = C.is_valid_addition(seqs, spark.createDataFrame([("g", *E[k]) for k in E], EDGE)).collect()
    assert all(r.valid for r in valid)


def test_counts_and_metrics(seqs, align, msa):
    assert M.n_edges(align).first().n_edges == 4 and M.n_edges(msa).first().n_edges == 2
    acc = M.accuracy(msa, align).first()
    assert math.isclose(acc.edge_f1, 1 / 3) and math.isclose(acc.edge_recall, 0.5) and math.isclose(acc.edge_precision, 0.25) and acc.column_recall == 0
    for columns, aligned, identity in ((align, 19 / 36, 19 / 36), (msa, 1 / 4, 5 / 36)):
        assert math.isclose(M.mean_pair_statistic(columns, seqs).first().value, aligned)
        assert math.isclose(M.mean_pair_statistic(columns, seqs, identical=True).first().value, identity)
    assert math.isclose(M.sequence_summary(seqs).first().mean_length, 8 / 3)
    assert M.alignments_equal(align, align).first().equal and not M.alignments_equal(align, msa).first().equal
    other = seqs.withColumn("letters", F.reverse("letters"))
    assert M.alignments_equal(align, align, seqs, seqs).first().equal and not M.alignments_equal(align, align, seqs, other).first().equal


def test_roc(seqs, scores, align):
    got = C.roc_curve(seqs, scores, align, 2).orderBy("k").collect()
    assert [(r.precision, r.recall, r.posterior) for r in got] == [(0.0, 0.0, 1000.0), (0.5, 0.25, 100.0)]


def test_split_and_union(spark, seqs, align):
    column = align.where("sequence_id = 'seq-0' and pos = 1").first().column_id
    parted = A.split_column(align, spark.createDataFrame([("g", column, "seq-0")], "aln_id string, column_id string, sequence_id string"))
    edges = {tuple(r)[1:] for r in A.edges_of_alignment(parted).collect()}
    assert edges == {("seq-1", 0, "seq-2", 1), ("seq-1", 1, "seq-2", 2)}
    with pytest.raises(Exception, match="kept"):
        A.split_column(align, align.where(F.col("column_id") == column).select("aln_id", "column_id", "sequence_id")).collect()
    united = A.union_alignments(align, align)
    assert united.where("not valid").count() == 0 and M.alignments_equal(united.drop("valid"), align).first().equal
    assert A.union_alignments(align, align, strict=True).where("valid").count() == 0
    with pytest.raises(Exception, match="different letters"):
        A.union_sequences(seqs, seqs.withColumn("letters", F.array(F.lit("Z")))).collect()


def test_validity(spark):
    rows = [("twice", "c", "s", 0), ("twice", "c", "s", 1), ("cross", "x", "a", 0), ("cross", "y", "a", 1), ("cross", "y", "b", 0), ("cross", "x", "b", 1), ("good", "x", "a", 0), ("good", "x", "b", 0)]
    got = C.validate_alignment(spark.createDataFrame(rows, "aln_id string, column_id string, sequence_id string, pos int")).collect()
    assert {r.aln_id: r.valid for r in got} == {"twice": False, "cross": False, "good": True}
    with pytest.raises(Exception, match="cycle"):
        A.linearize_columns(spark.createDataFrame(rows[2:6], "aln_id string, column_id string, sequence_id string, pos int")).collect()


def test_columns_stay_in_order():
    """After each merge the places follow all successions of residues."""
    rng = random.Random(12)
    for _ in range(60):
        lengths = [rng.randint(0, 6) for _ in range(rng.randint(2, 5))]
        columns, n = graphs.Columns(lengths), sum(lengths)
        for _ in range(3 * n):
            columns.merge(rng.randrange(n), rng.randrange(n))
            for r in range(n):
                if r not in columns.last:
                    assert columns.rank[columns.column[r]] < columns.rank[columns.column[r + 1]]
            assert all(columns.order[columns.rank[c]] == c for c in columns.members)


def test_mean_statistic_is_the_mean_of_pairs(spark, seqs, align, msa):
    more = sequences_of(spark, {"g": SEQS, "one": {"a": "AC"}, "empty": {"a": "AC", "b": ""}, "apart": {"a": "AC", "b": "A"}})
    for columns in (align, msa):
        for identical in (False, True):
            want = {r.aln_id: r.v for r in M.pair_statistic(columns, more, identical).groupBy("aln_id").agg(F.avg("value").alias("v")).collect()}
            got = {r.aln_id: r.value for r in M.mean_pair_statistic(columns, more, identical).collect()}
            assert set(got) == {"g", "one", "empty", "apart"} and math.isnan(got["one"]) and math.isnan(got["empty"]) and math.isnan(want["empty"])
            assert math.isclose(got["g"], want["g"]) and got["apart"] == want["apart"] == 0


def slow_consensus(seqs, edges, threshold):
    """Links added one by one; after each the whole column graph is checked for cycles."""
    column = {(s, i): (s, i) for s, x in seqs.items() for i in range(len(x))}
    for s1, p1, s2, p2, score in sorted(edges, key=lambda e: (-e[4], *e[:4])):
        a, b = column[s1, p1], column[s2, p2]
        if score <= threshold or a == b:
            continue
        trial = {r: (a if c == b else c) for r, c in column.items()}
        members = [r[0] for r, c in trial.items() if c == a]
        arcs = {(trial[s, i], trial[s, i + 1]) for s, x in seqs.items() for i in range(len(x) - 1)}
        if len(set(members)) == len(members) and len(graphs.depths(set(trial.values()), arcs)) == len(set(trial.values())) and not any(u == v for u, v in arcs):
            column = trial
    out: dict = {}
    for r, c in column.items():
        out.setdefault(c, []).append(r)
    return {frozenset(m) for m in out.values()}


def test_consensus_against_slow_checker(spark):
    rng = random.Random(6)
    groups, edges = {}, []
    for g in range(12):
        seqs = {f"s{i}": "x" * rng.randint(0, 5) for i in range(rng.randint(1, 4))}
        groups[f"g{g}"] = seqs
        places = [(s, i) for s, x in seqs.items() for i in range(len(x))]
        for a in places:
            for b in places:
                if a[0] < b[0] and rng.random() < 0.7:
                    edges.append((f"g{g}", *a, *b, rng.choice([0.1, 0.2, 0.3, rng.random()])))
    df, frame = sequences_of(spark, groups), spark.createDataFrame(edges, EDGE + ", score double")
    by = lambda rows: {g: {frozenset((r.sequence_id, r.pos) for r in rows if r.aln_id == g and r.column_id == c) for c in {r.column_id for r in rows if r.aln_id == g}} for g in groups}
    grid = C.consensus_grid(df, frame, [0.0, 0.25, 0.6]).collect()
    for t in (0.0, 0.25, 0.6):
        want = {g: slow_consensus(s, [e[1:] for e in edges if e[0] == g], t) for g, s in groups.items()}
        assert by(C.consensus_alignment(df, frame, t).collect()) == want
        assert by([r for r in grid if r.threshold == t]) == want
    assert C.validate_alignment(C.consensus_alignment(df, frame, 0.0)).where("not valid").count() == 0


def test_comparison_against_listed_edges(spark):
    rng = random.Random(8)
    rows = {"a": [], "b": []}
    for g in range(6):
        for s in range(4):
            for side in rows:
                rows[side] += [(f"g{g}", str(k), f"s{s}", i) for i, k in enumerate(sorted(rng.sample(range(7), 5)))]
    from seqloom.sources.views import named_columns

    one, two = (named_columns(spark.createDataFrame(r, "aln_id string, k string, sequence_id string, pos int"), "k") for r in rows.values())
    got = {r.aln_id: r for r in M.comparison(one, two).collect()}
    a, b = ({tuple(r) for r in A.edges_of_alignment(x).collect()} for x in (one, two))
    shared = {(r.aln_id, r.column_id) for r in A.shared_columns(one, two).collect()}
    sizes = {(r.aln_id, r.column_id): r.n for r in A.column_sizes(one).collect()}
    for g, r in got.items():
        assert (r.gold_edges, r.guess_edges, r.shared_edges) == (sum(e[0] == g for e in a), sum(e[0] == g for e in b), sum(e[0] == g for e in a & b))
        assert r.gold_columns == sum(k[0] == g and n > 1 for k, n in sizes.items())
        assert r.shared_columns == sum(k[0] == g and sizes[k] > 1 for k in shared)


def test_nan_where_nothing_is_to_be_found(spark):
    single = spark.createDataFrame([("g", "a:0", "a", 0)], "aln_id string, column_id string, sequence_id string, pos int")
    r = M.accuracy(single, single).first()
    assert all(math.isnan(v) for v in (r.edge_recall, r.edge_precision, r.edge_f1, r.column_recall))
    lone = spark.createDataFrame([("g", "a", [])], "group_id string, sequence_id string, letters array<string>")
    assert math.isnan(M.mean_pair_statistic(single, lone).first().value)
