"""What round 4 found to fail at larger sizes."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom import queries
from seqloom.functions import kernels
from seqloom.functions import letters as L
from seqloom.operators import alignment as A
from seqloom.operators import construct as C
from seqloom.plans import pairs, training
from seqloom.sources import files
from seqloom.sources.views import justified, order_sequences


#: Joins by more than the alignment: a row a column, a sequence or a residue.
BROADCAST_ROWS = re.compile(r"BroadcastHashJoin \[[^\]]*,")


def shown(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("name", ["accuracy", "contains_edge", "alignment_report", "char_at", "identity_statistic"])
def test_rows_of_lists_are_not_broadcast(spark, sf_dir, capsys, name):
    """a small file of lists is many rows, which the driver would have to hold."""
    assert not BROADCAST_ROWS.search(shown(queries.QUERIES[name](spark, sf_dir), capsys))


def test_texts_are_joined_without_the_driver(spark, sf_dir, capsys):
    """what is rendered, for each of the texts that an iteration writes."""
    s = order_sequences(spark, sf_dir)
    assert not BROADCAST_ROWS.search(shown(files.fasta_text(justified(s), s), capsys))


def test_plain_numbers_give_the_chances_of_logs(monkeypatch):
    """F2 (also F5, F8): no logarithm a cell where the numbers of a diagonal can be scaled;
    the same chances, totals and counts as by logs, also where a pair has no path."""
    rng = np.random.default_rng(2)
    sub, drop, ins = np.full((3, 3, 4, 4), -np.inf), np.full((3, 3, 4), -np.inf), np.full((3, 3, 4), -np.inf)
    sub[:, 0, :3, :3], drop[:, 2, :3], ins[:2, 1, :3] = rng.normal(size=(3, 3, 3)), rng.normal(size=(3, 3)), rng.normal(size=(2, 3))
    letters = lambda: [rng.integers(0, 3, n).tolist() for n in (0, 1, 7, 12, 5)]
    tops, bots, times = letters(), letters()[::-1], np.arange(1.0, 6.0)
    odds = [rng.normal(size=(len(a), len(b))) for a, b in zip(tops, bots, strict=True)]
    no_gaps = kernels.Weights(sub, np.full_like(drop, -np.inf), np.full_like(ins, -np.inf))
    real, logs = kernels.Recurrence.forward_step, []
    monkeypatch.setattr(kernels.Recurrence, "forward_step", lambda *a: logs.append(1) or real(*a))
    for weights in (kernels.Weights(sub, drop, ins), no_gaps):
        for batch in (kernels.Batch.of(tops, bots), kernels.Batch.of(tops, bots, odds), kernels.Batch.of([[]], [[]])):
            n, (c1, c2) = len(batch.top), np.zeros((2, 3, 3, 4, 4))
            found, totals = kernels.posteriors(batch, weights, c1, 3, times[:n])
            assert not logs
            want, want_totals = kernels.log_posteriors(batch, weights, c2, 3, times[:n])
            assert np.allclose(found, want, atol=1e-12) and np.allclose(totals, want_totals) and np.allclose(c1, c2)
            assert np.allclose(kernels.posteriors(batch, weights)[0], want, atol=1e-12)
            logs.clear()
            assert np.allclose(kernels.log_likelihoods(batch, weights), want_totals) and not logs


def test_numbers_too_far_apart_are_left_to_logs():
    """Chances below what doubles hold on one diagonal are found as before."""
    sub, drop, ins = np.full((3, 3, 2, 2), -np.inf), np.full((3, 3, 2), -np.inf), np.full((3, 3, 2), -np.inf)
    sub[:, 0], drop[:, 2], ins[:2, 1] = -0.1, -40.0, -40.0
    for size in (2, 30):
        batch, weights, counts = kernels.Batch.of([[0] * size], [[0] * size]), kernels.Weights(sub, drop, ins), np.zeros((3, 3, 2, 2))
        if size == 30:
            with pytest.raises(kernels.TooWide):
                kernels.scaled_posteriors(batch, weights, counts)
            assert not counts.any()
        assert np.allclose(kernels.posteriors(batch, weights)[0], kernels.log_posteriors(batch, weights)[0])
        assert np.array_equal(kernels.posteriors(batch, weights)[0] > 0, kernels.log_posteriors(batch, weights)[0] > 0)
    sub[:, 0] = -2 * kernels.WIDEST
    with pytest.raises(kernels.TooWide):
        kernels.Scaled(batch, kernels.Weights(sub, drop, ins))


EDGE = "aln_id string, seq1 string, pos1 int, seq2 string, pos2 int, score double"


def test_links_stay_where_they_are_made(spark, sf_dir, capsys):
    """no shuffle and no sort of links that a join by alignment has made."""
    s = order_sequences(spark, sf_dir)
    links = queries.scored(spark, sf_dir, s)
    for df in (C.merges(s, links, justified(s)), C.consensus_grid(s, links, [0.0, 0.5]), C.is_valid_addition(s, links, justified(s).where("pos = 1"))):
        plan = shown(df, capsys)
        above = plan[: plan.index("SortMergeJoin")].splitlines()
        of_links = above[next(i for i, line in enumerate(above) if "FlatMapCoGroups" in line) + 1 :]
        own = next(i for i, line in enumerate(of_links) if "Exchange" in line)
        assert not [line for line in of_links[own + 1 :] if "seq2" in line and ("Exchange" in line or " Sort " in line)]
        assert plan.count("Exchange hashpartitioning(aln_id") <= 4


def test_links_of_small_and_large_alignments(spark):
    """The same rows, whether an alignment's links are held or pass by, or come as lists."""
    rng = random.Random(12)
    sequences = [(g, f"s{i}", i, ["x"] * rng.randint(1, 5)) for g, n in (("a", 3), ("b", 6), ("c", 1), ("d", 5)) for i in range(n)]
    length = {(g, i): len(x) for g, i, _, x in sequences}
    pairs_of = [(g, a, b) for g, a in length for h, b in length if g == h and a < b]
    links = [(g, a, i, b, j, rng.choice([0.0, 0.25, 0.5, 0.75])) for g, a, b in pairs_of for i in range(length[g, a]) for j in range(length[g, b])]
    s = spark.createDataFrame(sequences, "group_id string, sequence_id string, ord int, letters array<string>")
    e = spark.createDataFrame(links + [("none", "s0", 0, "s1", 0, 0.9)], EDGE)
    turned = e.selectExpr("aln_id", "seq2 AS seq1", "pos2 AS pos1", "seq1 AS seq2", "pos1 AS pos2", "score").repartition(3)
    lists = e.groupBy("aln_id", "seq1", "seq2").agg(F.collect_list(F.expr("int(pos1 * 9 + pos2)")).alias("cells"), F.collect_list("score").alias("scores")).withColumn("width", F.lit(9))
    initial = C.columns_from_edges(e.selectExpr("aln_id", "seq1 AS sequence_id", "pos1 AS pos").where("aln_id <> 'none'"), e.where("pos1 = 0 and pos2 = 0 and aln_id <> 'none'"))
    schema, grid = "aln_id string, seq1 string, pos1 int, seq2 string, pos2 int, taken boolean", "aln_id string, column_id string, sequence_id string, pos int"

    def flags(built):
        return lambda found: found.with_flags(built.columns.merge_all(found.a, found.b)), None

    def columns(built):
        return lambda found: built.columns.merge_all(found.a, found.b) and () or (), built.rows

    for make, kind in ((flags, schema), (columns, grid)):
        for over in (None, 0.25):
            wants = None
            for small in (0, 8, 1000):
                for edges in (e, turned, lists):
                    got = sorted(map(tuple, C.of_each(s, edges, kind, make, initial, over=over, small=small).collect()))
                    wants = wants or got
                    assert got == wants and got, (small, over)
    with pytest.raises(Exception, match="names a sequence"):
        C.consensus_alignment(s, spark.createDataFrame([("a", "s0", 0, "s9", 0, 0.5)], EDGE)).collect()


def test_blocks_of_a_group_are_bounded(spark):
    """each sequence stands under so many blocks at most, however large its group is."""
    rows = [("large", f"s{i:03d}", i, [i]) for i in range(300)] + [("small", f"s{i}", i, [i]) for i in range(5)]
    coded = spark.createDataFrame(rows, "group_id string, sequence_id string, ord int, ids array<int>")
    first, second = pairs.blocked(coded, 2)
    assert max(first.count(), second.count()) <= 305 * (pairs.BLOCKS + 1) / 2 + 300
    found = [(r.group_id, r.top_id, r.bot_id) for r in pairs.sequence_pairs(coded, block=2).collect()]
    assert len(found) == len(set(found)) == 300 * 299 // 2 + 10 and all(a < b for _, a, b in found)


def test_columns_are_paired_in_one_join(spark, sf_dir, capsys):
    """pairs of columns carry their sequences, so that no pair is shuffled."""
    df = queries.disjoint_columns(spark, sf_dir)
    plan = shown(df, capsys)
    assert "Exchange" not in plan[: plan.index("SortMergeJoin [aln_id")]
    rows = [("a", "x", "s", 0), ("a", "x", "t", 0), ("a", "y", "s", 1), ("a", "z", "u", 0), ("b", "v", "s", 0), ("b", "w", "t", 0)]
    columns = spark.createDataFrame(rows, "aln_id string, column_id string, sequence_id string, pos int")
    each = columns.select("aln_id", "column_id").distinct()
    both = each.withColumnRenamed("column_id", "column_a").join(each.withColumnRenamed("column_id", "column_b"), "aln_id").where("column_a < column_b")
    assert {tuple(r) for r in A.disjoint_columns(None, columns).collect()} == {tuple(r) for r in A.disjoint_columns(both, columns).collect()} == {("a", "x", "z"), ("a", "y", "z"), ("b", "v", "w")}


def test_lists_of_chances_are_the_links(spark, sf_dir, capsys):
    """A row a pair, not a row a link, is brought to its group; turned where the
    later id is on top."""
    paired, weights, n = queries.modelled(spark, sf_dir, queries.fixed_weights(spark))
    some = paired.where("group_id < '3'")
    turned = some.select("group_id", F.col("bot_id").alias("top_id"), F.col("top_id").alias("bot_id"), F.col("bot").alias("top"), F.col("top").alias("bot"), "stat")
    for p in (some, turned):
        want = {tuple(r) for r in pairs.pair_posteriors(p, weights, n, over=0.1).collect()}
        assert want and {tuple(r) for r in C.listed_links(pairs.posterior_lists(p, weights, n, over=0.1)).select("aln_id", "seq1", "pos1", "seq2", "pos2", "score").collect()} == want
    plan = shown(training.align_groups(order_sequences(spark, sf_dir)), capsys)
    assert "explode(arrays_zip" not in plan and "FlatMapCoGroups" in plan


def test_an_edge_is_cut_out_by_one_match(spark, capsys):
    """one match a text, and the same edges and errors, also of ids with any sign."""
    texts = [" ((1, b), (0, a)) ", "((1, b, (2), (3, d), (4, e))", "((7, \x01), (2, a\x01b))", "((99999999999, a), (0, b))", "((0, ), (1, x))"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    parsed = df.select(L.parse_edge_literal(F.col("t")).alias("e")).select("e.*")
    plan = shown(parsed, capsys)
    assert plan.count("regexp_replace") <= 1
    assert {tuple(r) for r in parsed.collect()} == {("a", 0, "b", 1), ("b, (2", 1, "d), (4, e", 3), ("\x01", 7, "a\x01b", 2), ("a", None, "b", 0), ("", 0, "x", 1)}
    for bad in ("((1,b), (0, a))", "", "a\x01b\x01c\x01d", "((1, b), (0, a)) x", "1\x012\x013\x014\x01"):
        with pytest.raises(Exception, match="not an edge"):
            spark.createDataFrame([(bad,)], "t string").select(L.parse_edge_literal(F.col("t"))).collect()
