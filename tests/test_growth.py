"""What must not grow with the rows: work on equal pairs, runs of a merge, rows written."""

import random

import pandas as pd
from pyspark.sql import functions as F

from seqloom.functions import graphs
from seqloom.operators import alignment as A
from seqloom.operators import construct as C
from seqloom.plans import pairs
from seqloom.sources import shared

LINKS = "aln_id string, seq1 string, pos1 int, seq2 string, pos2 int, score double"


def test_equal_pairs_are_worked_on_once(spark):
    rows = [("g", f"s{i:02d}", f"t{i:02d}", [0, i % 3], [1], 0) for i in range(30)] + [(None, "a", "b", [0, 1], [1], 0)]
    paired = spark.createDataFrame(rows, "group_id string, top_id string, bot_id string, top array<int>, bot array<int>, stat int")
    seen = spark.sparkContext.accumulator(0)

    def work(part, batch, weights):
        seen.add(len(part))
        return pd.DataFrame({"last": [float(t[-1]) for t in part.top]})

    found = pairs.per_distinct(paired, {0: None}, None, "last double", work).collect()
    assert seen.value == 3
    assert sorted((r.top_id, r.bot_id, r["last"]) for r in found) == sorted((t, b, float(top[-1])) for _, t, b, top, _, _ in rows)


def test_a_merge_is_run_once_for_a_curve(spark, capsys):
    s = spark.createDataFrame([("g", x, i, ["x"]) for i, x in enumerate("ab")], "group_id string, sequence_id string, ord int, letters array<string>")
    e = spark.createDataFrame([("g", "a", 0, "b", 0, 0.5)], LINKS)
    C.roc_curve(s, e, spark.createDataFrame([("g", "a:0", "a", 0), ("g", "a:0", "b", 0)], C._COLUMNS)).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1


def test_a_refused_pair_of_columns_is_searched_once(monkeypatch):
    columns, searched = graphs.Columns([2, 2]), []
    assert columns.merge(0, 3)
    real = graphs.Columns.behind
    monkeypatch.setattr(graphs.Columns, "behind", lambda self, x, y: searched.append((x, y)) or real(self, x, y))
    assert columns.merge_all([1, 1, 1], [2, 2, 2]) == [False] * 3
    assert len(searched) == 1 and not columns.may_fit(1, 2) and not columns.may_fit(2, 1)


def test_small_groups_are_ranked_without_writing_their_rows(spark, monkeypatch):
    written, real = [], shared.saved
    monkeypatch.setattr(shared, "saved", lambda df, name: written.append(name) or real(df, name))
    rng = random.Random(5)
    edges = spark.createDataFrame([(f"g{i % 7}", "a", i, "b", i, round(rng.random(), 1)) for i in range(400)], LINKS)
    found = {tuple(r) for r in A.rank_edges(edges).collect()}
    assert "numbered" not in written and len(found) == 400
    order = (F.desc("score"), "seq1", "pos1", "seq2", "pos2")
    over_ranges = shared.numbered_within(edges, "rank", "aln_id", *order, over=57)  # g0 has 58 rows, g6 57
    assert "numbered" in written and {(*r[:6], r["rank"] + 1) for r in over_ranges.collect()} == found


def test_small_alignments_are_placed_where_they_are_walked(spark, monkeypatch):
    def numbered_within(*given, **named):
        raise AssertionError("columns are numbered in a pass of their own")

    columns = spark.createDataFrame([("g", "a:0", "a", 0), ("g", "a:1", "a", 1), ("g", "a:1", "b", 0), ("g", "b:1", "b", 1)], C._COLUMNS)
    with monkeypatch.context() as m:
        m.setattr(A, "numbered_within", numbered_within)
        places = sorted((r.column_id, r.place) for r in A.linearize_columns(columns).collect())
    assert places == [("a:0", 0), ("a:1", 1), ("b:1", 2)]
    s = spark.createDataFrame([("g", "a", ["x", "yy"]), ("g", "b", ["z", "w"]), ("g", "c", [])], "group_id string, sequence_id string, letters array<string>")
    shown = {r.sequence_id: r.row for r in A.render_alignment(columns, s, A.linearize_columns(columns)).collect()}
    assert shown == {"a": "x \tyy\t- \t", "b": "- \tz \tw \t", "c": "- \t- \t- \t"}
    only = s.select("group_id", "sequence_id").where("sequence_id = 'b'").withColumnRenamed("group_id", "aln_id")
    assert [r.row for r in A.render_alignment(columns, s, A.linearize_columns(columns), only).collect()] == ["z \tw \t"]
