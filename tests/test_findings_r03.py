"""What round 3 found to fail or to grow faster than its input."""

import random
import re

import numpy as np
import pyarrow as pa

from seqloom import queries
from seqloom.functions import graphs, kernels
from seqloom.operators import components, construct
from seqloom.plans import pairs

BROADCAST_BLOCKS = re.compile(r"Broadcast\w*Join[^\n]*_j#")


def shown(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_blocks_are_never_broadcast(spark, sf_dir, capsys):
    """a small file stands under many blocks; texts are made before that."""
    plan = shown(queries.pairs_of_one_group(spark, sf_dir), capsys)
    assert not BROADCAST_BLOCKS.search(plan) and "array_join" not in plan
    rows = [("g", f"s{i:02d}", i, [i]) for i in range(40)]
    coded = spark.createDataFrame(rows, "group_id string, sequence_id string, ord int, ids array<int>")
    for df in (pairs.sequence_pairs(coded, block=7), pairs.taxa_pairs(coded.withColumnRenamed("ids", "letters"), 7)):
        assert not BROADCAST_BLOCKS.search(shown(df, capsys))
        assert df.count() == 780


def test_alignments_of_a_task_are_closed_whole(spark, monkeypatch):
    """however many alignments a task takes, no round over all links follows."""
    written, real = [], components.saved
    monkeypatch.setattr(components, "saved", lambda df, name: written.append(name) or real(df, name))
    rows = [(f"g{i:02d}", f"s{j}", 0, f"s{j + 1}", 0) for j in range(4) for i in range(50)] + [(None, "b", 0, "a", 1)]
    links = spark.createDataFrame(rows, "aln_id string, seq1 string, pos1 int, seq2 string, pos2 int")
    found = components.components(links.repartition(3), held=10).collect()
    assert not {"forests", "stars"} & set(written)
    assert {(r.aln_id, r.sequence_id, *r.least) for r in found} == {(f"g{i:02d}", f"s{j}", "s0", 0) for j in range(1, 5) for i in range(50)} | {(None, "b", "a", 1)}


def test_closure_alone_and_over_tasks(spark):
    rng = random.Random(11)
    links = [("a" if i % 3 else None, f"s{rng.randrange(9)}", rng.randrange(4), f"s{rng.randrange(9)}", rng.randrange(4)) for i in range(24)]
    df = spark.createDataFrame(links, "aln_id string, seq1 string, pos1 int, seq2 string, pos2 int").where("aln_id is not null")
    residues = spark.createDataFrame([("a", f"s{s}", p) for s in range(8) for p in range(5)] + [("b", "x", 0), ("b", "x", 0)], "aln_id string, sequence_id string, pos int")
    alone, parted = ({tuple(r) for r in construct.columns_from_edges(residues, df, held).collect()} for held in (1000, 10))
    assert alone == parted and len(alone) == 41


def test_rows_are_cut_between_alignments():
    ids = [None] * 3 + ["a"] * 5 + ["b"] + ["c"] * 7 + ["d"]
    for size in (1, 2, 5, 40):
        batches = [pa.record_batch([pa.array(ids[i : i + size], pa.string())], names=["aln_id"]) for i in range(0, len(ids), size)]
        for rows in (1, 4, 100):
            parts = [b.column(0).to_pylist() for b in graphs.whole(batches, rows)]
            assert sum(parts, []) == ids and all(a[-1] != b[0] for a, b in zip(parts, parts[1:], strict=False))
            assert rows == 100 or max(map(len, parts)) < 4 + size + 7


def test_links_are_looked_up_without_a_search(spark, monkeypatch, capsys):
    """F16: one search for all columns, no order of links; the same answers as link by link."""
    rng = random.Random(16)
    sequences = [(g, f"s{s}", s, ["x"] * rng.randint(1, 6)) for g in "ab" for s in range(5)]
    length = {(g, s): len(letters) for g, s, _, letters in sequences}
    s = spark.createDataFrame(sequences, "group_id string, sequence_id string, ord int, letters array<string>")
    links = [(g, a, i, b, j) for g, a in length for h, b in length if g == h and a < b for i in range(length[g, a]) for j in range(length[h, b])]
    e = spark.createDataFrame(links, "aln_id string, seq1 string, pos1 int, seq2 string, pos2 int")
    initial = construct.columns_from_edges(e.selectExpr("aln_id", "seq1 AS sequence_id", "pos1 AS pos"), e.where("pos1 = pos2 and pos1 > 0 and seq1 = 's0'"))
    ask = lambda: construct.is_valid_addition(s, e, initial)
    assert "score" not in next(line for line in shown(ask(), capsys).splitlines() if " Sort " in line)
    monkeypatch.setattr(construct, "LISTED", 0)
    by_search = {tuple(r) for r in ask().collect()}
    monkeypatch.setattr(construct, "LISTED", 4096)
    assert {tuple(r) for r in ask().collect()} == by_search and {r[5] for r in by_search} == {True, False}


def test_terms_of_a_state_are_joined_at_once():
    """one sum a state and diagonal, not one for each move; the same chances."""
    rng = np.random.default_rng(4)
    sub, drop, ins = np.full((3, 3, 2, 2), -np.inf), np.full((3, 3, 2), -np.inf), np.full((3, 3, 2), -np.inf)
    sub[:, 0], drop[:, 2], ins[:2, 1] = rng.normal(size=(3, 2, 2)), rng.normal(size=(3, 2)), rng.normal(size=(2, 2))
    batch, weights, sums, real = kernels.Batch.of([[0, 1, 1], [1]], [[1, 0], [0, 1]]), kernels.Weights(sub, drop, ins), [], kernels.log_sum
    assert np.allclose(real(np.array([[0.0, -np.inf, 800.0], [1.0, -np.inf, 800.0]])), [np.logaddexp(0, 1), -np.inf, 800 + np.log(2)])
    r = kernels.Recurrence(batch, weights, lambda terms: sums.append(len(terms)) or real(terms))
    found = r.totals()
    assert len(sums) <= 3 * r.last and max(sums) == 3

    def paths(top, bot, s=0, x=0, y=0):
        here = 1.0 if s == 0 and x == len(top) and y == len(bot) else 0.0
        for t in range(3):
            here += np.exp(drop[s, t, top[x]]) * paths(top, bot, t, x + 1, y) if x < len(top) else 0.0
            here += np.exp(ins[s, t, bot[y]]) * paths(top, bot, t, x, y + 1) if y < len(bot) else 0.0
            here += np.exp(sub[s, t, top[x], bot[y]]) * paths(top, bot, t, x + 1, y + 1) if x < len(top) and y < len(bot) else 0.0
        return here

    assert np.allclose(found, np.log([paths([0, 1, 1], [1, 0]), paths([1], [0, 1])]))
    nowhere = kernels.posteriors(batch, kernels.Weights(np.full_like(sub, -np.inf), drop, ins))
    assert not nowhere[0].any() and not np.isfinite(nowhere[1]).any()
