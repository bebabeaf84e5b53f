"""The pair model against exact values, and against enumeration of all paths."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqloom import queries
from seqloom.functions import kernels
from seqloom.functions.kernels import Batch, Weights
from seqloom.plans import model, pairs, training

ROWS = [
    ("homologous group 1", "taxon1", ["firstLetter", "secondLetter"]), ("homologous group 1", "taxon2", ["thirdLetter", "firstLetter"]),
    ("homologous group, number 2", "taxon3", ["secondLetter", "secondLetter"]), ("homologous group, number 2", "taxon1", ["secondLetter", "firstLetter"]),
]


@pytest.fixture(scope="module")
def sequences(spark):
    return spark.createDataFrame([(g, s, i % 2, x) for i, (g, s, x) in enumerate(ROWS)], "group_id string, sequence_id string, ord int, letters array<string>").cache()


@pytest.fixture(scope="module")
def zero(spark, sequences):
    alphabet = model.build_alphabet(sequences)
    features = model.transition_features(alphabet)
    table = model.transition_logprobs(features, training.zero_weights(spark))
    paired = pairs.sequence_pairs(model.with_letter_ids(sequences, alphabet)).cache()
    return alphabet, features, table, paired, model.model_weights(table, 3)


def test_support_sizes(zero):
    got = zero[2].groupBy("state1").count().toPandas().set_index("state1")["count"].to_dict()
    assert got == {0: 16, 1: 16, 2: 13}


def test_zero_weight_likelihood_and_posteriors(zero):
    _, _, _, paired, weights = zero
    got = pairs.pair_log_likelihood(paired, weights, 3).toPandas()
    assert len(got) == 2 and np.allclose(got.loglik, math.log(111 / 346112))
    edges = pairs.pair_posteriors(paired, weights, 3).toPandas()
    assert len(edges) == 8
    for r in edges.itertuples():
        assert math.isclose(r.score, 91 / 111 if r.pos1 == r.pos2 else 13 / 222, rel_tol=1e-9)


def test_expected_counts(zero):
    _, _, _, paired, weights = zero
    counts = pairs.expected_counts(paired, weights, 3, 3).toPandas()
    by = counts.groupby(["state1", "state2"]).expected.sum() / 2
    want = {(0, 0): 533 / 222, (0, 1): 53 / 222, (2, 0): 53 / 222, (0, 2): 13 / 111, (1, 0): 13 / 111, (1, 2): 9 / 74, (1, 1): 1 / 222, (2, 2): 1 / 222}
    assert set(by.index) == set(want)
    for k, v in want.items():
        assert math.isclose(by[k], v, rel_tol=1e-9)
    assert math.isclose(by.sum(), 120 / 37, rel_tol=1e-9)


def test_viterbi_and_least_risk(zero):
    _, _, _, paired, weights = zero
    assert all(list(a) == [0, 1] for a in pairs.viterbi_alignment(paired, weights, 3).toPandas().ancestors)
    assert all(list(a) == [0, 1] for a in pairs.mbr_alignment(paired, weights, 3).toPandas().ancestors)


def test_consensus_grid(sequences, zero):
    columns = training.align_groups(sequences, thresholds=[0.0, 0.5, 0.75, 0.875])
    from seqloom.operators.metrics import n_edges
    from pyspark.sql import functions as F

    counts = n_edges(columns.withColumn("aln_id", F.concat_ws("@", "aln_id", F.col("threshold").cast("string")))).toPandas()
    for r in counts.itertuples():
        assert r.n_edges == (0 if r.aln_id.endswith("0.875") else 2)


def paths(n, m):
    """All sequences of moves that consume n and m letters."""
    if not n and not m:
        yield ()
    if n:
        yield from (("drop", *p) for p in paths(n - 1, m))
    if m:
        yield from (("ins", *p) for p in paths(n, m - 1))
    if n and m:
        yield from (("sub", *p) for p in paths(n - 1, m - 1))


def random_weights(rng, n_states, n_symbols):
    return Weights(rng.normal(size=(n_states, n_states, n_symbols, n_symbols)), rng.normal(size=(n_states, n_states, n_symbols)), rng.normal(size=(n_states, n_states, n_symbols)))


def enumerated(top, bot, w):
    """(log weight, aligned cells, ancestors) of every path and state sequence."""
    for moves in paths(len(top), len(bot)):
        for states in itertools.product(range(w.n_states), repeat=len(moves)):
            if moves and states[-1] != w.end:
                continue
            x = y = 0
            s1, total, cells, ancestors = w.start, 0.0, [], [-1] * len(bot)
            for move, s2 in zip(moves, states, strict=True):
                if move == "sub":
                    total += w.sub[s1, s2, top[x], bot[y]]
                    cells.append((x, y))
                    ancestors[y] = x
                elif move == "drop":
                    total += w.drop[s1, s2, top[x]]
                else:
                    total += w.ins[s1, s2, bot[y]]
                x, y, s1 = x + (move != "ins"), y + (move != "drop"), s2
            yield total, cells, ancestors


@pytest.mark.parametrize("cells", [10**9, 1])
def test_kernels_against_enumeration(cells, monkeypatch):
    """With cells = 1 the forward diagonals are recomputed from every n-th."""
    monkeypatch.setattr(kernels, "MAX_CELLS", max(cells, 10**5) if cells > 1 else 1)
    rng = np.random.default_rng(3)
    w = random_weights(rng, 2, 3)
    tops = [[0, 1, 2], [1], [2, 2], []]
    bots = [[1, 0], [0, 2, 1], [2], [1, 1]]
    batch = Batch.of(tops, bots)
    chance, totals = kernels.posteriors(batch, w)
    monkeypatch.setattr(kernels, "MAX_CELLS", 10**9)
    best = kernels.viterbi(batch, w)
    drawn = kernels.samples(batch, w, [1, 2, 3, 4], 200)
    for i, (t, b) in enumerate(zip(tops, bots, strict=True)):
        every = list(enumerated(t, b, w))
        log = np.array([e[0] for e in every])
        total = np.logaddexp.reduce(log)
        assert math.isclose(total, totals[i], rel_tol=1e-9)
        want = np.zeros((len(t), len(b)))
        for weight, at, _ in every:
            for x, y in at:
                want[x, y] += math.exp(weight - total)
        assert np.allclose(chance[i, : len(t), : len(b)], want)
        assert best[i][0] == every[int(log.argmax())][2]
        share: dict = {}
        for weight, _, a in every:
            share[tuple(a)] = share.get(tuple(a), 0) + math.exp(weight - total)
        top = max(share, key=share.get)
        assert abs(sum(tuple(a) == top for a in drawn[i]) / 200 - share[top]) < 0.15


def test_bonus_changes_only_aligned_moves():
    rng = np.random.default_rng(5)
    w = random_weights(rng, 1, 2)
    bonus = rng.normal(size=(2, 2))
    batch = Batch.of([[0, 1]], [[1, 0]], [bonus])
    log = [weight + sum(bonus[x, y] for x, y in cells) for weight, cells, _ in enumerated([0, 1], [1, 0], w)]
    assert math.isclose(kernels.log_likelihoods(batch, w)[0], np.logaddexp.reduce(log), rel_tol=1e-9)


def test_traces_of_blocks_are_those_of_the_whole(monkeypatch):
    """With few diagonals kept, and all pairs of a batch at once: the same paths."""
    rng = np.random.default_rng(5)
    w = Weights(*(rng.normal(size=shape) for shape in ((3, 3, 4, 4), (3, 3, 4), (3, 3, 4))))
    tops, bots = ([rng.integers(0, 4, n).tolist() for n in rng.integers(0, 30, 25)] for _ in range(2))
    seeds = list(range(25))
    whole = kernels.viterbi(Batch.of(tops, bots), w), kernels.least_risk(Batch.of(tops, bots), w), kernels.samples(Batch.of(tops, bots), w, seeds, 3)
    monkeypatch.setattr(kernels, "MAX_CELLS", 10)
    parts = kernels.viterbi(Batch.of(tops, bots), w), kernels.least_risk(Batch.of(tops, bots), w), kernels.samples(Batch.of(tops, bots), w, seeds, 3)
    for i in range(25):
        one = Batch.of([tops[i]], [bots[i]])
        single = kernels.viterbi(one, w)[0], kernels.least_risk(one, w)[0], kernels.samples(one, w, [i], 3)[0]
        want = tuple(p[i] for p in whole)
        assert tuple(p[i] for p in parts) == want and single == want


def test_long_pair(monkeypatch):
    """A pair whose tables would not fit: its path is as good as its likelihood says."""
    monkeypatch.setattr(kernels, "MAX_CELLS", 100_000)
    rng = np.random.default_rng(6)
    top = rng.integers(0, 4, 600)
    bot = np.delete(top, rng.choice(600, 60, replace=False))
    w = Weights(np.log(np.full((1, 1, 4, 4), 0.01) + np.eye(4) * 0.2), np.log(np.full((1, 1, 4), 0.01)), np.log(np.full((1, 1, 4), 0.01)))
    batch = Batch.of([top.tolist()], [bot.tolist()])
    ancestors = np.array(kernels.viterbi(batch, w)[0][0])
    linked = ancestors >= 0
    assert linked.all() and (np.diff(ancestors[linked]) > 0).all() and (top[ancestors] == bot).all()
    weight = linked.sum() * math.log(0.21) + 60 * math.log(0.01)
    assert weight <= kernels.log_likelihoods(batch, w)[0]
    assert (np.array(kernels.least_risk(batch, w)[0]) >= 0).mean() > 0.9


def test_features(spark, sequences, zero):
    alphabet = zero[0]
    listed = spark.createDataFrame([("firstLetter", ["f1v1", "f2v1", "f3v1"]), ("secondLetter", ["f1v1", "f2v2", "f3v1"]), ("thirdLetter", ["f4v1", "f5v1"])], "letter string, features array<string>")
    rows = model.transition_features(alphabet, listed).toPandas()

    def of(s1, s2, a, b):
        return dict(rows[(rows.state1 == s1) & (rows.state2 == s2) & (rows.top_sym == a) & (rows.bot_sym == b)][["feature", "value"]].itertuples(index=False))

    assert of(0, 0, 0, 1) == dict.fromkeys(["pair(firstLetter,secondLetter)", "featChange(1/3)", "state(0)", "statePair(0,0)"], 1)
    assert of(0, 0, 0, 0) == dict.fromkeys(["pair(firstLetter,firstLetter)", "selfsub", "state(0)", "statePair(0,0)"], 1)
    assert set(of(0, 0, 0, 2)) == {"pair(firstLetter,thirdLetter)", "featDimChange(1)", "featChange(0/3)", "featChange(1/3)", "featChange(2/3)", "featChange(0/2)", "featChange(1/2)", "state(0)", "statePair(0,0)"}
    assert set(of(1, 1, 4, 1)) == {"pair(secondLetter,-)", "state(1)", "statePair(1,1)"}
    assert set(of(2, 0, 3, 3)) == {"pair(#,#)", "selfsub", "state(1)", "statePair(1,0)"}


def test_gradient_and_training(spark, sequences, zero):
    _, features, _, paired, weights = zero
    counts = pairs.expected_counts(paired, weights, 3, 3)
    names, function = model.objective(features.toPandas(), counts.toPandas(), {}, 1.0)
    w = np.random.default_rng(0).normal(size=len(names))
    value, slope = function(w)
    for i in range(0, len(names), 3):
        step = np.zeros(len(names))
        step[i] = 1e-5
        assert abs((function(w + step)[0] - function(w - step)[0]) / 2e-5 - slope[i]) < 1e-5
    fitted = model.minimise(function, np.zeros(len(names)))
    assert np.abs(function(fitted)[1]).max() < 1e-4
    steps = training.train(sequences, iterations=3)
    penalised = []
    before = training.zero_weights(spark)
    for s in steps:
        penalised.append(s.log_likelihood - 0.5 * float((before.toPandas().weight ** 2).sum()))
        before = s.weights
    assert penalised == sorted(penalised)


def test_pair_specific_training(sequences):
    steps = training.train(sequences, iterations=1, pair_specific=True)
    assert any(f.startswith("taxon1|taxon2,") for f in steps[0].weights.toPandas().feature)


def test_fit_in_tasks_is_the_fit_of_the_driver(spark, sequences):
    alphabet = model.build_alphabet(sequences)
    index = pairs.pair_statistic_index(sequences)
    paired = pairs.with_statistics(pairs.sequence_pairs(model.with_letter_ids(sequences, alphabet)), index)
    features = model.transition_features(alphabet, statistics=index)
    first = model.transition_logprobs(features, training.zero_weights(spark))
    counts = pairs.expected_counts(paired, model.model_weights(first, 3), 3, 3)
    centers = spark.createDataFrame([("selfsub", 0.5), ("no such feature", 1.0)], "feature string, weight double")
    factors = spark.createDataFrame([("state(0)", 7.0), ("statePair(0,0)", 50.0)], "feature string, factor double")
    one, two = (fit(features, counts, None, centers, 2.0, factors).toPandas().set_index("feature").weight.sort_index() for fit in (model.m_step, model.m_step_in_tasks))
    assert list(one.index) == list(two.index) and np.allclose(one, two, atol=1e-5)
    free = model.m_step(features, counts, None, centers, 2.0).toPandas().set_index("feature").weight
    assert abs(two["statePair(0,0)"]) < abs(free["statePair(0,0)"]) / 5  # held at its center by its factor
    names, function = model.objective(features.toPandas(), counts.toPandas(), {}, 1e9)
    slope = model.fit_gradient(features, counts).toPandas().set_index("feature").gradient
    assert np.allclose(function(np.zeros(len(names)))[1], slope[names], atol=1e-9)


def test_models_meet_their_pairs(spark, sequences, zero, monkeypatch):
    """Many statistics: the same posteriors and counts as with models sent to every task."""
    alphabet = zero[0]
    coded = model.with_letter_ids(sequences, alphabet)
    many = coded.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumns({"group_id": F.concat_ws("/", "group_id", "_copy"), "sequence_id": F.concat_ws("/", "sequence_id", F.col("_copy") % 3)})
    paired = pairs.sequence_pairs(many.drop("_copy"))
    index = pairs.pair_statistic_index(many)
    paired = pairs.with_statistics(paired, index)
    features = model.transition_features(alphabet, statistics=index)
    weights = features.select("feature").distinct().withColumn("weight", F.xxhash64("feature") % 100 / F.lit(70.0))
    logprobs = model.transition_logprobs(features, weights)
    sent, met = model.model_weights(logprobs, 3), model.model_tables(logprobs, 3)
    assert len(sent) == 6
    key = ["aln_id", "seq1", "pos1", "seq2", "pos2"]
    want = pairs.pair_posteriors(paired, sent, 3).toPandas().sort_values(key)
    got = pairs.pair_posteriors(paired, met, 3).toPandas().sort_values(key)
    assert want[key].values.tolist() == got[key].values.tolist() and np.allclose(want.score, got.score, atol=1e-12)
    dealt = pairs.with_models(paired, met, per_task=1)
    assert dealt.where("cells is not null").count() > 6  # a model for each part of a statistic
    (one, log_one), (two, log_two) = (pairs.counts_and_likelihood(paired, w, 3, 3) for w in (sent, met))
    cells = ["state1", "stat", "state2", "top_sym", "bot_sym"]
    one, two = (d.toPandas().set_index(cells).expected.sort_index() for d in (one, two))
    assert list(one.index) == list(two.index) and np.allclose(one, two) and abs(log_one - log_two) < 1e-9


def test_table_weights(spark):
    rows = spark.createDataFrame([("sub", 0, 0, 0, 0, 0.5), ("del", 0, 0, 0, None, 0.2), ("ins", 0, 0, None, 0, 0.1)], "move string, state1 int, state2 int, a int, b int, weight double")
    w = pairs.table_weights(rows, 1, 1)
    assert math.isclose(math.exp(kernels.log_likelihoods(Batch.of([[0]], [[0]]), w)[0]), 0.5 + 2 * 0.2 * 0.1)


def test_reweighted_pairs(spark, zero):
    _, _, _, paired, weights = zero
    odds = spark.createDataFrame([("homologous group 1", "taxon1", "taxon2", 0, 1, 5.0)], "group_id string, top_id string, bot_id string, x int, y int, log_odds double")
    got = pairs.pair_posteriors(pairs.reweight_pairs(paired, odds), weights, 3).toPandas()
    row = got[(got.aln_id == "homologous group 1") & (got.pos1 == 0) & (got.pos2 == 1)].score.iloc[0]
    assert row > 0.8
    other = got[got.aln_id != "homologous group 1"]
    assert np.allclose(sorted(other.score), sorted([91 / 111, 91 / 111, 13 / 222, 13 / 222]))


def test_large_alphabets_are_joined(spark, sequences, monkeypatch):
    alphabet = model.build_alphabet(sequences)
    one = model.with_letter_ids(sequences, alphabet).collect()
    monkeypatch.setattr(model, "MAX_LITERALS", 2)
    two = model.with_letter_ids(sequences, alphabet)
    assert sorted(two.collect()) == sorted(one)
    with pytest.raises(Exception, match="unknown letter"):
        model.with_letter_ids(sequences, alphabet.where("letter_id < 2").union(spark.createDataFrame([("x", 2), ("y", 3)], "letter string, letter_id int"))).collect()


def test_rows_are_numbered_across_ranges(spark):
    from seqloom.sources.shared import numbered

    rows = [(i * 37 % 101,) for i in range(101)]
    got = numbered(spark.createDataFrame(rows, "v int"), "k", "v").collect()
    assert sorted((r.k, r.v) for r in got) == [(i, i) for i in range(101)]
    assert numbered(spark.createDataFrame([], "v int"), "k", "v").count() == 0


def test_equal_pairs_count_as_often_as_they_occur(spark, sf_dir):
    paired, table, n = queries.modelled(spark, sf_dir, queries.fixed_weights(spark))
    alike = pairs.like_pairs(paired)
    assert alike.agg(F.sum("times")).first()[0] == paired.count() > alike.count()
    (want, loglik), (got, again) = (pairs.counts_and_likelihood(p, table, n, n) for p in (paired, alike))
    key = ["state1", "stat", "state2", "top_sym", "bot_sym"]
    want, got = (d.toPandas().set_index(key).expected.sort_index() for d in (want, got))
    assert list(want.index) == list(got.index)
    assert np.allclose(want, got, rtol=1e-9) and abs(loglik - again) < 1e-6 * abs(loglik)
