"""One alignment or group in many tasks: the same rows as in one."""

import random

from pyspark.sql import functions as F

from seqloom.functions import graphs
from seqloom.operators import alignment as A
from seqloom.operators import components as K
from seqloom.operators import construct as C
from seqloom.plans import pairs
from seqloom.sources.shared import numbered_within

LINKS = "aln_id string, seq1 string, pos1 int, seq2 string, pos2 int"


def brute_components(links):
    root = {}

    def find(v):
        root.setdefault(v, v)
        while root[v] != v:
            v = root[v]
        return v

    for aln, s1, p1, s2, p2 in links:
        a, b = find((aln, s1, p1)), find((aln, s2, p2))
        root[max(a, b)] = min(a, b)
    return {(*v, *find(v)[1:]) for v in root if find(v) != v}


def test_components_over_tasks(spark):
    rng = random.Random(4)
    links = [("one", f"s{rng.randrange(300)}", rng.randrange(3), f"s{rng.randrange(300)}", rng.randrange(3)) for _ in range(700)]
    links += [("chain", f"t{i}", 9, f"t{i + 1}", 10) for i in range(150)] + [("chain", f"t{i}", 10, f"t{i}", 9) for i in range(150)]
    links += [(f"small{i % 40}", "a", i % 5, "b", i % 3) for i in range(200)] + [("loop", "a", 0, "a", 0)]
    rng.shuffle(links)
    df = spark.createDataFrame(links, LINKS)
    for held in (K.HELD, 10):  # with 10, forests are cut off and joined again in Spark
        found = {(r.aln_id, r.sequence_id, r.pos, r.least.sequence_id, r.least.pos) for r in K.components(df.repartition(5), held).collect()}
        assert found == brute_components(links)


def test_no_links(spark):
    assert K.components(spark.createDataFrame([], LINKS)).collect() == []


def test_columns_are_peeled_as_they_are_walked(spark):
    rng = random.Random(7)
    rows, arcs = [], {}
    for aln in range(6):
        places = sorted(rng.sample(range(40), 25))
        for s in range(5):
            own = sorted(rng.sample(places, rng.randint(3, 9)))
            if aln == 5 and s == 2:
                own.reverse()  # most likely a cycle
            rows += [(f"a{aln}", f"c{p:02d}", f"s{s}", i) for i, p in enumerate(own)]
            arcs.setdefault(f"a{aln}", []).extend((f"c{a:02d}", f"c{b:02d}") for a, b in zip(own, own[1:], strict=False))
    columns = spark.createDataFrame(rows, "aln_id string, column_id string, sequence_id string, pos int")
    want = set()
    for aln, of in arcs.items():
        nodes = {c for a, c, _, _ in rows if a == aln}
        found = graphs.depths(nodes, of)
        want |= {(aln, c, found.get(c)) for c in nodes}
    assert any(d is None for _, _, d in want)
    for alone in (10**6, 0, 34):
        assert {tuple(r) for r in A.column_depths(columns, alone).collect()} == want
    valid = {r.aln_id: r.valid for r in C.validate_alignment(columns).collect()}
    assert valid == {f"a{i}": i != 5 for i in range(6)}
    good = columns.where("aln_id <> 'a5'")
    for alone in (10**6, 0):
        ordered = {}
        for r in A.linearize_columns(good, alone).orderBy("aln_id", "place").collect():
            ordered.setdefault(r.aln_id, []).append(r)
        for aln, of in ordered.items():
            assert [r.place for r in of] == list(range(len(of)))
            assert [r.column_id for r in of] == [c for _, c in sorted((d, c) for a, c, d in want if a == aln)]


def test_pairs_by_blocks(spark):
    rows = [(g, f"s{i:03d}", i, [i]) for g, n in (("large", 60), ("small", 5), ("one", 1)) for i in range(n)]
    coded = spark.createDataFrame(rows, "group_id string, sequence_id string, ord int, ids array<int>")
    want = {(g, f"s{i:03d}", f"s{j:03d}", i, j) for g, n in (("large", 60), ("small", 5)) for j in range(n) for i in range(j)}
    for block in (7, 60, 512):
        found = pairs.sequence_pairs(coded, block=block)
        listed = [(r.group_id, r.top_id, r.bot_id, r.top[0], r.bot[0]) for r in found.collect()]
        assert len(listed) == len(want) and set(listed) == want
        taxa = {tuple(r) for r in pairs.taxa_pairs(coded, block).collect()}
        assert taxa == {(a, b) for _, a, b, _, _ in want}
    # One group's pairs come from many keys, none with more than a block squared.
    first, second = pairs.blocked(coded, 7)
    met = first.alias("a").join(second.alias("b"), ["group_id", "_i", "_j"]).where("a.ord < b.ord").groupBy("group_id", "_i", "_j").count()
    sizes = [r["count"] for r in met.where("group_id = 'large'").collect()]
    assert max(sizes) <= 49 and len(sizes) == 9 * 10 // 2


def test_own_statistic(spark):
    rows = [("g", f"s{i}", i, list(range(i))) for i in range(4)]
    coded = spark.createDataFrame(rows, "group_id string, sequence_id string, ord int, ids array<int>")
    found = pairs.sequence_pairs(coded, F.size("bot") - F.size("top"))
    assert {(r.top_id, r.bot_id, r.stat) for r in found.collect()} == {(f"s{i}", f"s{j}", j - i) for j in range(4) for i in range(j)}


def test_parts_of_large_groups(spark):
    """Parts that no link joins are merged by themselves, with the same columns."""
    rng = random.Random(9)
    sequences = [("big", f"s{i:02d}", i, ["x"] * 4) for i in range(24)] + [("small", f"s{i}", i, ["x"] * 3) for i in range(3)]
    links = []
    for _ in range(400):
        part = rng.randrange(4) * 6
        a, b = rng.sample(range(part, part + 5), 2)  # the last of each six stays without links
        links.append(("big", f"s{min(a, b):02d}", rng.randrange(4), f"s{max(a, b):02d}", rng.randrange(4), round(rng.random(), 3)))
    links += [("small", "s0", i, f"s{j}", i, 0.5) for i in range(3) for j in (1, 2)] + [("unknown", "s0", 0, "s1", 0, 0.9)]
    s = spark.createDataFrame(sequences, "group_id string, sequence_id string, ord int, letters array<string>")
    e = spark.createDataFrame(links, LINKS + ", score double")
    whole = C.per_alignment(C.stream(s, e.where("score > 0.2")), C._COLUMNS, lambda built: (lambda edge: built.merge(edge) and () or (), built.rows))
    want = sorted(map(tuple, whole.collect()))
    parted_s, parted_e = C.independent_pieces(s, e.where("score > 0.2"), over=10)
    assert parted_s.where("group_id = 'big'").select("piece").distinct().count() == 8
    parted = C.per_alignment(C.stream(parted_s, parted_e), C._COLUMNS, lambda built: (lambda edge: built.merge(edge) and () or (), built.rows))
    assert sorted(map(tuple, parted.collect())) == want
    assert sorted(map(tuple, C.consensus_alignment(s, e, 0.2).collect())) == want
    grid = C.consensus_grid(s, e, [0.8, 0.2, 0.5]).collect()
    for t in (0.2, 0.5, 0.8):
        assert sorted(tuple(r)[1:] for r in grid if r.threshold == t) == sorted(map(tuple, C.consensus_alignment(s, e, t).collect()))


def test_no_list_of_links_in_a_plan(spark, capsys):
    s = spark.createDataFrame([("g", "a", 0, ["x"])], "group_id string, sequence_id string, ord int, letters array<string>")
    e = spark.createDataFrame([("g", "a", 0, "b", 0, 0.5)], LINKS + ", score double")
    C.consensus_alignment(s, e).explain()
    C.columns_from_edges(s.selectExpr("group_id AS aln_id", "sequence_id", "0 AS pos"), e).explain()
    assert "collect_list" not in capsys.readouterr().out


def test_numbers_within_groups(spark):
    rng = random.Random(3)
    rows = [("hot", rng.random()) for _ in range(5000)] + [(f"g{i % 30}", rng.random()) for i in range(300)]
    found = numbered_within(spark.createDataFrame(rows, "g string, v double").repartition(8), "n", "g", F.desc("v")).collect()
    by = {}
    for r in found:
        by.setdefault(r.g, []).append((r.n, -r.v))
    for of in by.values():
        of.sort()
        assert [n for n, _ in of] == list(range(len(of))) and [v for _, v in of] == sorted(v for _, v in of)
