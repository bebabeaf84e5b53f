"""Operators 4, 6 and 7, and the pipeline, on small tables."""

import hashlib
import math
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from seqloom.llm import fingerprints, near_duplicates, preferences, queries

from .fixtures import docs, prose, texts


def test_spans_and_extensions():
    rng = random.Random(1)
    a, b = "".join(rng.choice("ab") for _ in range(200)), "".join(rng.choice("ab") for _ in range(180))
    x, y = fingerprints.PrefixHashes(a), fingerprints.PrefixHashes(b)
    for _ in range(300):
        i, j = rng.randrange(201), rng.randrange(181)
        n = rng.randrange(min(201 - i, 181 - j)) if min(200 - i, 180 - j) else 0
        assert fingerprints.spans_equal(x, i, y, j, n) == (a[i : i + n] == b[j : j + n])
        assert fingerprints.common_extension(x, i, y, j) == len(os.path.commonprefix([a[i:], b[j:]]))
    assert fingerprints.span_hash(x, 3, 9) == fingerprints.span_hash(fingerprints.PrefixHashes(a[3:9]), 0, 6)


@pytest.mark.parametrize("n_parts", [1, 3, 7])
def test_fingerprints(spark, n_parts):
    rows = [(i, t) for i, t in texts(25) if i is not None and not (i == 33 and t.startswith("a second"))]
    rows = [r for k, r in enumerate(rows) if r[0] not in {x[0] for x in rows[:k]}]
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs(spark, rows, clashing=True), n_parts).collect()}
    text = {i: t or "" for i, t in rows}
    order = sorted(text, reverse=True)
    assert set(got) == set(text)
    for k, i in enumerate(order):
        t, n = text[i], text[order[(k + 1) % len(order)]]
        cut = len(t) // 2
        edited = t[: len(t) - cut] + n[:cut]
        r, own, of_edited, of_next = got[i], *(fingerprints.Hashed(0, s).print for s in (t, edited, n))
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (own, of_edited)
        assert r.common_prefix == len(os.path.commonprefix([t, edited]))
        assert r.near_edited == fingerprints.likeness(own, of_edited) and r.near_next == fingerprints.likeness(own, of_next)
        spans = [{s[j : j + 16] for j in range(max(1, len(s) - 15))} if s else set() for s in (t, edited)]
        share = len(spans[0] & spans[1]) / len(spans[0] | spans[1]) if spans[0] | spans[1] else 1.0
        assert abs(r.near_edited - share) < 0.27
    same = [i for i, t in text.items() if t == text[0]]
    assert len(same) > 2 and len({got[i].fingerprint for i in same}) == 1


def test_fingerprints_of_repeated_and_null_ids(spark):
    rows = [(1, "a" * 40), (1, "b" * 40), (1, "b" * 40), (None, "c" * 30), (None, None), (2, "dd")]
    got = fingerprints.fingerprints(docs(spark, rows), 3).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    only = fingerprints.fingerprints(docs(spark, [(5, "abcdef")]), 2).collect()
    assert only[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert fingerprints.fingerprints(docs(spark, [])).count() == 0


def shingles(t):
    w = (t or "").split()
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def brute_classes(rows, each=False):
    """Least doc_id of each row's class, by all pairs; with each, of every class once."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if not either or both / either >= 0.8:
                parent[find(i)] = find(j)
    low: dict = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(find(i), []).append(d if d is not None else float("inf"))
    return [min(ids) for ids in low.values()] if each else [min(low[find(i)]) for i in range(len(rows))]


def near_copies(n, seed, edits=(1, 6)):
    """Copies of one text with a few words changed: pairs on both sides of 0.8."""
    rng = random.Random(seed)
    base = prose(rng, 150).split()
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(*edits)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("crowd", [near_duplicates.CROWD, 1])
def test_near_duplicates(spark, monkeypatch, crowd):
    """With crowd = 1 no bucket is listed without a look at common shingles."""
    monkeypatch.setattr(near_duplicates, "CROWD", crowd)
    rows = [*texts(25), *((1000 + i, t) for i, t in enumerate(near_copies(40, 3))), *((2000 + i, t) for i, t in enumerate(near_copies(12, 8, (4, 9))))]
    df = docs(spark, rows, clashing=True)
    got = near_duplicates.near_duplicates(df).toPandas()
    want = Counter((i if i is not None else float("inf"), c) for (i, _), c in zip(rows, brute_classes(rows), strict=True))
    inf = lambda v: float("inf") if v != v else v
    assert Counter((inf(r.doc_id), inf(r.class_id)) for r in got.itertuples()) == want
    if crowd > 1:
        kept = near_duplicates.one_of_each(df)
        assert kept.columns == df.columns
        assert Counter(inf(i if i is not None else float("nan")) for i in (r.doc_id for r in kept.collect())) == Counter(brute_classes(rows, each=True))
        assert near_duplicates.near_duplicates(docs(spark, [])).count() == 0


def test_crowds_list_every_link_and_few_other_pairs(spark):
    """Texts that resemble one another on both sides of 0.8, each a component of its own."""
    rows = [(1000 + i, t) for i, t in enumerate([*near_copies(60, 3, (1, 9)), *near_copies(60, 5, (4, 12))])]
    sets = {i: np.unique(near_duplicates.shingle_hashes(t)) for i, t in rows}
    links = {(i, j) for i in sets for j in sets if j < i and near_duplicates.jaccard(sets[i], sets[j]) >= 0.8}
    rarest = near_duplicates.rarest_shingles(spark.createDataFrame(rows, "node long, text string"), 0.8)
    labels = spark.createDataFrame([(i, i) for i in sets], "node long, label long")
    listed = {(r.a, r.b) for r in near_duplicates.crowd_pairs(rarest, labels, 0.8).collect()}
    assert len(links) > 50 and links <= listed
    assert len(listed) < 0.3 * len(sets) * (len(sets) - 1) / 2


def test_lines_repeated_unlike_often_hide_no_link(spark):
    """Copies whose shingle sets are alike, but one of whose lines comes once or many times."""
    rows = []
    for i in range(12):
        rng = random.Random(100 + i)
        once = " ".join(f"w{rng.randrange(10**6)}" for _ in range(150))
        line = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
        rows += [(10 * i, f"{once} {line}"), (10 * i + 1, " ".join([once, *[line] * 100]))]
    classes = brute_classes(rows)
    assert len(set(classes)) == 12
    got = near_duplicates.near_duplicates(docs(spark, rows)).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: c for (i, _), c in zip(rows, classes, strict=True)}


def test_similar_pairs_are_not_passed_over():
    """Chance that a pair at the least similarity agrees in too few coordinates, or shares no band."""
    p, k = near_duplicates.SIMILARITY, near_duplicates.K
    assert sum(math.comb(k, i) * p**i * (1 - p) ** (k - i) for i in range(near_duplicates.LEAST_AGREED)) < 1e-8
    assert (1 - p**near_duplicates.BAND_ROWS) ** near_duplicates.N_BANDS < 1e-5


def test_signature_estimates_weighted_similarity():
    rng = np.random.default_rng(5)
    universe = rng.integers(0, 2**63, 120).astype(np.uint64)
    w1, w2 = rng.uniform(0.2, 4, 120), rng.uniform(0.2, 4, 120)
    w2[:60] = w1[:60]
    w2[60:80] = 0
    on = w2 > 0
    a, b = near_duplicates.signatures([universe, universe[on]], [w1, w2[on]], k=2048)
    want = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    assert abs((a == b).mean() - want) < 0.05
    assert (a != 0).all()


def test_preferences_against_sql(spark):
    rng = random.Random(4)
    rows = []
    for c in range(40):
        n = rng.randint(1, 5)
        for t in range(n):
            rows.append((c * 700, t, ["user", "assistant"][t % 2], "hello" if t == 0 and c % 3 == 0 else prose(rng, 4)))
    rows += [(50_000, 0, "user", "hello"), (50_001, 0, "user", "hello"), (50_001, 1, "assistant", None), (50_001, 1, None, "é𝔘"), (50_001, None, "assistant", "early"), (None, 0, "user", "x"), (50_002, 0, "user", "hello"), (50_002, 1, "assistant", "a"), (50_003, 0, "user", "hello"), (50_003, 1, "assistant", "a"), (50_003, 1, "assistant", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as turns", "'y' as a")
    got = preferences.format_pairs(table).toPandas()
    con = duckdb.connect()
    con.register("frame", table.toPandas())
    con.execute("CREATE VIEW conversations AS SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM frame")
    want = con.sql(preferences.ORACLE_SQL).df()
    key = ["kind", "chosen_id", "rejected_id"]
    assert got[list(want.columns)].sort_values(key).reset_index(drop=True).equals(want.sort_values(key).reset_index(drop=True).astype(got[list(want.columns)].dtypes.to_dict()))
    assert (got.kind == "sibling").sum() > 10 and (got.kind == "swapped").sum() > 10
    for r in got.itertuples():
        for text, spans in ((r.chosen, r.chosen_loss), (r.rejected, r.rejected_loss)):
            for s in filter(None, spans.split(",")):
                a, b = map(int, s.split(":"))
                assert text[:a].endswith("<|assistant|>\n") and text[b] == "\n"
    assert preferences.format_pairs(table.limit(0)).count() == 0


def test_one_opening_of_all_conversations_is_spread(spark):
    rows = spark.createDataFrame([(i * 3, t, ["user", "assistant"][t], "hello" if t == 0 else f"r{i}") for i in range(300) for t in range(2)], "conv_id long, turn long, role string, text string")
    pairs = preferences.following(preferences.conversations(rows).withColumn("opening", preferences.F.lit("hello")), "opening")
    assert sorted(map(tuple, pairs.collect())) == [(i * 3, i * 3 + 3) for i in range(299)]
    assert "SinglePartition" not in pairs._jdf.queryExecution().toString()


def test_very_long_turns_and_repeated_rows(spark):
    long = "word " * 20_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", "a"), (2, 0, "user", long), (2, 1, "assistant", long), (2, 1, "assistant", long)]
    got = preferences.format_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.kind, r.chosen_id, r.rejected_id) for r in got} == {("sibling", 1, 2), ("swapped", 1, 2), ("swapped", 2, 1)}
    assert all(r.prompt.startswith(f"<|user|>\n{long}") for r in got)


def test_pipeline_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = df.columns, df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf_dir)
        rows = after.collect()
        assert after.columns == columns and 0 < len(rows) <= kept.count()
        kept = spark.createDataFrame(rows, after.schema)
    texts_left = [r.text for r in kept.collect()]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(i in t for i in items for t in texts_left)
    classes = near_duplicates.near_duplicates(kept).toPandas()
    assert classes.class_id.nunique() == len(classes)
    packed = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in kept.collect()}


def test_every_query_is_registered_once():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)
