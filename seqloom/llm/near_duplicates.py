"""Operator 7, near-duplicate documents by DartMinHash signatures.

The elements of a document are its distinct shingles of five words, each of weight 1
however often it occurs: the signature estimates the very similarity that decides, so
that a passage repeated more often in one copy hides no link. Over (weight, rank), each element owns a fixed Poisson
field of darts, found by hashing unit cells; a document sees the darts below its
element's weight and below a rank that leaves about `k ln k + 2k` of them. Each dart
falls to one of k coordinates, and the one of least rank is kept. Documents without a
dart in some coordinate are thrown again with twice the rank. `N_BANDS` bands of
`BAND_ROWS` coordinates are joined; at a similarity of 0.8 a pair misses every band
with probability (1 - 0.8**4)**24 = 3e-6.

Classes are found without listing all pairs of a group:

1. documents of one shingle set are one node;
2. in each of `ROUNDS` rounds, each bucket that holds several components names a center,
   and its nodes of other components are held against it: first the node that shares
   buckets with most others, as the text does that a group was copied from, then one by
   chance. Of the centers whose signature agrees with a node's in at least `LEAST_AGREED`
   coordinates (of similar pairs all but three in a billion do), the best ones are checked
   by exact Jaccard similarity, and good links join components. A round costs one row a
   node and bucket;
3. pairs of different components in buckets of at most `CROWD` nodes are listed: fewer
   than that many for each node and bucket. In larger ones, texts often resemble each
   other just short of a link, each all others. There a pair is listed only if a common
   shingle lets it be similar enough: the shingles of a set are put in order, those that
   the fewest sets of crowds hold first, and the place of the first common one bounds what
   two sets can share. This bound is exact, so that no link is lost, and only the
   beginnings of sets are joined;
4. the listed pairs whose signatures agree often enough are checked, all of them, and the
   components of all good links are the classes.

Links inside a component cannot change the classes. Every decision rests on the
similarity of shingle sets.

Defined cases: null text is the empty text; a text of fewer than five words is one
shingle of all its words; texts without words are copies of each other; rows of equal
doc_id are separate documents; null doc_ids sort last in a class; an empty table gives
no rows; other columns are ignored by `near_duplicates` and kept by `one_of_each`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, text_or_empty

WORDS = 5
SIMILARITY = 0.8
BAND_ROWS = 4
N_BANDS = 24
K = BAND_ROWS * N_BANDS
#: Coordinates in which the signatures of a pair must agree to be checked: more than six
#: standard deviations below what a similarity of 0.8 gives (chance 3e-9).
LEAST_AGREED = 52
#: Rounds of centers, and centers that a node is checked against in one round.
ROUNDS, BEST = 2, 2
#: Nodes of a bucket up to which its pairs are listed without a look at common shingles.
CROWD = 16
#: Chance that a Poisson(1) count is at most 0, 1, 2, ...
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])
_U = np.uint64
_NULL_ID = (1 << 63) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """A 64-bit hash of each run of five words, in order, with repeats."""
    from xxhash import xxh3_64_intdigest

    each = text.split()
    if not each:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, [w.encode("utf-8", "surrogatepass") for w in each]), np.uint64, len(each))
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = mixed(out * _U(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """[0, 1) from the upper 53 bits."""
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


def signatures(elements: list[np.ndarray], weights: list[np.ndarray], k: int = K) -> np.ndarray:
    """DartMinHash: k 32-bit coordinates for each weighted set; zeros for an empty set."""
    n = len(elements)
    out = np.zeros((n, k), np.uint64)
    todo = np.array([i for i in range(n) if len(elements[i])], np.int64)
    darts = k * math.log(k) + 2 * k
    while len(todo):
        x = np.concatenate([elements[i] for i in todo])
        w = np.concatenate([weights[i] for i in todo])
        owner = np.repeat(np.arange(len(todo)), [len(elements[i]) for i in todo])
        limit = darts / np.bincount(owner, w, len(todo))  # of rank, a document
        columns = np.ceil(w).astype(np.int64)
        rows = np.ceil(limit).astype(np.int64)[owner]
        cells = columns * rows
        at = np.repeat(np.arange(len(x)), cells)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
        row, column = nth % rows[at], nth // rows[at]
        cell = mixed(x[at] + column.astype(np.uint64) * _U(0xD6E8FEB86659FD93) + row.astype(np.uint64) * _U(0xA0761D6478BD642F))
        count = np.searchsorted(_POISSON, unit(cell), side="right")
        source = np.repeat(np.arange(len(at)), count)
        nth = np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count)
        dart = mixed(cell[source] + (nth.astype(np.uint64) + _U(1)) * _U(0xE7037ED1A0B428DB))
        place = mixed(dart ^ _U(0x8EBC6AF09C88C6E3))
        rank = row[source] + unit(place)
        height = column[source] + unit(mixed(place))
        doc = owner[at[source]]
        seen = (height < w[at[source]]) & (rank < limit[doc])
        dart, rank, doc = dart[seen], rank[seen], doc[seen]
        slot = doc * k + (dart % _U(k)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")  # the least rank is written last
        best = np.zeros(len(todo) * k, np.uint64)
        best[slot[order]] = (dart[order] >> _U(32)) | _U(1)
        best = best.reshape(-1, k)
        out[todo] = best
        todo = todo[(best == 0).any(axis=1)]
        darts *= 2
    return out.astype(np.uint32)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature, the band's number mixed in."""
    n = len(sketch)
    by = sketch.reshape(n, N_BANDS, BAND_ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(N_BANDS, dtype=np.uint64) + _U(1), (n, N_BANDS)).copy()
    for i in range(BAND_ROWS):
        key = mixed(key * _U(0x9E3779B97F4A7C15) + by[:, :, i])
    return key.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of distinct values."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


# --- Spark jobs -------------------------------------------------------------


def row_key(text: Column) -> Column:
    return F.xxhash64(text)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_key, text_key, high, low, sketch, size) a row; high and low are a digest of 128
    bits of the shingle set, sketch is its signature, null for a text without words, size
    its number of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for first in range(0, len(texts), 64):
                elements = [np.unique(shingle_hashes(t)) for t in texts[first : first + 64]]
                digests = np.frombuffer(b"".join(hashlib.blake2b(e.tobytes(), digest_size=16).digest() for e in elements), "<i8").reshape(-1, 2)
                drawn = signatures(elements, [np.ones(len(e)) for e in elements])
                found = [s.tobytes() if len(e) else None for s, e in zip(drawn, elements, strict=True)]
                part = batch.slice(first, 64)
                columns = [part.column(0), part.column(1), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(found, pa.binary()), pa.array([len(e) for e in elements], pa.int32())]
                yield pa.record_batch(columns, names=["doc_key", "text_key", "high", "low", "sketch", "size"])

    text = text_or_empty()
    picked = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_key"), row_key(text).alias("text_key"), text.alias("text"))
    return picked.mapInArrow(run, "doc_key long, text_key long, high long, low long, sketch binary, size int")


def numbered_nodes(sketched: DataFrame) -> DataFrame:
    """A row a shingle set: high, low, sketch, size, its first document and number of
    documents, and a number `node`. Numbers are any; the table is written with them."""
    kept = sketched.groupBy("high", "low").agg(F.min("sketch").alias("sketch"), F.min("size").alias("size"), F.min(F.struct("doc_key", "text_key")).alias("first"), F.count("*").alias("n"))
    return saved(kept.withColumn("node", F.monotonically_increasing_id()), "op7-nodes")


def banded(nodes: DataFrame) -> DataFrame:
    """(node, key): a row for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(stacked(batch.column(1)))
            yield pa.record_batch([pa.array(np.repeat(batch.column(0).to_numpy(), N_BANDS)), pa.array(keys.ravel())], names=["node", "key"])

    return nodes.select("node", "sketch").mapInArrow(run, "node long, key long")


def stacked(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint32).reshape(len(sketches), K)


def brief(nodes: DataFrame) -> DataFrame:
    """(node, brief): one byte of each coordinate, enough to count those that agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (stacked(batch.column(1)) >> 8).astype(np.uint8)
            yield pa.record_batch([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["node", "brief"])

    return nodes.select("node", "sketch").mapInArrow(run, "node long, brief binary")


def likely(pairs: DataFrame, briefs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree often enough, with `agreed`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(batch), K) for c in batch.columns[2:])
            agreed = (x == y).sum(1)
            out = pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(agreed, pa.int32())], names=["a", "b", "agreed"])
            yield out.filter(pa.array(agreed >= LEAST_AGREED))

    side = lambda v: briefs.select(F.col("node").alias(v), F.col("brief").alias(f"brief_{v}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "brief_a", "brief_b").mapInArrow(run, "a long, b long, agreed int")


def checked(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, None
        for batch in batches:
            a, b, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                if b[i] != last:
                    last, of_last = b[i], np.unique(shingle_hashes(y.as_py()))
                keep.append(jaccard(np.unique(shingle_hashes(x.as_py())), of_last) >= similarity)
            yield pa.record_batch([pa.array([v for v, k in zip(a, keep, strict=True) if k], pa.int64()), pa.array([v for v, k in zip(b, keep, strict=True) if k], pa.int64())], names=["a", "b"])

    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def texts_of(docs: DataFrame, nodes: DataFrame, within: DataFrame) -> DataFrame:
    """(node, text) of the nodes `within`, from one document of each."""
    wanted = nodes.join(within, "node", "left_semi").select("node", "first.*")
    text = text_or_empty()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_key"), row_key(text).alias("text_key"), text.alias("text"))
    return saved(rows.join(wanted, ["doc_key", "text_key"]).dropDuplicates(["node"]).select("node", "text"), "op7-texts")


def rarest_shingles(texts: DataFrame, similarity: float) -> DataFrame:
    """(node, size, token, place): the shingles of each set that others hold as well, from
    the rarest on, up to the last place at which a similar set may first meet it. Places
    count those held by one set alone, which come before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 64):
                part = batch.slice(first, 64)
                sets = [np.unique(shingle_hashes(t)) for t in part.column(1).to_pylist()]
                sizes = np.array([len(s) for s in sets], np.int32)
                columns = [np.repeat(part.column(0).to_numpy(), sizes), np.repeat(sizes, sizes), np.concatenate(sets).view(np.int64)]
                yield pa.record_batch(list(map(pa.array, columns)), names=["node", "size", "token"])

    tokens = saved(texts.mapInArrow(run, "node long, size int, token long"), "op7-tokens")
    held = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    ordered = tokens.join(held, "token").groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("tokens"))
    alone = F.col("size") - F.size("tokens")
    last = F.floor((1 - similarity) * F.col("size") + 1e-6).cast("int")
    begun = ordered.select("node", "size", alone.alias("alone"), F.posexplode(F.slice("tokens", F.lit(1), F.greatest(last - alone + 1, F.lit(0)))).alias("nth", "t"))
    return begun.select("node", "size", "t.token", (F.col("alone") + F.col("nth")).alias("place"))


def crowd_pairs(rarest: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of different components of which a common shingle stands early
    enough in both sets. The commonest component of each shingle is only held against the
    others, so that one large component costs no pairs of its own."""
    rows = rarest.join(labels, "node")
    most = rows.groupBy("token", "label").agg(F.count("*").alias("n")).groupBy("token").agg(F.max_by("label", F.struct("n", "label")).alias("home"), F.count("*").alias("labels")).where("labels > 1")
    rows = saved(rows.join(most.select("token", "home"), "token"), "op7-early")
    x, y = (rows.select("token", "home", *(F.col(c).alias(f"{c}_{v}") for c in ("node", "label", "size", "place"))) for v in ("x", "y"))
    once = (F.col("label_y") == F.col("home")) | (F.col("label_x") > F.col("label_y"))
    enough = F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y")) >= similarity / (1 + similarity) * (F.col("size_x") + F.col("size_y")) - 1e-6
    met = x.where("label_x <> home").join(y.drop("home"), "token").where("label_x <> label_y").where(once).where(enough)
    return met.select(F.greatest("node_x", "node_y").alias("a"), F.least("node_x", "node_y").alias("b")).distinct()


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, label) for the nodes of links (a, b): label is the least node that can
    be reached. Large-star and small-star steps alternate until nothing changes."""

    def star(edges: DataFrame, small: bool) -> DataFrame:
        both = edges.union(edges.select("b", "a")) if not small else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both.join(least, "a")
        if small:
            new = joined.select(F.col("b").alias("x"), "m").union(least.select(F.col("a").alias("x"), "m"))
        else:
            new = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("x"), "m")
        return new.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()

    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        edges = saved(star(star(edges, small=False), small=True), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots.select("node", F.col("node").alias("label")))


def node_classes(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketches, the nodes, and (node, label) for all nodes that are linked to another."""
    sketched = saved(sketches(docs), "op7-sketches")
    every = numbered_nodes(sketched)
    nodes = every.where("sketch is not null")
    keyed = banded(nodes)
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = saved(keyed.join(shared, "key"), "op7-buckets")
    within = saved(buckets.groupBy("node").agg(F.sum("n").alias("degree")), "op7-within")
    briefs = saved(brief(nodes.join(within.select("node"), "node")), "op7-briefs")
    buckets = buckets.select("key", "node")
    texts = texts_of(docs, nodes, within)

    links, labels, tried = None, None, None
    ordered = lambda v, w: (F.greatest(v, w).alias("a"), F.least(v, w).alias("b"))
    for n_round in range(ROUNDS + 1):
        # Rows of the buckets that still hold several components.
        labelled = buckets.withColumn("label", F.col("node")) if labels is None else buckets.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
        several = labelled.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("labels"), F.sum("n").alias("n")).where("labels > 1")
        rows = saved(labelled.join(several.select("key", "n"), "key"), "op7-open")
        if n_round == ROUNDS:
            break
        drawn = F.struct((-F.col("degree")).alias("d"), F.xxhash64("node", F.lit(n_round)).alias("h"), F.col("node").alias("center"), F.col("label").alias("center_label"))
        ranked = rows.join(within, "node") if n_round == 0 else rows.withColumn("degree", F.lit(0))
        centers = ranked.groupBy("key").agg(F.min(drawn).alias("c")).select("key", "c.center", "c.center_label")
        pairs = rows.join(centers, "key").where("label <> center_label").select(*ordered("node", "center"), "node").distinct()
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        found = likely(pairs.select("a", "b").distinct(), briefs)
        # For each node its best centers; each pair was drawn by one of its two nodes, or both.
        best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("agreed"), "a", "b"))
        chosen = saved(found.join(pairs, ["a", "b"]).withColumn("_r", best).where(F.col("_r") <= BEST).select("a", "b").distinct(), "op7-tried")
        tried = chosen if tried is None else tried.union(chosen)
        good = saved(checked(chosen, texts, similarity), "op7-links")
        links = good if links is None else links.union(good)
        labels = components(links, "op7-trees")

    # Sets of such a similarity are of like size.
    sized = rows.where(F.col("n") <= CROWD).join(nodes.select("node", "size"), "node")
    x, y = (sized.select("key", F.col("node").alias(v), F.col("label").alias(f"label_{v}"), F.col("size").alias(f"size_{v}")) for v in ("x", "y"))
    like = F.least("size_x", "size_y") >= similarity * F.greatest("size_x", "size_y")
    few = x.join(y, "key").where("label_x > label_y").where(like).select(*ordered("x", "y"))
    crowded = saved(rows.where(F.col("n") > CROWD).select("node", "label").distinct(), "op7-crowded")
    rarest = rarest_shingles(texts.join(crowded, "node", "left_semi"), similarity)
    pairs = few.union(crowd_pairs(rarest, crowded, similarity)).distinct()
    pairs = pairs.join(tried, ["a", "b"], "left_anti")
    pairs = saved(likely(pairs, briefs).select("a", "b"), "op7-pairs")
    good = saved(checked(pairs, texts, similarity), "op7-links")
    return sketched, every, components(links.union(good), "op7-classes")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, class_size: class_id is the least doc_id of the class."""
    sketched, nodes, labels = node_classes(docs, similarity)
    labelled = nodes.join(labels, "node", "left").select("high", "low", F.coalesce("label", "node").alias("label"), "first.doc_key", "n")
    classes = labelled.groupBy("label").agg(F.min("doc_key").alias("class_id"), F.sum("n").alias("class_size"))
    of_node = labelled.join(classes, "label").select("high", "low", "class_id", "class_size")
    real = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c)).alias(c.replace("doc_key", "doc_id"))
    return sketched.select("doc_key", "high", "low").join(of_node, ["high", "low"]).select(real("doc_key"), real("class_id"), "class_size")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, all columns, without those that have a like one of lesser doc_id."""
    _, nodes, labels = node_classes(docs, similarity)
    stay = nodes.join(labels, "node", "left").groupBy(F.coalesce("label", "node")).agg(F.min("first").alias("first")).select(F.col("first.doc_key").alias("_doc_key"), F.col("first.text_key").alias("_text_key"))
    keyed = docs.withColumns({"_doc_key": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)), "_text_key": row_key(text_or_empty())})
    return keyed.join(stay, ["_doc_key", "_text_key"], "left_semi").dropDuplicates(["_doc_key", "_text_key"]).drop("_doc_key", "_text_key")
