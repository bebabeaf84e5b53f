"""Operator 11, an exact join of sets of three-word shingles at a Jaccard similarity.

Sets whose similarity reaches the threshold differ in at most H elements, which follows
from their sizes. Sizes are put into bands, each twice as wide as the one before; a band
hashes the universe of shingles into m segments, one more than its largest H. Two sets of
at most H differences are equal in some segment, and more can be asked: where each segment
i is given a[i] of 0, 1 or 2, and these add up to more than H, some segment differs in
fewer than a[i] elements. 0 leaves a segment out, 1 asks for an equal segment, 2 for one
that is equal but for one element, which the keys of the segment without each of its
elements find. The first `deleting` segments of a band have such keys.

1. Every set lists its keys in its own band, and in the band below if a similar smaller
   set may lie there. Keys that only one set holds are dropped: a segment with such a key
   is asked for at no cost.
2. Each set then gives its segments what costs the least: it leaves out the keys that
   most sets hold, as many as the sum allows. It looks for smaller sets under the keys
   that remain, while every set can be found under all of its keys.
3. Rounds of centers join what is alike without listing pairs: each key draws one of its
   nodes, the others are held against it, each against the `BEST` centers nearest to it by
   the parity below, and good links join components.
4. All pairs of different components that meet under a key that remains are listed, if
   their sizes and parities allow it: each element of a set turns over one of `PARITY` bits,
   so that two sets differ in no fewer elements than bits. Among the sets of keys with more
   than `CROWD` nodes, shingles that one set alone holds are counted before, as no pair can
   share them. Both bounds are exact.
5. All listed pairs are checked on their sets, and the components of good links are the
   classes.

No link is lost: the bounds are exact, and links inside a component cannot change it. A
set is a 64-bit hash a shingle.

Defined cases: null text and text without words have the empty set, which is linked with
nothing, copies of it included; fewer than three words are one shingle; rows of equal
doc_id are separate documents; a null doc_id sorts last in a component; an empty table
gives no rows; other columns are ignored. Whole texts are read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, text_or_empty
from .near_duplicates import components, mixed, row_key

WORDS = 3
#: 100 * intersection >= PERCENT * union.
PERCENT = 90
#: One segment of so many has keys of one deletion; one at least.
DELETING = 32
#: Rounds of centers, and centers that a node is checked against in one round.
ROUNDS, BEST = 2, 3
#: Nodes of a key from which shingles of one set alone are counted.
CROWD = 16
#: Bits of a set's parity, a multiple of 64.
PARITY = 512
#: Sets that a task remembers, to list the keys of copies once.
REMEMBERED = 1 << 20
_U = np.uint64
_NULL_ID = (1 << 63) - 1
_SIDE = 25


class _Hashes(dict):
    """Hashes of words, the commonest kept."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        h = xxh3_64_intdigest(word)
        if len(self) < 1 << 18:
            self[word] = h
        return h


def shingle_set(text: bytes, hashes: dict[bytes, int], words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes. bytes.lower() and split() know A-Z and the six
    ASCII spaces only."""
    each = text.lower().split()
    if not each:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, each), np.uint64, len(each))
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = mixed(out * _U(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    return np.unique(out)


# --- bounds -----------------------------------------------------------------


def most_different(x: int, y: int, percent: int = PERCENT) -> int:
    """Elements in which sets of sizes x and y may differ, if they are similar."""
    return (x + y) * (100 - percent) // (100 + percent)


@cache
def bands(percent: int) -> list[tuple[int, int, int, int]]:
    """(least size, end, segments, deleting segments) of each band. Smaller sets have only
    equal ones similar to them."""
    least = 1
    while most_different(least, least * 100 // percent, percent) < 1:
        least += 1
    out = []
    while least < 1 << 40:
        end = 2 * least
        m = most_different(end - 1, (end - 1) * 100 // percent, percent) + 1
        out.append((least, end, m, max(1, m // DELETING)))
        least = end
    return out


def bands_of(size: int, percent: int) -> list[int]:
    """The set's own band, and the one below if a similar smaller set may be there."""
    all_bands = bands(percent)
    if size < all_bands[0][0]:
        return []
    own = (size // all_bands[0][0]).bit_length() - 1
    least = -(-size * percent // 100)
    return [own, own - 1] if own and least < all_bands[own][0] else [own]


def segment_keys(elements: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Keys and slots of a set; a slot is side << 25 | segment << 1 | deletion, the side 1
    for the band below. All of one kind share one space of keys, so that a segment without
    an element meets an equal segment."""
    keys, slots = [], []
    for side, band in enumerate(bands_of(len(elements), percent)):
        _, _, m, deleting = bands(percent)[band]
        h = mixed(elements ^ _U(0xD6E8FEB86659FD93 * (band + 1) % (1 << 64)))
        segment = ((h >> _U(32)) * _U(m)) >> _U(32)
        order = np.argsort(segment, kind="stable")
        present, first = np.unique(segment[order], return_index=True)
        sums = np.zeros(m, np.uint64)
        sums[present] = np.add.reduceat(h[order], first)
        name = (np.arange(m, dtype=np.uint64) + _U(1)) * _U(0xA0761D6478BD642F) + _U(band)
        short = segment < deleting
        at = segment[short]
        keys += [mixed(mixed(sums) + name), mixed(mixed(sums[at] - h[short]) + name[at])]
        slots += [np.arange(m) << 1 | side << _SIDE, at.astype(np.int64) << 1 | 1 | side << _SIDE]
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    return np.concatenate(keys).view(np.int64), np.concatenate(slots).astype(np.int32)


def asked(size: int, slots: list[int], held: list[int], percent: int = PERCENT) -> list[bool]:
    """Which of a set's shared keys it looks under: those of the cheapest segments that
    add up to more than the differences it may have with a set of at most its size."""
    cost: dict[tuple[int, int, int], int] = defaultdict(int)
    for slot, n in zip(slots, held, strict=True):
        cost[slot >> _SIDE, slot >> 1 & (1 << _SIDE - 1) - 1, slot & 1] += n
    spare = []
    for side, band in enumerate(bands_of(size, percent)):
        _, end, m, deleting = bands(percent)[band]
        spare.append(m + deleting - 1 - most_different(size, min(size, end - 1), percent))
    left_out = set()
    # Costliest first. A segment can be left out altogether only with its deletions.
    for unit in sorted(cost, key=cost.__getitem__, reverse=True):
        side, segment, deletion = unit
        if unit in left_out:
            continue
        units = [unit]
        _, _, _, deleting = bands(percent)[bands_of(size, percent)[side]]
        if not deletion and segment < deleting and (side, segment, 1) not in left_out:
            units.append((side, segment, 1))
        if len(units) <= spare[side]:
            spare[side] -= len(units)
            left_out.update(units)
    return [(slot >> _SIDE, slot >> 1 & (1 << _SIDE - 1) - 1, slot & 1) not in left_out for slot in slots]


# --- Spark jobs -------------------------------------------------------------


def keyed_sets(docs: DataFrame, percent: int) -> DataFrame:
    """(node, doc_key, text_key, high, low, size, keys, slots) a row: high and low are a
    digest of the set; keys of a set that its task has seen before are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _Hashes(), set()
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                digests, sizes, keys, slots = [], [], [], []
                for text in part.column(2):
                    elements = shingle_set(text.as_py(), hashes)
                    digest = hashlib.blake2b(elements.tobytes(), digest_size=16).digest()
                    found = (np.empty(0, np.int64), np.empty(0, np.int32)) if digest in seen else segment_keys(elements, percent)
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(digest)
                    digests.append(digest)
                    sizes.append(len(elements))
                    keys.append(found[0])
                    slots.append(found[1])
                high, low = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2).T
                ends = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c))) for c in (keys, slots)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(high), pa.array(low), pa.array(sizes, pa.int32()), *lists], names=["doc_key", "text_key", "high", "low", "size", "keys", "slots"])

    text = text_or_empty()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_key"), row_key(text).alias("text_key"), text.cast("binary").alias("text"))
    found = rows.mapInArrow(run, "doc_key long, text_key long, high long, low long, size int, keys array<long>, slots array<int>")
    return saved(found.withColumn("node", F.monotonically_increasing_id()), "op11-sets")


def flat(rows: DataFrame, *lists: str) -> DataFrame:
    """A row for each element of the lists, which are of equal length, beside the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = np.diff(batch.column(1).offsets.to_numpy())
            head = pa.array(np.repeat(batch.column(0).to_numpy(), count))
            yield pa.record_batch([head, *(c.flatten() for c in batch.columns[1:])], names=list(batch.schema.names))

    kinds = dict(rows.dtypes)
    first = next(c for c in rows.columns if c not in lists)
    schema = ", ".join([f"{first} {kinds[first]}", *(f"{c} {kinds[c].removeprefix('array<').removesuffix('>')}" for c in lists)])
    return rows.select(first, *lists).mapInArrow(run, schema)


def buckets_of(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(key, node, size, asks): the keys that several sets hold, where at least one of them
    looks for others."""
    listed = rows.where(F.size("keys") > 0)
    shared = flat(listed.select("high", "keys"), "keys").groupBy("keys").agg(F.min("high").alias("a"), F.max("high").alias("b"), F.count("*").alias("n")).where("a < b").select("keys", "n")
    held = flat(listed.select("node", "keys", "slots"), "keys", "slots").join(shared, "keys")
    by_node = held.groupBy("node").agg(F.collect_list(F.struct("keys", "slots", "n")).alias("held")).join(nodes.select("node", "size"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = np.diff(batch.column(2).offsets.to_numpy())
            of = batch.column(2).flatten()
            keys, slots, n = of.field(0), of.field(1).to_pylist(), of.field(2).to_pylist()
            asks, at = [], 0
            for size, k in zip(batch.column(1).to_pylist(), count.tolist(), strict=True):
                asks += asked(size, slots[at : at + k], n[at : at + k], percent)
                at += k
            head = [pa.array(np.repeat(c.to_numpy(), count)) for c in batch.columns[:2]]
            yield pa.record_batch([keys, *head, pa.array(asks, pa.bool_())], names=["key", "node", "size", "asks"])

    asking = saved(by_node.select("node", "size", "held").mapInArrow(run, "key long, node long, size int, asks boolean"), "op11-asking")
    alive = asking.groupBy("key").agg(F.count("*").alias("n"), F.max("asks").alias("any")).where("n > 1 and any").select("key")
    return saved(asking.join(alive, "key"), "op11-buckets")


def sets_of(docs: DataFrame, nodes: DataFrame, within: DataFrame) -> DataFrame:
    """(node, elements) of the nodes `within`, from one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([shingle_set(t.as_py(), hashes).tobytes() for t in batch.column(1)], pa.binary())], names=["node", "elements"])

    wanted = nodes.join(within, "node", "left_semi").select("node", "first.*")
    text = text_or_empty()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_key"), row_key(text).alias("text_key"), text.cast("binary").alias("text"))
    found = rows.join(wanted, ["doc_key", "text_key"]).dropDuplicates(["node"]).select("node", "text")
    return saved(found.mapInArrow(run, "node long, elements binary"), "op11-elements")


def checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of similar sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda v: sets.select(F.col("node").alias(v), F.col("elements").alias(f"of_{v}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def unshared(sets: DataFrame) -> DataFrame:
    """(node, alone): how many elements no other of the sets holds; nodes with none have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(v.as_buffer()) // 8 for v in batch.column(1)]
            every = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.record_batch([pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(every)], names=["node", "element"])

    held = sets.mapInArrow(run, "node long, element long").groupBy("element").agg(F.min("node").alias("node"), F.max("node").alias("other"))
    return held.where("node = other").groupBy("node").agg(F.count("*").alias("alone"))


def parities(sets: DataFrame) -> DataFrame:
    """(node, p0, p1, ...): the parity of the elements that fall on each of PARITY bits."""
    names = [f"p{i}" for i in range(PARITY // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.zeros((len(batch), PARITY), np.uint8)
            for row, v in zip(bits, batch.column(1), strict=True):
                row[:] = np.bincount((mixed(np.frombuffer(v.as_buffer(), np.uint64)) % _U(PARITY)).astype(np.int64), minlength=PARITY) & 1
            packed = np.packbits(bits, axis=1).view(np.int64)
            yield pa.record_batch([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in packed.T)], names=["node", *names])

    return sets.mapInArrow(run, ", ".join(["node long", *(f"{n} long" for n in names)]))


def linked(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows, the nodes (a row a set: high, low, node, size, first, doc_key), and
    (node, label) for all nodes that are linked to another."""
    rows = keyed_sets(docs, percent)
    nodes = saved(rows.groupBy("high", "low").agg(F.min("node").alias("node"), F.min("size").alias("size"), F.min(F.struct("doc_key", "text_key")).alias("first")), "op11-nodes")
    buckets = buckets_of(rows, nodes, percent)
    within = saved(buckets.groupBy("node").agg(F.count("*").alias("degree")), "op11-within")
    sets = sets_of(docs, nodes, within)

    facts = saved(parities(sets), "op11-parities")
    own = [c for c in facts.columns if c.startswith("p")]
    of = lambda v: facts.select(F.col("node").alias(v), *(F.col(c).alias(f"{c}_{v}") for c in own))
    differing = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in own), F.lit(0))
    close = (100 + percent) * differing <= (100 - percent) * (F.col("size_a") + F.col("size_b"))

    links, labels, tried = None, None, None
    for n_round in range(ROUNDS + 1):
        labelled = buckets.withColumn("label", F.col("node")) if labels is None else buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        several = labelled.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n")).where("least < most").select("key", "n")
        open_rows = saved(labelled.join(several, "key"), "op11-open")
        if n_round == ROUNDS:
            break
        # At first the node that shares most keys, as the text does that others were copied from; then any.
        ranked = open_rows.join(within, "node") if n_round == 0 else open_rows.withColumn("degree", F.lit(0))
        drawn = F.struct((-F.col("degree")).alias("d"), F.xxhash64("node", "key", F.lit(n_round)).alias("h"), F.col("node").alias("b"), F.col("label").alias("center_label"), F.col("size").alias("size_b"))
        centers = ranked.groupBy("key").agg(F.min(drawn).alias("c")).select("key", "c.b", "c.center_label", "c.size_b")
        like = 100 * F.least("size", "size_b") >= percent * F.greatest("size", "size_b")
        met = open_rows.join(centers, "key").where("label <> center_label").where(like).select(F.col("node").alias("a"), "b", F.col("size").alias("size_a"), "size_b").distinct()
        near = met.join(of("a"), "a").join(of("b"), "b").where(close).select("a", "b", differing.alias("d"))
        best = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
        chosen = near.withColumn("_r", best).where(F.col("_r") <= BEST).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        chosen = saved(chosen if tried is None else chosen.join(tried, ["a", "b"], "left_anti"), "op11-tried")
        tried = chosen if tried is None else tried.union(chosen)
        good = saved(checked(chosen, sets, percent), "op11-links")
        links = good if links is None else links.union(good)
        labels = components(links, "op11-trees")

    crowded = open_rows.where(F.col("n") > CROWD).select("node").distinct()
    alone = unshared(sets.join(crowded, "node", "left_semi"))
    still = facts.join(open_rows.select("node").distinct(), "node", "left_semi")
    still = saved(still.join(alone, "node", "left").withColumn("alone", F.coalesce("alone", F.lit(0))), "op11-facts")
    known = open_rows.join(still, "node").withColumn("alone", F.when(F.col("n") > CROWD, F.col("alone")).otherwise(0))
    # What a set can share at most, with the smallest set that may be similar.
    known = known.where((100 + percent) * (F.col("size") - F.col("alone")) >= percent * (F.col("size") + F.ceil(F.col("size") * percent / 100)))
    side = lambda v, *more: known.select("key", F.col("node").alias(v), *more, *(F.col(c).alias(f"{c}_{v}") for c in ("label", "size", "alone", *own)))
    both = F.least(F.col("size_a") - F.col("alone_a"), F.col("size_b") - F.col("alone_b"))
    enough = (100 + percent) * both >= percent * (F.col("size_a") + F.col("size_b"))
    smaller = (F.col("size_b") < F.col("size_a")) | ((F.col("size_b") == F.col("size_a")) & (F.col("b") < F.col("a")))
    met = side("a", "asks").where("asks").join(side("b"), "key").where("label_a <> label_b").where(smaller).where(enough).where(close)
    pairs = met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = saved(pairs.join(tried, ["a", "b"], "left_anti"), "op11-pairs")
    good = saved(checked(pairs, sets, percent), "op11-links")
    return rows, nodes, components(links.union(good), "op11-classes")


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: the least doc_id that links reach."""
    rows, nodes, labels = linked(docs, percent)
    labelled = nodes.where("size > 0").join(labels, "node", "left").select("high", "low", F.coalesce("label", "node").alias("label"), F.col("first.doc_key").alias("doc_key"))
    least = labelled.groupBy("label").agg(F.min("doc_key").alias("component_key"))
    of_set = labelled.join(least, "label").select("high", "low", "component_key")
    real = lambda c, name: F.when(c != _NULL_ID, c).alias(name)
    joined = rows.select("doc_key", "high", "low", "size").join(of_set, ["high", "low"], "left")
    return joined.select(real(F.col("doc_key"), "doc_id"), F.col("size").cast("long").alias("n_shingles"), real(F.coalesce("component_key", "doc_key"), "component_id"))


ORACLE_SQL = r"""
with recursive words as (
    select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
    select doc_id, r, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from words
), alike as (
    select min(r) as node, min(doc_id) as doc_id, list_sort(s) as s, len(s) as n from sets where len(s) > 0 group by list_sort(s), len(s)
), elements as (
    select node, n, unnest(s) as e from alike
), met as (
    select a.node as a, b.node as b, a.n + b.n as total, count(*) as common from elements a join elements b on a.e = b.e and a.node < b.node and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) group by 1, 2, 3
), links as (
    select a, b from met where 100 * common >= 90 * (total - common) union select b, a from met where 100 * common >= 90 * (total - common)
), reach as (
    select a as node, a as other from links union select k.node, l.b from reach k join links l on l.a = k.other
), least as (
    select k.node, min(x.doc_id) as doc_id from reach k join alike x on x.node = k.other group by k.node
), named as (
    select x.s, coalesce(l.doc_id, x.doc_id) as component_id from alike x left join least l on l.node = x.node
)
select t.doc_id, len(t.s)::bigint as n_shingles, coalesce(d.component_id, t.doc_id) as component_id from sets t left join named d on d.s = list_sort(t.s)
"""
