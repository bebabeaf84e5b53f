"""Operator 4, document fingerprints from prefix polynomial hashes.

For code points c_0 .. c_{n-1} and a base B, H[i] = sum of c_j * B**j over j < i,
modulo the Mersenne prime 2**31 - 1, for two bases. Then any span [s, e) has the
hash (H[e] - H[s]) * B**-s, whatever its place, so that spans are compared in two
look-ups and the longest common extension of two places is found by binary search.

A fingerprint holds the length, the hash of the whole text and the `K` least
distinct (scrambled) hashes of all spans of `WIDTH` code points. The likeness of two
fingerprints is 1 for equal texts, else the share of the least `K` of both that
both have, which estimates how many spans the texts share.

Each document meets the next one of descending doc_id after one shuffle: ranges of
doc_id form parts, and the first document of a part is also sent to the part before.

Defined cases: null text is the empty text; a text shorter than a span is one span,
the empty text has none (likeness 1 to the empty text, 0 to any other); equal doc_ids
are ordered by text; null doc_ids come last; the only document is its own next one;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

PRIME = (1 << 31) - 1
BASES = (1_000_003, 19_260_817)
#: Code points of a span.
WIDTH = 16
#: Span hashes kept in a fingerprint.
K = 64

_P = np.uint64(PRIME)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2**62."""
    x = (x & _P) + (x >> np.uint64(31))
    return np.where(x >= _P, x - _P, x)


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1), or of its inverse; kept for the next text."""
    key = base, inverse
    have = _powers.get(key)
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) < n:
        by = pow(pow(base, -1, PRIME) if inverse else base, len(have), PRIME)
        have = np.concatenate([have, _reduced(have * np.uint64(by))])
    _powers[key] = have
    return have[:n]


class PrefixHashes:
    """The prefix arrays of one text."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(self.codes)
        self.sums = []
        for base in BASES:
            terms = _reduced(self.codes * powers(base, self.n))
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])
            self.sums.append(_reduced(sums))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """62-bit hashes of the spans [start, end)."""
        out = []
        for base, sums in zip(BASES, self.sums, strict=True):
            gap = sums[ends] + _P - sums[starts]
            out.append(_reduced(_reduced(gap) * powers(base, self.n + 1, inverse=True)[starts]))
        return (out[0] << np.uint64(31)) | out[1]

    def windows(self, width: int = WIDTH) -> np.ndarray:
        """Hashes of all spans of `width`, in order; of the whole text if it is shorter."""
        if self.n == 0:
            return np.empty(0, np.uint64)
        width = min(width, self.n)
        out = []
        for base, sums in zip(BASES, self.sums, strict=True):
            gap = _reduced(sums[width:] + _P - sums[: len(sums) - width])
            out.append(_reduced(gap * powers(base, self.n - width + 1, inverse=True)))
        return (out[0] << np.uint64(31)) | out[1]

    def whole(self) -> int:
        return (int(self.sums[0][-1]) << 31) | int(self.sums[1][-1])


def span_hash(h: PrefixHashes, start: int, end: int) -> int:
    return int(h.spans(np.array([start]), np.array([end]))[0])


def spans_equal(a: PrefixHashes, i: int, b: PrefixHashes, j: int, length: int) -> bool:
    return span_hash(a, i, i + length) == span_hash(b, j, j + length)


def common_extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """The largest length with a[i:i+length] == b[j:j+length]."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if spans_equal(a, i, b, j, mid):
            low = mid
        else:
            high = mid - 1
    return low


def scrambled(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64 bits, so that the least hashes are a fair sample."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(32)


def least(values: np.ndarray, k: int = K) -> np.ndarray:
    """The k least distinct values, sorted."""
    n = len(values)
    if n > 64 * k:  # a bound that most likely leaves enough
        few = np.unique(values[values <= np.uint64((1 << 32) * 4 * k // n)])
        if len(few) >= k:
            return few[:k]
    return np.unique(values)[:k]


def fingerprint(n: int, whole: int, sketch: np.ndarray) -> str:
    return f"{n:x}.{whole:016x}.{sketch.astype('>u4').tobytes().hex()}"


def likeness(a: str, b: str, k: int = K) -> float:
    """From two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    x, y = (set(s[i : i + 8] for i in range(0, len(s), 8)) for s in (a.rpartition(".")[2], b.rpartition(".")[2]))
    of_both = sorted(x | y)[:k]
    return sum(v in x and v in y for v in of_both) / len(of_both) if of_both else 0.0


class Hashed:
    """A document with its prefix arrays and scrambled span hashes."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.prefix = PrefixHashes(text)
        self.spans = scrambled(self.prefix.windows())
        self.print = fingerprint(self.prefix.n, self.prefix.whole(), least(self.spans))

    def row(self, following: Hashed) -> tuple:
        n = self.prefix.n
        cut = n // 2
        head, tail = self.text[: n - cut], following.text[:cut]
        edited = head + tail
        n_head, n_tail = len(head), len(tail)
        n_edited = n_head + n_tail
        if n_edited >= WIDTH:
            # Spans of either half have their hashes; those across the cut are few.
            across = PrefixHashes(head[max(0, n_head - WIDTH + 1) :] + tail[: WIDTH - 1])
            parts = [scrambled(across.windows())] if across.n >= WIDTH else []
            if n_head >= WIDTH:
                parts.append(self.spans[: n_head - WIDTH + 1])
            if n_tail >= WIDTH:
                parts.append(following.spans[: n_tail - WIDTH + 1])
            spans = np.concatenate(parts)
        else:
            spans = scrambled(PrefixHashes(edited).windows())
        whole = 0
        for base, mine, other in zip(BASES, self.prefix.sums, following.prefix.sums, strict=True):
            both = (int(mine[n_head]) + int(other[n_tail]) * pow(base, n_head, PRIME)) % PRIME
            whole = (whole << 31) | both
        edited_print = fingerprint(n_edited, whole, least(spans))
        # The heads agree; beyond them the common extension goes on into the next document.
        kept = n_head + (common_extension(self.prefix, n_head, following.prefix, 0) if n_tail else 0)
        return (
            self.doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), self.print, edited_print,
            likeness(self.print, edited_print), likeness(self.print, following.print), min(kept, n_edited),
        )


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"


def with_next_part(docs: DataFrame, n_parts: int) -> DataFrame:
    """(part, ghost, doc_id, text): ranges of doc_id, descending with part; the first
    document of each part also stands as a ghost at the end of the part before."""
    from pyspark.ml.feature import Bucketizer

    docs = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    shares = [i / n_parts for i in range(1, n_parts)]
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), 10_000)).first()[0] if shares else None
    splits = [float("-inf"), *sorted({float(c) for c in cuts or []}), float("inf")]
    if len(splits) > 2:
        placed = Bucketizer(splits=splits, inputCol="_id", outputCol="_bucket", handleInvalid="keep").transform(docs.withColumn("_id", F.col("doc_id").cast("double")))
        part = F.lit(len(splits) - 2) - F.col("_bucket").cast("int")  # descending; nulls get the last
        placed = placed.withColumn("part", F.when(F.col("doc_id").isNull(), len(splits)).otherwise(part)).select("part", "doc_id", "text")
    else:
        placed = docs.withColumn("part", F.when(F.col("doc_id").isNull(), 1).otherwise(0)).select("part", "doc_id", "text")
    heads = {r.part: r.head for r in placed.groupBy("part").agg(F.max("doc_id").alias("head")).collect()}  # a row a part
    order = sorted(heads)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    is_head, target = F.lit(False), F.lit(None).cast("int")
    if order:
        size = max(order) + 1
        ids = F.array(*[F.lit(heads.get(p)).cast("long") for p in range(size)])
        prior = F.array(*[F.lit(before.get(p)).cast("int") for p in range(size)])
        is_head, target = F.col("doc_id").eqNullSafe(ids[F.col("part")]), prior[F.col("part")]
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("ghost"))
    ghost = F.struct(target.alias("part"), F.lit(True).alias("ghost"))
    return placed.select(F.explode(F.when(is_head, F.array(own, ghost)).otherwise(F.array(own))).alias("_at"), "doc_id", "text").select("_at.part", "_at.ghost", "doc_id", "text")


def fingerprints(docs: DataFrame, n_parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, and common_prefix, the code points at which text and edited text agree."""
    spark = docs.sparkSession
    n_parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, None
        for batch in batches:
            out = []
            for p, ghost, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    part, held = p, None
                if ghost and held is None:
                    continue  # a further ghost of the same doc_id
                now = Hashed(doc_id, text)
                if held is not None:
                    out.append(held.row(now))
                held = None if ghost else now
            columns = zip(*out, strict=True) if out else [[]] * 8
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)

    return with_next_part(docs, n_parts).repartition(n_parts, "part").sortWithinPartitions("part", "ghost", F.desc("doc_id"), "text").mapInArrow(run, _SCHEMA)
