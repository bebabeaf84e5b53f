"""Operator 13, spelling variants: words one edit apart, grouped under the commonest form.

Words are counted in all documents, a task adding up its own before the shuffle. Two
words one edit apart agree on all but one place, so that they meet under a key made of
what lies before and behind that place: a key (m, lo, hi) holds the words whose longer
partner has m code points and differs at a place in [lo, hi), with equal first `lo` and
last `m - hi` code points. Keys begin with the two halves. One that holds more than
`BUCKET` words is halved again, at the narrowest to a single place, where at most one
word for each letter is left; so no key grows with the vocabulary.

Within a key, the words are sorted (backwards where it is the end that they share) and
scanned once for each word. The edit matrix is kept as rows of three cells around the
diagonal, one row a prefix; the next word reuses the rows of the prefix it shares with
the one before, and a prefix whose cells are all above one edit passes over every word
that begins with it.

A word's form is its near word of largest count, ties by code-point order, if that is at
least `RATIO` times as common; forms are followed by doubling steps, as each step
multiplies the count.

Defined cases: null text has no words; a null doc_id counts as the empty text in the
hash that decides deletions; repeated rows are counted each; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_sql, saved, text_or_empty

#: Code points of the shortest word, and the least number of its occurrences.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: How much commoner a form is than its variant.
RATIO = 10
#: A run whose hash this number divides loses a code point.
DAMAGED = 31
#: Words of a key up to which it is scanned as it is.
BUCKET = 64
#: Distinct words that a task adds up before it hands them on.
HELD = 200_000
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")


# --- within a task ----------------------------------------------------------


def counted(doc_id: int | None, text: bytes, totals: Counter) -> None:
    """Add the words of a text, some damaged, to `totals`."""
    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    runs = _RUN.findall(text.lower().decode("utf-8", "replace"))  # bytes.lower() changes A-Z only
    for run, n in Counter(runs).items():
        h = zlib.crc32(run.encode("utf-8"), before)
        if h % DAMAGED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        totals[run] += n


def shared_prefixes(words: list[str]) -> list[int]:
    """Code points that each word shares with the one before it."""
    out = [0] * len(words)
    for j in range(1, len(words)):
        a, b = words[j - 1], words[j]
        n = min(len(a), len(b))
        k = 0
        while k < n and a[k] == b[k]:
            k += 1
        out[j] = k
    return out


def near_pairs(words: list[str]) -> list[tuple[int, int]]:
    """The pairs (i, j), i < j, of a sorted list of distinct words that are one edit apart."""
    shared = shared_prefixes(words)
    out = []
    for i, word in enumerate(words):
        size = len(word)
        # rows[d]: edits from the first d code points of the scanned word to the first d - 1, d, d + 1 of `word`.
        rows = [(2, 0, 1)] + [(1, 0, 1)] * size
        known = size  # rows up to here belong to the word before
        j = i + 1
        while j < len(words):
            other = words[j]
            d = min(shared[j], known)
            low, mid, high = rows[d]
            dead = 0
            while d < len(other):
                c = other[d]
                a = min(low + (d < 1 or d > size or c != word[d - 1]), mid + 1)
                b = min(mid + (d >= size or c != word[d]), high + 1, a + 1)
                e = min(high + (d + 1 >= size or c != word[d + 1]), b + 1)
                low, mid, high = a, b, e
                d += 1
                if d < len(rows):
                    rows[d] = (a, b, e)
                else:
                    rows.append((a, b, e))
                if low > 1 and mid > 1 and high > 1:
                    dead = d
                    break
            known = d
            j += 1
            if dead:
                while j < len(words) and shared[j] >= dead:
                    j += 1
                # Every word passed over shares those `dead` code points, and so does what comes next up to shared[j].
                continue
            at = size - d
            if at in (-1, 0, 1) and (low, mid, high)[at + 1] == 1:
                out.append((i, j - 1))
    return out


# --- Spark jobs -------------------------------------------------------------


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of enough code points and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counted(doc_id, text.as_py(), totals)
                if len(totals) > HELD:
                    yield out()
                    totals.clear()
        yield out()

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def keyed(rows: DataFrame) -> DataFrame:
    """Add the key of rows (m, lo, hi, word, n). Keys that collide only share a scan."""
    before = F.substring("word", F.lit(1), F.col("lo"))
    behind = F.substring("word", F.length("word") - (F.col("m") - F.col("hi")) + 1, F.col("m") - F.col("hi"))
    return rows.withColumn("key", F.xxhash64("m", "lo", "hi", before, behind))


def halved(lo: Column, hi: Column) -> Column:
    middle = F.floor((lo + hi) / 2).cast("int")
    return F.array(F.struct(lo.alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), hi.alias("hi")))


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, other_n): each pair of words one edit apart, both ways."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, int]] = []
            for backwards, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = {m["word"]: m["n"] for m in members}
                listed = sorted(w[::-1] for w in n) if backwards else sorted(n)
                for i, j in near_pairs(listed):
                    a, b = (listed[i][::-1], listed[j][::-1]) if backwards else (listed[i], listed[j])
                    out += [(a, b, n[b]), (b, a, n[a])]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["word", "other", "other_n"])

    longer = words.withColumn("m", F.explode(F.array(F.length("word"), F.length("word") + 1)))
    rows = longer.withColumn("range", F.explode(halved(F.lit(0), F.col("m")))).select("m", "range.lo", "range.hi", "word", "n")
    ready = None
    while True:
        rows = keyed(rows)
        sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
        rows = saved(rows.join(sizes, "key"), "op13-keys")
        fits = (F.col("size") <= BUCKET) | (F.col("hi") - F.col("lo") <= 1)
        ready = rows.where(fits) if ready is None else ready.union(rows.where(fits))
        rows = rows.where(~fits)
        if rows.isEmpty():
            break
        rows = rows.withColumn("range", F.explode(halved(F.col("lo"), F.col("hi")))).select("m", "range.lo", "range.hi", "word", "n")
    # At most BUCKET words a key, or one for each letter.
    groups = ready.groupBy("key").agg(F.first(F.col("lo") < F.col("m") - F.col("hi")).alias("backwards"), F.collect_list(F.struct("word", "n")).alias("members"))
    return groups.select("backwards", "members").mapInArrow(run, "word string, other string, other_n long").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following `form` ends; counts grow tenfold a step, so a few doublings do."""
    reached = saved(forms.select("word", F.col("form").alias("root")), "op13-roots")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = reached.join(onward, "root", "left")
        reached = saved(further.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "op13-roots")
        if reached.where("moved").isEmpty():
            return reached.select("word", "root")
        reached = reached.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word."""
    words = saved(vocabulary(docs), "op13-words")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("form"))).alias("best"))
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.m")).alias("form_n"))
    common = F.col("form_n") >= RATIO * F.col("n")
    judged = saved(joined.select("word", "n", "n_near", F.when(common, F.col("form")).alias("form"), F.when(common, F.col("form_n")).alias("form_n")), "op13-forms")
    ends = roots(judged.where("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE_SQL = f"""
with recursive runs as (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{7,}}')) as run from documents
), each as (
    select doc_id, run, count(*) as n from runs group by all
), hashed as (
    select run, n, {crc32_sql("coalesce(doc_id::varchar, '') || ':' || run")} as h from each
), words as (
    select word, sum(n)::bigint as n from (
        select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed
    ) where length(word) >= 7 group by word having sum(n) >= 2
), cut as (
    select word, n, length(word) as size, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from words, unnest(range(1, length(word) + 1)) as t(i)
), near as (
    select a.word, b.word as other, b.n as other_n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
    union select a.word, b.word, b.n from cut a join words b on a.rest = b.word
    union select b.word, a.word, a.n from cut a join words b on a.rest = b.word
), best as (
    select word, count(*) as n_near, first(other order by other_n desc, other) as form, max(other_n) as form_n from near group by word
), judged as (
    select w.word, case when form_n >= 10 * w.n then form end as form, w.n, coalesce(n_near, 0) as n_near, case when form_n >= 10 * w.n then form_n end as form_n
    from words w left join best b on w.word = b.word
), walk as (
    select word, word as root, 0 as step from judged
    union all select k.word, j.form, step + 1 from walk k join judged j on k.root = j.word where j.form is not null
), ends as (select word, last(root order by step) as root from walk group by word)
select j.word, j.form, e.root, j.n, j.n_near, j.form_n from judged j join ends e on j.word = e.word
"""
