"""Operator 5, secret scans, by SQL functions only.

Three patterns give the base spans. Beyond them, every run of 20 or more token
characters that mixes letters and digits is a candidate: a window of `WINDOW`
characters slides over it, the count of each character is kept up to date as one
enters and one leaves, and with it the sum of c * log2(c), from which the window's
Shannon entropy follows. Windows above the threshold of the candidate's character
class make a span, unless the allow-list names the candidate or a base span covers it.
Placeholder words part candidates, so that they hide no secret that stands beside them.

Positions are code points: splitting a text at a pattern gives the lengths between
its matches, and so the places of the matches.

Arrays are built in blocks, so that the work grows with the number of matches and not its
square, and the patterns of the allow-list take no step back, so that no text is too long:
one word or path of 100,000 characters and 50,000 matches in a text are tested.

Defined cases: null text is the empty text and has no span; repeated rows are scanned
each; null doc_ids are kept; an empty table gives no rows; other columns are ignored
by `scan` and kept by `redact`.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# The patterns of the contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are matched whole, so that the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
MIN_ASSIGNED = 8
KINDS = ("assign", "access", "hex", "entropy")

#: What stands for a secret in examples. Candidates end before it and begin anew after it.
PLACEHOLDER = "(?i:example|placeholder|x{8}|0{8}|12345678)"
RUN = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}"
CANDIDATE = rf"(?:(?<![A-Za-z0-9+/=_-])|(?<={PLACEHOLDER}))(?:(?!{PLACEHOLDER})[A-Za-z0-9+/=_-]){{20,}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
WINDOW = 20
#: Character class of a candidate, the first that fits, and the least entropy in bits of a hot window.
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 3.0), ("capitals", r"^[A-Z0-9]+$", 3.4), ("alphanumeric", r"^[A-Za-z0-9]+$", 3.6), ("base64", r".", 3.75))
#: Candidates that are no secrets: UUIDs, dates and numbers with words, paths of words.
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[A-Za-z]++(?:[-_/=+][A-Za-z]++)*+[-_/=+]?[0-9]{1,6}$",
    r"^(?:[a-z]++|[0-9]{1,6}+)(?:[-_/=+]++(?:[a-z]++|[0-9]{1,6}+))*+$",
)
#: Elements that a scan appends one by one before it hands on their array.
BLOCK = 256

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def scanned(items: Column, begin: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """The arrays that step(state, item) gives beside the next state, one after another, for
    all items in order. out: the type of their elements."""
    none, n = F.array().cast(f"array<{out}>"), F.size(items)
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda k: F.slice(items, k * BLOCK + 1, BLOCK)))
    once = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  evaluates x once

    def one(state: Column, x: Column) -> Column:
        after, made = step(state["at"], x)
        return F.struct(after.alias("at"), F.concat(state["out"], made).cast(f"array<{out}>").alias("out"))

    def block(state: Column, of: Column) -> Column:
        found = F.aggregate(of, F.struct(state["at"].alias("at"), none.alias("out")), one)
        return once(found, lambda r: F.struct(r["at"].alias("at"), F.concat(state["out"], F.array(r["out"])).alias("out")))

    start = F.struct(begin.alias("at"), F.array().cast(f"array<array<{out}>>").alias("out"))
    return F.coalesce(F.aggregate(blocks, start, block, lambda s: F.flatten(s["out"])), none)


def matches(text: Column, pattern: str, only_with: str | None = None) -> Column:
    """array of (start, end, value) of a pattern's matches. only_with: a cheaper pattern
    that every text with a match matches as well."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("value")).cast("array<struct<gap:string,value:string>>")

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["value"])
        return end, F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))

    kind = "struct<start:int,end:int,value:string>"
    # Most texts have no match: one search decides it.
    return F.coalesce(F.when(text.rlike(only_with or pattern), scanned(pairs, F.lit(0), step, kind)), F.array().cast(f"array<{kind}>"))


def spans(found: Column, kind: str, keep=None) -> Column:
    """(start, kind, end) of matches; kinds by their place in KINDS."""
    found = F.filter(found, keep) if keep else found
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"))).cast(_SPAN)


def assign_spans(text: Column) -> Column:
    """A match ends with its second group, whose length the match alone decides."""
    value = lambda m: F.regexp_extract(m["value"], ASSIGN, 2)
    return spans(matches(text, ASSIGN), "assign", lambda m: F.length(value(m)) >= MIN_ASSIGNED)


def hot_range(value: Column, threshold: Column) -> Column:
    """(first, last): the characters of a candidate from the start of its first window
    with the threshold's entropy to the end of its last one; last 0 if there is none."""
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    symbols = F.transform(F.split(value, ""), lambda ch: F.instr(F.lit(ALPHABET), ch))
    symbols = F.filter(symbols, lambda s: s > 0)
    begin = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("first"), F.lit(0).alias("last"), symbols.alias("symbols"),
        threshold.cast("double").alias("threshold"),  # taken once, as it may look at the whole candidate
    )

    def step(s: Column, i: Column) -> Column:
        enters = s["symbols"][i]
        leaves = F.when(i >= WINDOW, s["symbols"][i - WINDOW]).otherwise(F.lit(0))
        n_in = s["counts"][enters - 1]
        # A symbol that enters as it leaves keeps its count.
        n_out = s["counts"][leaves - 1]
        same = enters == leaves
        without = F.when(leaves > 0, weight[n_out - 1] - weight[n_out]).otherwise(F.lit(0.0))
        total = F.when(same, s["sum"]).otherwise(s["sum"] + weight[n_in + 1] - weight[n_in] + without)
        counts = F.when(same, s["counts"]).otherwise(F.transform(s["counts"], lambda c, j: c + F.when(j == enters - 1, 1).when(j == leaves - 1, -1).otherwise(0)))
        entropy = math.log2(WINDOW) - total / WINDOW
        hot = (i >= WINDOW - 1) & (entropy >= s["threshold"])
        first = F.when(hot & (s["last"] == 0), i - (WINDOW - 1)).otherwise(s["first"])
        return F.struct(counts.alias("counts"), total.alias("sum"), first.alias("first"), F.when(hot, i + 1).otherwise(s["last"]).alias("last"), s["symbols"].alias("symbols"), s["threshold"].alias("threshold"))

    return F.aggregate(F.sequence(F.lit(0), F.length(value) - 1), begin, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def entropy_spans(text: Column) -> Column:
    def candidate(m: Column) -> Column:
        v = m["value"]
        allowed = F.lit(False)
        for pattern in ALLOWED:
            allowed = allowed | v.rlike(pattern)
        return v.rlike("[0-9]") & v.rlike("[A-Za-z]") & ~allowed

    threshold = lambda v: F.when(v.rlike(CLASSES[0][1]), CLASSES[0][2]).when(v.rlike(CLASSES[1][1]), CLASSES[1][2]).when(v.rlike(CLASSES[2][1]), CLASSES[2][2]).otherwise(CLASSES[3][2])
    scored = F.transform(F.filter(matches(text, CANDIDATE, RUN), candidate), lambda m: F.struct(m["start"].alias("start"), hot_range(m["value"], threshold(m["value"])).alias("hot")))
    hot = F.filter(scored, lambda m: m["hot"]["last"] > 0)
    return F.transform(hot, lambda m: F.struct((m["start"] + m["hot"]["first"]).alias("start"), F.lit(KINDS.index("entropy")).alias("kind"), (m["start"] + m["hot"]["last"]).alias("end"))).cast(_SPAN)


def uncovered(base: Column, hot: Column) -> Column:
    """The base spans and the hot ranges that none of them covers, sorted."""

    def step(end: Column, x: Column) -> tuple[Column, Column]:
        is_hot = x["kind"] == KINDS.index("entropy")
        kept = F.when(is_hot & (end >= x["end"]), F.array().cast(_SPAN)).otherwise(F.array(x).cast(_SPAN))
        return F.when(is_hot, end).otherwise(F.greatest(end, x["end"])), kept

    # In order of start, base spans first: what covers a range has begun by then.
    every = F.array_sort(F.concat(base, hot))
    return F.when(F.size(hot) > 0, scanned(every, F.lit(-1), step, "struct<start:int,kind:int,end:int>")).otherwise(base)


def with_spans(docs: DataFrame, text: Column, base: str = "base", every: str = "every") -> DataFrame:
    """Add the sorted base spans, and all spans: base ones and hot ranges that none of them covers."""
    found = docs.withColumn(base, F.array_sort(F.concat(assign_spans(text), spans(matches(text, ACCESS), "access"), spans(matches(text, HEX), "hex"))))
    found = found.withColumn("_hot_spans", entropy_spans(text))
    return found.withColumn(every, uncovered(F.col(base), F.col("_hot_spans"))).drop("_hot_spans")


def listed(of: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row."""
    found = with_spans(docs.select("doc_id", text_or_empty().alias("text")), F.col("text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("every")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows with every span replaced by a mark, and n_chars to match where there is one."""
    found = with_spans(docs, text_or_empty(), "_base_spans", "_all_spans")
    every, text = F.col("_all_spans"), F.col("text")
    n = F.size(every)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda k: F.slice(every, k * BLOCK + 1, BLOCK))

    def one(state: Column, s: Column) -> Column:
        # `part` is the text from `first` on.
        kept = F.concat(state["out"], F.substring(state["part"], state["at"] - state["first"] + 1, s["start"] - state["at"]), F.lit(mark))
        return F.struct(state["part"].alias("part"), state["first"].alias("first"), F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], kept).otherwise(state["out"]).alias("out"))

    def block(state: Column, of: Column) -> Column:
        last = F.greatest(state["at"], F.array_max(F.transform(of, lambda s: s["end"])))
        begin = F.struct(F.substring(text, state["at"] + 1, last - state["at"]).alias("part"), state["at"].alias("first"), state["at"].alias("at"), F.lit("").alias("out"))
        done = F.aggregate(of, begin, one, lambda s: s["out"])
        return F.struct(last.alias("at"), F.concat(state["out"], F.array(done)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(blocks, start, block, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    out = found.withColumn("text", F.when(n > 0, clean).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(n > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop("_base_spans", "_all_spans")
