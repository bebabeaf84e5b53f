"""Operator 6, preference formatting, by DataFrame operations.

A pair holds a chosen and a rejected conversation. Their longest common prefix of
turns (equal role and text) is rendered once as the prompt; the turns that follow are
rendered as two completions, each with the character spans of the assistant's texts,
which alone bear loss.

Two sources of pairs:

- `sibling`: conversations that open with the same turn; each is paired with the next
  one in order of conv_id;
- `swapped`: each conversation against itself with its last assistant turn replaced
  by that of the next conversation in order of conv_id (after the last: the first).

The next one is found by numbers given range by range, so that a very common opening is
dealt out.

Defined cases: null role or text is empty; turns of one number are ordered by role and
text; null turns come first; rows with null conv_id belong to no conversation; a
conversation without an assistant turn is in no swapped pair, nor is the only one that
has any; identical conversations have empty completions; an empty table gives no rows;
repeated rows are repeated turns; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import numbered
from .common import saved



def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>) in order."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def following(rows: DataFrame, *by: str) -> DataFrame:
    """(chosen_id, rejected_id): each conv_id and the next one of equal `by`. Rows are
    numbered by ranges and met with the number after theirs, so that many of one `by`
    are spread like all others."""
    at = numbered(rows.select("conv_id", *by), "_nth", *by, "conv_id")
    after = at.select((F.col("_nth") - 1).alias("_nth"), F.col("conv_id").alias("rejected_id"), *by)
    return at.join(after, ["_nth", *by]).select(F.col("conv_id").alias("chosen_id"), "rejected_id")


def siblings(convs: DataFrame) -> DataFrame:
    """Pairs (kind, chosen_id, rejected_id, a, b) of conversations with one opening."""
    first = F.col("turns")[0]
    pairs = following(convs.select("conv_id", F.sha2(F.concat_ws("\n", first["role"], first["text"]), 256).alias("opening")), "opening")
    left = convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a"))
    right = convs.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("b"))
    return pairs.join(left, "chosen_id").join(right, "rejected_id").select(F.lit("sibling").alias("kind"), "chosen_id", "rejected_id", "a", "b")


def swapped(convs: DataFrame) -> DataFrame:
    """Pairs of a conversation and its copy that ends in the next one's last reply."""
    roles = F.transform("turns", lambda t: t["role"])
    at = F.size(roles) - F.array_position(F.reverse(roles), "assistant").cast("int") + 1
    replying = convs.select("conv_id", "turns", F.when(F.array_contains(roles, "assistant"), at).alias("at")).where("at is not null")
    pairs = following(replying)
    low, high = replying.agg(F.min("conv_id"), F.max("conv_id")).first()
    if low != high:
        pairs = pairs.union(replying.where(F.col("conv_id") == high).select("conv_id", F.lit(low).alias("rejected_id")))
    left = replying.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a"), "at")
    reply = replying.select(F.col("conv_id").alias("rejected_id"), F.array(F.col("turns")[F.col("at") - 1]).alias("reply"))
    both = pairs.join(left, "chosen_id").join(reply, "rejected_id")
    return both.select(F.lit("swapped").alias("kind"), "chosen_id", "rejected_id", "a", F.concat(F.slice("a", F.lit(1), F.col("at") - 1), F.col("reply")).alias("b"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n"))), "")


def loss_spans(turns: Column) -> Column:
    """start:end of each assistant text in the rendering, comma-joined."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        start = s["at"] + F.length(t["role"]) + 5
        end = start + F.length(t["text"])
        span = F.concat_ws(":", start.cast("string"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == "assistant", F.array_append(s["out"], span)).otherwise(s["out"]).alias("out"))

    return F.array_join(F.aggregate(turns, begin, step, lambda s: s["out"]), ",")


def preferences(pairs: DataFrame) -> DataFrame:
    """Pairs (kind, chosen_id, rejected_id, a, b) rendered: n_prefix, prompt, chosen,
    rejected, chosen_loss, rejected_loss."""
    differs = F.array_position(F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y)), F.lit(False))
    both = pairs.withColumn("n_prefix", F.when(differs > 0, differs.cast("int") - 1).otherwise(F.size("a")))
    rest = lambda turns: F.slice(turns, F.col("n_prefix") + 1, F.size(turns))
    return both.select(
        "kind", "chosen_id", "rejected_id", "n_prefix", rendered(F.slice("a", F.lit(1), F.col("n_prefix"))).alias("prompt"),
        rendered(rest("a")).alias("chosen"), rendered(rest("b")).alias("rejected"), loss_spans(rest("a")).alias("chosen_loss"), loss_spans(rest("b")).alias("rejected_loss"),
    )


def format_pairs(turns: DataFrame) -> DataFrame:
    convs = saved(conversations(turns), "op6-conversations")
    return preferences(siblings(convs).union(swapped(convs)))


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
opening AS (SELECT conv_id, role, text FROM t WHERE i = 0),
reply AS (
  SELECT conv_id, max(i) AS at, arg_max(text, i) AS text FROM t WHERE role = 'assistant' GROUP BY conv_id),
p AS (
  SELECT 'sibling' AS kind, conv_id AS chosen_id,
         lead(conv_id) OVER (PARTITION BY role, text ORDER BY conv_id) AS rejected_id FROM opening
  UNION ALL
  SELECT 'swapped', conv_id, coalesce(lead(conv_id) OVER (ORDER BY conv_id), first_value(conv_id) OVER (ORDER BY conv_id))
  FROM reply WHERE (SELECT count(*) FROM reply) > 1),
pairs AS (SELECT * FROM p WHERE rejected_id IS NOT NULL),
sides AS (
  SELECT kind, chosen_id, rejected_id, 'a' AS side, t.i, t.role, t.text FROM pairs JOIN t ON t.conv_id = chosen_id
  UNION ALL
  SELECT kind, chosen_id, rejected_id, 'b', t.i, t.role, t.text FROM pairs JOIN t ON t.conv_id = rejected_id WHERE kind = 'sibling'
  UNION ALL
  SELECT kind, chosen_id, rejected_id, 'b', t.i, t.role, CASE WHEN t.i = r.at THEN d.text ELSE t.text END
  FROM pairs JOIN t ON t.conv_id = chosen_id JOIN reply r ON r.conv_id = chosen_id AND t.i <= r.at
  JOIN reply d ON d.conv_id = rejected_id WHERE kind = 'swapped'),
n AS (
  SELECT a.kind, a.chosen_id, a.rejected_id, coalesce(min(CASE WHEN b.i IS NULL THEN a.i END), count(*)) AS n_prefix
  FROM sides a LEFT JOIN sides b ON b.kind = a.kind AND b.chosen_id = a.chosen_id AND b.rejected_id = a.rejected_id
    AND b.side = 'b' AND b.i = a.i AND b.role = a.role AND b.text = a.text
  WHERE a.side = 'a' GROUP BY ALL),
lines AS (
  SELECT s.*, n.n_prefix, '<|' || role || '|>' || chr(10) || text || chr(10) AS line,
         sum(CASE WHEN i >= n_prefix THEN length(role) + length(text) + 6 ELSE 0 END)
           OVER (PARTITION BY kind, chosen_id, rejected_id, side ORDER BY i) AS upto
  FROM sides s JOIN n USING (kind, chosen_id, rejected_id))
SELECT kind, chosen_id, rejected_id, CAST(n_prefix AS INTEGER) AS n_prefix,
  coalesce(string_agg(line, '' ORDER BY i) FILTER (WHERE side = 'a' AND i < n_prefix), '') AS prompt,
  coalesce(string_agg(line, '' ORDER BY i) FILTER (WHERE side = 'a' AND i >= n_prefix), '') AS chosen,
  coalesce(string_agg(line, '' ORDER BY i) FILTER (WHERE side = 'b' AND i >= n_prefix), '') AS rejected,
  coalesce(string_agg(CAST(upto - 1 - length(text) AS BIGINT) || ':' || CAST(upto - 1 AS BIGINT), ',' ORDER BY i)
    FILTER (WHERE side = 'a' AND i >= n_prefix AND role = 'assistant'), '') AS chosen_loss,
  coalesce(string_agg(CAST(upto - 1 - length(text) AS BIGINT) || ':' || CAST(upto - 1 AS BIGINT), ',' ORDER BY i)
    FILTER (WHERE side = 'b' AND i >= n_prefix AND role = 'assistant'), '') AS rejected_loss
FROM lines GROUP BY kind, chosen_id, rejected_id, n_prefix
"""
