"""Operator 12, repair of damaged conversations by Hirschberg's divide and conquer.

A conversation is an optional system turn and then user and assistant by turns. The
cheapest edits (keep, set the role, delete, insert) follow from a walk over four states:
nothing yet, after the system, after a user, after an assistant. A move is one row's
edit with the insertions before it, so that a state's cheapest edits from a given start
are never the beginning of another state's, and one pass can carry the order of the
four edit strings beside the four costs, without the strings.

A run of rows is cut in the middle. The forward costs and order from its first state
meet the backward costs to its last state; of the cheapest crossings the one with the
least string before it is taken, which makes the whole string least, and both halves
are solved alike. Nothing but four costs and ranks is held for a row.

Rows are put in order by a range sort, so that a long conversation lies in several
tasks. Each task cuts its rows into chunks of at most `CHUNK_ROWS` rows and
`CHUNK_CHARS` code points (or one row), and gives for each the costs and ranks from
every state to every state. One row a conversation gathers these matrices, chooses the
states between chunks in the same way, and the chunks are then solved side by side.
Texts of a conversation are never gathered; the digest of one of several chunks is
taken as they pass in order.

Defined cases: a null role or text is one space, as are nulls in the text that is hashed;
rows of one turn are taken in the order of role and text, copies of a row together; rows
of null conv_id are one conversation; a role is known by its first letter; an empty table
gives no rows; other columns are ignored. Whole texts are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_sql, saved

#: Rows and code points of a chunk.
CHUNK_ROWS, CHUNK_CHARS = 1024, 1 << 18
#: What edits cost. An undeleted truncated row costs TRUNCATED more.
RETOLD, DELETED, INSERTED, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: Letters of roles and faults of rows; a row's code is letter + 4 * fault.
LETTERS, FAULTS = ("s", "u", "a", "other"), ("", "truncated", "blank", "duplicate")
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The state after a user or assistant turn, by the state before; what has no entry must first see one.
FOLLOWS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Turns to insert after the last row.
ENDING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: Characters that do not count as text.
SPACES = " \t\n\x0b\f\r"
_FAR = 1 << 60

_CHUNK = (
    "conv string, conv_id long, part int, seq int, n long, codes binary, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, illegal long,"
    " first int, last int, first_turn long, last_turn long, turns long, costs array<long>, ranks array<int>"
)


# --- edits ------------------------------------------------------------------


@cache
def moves(code: int) -> list[list[tuple[int, str]]]:
    """(cost, edits) from each state to each state by one row of this code and the
    insertions before it; of equal costs the least edits."""
    letter, fault = LETTERS[code % 4], FAULTS[code // 4]
    extra = TRUNCATED if fault == "truncated" else 0
    out = [[(_FAR, "")] * 4 for _ in STATES]
    for state in STATES:
        at = state
        for inserted in range(3):  # a third would lead back to where the first did
            found = [(DELETED, "D", at)]
            if fault not in ("blank", "duplicate"):
                found.append((RETOLD + extra, "R", FOLLOWS[at]))
                if letter == "s" and at == START:
                    found.append((extra, "K", SYSTEM))
                if letter == {USER: "u", ASSISTANT: "a"}[FOLLOWS[at]]:
                    found.append((extra, "K", FOLLOWS[at]))
            for cost, edit, to in found:
                out[state][to] = min(out[state][to], (cost + INSERTED * inserted, "I" * inserted + edit))
            at = FOLLOWS[at]
    return out


def forward(codes: bytes, start: int) -> tuple[list[int], list[int]]:
    """Least costs from `start` to each state, and the order of their least edits."""
    cost, rank = [_FAR] * 4, [0] * 4
    cost[start] = 0
    for code in codes:
        step = moves(code)
        new, edits = [_FAR] * 4, []
        for to in STATES:
            total, before, how = min((cost[s] + step[s][to][0], rank[s], step[s][to][1]) for s in STATES)
            new[to] = min(total, _FAR)
            edits.append((before, how, to))
        cost = new
        for place, (_, _, to) in enumerate(sorted(edits)):
            rank[to] = place
    return cost, rank


def backward(codes: bytes, end: int) -> list[int]:
    """Least costs from each state to `end`."""
    cost = [_FAR] * 4
    cost[end] = 0
    for code in reversed(codes):
        step = moves(code)
        cost = [min(_FAR, min(step[s][to][0] + cost[to] for to in STATES)) for s in STATES]
    return cost


def edits(codes: bytes, start: int, end: int) -> list[str]:
    """The least of the cheapest edits from `start` to `end`, one string a row."""
    out: list[str] = []
    todo = [(0, len(codes), start, end)]
    while todo:
        lo, hi, a, b = todo.pop()
        if hi - lo == 1:
            out.append(moves(codes[lo])[a][b][1])
        elif hi > lo:
            middle = (lo + hi) // 2
            cost, rank = forward(codes[lo:middle], a)
            rest = backward(codes[middle:hi], b)
            cross = min(STATES, key=lambda s: (cost[s] + rest[s], rank[s]))
            todo += [(middle, hi, cross, b), (lo, middle, a, cross)]
    return out


def rewritten(how: list[str], state: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The turns that the edits leave, from `state` on. Edits past the rows are insertions."""
    out = []
    for i, step in enumerate(how):
        for edit in step:
            if edit == "D":
                continue
            state = SYSTEM if edit == "K" and state == START and roles[i][:1] == "s" else FOLLOWS[state]
            if edit == "I":
                out.append((NAMES[state], ""))
            else:
                out.append((roles[i] if edit == "K" else NAMES[state], texts[i]))
    return out


def chosen(costs: list[list[int]], ranks: list[list[int]]) -> tuple[int, list[int]]:
    """The least cost of a row of chunks, and the states before, between and after them.
    Matrices go by first and last state, four rows of four."""
    after = [[INSERTED * ENDING[s] for s in STATES]]
    for matrix in reversed(costs):
        after.append([min(_FAR, min(matrix[4 * s + to] + after[-1][to] for to in STATES)) for s in STATES])
    after.reverse()
    states = [START]
    for k, matrix in enumerate(costs):
        s = states[-1]
        states.append(min(STATES, key=lambda to: (matrix[4 * s + to] + after[k + 1][to], ranks[k][4 * s + to])))
    return after[0][START], states


# --- Spark jobs -------------------------------------------------------------


def _key(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def rows_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) as they are, one copy each."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text"), F.lit(1).cast("long").alias("copies"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The same with the damage of the contract; dropped rows stay, with no copies."""
    drawn = F.crc32(F.concat(_key("conv_id"), F.lit(":"), _key("turn")).cast("binary")) % 20
    rows = rows_of(conversations).withColumn("_drawn", drawn)
    changed = {
        "copies": F.when(F.col("_drawn") == 0, 0).when(F.col("_drawn") == 3, 2).otherwise(1).cast("long"),
        "role": F.when(F.col("_drawn") == 4, F.lit("user")).otherwise(F.col("role")),
        "text": F.when(F.col("_drawn") == 1, F.lit("")).when(F.col("_drawn") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
    }
    return rows.withColumns(changed).drop("_drawn")


def coded(rows: DataFrame) -> DataFrame:
    """A row for each distinct row: conv, conv_id, turn, role, text, copies, code (of the
    first copy). Earlier rows of equal role and text are found by a digest."""
    alike = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    alike = saved(alike.select(_key("conv_id").alias("conv"), "*", F.xxhash64("role", "text").alias("_h"), F.xxhash64("text", F.lit(1), "role").alias("_g")), "op12-rows")
    place = F.struct(F.col("turn").isNotNull().alias("some"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = alike.where("copies > 0").groupBy("conv", "_h", "_g").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    joined = alike.join(first, ["conv", "_h", "_g"], "left")
    seen = F.coalesce(F.col("_first") < place, F.lit(False))
    ended = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(ended == "", 2).when(seen, 3).when(~F.substring(ended, -1, 1).isin(".", "!", "?"), 1).otherwise(0)
    initial = F.substring("role", 1, 1)
    letter = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return joined.select("conv", "conv_id", "turn", "role", "text", "copies", (letter + 4 * fault).cast("int").alias("code"))


def chunks(rows: DataFrame) -> DataFrame:
    """The rows in order, cut into chunks; part and seq give the order of chunks."""

    def summary(key: tuple, at: tuple[int, int], turns: list, roles: list[str], texts: list[str], codes: bytearray) -> tuple:
        codes = bytes(codes)
        fault = [c // 4 for c in codes]
        letters = [c % 4 for c in codes]
        illegal = sum(p not in ((0, 1), (1, 2), (2, 1)) for p in zip(letters, letters[1:], strict=False))
        real = [t for t in turns if t is not None]
        ends = [forward(codes, s) for s in STATES]
        edge = (letters[0], letters[-1]) if letters else (None, None)
        return (
            *key, *at, len(codes), codes, roles, texts, fault.count(2), fault.count(3), fault.count(1), illegal, *edge, real[0] if real else None, real[-1] if real else None,
            len(set(real)), [c for cost, _ in ends for c in cost], [r for _, rank in ends for r in rank],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[tuple] = []
            held: tuple | None = None
            turns, roles, texts, codes, chars = [], [], [], bytearray(), 0

            def close() -> None:
                nonlocal seq, turns, roles, texts, codes, chars
                if held is not None:
                    out.append(summary(held, (part, seq), turns, roles, texts, codes))
                    seq += 1
                turns, roles, texts, codes, chars = [], [], [], bytearray(), 0

            for conv, conv_id, turn, role, text, copies, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held != (conv, conv_id):
                    close()
                    held = conv, conv_id
                again = code if code // 4 == 2 else code % 4 + 12  # later copies are duplicates, unless blank
                for k in range(copies):
                    if codes and (len(codes) >= CHUNK_ROWS or chars + len(text) > CHUNK_CHARS):
                        close()
                    turns.append(turn)
                    roles.append(role)
                    texts.append(text)
                    codes.append(again if k else code)
                    chars += len(text)
            close()
            schema = pa.schema([("conv", pa.string()), ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("n", pa.int64()), ("codes", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("first", pa.int32()), ("last", pa.int32()), *((c, pa.int64()) for c in ("first_turn", "last_turn", "turns")), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32()))])
            columns = zip(*out, strict=True) if out else [[]] * len(schema)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    order = ("conv", F.col("turn").asc_nulls_first(), "role", "text")
    return saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _CHUNK), "op12-chunks")


def chains(cut: DataFrame) -> DataFrame:
    """A row a conversation: its counts, cost and, for each chunk, the states around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for conv, conv_id, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cost, states = chosen([p["costs"] for p in parts], [p["ranks"] for p in parts])
                count = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
                letters = [(p["first"], p["last"]) for p in parts if p["first"] is not None]
                count["illegal"] += sum((a[1], b[0]) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(letters, letters[1:], strict=False))
                ends = [(p["first_turn"], p["last_turn"]) for p in parts if p["first_turn"] is not None]
                count["turns"] -= sum(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
                gaps = ends[-1][1] - ends[0][0] + 1 - count["turns"] if ends else 0
                around = [{"part": p["part"], "seq": p["seq"], "state": a, "after": b, "is_last": i == len(parts) - 1} for i, (p, a, b) in enumerate(zip(parts, states, states[1:], strict=False))]
                out.append((conv, conv_id, gaps, count["blank"], count["duplicate"], count["truncated"], count["illegal"], cost, around))
            kinds = [pa.string(), *[pa.int64()] * 7, pa.list_(pa.struct([("part", pa.int32()), ("seq", pa.int32()), ("state", pa.int32()), ("after", pa.int32()), ("is_last", pa.bool_())]))]
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv", "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "around"])

    held = F.struct("part", "seq", "blank", "duplicate", "truncated", "illegal", "first", "last", "first_turn", "last_turn", "turns", "costs", "ranks")
    gathered = cut.groupBy("conv", "conv_id").agg(F.array_sort(F.collect_list(held)).alias("parts"))
    kind = "conv string, conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, around array<struct<part:int,seq:int,state:int,after:int,is_last:boolean>>"
    return gathered.mapInArrow(run, kind)


def solved(cut: DataFrame, chain: DataFrame) -> DataFrame:
    """A row a chunk: conv, part, seq, chunks (of its conversation), audit, turns (role, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.columns[:4]
            audits, turns = [], []
            for codes, roles, texts, state, after, is_last in zip(*(c.to_pylist() for c in batch.columns[4:]), strict=True):
                how = edits(codes, state, after)
                if is_last:
                    how.append("I" * ENDING[after])
                audits.append("".join(how))
                turns.append([{"role": r, "text": t} for r, t in rewritten(how, state, roles, texts)])
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.record_batch([*keys, pa.array(audits, pa.string()), pa.array(turns, kind)], names=["conv", "part", "seq", "chunks", "audit", "turns"])

    around = chain.select(F.size("around").alias("chunks"), F.explode("around").alias("a")).select("chunks", "a.*")
    joined = cut.select("conv", "part", "seq", "codes", "roles", "texts").join(around, ["part", "seq"])
    return joined.select("conv", "part", "seq", "chunks", "codes", "roles", "texts", "state", "after", "is_last").mapInArrow(run, "conv string, part int, seq int, chunks int, audit string, turns array<struct<role:string,text:string>>")


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, place, role, text: the turns of the repaired conversations, by the cheapest
    edits. place is a number that grows along a conversation."""
    cut = chunks(coded(rows_of(conversations)))
    chain = saved(chains(cut), "op12-chains")
    of = cut.select("part", "seq", "conv_id")
    turns = solved(cut, chain).join(of, ["part", "seq"]).select("conv_id", "part", "seq", F.posexplode("turns").alias("nth", "t"))
    place = F.shiftleft(F.shiftleft(F.col("part").cast("long"), 24) + F.col("seq"), 16) + F.col("nth")
    return turns.select("conv_id", place.alias("place"), "t.role", "t.text")


def digests(pieces: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256) of conversations of several chunks, as they pass in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest, audit, begun = None, hashlib.sha256(), [], False
        done = lambda: pa.record_batch([pa.array([held]), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], names=["conv", "audit", "repaired_sha256"])
        for batch in batches:
            for conv, piece, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if conv != held:
                    if held is not None:
                        yield done()
                    held, digest, audit, begun = conv, hashlib.sha256(), [], False
                audit.append(piece)
                if lines.is_valid:
                    digest.update(("\n" if begun else "").encode() + lines.as_py().encode("utf-8"))
                    begun = True
        if held is not None:
            yield done()

    rows = pieces.repartition("conv").sortWithinPartitions("conv", "part", "seq").select("conv", "audit", "lines")
    return rows.mapInArrow(run, "conv string, audit string, repaired_sha256 string")


def report(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for
    rows (conv_id, turn, role, text, copies), such as `damaged` gives."""
    cut = chunks(coded(rows))
    chain = saved(chains(cut), "op12-chains")
    lines = F.when(F.size("turns") > 0, F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"))
    pieces = saved(solved(cut, chain).select("conv", "part", "seq", "chunks", "audit", lines.alias("lines")), "op12-pieces")
    whole = pieces.where("chunks = 1").select("conv", "audit", F.sha2(F.coalesce("lines", F.lit("")).cast("binary"), 256).alias("repaired_sha256"))
    texts = whole.union(digests(pieces.where("chunks > 1")))
    return chain.drop("around").join(texts, "conv").drop("conv")


def repair_of_damaged(conversations: DataFrame) -> DataFrame:
    return report(damaged(conversations))


def _oracle() -> str:
    listed = [(code, s, to, cost, how) for code in range(16) for s in STATES for to in STATES for cost, how in [moves(code)[s][to]] if cost < _FAR]

    def shown(s: int, to: int, how: str) -> tuple[str, str]:
        """Inserted lines, and the role that a set role gets."""
        lines = ""
        for _ in how[:-1]:
            s = FOLLOWS[s]
            lines += NAMES[s] + ":\n"
        return lines, NAMES.get(to, "") if how[-1] == "R" else ""

    values = ", ".join(f"({code}, {s}, {to}, {cost}, '{how}', '{shown(s, to, how)[0]}', '{shown(s, to, how)[1]}')" for code, s, to, cost, how in listed)
    spaces = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
with recursive moves(code, s, q, cost, how, lines, named) as (values {values}),
drawn as (
    select *, {crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as k from conversations
), changed as (
    select conv_id, turn, case when k = 4 then 'user' else coalesce(role, ' ') end as role,
        case when k = 1 then '' when k = 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') else coalesce(text, ' ') end as text, unnest(range(case k when 0 then 0 when 3 then 2 else 1 end)) as copy
    from drawn
), ordered as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as rn from changed
), marked as (
    select *, rtrim(text, {spaces}) as ended, row_number() over (partition by conv_id, role, text order by rn) as nth from ordered
), coded as (
    select *, case when ended = '' then 2 when nth > 1 then 3 when right(ended, 1) not in ('.', '!', '?') then 1 else 0 end as fault,
        case left(role, 1) when 's' then 0 when 'u' then 1 when 'a' then 2 else 3 end as letter from marked
), walk(conv_id, rn, q, best) as (
    select conv_id, 0::bigint, 0, {{'c': 0::bigint, 'a': '', 't': ''}} from (select distinct conv_id from conversations)
    union all
    select r.conv_id, r.rn, m.q, min({{'c': w.best.c + m.cost, 'a': w.best.a || m.how, 't': w.best.t || m.lines || case right(m.how, 1) when 'D' then '' when 'K' then r.role || ':' || r.text || chr(10) else m.named || ':' || r.text || chr(10) end}})
    from walk w join coded r on r.conv_id is not distinct from w.conv_id and r.rn = w.rn + 1 join moves m on m.code = r.letter + 4 * r.fault and m.s = w.q
    group by r.conv_id, r.rn, m.q
), last as (
    select conv_id, min({{'c': best.c + case q when 1 then 10 when 2 then 5 else 0 end, 'a': best.a || case q when 1 then 'II' when 2 then 'I' else '' end,
        't': best.t || case q when 1 then 'user:' || chr(10) || 'assistant:' || chr(10) when 2 then 'assistant:' || chr(10) else '' end}}) as best
    from walk w where rn = (select coalesce(max(rn), 0) from ordered o where o.conv_id is not distinct from w.conv_id) group by conv_id
), pairs as (
    select conv_id, letter, lead(letter) over (partition by conv_id order by rn) as next from coded
), illegal as (
    select conv_id, count(*) as n from pairs where next is not null and (letter, next) not in ((0, 1), (1, 2), (2, 1)) group by conv_id
), counts as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 2) as blank, count(*) filter (fault = 3) as duplicate, count(*) filter (fault = 1) as truncated from coded group by conv_id
)
select l.conv_id, coalesce(c.gaps, 0)::bigint as gaps, coalesce(c.blank, 0) as blank, coalesce(c.duplicate, 0) as duplicate, coalesce(c.truncated, 0) as truncated, coalesce(i.n, 0) as illegal,
    l.best.c as cost, l.best.a as audit, sha256(case when l.best.t = '' then '' else left(l.best.t, length(l.best.t) - 1) end) as repaired_sha256
from last l left join counts c on l.conv_id is not distinct from c.conv_id left join illegal i on l.conv_id is not distinct from i.conv_id
"""


ORACLE_SQL = _oracle()
