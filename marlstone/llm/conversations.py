"""Repair of conversations whose turns are blank, repeated, truncated or out of role order.

Edits: keep a turn (K, cost 0), give it the role user or assistant (R, 2), delete it (D, 3; blank turns and repeats must go)
and insert an empty turn of user or assistant (I, 2); a truncated turn that stays costs 1 more. The roles that result, by
their initials, are `(s?(ua)+)?`. The cheapest edits are taken, of those the ones whose initials are least in ASCII.

A DP over the turns that are retained: turn j as role t costs its edit, what lies between it and the next retained turn, and
what that costs. Prefix sums price the deletions in the gap, the pair of roles says how many inserts it needs, and the least
for each role of the next turn is a running minimum, taken from the end. Each state's choice is kept as the audit of its gap
requires: the later next turn (more D), then more inserts (I), then K before R. Since a state and an initial decide the next
state, the walk from the start with these choices is the least audit.

Equal turns are one row with a number from the beginning. Rows are sorted over the whole table by ranges of (conversation,
turn), and long conversations are cut into chunks of at most CHUNK rows: a chunk is a 4 x 4 (min, +) matrix from the
running minima behind it to those before it. Matrices are multiplied from the last chunk on, so each chunk knows its end;
chunks then say in which role they end for each role before them, and are walked. The hash over a whole repaired text
is by nature one sequence: rows stream through a task that holds a hash state, not the texts.

Defined cases: null roles, texts and, in the damage's key, ids and turns are one space; rows with a null conversation are one
conversation; null turns come first; turns with one number are ordered by role and the text's digest. A role that is neither
s..., u... nor a... can't be kept as it is. An empty table gives an empty result. Only the four columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm._common import Scratch, arrow_column, null_safe, skew_join, small_batches

DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
CHUNK = 1 << 15
S, U, A, END = range(4)
START = 3  # as the role before; END is only ever a target
FAR = 1 << 60
NAMES = ("system", "user", "assistant")
#: Inserts that a pair of neighbouring roles needs, and which: FILL[before][target].
FILL = [
    [None, "", "u", "ua"],
    [None, "a", "", "a"],
    [None, "", "u", ""],
    ["", "", "u", ""],
]
LEGAL = {(S, U), (U, A), (A, U)}
#: Kinds of a row: it may stay, it must go, it may stay at a price.
OPEN, GONE, CUT = range(3)


def code(initial: F.Column, kind: F.Column) -> F.Column:
    """One letter for a row's role initial (s, u, a or other) and kind."""
    of = F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(3)
    return F.chr(F.lit(97) + of + 4 * kind)


def _read(codes: str) -> list[tuple[int, int]]:
    return [((ord(c) - 97) % 4, (ord(c) - 97) // 4) for c in codes]


def _choices(codes: str, times: list[int] | None, end: list[int], keep: bool):
    """The running minima before the chunk, those behind it being `end`; with `keep`, also each state's choice.

    A choice is (row, target, op) of the next retained row; row is len(codes) where that lies behind the chunk.
    """
    rows = _read(codes)
    n = len(rows)
    times = times or [1] * n
    gone = [0]
    for k in times:
        gone.append(gone[-1] + DELETE * k)
    least = [gone[n] + e if e < FAR else FAR for e in end]
    at, ops = [n] * 4, [""] * 4

    def next_of(role: int):
        best = None
        for t in (S, U, A, END):
            fill = FILL[role][t]
            if fill is None or least[t] >= FAR:
                continue
            c = (INSERT * len(fill) + least[t], -at[t], -len(fill), ops[t], t)
            if best is None or c < best:
                best = c
        return best

    choice: list[list] = [[None] * 3 for _ in range(n)] if keep else []
    for j in range(n - 1, -1, -1):
        own, kind = rows[j]
        if kind == GONE:
            continue
        new = []
        for t in (S, U, A):
            if t != own and t == S:
                continue
            after = next_of(t)
            if after is None:
                continue
            if keep:
                choice[j][t] = (-after[1], after[4])
            edit = (0 if t == own else REROLE) + TRUNCATED * (kind == CUT) + DELETE * (times[j] - 1)
            new.append((t, gone[j] + edit + after[0] - gone[j + 1], "K" if t == own else "R"))
        for t, cost, op in new:
            if cost < least[t]:
                least[t], at[t], ops[t] = cost, j, op
    if not keep:
        return least
    starts = []
    for role in range(4):
        first = next_of(role)
        starts.append(None if first is None else (-first[1], first[4]))
    return least, starts, choice


def matrix(codes: str, times: list[int] | None) -> list[int]:
    """The chunk's (min, +) matrix by rows: from target t before it to target q behind it."""
    columns = [_choices(codes, times, [0 if t == q else FAR for t in range(4)], False) for q in range(4)]
    return [columns[q][t] for t in range(4) for q in range(4)]


def walk(codes: str, times: list[int] | None, end: list[int], role: int, last: bool):
    """The audit of a chunk entered after a turn of `role`; each row's op, new role and inserts before it; the role at its end; and the inserts at the conversation's end."""
    rows = _read(codes)
    n = len(rows)
    times = times or [1] * n
    _, starts, choice = _choices(codes, times, end, True)
    audit, ops, j = [], [("D", -1, "")] * n, 0
    step = starts[role]
    while step is not None and step[0] < n:
        k, t = step
        fill = FILL[role][t]
        op = "K" if rows[k][0] == t else "R"
        audit.append("D" * sum(times[j:k]) + "I" * len(fill) + op + "D" * (times[k] - 1))
        ops[k] = (op, t, fill)
        role, j, step = t, k + 1, choice[k][t]
    tail = FILL[role][END] if last else ""
    audit.append("D" * sum(times[j:]) + "I" * len(tail))
    return "".join(audit), ops, role, tail


def _cost(least: list[int], role: int = START) -> int:
    return min(least[t] + INSERT * len(FILL[role][t]) for t in range(4) if FILL[role][t] is not None)


def _times(value) -> list[int] | None:
    return value if value is not None and any(k != 1 for k in value) else None


def breaks(codes: str, times: list[int] | None) -> int:
    """Neighbouring rows whose initials are not su, ua or au."""
    own = [r for r, _ in _read(codes)]
    return sum(pair not in LEGAL for pair in zip(own, own[1:])) + sum(k - 1 for k in times or [])


def _chunk_batches(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    of = lambda codes, times: {"matrix": matrix(codes, times), "illegal": breaks(codes, times)}
    once = lru_cache(4096)(lambda codes: of(codes, None))
    for codes, times in batches:
        found = [once(c) if (k := _times(t)) is None else of(c, k) for c, t in zip(codes.to_pylist(), times.to_pylist())]
        yield pa.array(found, pa.struct([("matrix", pa.list_(pa.int64())), ("illegal", pa.int64())]))


def _exit_batches(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for codes, times, ends in batches:
        yield pa.array([[walk(c, _times(t), e, r, False)[2] for r in range(4)] for c, t, e in zip(codes.to_pylist(), times.to_pylist(), ends.to_pylist())], pa.list_(pa.int32()))


_WALKED = pa.struct([("audit", pa.string()), ("ops", pa.list_(pa.struct([("op", pa.string()), ("role", pa.string()), ("before", pa.string()), ("after", pa.string())])))])


def _walk_batches(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    def walked(codes, times, end, role, last):
        audit, ops, _, tail = walk(codes, times, end, role, last)
        listed = [{"op": op, "role": NAMES[t] if op == "R" else None, "before": before, "after": ""} for op, t, before in ops]
        if listed:
            listed[-1]["after"] = tail
        return {"audit": audit, "ops": listed}

    once = lru_cache(4096)(lambda codes: walked(codes, None, [FAR, FAR, FAR, 0], START, True))
    for codes, times, ends, roles, lasts in batches:
        out = []
        for c, t, e, r, last in zip(*(x.to_pylist() for x in (codes, times, ends, roles, lasts))):
            k = _times(t)
            out.append(once(c) if k is None and last and r == START else walked(c, k, e, r, last))
        yield pa.array(out, _WALKED)


def _behind_batches(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """From a conversation's chunks in order (matrices, and their first and last codes): the running minima behind each, the least cost, and the breaks between chunks."""
    for chunks, borders in batches:
        out = []
        for matrices, border in zip(chunks.to_pylist(), borders.to_pylist()):
            end, ends = [FAR, FAR, FAR, 0], []
            for m in reversed(matrices):
                ends.append(end)
                end = [min(FAR, min(m[4 * t + q] + end[q] for q in range(4))) for t in range(4)]
            out.append({"ends": ends[::-1], "cost": _cost(end), "between": sum(breaks(x[-1] + y[0], None) for x, y in zip(border, border[1:]))})
        yield pa.array(out, pa.struct([("ends", pa.list_(pa.list_(pa.int64()))), ("cost", pa.int64()), ("between", pa.int64())]))


def _entry_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """From the roles that a conversation's chunks end in, for each role before them: the role before each chunk."""
    for chunks in batches:
        out = []
        for exits in chunks.to_pylist():
            role, roles = START, []
            for e in exits:
                roles.append(role)
                role = e[role]
            out.append(roles)
        yield pa.array(out, pa.list_(pa.int32()))


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns as conv, conv_id, turn, role, text and times after the damage that a row's checksum decides; dropped rows have times = 0."""
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), F.lit(" ")))
    fate = F.crc32(key) % 20
    text = F.coalesce(text_col, F.lit(" "))
    return turns.select(
        null_safe(conv_col).alias("conv"), F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.when(fate == 4, "user").otherwise(F.coalesce(role_col, F.lit(" "))).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("long").alias("times"),
    )


TURN = ["conv", "turn", "role", "digest"]
_SPACE = " \t\n\x0b\f\r"


def plan(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables from turns (conv, conv_id, turn, role, text, times): distinct turns, the edit of each, and one row a conversation.

    turns: TURN, text, times. Edits: TURN, op, new_role, before and after (initials of inserted turns).
    Conversations: conv, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    """
    small_batches()
    same = turns.filter("times > 0").groupBy("conv", "turn", "role", "text").agg(F.sum("times").alias("times"))
    same = scratch.table(same.withColumn("digest", F.unhex(F.sha2("text", 256))), "turns")
    tail = F.substring(F.rtrim("text", F.lit(_SPACE)), -1, 1)
    seen = scratch.table(same.select(*TURN, "times", (tail == "").alias("blank"), (~tail.isin(".", "!", "?")).alias("cut")), "seen")
    # The first turn with a role and a text is no repeat.
    first = seen.filter("NOT blank").groupBy("conv", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("f"), F.count(F.lit(1)).alias("n"))
    first = scratch.table(first.filter("n > 1"), "first")
    known = first.select("conv", "role", "digest", F.col("f.turn").alias("first_turn"), F.lit(True).alias("again"))
    kept = skew_join(seen, known, ["conv", "role", "digest"], "turn", first.select("conv", "role", "digest", "n"), "left")
    repeat = F.coalesce("again", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    kind = F.when(F.col("blank") | repeat, GONE).when(F.col("cut"), CUT).otherwise(OPEN)
    coded = kept.select(*TURN, "times", "blank", repeat.alias("repeat"), "cut", code(F.substring("role", 1, 1), kind).alias("code"))
    # A row's place: the partition that wrote it, and its number there. Chunks are parts of a conversation within a partition.
    ordered = coded.repartitionByRange(*TURN).sortWithinPartitions(*TURN)
    ordered = scratch.table(ordered.withColumn("place", F.monotonically_increasing_id()), "ordered")
    row = F.struct("place", "turn", "role", "digest", "times", "code")
    block = F.floor(F.col("place") / CHUNK)  # CHUNK divides 2 ** 33, where partitions begin
    times, blank, again = F.col("times"), F.col("blank"), F.col("repeat")
    faults = {"blank": F.when(blank, times).otherwise(0), "duplicate": F.when(blank, 0).when(again, times).otherwise(times - 1), "truncated": (~blank & ~again & F.col("cut")).cast("long")}
    chunks = ordered.groupBy("conv", block.alias("chunk")).agg(F.sort_array(F.collect_list(row)).alias("rows"), *[F.sum(v).alias(k) for k, v in faults.items()])
    chunks = chunks.withColumn("codes", F.array_join("rows.code", "")).withColumn("m", arrow_column(_chunk_batches, "struct<matrix:array<bigint>,illegal:bigint>")("codes", "rows.times"))
    chunks = scratch.table(chunks, "chunks")
    # One row a conversation, with sixteen numbers for each CHUNK rows.
    inner = F.struct("chunk", "m.matrix", "m.illegal", F.concat(F.substring("codes", 1, 1), F.substring("codes", -1, 1)).alias("border"), *faults)
    convs = chunks.groupBy("conv").agg(F.sort_array(F.collect_list(inner)).alias("c"))
    convs = scratch.table(convs.withColumn("b", arrow_column(_behind_batches, "struct<ends:array<array<bigint>>,cost:bigint,between:bigint>")("c.matrix", "c.border")), "convs")
    ends = convs.select("conv", F.size("c").alias("n"), F.element_at("c.chunk", -1).alias("final"), F.inline(F.arrays_zip(F.col("c.chunk").alias("chunk"), F.col("b.ends").alias("end"))))
    placed = scratch.table(chunks.select("conv", "chunk", "codes", "rows").join(ends, ["conv", "chunk"]), "placed")
    exits = placed.filter("n > 1").select("conv", "chunk", arrow_column(_exit_batches, "array<int>")("codes", "rows.times", "end").alias("exits"))
    entries = exits.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("chunk", "exits"))).alias("c")).withColumn("roles", arrow_column(_entry_batches, "array<int>")("c.exits"))
    entries = entries.select("conv", F.inline(F.arrays_zip(F.col("c.chunk").alias("chunk"), F.col("roles").alias("entry"))))
    walked = arrow_column(_walk_batches, "struct<audit:string,ops:array<struct<op:string,role:string,before:string,after:string>>>")
    done = placed.join(entries, ["conv", "chunk"], "left").select("conv", "chunk", "rows", walked("codes", "rows.times", "end", F.coalesce("entry", F.lit(START)), F.col("chunk") == F.col("final")).alias("w"))
    done = scratch.table(done, "walked")
    each = F.arrays_zip(*[F.col(f"rows.{c}").alias(c) for c in TURN[1:]], F.col("w.ops").alias("o"))
    edits = done.select("conv", F.inline(each)).select(*TURN, "o.op", F.col("o.role").alias("new_role"), "o.before", "o.after")
    audits = done.groupBy("conv").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "w.audit"))), lambda x: x["audit"]), "").alias("audit"))
    gaps = seen.groupBy("conv", "turn").agg(F.lit(1)).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    total = lambda f: F.aggregate(f"c.{f}", F.lit(0).cast("long"), lambda x, y: x + y)
    facts = convs.select("conv", *[total(f).alias(f) for f in faults], (total("illegal") + F.col("b.between")).alias("illegal"), F.col("b.cost").alias("cost"))
    ids = turns.groupBy("conv").agg(F.first("conv_id", True).alias("conv_id"))
    found = ids.join(facts, "conv", "left").join(gaps, "conv", "left").join(audits, "conv", "left")
    counted = [F.coalesce(f, F.lit(0)).cast("long").alias(f) for f in ("gaps", *faults, "illegal", "cost")]
    return same, edits, scratch.table(found.select("conv", "conv_id", *counted, F.coalesce("audit", F.lit("")).alias("audit")), "conversations")


def repair(turns: DataFrame) -> DataFrame:
    """The repaired turns, inserted ones included, of turns as damage() gives them: conv_id, turn, at, step, op, role and text.

    In a conversation, (turn, at, step) is the order; an inserted turn has the turn number of its neighbour.
    """
    with Scratch(turns.sparkSession) as scratch:
        same, edits, convs = plan(turns, scratch)
        key = [null_safe("turn").alias("_turn"), "conv", "role", "digest"]
        left = same.select("*", *key[:1]).drop("times")
        right = edits.filter("op <> 'D' OR after <> ''").select(*key, "op", "new_role", "before", "after")
        made = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.struct(F.lit("I").alias("op"), F.when(x == "u", NAMES[U]).otherwise(NAMES[A]).alias("role"), F.lit("").alias("text")))
        own = F.when(F.col("op") == "D", F.array()).otherwise(F.array(F.struct("op", F.coalesce("new_role", "role").alias("role"), "text")))
        rows = left.join(right, ["conv", "_turn", "role", "digest"]).select("conv", "turn", F.struct("role", "digest").alias("at"), F.posexplode(F.concat(made("before"), own, made("after"))).alias("step", "t"))
        rows = skew_join(rows, convs.select("conv", "conv_id"), ["conv"], "turn")
        return scratch.last(rows.select("conv_id", "turn", "at", "step", "t.*"), "repaired")


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From turns in order, each one's edit before its text: the digest of each conversation's repaired text. Holds one hash state."""
    conv, state, edit, some = None, None, None, False

    def say(role: str, text: str):
        nonlocal some
        state.update(("\n" if some else "").encode() + f"{role}:".encode() + text.encode())
        some = True

    for batch in batches:
        names, found = {"u": NAMES[U], "a": NAMES[A]}, []
        for c, role, op, new_role, before, after, text in zip(*(batch.column(k).to_pylist() for k in ("conv", "role", "op", "new_role", "before", "after", "text"))):
            if c != conv:
                if state:
                    found.append((conv, state.hexdigest()))
                conv, state, some = c, hashlib.sha256(), False
            if op is not None:
                edit = op, new_role, before, after
                continue
            op, new_role, before, after = edit
            for x in before:
                say(names[x], "")
            if op != "D":
                say(new_role or role, text)
            for x in after:
                say(names[x], "")
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], ["conv", "repaired_sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([state.hexdigest()])], ["conv", "repaired_sha256"])


def digest(turns: DataFrame) -> DataFrame:
    """One row a conversation of turns as damage() gives them: conv_id, the counts of its faults, cost and audit of its edits, and repaired_sha256."""
    with Scratch(turns.sparkSession) as scratch:
        same, edits, convs = plan(turns, scratch)
        text = same.select(*TURN, F.lit(1).alias("is_text"), *[F.lit(None).cast("string").alias(c) for c in ("op", "new_role", "before", "after")], "text")
        both = edits.select(*TURN, F.lit(0).alias("is_text"), "op", "new_role", "before", "after", F.lit(None).cast("string").alias("text")).unionByName(text)
        hashes = both.repartition("conv").sortWithinPartitions(*TURN, "is_text").mapInArrow(_hash_batches, "conv string, repaired_sha256 string")
        out = convs.join(hashes, "conv", "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())))
        return scratch.last(out.drop("conv"), "repairs")
