"""Conversation structure repair by shortest edits.

A conversation's rows come in the order of their turns (null turns first; equal
turns by role, then by a hash of their text). A row may be kept (0), given the role user or
assistant (1), deleted (2), and turns with empty text may be inserted (5); a row
that is cut short costs 5 more unless it is deleted, and blank or repeated rows must
be deleted. The roles' initials must give ``(s?(ua)+)?`` in the end.

The edits are found by Dijkstra's algorithm on the lattice of (turn index, state of
the grammar), whose nodes are made as they are reached. The priority is (cost,
audit), where the audit holds the edits' initials (D, I, K, R), so the first
accepting end node that is popped has the least cost and, among those, the least
audit in ASCII order. A state allows one role next (and ``system`` at the
start), so the audit determines the repaired conversation. Long conversations are
searched in blocks of ``BLOCK`` rows: an end node of a block is charged with the
least cost from there on, which a pass from behind gives. A block's paths end with its
last row, so none is the beginning of another, and the choice is that of one search
over all rows; labels stay short.

Plan
1. Equal rows are one row with a count (combined before the shuffle). Rows are laid
   out in ranges of (conversation, turn, role, hash), so a conversation with a third
   of all rows is spread over tasks. A task repairs the conversations that lie within
   its range, one at a time.
2. Rows of conversations that a range's border cuts (two a task at most), or that hold
   more than ``HELD_BYTES``, are written out. For them, repeated rows are found by a minimum
   over digests, and a row becomes a code of one character (role and fault).
   The codes of a range's rows of a conversation are a piece, and pieces are searched side by side: each
   gives its least costs from state to state, these are added up from behind (a few numbers a
   piece), each piece is searched from all four states with the least cost ahead, and the states between
   pieces are read off from the front. Texts stream past the audit in order and are never held
   together; a digest of a conversation is sequential, and so is this stream.

A null role or text is one space; null ids are one conversation; an empty role has no
initial and cannot be kept. A row whose ``present`` is false or null names its
conversation only. A conversation without rows has zeros and an empty audit. An empty table
gives no rows; only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.operators.joins import join_counted
from twinsift.plans.storage import arrow_rows, materialize

KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
BLOCK = 128
HELD_BYTES = 32 << 20
WHITE = " \t\n\x0b\x0c\r"
#: States of the grammar: start, after a system, a user and an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state behind each initial, by state; and the turn that an inserted or rerole'd one must be.
_AFTER = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
_FITS = [USER, USER, ASSISTANT, USER]
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_ENDS = (START, ASSISTANT)
#: A row's code is a letter: its initial (s, u, a or another) and its fault (none, cut short, to be deleted).
_INITIALS = "sua?"
SOUND, SHORT, BAD = range(3)
_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_ROW = "kind int, conv long, part int, seq long, turn long, role string, text string, code string, digest binary, copies long"


def code(role: str, fault: int) -> str:
    initial = role[:1]
    return chr(65 + 3 * (_INITIALS.index(initial) if initial and initial in "sua" else 3) + fault)


def _read(letter: str) -> tuple[str, int]:
    at = ord(letter) - 65
    return _INITIALS[at // 3], at % 3


def _edits(initial: str, fault: int, state: int):
    """``(letter, cost, state behind)`` of what may be done with a row."""
    yield "D", DELETE, state
    if fault != BAD:
        more = CUT_SHORT if fault == SHORT else 0
        if initial in _AFTER[state]:
            yield "K", KEEP + more, _AFTER[state][initial]
        if initial != _ROLE[_FITS[state]][0]:
            yield "R", REROLE + more, _FITS[state]


def _inserted(costs: list[int]) -> list[int]:
    """Least costs by state when turns may be inserted first; more than two in a row return to where they began."""
    for _ in range(2):
        costs = [min(costs[s], INSERT + costs[_FITS[s]]) for s in range(4)]
    return costs


def _costs_before(codes: str, costs: list[int]) -> list[int]:
    """Least costs by state from before ``codes``, given those from behind them."""
    for letter in reversed(codes):
        initial, fault = _read(letter)
        costs = _inserted([min(c + costs[to] for _, c, to in _edits(initial, fault, s)) for s in range(4)])
    return costs


def _search(codes: str, state: int, ahead: list[int] | None) -> tuple[int, str, int]:
    """``(cost, audit, state)`` of the best path; ``ahead`` are the least costs from the end on, None at a conversation's end."""
    rows, n = [_read(x) for x in codes], len(codes)
    heap, settled = [(0, "", 0, state)], set()
    while heap:
        cost, audit, i, s = heapq.heappop(heap)
        if (i, s) in settled:
            continue
        settled.add((i, s))
        if i == n and (ahead is not None or s in _ENDS):
            return cost, audit, s
        heapq.heappush(heap, (cost + INSERT, f"{audit}I", i, _FITS[s]))
        if i < n:
            for letter, more, to in _edits(*rows[i], s):
                heapq.heappush(heap, (cost + more + (ahead[to] if ahead is not None and i + 1 == n else 0), audit + letter, i + 1, to))
    raise AssertionError("deleting all rows always ends")


_NEVER = 1 << 40
#: Least costs by state at the end of a conversation.
_DONE = _inserted([0 if s in _ENDS else _NEVER for s in range(4)])


def least_edits(codes: str, state: int = START, beyond: list[int] | None = None) -> tuple[int, str, int]:
    """``(cost, audit, state behind)`` of the codes of rows; ``beyond`` are the least costs from behind them, None at a conversation's end."""
    starts = list(range(0, len(codes), BLOCK)) or [0]
    ahead: list[list[int] | None] = [None] * (len(starts) - 1) + [beyond]
    costs = _DONE if beyond is None else beyond
    for k in range(len(starts) - 1, 0, -1):
        costs = ahead[k - 1] = _costs_before(codes[starts[k] : starts[k] + BLOCK], costs)
    total, audits = 0, []
    for at, charged in zip(starts, ahead, strict=True):
        cost, audit, state = _search(codes[at : at + BLOCK], state, charged)
        total += cost - (charged[state] if charged is not None else 0)
        audits.append(audit)
    return total, "".join(audits), state


def transfer(codes: str) -> list[int]:
    """Least costs of the codes from each state (inner) to each state behind them (outer), 16 numbers."""
    return [c for end in range(4) for c in _costs_before(codes, [0 if s == end else _NEVER for s in range(4)])]


def costs_beyond(pieces: list[list[int]]) -> list[list[int] | None]:
    """For each piece of a conversation the least costs from behind it, by the pieces' ``transfer``; None for the last one."""
    out: list[list[int] | None] = [None] * len(pieces)
    costs = _DONE
    for k in range(len(pieces) - 1, 0, -1):
        costs = out[k - 1] = [min(pieces[k][4 * end + s] + costs[end] for end in range(4)) for s in range(4)]
    return out


def illegal_pairs(codes: str) -> int:
    """Neighbouring rows whose initials are not su, ua or au."""
    initials = [_read(x)[0] for x in codes]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


class Replay:
    """Repaired turns of a conversation, from its audit and its rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.place = audit, 0, START, 0

    def _turn(self, turn, role: str, text: str, state: int, edit: str):
        self.state, self.place = state, self.place + 1
        return self.place - 1, turn, role, text, edit

    def inserts(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._turn(None, _ROLE[_FITS[self.state]], "", _FITS[self.state], "I")

    def row(self, turn, role: str, text: str, copies: int) -> Iterator[tuple]:
        """``(place, turn, role, text, edit)`` of what becomes of a row and its copies."""
        for _ in range(copies):
            yield from self.inserts()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                yield self._turn(turn, role, text, _AFTER[self.state][role[:1]], edit)
            elif edit == "R":
                yield self._turn(turn, _ROLE[_FITS[self.state]], text, _FITS[self.state], edit)


def _digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _fault(text: str) -> int:
    shown = text.rstrip(WHITE)
    return BAD if not shown else SOUND if shown[-1] in ".!?" else SHORT


def _finished(rows: list[tuple]) -> tuple[tuple, list[tuple]]:
    """Summary and repaired turns of a whole conversation; rows are ``(turn, role, text, copies)``."""
    codes, seen, turns, blank, duplicate, truncated = [], set(), set(), 0, 0, 0
    for turn, role, text, copies in rows:
        fault, digest = _fault(text), _digest(role, text)
        if turn is not None:
            turns.add(turn)
        if fault == BAD:
            blank += copies
        else:
            again = copies - (digest not in seen)
            seen.add(digest)
            duplicate += again
            truncated += fault == SHORT and again < copies
            fault = BAD if again == copies else fault
        codes.append(code(role, fault) + code(role, BAD) * (copies - 1))
    codes = "".join(codes)
    cost, audit, _ = least_edits(codes)
    replay = Replay(audit)
    out = [t for row in rows for t in replay.row(*row)] + list(replay.inserts())
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, blank, duplicate, truncated, illegal_pairs(codes), cost, audit), out


def _repair(batches: Iterator) -> Iterator:
    """Finished conversations of a range; rows of those that may go on in another one as they are.

    ``kind`` 0 is a summary, 1 a repaired turn, 2 a row left over.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = [c.split()[0] for c in f"{_ROW}, edit string, {_SUMMARY}".split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in f"{_ROW}, edit string, {_SUMMARY}".split(", ")])
    out: list[dict] = []
    seq = 0

    def left_over(conv, rows):
        nonlocal seq
        for turn, role, text, copies in rows:
            fault = _fault(text)
            out.append({"kind": 2, "conv": conv, "part": part, "seq": seq, "turn": turn, "role": role, "text": text, "code": code(role, fault), "digest": _digest(role, text), "copies": copies})
            seq += 1

    def finish(conv, rows):
        summary, turns = _finished(rows)
        out.append({"kind": 0, "conv": conv} | dict(zip(names[11:], summary, strict=True)))
        out.extend({"kind": 1, "conv": conv, "seq": place, "turn": turn, "role": role, "text": text, "edit": edit} for place, turn, role, text, edit in turns)

    now, held, size, cut = None, [], 0, True  # the first conversation of a range may have begun before it
    for batch in batches:
        for conv, turn, role, text, copies in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if now is None or now[0] != conv:
                if now is not None and not cut:
                    finish(now[0], held)
                cut = now is None
                now, held, size = (conv,), [], 0
            row = (turn, role, text, copies)
            if cut:
                left_over(conv, [row] if copies else [])
                if not copies:
                    out.append({"kind": 2, "conv": conv, "part": part, "seq": -1, "copies": 0})
            elif copies:
                held.append(row)
                size += 64 + len(text)
                if size > HELD_BYTES:
                    left_over(conv, held)
                    held, cut = [], True
        if len(out) > 2000 or size > HELD_BYTES // 4:
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
    if now is not None and not cut:
        left_over(now[0], held)
        out.append({"kind": 2, "conv": now[0], "part": part, "seq": -1, "copies": 0})
    yield pa.RecordBatch.from_pylist(out, schema)


def _transfers(codes: Column) -> Column:
    @F.arrow_udf("array<long>")
    def costs(texts):
        import pyarrow as pa

        return pa.array([transfer(x) for x in texts.to_pylist()], pa.list_(pa.int64()))

    return costs(codes)


def _beyond(pieces: Column) -> Column:
    """``(part, beyond)`` of each piece, from ``(part, costs)`` in order."""

    @F.arrow_udf("array<struct<part:int,beyond:array<long>>>")
    def folded(rows):
        import pyarrow as pa

        out = [[{"part": p["part"], "beyond": b} for p, b in zip(own, costs_beyond([p["costs"] for p in own]), strict=True)] for own in rows.to_pylist()]
        return pa.array(out, pa.list_(pa.struct([("part", pa.int32()), ("beyond", pa.list_(pa.int64()))])))

    return folded(pieces)


_FOUND = "array<struct<cost:bigint,audit:string,behind:int>>"


def _searched(codes: Column, beyond: Column) -> Column:
    """Least edits of a piece from each of the four states."""

    @F.arrow_udf(_FOUND)
    def search(texts, costs):
        import pyarrow as pa

        out = [[dict(zip(("cost", "audit", "behind"), least_edits(x, state, c), strict=True)) for state in range(4)] for x, c in zip(texts.to_pylist(), costs.to_pylist(), strict=True)]
        return pa.array(out, pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("behind", pa.int32())])))

    return search(codes, beyond)


def _chained(pieces: Column) -> Column:
    """``(part, state)`` in which each piece begins, from ``(part, behind)`` in order."""

    @F.arrow_udf("array<struct<part:int,state:int>>")
    def chained(rows):
        import pyarrow as pa

        out = []
        for own in rows.to_pylist():
            state, states = START, []
            for p in own:
                states.append({"part": p["part"], "state": state})
                state = p["behind"][state]
            out.append(states)
        return pa.array(out, pa.list_(pa.struct([("part", pa.int32()), ("state", pa.int32())])))

    return chained(pieces)


def _illegal(codes: Column) -> Column:
    @F.arrow_udf("long")
    def illegal(texts):
        import pyarrow as pa

        return pa.array([illegal_pairs(x) for x in texts.to_pylist()], pa.int64())

    return illegal(codes)


def _illegal_borders(borders: Column) -> Column:
    @F.arrow_udf("long")
    def illegal(rows):
        import pyarrow as pa

        return pa.array([sum(map(illegal_pairs, own)) for own in rows.to_pylist()], pa.int64())

    return illegal(borders)


def _replayed(batches: Iterator) -> Iterator:
    """Repaired turns; a conversation's audit comes before its rows."""
    import pyarrow as pa

    def batch_of(rows):
        columns = zip(*rows, strict=True) if rows else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv", "place", "turn", "role", "text", "edit"])

    replay, now, out = None, None, []
    for batch in batches:
        for conv, turn, role, text, copies, audit in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if audit is not None:
                if replay is not None:
                    out += [(now, *t) for t in replay.inserts()]
                replay, now = Replay(audit), conv
            else:
                out += [(now, *t) for t in replay.row(turn, role, text, copies)]
            if len(out) > 1000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)
            out = []
    yield batch_of([(now, *t) for t in replay.inserts()] if replay is not None else [])


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(summaries, turns)`` of all conversations.

    Summaries have ``conv_id`` and the columns of ``_SUMMARY``; turns have ``conv_id``, ``place`` (from
    0), ``turn`` (null where inserted), ``role``, ``text`` and ``edit`` (K, R or I).
    """
    arrow_rows(df.sparkSession)
    shown = lambda c: F.coalesce(F.col(c), F.lit(" "))
    there = F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)
    rows = df.select(F.col(conv_col).cast("long").alias("conv"), *(F.when(there, c).alias(n) for n, c in (("turn", F.col(turn_col).cast("long")), ("role", shown(role_col)), ("text", shown(text_col)))), there.cast("int").alias("one"))
    equal = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("one").alias("copies"))
    ranged = equal.withColumn("hash", F.xxhash64("text")).repartitionByRange("conv", "turn", "role", "hash").sortWithinPartitions("conv", "turn", "role", "hash", "text")
    stored = materialize(ranged.select("conv", "turn", "role", "text", "copies").mapInArrow(_repair, f"{_ROW}, edit string, {_SUMMARY}"), "repaired")

    left = stored.where("kind = 2").withColumn("key", F.coalesce(F.col("conv").cast("string"), F.lit("")))
    said = left.where("seq >= 0")
    blank = (F.ascii("code") - 65) % 3 == BAD
    place = F.struct("part", "seq")
    firsts = materialize(said.where(~blank).groupBy("key", "digest").agg(F.min(place).alias("first"), F.count("*").alias("rows")), "firsts")
    spoken = join_counted(said.where(~blank).select("key", "digest", "part", "seq", "code", "copies"), firsts, ["key", "digest"], ["part", "seq"], "rows")
    bad = F.char(F.ascii("code") - (F.ascii("code") - 65) % 3 + BAD)
    again = F.col("copies") - (place == F.col("first")).cast("int")
    coded = spoken.select("key", "part", "seq", "copies", again.alias("again"), F.lit(0).cast("long").alias("blank"), F.when(place == F.col("first"), F.col("code")).otherwise(bad).alias("code"), bad.alias("more"))
    coded = coded.unionByName(said.where(blank).select("key", "part", "seq", "copies", F.lit(0).cast("long").alias("again"), F.col("copies").alias("blank"), "code", F.col("code").alias("more")))
    coded = coded.withColumns({"codes": F.concat("code", F.repeat("more", (F.col("copies") - 1).cast("int"))), "truncated": ((F.ascii("code") - 65) % 3 == SHORT).cast("long")})
    in_order = lambda at, *what: F.array_sort(F.collect_list(F.struct(at, *what)))
    text_of = lambda rows, c: F.array_join(F.transform(rows, lambda x: x[c]), "")
    total = [F.sum(c).alias(c) for c in ("again", "blank", "truncated")]
    pieces = coded.groupBy("key", "part").agg(text_of(in_order("seq", "codes"), "codes").alias("codes"), *total)
    pieces = materialize(pieces.withColumns({"costs": _transfers(F.col("codes")), "illegal": _illegal(F.col("codes"))}), "pieces")
    # a few numbers a piece, and no more pieces of a conversation than ranges
    beyond = pieces.groupBy("key").agg(in_order("part", "costs").alias("p")).select("key", F.explode(_beyond(F.col("p"))).alias("b")).select("key", "b.part", "b.beyond")
    searched = materialize(pieces.join(beyond, ["key", "part"]).withColumn("found", _searched(F.col("codes"), F.col("beyond"))), "searched")
    begun = searched.groupBy("key").agg(in_order("part", F.transform("found", lambda f: f["behind"]).alias("behind")).alias("p")).select("key", F.explode(_chained(F.col("p"))).alias("b")).select("key", "b.part", "b.state")
    best = F.get("found", F.col("state"))
    ends = F.concat(F.substring("codes", 1, 1), F.substring("codes", -1, 1)).alias("ends")
    chosen = searched.join(begun, ["key", "part"]).select("key", "part", "again", "blank", "truncated", "illegal", best["cost"].alias("cost"), best["audit"].alias("audit"), ends)
    sums = [F.sum(c).alias(c) for c in ("again", "blank", "truncated", "illegal", "cost")]
    whole = chosen.groupBy("key").agg(*sums, in_order("part", "audit", "ends").alias("p"))
    # pairs across the borders of pieces: the last code of one beside the first of the next
    borders = F.aggregate(F.sequence(F.lit(1), F.size("p") - 1), F.array().cast("array<string>"), lambda a, i: F.concat(a, F.array(F.concat(F.substring(F.get("p", i - 1)["ends"], 2, 1), F.substring(F.get("p", i)["ends"], 1, 1)))))
    whole = whole.withColumn("borders", F.when(F.size("p") > 1, borders).otherwise(F.array().cast("array<string>"))).withColumn("audit", text_of(F.col("p"), "audit"))
    across = _illegal_borders(F.col("borders"))
    whole = whole.withColumn("illegal", F.col("illegal") + across).drop("p", "borders")
    gaps = left.groupBy("key", "conv", "turn").agg(F.count("*").alias("n")).groupBy("key", "conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    found = gaps.join(whole, "key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias("duplicate" if c == "again" else c)
    summaries = found.select("key", "conv", *map(zero, ("gaps", "blank", "again", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"))
    summaries = materialize(summaries, "summaries")
    columns = [F.col("conv").alias("conv_id"), *[c.split()[0] for c in _SUMMARY.split(", ")]]

    first = summaries.select("key", F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("seq"), "conv", F.lit(None).cast("long").alias("turn"), *(F.lit(None).cast("string").alias(c) for c in ("role", "text")), F.lit(0).cast("long").alias("copies"), "audit")
    stream = first.unionByName(said.select("key", "part", "seq", "conv", "turn", "role", "text", "copies", F.lit(None).cast("string").alias("audit")))
    replayed = stream.repartition("key").sortWithinPartitions("key", "part", "seq").select("conv", "turn", "role", "text", "copies", "audit").mapInArrow(_replayed, "conv long, place long, turn long, role string, text string, edit string")
    turns = stored.where("kind = 1").select("conv", F.col("seq").alias("place"), "turn", "role", "text", "edit").unionByName(materialize(replayed, "replayed"))
    return stored.where("kind = 0").select(*columns).unionByName(summaries.select(*columns)), turns.withColumnRenamed("conv", "conv_id")


def _digests(batches: Iterator) -> Iterator:
    import pyarrow as pa

    def batch_of(now, hashed):
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([hashed.hexdigest()])], ["conv_id", "repaired_sha256"])

    now, hashed = None, None
    for batch in batches:
        done = []
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if hashed is None or now[0] != conv:
                if hashed is not None:
                    done.append(batch_of(now[0], hashed))
                now, hashed = (conv,), hashlib.sha256()
            else:
                hashed.update(b"\n")
            hashed.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        yield from done
    if hashed is not None:
        yield batch_of(now[0], hashed)


def digests(turns: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)``: of ``role:text`` of the repaired turns, joined by line feeds, as they stream by in order."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "role", "text").mapInArrow(_digests, "conv_id long, repaired_sha256 string")
