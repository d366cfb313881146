"""Repair of conversations by a generalised LR parser over their roles.

A dialogue is empty, or turns (a user's row and an assistant's) with or without a system row before
them.  ``Machine`` makes the LR states of that grammar and runs a graph-structured stack over a
conversation's rows: each row can be kept, deleted or given another role, rows can be inserted
anywhere, and every stack that an edit leads to stays open.  Stacks with equal tops are merged, and the
minimum of (cost, audit) stays; what can follow depends on the top alone, so nothing is lost.

* Audits aren't compared as strings.  Of two different audits over the same rows neither begins the
  other (an insertion has a price), so a stack's rank among the others and the letters that a row adds
  decide.
* A stack that costs over PRUNE more than the cheapest can't win: the cheapest can always do as it does
  for at most that much.  So stacks, costs and ranks of a row are one of few combinations, and the step from
  one to the next is worked out once.

Rows are dealt out by ranges of (conv_id, turn, role, md5 of the text), so a conversation of any
length spreads over tasks, and each task parses its pieces.  A piece whose conversation began elsewhere
is parsed from every top; the pieces' results are put together in order.  Only the digest of such a
conversation's repaired text, which is one chain over all of it, is streamed through one task.

Defined cases: rows of equal turn follow one another by role and by the md5 of their text; of rows
equal in all, all but the first are duplicates; a null conv_id is one conversation, in whose rows'
checksums it is one space, as are a null turn, role and text; a role that doesn't begin with s, u or a
can't be kept, an empty one neither; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import ship, written

#: Rules of the role grammar; terminals are the initials of roles.
GRAMMAR = (("dialogue", ()), ("dialogue", ("turns",)), ("dialogue", ("s", "turns")), ("turns", ("turn",)), ("turns", ("turns", "turn")), ("turn", ("u", "a")))
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: The cheapest stack inserts two rows, deletes one or inserts one more, and goes on like any other.
PRUNE = 2 * INSERT + max(DELETE, INSERT)
SPACES = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
#: Rows and bytes of text that a task holds of a conversation before it closes a piece.
PIECE, PIECE_BYTES = 20_000, 16 << 20

Stack = tuple  # (LR state, the stack below or None)


class Machine:
    """The LR states of the grammar and the steps of the graph-structured stack."""

    def __init__(self) -> None:
        self.states: list[frozenset] = []
        self.root: Stack = (self._number(self._closed(frozenset((r, 0) for r, (left, _) in enumerate(GRAMMAR) if left == "dialogue"))), None)
        #: One stack for each top that can be met between rows.  All stacks are walked here, always in the same order,
        #: so that every worker numbers the states alike.
        self.tops: dict[int, Stack] = {}
        work, met = [self.root], {self.root}
        for stack in work:
            self.tops.setdefault(stack[0], stack)
            for nxt in (s for c in "sua" for s in self.shifted(stack, c)):
                if nxt not in met:
                    met.add(nxt)
                    work.append(nxt)

    @staticmethod
    def _closed(items: frozenset) -> frozenset:
        more = {(r, 0) for rule, dot in items for r, (left, _) in enumerate(GRAMMAR) if GRAMMAR[rule][1][dot : dot + 1] == (left,)}
        return items if more <= items else Machine._closed(items | more)

    def _number(self, items: frozenset) -> int:
        if items not in self.states:
            self.states.append(items)
        return self.states.index(items)

    def _goto(self, state: int, symbol: str) -> int | None:
        moved = frozenset((rule, dot + 1) for rule, dot in self.states[state] if GRAMMAR[rule][1][dot : dot + 1] == (symbol,))
        return self._number(self._closed(moved)) if moved else None

    def shifted(self, stack: Stack, terminal: str) -> list[Stack]:
        """The stacks after the terminal and any reductions, as far as they can shift on or accept."""
        state = self._goto(stack[0], terminal)
        out, work = [], [] if state is None else [(state, stack)]
        while work:
            top = work.pop()
            if self.accepts(top) or any(self._goto(top[0], c) is not None for c in "sua"):
                out.append(top)
            for rule, dot in sorted(self.states[top[0]]):
                left, right = GRAMMAR[rule]
                if dot == len(right) and left != "dialogue":
                    below = top
                    for _ in right:
                        below = below[1]
                    work.append((self._goto(below[0], left), below))
        return out

    def accepts(self, stack: Stack) -> bool:
        """Whether what the stack holds is a dialogue."""
        return any(GRAMMAR[rule][0] == "dialogue" and dot == len(GRAMMAR[rule][1]) for rule, dot in self.states[stack[0]])

    def _inserted(self, best: dict) -> dict:
        """best: top to (cost, rank, letters, stack), with what insertions add."""
        work = list(best.values())
        while work:
            cost, rank, letters, stack = work.pop()
            for nxt in (s for c in ROLES for s in self.shifted(stack, c)):
                new = (cost + INSERT, rank, letters + "I", nxt)
                if nxt[0] not in best or new[:3] < best[nxt[0]][:3]:
                    best[nxt[0]] = new
                    work.append(new)
        return best

    @cache
    def step(self, frontier: tuple, initial: str, must_go: bool, cut_off: bool) -> tuple[tuple, int, tuple]:
        """The frontier after a row, what the least cost rose by, and for each of its stacks (place of the stack it comes from, letters).

        frontier: (stack, cost above the least) in the order of their audits.
        """
        out: dict = {}

        def offer(cost, rank, letters, stack):
            if stack[0] not in out or (cost, rank, letters) < out[stack[0]][:3]:
                out[stack[0]] = (cost, rank, letters, stack)

        more = CUT_OFF if cut_off else 0
        for place, (stack, cost) in enumerate(frontier):
            for cost, rank, letters, stack in self._inserted({stack[0]: (cost, place, "", stack)}).values():
                offer(cost + DELETE, rank, letters + "D", stack)
                if not must_go:
                    for nxt in self.shifted(stack, initial) if initial in "sua" else ():
                        offer(cost + KEEP + more, rank, letters + "K", nxt)
                    for nxt in (s for c in ROLES for s in self.shifted(stack, c)):
                        offer(cost + REROLE + more, rank, letters + "R", nxt)
        return self._settled(out)

    @cache
    def finish(self, frontier: tuple) -> tuple[int, int, str]:
        """(cost above the frontier's least, place of the stack, letters) of the cheapest way to end."""
        ends = [self._inserted({stack[0]: (cost, place, "", stack)}) for place, (stack, cost) in enumerate(frontier)]
        return min(way[:3] for end in ends for way in end.values() if self.accepts(way[3]))

    @staticmethod
    def _settled(out: dict) -> tuple[tuple, int, tuple]:
        least = min(way[0] for way in out.values())
        kept = sorted((way for way in out.values() if way[0] <= least + PRUNE), key=lambda way: way[1:3])
        return tuple((way[3], way[0] - least) for way in kept), least, tuple(way[1:3] for way in kept)

    @staticmethod
    def joined(frontier: tuple, ways: dict) -> tuple[tuple, int, tuple]:
        """The step over a whole piece; ways: (entry top, exit top) to (cost, audit)."""
        out: dict = {}
        for place, (stack, cost) in enumerate(frontier):
            for (entry, leave), (more, audit) in ways.items():
                if entry == stack[0] and (leave not in out or (cost + more, place, audit) < out[leave][:3]):
                    out[leave] = (cost + more, place, audit, machine().tops[leave])
        return Machine._settled(out)


@lru_cache(maxsize=1)
def machine() -> Machine:
    return Machine()


def parsed(rows: list[tuple], start: Stack) -> tuple[tuple, int, list]:
    """The frontier after rows (initial, must go, cut off), its least cost, and the steps back."""
    m = machine()
    frontier, cost, back = ((start, 0),), 0, []
    for initial, must_go, cut_off in rows:
        frontier, more, came = m.step(frontier, initial, must_go, cut_off)
        cost += more
        back.append(came)
    return frontier, cost, back


def _audit(back: list, place: int, last: str = "") -> str:
    letters = [last]
    for came in reversed(back):
        place, added = came[place]
        letters.append(added)
    return "".join(reversed(letters))


def repaired(rows: list[tuple]) -> tuple[int, str]:
    """(cost, audit) of rows (initial, must go, cut off): the cheapest edits, of equal ones the ASCII-least."""
    frontier, cost, back = parsed(rows, machine().root)
    more, place, letters = machine().finish(frontier)
    return cost + more, _audit(back, place, letters)


class Speech:
    """The digest of a repaired conversation, row by row."""

    def __init__(self, audit: str):
        self.letters, self.sha, self.said = iter(audit), hashlib.sha256(), 0
        self.system = (len(audit) - audit.count("D")) % 2  # turns are pairs

    def _say(self, role: str | None, text: str) -> None:
        role = ROLES["ua"[(self.said - self.system) % 2]] if role is None else role
        self.sha.update(f"{chr(10) if self.said else ''}{role}:{text}".encode())
        self.said += 1

    def row(self, role: str, text: str) -> None:
        for letter in self.letters:
            if letter == "I":
                self._say(None, "")
                continue
            if letter != "D":
                self._say(role if letter == "K" else None, text)
            return

    def digest(self) -> str:
        for _ in self.letters:  # insertions at the end
            self._say(None, "")
        return self.sha.hexdigest()


COUNTS = ("blank", "duplicate", "truncated", "illegal")
LEGAL = ("su", "ua", "au")
#: What damage leaves of a row; the first that fits.
GONE, BLANK, DUPLICATE, TRUNCATED = "gone", "blank", "duplicate", "truncated"
ORDER = ("conv_id", "turn", "role", "h")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and h (md5 of the text) after damage; rows that it drops stay, with gone set and no text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    d = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("d"))
    text = F.when(F.col("d") == 0, None).when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    d = d.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("d") == 0).alias("gone"), F.when(F.col("d") == 3, 2).otherwise(1).alias("times"))
    d = d.select("*", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("again")).drop("times", "again")
    return d.withColumn("h", F.md5(F.col("text").cast("binary")))


def _last(text: Column | str) -> Column:
    """The last character that isn't white space, or nothing."""
    return F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1))


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows of ``damaged`` with their fault; copies in the same turn are told apart later, when they follow one another."""
    said = rows.where(~F.col("gone") & (_last("text") != ""))
    open_ = F.max(F.col("turn").isNull()).alias("open")  # a null turn is before all others
    again = said.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("g")).agg(open_, F.min("turn").alias("first"), F.max("turn").alias("last")).where("first < last or (open and first is not null)").drop("last")
    again = written(again)  # read for the ranges, for the pieces and for the digests
    r = rows.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("g")), "left")
    fault = F.when(F.col("gone"), GONE).when(_last("text") == "", BLANK).when((F.col("turn") > F.col("first")) | (F.col("open") & F.col("turn").isNotNull()), DUPLICATE).when(~_last("text").isin(".", "!", "?"), TRUNCATED)
    return r.select(*ORDER, "text", fault.alias("fault"))


def _streamed(batches) -> Iterator[tuple]:
    """Rows of sorted batches as tuples."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _emit(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _piece(rows: list[tuple], known_start: bool, known_end: bool) -> dict:
    """Counts and parses of consecutive rows (conv_id, turn, role, h, text, fault) of one conversation."""
    live = [r for r in rows if r[5] != GONE]
    initials = [r[2][:1] for r in live]
    turns = [r[1] for r in live if r[1] is not None]
    out = dict(zip(ORDER, rows[0])) | {f: sum(r[5] == f for r in live) for f in COUNTS[:3]}
    out |= {"illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "first": initials[0] if live else None, "last": initials[-1] if live else None}
    out |= {"low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns)), "whole": known_start and known_end}
    edits = [(i, r[5] in (BLANK, DUPLICATE), r[5] == TRUNCATED) for i, r in zip(initials, live)]
    if out["whole"]:
        out["cost"], out["audit"] = repaired(edits)
        speech = Speech(out["audit"])
        for r in live:
            speech.row(r[2], r[4])
        return out | {"repaired_sha256": speech.digest(), "ways": []}
    ways = []
    for start in [machine().root] if known_start else machine().tops.values():
        frontier, cost, back = parsed(edits, start)
        ways += [{"entry": start[0], "leave": stack[0], "cost": cost + more, "audit": _audit(back, place)} for place, (stack, more) in enumerate(frontier)]
    return out | {"ways": ways}


def _arrow(schema: str, like: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(like.sparkSession.createDataFrame([], schema).schema)


def pieces(rows: DataFrame, most: int = PIECE, most_bytes: int = PIECE_BYTES) -> DataFrame:
    """Rows with their faults, dealt out by ranges, to one row a piece; whole: the piece is a conversation, and repaired."""
    ids, turns = rows.schema["conv_id"].dataType.simpleString(), rows.schema["turn"].dataType.simpleString()
    fields = f"conv_id {ids}, turn {turns}, role string, h string, seq long, whole boolean, blank long, duplicate long, truncated long, illegal long, first string, last string, low {turns}, high {turns}, turns long, cost long, audit string, repaired_sha256 string, ways array<struct<entry:int,leave:int,cost:bigint,audit:string>>"
    schema = _arrow(fields, rows)

    def run(batches):
        held, size, out, seq, known_start, before = [], 0, [], 0, False, None

        def close(known_end):
            nonlocal held, size, seq, known_start
            out.append(_piece(held, known_start, known_end) | {"seq": seq})
            held, size, seq, known_start = [], 0, seq + 1, known_end

        for row in _streamed(batches):
            if before is not None and row[0] != before[0]:
                close(True)
            elif held and (len(held) >= most or size >= most_bytes):
                close(False)
            if row[5] not in (GONE, BLANK) and before is not None and row[:4] == before[:4]:
                row = (*row[:5], DUPLICATE)
            before = row
            held.append(row)
            size += len(row[4] or "")
            if len(out) >= 500:
                yield _emit(out, schema)
                out.clear()
        if held:
            close(False)
        if out:
            yield _emit(out, schema)

    dealt = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return dealt.mapInArrow(run, fields)


def put_together(parts: DataFrame) -> DataFrame:
    """Pieces of conversations that lie in several, as one row for each: its counts, gaps, cost and audit."""
    ids = parts.schema["conv_id"].dataType.simpleString()
    fields = f"conv_id {ids}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    schema = _arrow(fields, parts)
    names = parts.columns

    def conversation(rows: Iterator[dict]) -> dict:
        frontier, cost, back = ((machine().root, 0),), 0, []
        out, low, high, turns, last = dict.fromkeys(COUNTS, 0), None, None, 0, None
        for r in rows:
            frontier, more, came = Machine.joined(frontier, {(w["entry"], w["leave"]): (w["cost"], w["audit"]) for w in r["ways"]})
            cost += more
            back.append(came)
            for c in COUNTS:
                out[c] += r[c]
            if r["first"] is not None:
                out["illegal"] += last is not None and last + r["first"] not in LEGAL
                last = r["last"]
            if r["low"] is not None:
                turns += r["turns"] - (high == r["low"])
                low, high = r["low"] if low is None else low, r["high"]
        more, place, letters = machine().finish(frontier)
        return out | {"gaps": _gaps(low, high, turns), "cost": cost + more, "audit": _audit(back, place, letters)}

    def run(batches):
        from itertools import groupby

        rows = (dict(zip(names, r)) for r in _streamed(batches))
        for conv, own in groupby(rows, key=lambda r: r["conv_id"]):
            yield _emit([conversation(own) | {"conv_id": conv}], schema)

    dealt = parts.repartition("conv_id").sortWithinPartitions(*ORDER, "seq")
    return dealt.mapInArrow(run, fields)


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def spoken(rows: DataFrame, results: DataFrame) -> DataFrame:
    """results (of ``put_together``) with the digest of their repaired text: rows pass in order and aren't held."""
    ids = results.schema["conv_id"].dataType.simpleString()
    columns = [c for c in results.columns if c != "conv_id"]
    fields = f"conv_id {ids}, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in results.schema if f.name != 'conv_id')}, repaired_sha256 string"
    schema = _arrow(fields, results)
    own = results.select(F.col("conv_id").alias("c"))
    mine = rows.where(F.col("fault").isNull() | (F.col("fault") != GONE)).join(own, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    result = F.struct(*columns)
    both = mine.select(*ORDER, "text", F.lit(None).cast(results.select(result.alias("x")).schema["x"].dataType).alias("result")).unionByName(results.select("conv_id", result.alias("result")), allowMissingColumns=True)

    def run(batches):
        got = speech = None
        for conv, _, role, _, text, result in _streamed(batches):
            if result is not None:
                if got is not None:
                    yield _emit([got | {"repaired_sha256": speech.digest()}], schema)
                got, speech = {"conv_id": conv, **result}, Speech(result["audit"])
            else:
                speech.row(role, text)
        if got is not None:
            yield _emit([got | {"repaired_sha256": speech.digest()}], schema)

    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("result").isNull(), "turn", "role", "h")
    return dealt.mapInArrow(run, fields)


def repair(conversations: DataFrame, most: int = PIECE, most_bytes: int = PIECE_BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation after damage."""
    ship(conversations.sparkSession)
    rows = with_faults(damaged(conversations))
    found = written(pieces(rows, most, most_bytes))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    columns = ["conv_id", "gaps", *COUNTS, "cost", "audit", "repaired_sha256"]
    whole = found.where("whole").select("conv_id", gaps, *columns[2:])
    split = written(put_together(found.where("not whole")))
    return whole.unionByName(spoken(rows, split).select(columns))
