"""Repair of conversation structure by weighted CYK parsing over spans of turns.

A sound conversation's role initials read ``(s?(ua)+)?``. Its automaton has four states (start, after s, after
u, after a); a nonterminal X[p][q] derives the runs of turns that lead from p to q, and the grammar in Chomsky
normal form is X[p][q] -> X[p][r] X[r][q]. Terminals are edited turns: keep, rerole, delete. Turns
may be inserted anywhere: leaves are closed under insertion on both sides. A cell holds the least (cost,
audit) of a span, an audit being the edits' initials in order. Edits of equal cost over the same turns are
never prefixes of each other (what one has in addition would be insertions, which cost), so the least
audit of a span is made of least audits of its parts.

Spans of up to ``BLOCK`` turns get the full chart, bottom-up by length over all splits. Any derivation
passes every border between turns in one state, so longer spans need one split each: cells of
neighbouring blocks are joined by doubling span lengths.

Conversations may hold any share of the turns. Equal turns are counted first; turns are range-sorted by
conversation, turn and content, so a large conversation lies over many tasks; each task folds its run of
turns to one cell table, and the tables of a conversation, one per task at most, are joined. Only the
digest of such a conversation, sequential by nature, is taken in one task, streaming over sorted turns.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from signalloom.llm.common import stage

BLOCK = 8
HELD_TURNS = 2_000  # a longer conversation is folded as its turns pass by
HELD_BYTES = 8 << 20
CACHED_SPANS = 20_000
RULES = {"rerole": 1, "delete": 2, "insert": 5, "truncated": 5}

START, AFTER_S, AFTER_U, AFTER_A = range(4)
STEP = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
FINAL = (START, AFTER_A)
LEGAL_PAIRS = ("su", "ua", "au")
NEXT_ROLE = {START: "user", AFTER_S: "user", AFTER_U: "assistant", AFTER_A: "user"}

Cells = list  # 16 entries by 4 * p + q: (cost, audit) or None


def join_cells(a: Cells, b: Cells, into: Cells | None = None) -> Cells:
    """The least cells of two neighbouring spans, also against cells another split has given."""
    out = [None] * 16 if into is None else into
    for i, left in enumerate(a):
        if left is None:
            continue
        row, base = i & 12, 4 * (i & 3)
        cost, audit = left
        for q in range(4):
            right = b[base + q]
            if right is None:
                continue
            total, best = cost + right[0], out[row + q]
            if best is None or total < best[0]:
                out[row + q] = total, audit + right[1]
            elif total == best[0] and audit + right[1] < best[1]:
                out[row + q] = total, audit + right[1]
    return out


def _insertions() -> Cells:
    one = [None] * 16
    for p in range(4):
        one[5 * p] = 0, ""
    for (p, initial), q in STEP.items():
        if initial != "s":
            one[4 * p + q] = RULES["insert"], "I"
    return join_cells(join_cells(one, one), join_cells(one, one))


INSERTIONS = _insertions()


def leaf(symbol: str) -> Cells:
    """Cells of one turn: ``x`` must go; else its role initial (``o``: none of s, u, a), capital if truncated."""
    own = [None] * 16
    for p in range(4):
        own[5 * p] = RULES["delete"], "D"
    if symbol != "x":
        more = RULES["truncated"] if symbol.isupper() else 0
        for (p, initial), q in STEP.items():
            if initial == symbol.lower():
                own[4 * p + q] = more, "K"
            elif initial != "s":
                own[4 * p + q] = more + RULES["rerole"], "R"
    return join_cells(join_cells(INSERTIONS, own), INSERTIONS)


class Chart:
    """Cells of short spans, shared by all conversations of a worker that hold the same symbols."""

    def __init__(self):
        self.spans: dict[str, Cells] = {}

    def cells(self, symbols: str) -> Cells:
        """CYK over all spans of the symbols, bottom-up by length."""
        spans = self.spans
        if len(spans) > CACHED_SPANS:
            spans.clear()
        for size in range(1, len(symbols) + 1):
            for begin in range(len(symbols) - size + 1):
                span = symbols[begin : begin + size]
                if span not in spans:
                    found = leaf(span) if size == 1 else [None] * 16
                    for cut in range(1, size):
                        join_cells(spans[span[:cut]], spans[span[cut:]], found)
                    spans[span] = found
        return spans[symbols]


_CHART = Chart()


class Fold:
    """Cells of a run of turns of any length: full blocks are joined with spans of the same size before them."""

    def __init__(self):
        self.symbols, self.stack = "", []

    def add(self, symbols: str) -> None:
        self.symbols += symbols
        while len(self.symbols) >= BLOCK:
            self._push(0, _CHART.cells(self.symbols[:BLOCK]))
            self.symbols = self.symbols[BLOCK:]

    def _push(self, size: int, cells: Cells) -> None:
        while self.stack and self.stack[-1][0] <= size:
            before, left = self.stack.pop()
            size, cells = max(size, before) + 1, join_cells(left, cells)
        self.stack.append((size, cells))

    def join(self, cells: Cells) -> None:
        """Appends the cells of a run that another task has folded."""
        self._push(0, cells)

    def cells(self) -> Cells:
        out = _CHART.cells(self.symbols) if self.symbols else list(INSERTIONS)
        for _, left in reversed(self.stack):
            out = join_cells(left, out)
        return out


def cheapest(cells: Cells) -> tuple[int, str]:
    return min(c for q in FINAL if (c := cells[4 * START + q]) is not None)


def edited(audit: str, turns: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """``edit, role, text`` of the turns that an audit leaves, in order; memory holds one turn."""
    state, turns = START, iter(turns)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(turns)
        if letter == "D":
            continue
        role = role if letter == "K" else NEXT_ROLE[state]
        state = STEP[state, role[0]]
        yield letter, role, text


def _digest(audit: str, turns) -> str:
    sha, gap = hashlib.sha256(), b""
    for _, role, text in edited(audit, turns):
        sha.update(gap + f"{role}:{text}".encode())
        gap = b"\n"
    return sha.hexdigest()


_SPACE = r"' \t\n\u000B\f\r'"


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: turns damaged by the hash of their place; nulls become a space, dropped turns have no copies."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    place = F.concat_ws(":", F.coalesce(conv.cast("string"), F.lit(" ")), F.coalesce(turn.cast("string"), F.lit(" ")))
    hit = F.crc32(F.encode(place, "UTF-8")) % 20
    return conversations.select(
        conv.alias("conv_id"), turn.alias("turn"), F.when(hit == 0, "").when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit <= 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def undamaged(conversations: DataFrame) -> DataFrame:
    """The same columns for turns as they are."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.lit(1).cast("long").alias("copies"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def faulted_turns(turns: DataFrame) -> DataFrame:
    """Distinct turns of each conversation with their ``copies``, ``fault`` (blank, truncated or none; ``again`` if
    role and text were seen in an earlier turn) and the keys of their order."""
    trimmed = F.expr(f"trim(TRAILING {_SPACE} FROM text)")
    bag = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    fault = F.when(trimmed == "", "blank").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("none")
    bag = stage(bag.select("*", fault.alias("fault"), F.substring("role", 1, 8).alias("lead"), F.md5(F.concat_ws("", F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("content")), "turns")
    first = bag.filter("copies > 0").groupBy(F.col("conv_id").alias("_conv"), F.col("content").alias("_content")).agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n"))
    first = first.filter("n > 1").select("_conv", "_content", F.col("first.turn").alias("_turn"))
    again = F.col("_content").isNotNull() & ~_same("turn", "_turn")
    return stage(bag.join(first, _same("conv_id", "_conv") & (F.col("content") == F.col("_content")), "left").select(*bag.columns, again.alias("again")), "turn-faults")


_ORDER = ["conv_id", "turn", "lead", "content"]  # nulls first
_TURN = ["conv_id", "turn", "role", "text", "copies", "fault", "again"]
_TABLE = (
    "conv_id long, part int, whole boolean, low long, high long, n_turns long, blank long, duplicate long, truncated long, illegal long, "
    "opens string, closes string, cost long, audit string, repaired_sha256 string, cells string"
)
_NAMES = [f.split()[0] for f in _TABLE.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.bool_(), *[pa.int64()] * 7, pa.string(), pa.string(), pa.int64(), *[pa.string()] * 3]


class Run:
    """A conversation's neighbouring turns in one task."""

    def __init__(self, conv):
        self.conv, self.low, self.high, self.n_turns = conv, None, None, 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.opens = self.closes = None
        self.fold, self.held, self.count, self.bytes = Fold(), [], 0, 0

    def add(self, turn, role: str, text: str, copies: int, fault: str, again: bool) -> None:
        if not copies:
            return
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.n_turns += 1
        initial = role[:1]
        self.pair(initial)
        self.illegal += copies - 1  # no role may follow itself
        if fault == "blank":
            self.blank += copies
            symbols = "x" * copies
        else:
            self.duplicate += copies if again else copies - 1
            self.truncated += fault == "truncated" and not again
            own = initial if initial and initial in "sua" else "o"
            symbols = "x" * copies if again else (own.upper() if fault == "truncated" else own) + "x" * (copies - 1)
        self.fold.add(symbols)
        self.count += copies
        self.bytes += len(text)
        if self.held is not None:
            self.held.append((role, text, copies))
            if self.count > HELD_TURNS or self.bytes > HELD_BYTES:
                self.held = None

    def pair(self, initial: str | None) -> None:
        if initial is not None:
            if self.closes is None:
                self.opens = initial
            else:
                self.illegal += self.closes + initial not in LEGAL_PAIRS
            self.closes = initial

    def row(self, part: int, whole: bool) -> tuple:
        cells = self.fold.cells()
        counts = (self.conv, part, whole, self.low, self.high, self.n_turns, self.blank, self.duplicate, self.truncated, self.illegal, self.opens, self.closes)
        if not whole:
            return *counts, None, None, None, json.dumps(cells)
        cost, audit = cheapest(cells)
        digest = _digest(audit, ((role, text) for role, text, copies in self.held for _ in range(copies))) if self.held is not None else None
        return *counts, cost, audit, digest, None


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], _NAMES)


def parse_runs(turns: DataFrame) -> DataFrame:
    """One row per conversation that lies inside a task, else one per task and conversation with its cells."""

    def work(batches):
        part, run, first, rows = TaskContext.get().partitionId(), None, True, []
        for batch in batches:
            for conv, *turn in zip(*(c.to_pylist() for c in batch.columns)):
                if run is None or conv != run.conv:
                    if run is not None:
                        rows.append(run.row(part, not first and run.held is not None))
                        first = False
                    run = Run(conv)
                run.add(*turn)
            if len(rows) > 1000:
                yield _arrow(rows)
                rows = []
        if run is not None:
            rows.append(run.row(part, False))
        yield _arrow(rows)

    keyed = turns.select(*_TURN, "lead", "content").repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    return stage(keyed.select(*_TURN).mapInArrow(work, _TABLE), "conversation-runs")


def _joined(runs: DataFrame) -> DataFrame:
    """Joins the runs of a conversation, one per task at most, in the order of the tasks."""

    def finish(parts: list[dict]) -> tuple:
        whole = Run(parts[0]["conv_id"])
        for r in parts:
            whole.fold.join([c and tuple(c) for c in json.loads(r["cells"])])
            if r["n_turns"]:
                whole.n_turns += r["n_turns"] - (r["low"] == whole.high)
                whole.low, whole.high = r["low"] if whole.low is None else whole.low, r["high"]
            if r["opens"] is not None:
                whole.pair(r["opens"])
                whole.closes = r["closes"]
            for name in ("blank", "duplicate", "truncated", "illegal"):
                setattr(whole, name, getattr(whole, name) + r[name])
        whole.held = None
        return whole.row(-1, True)

    def work(batches):
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["conv_id"] != r["conv_id"]:
                    yield _arrow([finish(held)])
                    held = []
                held.append(r)
        if held:
            yield _arrow([finish(held)])

    parts = runs.filter("NOT whole")
    return stage(parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(work, _TABLE), "conversation-plans")


def _with_audits(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """Sorted turns of the planned conversations, each led by a row with its audit as text."""
    some = plans.select(F.col("conv_id").alias("_conv"))
    rows = turns.join(some, _same("conv_id", "_conv"), "left_semi").filter("copies > 0").select("conv_id", "turn", "lead", "content", "role", "text", "copies", F.lit(1).alias("kind"))
    heads = plans.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("lead"), F.lit("").alias("content"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("copies"), F.lit(0).alias("kind"))
    ordered = rows.unionByName(heads).repartition("conv_id").sortWithinPartitions(_ORDER[0], "kind", *_ORDER[1:])
    return ordered.select("conv_id", "kind", "role", "text", "copies")


def _conversations(batches) -> Iterator[tuple[object, str, Iterator[tuple[str, str]]]]:
    """Identifier, audit and a stream of turns; the stream must be read before the next conversation."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
    ahead = [next(rows, None)]

    def turns():
        while (ahead[0] is not None) and ahead[0][1]:
            for _ in range(ahead[0][4]):
                yield ahead[0][2], ahead[0][3]
            ahead[0] = next(rows, None)

    while ahead[0] is not None:
        conv, _, _, audit, _ = ahead[0]
        ahead[0] = next(rows, None)
        stream = turns()
        yield conv, audit, stream
        for _ in stream:
            pass


def plan_repairs(turns: DataFrame) -> DataFrame:
    """Per conversation: faults, cost and audit of the cheapest repair; no digest where it lay over several tasks."""
    runs = parse_runs(turns)
    return runs.filter("whole").unionByName(_joined(runs))


def _result(plans: DataFrame) -> DataFrame:
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n_turns"), F.lit(0))
    return plans.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_digests(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """One row per conversation: ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Null fields count as one space; all rows without ``conv_id`` are one conversation. Turns are ordered by
    number, nulls first; turns of one number by role and then by a hash of role and text. A role that is
    empty or begins with another letter than s, u, a cannot be kept. A conversation without turns left has
    zeros, an empty audit and the digest of nothing. An empty table gives no rows. Other columns are ignored.
    """
    turns = faulted_turns((damaged if damage else undamaged)(conversations))
    runs = parse_runs(turns)
    joined = _joined(runs)

    def work(batches):
        for conv, audit, stream in _conversations(batches):
            yield pa.RecordBatch.from_pydict({"_conv": pa.array([conv], pa.int64()), "_sha": pa.array([_digest(audit, stream)])})

    digests = _with_audits(turns, joined).mapInArrow(work, "_conv long, _sha string")
    split = joined.drop("repaired_sha256").join(digests, _same("conv_id", "_conv")).withColumnRenamed("_sha", "repaired_sha256")
    return _result(runs.filter("whole").unionByName(split.select(*runs.columns)))


def repaired_turns(conversations: DataFrame, damage: bool = False) -> DataFrame:
    """The repaired conversations: ``conv_id, position, edit, role, text``; edit K, R or I."""
    turns = faulted_turns((damaged if damage else undamaged)(conversations))
    plans = plan_repairs(turns)

    def work(batches):
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

        def arrow(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["conv_id", "position", "edit", "role", "text"])

        rows = []
        for conv, audit, stream in _conversations(batches):
            for position, turn in enumerate(edited(audit, stream)):
                rows.append((conv, position, *turn))
                if len(rows) >= 5000:
                    yield arrow(rows)
                    rows = []
        yield arrow(rows)

    return _with_audits(turns, plans).mapInArrow(work, "conv_id long, position long, edit string, role string, text string")
