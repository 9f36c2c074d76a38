"""Repair of conversations by generalised LR parsing of their roles, with weighted edits."""

from __future__ import annotations

import hashlib
import os
from collections import deque
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tickloom.llm.common import slices
from tickloom.operators.series import join_sized

#: Roles by their initials: a conversation is ``(s?(ua)+)?``. TURNS is read from the left, one exchange after the other.
GRAMMAR = (("CONVERSATION", ()), ("CONVERSATION", ("TURNS",)), ("CONVERSATION", ("s", "TURNS")), ("TURNS", ("EXCHANGE",)), ("TURNS", ("TURNS", "EXCHANGE")), ("EXCHANGE", ("u", "a")))
START = "CONVERSATION"
#: Costs of the edits, and of keeping a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: From any stack top, one insert and one deletion more do what any other top can do.
SLACK = INSERT + DELETE
#: Faults of a row.
SOUND, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
#: Rows that are read before edits are asked for.
FLUSH = 64
INITIALS = ("s", "u", "a")

Items = frozenset[tuple[int, int]]


def _closure(items: Iterable[tuple[int, int]]) -> Items:
    done, todo = set(), list(items)
    while todo:
        item = todo.pop()
        if item in done:
            continue
        done.add(item)
        body = GRAMMAR[item[0]][1]
        if item[1] < len(body):
            todo += [(i, 0) for i, (head, _) in enumerate(GRAMMAR) if head == body[item[1]]]
    return frozenset(done)


@cache
def automaton() -> tuple[list[dict[str, int]], list[list[tuple[str, int]]]]:
    """LR(0) states of the grammar: what each moves to by symbol, and its finished productions ``(head, length)``."""
    states = [_closure((i, 0) for i, (head, _) in enumerate(GRAMMAR) if head == START)]
    moves: list[dict[str, int]] = []
    for items in states:  # grows while it is read
        move = {}
        for symbol in sorted({GRAMMAR[i][1][at] for i, at in items if at < len(GRAMMAR[i][1])}):
            to = _closure((i, at + 1) for i, at in items if at < len(GRAMMAR[i][1]) and GRAMMAR[i][1][at] == symbol)
            if to not in states:
                states.append(to)
            move[symbol] = states.index(to)
        moves.append(move)
    return moves, [[(GRAMMAR[i][0], at) for i, at in items if at == len(GRAMMAR[i][1])] for items in states]


# A stack is a linked list (state, stack below); stacks share what lies below. An entry of the frontier maps the state on
# top to (cost, audit since the last flush, stack).
Stack = tuple[int, "Stack | None"]
Frontier = dict[int, tuple[int, str, Stack]]


def _offer(frontier: Frontier, cost: int, audit: str, stack: Stack) -> bool:
    """Merge a stack into the frontier: of equal tops the smallest (cost, audit) stays."""
    old = frontier.get(stack[0])
    if old is not None and (old[0], old[1]) <= (cost, audit):
        return False
    frontier[stack[0]] = (cost, audit, stack)
    return True


@cache
def _shift(stack: Stack, symbol: str) -> Stack | None:
    """The stack after a symbol and all reductions but those to the whole conversation, which wait for the end."""
    moves, finished = automaton()
    to = moves[stack[0]].get(symbol)
    if to is None:
        return None
    stack = (to, stack)
    while True:
        heads = [(head, size) for head, size in finished[stack[0]] if head != START]
        if not heads:
            return stack
        head, size = heads[0]  # the grammar has no two such reductions in one state
        for _ in range(size):
            stack = stack[1]
        stack = (moves[stack[0]][head], stack)


def _insertions(frontier: Frontier) -> Frontier:
    """Everything reachable by inserted turns, until no top gets better."""
    todo = list(frontier.values())
    while todo:
        cost, audit, stack = todo.pop()
        if frontier[stack[0]][:2] < (cost, audit):
            continue
        for initial in ROLES:
            onward = _shift(stack, initial)
            if onward is not None and _offer(frontier, cost + INSERT, audit + "I", onward):
                todo.append(frontier[onward[0]])
    return frontier


def _row(frontier: Frontier, initial: str, cut: bool) -> Frontier:
    """Keep, rerole or delete one row that may stay."""
    out: Frontier = {}
    extra = TRUNCATED if cut else 0
    for cost, audit, stack in _insertions(frontier).values():
        _offer(out, cost + DELETE, audit + "D", stack)
        kept = _shift(stack, initial) if initial else None
        if kept is not None:
            _offer(out, cost + extra, audit + "K", kept)
        for to in ROLES:
            moved = _shift(stack, to)
            if moved is not None:
                _offer(out, cost + extra + REROLE, audit + "R", moved)
    least = min(c for c, _, _ in out.values())
    return {s: e for s, e in out.items() if e[0] <= least + SLACK}


class Parser:
    """Online search for the cheapest edits of a conversation, given as rows ``(role initial, fault)``.

    Of two audits of equal cost that end at the same row neither is a beginning of the other (the longer one would have paid
    for more inserts), so the smaller one stays smaller whatever follows, and merging equal tops is exact. What all
    stacks agree on is handed out as decided; a conversation of any length needs little memory.
    """

    def __init__(self) -> None:
        self.frontier: Frontier = {0: (0, "", (0, None))}
        self.paid, self.forced = 0, 0

    def _settle(self) -> None:
        if self.forced:
            self.frontier = {s: (c, a + "D" * self.forced, k) for s, (c, a, k) in self.frontier.items()}
            self.paid += DELETE * self.forced
            self.forced = 0

    def feed(self, symbols: Iterable[tuple[str, int]]) -> str:
        """Read rows; returns the edits that are decided by now."""
        for initial, fault in symbols:
            if fault in (BLANK, DUPLICATE):
                # All stacks delete the row. An insert may as well follow, with a smaller audit ("D" before "I").
                self.forced += 1
            else:
                self._settle()
                self.frontier = _row(self.frontier, initial, fault == CUT)
        least = min(c for c, _, _ in self.frontier.values())
        agreed = os.path.commonprefix([a for _, a, _ in self.frontier.values()])
        self.frontier = {s: (c - least, a[len(agreed) :], k) for s, (c, a, k) in self.frontier.items()}
        self.paid += least
        return agreed

    def finish(self) -> tuple[int, str]:
        """Total cost, and the edits since those that ``feed`` has returned."""
        self._settle()
        _, finished = automaton()
        ends = [(c, a) for s, (c, a, _) in _insertions(self.frontier).items() if any(head == START for head, _ in finished[s])]
        cost, audit = min(ends)
        return cost + self.paid, audit


@lru_cache(maxsize=200_000)
def cheapest(symbols: tuple[tuple[str, int], ...]) -> tuple[int, str]:
    """Least cost and, of the audits of that cost, the ASCII-least."""
    parser = Parser()
    agreed = parser.feed(symbols)
    cost, rest = parser.finish()
    return cost, agreed + rest


def _blank(text: str) -> str:
    return rf"NOT ({text} RLIKE '[^\\x20\\x09-\\x0D]')"


def _cut(text: str) -> str:
    return rf"NOT ({text} RLIKE '[.!?][\\x20\\x09-\\x0D]*\\z')"


def marked_rows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text, fault`` of every row; a null role or text is one space.

    Rows are in the order of (turn, nulls first; role; text). The first fault counts: blank, duplicate (same role and
    text at an earlier place) or truncated. Only texts that stand at two turns or more are joined back.
    """
    rows = turns.select(
        F.col(f"`{conv}`").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" ")).alias("text"),
    )
    rows = rows.withColumn("h", F.expr("unhex(sha2(concat(length(role), ':', role, text), 256))"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = (
        rows.groupBy("conv", "h")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first != last")
        .select("conv", "h", F.col("first.turn").alias("first"), F.lit(True).alias("repeated"))
    )
    joined = join_sized(rows, again, ["conv", "h"])
    return joined.selectExpr(
        "conv",
        "turn",
        "role",
        "text",
        f"CASE WHEN {_blank('text')} THEN {BLANK} WHEN repeated AND NOT (turn <=> first) THEN {DUPLICATE} WHEN {_cut('text')} THEN {CUT} ELSE {SOUND} END AS fault",
    )


class _Conversation:
    """What is known of the conversation that is being read."""

    def __init__(self, conv: object) -> None:
        self.conv, self.parser = conv, None
        self.symbols: list[tuple[str, int]] = []
        self.rows: deque[tuple[str, str]] = deque()
        self.faults = [0, 0, 0, 0]
        self.illegal, self.turns, self.low, self.high = 0, 0, None, None
        self.before: tuple | None = None
        self.initial, self.written, self.position = "", False, 0

    def read(self, turn: int | None, role: str, text: str, fault: int) -> None:
        # Equal rows of one turn stand next to each other.
        if fault != BLANK and self.before == (turn, role, text):
            fault = DUPLICATE
        self.faults[fault] += 1
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.illegal += self.before is not None and self.before[1][:1] + role[:1] not in ("su", "ua", "au")
        self.before = (turn, role, text)
        self.symbols.append((role[:1] if role[:1] in INITIALS else "", fault))
        self.rows.append((role, text if fault in (SOUND, CUT) else ""))

    def decide(self) -> str:
        """Edits that are decided by now; memory is given back by what they are applied to."""
        self.parser = self.parser or Parser()
        edits = self.parser.feed(self.symbols)
        self.symbols = []
        return edits

    def finish(self) -> tuple[int, str]:
        if self.parser is None:
            return cheapest(tuple(self.symbols))
        edits = self.parser.feed(self.symbols)
        cost, rest = self.parser.finish()
        return cost, edits + rest

    def apply(self, edits: str) -> Iterator[tuple[str, str, str]]:
        """``(edit, role, text)`` of the next edits."""
        for e in edits:
            role, text = ("", "") if e == "I" else self.rows.popleft()
            if e == "D":
                yield e, role, text
                continue
            if e == "K":
                self.initial = role[:1]
            else:
                self.initial = "a" if self.initial == "u" else "u"
                role = ROLES[self.initial]
            yield e, role, text


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[_Conversation, str, int | None]]:
    """Conversations of sorted rows with their edits as they are decided; the last edits of each come with its cost."""
    now: _Conversation | None = None
    for b in slices(batches, "text"):
        for conv, *row in zip(*(b.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "fault")), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    cost, edits = now.finish()
                    yield now, edits, cost
                now = _Conversation(conv)
            now.read(*row)
            if len(now.symbols) >= FLUSH:
                yield now, now.decide(), None
    if now is not None:
        cost, edits = now.finish()
        yield now, edits, cost


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")


def repaired_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: ``conv_id, position, role, text, edit`` in the roles ``(s?(ua)+)?``.

    ``edit`` is K (kept), R (role changed) or I (inserted, with an empty text). A conversation of which nothing can stay
    has no rows. A null role or text is one space, a null conversation a conversation, rows of a null turn come first,
    rows of one turn are in the order of role and text; other columns are not read; no rows give no rows.
    """
    kind = turns.schema[conv].dataType

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for c, edits, _ in _walk(batches):
            for e, r, t in c.apply(edits):
                if e != "D":
                    out.append((c.conv, c.position, r, t, e))
                    c.position += 1
                    size += len(t) + 64
            if size > 1 << 22:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) if i else pa.array(x, to_arrow_type(kind)) for i, x in enumerate(zip(*rows, strict=True))], names=["conv_id", "position", "role", "text", "edit"])

    schema = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL("position long, role string, text string, edit string").fields])
    return _sorted(marked_rows(turns, conv, turn, role, text)).mapInArrow(rewrite, schema)


_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair_report(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id``, faults and cost, audit of the cheapest repair, and ``repaired_sha256``.

    Faults are counted before the repair: ``gaps`` (missing turn numbers), ``blank``, ``duplicate``, ``truncated`` rows and
    ``illegal`` neighbours. Nulls and ties are taken as ``repaired_turns`` takes them. The digest of a whole conversation is one
    sequence, so a conversation passes one task; it is a stream there, of which the audit and what is not decided yet are kept.
    """
    kind = turns.schema[conv].dataType

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, sha, audit = [], hashlib.sha256(), bytearray()
        for c, edits, cost in _walk(batches):
            for e, r, t in c.apply(edits):
                if e != "D":
                    sha.update(f"{chr(10) if c.written else ''}{r}:{t}".encode())
                    c.written = True
            audit += edits.encode()
            if cost is not None:
                gaps = 0 if c.low is None else c.high - c.low + 1 - c.turns
                out.append((c.conv, gaps, *c.faults[BLANK:], c.illegal, cost, audit.decode(), sha.hexdigest()))
                sha, audit = hashlib.sha256(), bytearray()
                if len(out) >= 4096:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [to_arrow_type(kind), *[pa.int64()] * len(_REPORT), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv_id", *_REPORT, "audit", "repaired_sha256"])

    fields = ", ".join(f"{c} long" for c in _REPORT) + ", audit string, repaired_sha256 string"
    schema = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(fields).fields])
    return _sorted(marked_rows(turns, conv, turn, role, text)).mapInArrow(digest, schema)


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text`` with planted faults, chosen by the crc32 of ``conv:turn`` modulo 20 (nulls: one space).

    0 drops a row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes it a user's.
    """
    key = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (conv, turn)]
    rows = turns.select(
        F.col(f"`{conv}`").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))],
        (F.crc32(F.concat(key[0], F.lit(":"), key[1])) % 20).alias("fault"),
    ).where("fault != 0")
    changed = rows.selectExpr(
        "conv_id",
        "turn",
        "CASE WHEN fault = 4 THEN 'user' ELSE role END AS role",
        "CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '') ELSE text END AS text",
        "explode(sequence(1, CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy",
    )
    return changed.drop("copy")


def damaged_and_repaired(turns: DataFrame) -> DataFrame:
    """``repair_report`` of the ``damaged`` rows, with a row for each conversation that lost all its rows: zeros, no edits."""
    report = repair_report(damaged(turns))
    all_ = turns.select(F.col("conv_id").alias("__conv")).distinct()
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _REPORT]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return all_.join(report, F.col("__conv").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("__conv").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256")
    )
