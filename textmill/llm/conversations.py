"""Operator 12, conversation structure repair.

Each turn becomes a symbol of its role's initial and its fault.  Runs of equal
symbols collapse; the cheapest way to a legal order of roles is a min-plus
product of 4 x 4 transitions, one for each symbol, and a run of n goes through
the cached binary powers of its own.  The costs to go then decide each turn's
edit, in the order of the edits' letters, so that of equally cheap audits the
least is found.

Turns are numbered inside their conversation by a distributed rank and worked
on in blocks of at most ``BLOCK_TURNS``.  A conversation of more blocks is
solved in parallel too: only the blocks' matrices, costs and states meet in
one group.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import written
from textmill.operators.windows import group_row_number

#: ASCII white space, and the marks that end a whole turn.
SPACE, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Turns of one block (a work size).
BLOCK_TURNS = 65_536
NEVER = 1 << 60

# States: nothing yet, after system, after user, after assistant; a whole
# conversation ends in the first or the last.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a user's or assistant's turn (what may be inserted, and what
#: a role may become) leads to.
NEXT = (USER, USER, ASSISTANT, USER)
KEEP = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
#: Symbols: the initial (o: any other), in upper case if truncated; x must go.
SYMBOLS = "suaoSUAOx"


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product of a matrix and a matrix or vector."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), NEVER) if b.ndim == 2 else np.minimum((a + b[None, :]).min(1), NEVER)


def _edges(edges: dict[tuple[int, int], int]) -> np.ndarray:
    out = np.full((4, 4), NEVER, np.int64)
    for (a, b), cost in edges.items():
        out[a, b] = min(out[a, b], cost)
    return out


#: Any number of insertions: more than two in a row never pay.
_ONE = _edges({**{(s, s): 0 for s in range(4)}, **{(s, NEXT[s]): INSERT for s in range(4)}})
INSERTIONS = _times(_ONE, _ONE)
#: Costs to go when no turn is left.
END = INSERTIONS[:, [EMPTY, ASSISTANT]].min(1)


@functools.cache
def power(symbol: str, k: int) -> np.ndarray:
    """Transition of 2**k turns of ``symbol``, insertions before each included."""
    if k:
        half = power(symbol, k - 1)
        return _times(half, half)
    moves = {(s, s): DELETE for s in range(4)}
    if symbol != "x":
        late = TRUNCATED * symbol.isupper()
        moves |= {(s, NEXT[s]): REROLE + late for s in range(4)}
        moves |= {(s, t): late for s, t in KEEP[symbol.lower()].items()}
    return _times(INSERTIONS, _edges(moves))


def _advance(symbol: str, n: int, x: np.ndarray) -> np.ndarray:
    """``x``, the costs (or transition) after a run, carried before it."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            x = _times(power(symbol, k), x)
    return x


def runs_of(symbols: str) -> tuple[tuple[str, int], ...]:
    return tuple((s, sum(1 for _ in own)) for s, own in itertools.groupby(symbols))


def transition(runs: tuple) -> np.ndarray:
    out = _edges({(s, s): 0 for s in range(4)})
    for symbol, n in reversed(runs):
        out = _advance(symbol, n, out)
    return out


def _insert(state: int) -> str:
    return "A" if state == USER else "U"


@functools.lru_cache(20_000)
def edits(runs: tuple, after: tuple, state: int = EMPTY, last: bool = True) -> tuple[tuple[str, ...], int]:
    """(edits of each turn, state after the last), cheapest and least: K keep,
    D delete, u or a a new role, U or A an inserted turn before (at the end of
    a conversation, after) the turn.  ``after`` has the costs to go behind these runs."""
    ends = [np.array(after)]
    for symbol, n in reversed(runs):
        ends.append(_advance(symbol, n, ends[-1]))
    out = []
    for (symbol, n), behind in zip(runs, ends[-2::-1]):
        # Costs to go behind each turn of this run alone.
        step, late, keeps = power(symbol, 0), TRUNCATED * symbol.isupper(), KEEP.get(symbol.lower(), {})
        costs = [behind]
        for _ in range(n):
            costs.append(_times(step, costs[-1]))
        costs = [c.tolist() for c in costs]
        for left in range(n - 1, -1, -1):
            here, then, done = costs[left + 1], costs[left], ""
            while True:
                cost = here[state]
                if cost == DELETE + then[state]:
                    done += "D"
                elif cost == INSERT + here[NEXT[state]]:
                    done += _insert(state)
                    state = NEXT[state]
                    continue
                elif state in keeps and cost == late + then[keeps[state]]:
                    done += "K"
                    state = keeps[state]
                else:
                    done += _insert(state).lower()
                    state = NEXT[state]
                break
            out.append(done)
    while last and out and state not in (EMPTY, ASSISTANT):
        out[-1] += _insert(state)
        state = NEXT[state]
    return tuple(out), state


def _pieces(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict]:
    """Rows of one key, which are consecutive, as lists of all columns."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.to_pydict()
        where = [0, *(i for i in range(1, batch.num_rows) if any(own[k][i] != own[k][i - 1] for k in keys)), batch.num_rows]
        for a, b in itertools.pairwise(where):
            piece = {c: v[a:b] for c, v in own.items()}
            if held and all(held[k][0] == piece[k][0] for k in keys):
                for c, v in piece.items():
                    held[c] += v
                continue
            if held:
                yield held
            held = piece
    if held:
        yield held


def _table(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


_SOLVED = pa.schema([("conv", pa.string()), ("k", pa.int64()), ("edits", pa.string()), ("block", pa.int64()), ("symbols", pa.string()), ("matrix", pa.list_(pa.int64()))])
_END = tuple(END.tolist())


def _solver(block_turns: int):
    """Edits of conversations within one block; of longer ones, each block's symbols and matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = {f.name: [] for f in _SOLVED}
        for piece in _pieces(batches, ["conv", "block"]):
            n, block, symbols = len(piece["k"]), piece["block"][0], "".join(piece["symbol"])
            if block == 0 and n < block_turns:
                rows = {"conv": piece["conv"], "k": piece["k"], "edits": edits(runs_of(symbols), _END)[0], "block": [None] * n, "symbols": [None] * n, "matrix": [None] * n}
            else:
                rows = {"conv": [piece["conv"][0]], "k": [None], "edits": [None], "block": [block], "symbols": [symbols], "matrix": [transition(runs_of(symbols)).ravel().tolist()]}
            for c, v in rows.items():
                out[c] += v
            if len(out["k"]) >= 10_000:
                yield _table(out, _SOLVED)
                out = {f.name: [] for f in _SOLVED}
        yield _table(out, _SOLVED)

    return run


def _costs_after(table: pa.Table) -> pa.Table:
    """Costs to go behind each block of one conversation."""
    table, costs, after = table.sort_by("block"), END, []
    for m in reversed(table["matrix"].to_pylist()):
        after.append(costs.tolist())
        costs = _times(np.array(m, np.int64).reshape(4, 4), costs)
    last = [False] * (len(after) - 1) + [True]
    return pa.table({"conv": table["conv"], "block": table["block"], "after": pa.array(after[::-1], pa.list_(pa.int64())), "last": last})


def _states_before(table: pa.Table) -> pa.Table:
    """The state in which each block of one conversation begins."""
    table, state, before = table.sort_by("block"), EMPTY, []
    for ends in table["ends"].to_pylist():
        before.append(state)
        state = ends[state]
    return pa.table({"conv": table["conv"], "block": table["block"], "state": pa.array(before, pa.int64())})


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after each block, for every state before it."""
    for batch in batches:
        own = batch.to_pydict()
        found = [[edits(runs_of(s), tuple(a), state, last)[1] for state in range(4)] for s, a, last in zip(own["symbols"], own["after"], own["last"])]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), pa.array(found, pa.list_(pa.int64()))], names=["conv", "block", "ends"])


def _unrolled(block_turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                done, _ = edits(runs_of(r["symbols"]), tuple(r["after"]), r["state"], r["last"])
                first = r["block"] * block_turns + 1
                yield pa.RecordBatch.from_arrays([pa.array([r["conv"]] * len(done)), pa.array(range(first, first + len(done)), pa.int64()), pa.array(done)], names=["conv", "k", "edits"])

    return run


def _long_ones(blocks: DataFrame, block_turns: int) -> DataFrame:
    """(conv, k, edits) of conversations of several blocks."""
    after = blocks.select("conv", "block", "matrix").groupBy("conv").applyInArrow(_costs_after, "conv string, block long, after array<long>, last boolean")
    known = written(blocks.select("conv", "block", "symbols").join(after, ["conv", "block"]), "blocks")
    ends = known.mapInArrow(_ends, "conv string, block long, ends array<long>")
    before = ends.groupBy("conv").applyInArrow(_states_before, "conv string, block long, state long")
    return known.join(before, ["conv", "block"]).mapInArrow(_unrolled(block_turns), "conv string, k long, edits string")


def _inner(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE))


def repair(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row a turn: ``id_col``, ``conv`` (the id as text, a space for null),
    ``k`` (1, 2 ... in order), ``turn``, ``role``, ``text``, ``initial``,
    ``fault`` (blank, duplicate, truncated or null) and ``edits`` (see ``edits``).

    Null roles and texts count as one space.  Turns go by number, nulls first,
    then role and text; a null id is a conversation of its own; an empty table
    gives an empty one; other columns are left alone."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = turns.select(F.col(f"`{id_col}`").alias("id"), text(id_col).alias("conv"), F.col(f"`{turn_col}`").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    # Equal turns differ by their place in the input alone, so that many of them are dealt out.
    rows = written(group_row_number(rows.withColumn("_row", F.monotonically_increasing_id()), ["conv"], ["turn", "role", "text", "_row"], out="k").drop("_row"), "turns")
    initial, inner = F.substring("role", 1, 1), _inner(F.col("text"))
    whole = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    slim = rows.select("conv", "k", initial.alias("initial"), (inner == "").alias("blank"), (~F.right(inner, F.lit(1)).isin(*ENDS)).alias("cut"), whole.alias("whole"))
    firsts = slim.groupBy("conv", "whole").agg(F.min("k").alias("k")).select("conv", "k", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    symbol = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(symbol)).otherwise(symbol)
    slim = slim.drop("whole").join(firsts, ["conv", "k"], "left").withColumn("fault", fault).withColumn("symbol", symbol)
    slim = written(slim.select("conv", "k", "initial", "fault", "symbol", F.floor((F.col("k") - 1) / block_turns).alias("block")), "symbols")
    dealt = slim.select("conv", "block", "k", "symbol").repartition("conv", "block").sortWithinPartitions("conv", "block", "k")
    solved = written(dealt.mapInArrow(_solver(block_turns), "conv string, k long, edits string, block long, symbols string, matrix array<long>"), "solved")
    every = solved.where("symbols is null").select("conv", "k", "edits").union(_long_ones(solved.where("symbols is not null"), block_turns))
    out = rows.join(slim.select("conv", "k", "initial", "fault"), ["conv", "k"]).join(every, ["conv", "k"])
    return out.select(F.col("id").alias(id_col), "conv", "k", "turn", "role", "text", "initial", "fault", "edits")


def lines() -> Column:
    """The turns (role, text) that a row of ``repair`` becomes, in order."""
    def one(e: Column) -> Column:
        role = F.when(e == "K", F.col("role")).when(F.lower(e) == "u", "user").otherwise("assistant")
        return F.struct(role.alias("role"), F.when(e.isin("U", "A"), "").otherwise(F.col("text")).alias("text"))

    return F.transform(F.filter(F.split("edits", ""), lambda e: ~e.isin("D", "")), one)


def repaired(turns: DataFrame, id_col: str = "conv_id", **options) -> DataFrame:
    """The repaired conversations: ``id_col``, ``k``, ``part``, ``role`` and
    ``text``, in the order of ``k`` and ``part``."""
    done = repair(turns, id_col, **options)
    return done.select(id_col, "k", F.posexplode(lines()).alias("part", "line")).select(id_col, "k", "part", "line.role", "line.text")


_DIGEST = pa.schema([("conv", pa.string()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


class _Digest:
    """What a conversation's ordered stream of turns adds up to."""

    def __init__(self):
        self.first = self.last = self.initial = None
        self.turns = self.illegal = self.cost = 0
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.audit: list[str] = []
        self.sha, self.any = hashlib.sha256(), False

    def add(self, turn: int | None, initial: str, fault: str | None, done: str, piece: str | None) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if fault:
            self.faults[fault] += 1
        self.audit.append(done.translate(_LETTERS))
        self.cost += sum(map(_COSTS.__getitem__, done)) + (TRUNCATED if fault == "truncated" and "D" not in done else 0)
        if piece is not None:
            self.sha.update((("\n" if self.any else "") + piece).encode())
            self.any = True

    def row(self, conv: str) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


_LETTERS = str.maketrans("uaUA", "RRII")
_COSTS = {"K": 0, "D": DELETE, "u": REROLE, "a": REROLE, "U": INSERT, "A": INSERT}


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, now, out = None, None, []
    for batch in batches:
        for own, *rest in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "initial", "fault", "edits", "piece"))):
            if own != conv:
                if now:
                    out.append(now.row(conv))
                conv, now = own, _Digest()
            now.add(*rest)
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _DIGEST)], schema=_DIGEST)
            out = []
    if now:
        out.append(now.row(conv))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _DIGEST)], schema=_DIGEST)


def digests(done: DataFrame) -> DataFrame:
    """One row a conversation of ``repair``'s rows: faults, costs, audit and
    the hash of the repaired text.  A hash is one ordered stream, so the turns
    of one conversation pass one task, a batch at a time."""
    piece = F.array_join(F.transform(lines(), lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    rows = done.select("conv", "k", F.col("turn").cast("long").alias("turn"), "initial", "fault", "edits", F.when(F.size(lines()) > 0, piece).alias("piece"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "k")
    return rows.mapInArrow(_digests, "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
