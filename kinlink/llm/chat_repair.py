"""Chat formatting with minimum-cost role repair.

A legal conversation is a path through a small automaton: an optional system turn, then user and assistant in turn, starting with the user. For each role of an input turn and each state there are a few ways to take the turn: keep it, merge it into the turn before, relabel it, and insert empty turns ahead of it. Dynamic programming finds the cheapest path; the repaired sequence is rendered as fragments that, joined in order, are the formatted conversation.

Costs of stretches compose by (min, +), so a conversation of any length is cut into pieces of bounded size: each piece gives a summary, the summaries give the states at the cuts, and every piece is then repaired by itself. Paths are totally ordered, by cost and then by their states, and summaries keep that order; so the repair is the same wherever the cuts fall.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

ROLES = ("system", "user", "assistant")
UNKNOWN = 3  # class of a role that is none of these
# Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
KEEP, MERGE, INSERT, RELABEL, GUESS = 0, 1, 2, 3, 1  # costs; GUESS labels a turn of unknown role
START, SYSTEM, USER, ASSISTANT = range(4)  # states: the role of the last turn put out
STATES = 4
ACCEPT = (USER, ASSISTANT)
PIECE = 2048  # turns in a piece
FAR = 1 << 40
#: Which role may follow which state, and the state it leads to.
LEGAL = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}


def role_class(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else UNKNOWN


@cache
def inserts(state: int) -> dict[int, tuple[int, tuple[int, ...]]]:
    """Where empty turns lead from state: the state to (cost, roles put in), cheapest first found."""
    found: dict[int, tuple[int, tuple[int, ...]]] = {state: (0, ())}
    front = [state]
    while front:
        after = []
        for s in front:
            cost, roles = found[s]
            for role in (1, 2):
                t = LEGAL.get((s, role))
                if t is not None and t not in found:
                    found[t] = (cost + INSERT, (*roles, role))
                    after.append(t)
        front = after
    return found


@cache
def moves(cls: int) -> dict[tuple[int, int], tuple[int, tuple[int, ...], int, str]]:
    """(state, next state) to the cheapest (cost, roles put in before, label, action) for a turn of this class."""
    best: dict[tuple[int, int], tuple[int, tuple[int, ...], int, str]] = {}
    for state in range(STATES):
        for label in range(len(ROLES)):
            price = KEEP if cls == label else GUESS if cls == UNKNOWN else RELABEL
            named = "keep" if cls == label else "relabel"
            options = []
            for s, (cost, roles) in inserts(state).items():
                if (s, label) in LEGAL:
                    options.append((LEGAL[s, label], (cost + price, roles, label, named)))
            if state == label + 1:  # the last turn has this role
                options.append((state, (price + MERGE, (), label, "merge" if named == "keep" else "relabel+merge")))
            for t, option in options:
                if (state, t) not in best or option[0] < best[state, t][0]:
                    best[state, t] = option
    return best


#: For each state the cost of its cheapest path above the least of all (FAR: none leads there), and the place of that path among those of the other states, by the states passed from the first turn on.
Vector = tuple[tuple[int, int], ...]


def start(state: int) -> Vector:
    return tuple((0 if s == state else FAR, 0) for s in range(STATES))


def _step(options: list[list[tuple[int, int, int, int]]]) -> tuple[Vector, int, tuple[int, ...]]:
    """From each next state's ways there (cost, place of the path so far, place of the way, state before): the next vector, the least cost, and the states before."""
    best = [min(ways) if ways else None for ways in options]
    least = min(x[0] for x in best if x)
    order = sorted((x[1], x[2], t) for t, x in enumerate(best) if x)
    place = {t: i for i, (*_, t) in enumerate(order)}
    return tuple((x[0] - least, place[t]) if x else (FAR, 0) for t, x in enumerate(best)), least, tuple(x[3] if x else -1 for x in best)


@cache
def advance(vector: Vector, cls: int) -> tuple[Vector, int, tuple[int, ...]]:
    """A turn of this class. There are few vectors, so this soon is a table."""
    ways = moves(cls)
    return _step([[(c + ways[s, t][0], r, t, s) for s, (c, r) in enumerate(vector) if c < FAR and (s, t) in ways] for t in range(STATES)])


def last_state(vector: Vector) -> tuple[int, tuple[int, ...]]:
    """The best last state and the roles put in after it: the least cost, then the fewest roles, then the first path."""
    options = [(c + cost, len(roles), r, s, roles) for s, (c, r) in enumerate(vector) if c < FAR for t, (cost, roles) in inserts(s).items() if t in ACCEPT]
    *_, state, roles = min(options)
    return state, roles


def _back(state: int, befores: list[tuple[int, ...]]) -> list[int]:
    states = [state]
    for before in reversed(befores):
        states.append(before[states[-1]])
    return states[::-1]


def path(classes: list[int], entry: int, leave: int | None) -> list[int]:
    """The states before each turn and after the last on the best path from entry to leave, or to the best end. Of equally cheap paths the best is the one whose states come first, compared from the first turn on; so there is only one, and it is the same however a conversation is cut."""
    vector, befores = start(entry), []
    for c in classes:
        vector, _, before = advance(vector, c)
        befores.append(before)
    return _back(last_state(vector)[0] if leave is None else leave, befores)


class Summary:
    """A stretch of turns as a whole: for each state before and each after, the cost of the best path and its place among those from the same state."""

    def __init__(self):
        self.vectors = [start(s) for s in range(STATES)]
        self.shifts = [0] * STATES

    def add(self, cls: int) -> None:
        for s in range(STATES):
            self.vectors[s], least, _ = advance(self.vectors[s], cls)
            self.shifts[s] += least

    def numbers(self) -> list[int]:
        return [n for s in range(STATES) for c, r in self.vectors[s] for n in (min(c + self.shifts[s], FAR) if c < FAR else FAR, r)]


def through(summaries: list[list[int]]) -> list[tuple[int, int]]:
    """The states before and after each stretch of a conversation, in order, from the numbers of their summaries."""
    vector, befores = start(START), []
    for numbers in summaries:
        way = lambda s, t: numbers[2 * (STATES * s + t) : 2 * (STATES * s + t) + 2]  # noqa: B023, E731
        vector, _, before = _step([[(c + way(s, t)[0], r, way(s, t)[1], s) for s, (c, r) in enumerate(vector) if c < FAR and way(s, t)[0] < FAR] for t in range(STATES)])
        befores.append(before)
    states = _back(last_state(vector)[0], befores)
    return list(zip(states, states[1:]))


def fragment(role: int, text: str, first: bool, merged: bool) -> str:
    if merged:
        return "\n\n" + text
    return ("" if first else "<|im_end|>\n") + f"<|im_start|>{ROLES[role]}\n{text}"


def repair(turns: list[tuple[int | None, str | None, str | None]], entry: int = START, leave: int | None = None, last: bool = True) -> list[tuple]:
    """(turn, step, role, action, cost, fragment) for each turn (turn, role, text) and each insertion, in order. Turns put in carry the number of the turn they precede, or at the end of the last. last: whether the conversation ends here."""
    classes = [role_class(r) for _, r, _ in turns]
    states = path(classes, entry, leave)
    out = []
    for (turn, _, text), cls, s, t in zip(turns, classes, states, states[1:]):
        cost, roles, label, action = moves(cls)[s, t]
        for i, r in enumerate(roles):
            out.append((turn, i, ROLES[r], "insert", INSERT, fragment(r, "", s == START and i == 0, False)))
        out.append((turn, len(roles), ROLES[label], action, cost - INSERT * len(roles), fragment(label, text or "", s == START and not roles, action.endswith("merge"))))
    if last and turns:
        _, roles = last_state(start(states[-1]))
        turn, step = turns[-1][0], out[-1][1] + 1
        for i, r in enumerate(roles):
            out.append((turn, step + i, ROLES[r], "insert", INSERT, fragment(r, "", states[-1] == START and i == 0, False)))
        *rest, end = out
        out = [*rest, (*end[:5], end[5] + "<|im_end|>\n")]
    return out


def _cut(piece: int):
    """From rows in order: each with its piece and place, and for each piece a row with its summary."""

    def run(batches):
        part = TaskContext.get().partitionId()
        seq, at, now, whole = -1, 0, object(), Summary()
        for batch in batches:
            rows = batch.to_pydict()
            out = {k: [] for k in ("conv_id", "piece", "at", "turn", "role", "text", "summary")}

            def put(conv, at, turn, role, text, costs, out=out):
                for k, v in zip(out, (conv, part << 32 | seq, at, turn, role, text, costs)):
                    out[k].append(v)

            for conv, turn, role, text in zip(rows["conv_id"], rows["turn"], rows["role"], rows["text"]):
                if conv != now or at == piece:
                    if seq >= 0:
                        put(now, None, None, None, None, whole.numbers())
                    seq, at, now, whole = seq + 1, 0, conv, Summary()
                put(conv, at, turn, role, text, None)
                whole.add(role_class(role))
                at += 1
            yield pa.RecordBatch.from_pydict(out, schema=_CUT)
        if seq >= 0:
            yield pa.RecordBatch.from_pydict({"conv_id": [now], "piece": [part << 32 | seq], "at": [None], "turn": [None], "role": [None], "text": [None], "summary": [whole.numbers()]}, schema=_CUT)

    return run


_CUT = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("at", pa.int32()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("summary", pa.list_(pa.int64()))])
_CUT_SQL = "conv_id long, piece long, at int, turn long, role string, text string, summary array<bigint>"


def _bounds(batches):
    """For each conversation of several pieces, the states at their ends."""
    for batch in batches:
        out = {"piece": [], "entry": [], "leave": []}
        for pieces in batch.column("pieces").to_pylist():
            pieces = sorted(pieces, key=lambda p: p["piece"])
            for p, (entry, leave) in zip(pieces, through([p["summary"] for p in pieces])):
                for k, v in zip(out, (p["piece"], entry, leave)):
                    out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("piece", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32())]))


def _repaired(batches):
    """From turns in the order of (piece, at), piece by piece."""
    now, held = None, []

    def flush(out):
        if held:
            entry, leave, last = held[0]["entry"], held[0]["leave"], held[0]["last"]
            for x in repair([(r["turn"], r["role"], r["text"]) for r in held], START if entry is None else entry, leave, last):
                out.append((held[0]["conv_id"], *x))
            held.clear()

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(_OUT), _OUT.types)], schema=_OUT)

    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            if row["piece"] != now:
                flush(out)
                now = row["piece"]
            held.append(row)
        yield batch_of(out)
    out = []
    flush(out)
    yield batch_of(out)


_OUT = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("step", pa.int32()), ("role", pa.string()), ("action", pa.string()), ("cost", pa.int32()), ("fragment", pa.string())])
_OUT_SQL = "conv_id long, turn long, step int, role string, action string, cost int, fragment string"


def repaired(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, turn, step, role, action, cost, fragment): the repaired turns; by conv_id, turn and step in order, a conversation's fragments joined are its text.

    Turns are ordered by turn, null turns first, and of equal ones by a hash of role and text, then role and text; so repeated rows and ties have a fixed order. A null text is empty; a null or foreign role is unknown and gets the label that costs least. Rows of null conv_id are one conversation. Each conversation's cost is the least there is; of equally cheap repairs the one is taken whose states come first, wherever the rows are cut and however they are dealt. Columns other than conv_id, turn, role and text are ignored. An empty table gives no rows. Rows are dealt by ranges of (conv_id, turn), so that a conversation of any length is shared by many tasks.
    """
    spark = conversations.sparkSession
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("tie", F.xxhash64("role", "text")).repartitionByRange(tasks, "conv_id", "turn", "tie").sortWithinPartitions("conv_id", "turn", "tie", "role", "text")
    cut = staged(dealt.select(*order).mapInArrow(_cut(piece), _CUT_SQL))
    pieces = cut.filter(F.col("summary").isNotNull()).select("conv_id", "piece", "summary")
    many = pieces.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("piece").alias("final")).filter("n > 1")
    of_many = pieces.join(many.select(F.col("conv_id").alias("_conv"), "final"), F.col("conv_id").eqNullSafe(F.col("_conv")))
    bounds = of_many.groupBy("conv_id").agg(F.collect_list(F.struct("piece", "summary")).alias("pieces")).select("pieces").mapInArrow(_bounds, "piece long, entry int, leave int")
    known = staged(bounds.join(of_many.select("piece", (F.col("piece") == F.col("final")).alias("last")), "piece"))
    turns = cut.filter(F.col("summary").isNull()).select("conv_id", "piece", "at", "turn", "role", "text").join(known, "piece", "left")
    turns = turns.withColumn("last", F.coalesce("last", F.lit(True))).withColumn("leave", F.when(F.col("last"), F.lit(None)).otherwise(F.col("leave")))
    return turns.repartition(tasks, "piece").sortWithinPartitions("piece", "at").mapInArrow(_repaired, _OUT_SQL)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))


QUERIES = {"op8_chat_repair": op8}
ORACLES: dict[str, str] = {}
