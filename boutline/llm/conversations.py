"""Repair of conversation structure by cheapest edits, with Four-Russians block tables.

A conversation's rows become symbols; costs to go from the four states of `(s?(ua)+)?` form a
vector with few normalised values, so a table gives, for every vector behind a block of symbols,
the vector before it, the cost between and the state each state leaves in. Blocks are processed
from the end by lookup. Tracing expands them again between known vectors, letter by letter, and
takes the least letter that keeps the cost, which is exact also among ties.

Rows are range-partitioned and cut into chunks, so one conversation may hold any share of them:
a chunk's lookups for all vectors and states make a small function, and only these functions (a
few hundred bytes a chunk) meet per conversation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.session import materialise

BLOCK = 4
CHUNK_ROWS, CHUNK_BYTES = 4096, 1 << 20  # one longer text makes its own chunk
SLICE_BYTES = 4 << 20
COPIES = 1024  # of one row in one piece

# Fixed values of the contract: costs, and letters in their order for ties.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
NONE, SYSTEM, USER, ASSISTANT = range(4)  # states, and from SYSTEM on what they hold last
CLASSES = {"s": 0, "u": 1, "a": 2}  # of role initials, any other: 3
GONE, PAD = 8, 9  # symbols: class, class + 4 if truncated, must go, nothing
SYMBOLS = 10
ALTERNATE = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # an inserted or re-roled turn
KEEP = {(NONE, 0): SYSTEM, (NONE, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {(0, 1), (1, 2), (2, 1)}
FAR = 1 << 20


# ------------------------------------------------------------------ one symbol


def _closed(costs: list[int]) -> tuple[int, ...]:
    """Costs when turns may be inserted first."""
    out = list(costs)
    for _ in range(2):
        out = [min(c, INSERT + out[ALTERNATE[q]]) for q, c in enumerate(out)]
    return tuple(out)


END = _closed([0, FAR, FAR, 0])


def _edits(after: tuple[int, ...], symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost to go, next state) of what may be done with the row, without inserting."""
    if symbol == PAD:
        return [("", after[state], state)]
    out = [("D", DELETE + after[state], state)]
    if symbol != GONE:
        kind, extra = symbol % 4, TRUNCATED * (symbol >= 4)
        kept = KEEP.get((state, kind))
        out += [("K", extra + after[kept], kept)] if kept is not None else []
        out += [("R", REROLE + extra + after[ALTERNATE[state]], ALTERNATE[state])]
    return out


@cache
def before(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs to go in front of a symbol, from those behind it."""
    return _closed([min(cost for _, cost, _ in _edits(after, symbol, q)) for q in range(4)])


@cache
def letters(after: tuple[int, ...], symbol: int, state: int) -> tuple[str, int]:
    """The least letters that do a row at least cost, turns inserted before it included, and the
    state behind them."""
    costs, out = before(after, symbol), ""
    while True:
        options = [(letter, to) for letter, cost, to in _edits(after, symbol, state) if cost == costs[state]]
        inserted = ALTERNATE[state]
        if symbol != PAD and INSERT + costs[inserted] == costs[state] and (not options or options[0][0] > "I"):
            out, state = out + "I", inserted
            continue
        return out + options[0][0], options[0][1]


def closing(state: int) -> str:
    """Turns inserted behind the last row."""
    out = ""
    while END[state]:
        out, state = out + "I", ALTERNATE[state]
    return out


# ------------------------------------------------------------------ blocks


class Tables:
    """Transitions of normalised vectors over every block of `BLOCK` symbols."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = [END]
        number = {END: 0}
        step: list[list[int]] = []
        for vector in self.vectors:  # grows while it is read: all vectors that can be reached
            row = []
            for symbol in range(SYMBOLS):
                costs = before(vector, symbol)
                least = tuple(c - min(costs) for c in costs)
                if least not in number:
                    number[least] = len(self.vectors)
                    self.vectors.append(least)
                row.append(number[least])
            step.append(row)
        one = np.array(step, np.uint8)
        leaves = np.array(
            [[[letters(v, s, q)[1] for q in range(4)] for s in range(SYMBOLS)] for v in self.vectors], np.uint8
        )
        blocks = np.arange(SYMBOLS**BLOCK)
        digits = [blocks // SYMBOLS ** (BLOCK - 1 - i) % SYMBOLS for i in range(BLOCK)]
        behind = [np.repeat(np.arange(len(self.vectors))[:, None], len(blocks), axis=1)]
        for digit in reversed(digits):
            behind.append(one[behind[-1], digit])
        #: before[vector behind, block], leaves[vector behind, block, state]
        self.before = behind.pop()
        state = np.broadcast_to(np.arange(4), (*self.before.shape, 4))
        for digit, vector in zip(digits, reversed(behind)):
            state = leaves[vector[..., None], digit[:, None], state]
        self.leaves = np.ascontiguousarray(state)

    @lru_cache(maxsize=1 << 16)
    def expand(self, vector: int, block: int, state: int) -> tuple[str, int]:
        """Letters of a block between known vectors: backward for the vectors, forward for letters."""
        symbols = [block // SYMBOLS ** (BLOCK - 1 - i) % SYMBOLS for i in range(BLOCK)]
        after = [self.vectors[vector]]
        for symbol in reversed(symbols[1:]):
            after.append(before(after[-1], symbol))
        out = ""
        for symbol, costs in zip(symbols, reversed(after)):
            more, state = letters(costs, symbol, state)
            out += more
        return out, state


@cache
def tables() -> Tables:
    return Tables()


def blocks_of(symbols: bytes) -> np.ndarray:
    padded = np.frombuffer(bytes([PAD]) * (-len(symbols) % BLOCK) + symbols, np.uint8).astype(np.int64)
    return padded.reshape(-1, BLOCK) @ SYMBOLS ** np.arange(BLOCK)[::-1]


def summary(symbols: bytes) -> tuple[bytes, bytes]:
    """A chunk as a function: for every vector behind it the vector before it, and for every vector
    and state the state behind it."""
    t = tables()
    blocks = blocks_of(symbols)
    behind = [np.arange(len(t.vectors))]
    for block in blocks[::-1]:
        behind.append(t.before[behind[-1], block])
    first = behind.pop()
    state = np.broadcast_to(np.arange(4), (len(t.vectors), 4))
    for block, vector in zip(blocks, reversed(behind)):
        state = t.leaves[vector[:, None], block, state]
    return first.astype(np.uint8).tobytes(), state.astype(np.uint8).tobytes()


def trace(symbols: bytes, behind: int = 0, state: int = NONE) -> tuple[str, int]:
    """Letters of a chunk from the state before and the vector behind it, and the state behind it."""
    t = tables()
    blocks = blocks_of(symbols).tolist()
    vectors = [behind]
    for block in reversed(blocks[1:]):
        vectors.append(int(t.before[vectors[-1], block]))
    out = []
    for block, vector in zip(blocks, reversed(vectors)):
        more, state = t.expand(vector, block, state)
        out.append(more)
    return "".join(out), state


# ------------------------------------------------------------------ rows and chunks

WORD = r"[^\x20\x09-\x0D]"


def damage(conversations: DataFrame) -> DataFrame:
    """The test damage: by a checksum of conversation and turn, one row of twenty each is dropped,
    emptied, robbed of its sentence ends, repeated or set to role user. Columns conv_id, turn, role,
    text; NULL role or text is one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"),
        (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20).alias("draw"),
    ).where("draw <> 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _faults(rows: DataFrame) -> DataFrame:
    """Rows in pieces of up to `COPIES` equal ones: conv_id, turn, role, key, piece, copies, repeat
    (an equal role and text stands earlier), blank, truncated, text (NULL where it is not needed)."""
    rows = rows.select("conv_id", "turn", "role", "text")
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("key", F.unhex(F.md5("text")))
    rank = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    said = ["conv_id", "role", "key"]
    first = rows.groupBy(*said).agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    first = first.select(*[F.col(c).alias(f"first_{c}") for c in said], "first")
    same = [F.col(c).eqNullSafe(F.col(f"first_{c}")) for c in said]
    joined = rows.join(first, same[0] & same[1] & same[2], "left")
    last = F.regexp_extract("text", rf"({WORD})[\x20\x09-\x0D]*$", 1)
    joined = joined.select(
        *rows.columns, F.coalesce(rank > F.col("first"), F.lit(False)).alias("repeat"), (~F.col("text").rlike(WORD)).alias("blank"),
        (~last.isin(".", "!", "?")).alias("truncated"),
    )
    pieces = F.sequence(F.lit(0), ((F.col("copies") - 1) / COPIES).cast("int"))
    cut = joined.withColumn("piece", F.explode(pieces))
    return cut.select(
        "conv_id", "turn", "role", "key", "piece", F.least(F.lit(COPIES), F.col("copies") - F.col("piece") * COPIES).cast("int").alias("copies"),
        (F.col("repeat") | (F.col("piece") > 0)).alias("repeat"), "blank", "truncated",
        F.when(~F.col("repeat") & ~F.col("blank") & (F.col("piece") == 0), F.col("text")).alias("text"),
    )


_COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
CHUNK_SCHEMA = (
    "conv_id long, part long, seq long, whole boolean, symbols binary, roles array<string>, texts array<string>, "
    + ", ".join(f"{c} long" for c in _COUNTS)
    + ", first_turn long, last_turn long, first_class int, last_class int, entry binary, leaves binary"
)


class Chunk:
    """Consecutive rows of one conversation."""

    def __init__(self, conv_id: int | None):
        self.row: dict = {"conv_id": conv_id} | dict.fromkeys(_COUNTS, 0)
        self.row |= dict.fromkeys(["first_turn", "last_turn", "first_class", "last_class", "entry", "leaves"])
        self.symbols, self.roles, self.texts, self.size = bytearray(), [], [], 0

    def add(self, turn: int | None, role: str, copies: int, repeat: bool, blank: bool, truncated: bool, text: str | None) -> None:
        row, kind = self.row, CLASSES.get(role[:1], 3)
        before_ = row["last_class"]
        row["illegal"] += before_ is not None and (before_, kind) not in LEGAL
        row["illegal"] += copies - 1  # no role may stand twice in a row
        row["first_class"] = kind if before_ is None else row["first_class"]
        row["last_class"] = kind
        if turn is not None and turn != row["last_turn"]:
            row["first_turn"] = turn if row["first_turn"] is None else row["first_turn"]
            row["last_turn"] = turn
            row["turns"] += 1
        if blank:
            row["blank"] += copies
            self.symbols += bytes([GONE]) * copies
            self.texts += [None] * copies
        else:
            row["duplicate"] += copies - (not repeat)
            row["truncated"] += truncated and not repeat
            self.symbols += (b"" if repeat else bytes([kind + 4 * truncated])) + bytes([GONE]) * (copies - (not repeat))
            self.texts += ([] if repeat else [text]) + [None] * (copies - (not repeat))
        self.roles += [role] * copies
        self.size += len(text or "")

    def done(self, part: int, seq: int, whole: bool) -> dict:
        symbols = bytes(self.symbols)
        if not whole:
            self.row["entry"], self.row["leaves"] = summary(symbols)
        return self.row | {"part": part, "seq": seq, "whole": whole, "symbols": symbols, "roles": self.roles, "texts": self.texts}


_KINDS = {
    "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
    "array<string>": pa.list_(pa.string()),
}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _chunks(rows: DataFrame) -> DataFrame:
    order = ["conv_id", "turn", "role", "key", "piece"]
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    names = ["conv_id", "turn", "role", "copies", "repeat", "blank", "truncated", "text"]
    schema = _arrow(CHUNK_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[dict] = []
        size = seq = 0
        chunk, start = None, False  # whether the open conversation began inside this partition, in this chunk
        for batch in batches:
            for conv_id, *row in zip(*[batch.column(n).to_pylist() for n in names]):
                new = chunk is None or conv_id != chunk.row["conv_id"]
                if chunk is not None and (new or chunk.size >= CHUNK_BYTES or len(chunk.symbols) >= CHUNK_ROWS):
                    out.append(chunk.done(part, seq, new and start))
                    size, seq = size + chunk.size + 200, seq + 1
                    start = new
                    chunk = None
                    if size >= SLICE_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, size = [], 0
                if chunk is None:
                    chunk = Chunk(conv_id)
                chunk.add(*row)
        if chunk is not None:
            out.append(chunk.done(part, seq, False))
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return dealt.select(names).mapInArrow(run, CHUNK_SCHEMA)


def _placed(open_: DataFrame) -> DataFrame:
    """(part, seq, behind, state, last) of chunks whose conversation goes on in others: the vector
    behind each and the state before it, from the chunks' functions alone."""
    narrow = open_.select("conv_id", "part", "seq", "entry", "leaves")
    dealt = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    ddl = "part long, seq long, behind int, state int, last boolean"
    schema = _arrow(ddl)

    def placed(group: list[tuple]) -> list[dict]:
        out, behind = [], 0
        for part, seq, entry, leaves in reversed(group):
            out.append({"part": part, "seq": seq, "behind": behind, "last": not out, "leaves": leaves})
            behind = entry[behind]
        state = NONE
        for row in reversed(out):
            row["state"] = state
            state = row.pop("leaves")[4 * row["behind"] + state]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, now = [], None
        for batch in batches:
            out = []
            for conv_id, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if group and conv_id != now:
                    out += placed(group)
                    group = []
                now = conv_id
                group.append(tuple(row))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if group:
            yield pa.RecordBatch.from_pylist(placed(group), schema=schema)

    return dealt.mapInArrow(run, ddl)


REPAIRED_SCHEMA = (
    "conv_id long, part long, seq long, whole boolean, "
    + ", ".join(f"{c} long" for c in _COUNTS)
    + ", first_turn long, last_turn long, first_class int, last_class int, cost long, audit string, turns_text array<string>"
)


def _traced(chunks: DataFrame) -> DataFrame:
    kept = [f.split()[0] for f in REPAIRED_SCHEMA.split(", ")][:-3]
    ddl = REPAIRED_SCHEMA
    schema = _arrow(ddl)

    def done(row: dict) -> dict:
        symbols, state = row["symbols"], row["state"]
        audit, left = trace(symbols, row["behind"], state)
        audit += closing(left) if row["last"] else ""
        at, cost, shown = 0, 0, []
        for letter in audit:
            if letter == "I":
                state, cost = ALTERNATE[state], cost + INSERT
                shown.append(f"{ROLE[state]}:")
                continue
            symbol, role, text = symbols[at], row["roles"][at], row["texts"][at]
            at += 1
            if letter == "D":
                cost += DELETE
                continue
            state = KEEP[state, symbol % 4] if letter == "K" else ALTERNATE[state]
            cost += REROLE * (letter == "R") + TRUNCATED * (symbol >= 4)
            shown.append(f"{role if letter == 'K' else ROLE[state]}:{text}")
        return {k: row[k] for k in kept} | {"cost": cost, "audit": audit, "turns_text": shown}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                yield pa.RecordBatch.from_pylist([done(r) for r in batch.slice(start, 256).to_pylist()], schema=schema)

    return chunks.mapInArrow(run, ddl)


def repair(rows: DataFrame) -> DataFrame:
    """Cheapest repair of every conversation in `rows` (conv_id, turn, role, text), by chunk: counts
    of faults, edits (`audit`), their cost, and the repaired turns (`turns_text`, role:text).

    Rows count by turn, NULL turns first; rows of one turn by role and a digest of
    the text. Equal rows are copies of
    each other. Rows with a NULL conv_id are one conversation; NULL role or text counts as one space.
    Chunks of a conversation are ordered by (part, seq); `whole` marks those that are all of it."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), shown("role"), shown("text"))
    chunks = materialise(_chunks(_faults(rows)), "conversation_chunks")
    alone = chunks.where("whole").select("*", F.lit(0).alias("behind"), F.lit(NONE).alias("state"), F.lit(True).alias("last"))
    others = chunks.where("NOT whole")
    return _traced(alone.unionByName(others.join(_placed(others), ["part", "seq"])))


SUMS = [*_COUNTS[:4], "cost"]
AUDIT_SCHEMA = "conv_id long, gaps long, " + ", ".join(f"{c} long" for c in SUMS) + ", audit string, repaired_sha256 string"


def _summed(chunks: DataFrame) -> DataFrame:
    """One row a conversation from its chunks, read in order: only numbers, the edits and a running
    digest are held."""
    dealt = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    schema = _arrow(AUDIT_SCHEMA)

    def started(conv_id) -> dict:
        return {"conv_id": conv_id, "sums": dict.fromkeys(SUMS, 0), "audit": [], "sha": hashlib.sha256(), "any": False, "turns": 0, "from": None, "to": None, "class": None}

    def finished(now: dict) -> dict:
        gaps = now["to"] - now["from"] + 1 - now["turns"] if now["turns"] else 0
        return {"conv_id": now["conv_id"], "gaps": gaps, **now["sums"], "audit": "".join(now["audit"]), "repaired_sha256": now["sha"].hexdigest()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out = []
            for start in range(0, batch.num_rows, 64):
                for row in batch.slice(start, 64).to_pylist():
                    if now is not None and row["conv_id"] != now["conv_id"]:
                        out.append(finished(now))
                        now = None
                    now = now or started(row["conv_id"])
                    for c in SUMS:
                        now["sums"][c] += row[c]
                    now["sums"]["illegal"] += now["class"] is not None and (now["class"], row["first_class"]) not in LEGAL
                    now["class"] = row["last_class"]
                    if row["turns"]:
                        now["turns"] += row["turns"] - (now["to"] == row["first_turn"])
                        now["from"] = row["first_turn"] if now["from"] is None else now["from"]
                        now["to"] = row["last_turn"]
                    now["audit"].append(row["audit"])
                    for turn in row["turns_text"]:
                        now["sha"].update((b"\n" if now["any"] else b"") + turn.encode())
                        now["any"] = True
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([finished(now)], schema=schema)

    return dealt.mapInArrow(run, AUDIT_SCHEMA)


def audits(repaired: DataFrame) -> DataFrame:
    """One row per conversation of `repair`: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256. Only conversations cut into several chunks are shuffled."""
    repaired = materialise(repaired, "conversation_repairs")
    gaps: Column = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).cast("long")
    alone = repaired.where("whole").select(
        "conv_id", gaps.alias("gaps"), *SUMS, "audit", F.sha2(F.array_join("turns_text", "\n"), 256).alias("repaired_sha256")
    )
    return alone.unionByName(_summed(repaired.where("NOT whole")))


def repair_report(conversations: DataFrame) -> DataFrame:
    """`audits` of `conversations` (conv_id, turn, role, text) after `damage`: one row per distinct
    conv_id, NULL included; one whose rows are all gone has zeros, no edits and the digest of an
    empty text. Other columns are ignored; an empty table gives an empty result."""
    every = conversations.select(F.col("conv_id").cast("long").alias("every_id")).distinct()
    found = audits(repair(damage(conversations)))
    joined = every.join(found, F.col("every_id").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(
        F.col("every_id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *SUMS)],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
