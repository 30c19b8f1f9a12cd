"""Conversation repair against a search over all edits, and the block tables against it."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from boutline.llm import conversations as C

WORD = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}  # states: start, after s, after u, after a
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def cheapest(rows):
    """Least (cost, edits) for rows of (must go, role initial, truncated), from the end."""

    def with_inserts(best):
        best = dict(best)
        for _ in range(4):
            for q in range(4):
                if NEXT[q] in best:
                    cost, edits = best[NEXT[q]]
                    best[q] = min(best.get(q, (10**9, "")), (cost + 2, "I" + edits))
        return best

    best = with_inserts({0: (0, ""), 3: (0, "")})
    for must_go, initial, truncated in reversed(rows):
        new = {}
        for q in range(4):
            options = [(best[q][0] + 3, "D" + best[q][1])]
            if not must_go:
                kept = KEPT.get((q, initial))
                if kept is not None:
                    options.append((best[kept][0] + truncated, "K" + best[kept][1]))
                options.append((best[NEXT[q]][0] + 2 + truncated, "R" + best[NEXT[q]][1]))
            new[q] = min(options)
        best = with_inserts(new)
    return best[0]


def report(table):
    conv, out = defaultdict(list), []
    ids = {row[0] for row in table}
    for c, t, role, text in table:
        role, text = (" " if v is None else v for v in (role, text))
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        conv[c] += [(t, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    for c in ids:
        rows = sorted(conv[c], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, symbols, faults = set(), [], {"b": 0, "d": 0, "t": 0, "": 0}
        for _, role, text in rows:
            said = WORD.findall(text)
            fault = "b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else ""
            faults[fault] += 1
            seen.add((role, text))
            symbols.append((fault in ("b", "d"), role[:1], int(fault == "t")))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, edits = cheapest(symbols)
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        state, at, shown, names = 0, 0, [], {2: "user", 3: "assistant"}
        for letter in edits:
            if letter == "D":
                at += 1
                continue
            state = KEPT[state, rows[at][1][:1]] if letter == "K" else NEXT[state]
            shown.append(f"{rows[at][1] if letter == 'K' else names[state]}:{'' if letter == 'I' else rows[at][2]}")
            at += letter != "I"
        digest = hashlib.sha256("\n".join(shown).encode()).hexdigest()
        out.append((c, gaps, faults["b"], faults["d"], faults["t"], illegal, cost, edits, digest))
    return sorted(out, key=str)


def rows_of(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def symbol(must_go, initial, truncated):
    return C.GONE if must_go else C.CLASSES.get(initial, 3) + 4 * truncated


def test_edits_are_the_cheapest_and_the_least():
    rng = random.Random(1)
    for _ in range(3000):
        rows = [(rng.random() < 0.2, rng.choice("suaux"), int(rng.random() < 0.3)) for _ in range(rng.randrange(0, 14))]
        edits, state = C.trace(bytes(symbol(*r) for r in rows))
        assert edits + C.closing(state) == cheapest(rows)[1]


def test_chunks_as_functions_give_the_same_edits():
    rng = random.Random(2)
    for _ in range(300):
        rows = [(rng.random() < 0.2, rng.choice("suaux"), int(rng.random() < 0.3)) for _ in range(rng.randrange(1, 40))]
        symbols, cut = bytes(symbol(*r) for r in rows), rng.randrange(0, len(rows))
        first, second = symbols[:cut], symbols[cut:]
        entry, _ = C.summary(second)
        behind = entry[0]
        _, leaves = C.summary(first)
        edits, state = C.trace(first, behind)
        assert state == leaves[4 * behind + C.NONE]
        more, last = C.trace(second, 0, state)
        assert edits + more + C.closing(last) == cheapest(rows)[1]


@pytest.fixture(scope="module")
def odd_rows():
    """NULLs in every column, blank and odd roles, ties of turns, repeated rows, one long conversation."""
    rng = random.Random(3)
    texts = ["Hi.", "ok", "", " \n", None, "x!  ", "é中", "y\n", "p? "]
    rows = []
    for c in [*range(120), None]:
        for t in range(900 if c in (7, None) else rng.choice([1, 2, 3, 8, 30])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, " ", "user2"])
            rows.append((c, rng.choice([t, t, t, t + 5, None]), role, rng.choice([*texts, f"q{rng.random()}.", f"r{rng.random()}"])))
    return rows + [(7, 3, "user", "same.")] * 3000 + [(200, 1, "user", "long " * 400_000), (201, 4, "user", "a.")]


def test_report_equals_brute_force(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_ROWS", 128)
    df = spark.createDataFrame(odd_rows, "conv_id long, turn long, role string, text string")
    clashing = df.selectExpr("*", "turn AS key", "conv_id AS copies", "role AS part", "text AS symbols", "turn AS seq")
    assert rows_of(C.repair_report(clashing)) == report(odd_rows)
    assert C.repair_report(df.limit(0)).collect() == []


def test_a_conversation_whose_rows_are_all_dropped(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = C.repair_report(spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")).first()
    assert (row.conv_id, row.cost, row.audit, row.repaired_sha256) == (gone, 0, "", hashlib.sha256(b"").hexdigest())


def test_whole_table_equals_brute_force(spark):
    from boutline.llm.queries import QUERIES

    from .conftest import SF

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op11_repair_conversations"](spark, SF)) == report(rows)
