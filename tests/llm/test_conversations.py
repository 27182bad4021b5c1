"""Repaired conversations against a search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from paddock.llm import conversations, queries

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def cheapest(symbols: str, gone: str = "") -> tuple[int, str]:
    """Cost and audit by cheapest-first search; ``gone`` says per turn whether it has to be deleted."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(symbols) and state in ("", "a"):
            return cost, audit
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i < len(symbols):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if not gone or gone[i] == ".":
                cut = symbols[i].isupper()
                if (state, symbols[i].lower()) in NEXT:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, NEXT[state, symbols[i].lower()]))
                for char in "ua":
                    if (state, char) in NEXT:
                        heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, NEXT[state, char]))
        for char in "ua":
            if (state, char) in NEXT:
                heapq.heappush(heap, (cost + 2, audit + "I", i, NEXT[state, char]))
    raise AssertionError


def test_short_strings():
    for n in range(4):
        for symbols in map("".join, itertools.product("suaxSUAX", repeat=n)):
            want = cheapest(symbols)
            assert conversations.by_lengths(symbols) == want, symbols
            assert conversations.by_parity(symbols) == want, symbols


def test_long_strings():
    random.seed(3)
    for _ in range(150):
        symbols = "".join(random.choice("suauauauaxUAS") for _ in range(random.randint(4, 45)))
        assert conversations.by_lengths(symbols) == conversations.by_parity(symbols) == cheapest(symbols), symbols


def plain_audits(turns: list[tuple]) -> dict:
    """Damage and repair once more, in plain loops."""
    out = {}
    for conv in {t[0] for t in turns}:
        rows = []
        for _, turn, role, text in (t for t in turns if t[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if case == 0:
                continue
            text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
            row = (turn is not None, turn or 0, "user" if case == 4 else role, text)
            rows += [row, row] if case == 3 else [row]
        rows.sort()
        numbers = [r[1] for r in rows if r[0]]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        seen, symbols, faults = set(), "", ""
        for _, _, role, text in rows:
            visible = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "b" if not visible else "d" if (role, text) in seen else "t" if visible[-1] not in ".!?" else "."
            seen.add((role, text))
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            symbols += initial.upper() if fault == "t" else initial
            faults += fault
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit = cheapest(symbols, faults.replace("t", "."))
        length = len(audit) - audit.count("D")
        roles = (["s"] if length % 2 else []) + ["u", "a"] * (length // 2)
        lines, left = [], iter(rows)
        for letter in audit:
            row = next(left) if letter != "I" else None
            if letter != "D":
                char = roles[len(lines)]
                own = {"u": "user", "a": "assistant"}.get(char, "")
                lines.append(f"{row[2] if letter == 'K' else own}:{row[3] if row else ''}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        counts = [faults.count(f) for f in "bdt"]
        out[conv] = (gaps, *counts, illegal, cost, audit, digest)
    return out


def compared(turns, rows) -> None:
    want = plain_audits(turns)
    assert len(rows) == len(want)
    for r in rows:
        assert tuple(r)[1:] == want[r.conv_id], r


def test_query_on_whole_tables(spark):
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        turns = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        compared(turns, queries.conversation_query(spark, folder).collect())


def odd_turns() -> list[tuple]:
    random.seed(5)
    roles = ["user", "assistant", "system", "tool", "", " ", None, "u", "Assistant", "é"]
    texts = [None, "", " ", "\x0b\x0c", "Yes.", "Yes. \n", "no", "…", "ünd!", "Why?\x85", "x" * 3000, "a" * 40 + "1.", "a" * 40 + "0."]
    turns = [(c, random.choice([None, *range(6)]), random.choice(roles), random.choice(texts)) for c in range(80) for _ in range(8)]
    turns += [(None, k, "user", "A.") for k in range(5)] + [(900, None, None, None)] * 3
    turns += [(901, 7, "user", f"Same {k}.") for k in range(30)]
    return turns + [t for t in turns if t[0] == 3]


def test_odd_rows(spark):
    turns = odd_turns()
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    table = table.withColumn("key", F.lit(1)).withColumn("audit", F.lit("clash")).withColumn("digest", F.lit(None).cast("int"))
    compared(turns, conversations.damaged_audits(table).collect())
    assert conversations.damaged_audits(table.limit(0)).count() == 0
    assert conversations.repaired(table.limit(0)).count() == 0


@pytest.mark.parametrize("long", [256, 8])
def test_repaired_turns_and_long_conversations(spark, monkeypatch, long):
    random.seed(6)
    turns = [(1, k, random.choice(["user", "assistant"]), f"Turn {k}{random.choice('..,')}") for k in range(1500)]
    turns += [(2, k, "system", "Be kind.") for k in range(3)] + [(3, 0, "assistant", "Hello.")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(conversations, "LONG", long)
    summary = {r.conv_id: r for r in conversations.audits(table).collect()}
    assert summary[1].audit == conversations.by_parity("".join(r[0].upper() if t[-1] == "," else r[0] for c, _, r, t in turns if c == 1))[1]
    made: dict[int, list] = {}
    for r in conversations.repaired(table).orderBy("conv_id", "place").collect():
        made.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, row in summary.items():
        lines = made.get(conv, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == row.repaired_sha256
