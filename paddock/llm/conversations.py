"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

The roles' initials are to read as one of the strings that ``(s?(ua)+)?`` allows: one string for each length but 1. For each
feasible length the turns are aligned with that string by Wagner and Fischer's table: a turn is kept where its role fits (0),
gets another role (2) or is deleted (3), a turn without text is inserted (2); a truncated turn that stays costs 1 more, a
blank or repeated one has to go. Lengths are tried in the order of the least cost that their distance allows. The cheapest
alignment so far, the incumbent, bounds how far a path may leave the diagonal (Ukkonen's band), and ends the search where
distance alone costs more. Each table gives its least audit, the string of the edits' initials, by tracing back among
the cheapest choices the first letter in ASCII order; of the lengths' audits the cheapest, then the least, counts.

Turns that have to go are taken out first: D precedes every other letter, so the least audit deletes them as soon as they come.

A table grows with the square of a conversation's turns. From ``LONG`` live turns on, all lengths of one parity share their
cells, as what is left of their strings is the same: one linear table, the same audits.

Spark sorts each turn twice into its conversation's partition, first without its text, then with it. A task reads the first kind
to find the audit, then streams the second kind into the digest and the repaired turns, so it holds no texts: per turn of one
conversation it holds a symbol and 16 bytes of digest. Large conversations are sorted on disk by Spark, never held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: Neighbouring initials that a sound conversation may have.
PAIRS = ("su", "ua", "au")
#: Live turns from which the lengths of one parity share their cells.
LONG = 256
#: Symbol strings whose audits a task keeps.
KEPT_AUDITS = 100_000
NO_SPACE = r"[^\x20\x09-\x0D]"

# A live turn's symbol: its initial if it is s, u or a, else "x"; upper case if it is truncated.


def _leaving(turns: int, chars: int, truncated: int) -> int:
    """The least cost of aligning so many turns with so many characters, beside the 1 of each truncated turn."""
    more = turns - chars
    return DELETE * more - min(more, truncated) * TRUNCATED if more > 0 else -INSERT * more


def target(length: int) -> str:
    """The grammar's string of this length; there is none of length 1."""
    return "s" * (length % 2) + "ua" * (length // 2)


def _step_costs(symbol: str, char: str) -> tuple[int | None, int | None]:
    """(keep, rerole) of a turn that meets a character, None where that can't be."""
    more = TRUNCATED if symbol.isupper() else 0
    return (KEEP + more if symbol.lower() == char else None), (REROLE + more if char in ROLES else None)


def align(symbols: str, string: str, most: int) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest alignment of live turns with a string, if it costs ``most`` at the utmost.

    ``table[i][j]`` is the cost of what follows the first i turns and j characters. Cells from which or to which distance alone costs
    too much are left out.
    """
    n, m = len(symbols), len(string)
    truncated = sum(s.isupper() for s in symbols)
    far = 1 << 60
    table: list[dict[int, int]] = [{} for _ in range(n + 1)]
    spare = most - truncated * TRUNCATED
    for i in range(n, -1, -1):
        row, below = table[i], table[i + 1] if i < n else {}
        # i - j may be at most what deletions, and at least what insertions, leave of the incumbent's cost
        low = max(0, i - max(spare, 0) // (DELETE - TRUNCATED) - 1)
        high = min(m, i + max(spare, 0) // INSERT + 1)
        for j in range(high, low - 1, -1):
            if _leaving(i, j, truncated) + _leaving(n - i, m - j, truncated) > spare:
                continue
            best = 0 if i == n and j == m else far
            if i < n:
                best = min(best, DELETE + below.get(j, far))
                if j < m:
                    after = below.get(j + 1, far)
                    for cost in _step_costs(symbols[i], string[j]):
                        if cost is not None:
                            best = min(best, cost + after)
            if j < m and string[j] in ROLES:
                best = min(best, INSERT + row.get(j + 1, far))
            if best < far:
                row[j] = best
    total = table[0].get(0, far)
    if total > most:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:
        left = table[i][j]
        below = table[i + 1] if i < n else {}
        keep, rerole = _step_costs(symbols[i], string[j]) if i < n and j < m else (None, None)
        if i < n and left == DELETE + below.get(j, far):
            letter, i = "D", i + 1
        elif j < m and string[j] in ROLES and left == INSERT + table[i].get(j + 1, far):
            letter, j = "I", j + 1
        elif keep is not None and left == keep + below.get(j + 1, far):
            letter, i, j = "K", i + 1, j + 1
        else:
            assert rerole is not None
            letter, i, j = "R", i + 1, j + 1
        audit.append(letter)
    return total, "".join(audit)


def by_lengths(symbols: str) -> tuple[int, str]:
    """Cost and audit of live turns, by the strings of all feasible lengths."""
    n = len(symbols)
    truncated = sum(s.isupper() for s in symbols)
    bounds = sorted((_leaving(n, m, truncated), m) for m in range(2 * n + 3) if m != 1)  # emptying costs less than a longer one
    most = DELETE * n
    best: tuple[int, str] | None = None
    for bound, m in bounds:
        if bound + truncated * TRUNCATED > most:
            break
        found = align(symbols, target(m), most)
        if found is not None and (best is None or found < best):
            best, most = found, found[0]
    assert best is not None  # deleting all turns is an alignment with the empty string
    return best


def by_parity(symbols: str) -> tuple[int, str]:
    """The same in one linear table: what is left of a string is its next character, as its length doesn't matter.

    States: ``b`` before the first character, ``u`` and ``a`` where that character is next; ends are allowed in ``b`` and ``u``, but
    not behind a lone s, which is state ``f``, where a first u is next.
    """
    far = 1 << 60
    n = len(symbols)
    after = {"u": "a", "a": "u", "f": "a"}
    table: list[dict[str, int]] = [{}] * (n + 1)

    def choices(i: int, state: str) -> Iterator[tuple[str, int, int, str]]:
        """(letter, cost, next turn, next state), letters in ASCII order; before the first character also an s may be kept."""
        nexts = {"b": "u", "f": "u"}.get(state, state)
        if i < n:
            yield "D", DELETE, i + 1, state
        to = "a" if state == "b" else after[state]
        yield "I", INSERT, i, to
        if i < n:
            if state == "b" and symbols[i].lower() == "s":
                yield "K", TRUNCATED * symbols[i].isupper(), i + 1, "f"
            keep, rerole = _step_costs(symbols[i], nexts)
            if keep is not None:
                yield "K", keep, i + 1, to
            if rerole is not None:
                yield "R", rerole, i + 1, to

    for i in range(n, -1, -1):
        row = dict.fromkeys("bfua", far)
        table[i] = row
        if i == n:
            row["b"] = row["u"] = 0
        for _ in range(2):  # an insertion leads to another state of the same turn; two in a row come back
            for state in "aufb":
                row[state] = min([row[state], *(cost + table[k].get(to, far) for _, cost, k, to in choices(i, state))])
    audit, i, state = [], 0, "b"
    while not (i == n and table[i][state] == 0):
        letter, _, i, state = next(c for c in choices(i, state) if c[1] + table[c[2]][c[3]] == table[i][state])
        audit.append(letter)
    return table[0]["b"], "".join(audit)


@dataclass
class Conversation:
    """What is known of a conversation after its turns were read without texts."""

    gaps: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    cost: int = 0
    audit: str = ""
    written: int = 0
    digest: "hashlib._Hash" = field(default_factory=hashlib.sha256)


class Reader:
    """Turns of one conversation without their texts, in order: symbols, faults and digests as bytes."""

    def __init__(self) -> None:
        self.initials = bytearray()  # 0 for none, as of an empty role
        self.faults = bytearray()  # b blank, t truncated, . neither
        self.digests = bytearray()
        self.least: int | None = None
        self.greatest: int | None = None
        self.turns = 0

    def add(self, turn: int | None, initial: str, fault: str, digest: bytes) -> None:
        self.initials.append(ord(initial) if initial in ("s", "u", "a") else ord("x"))
        self.faults.append(ord(fault))
        self.digests += digest
        if turn is not None:
            if self.greatest is None:
                self.least = turn
            self.turns += turn != self.greatest
            self.greatest = turn

    def duplicates(self) -> np.ndarray:
        """Whether a turn's role and text stood in the conversation before."""
        if len(self.faults) < 1000:
            seen: set[bytes] = set()
            again = np.zeros(len(self.faults), bool)
            for k in range(again.size):
                one = bytes(self.digests[16 * k : 16 * k + 16])
                again[k] = one in seen
                seen.add(one)
            return again
        halves = np.frombuffer(bytes(self.digests), "<u8").reshape(-1, 2)
        order = np.lexsort((halves[:, 0], halves[:, 1]))  # stable: equal ones stay in order
        again = np.zeros(order.size, bool)
        again[order[1:]] = (halves[order[1:]] == halves[order[:-1]]).all(axis=1)
        return again

    def result(self, audits: Callable[[str], tuple[int, str]]) -> Conversation:
        faults = np.frombuffer(bytes(self.faults), "S1")
        blank = faults == b"b"
        duplicate = ~blank & self.duplicates()
        gone = blank | duplicate
        truncated = ~gone & (faults == b"t")
        out = Conversation(0, int(blank.sum()), int(duplicate.sum()), int(truncated.sum()))
        if self.greatest is not None and self.least is not None:
            out.gaps = self.greatest - self.least + 1 - self.turns
        initials = self.initials.decode()
        out.illegal = sum(initials[k : k + 2] not in PAIRS for k in range(len(initials) - 1))
        live = "".join(
            c.upper() if cut else c for c, cut, left in zip(initials, truncated.tolist(), gone.tolist(), strict=True) if not left
        )
        cost, audit = audits(live)
        out.cost = cost + DELETE * int(gone.sum())
        out.audit = _with_deletions(audit, gone)
        # odd lengths begin with s, so the character that each turn or insertion stands for follows
        out.written = len(out.audit) - out.audit.count("D")
        return out


def _with_deletions(audit: str, gone: np.ndarray) -> str:
    """The audit of live turns with a D for each turn that has to go, as soon as it comes."""
    out, k, flags = [], 0, gone.tolist()

    def skip() -> None:
        nonlocal k
        while k < len(flags) and flags[k]:
            out.append("D")
            k += 1

    skip()
    for letter in audit:
        out.append(letter)
        if letter != "I":
            k += 1
            skip()
    return "".join(out)


class Writer:
    """Turns of one conversation with their texts, in order: the repaired ones."""

    def __init__(self, found: Conversation) -> None:
        self.found = found
        self.at = 0  # in the audit
        self.place = 0  # among the repaired turns

    def _next(self, role: str, text: str) -> tuple[int, str, str]:
        line = f"{role}:{text}"
        self.found.digest.update((("\n" if self.place else "") + line).encode("utf-8", "surrogatepass"))
        self.place += 1
        return self.place - 1, role, text

    def _char(self) -> str:
        return "s" if self.found.written % 2 and self.place == 0 else "ua"[(self.place - self.found.written % 2) % 2]

    def inserted(self) -> Iterator[tuple[int, str, str]]:
        """The turns that are inserted before the next one of the conversation."""
        while self.at < len(self.found.audit) and self.found.audit[self.at] == "I":
            self.at += 1
            yield self._next(ROLES[self._char()], "")

    def turn(self, role: str, text: str) -> Iterator[tuple[int, str, str]]:
        yield from self.inserted()
        letter = self.found.audit[self.at]
        self.at += 1
        if letter == "K":
            yield self._next(role, text)
        elif letter == "R":
            yield self._next(ROLES[self._char()], text)


def _remembered() -> Callable[[str], tuple[int, str]]:
    known: dict[str, tuple[int, str]] = {}

    def audits(symbols: str) -> tuple[int, str]:
        if len(symbols) >= LONG:
            return by_parity(symbols)
        if symbols not in known:
            if len(known) >= KEPT_AUDITS:
                known.clear()
            known[symbols] = by_lengths(symbols)
        return known[symbols]

    return audits


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Conversation | None, tuple[int, str, str] | None]]:
    """(conv_id, None, repaired turn) for each repaired turn, then (conv_id, conversation, None), for sorted rows of both kinds."""
    audits = _remembered()
    key: object = None
    conv_id: object = None
    reader, writer = Reader(), None

    def end() -> Iterator[tuple[object, Conversation | None, tuple[int, str, str] | None]]:
        if writer is not None:
            for turn in writer.inserted():
                yield conv_id, None, turn
            yield conv_id, writer.found, None

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "conv_id", "with_text", "turn", "role", "fault", "digest", "text")]
        for group, own_id, with_text, turn, role, fault, digest, text in zip(*columns, strict=True):
            if group != key:
                yield from end()
                key, conv_id, reader, writer = group, own_id, Reader(), None
            if not with_text:
                reader.add(turn, role[:1], fault, digest)
                continue
            if writer is None:
                writer = Writer(reader.result(audits))
            for made in writer.turn(role, text):
                yield conv_id, None, made
    yield from end()


def _sorted_twice(turns: DataFrame) -> DataFrame:
    """Each turn without and with its text, conversations one after the other, first the turns without."""
    key = F.concat(F.when(F.col("conv_id").isNull(), "n").otherwise("v"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    last = F.regexp_extract("text", rf"({NO_SPACE})[\x20\x09-\x0D]*\z", 1)
    rows = turns.select(key.alias("key"), "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    fault = F.when(last == "", "b").when(F.translate(last, ".!?", "") != "", "t").otherwise(".")
    digest = F.unhex(F.md5(F.concat_ws(":", F.length("role"), "role", "text")))
    rows = rows.select("*", fault.alias("fault"), digest.alias("digest"), F.substring("text", 1, 32).alias("head"))
    twice = rows.withColumn("with_text", F.explode(F.array(F.lit(False), F.lit(True))))
    twice = twice.withColumn("text", F.when(F.col("with_text"), F.col("text")))
    spread = twice.repartition("key").sortWithinPartitions("key", "with_text", F.col("turn").asc_nulls_first(), "role", "head", "digest")
    return spread.select("key", "conv_id", "with_text", "turn", "role", "fault", "digest", "text")


def audits(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per conversation that has turns.

    A turn has a conv_id, a turn number, a role and a text; other columns aren't read. Turns come by number, nulls first; equal
    numbers by role, then by text (its first 32 characters, then a digest). A null role or text is one space, so such a text is blank
    and such a role none of the grammar's; so is an empty role. Turns without conv_id are one conversation. Repeated rows are
    turns, all but the first of which are duplicates. An empty table gives no rows.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for conv_id, found, _ in _streamed(batches):
            if found is not None:
                numbers = (found.gaps, found.blank, found.duplicate, found.truncated, found.illegal, found.cost)
                rows.append((conv_id, *numbers, found.audit, found.digest.hexdigest()))
            if len(rows) >= 5000:
                yield _batch(rows, schema)
                rows = []
        yield _batch(rows, schema)

    ids = turns.schema["conv_id"].dataType
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    kinds = [f"conv_id {ids.simpleString()}", *(f"{c} long" for c in numbers), "audit string", "repaired_sha256 string"]
    schema = _arrow(turns, numbers, ("audit", "repaired_sha256"))
    return _sorted_twice(turns).mapInArrow(task, ", ".join(kinds))


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, place, role, text: the repaired turns, numbered from 0. Rows, nulls and ties as in ``audits``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for conv_id, _, turn in _streamed(batches):
            if turn is not None:
                rows.append((conv_id, *turn))
            if len(rows) >= 5000:
                yield _batch(rows, schema)
                rows = []
        yield _batch(rows, schema)

    ids = turns.schema["conv_id"].dataType
    schema = _arrow(turns, ("place",), ("role", "text"))
    return _sorted_twice(turns).mapInArrow(task, f"conv_id {ids.simpleString()}, place long, role string, text string")


def _arrow(turns: DataFrame, numbers: tuple[str, ...], texts: tuple[str, ...]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    ids = pa.field("conv_id", to_arrow_type(turns.schema["conv_id"].dataType))
    return pa.schema([ids, *(pa.field(c, pa.int64()) for c in numbers), *(pa.field(c, pa.string()) for c in texts)])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with known faults, by the CRC-32 of conversation and turn; nulls but in the numbers are one space."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    case = (F.crc32(name) % 20).alias("case")
    role, text = (F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role, text, case).where("case != 0")
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("case") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("case") == 3, 2).otherwise(1))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def damaged_audits(turns: DataFrame) -> DataFrame:
    """``audits`` of the damaged turns, for every conversation of ``turns``: zeros and empty texts where no turn is left."""
    ids = turns.select("conv_id").distinct().withColumn("present", F.lit(1))
    found = audits(damaged(turns))
    one = found.withColumnRenamed("conv_id", "own")
    joined = ids.join(one, ids["conv_id"].eqNullSafe(one["own"]), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256().hexdigest()
    return joined.select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")
    )
