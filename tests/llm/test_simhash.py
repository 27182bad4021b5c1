"""Fingerprints, links and components against brute force."""

from __future__ import annotations

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from paddock.llm import components, simhash


def plain_fingerprint(text: str | None, k: int = 3) -> int:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values: list[int], max_bits: int) -> dict[int, int]:
    root = {v: v for v in values}

    def find(v: int) -> int:
        while root[v] != v:
            v = root[v]
        return v

    for a in root:
        for b in root:
            if a < b and (a ^ b).bit_count() <= max_bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in root}


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize(("max_bits", "cell_rows"), [(2, 512), (2, 1), (3, 1), (1, 512)])
def test_links_lose_no_pair(spark, max_bits, cell_rows):
    random.seed(max_bits)
    values = [random.getrandbits(64) for _ in range(40)]
    for base in values[:12]:
        chain = base
        for _ in range(12):
            for bit in random.sample(range(64), random.randint(1, 3)):
                chain ^= 1 << bit
            values.append(chain)
    rows = spark.createDataFrame([(signed(v),) for v in values], "fingerprint long")
    found = components.components(simhash.links(rows, max_bits, cell_rows)).collect()
    groups: dict[int, set[int]] = {}
    for r in found:
        groups.setdefault(r.root, set()).add(r.node)
    want: dict[int, set[int]] = {}
    for v, root in plain_components(values, max_bits).items():
        want.setdefault(root, set()).add(signed(v))
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def texts() -> list[str | None]:
    random.seed(4)
    out: list[str | None] = [None, "", " \t\n", "one", "One", "one two", "É é", "é é", "x" * 5000, "A b C d", "a\x0bb c\x0cd"]
    for _ in range(12):
        words = [random.choice(["foo", "Bar", "baz,", "qüx", "zed"]) + str(random.randint(0, 99)) for _ in range(random.randint(80, 300))]
        out += [" ".join(words), "\n".join(words)]
        for _ in range(4):
            words[random.randrange(len(words))] = "new"
            out.append(" ".join(words))
    return out


def test_documents(spark):
    cases = texts()
    ids = [None if k in (3, 4) else 1000 - k // 2 for k in range(len(cases))]
    docs = spark.createDataFrame(list(zip(ids, cases, strict=True)), "doc_id long, text string")
    docs = docs.withColumn("fingerprint", F.lit("clash")).withColumn("root", F.lit(0))
    got = sorted(map(tuple, simhash.near_duplicate_ids(docs).collect()), key=str)
    marks = [plain_fingerprint(t) for t in cases]
    roots = plain_components(marks, 2)
    least: dict[int, int | None] = {}
    for k, v in zip(ids, marks, strict=True):
        known = [x for x in (least.get(roots[v]), k) if x is not None]
        least[roots[v]] = min(known, default=None)
    assert got == sorted(((k, f"{v:016x}", least[roots[v]]) for k, v in zip(ids, marks, strict=True)), key=str)

    kept = simhash.without_near_duplicates(docs).collect()
    assert sorted(r.doc_id or 0 for r in kept) == sorted(k or 0 for k in least.values())
    assert kept[0].asDict().keys() == {"doc_id", "text", "fingerprint", "root"}
    assert simhash.near_duplicate_ids(docs.limit(0)).count() == 0


def test_the_least_of_rows_equal_in_id_and_text_stays(spark):
    rows = [(1, "some words of a text", k % 7, f"source {k}") for k in range(40, 2, -1)] + [(2, None, 5, "b"), (2, "", 5, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, source string")
    want = [(1, "some words of a text", 0, "source 14"), (2, None, 5, "b")]
    for parts in (1, 7):
        assert sorted(map(tuple, simhash.without_near_duplicates(docs.repartition(parts)).collect())) == want
    maps = docs.withColumn("extra", F.create_map("source", "n"))
    assert simhash.without_near_duplicates(maps).count() == 2
