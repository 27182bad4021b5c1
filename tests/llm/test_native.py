"""Licence scan, decontamination and quality rules against brute force, and their plans."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from paddock.llm import decontamination, licences, quality_rules

FOLDER = "/root/testdata/sf0.001"


def shown(rows) -> list[tuple]:
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=str)


def in_duckdb(sql: str, **tables) -> list[tuple]:
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows.toArrow())
    return con.execute(sql).fetchall()


def licence_docs(spark):
    texts = [None, "", "MIT", "prose\nReleased under the MIT License.\nmore", "released under  the *MIT* license", "Released under\nthe MIT License."]
    texts += ["a b c\n\n" + licences.TEMPLATES["MIT"][2].replace(",", ",\n") + "\n\nend " + "word " * 300]
    texts += ["Licensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", "x y " * 50_000]
    texts += [t for k in licences.TEMPLATES.values() for t in k]
    rows = [(None if k == 3 else k // 2, t) for k, t in enumerate(texts)]
    rows += [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_licences(spark):
    docs = licence_docs(spark)
    got = licences.scan(docs.withColumn("units", F.lit("clash")).withColumn("found", F.lit(1)))
    assert shown(got.collect()) == shown(in_duckdb(licences.oracle_sql(), documents=docs))
    found = {(r.doc_id, r.licence) for r in got.collect()}
    assert {(None, "MIT"), (2, "MIT"), (3, "MIT"), (3, "CC-BY-NC-4.0")} <= found
    assert licences.scan(docs.limit(0)).count() == 0


def test_licences_within_lines(spark):
    prose = " ".join(f"word{k} of{k}" for k in range(160)) + " "
    mit, bsd = licences.TEMPLATES["MIT"][2], licences.TEMPLATES["BSD-3-Clause"][1]
    texts = ["Copyright (c) 2020 Jane Doe. Released under the MIT License.", prose + mit + " " + prose, prose + bsd + prose + bsd]
    texts += [f"Released under the MIT License.\n{prose} licensed under the MIT License. {prose}", prose, "under the License of the sea " * 50]
    rows = licences.scan(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    assert shown(rows) == shown([(0, "MIT", 1.0, 1), (1, "MIT", 1.0, 1), (2, "BSD-3-Clause", 1.0, 1), (3, "MIT", 1.0, 2)])


def contaminated(spark):
    random.seed(6)
    word = lambda: random.choice(["der", "Und", "zoo", "é", "kap", "lim"]) + str(random.randint(0, 400))
    items = [" ".join(word() for _ in range(n)) for n in (5, 6, 9, 17, 33, 60, 64)] + [None, "", "two words", "four words are few", "a b c d a b c d a b c d"]
    docs = [None, "", "two words", "Two, words!", "here are two words more", "four words are few", "a b c d " * 20]
    for item in items[:7]:
        own = (item or "").split()
        for kept in (1.0, 0.9, 0.8, 0.6):
            part = own.copy()
            for k in range(round(len(own) * (1 - kept))):
                part[len(own) - 1 - k] = "other"
            docs.append(" ".join(word() for _ in range(400)) + ", " + ",\n".join(part).upper() + " " + " ".join(word() for _ in range(random.choice([3, 4000]))))
    docs += [docs[8], docs[8]]
    rows = [(None if k % 9 == 8 else k // 2, t) for k, t in enumerate(docs)]
    bench = [(None if k == 2 else k // 2, t) for k, t in enumerate(items)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_decontamination(spark, broadcast):
    docs, bench = contaminated(spark)
    odd = docs.withColumn("item", F.lit("clash")).withColumn("hash", F.lit(1)).withColumn("contaminated_text", F.lit(2))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = decontamination.matches(odd, bench.withColumn("n", F.lit(0))).collect()
        clean = decontamination.without_contaminated(odd, bench)
        left = clean.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = in_duckdb(decontamination.oracle_sql(), documents=docs, benchmark=bench)
    assert len(want) > 15
    assert shown(got) == shown(want)
    assert clean.columns == odd.columns
    assert all((r.text or "") in ("", "here are two words more") or len(r.text) > 1000 for r in left)
    assert decontamination.matches(docs.limit(0), bench).count() == decontamination.matches(docs, bench.limit(0)).count() == 0


def plain_statistics(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(hit)


def plain_verdicts(rows: list[tuple]) -> list[tuple]:
    """(doc_id, *statistics, base_failed, kept), by numpy."""
    least = np.array([floor for _, floor in quality_rules.VECTOR.values()])
    found = [plain_statistics(t) for _, _, _, t in rows]
    failed = [w < 50 or 100 * r > 50 * w for w, *_, r in found]
    vector = lambda w, c, s, n, d, r: [math.log(w), math.log(c / w), math.log1p(100 * s / c), d / max(n, 1), r / w]
    counts = Counter((g or "", s or "") for (_, g, s, _), f in zip(rows, failed, strict=True) if not f)
    small = Counter()
    for (lang, _), n in counts.items():
        small[lang] += n if n < 100 else 0
    key = lambda g, s: (g, s) if counts[g, s] >= 100 else (g,) if small[g] >= 100 else ()
    groups: dict[tuple, list[int]] = {}
    for k, (_, lang, source, _) in enumerate(rows):
        if not failed[k]:
            groups.setdefault(key(lang or "", source or ""), []).append(k)
    kept = [not f for f in failed]
    for members in groups.values():
        if len(members) < 100:
            continue
        x = np.array([vector(*found[k]) for k in members])
        low = lambda v, q, axis=0: np.sort(v, axis)[math.ceil(q * len(v)) - 1]
        center = low(x, 0.5)
        cov = np.diag((1.4826 * low(np.abs(x - center), 0.5)) ** 2 + least**2)
        for step in range(4):
            d = np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(cov), x - center)
            if step < 3:
                near = x[d <= low(d, 0.75) + 1e-12]
                center, cov = near.mean(0), np.cov(near.T, bias=True) * quality_rules.CONSISTENCY + np.diag(least**2)
        for k, far in zip(members, d > quality_rules.CUT, strict=True):
            kept[k] = not far
    return [(r[0], f[0], f[1], f[2], f[4], f[5], b, k) for r, f, b, k in zip(rows, found, failed, kept, strict=True)]


def test_quality_rules(spark):
    random.seed(9)
    rows = [(None, None, None, None), (1, "en", None, ""), (2, "en", "s", " \x0b\n"), (3, "xx", "s", "one " * 60), (4, "xx", "a", "é€ " * 49), (5, "en", "s", "#" * 400 + " a" * 60)]
    word = lambda: "".join(random.choice("abcdefgé") for _ in range(random.randint(2, 8)))
    for k in range(900):
        lines = [" ".join(word() for _ in range(random.randint(4, 14))) for _ in range(random.randint(9, 30))]
        if k % 60 == 0:
            lines = ["$$$###%%% " + " ".join("|<" * 9 for _ in range(12)) + word() for _ in range(9)]
        if k % 60 == 1:
            lines = ["x" * 60 + word() for _ in range(60)]
        if k % 7 == 0:
            lines.append(lines[0])
        rows.append((k % 800, random.choice(["en", "en", "fr", None]), random.choice(["a", "a", "a", "b", "c"]) if k % 5 else f"rare{k}", "\n".join(lines)))
    rows += rows[20:22]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").withColumn("group", F.lit("clash"))
    got = quality_rules.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got = shown(got.collect())
    want = shown(plain_verdicts(rows))
    assert got == want
    assert sum(not r[-1] for r in got) > 20
    assert quality_rules.judged(docs.limit(0)).count() == 0


def quality_docs(spark, n: int, odd: list[tuple], sources=("s",)):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 8)))
    line = lambda: " ".join(word() for _ in range(draw.randint(6, 14)))
    rows = [(k, "en", sources[k % len(sources)], "\n".join(line() for _ in range(draw.randint(10, 30)))) for k in range(n)]
    return spark.createDataFrame(rows + odd, "doc_id long, lang string, source string, text string"), line


def test_unusual_in_its_group(spark):
    _, line = quality_docs(spark, 0, [(0, "", "", "")])
    short = [" ".join(line().split()[:2]) for _ in range(3)]
    lines = [line() for _ in range(20)]
    half_lines = "\n".join([*lines, *[short[k % 3] for k in range(30)]])
    half_words = " ".join(line() for _ in range(12)) + 2 * (" " + " ".join(lines[:2]))
    docs, _ = quality_docs(spark, 400, [(-1, "en", "s", half_lines), (-2, "en", "s", half_words)])
    got = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    assert not got[-1].base_failed and not got[-1].kept
    assert not got[-2].base_failed and not got[-2].kept
    assert sum(r.kept for k, r in got.items() if k >= 0) >= 390


def test_chi2():
    assert abs(quality_rules.chi2_quantile(0.95, 5) - 11.0705) < 1e-3


def test_native_plans(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    for rows in (licences.scan(docs), decontamination.matches(docs, bench), quality_rules.judged(docs)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)
