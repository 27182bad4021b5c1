"""Benchmark decontamination: short test items found inside long documents by MinHash containment search.

Items are partitioned by their number of shingles, each partition twice as large as the one before. Containment of at least
``similarity`` leaves at most a fixed number of an item's shingles outside a document; so among the least hashes of the
item, one more than that number, at least one is the document's. Each partition's sketch is as long as its largest item
needs, so the search loses nothing, however long the document. Documents are probed with those of their shingle hashes
that are at most as large as the largest in any sketch. What is found is verified by counting shingles, as strings.

All of it is DataFrame functions. Documents are told apart by the MD5 of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm import words

SHINGLE = 5
#: Containment as a fraction, so that thresholds are whole numbers.
SIMILARITY = (4, 5)


def _shingles(normal: str, width: int, hashed: bool) -> Column:
    """Distinct shingles of a normalised text column, as strings or hashes; a shorter text is one shingle.

    So an item of fewer words than a shingle is found in texts of the same words only, not inside a longer one.
    """
    some = ", ".join(f"get(w, i + {k})" for k in range(width))
    one = f"xxhash64({some})" if hashed else f"concat_ws(' ', {some})"
    kind = "bigint" if hashed else "string"
    return F.expr(
        f"array_distinct(aggregate(array(if({normal} = '', cast(array() as array<string>), split({normal}, ' '))), "
        f"cast(array() as array<{kind}>), (a, w) -> if(size(w) = 0, a, "
        f"transform(sequence(0, greatest(size(w) - {width}, 0)), i -> {one}))))"
    )


def _text_id() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


def _needed(n: Column, similarity: tuple[int, int]) -> Column:
    """Shingles that a document needs of an item's n."""
    return F.ceil(n * similarity[0] / F.lit(similarity[1])).cast("int")


def sketches(benchmark: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """hash, item of each partition's sketches: the least hashes of each item."""
    items = benchmark.select(_text_id().alias("item"), words.normalised(F.col("text")).alias("normal")).distinct()
    items = items.select("item", F.array_sort(_shingles("normal", width, True)).alias("hashes")).where("size(hashes) > 0")
    partition = F.floor(F.log2(F.size("hashes")))
    largest = (F.pow(F.lit(2), partition + 1) - 1).cast("int")
    length = largest - _needed(largest, similarity) + 1
    return items.select("item", F.explode(F.slice("hashes", F.lit(1), length)).alias("hash"))


def contained(docs: DataFrame, benchmark: DataFrame, width: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """text_id, item, n_shingles, n_contained: the items whose shingles a text has to the given part at least."""
    sketch = sketches(benchmark, width, similarity)
    highest = F.lit(sketch.agg(F.max("hash")).first()[0]).cast("long")  # one number, null without items
    texts = docs.select(_text_id().alias("text_id"), words.normalised(F.col("text")).alias("normal"))
    own = _shingles("normal", width, True)
    probes = texts.select("text_id", F.explode(F.filter(own, lambda h: h <= highest)).alias("hash"))
    candidates = probes.join(sketch, "hash").select("text_id", "item").distinct()

    items = benchmark.select(_text_id().alias("item"), words.normalised(F.col("text")).alias("normal")).distinct()
    items = items.select("item", _shingles("normal", width, False).alias("all"))
    items = items.select("item", F.size("all").alias("n_shingles"), F.explode("all").alias("shingle"))
    suspects = texts.join(candidates.select("text_id").distinct(), "text_id", "left_semi")
    suspects = suspects.groupBy("text_id").agg(F.first("normal").alias("normal"))  # copies of a text have one
    suspects = suspects.select("text_id", F.explode(_shingles("normal", width, False)).alias("shingle"))
    counts = suspects.join(items, "shingle").groupBy("text_id", "item")
    counts = counts.agg(F.first("n_shingles").alias("n_shingles"), F.count(F.lit(1)).cast("int").alias("n_contained"))
    verified = counts.where(F.col("n_contained") >= _needed(F.col("n_shingles"), similarity))
    return verified.join(candidates, ["text_id", "item"], "left_semi")


def matches(docs: DataFrame, benchmark: DataFrame, width: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, item_id, n_shingles, n_contained for each row of ``docs`` and each row of ``benchmark`` found in it.

    Words are runs of letters and digits in lower case. A text with fewer than ``width`` words has one shingle, all of
    it, and one without words has none: such an item is in no document. A null text is empty. Null and repeated ids are
    returned as they are, once for each pair of rows. Other columns aren't read.
    """
    found = contained(docs, benchmark, width, similarity)
    found = found.join(benchmark.select("item_id", _text_id().alias("item")), "item")
    rows = docs.select("doc_id", _text_id().alias("text_id"))
    return rows.join(found, "text_id").select("doc_id", "item_id", "n_shingles", "n_contained")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that no item is found in, unchanged, whatever other columns they have."""
    bad = contained(docs, benchmark, width, similarity).select("text_id").distinct()
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # so that names don't clash
    return docs.select(row, _text_id().alias("text_id")).join(bad, "text_id", "left_anti").select("row.*")


def oracle_sql(width: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> str:
    """The same by comparing all shingles of all texts."""
    return f"""
WITH texts AS (
  SELECT 'd' AS kind, row_number() OVER () AS row, doc_id AS id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), item_id, text FROM benchmark
), split AS (
  SELECT kind, row, id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w
  FROM texts
), shingles AS (
  SELECT DISTINCT kind, row, id, array_to_string(w[i:i + {width - 1}], ' ') AS shingle
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) AS i FROM split WHERE w <> [''])
), sizes AS (
  SELECT row, count(*) AS n FROM shingles WHERE kind = 'b' GROUP BY row
)
SELECT d.id AS doc_id, b.id AS item_id, CAST(n AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_contained
FROM shingles b JOIN shingles d ON b.kind = 'b' AND d.kind = 'd' AND b.shingle = d.shingle JOIN sizes s ON s.row = b.row
GROUP BY d.row, d.id, b.row, b.id, n HAVING count(*) * {similarity[1]} >= n * {similarity[0]}"""
