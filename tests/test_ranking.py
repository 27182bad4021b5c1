"""Positions by buckets agree with a plain window, whatever the skew; nesting keeps every child."""

from __future__ import annotations

import golden
from pyspark.sql import functions as F

from paddock.operators import results, stewarding
from paddock.operators.ranking import Children, nest, rank_bounded, rank_spread, seasons_without

# Half of all rows in one race, a third of them without a time, and many equal times.
HOT = """
  select case when id % 2 = 0 then 0 else id % 11 end as race_id,
         id as driver_id,
         case when id % 3 <> 0 then cast(id * 7919 % 5000 as double) end as time,
         case when id % 5 = 0 then null else id % 7 = 0 end as is_dsq
  from range(20000)
"""


def order():
    return [*results.finish_order(), F.col("driver_id").asc()]


def same(one, other):
    return one.exceptAll(other).count() == other.exceptAll(one).count() == 0


def test_spread_positions_equal_window_positions(spark):
    for driver in ("driver_id", "cast(driver_id as string)"):
        rows = spark.sql(HOT).withColumn("driver_id", F.expr(driver))
        plain = rank_bounded(rows, ["race_id"], order(), "rank")
        spread = results.ranked_by_finish(rows)
        assert spread.dtypes == plain.dtypes
        assert same(spread, plain)


def test_spread_positions_cut_a_hot_group(spark):
    rows = spark.sql(HOT)
    buckets = results.finish_buckets(rows)
    largest = rows.groupBy("race_id", *[b.alias(f"b{k}") for k, b in enumerate(buckets)]).count().agg(F.max("count"))
    assert largest.first()[0] < rows.filter("race_id = 0").count() / 10


def test_null_and_composite_keys(spark):
    rows = spark.sql("select if(id % 4 = 0, null, id % 2) as a, cast(id % 3 as string) as b, id from range(500)")
    plain = rank_bounded(rows, ["a", "b"], [F.col("id").desc()], "n")
    spread = rank_spread(rows, ["a", "b"], [F.col("id").desc()], [F.floor(-F.col("id") / 10)], "n")
    assert same(spread, plain) and spread.count() == 500


def test_report_numbers_without_times(spark):
    reports = spark.sql(
        "select cast(id as string) as id, id % 2 as race_id,"
        " if(id % 3 = 0, null, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id % 20, id % 7)) as created_at"
        " from range(3000)"
    )
    plain = rank_bounded(reports, ["race_id"], [F.col("created_at").asc_nulls_last(), F.col("id").asc()], "rank")
    assert same(stewarding.numbered_reports(reports), plain)


def test_nesting_keeps_every_child_in_order(spark):
    rows = spark.sql("select if(id % 3 = 0, 0, id) as k, if(id = 3, null, -id) as v from range(3000)")
    parents = spark.sql("select id as k from range(3001)")
    found = {r.k: r["items"] for r in nest(["k"], parents=parents, items=Children(rows, [F.col("v")], ["v"])).collect()}
    assert len(found) == 3001
    assert [c["v"] for c in found[0]] == [*range(-2997, 1, 3)][: -2] + [0, None]
    assert sum(map(len, found.values())) == 3000


def test_nesting_shuffles_a_field_of_the_order_once(spark):
    """what orders the children and is kept of them is one value in the rows that are dealt, nulls last as before."""
    rows = spark.sql("select id % 2 as k, if(id = 3, null, id) as v, concat('w', id % 3) as w from range(6)")
    nested = nest(["k"], items=Children(rows, ["w", "v"], ["v", "w"]))
    shown = nested._jdf.queryExecution().optimizedPlan().toString()
    assert shown.split("collect_list")[1].count("_child") == 0 and "_child" not in shown
    found = {r.k: [tuple(c) for c in r["items"]] for r in nested.collect()}
    assert found == {0: [(0, "w0"), (4, "w1"), (2, "w2")], 1: [(None, "w0"), (1, "w1"), (5, "w2")]}


def test_one_message_however_many_targets(spark):
    league = golden.league(spark)
    targets = spark.range(10_001).select(F.lit("p1").alias("report_id"), F.format_string("x%d", "id").alias("driver_id"))
    many = league.replacing(report_targets=targets)
    assert {r.report_id: len(r.targets) for r in stewarding.incident_reports(many, "x").collect()}["p1"] == 10_001
    feed = [r.message for r in stewarding.report_notification_feed(many, "https://x").collect() if r.report_id == "p1"]
    assert len(feed) == 1
    assert [r for r in stewarding.report_links(many, "https://x").collect() if r.report_id == "p1"][0].rank == 3
    assert stewarding.open_reports(many).count() == 4


def test_absent_seasons(spark):
    seasons = spark.createDataFrame([("s1", "x", None), ("s2", "y", None)], "id string, name string, fia_role_id string")
    people = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    taken = spark.createDataFrame([("a", "s1"), ("b", "s1"), ("b", "s2"), ("b", "s2")], "k string, season_id string")
    rows = {r.k: r.absent_from for r in seasons_without(people, "k", taken, seasons).collect()}
    assert rows == {"a": ["s2"], "b": [], "c": ["s1", "s2"]}


def test_shared_places_equal_rank(spark):
    rows = spark.sql(HOT)
    places = results.scoring_places(rows, 10)
    expected = spark.sql(
        f"""select distinct race_id, is_dsq, time, place from (
              select *, rank() over (partition by race_id order by is_dsq asc nulls last, time asc nulls last) as place
              from ({HOT})) """
    )
    both = places.join(
        expected.withColumnsRenamed({"race_id": "r", "is_dsq": "d", "time": "t"}),
        F.expr("race_id = r and is_dsq <=> d and time <=> t"),
    )
    assert both.count() == places.count()
    assert both.filter("rank <> place").count() == 0
    # every place of ten or better is there
    assert places.filter("rank <= 10").count() == expected.filter("place <= 10").count()


def test_scoring_places_cut_rows_before_the_shuffle(spark):
    rows = spark.sql(HOT)
    plan = results.scoring_places(rows, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
