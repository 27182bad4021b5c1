"""The registered queries: each takes a session and a test-data folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.functions import text, timing
from paddock.operators import championship, ingest, members, quality, results, season, stewarding, upkeep
from paddock.plans import feeds
from paddock.session import new_folder, store
from paddock.sources import tables, testdata
from paddock.sources.kept import Kept
from paddock.sources.tables import League
from paddock.streaming import gates, notifications, numbers

BASE_URL = "https://league.example"
EMBED_PARENT = "league.example"
AS_OF = testdata.AS_OF
#: Parts of the small tables that queries keep here.
KEPT_PARTS = 8
#: Files of a micro-batch, so that the number of batches doesn't grow with the tables and many tasks write and read one.
BATCH_FILES = 8

Query = Callable[[SparkSession, str], DataFrame]


def as_json(rows: DataFrame, *columns: str) -> DataFrame:
    """Nested columns as JSON text."""
    options = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}
    return rows.withColumns({c: F.to_json(c, options) for c in columns})


def _json_sink(league: League) -> DataFrame:
    spark = league.races.sparkSession
    nested = championship.driver_standings(league, AS_OF)
    path = new_folder(spark, "standings-json")
    tables.write_json(nested, path)
    back = spark.read.schema(nested.schema).json(path)
    return back.select(
        "season_id", "position", "driver_id", "points_total", F.explode("races").alias("cell")
    ).select("season_id", "position", "driver_id", "points_total", "cell.race_id", "cell.rank", "cell.points")


def _gated_reports(league: League) -> DataFrame:
    return stewarding.report_gate(league.reports, league.races, league.races_drivers)


def _gated_responses(league: League) -> DataFrame:
    taken = gates.accepted(_gated_reports(league))
    return stewarding.response_gate(
        league.report_responses, taken, league.races, league.races_drivers, league.report_targets
    )


def _report_columns(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("report_id"), "race_id", "from_driver", "created_at", "gate")


def _response_columns(rows: DataFrame) -> DataFrame:
    return rows.select("report_id", "from_driver", "content", "created_at", "gate")


def _stream_report_gate(league: League) -> DataFrame:
    """Three runs: reports by time, then all of them again, most of them late by then, then one without a time by itself."""
    spark, schema = league.races.sparkSession, league.reports.schema
    inbox, out, state = (new_folder(spark, f"report-{kind}") for kind in ("inbox", "out", "state"))
    dated = F.col("created_at").isNotNull()
    for rows in (
        league.reports.filter(dated).repartitionByRange(2 * BATCH_FILES, "created_at"),
        league.reports.filter(dated).coalesce(2 * BATCH_FILES),
        league.reports.filter(~dated).coalesce(BATCH_FILES),
    ):
        rows.write.mode("append").parquet(inbox)
        stream = gates.read_files(spark, inbox, schema, max_files=BATCH_FILES)
        gates.stream_report_gate(stream, league, out, state).awaitTermination()
    on_time = gates.labelled_reports(spark, out, schema)
    return _report_columns(on_time.unionByName(gates.late_reports(spark, league, out, schema)))


def _stream_response_gate(league: League) -> DataFrame:
    """Two runs: the second brings reports whose responses came in the first, and what is left of the responses."""
    spark = league.races.sparkSession
    sent, taken, out, state = (new_folder(spark, f"response-{kind}") for kind in ("sent", "taken", "out", "state"))
    responses = league.report_responses
    accepted = store(gates.accepted(_gated_reports(league)).select(*league.reports.columns), "accepted_reports")
    first = F.col("report_id") % 3 != 0
    seen = F.col("id") % 2 == 0
    for last, answered, known in ((False, first, seen), (True, ~first, ~seen)):
        responses.filter(answered).write.mode("append").option("compression", "zstd").parquet(sent)
        accepted.filter(known).write.mode("append").option("compression", "zstd").parquet(taken)
        if last:  # the league has ended: all that still waits is due
            gates.heartbeat(spark, responses.schema, datetime(2100, 1, 1)).write.mode("append").parquet(sent)
            gates.heartbeat(spark, accepted.schema, datetime(2100, 1, 1)).write.mode("append").parquet(taken)
        streams = gates.read_files(spark, sent, responses.schema), gates.read_files(spark, taken, accepted.schema)
        gates.stream_response_gate(*streams, lambda: accepted, league, out, state).awaitTermination()
    late = gates.late_responses(spark, accepted, league, out, responses.schema)
    return _response_columns(gates.labelled_responses(spark, out, responses.schema).unionByName(late))


def _stream_notifications(league: League) -> DataFrame:
    spark = league.races.sparkSession
    inbox, out, state = (new_folder(spark, f"news-{kind}") for kind in ("inbox", "out", "state"))
    arrived = league.reports.select(F.col("id").alias("report_id"), F.lit(False).alias("is_decision"))
    decided = league.reports.filter(F.col("verdict").isNotNull()).select(
        F.col("id").alias("report_id"), F.lit(True).alias("is_decision")
    )
    news = arrived.unionByName(decided)
    news.repartition(2 * BATCH_FILES).write.parquet(inbox)
    stream = gates.read_files(spark, inbox, news.schema, max_files=BATCH_FILES)
    asked: list[int] = []

    def tables_so_far() -> League:
        """At first only some reports are there, so news of the others has to wait."""
        asked.append(len(asked))
        return league if len(asked) > 1 else league.replacing(reports=league.reports.filter("race_id % 2 = 0"))

    notifications.stream_notifications(stream, tables_so_far, BASE_URL, out, state).awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/sent").select(
        "report_id", "is_decision", "sender", "message"
    )


def _stream_report_numbers(league: League) -> DataFrame:
    """Reports come in three batches, the latest first, and some again; then all are numbered by the index of counts."""
    spark, schema = league.races.sparkSession, league.reports.schema
    inbox, path, state = (new_folder(spark, f"numbers-{kind}") for kind in ("inbox", "index", "state"))
    league.reports.repartitionByRange(2 * BATCH_FILES, F.col("created_at").desc()).write.parquet(inbox)
    league.reports.filter("verdict IS NULL").coalesce(BATCH_FILES).write.mode("append").parquet(inbox)
    index = numbers.Numbers(path, schema, KEPT_PARTS).create(spark)
    numbers.keep_numbers(gates.read_files(spark, inbox, schema, max_files=BATCH_FILES), index, state).awaitTermination()
    found = index.of(league.reports.select("id", "race_id", "created_at"))
    return found.withColumnRenamed("id", "report_id")


def _kept_standings(league: League) -> upkeep.Standings:
    """A league with empty sprints and half of its penalties, to which the sprints' entries and the other penalties are posted.

    Each feed comes twice under one name, and once more under another, as after a posting that broke off.
    """
    spark = league.races.sparkSession
    sprints = league.races.filter("is_sprint").select(F.col("id").alias("race_id"))
    later = F.col("report_id") % 2 == 1
    before = feeds.lined_up(league).join(sprints, "race_id", "left_semi")
    raced = league.races_drivers.join(sprints, "race_id", "left_anti")
    first = league.replacing(races_drivers=raced.unionByName(before), penalties=league.penalties.filter(~later))
    kept = upkeep.Standings.at(new_folder(spark, "standings"), first, KEPT_PARTS).create(first)
    posted = league.races_drivers.join(sprints, "race_id", "left_semi")
    # the feed's disqualifications are in the entries already
    given = upkeep.penalties_by_race(league).filter(later).withColumn("is_dsq", F.lit(False))
    for posting in ("sprints", "sprints", "again"):
        kept.post_entries(posted, league, posting)
    for posting in ("verdicts", "verdicts", "again"):
        kept.post_penalties(given, league, posting)
    return kept


def _kept_entries(league: League) -> DataFrame:
    """Two postings, one of the sprints and one of the other races and the strays, applied in turn to kept entries."""
    spark = league.races.sparkSession
    table = Kept(new_folder(spark, "entries"), league.races_drivers.schema, ["race_id"], KEPT_PARTS).create(league.races_drivers)
    sprints = league.races.filter("is_sprint").select(F.col("id").alias("race_id"))
    lists = ingest.flatten_teams(feeds.entry_lists(league), "race_id")
    strays = ingest.flatten_teams(feeds.stray_entry_lists(league), "race_id", outer=True)
    upkeep.replace_kept_entries(table, lists.join(sprints, "race_id", "left_semi"), league, "sprints")
    upkeep.replace_kept_entries(table, lists.join(sprints, "race_id", "left_anti").unionByName(strays), league, "features")
    return table.read(spark)


def _kept_lineup(league: League) -> DataFrame:
    spark = league.races.sparkSession
    roster = upkeep.Roster.at(new_folder(spark, "roster"), league, KEPT_PARTS)
    roster.seats.create(league.seasons_drivers)
    changes = feeds.lineup_changes(league).unionByName(feeds.stray_seats(league))
    for posting in ("line-ups", "line-ups", "again"):
        roster.change(changes, league.seasons, posting)
    return roster.seats.read(spark)


def _kept_drivers(spark: SparkSession, folder: str) -> DataFrame:
    """The change feed applied to kept drivers; it comes again under the same name, and once more under another."""
    drivers = testdata.league(spark, folder).drivers
    table = Kept(new_folder(spark, "drivers"), drivers.schema, ["id"], KEPT_PARTS).create(drivers)
    orders = _orders(spark, folder)
    changes = feeds.driver_changes(orders).unionByName(feeds.stray_changes(orders))
    for posting in ("changes", "changes", "again"):
        upkeep.change_kept(table, changes, posting)
    return table.read(spark)


def _loaded(league: League) -> League:
    """The league written as a live one keeps it, and read back."""
    spark = league.races.sparkSession
    path = new_folder(spark, "league")
    tables.write_league(tables.conformed(league), path)
    return tables.load_league(spark, path)


def _schedule(league: League) -> tuple[DataFrame, DataFrame]:
    records = ingest.schedule_records(feeds.schedules(league).unionByName(feeds.empty_schedules(league)))
    return ingest.ingest_schedule(records, league.seasons, league.races, league.tracks)


def _results(league: League) -> tuple[DataFrame, DataFrame]:
    records = feeds.results(league).unionByName(feeds.stray_results(league))
    return ingest.ingest_results(feeds.lined_up(league), records)


def _verdicts(league: League) -> ingest.Verdicts:
    return ingest.apply_verdicts(
        league.reports, league.penalties, league.races_drivers, feeds.verdicts(league)
    )


def _reserves(league: League) -> tuple[DataFrame, DataFrame]:
    requests = feeds.reserve_requests(league).unionByName(feeds.stray_seats(league).select("season_name", "driver_id"))
    return ingest.add_reserves(league.seasons_drivers, requests, league.seasons)


def _lineup(league: League) -> tuple[DataFrame, DataFrame]:
    changes = feeds.lineup_changes(league).unionByName(feeds.stray_seats(league))
    return ingest.upsert_lineup(league.seasons_drivers, changes, league.seasons)


def _entry_lists(league: League) -> tuple[DataFrame, DataFrame]:
    posted = feeds.entry_lists(league).unionByName(feeds.stray_entry_lists(league))
    lists = ingest.flatten_teams(posted, "race_id", outer=True)
    return ingest.replace_race_entries(league.races_drivers, lists, league.races, league.drivers, league.teams)


def _new_reports(league: League) -> tuple[DataFrame, DataFrame, DataFrame]:
    submissions = feeds.report_submissions(league).unionByName(feeds.stray_reports(league))
    return ingest.append_reports(submissions, league.users, races=league.races)


def _new_responses(league: League) -> tuple[DataFrame, DataFrame]:
    return ingest.append_responses(feeds.response_submissions(league), league.users, league.reports)


def _role_members(league: League) -> tuple[DataFrame, DataFrame]:
    return ingest.replace_role_members(
        league.users_roles, feeds.steward_lists(league), league.seasons, league.users
    )


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/orders.parquet")


def _driver_changes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    drivers = testdata.league(spark, folder).drivers
    orders = _orders(spark, folder)
    changes = feeds.driver_changes(orders).unionByName(feeds.stray_changes(orders))
    return ingest.apply_changes(drivers, changes, ["id"])


def _changed_drivers(spark: SparkSession, folder: str) -> DataFrame:
    return _driver_changes(spark, folder)[0]


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    """References to drivers the change feed removed."""
    league = testdata.league(spark, folder)
    return quality.dq_orphans(league.replacing(drivers=_changed_drivers(spark, folder)))


def _long_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names taken from whole documents."""
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    names = documents.select(F.col("doc_id").alias("id"), F.col("text").alias("name"))
    return quality.dq_length(testdata.league(spark, folder).replacing(drivers=names))


# Queries over the league's tables.
LEAGUE_QUERIES: dict[str, Callable[[League], DataFrame]] = {
    # championship and results
    "penalty_time_totals": results.penalty_time_totals,
    "race_classification": lambda lg: results.race_classification(lg).select(
        "race_id", "driver_id", "team_id", "time", "is_dsq", "rank"
    ),
    "race_results": lambda lg: results.race_results(lg, AS_OF),
    "race_wins": results.race_wins,
    "race_wins_pg_compat": lambda lg: results.race_wins(lg, pg_compat=True),
    "driver_race_points": championship.driver_race_points,
    "team_colors": championship.team_colors,
    "avg_finish_position": championship.avg_finish_position,
    "driver_standings_long": lambda lg: championship.driver_standings_long(lg, AS_OF),
    "driver_standings": lambda lg: as_json(championship.driver_standings(lg, AS_OF), "races"),
    "standings_race_header": championship.standings_race_header,
    "rank_display": championship.rank_display,
    "constructor_standings": championship.constructor_standings,
    "driver_standings_kept": lambda lg: _kept_standings(lg).driver_standings_long(lg, AS_OF),
    "constructor_standings_kept": lambda lg: _kept_standings(lg).constructor_standings(lg),
    "constructor_standings_pg_compat": lambda lg: championship.constructor_standings(lg, pg_compat=True),
    "penalty_points_by_race": championship.penalty_points_by_race,
    "penalty_points_table": championship.penalty_points_table,
    "penalty_points_nested": lambda lg: as_json(championship.penalty_points_nested(lg), "races"),
    "race_entry_list": results.race_entry_list,
    "race_lineup_options": results.race_lineup_options,
    "race_gap_sheet": results.race_gap_sheet,
    # stewarding
    "incident_reports": lambda lg: as_json(
        stewarding.incident_reports(lg, EMBED_PARENT), "videos", "targets", "responses", "penalties"
    ),
    "report_rank": stewarding.report_rank,
    "open_reports": lambda lg: as_json(stewarding.open_reports(lg), "targets"),
    "concerned_drivers": stewarding.concerned_drivers,
    "report_notification_feed": lambda lg: stewarding.report_notification_feed(lg, BASE_URL),
    "verdict_notification_feed": lambda lg: stewarding.report_notification_feed(lg, BASE_URL, is_decision=True),
    # seasons and members
    "season_schedule": season.season_schedule,
    "season_list": season.season_list,
    "track_list": season.track_list,
    "report_targets": stewarding.report_targets,
    "report_penalties": stewarding.report_penalties,
    "unrostered_drivers": lambda lg: season.one_per_season(season.unrostered_drivers(lg)),
    "available_drivers": lambda lg: season.one_per_season(season.available_drivers(lg)),
    "season_lineup": lambda lg: as_json(season.season_lineup(lg), "drivers"),
    "season_reserves": season.season_reserves,
    "signed_drivers": season.signed_drivers,
    "steward_candidates": lambda lg: season.one_per_season(members.steward_candidates(lg)),
    "current_stewards": members.current_stewards,
    "users_with_roles": lambda lg: as_json(members.users_with_roles(lg), "roles"),
    "role_list": members.role_list,
    "user_role_names": members.user_role_names,
    # scans, sinks and ingest
    "load_league": lambda lg: tables.table_sizes(_loaded(lg)),
    "lookup": lambda lg: tables.lookup(_loaded(lg).seasons_drivers, season_id="1998"),
    "season_by_name": lambda lg: tables.season_by_name(feeds.name_requests(lg), lg.seasons).select(
        "race_id", "season_name", "season_id"
    ),
    "nested_json_sink": _json_sink,
    "ingest_schedule": lambda lg: _schedule(lg)[0],
    "ingest_schedule_rejected": lambda lg: _schedule(lg)[1],
    "ingest_results": lambda lg: _results(lg)[0],
    "ingest_results_rejected": lambda lg: _results(lg)[1],
    "replace_race_entries": lambda lg: _entry_lists(lg)[0],
    "replace_race_entries_kept": _kept_entries,
    "replace_race_entries_rejected": lambda lg: _entry_lists(lg)[1],
    "flatten_team_pairs": lambda lg: ingest.flatten_team_pairs(feeds.team_pairs(lg)),
    "roster_to_entries": season.roster_to_entries,
    "add_reserves": lambda lg: _reserves(lg)[0],
    "add_reserves_rejected": lambda lg: _reserves(lg)[1],
    "upsert_lineup": lambda lg: _lineup(lg)[0],
    "upsert_lineup_kept": _kept_lineup,
    "upsert_lineup_rejected": lambda lg: _lineup(lg)[1],
    "apply_verdicts": lambda lg: _verdicts(lg).reports.select("id", "verdict"),
    "apply_verdicts_penalties": lambda lg: _verdicts(lg).penalties,
    "apply_verdicts_entries": lambda lg: _verdicts(lg).entries.select("race_id", "driver_id", "is_dsq"),
    "apply_verdicts_rejected": lambda lg: _verdicts(lg).rejected,
    "apply_verdicts_rejected_penalties": lambda lg: _verdicts(lg).rejected_penalties,
    "append_reports": lambda lg: _new_reports(lg)[0],
    "append_report_targets": lambda lg: _new_reports(lg)[1],
    "append_reports_rejected": lambda lg: _new_reports(lg)[2],
    "append_responses": lambda lg: _new_responses(lg)[0],
    "append_responses_rejected": lambda lg: _new_responses(lg)[1],
    "replace_role_members": lambda lg: _role_members(lg)[0],
    "replace_role_members_rejected": lambda lg: _role_members(lg)[1],
    # column functions over whole tables
    "points_for": results.entry_points,
    "parse_gap": lambda lg: feeds.gap_texts(lg).select(
        "race_id",
        "driver_id",
        "gap",
        timing.parse_gap(F.col("leader_time"), F.col("gap")).alias("time"),
        timing.is_valid_gap(F.col("gap")).alias("is_valid"),
        timing.is_valid_gap(F.col("gap"), strict=True).alias("is_valid_strictly"),
    ),
    "format_gap": lambda lg: feeds.time_pairs(lg).select(
        "race_id", "driver_id", timing.format_gap(F.col("leader_time"), F.col("time")).alias("gap")
    ),
    "format_time": lambda lg: lg.races_drivers.select(
        "race_id", "driver_id", timing.format_time(F.col("time")).alias("time_text")
    ),
    "parse_time": lambda lg: feeds.clock_texts(lg).select(
        "race_id", "driver_id", timing.parse_time(F.col("time_text")).alias("time")
    ),
    "has_been_raced": lambda lg: lg.races.select(
        F.col("id").alias("race_id"),
        timing.has_been_raced(F.col("date"), results.moment(AS_OF, lg.races, "date")).alias("has_been_raced"),
    ),
    "expiry_instant": lambda lg: lg.discord_accounts.select(
        "id", timing.expires_at(results.moment(AS_OF, lg.races, "date"), F.col("id")).alias("expires_at")
    ),
    "local_instant": lambda lg: ingest.schedule_records(feeds.schedules(lg)).select(
        "season_name", "track_id", timing.local_to_utc(F.col("timestamp")).alias("starts_at")
    ),
    "report_deadline": lambda lg: lg.races.select(
        F.col("id").alias("race_id"),
        timing.report_deadline(F.col("date")).alias("deadline"),
        timing.report_deadline(F.col("date"), timing.SCHEDULE_ZONE).alias("local_deadline"),
    ),
    "video_links": lambda lg: stewarding.video_links(lg, EMBED_PARENT),
    "mention_text": stewarding.mention_text,
    "report_link": lambda lg: stewarding.report_links(lg, BASE_URL).select("report_id", "link"),
    "message_time": lambda lg: lg.reports.select(
        F.col("id").alias("report_id"), timing.message_time(F.col("created_at")).alias("sent")
    ),
    "name_decode": lambda lg: feeds.name_requests(lg).select(
        "race_id", text.decode_name(F.col("encoded_name")).alias("season_name")
    ),
    "role_name": lambda lg: lg.seasons.select("id", text.steward_role_name(F.col("name")).alias("role_name")),
    # data quality
    "dq_duplicate_keys": lambda lg: quality.dq_duplicate_keys(
        lg.replacing(races_drivers=ingest.flatten_teams(feeds.entry_lists(lg), "race_id"))
    ),
    "dq_driver_two_teams": lambda lg: quality.dq_driver_two_teams(
        ingest.flatten_teams(feeds.entry_lists(lg), "race_id")
    ),
    "dq_one_fastest_lap": lambda lg: quality.dq_one_fastest_lap(
        lg.races_drivers.withColumn("has_fastest_lap", F.col("has_fastest_lap") & ~F.col("is_dsq"))
    ),
    # gates
    "report_gate": lambda lg: _report_columns(_gated_reports(lg)),
    "response_gate": lambda lg: _response_columns(_gated_responses(lg)),
    "stream_report_gate": _stream_report_gate,
    "stream_response_gate": _stream_response_gate,
    "stream_notifications": _stream_notifications,
    "stream_report_numbers": _stream_report_numbers,
}

# Queries over the given tables themselves.
TABLE_QUERIES: dict[str, Query] = {
    "apply_changes": _changed_drivers,
    "apply_changes_kept": _kept_drivers,
    "apply_changes_rejected": lambda spark, folder: _driver_changes(spark, folder)[1],
    "dq_orphans": _orphans,
    "dq_length": _long_names,
    "is_canonical_uuid": lambda spark, folder: feeds.identifiers(_orders(spark, folder)).withColumn(
        "is_canonical", text.is_canonical_uuid(F.col("id_text"))
    ),
    "dq_uuid": lambda spark, folder: quality.dq_uuid(feeds.identifiers(_orders(spark, folder)), "id_text"),
}


def queries() -> dict[str, Query]:
    def over_league(operator: Callable[[League], DataFrame]) -> Query:
        return lambda spark, folder: operator(testdata.league(spark, folder))

    return {name: over_league(operator) for name, operator in LEAGUE_QUERIES.items()} | TABLE_QUERIES
