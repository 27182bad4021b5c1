"""Incident reports: numbering, listings, messages, and the gates for new ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.functions.text import (
    GAME_ID,
    GAME_NAME,
    embed_url,
    mention,
    report_link,
    split_videos,
    url_host,
)
from paddock.functions.timing import message_time, report_deadline
from paddock.operators.ranking import Children, nest, prefix, rank_spread
from paddock.sources.tables import League

# Message templates and the stewards' sender name.
HEADING = "## %s %s, Report #%d"
REPORT_TEXT = "%s\n*%s*\n\nNa koho: \n%s\n\nViac info [na tomto odkaze](%s)"
VERDICT_TEXT = (
    "%s\n\n### Pridané rozhodnutie\n\nÚčastníci:\n%s\n%s\n\nViac info [na tomto odkaze](%s)"
)
STEWARD_SENDER = "FIA"

ACCEPTED, NOT_ENTERED, TOO_EARLY, TOO_LATE, NO_REPORT, UNKNOWN_RACE, UNDATED = (
    "accepted",
    "not_entered",
    "too_early",
    "too_late",
    "no_report",
    "unknown_race",
    "undated",
)
MEDIA_ROOT = "/media"


def _drivers(league: League, key: str, name: str) -> DataFrame:
    return league.drivers.select(F.col("id").alias(key), F.col("name").alias(name))


def numbered_reports(reports: DataFrame) -> DataFrame:
    """Reports with their number in the race, in order of arrival."""
    unknown = F.col("created_at").isNull()
    first = prefix(reports, "id")
    minute = F.date_trunc("minute", "created_at")
    buckets = [
        unknown.cast("int"),
        F.coalesce(F.date_format(minute, "yyyyMMddHHmm"), F.lit("")),
        F.when(unknown, first).otherwise(F.lit("" if dict(reports.dtypes)["id"] == "string" else 0)),
    ]
    order = [F.col("created_at").asc_nulls_last(), F.col("id").asc()]
    return rank_spread(reports, ["race_id"], order, buckets, "rank")


def report_rank(league: League) -> DataFrame:
    """Number of each report in its race, in order of arrival."""
    reports = numbered_reports(league.reports.select("id", "race_id", "created_at"))
    return reports.withColumnRenamed("id", "report_id")


def report_targets(league: League) -> DataFrame:
    """Targets with names; a target without a driver is the game."""
    named = league.report_targets.join(_drivers(league, "driver_id", "driver_name"), "driver_id", "left")
    return named.select("report_id", "driver_id", *_target(F.col("driver_id"), F.col("driver_name")))


def _target(driver_id: Column, driver_name: Column) -> tuple[Column, Column]:
    """target_id and target_name; a target without a driver is the game."""
    is_game = driver_id.isNull()
    target_id = F.when(is_game, GAME_ID).otherwise(driver_id.cast("string"))
    return target_id.alias("target_id"), F.when(is_game, GAME_NAME).otherwise(driver_name).alias("target_name")


def _targets_of(league: League) -> Children:
    return Children(report_targets(league), ["driver_id"], ["target_id", "target_name"])


def report_responses(league: League, embed_parent: str) -> DataFrame:
    """Responses with names and videos."""
    responses = league.report_responses.join(
        _drivers(league, "from_driver", "driver_name"), "from_driver", "left"
    )
    return responses.select(
        "report_id",
        "id",
        "from_driver",
        "driver_name",
        "content",
        videos(F.col("video_path"), embed_parent).alias("videos"),
        "created_at",
    )


def report_penalties(league: League) -> DataFrame:
    """Penalties with names."""
    return league.penalties.join(_drivers(league, "driver_id", "driver_name"), "driver_id").select(
        "report_id", "driver_id", "driver_name", "time", "penalty_points", "is_dsq"
    )


def incident_reports(league: League, embed_parent: str) -> DataFrame:
    """Reports with their videos, targets, responses and penalties, one row per report.

    The children's own rows are ``report_targets``, ``report_responses`` and ``report_penalties``. A target's
    text is worked out in the list, so that it isn't shuffled.
    """
    named = league.report_targets.join(_drivers(league, "driver_id", "driver_name"), "driver_id", "left")
    lists = nest(
        ["report_id"],
        parents=league.reports.select(F.col("id").alias("report_id")),
        targets=Children(named, ["driver_id"], ["driver_id", "driver_name"]),
        responses=Children(
            report_responses(league, embed_parent),
            ["created_at", "from_driver", "content"],
            ["id", "from_driver", "driver_name", "content", "videos", "created_at"],
        ),
        penalties=Children(
            report_penalties(league),
            ["driver_id"],
            ["driver_id", "driver_name", "time", "penalty_points", "is_dsq"],
        ),
    )
    reports = (
        numbered_reports(league.reports)
        .withColumnRenamed("id", "report_id")
        .join(_drivers(league, "from_driver", "from_name"), "from_driver")
    )
    return reports.join(lists, "report_id").select(
        "report_id",
        "race_id",
        "rank",
        "from_driver",
        "from_name",
        "content",
        videos(F.col("video_path"), embed_parent).alias("videos"),
        "created_at",
        "verdict",
        F.transform("targets", lambda t: F.struct(*_target(t["driver_id"], t["driver_name"]))).alias("targets"),
        "responses",
        "penalties",
    )


def is_upload(url: Column, media_root: str = MEDIA_ROOT) -> Column:
    """Whether a video is a file uploaded to the league's own folder, rather than an address elsewhere."""
    return F.startswith(url, F.lit(f"{media_root}/"))


def _shown(url: Column, player: Column, media_root: str) -> tuple[Column, Column, Column]:
    """is_local, url and embed of a video: uploads by name, others by player address."""
    local = is_upload(url, media_root)
    name = F.substring(url, F.lit(len(media_root) + 2), F.length(url))
    shown = F.when(local, name).otherwise(F.coalesce(player, url))
    return local.alias("is_local"), shown.alias("url"), (~local & player.isNotNull()).alias("embed")


def videos(video_path: Column, embed_parent: str, media_root: str = MEDIA_ROOT) -> Column:
    """Videos of a report with a flag for uploads, and one for players."""
    addresses = F.transform(
        split_videos(video_path), lambda url: F.struct(url.alias("url"), url_host(url).alias("host"))
    )
    players = F.transform(
        addresses,
        lambda a: F.struct(
            a["url"].alias("url"), embed_url(a["url"], a["host"], embed_parent).alias("player")
        ),
    )
    return F.transform(players, lambda p: F.struct(*_shown(p["url"], p["player"], media_root)))


def video_links(league: League, embed_parent: str, media_root: str = MEDIA_ROOT) -> DataFrame:
    """One row per video of a report: uploaded files by name, others by player address."""
    paths = league.reports.select(
        F.col("id").alias("report_id"), F.posexplode(split_videos(F.col("video_path"))).alias("video_no", "url")
    )
    players = paths.withColumn("host", url_host(F.col("url"))).withColumn(
        "player", embed_url(F.col("url"), F.col("host"), embed_parent)
    )
    return players.select("report_id", "video_no", *_shown(F.col("url"), F.col("player"), media_root))


def open_reports(league: League) -> DataFrame:
    """Undecided reports with their targets, one row per report; numbers count the decided ones too."""
    tracks = league.tracks.select(F.col("id").alias("track_id"), "race_name")
    races = league.races.select(F.col("id").alias("race_id"), "track_id").join(tracks, "track_id")
    columns = ["id", "race_id", "from_driver", "created_at", F.col("verdict").isNull().alias("is_open")]
    undecided = numbered_reports(league.reports.select(*columns)).filter("is_open").withColumnRenamed("id", "report_id")
    lists = nest(
        ["report_id"],
        parents=league.reports.filter(F.col("verdict").isNull()).select(F.col("id").alias("report_id")),
        targets=_targets_of(league),
    )
    return (
        undecided.join(races, "race_id")
        .join(_drivers(league, "from_driver", "from_name"), "from_driver")
        .join(lists, "report_id")
        .select("report_id", "race_id", "race_name", "rank", "from_driver", "from_name", "targets")
    )


def concerned_drivers(league: League) -> DataFrame:
    """Reporter and targets of each report."""
    reporters = league.reports.select(
        F.col("id").alias("report_id"), F.lit("reporter").alias("role"), F.col("from_driver").alias("driver_id")
    ).join(_drivers(league, "driver_id", "driver_name"), "driver_id")
    targets = report_targets(league).select(
        "report_id", F.lit("target").alias("role"), "driver_id", F.col("target_name").alias("driver_name")
    )
    return reporters.unionByName(targets).select("report_id", "role", "driver_id", "driver_name")


def _accounts(league: League) -> DataFrame:
    """Chat account per driver: the one the user chose, else one that names the user.

    A user has one driver; should data hold more, the smallest account is taken.
    """
    accounts = league.discord_accounts
    chosen = accounts.select(F.col("id").alias("discord_account_id"), F.col("discord_id").alias("_chosen"))
    naming = accounts.groupBy(F.col("user_id").alias("id")).agg(F.min("discord_id").alias("_naming"))
    return (
        league.users.filter(F.col("driver_id").isNotNull())
        .join(chosen, "discord_account_id", "left")
        .join(naming, "id", "left")
        .groupBy("driver_id")
        .agg(F.min(F.coalesce("_chosen", "_naming")).alias("account"))
    )


def _mentions(league: League) -> DataFrame:
    return report_targets(league).join(_accounts(league), "driver_id", "left").select(
        "report_id",
        "driver_id",
        mention(F.col("driver_id"), F.col("target_name"), F.col("account")).alias("line"),
    )


def mention_text(league: League) -> DataFrame:
    """Targets of a report as lines of one text."""
    lines = nest(["report_id"], lines=Children(_mentions(league), ["driver_id"], ["line"]))
    text = F.array_join(F.transform("lines", lambda c: c["line"]), "\n")
    return lines.select("report_id", text.alias("mentions"))


def report_links(
    league: League, base_url: str, reports: DataFrame | None = None, numbered: DataFrame | None = None
) -> DataFrame:
    """Numbered reports with season, race and link; ``numbered`` ones, if given, have their ``rank`` already."""
    tracks = league.tracks.select(F.col("id").alias("track_id"), "race_name", "emoji")
    seasons = league.seasons.select(F.col("id").alias("season_id"), F.col("name").alias("season_name"))
    races = (
        league.races.select(F.col("id").alias("race_id"), "track_id", "season_id")
        .join(tracks, "track_id")
        .join(seasons, "season_id")
    )
    rows = league.reports.select("id", "race_id", "created_at") if reports is None else reports
    link = report_link(base_url, F.col("season_name"), F.col("race_id"), F.col("rank"))
    numbered = (numbered_reports(rows) if numbered is None else numbered).withColumnRenamed("id", "report_id")
    return numbered.join(races, "race_id").withColumn("link", link)


def report_notification_feed(
    league: League,
    base_url: str,
    is_decision: bool = False,
    wanted: DataFrame | None = None,
    number: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One message for each report, or for each decided report's verdict.

    ``wanted`` (report_id) narrows it to some reports: then only their races' reports are numbered, and only their
    targets named. ``number`` gives the wanted reports their ``rank`` without the others of the race.
    """
    numbered = None
    columns = ["id", "race_id", "created_at", "from_driver", F.col("verdict").isNotNull().alias("is_decided")]
    reports = league.reports.select(*columns)
    if wanted is not None:
        asked = wanted.select(F.col("report_id").alias("id")).distinct()
        own = reports.join(asked, "id", "left_semi")
        if number is not None:
            numbered = number(own)
        else:
            reports = reports.join(own.select("race_id").distinct(), "race_id", "left_semi")
        own = league.report_targets.join(asked.withColumnRenamed("id", "report_id"), "report_id", "left_semi")
        league = league.replacing(report_targets=own)
    rows = report_links(league, base_url, reports, numbered)
    if is_decision:
        rows = rows.filter("is_decided")
    if wanted is not None:
        rows = rows.join(wanted.select("report_id").distinct(), "report_id", "left_semi")
    rows = rows.join(_drivers(league, "from_driver", "from_name"), "from_driver").join(
        mention_text(league), "report_id", "left"
    )
    heading = F.format_string(HEADING, F.coalesce("emoji", F.lit("")), "race_name", "rank")
    mentions = F.coalesce("mentions", F.lit(""))
    if is_decision:
        rows = rows.join(
            _accounts(league).withColumnRenamed("driver_id", "from_driver"), "from_driver", "left"
        )
        reporter = mention(F.col("from_driver"), F.col("from_name"), F.col("account"))
        text = F.format_string(VERDICT_TEXT, heading, reporter, mentions, F.col("link"))
        sender = F.lit(STEWARD_SENDER)
    else:
        text = F.format_string(REPORT_TEXT, heading, message_time(F.col("created_at")), mentions, F.col("link"))
        sender = F.col("from_name")
    return rows.select("report_id", "race_id", "rank", sender.alias("sender"), "link", text.alias("message"))


def _race_dates(races: DataFrame) -> DataFrame:
    return races.select(
        F.col("id").alias("race_id"), F.col("date").alias("race_date"), F.lit(True).alias("is_race")
    )


def _entrants(entries: DataFrame) -> DataFrame:
    pairs = entries.select("race_id", F.col("driver_id").alias("from_driver")).distinct()
    return pairs.withColumn("entered", F.lit(True))


def report_gate(reports: DataFrame, races: DataFrame, entries: DataFrame, zone: str = "UTC") -> DataFrame:
    """Label new reports: only entrants may report, from the start to the end of the next day.

    A report of an unknown race or without a time to judge by isn't accepted.
    """
    sent = F.col("created_at")
    label = (
        F.when(F.col("is_race").isNull(), UNKNOWN_RACE)
        .when(F.col("entered").isNull(), NOT_ENTERED)
        .when(sent.isNull() | F.col("race_date").isNull(), UNDATED)
        .when(sent <= F.col("race_date"), TOO_EARLY)
        .when(sent <= report_deadline(F.col("race_date"), zone), ACCEPTED)
        .otherwise(TOO_LATE)
    )
    return (
        reports.join(_race_dates(races), "race_id", "left")
        .join(_entrants(entries), ["race_id", "from_driver"], "left")
        .withColumn("gate", label)
        .drop("entered", "race_date", "is_race")
    )


def response_label(
    responses: DataFrame, races: DataFrame, entries: DataFrame, targets: DataFrame, zone: str
) -> DataFrame:
    """Label responses already joined to their report's ``race_id`` and ``reported_at``.

    Responses without a report are dealt for no join, and of the others only those between the race's deadline and a day
    after the report, for which it matters, are looked up among the targets.
    """
    sent, start = F.col("created_at"), F.col("race_date")
    in_time = sent < report_deadline(start, zone)
    as_target = F.coalesce((sent > start) & ~in_time & (sent < F.col("reported_at") + F.expr("INTERVAL 1 DAY")), F.lit(False))
    judged = responses.filter(F.col("race_id").isNotNull()).join(_race_dates(races), "race_id", "left")
    targeted = targets.filter(F.col("driver_id").isNotNull())
    targeted = targeted.select("report_id", F.col("driver_id").alias("from_driver")).distinct().withColumn("targeted", F.lit(True))
    entrants, by_entry = _entrants(entries), ["race_id", "from_driver"]
    rest = judged.filter(~as_target).join(entrants, by_entry, "left").withColumn("targeted", F.lit(False))
    asked = judged.filter(as_target).join(entrants, by_entry, "left").join(targeted, ["report_id", "from_driver"], "left")
    label = (
        F.when(F.col("entered").isNull(), NOT_ENTERED)
        .when(sent.isNull() | start.isNull(), UNDATED)
        .when(sent <= start, TOO_EARLY)
        .when(in_time | F.coalesce("targeted", F.lit(False)), ACCEPTED)
        .otherwise(TOO_LATE)
    )
    keys = ["report_id", "from_driver", "race_id"]
    columns = [*keys, *(c for c in responses.columns if c not in keys)]
    alone = responses.filter(F.col("race_id").isNull()).select(*columns, F.lit(NO_REPORT).alias("gate"))
    known = rest.unionByName(asked).select(*columns, label.alias("gate"))
    return known.unionByName(alone)


def with_reports(responses: DataFrame, accepted_reports: DataFrame) -> DataFrame:
    """Responses with their accepted report's ``race_id`` and ``reported_at``, nulls where there is none."""
    known = accepted_reports.filter(F.col("race_id").isNotNull()).select(
        F.col("id").alias("report_id"), "race_id", F.col("created_at").alias("reported_at")
    )
    # only responses that name a report are dealt, so that the join is dealt alike whatever is asked of its result
    named = responses.filter(F.col("report_id").isNotNull()).join(known, "report_id", "left")
    blank = [F.lit(None).cast(known.schema[c].dataType).alias(c) for c in ("race_id", "reported_at")]
    return named.unionByName(responses.filter(F.col("report_id").isNull()).select("*", *blank))


def response_gate(
    responses: DataFrame,
    accepted_reports: DataFrame,
    races: DataFrame,
    entries: DataFrame,
    targets: DataFrame,
    zone: str = "UTC",
) -> DataFrame:
    """Label responses: entrants until the race's deadline, targets also a day after the report."""
    return response_label(with_reports(responses, accepted_reports), races, entries, targets, zone)
