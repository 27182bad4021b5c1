"""Race times, gaps and deadlines as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted gap text and the wall-clock formats.
GAP_PATTERN = r"^\+(([0-5]?[0-9]):)?([0-5]?[0-9])([.,][0-9]{1,3})?"
SCHEDULE_FORMAT = "yyyy-MM-dd'T'HH:mm"
MESSAGE_FORMAT = "dd.MM.yy HH:mm:ss"
SCHEDULE_ZONE = "Europe/Budapest"


def is_dnf(gap: Column) -> Column:
    return F.lower(gap) == "dnf"


def is_valid_gap(gap: Column, strict: bool = False) -> Column:
    """Whether a gap text can be read; by default trailing text is ignored, as at the source."""
    pattern = GAP_PATTERN + r"\z" if strict else GAP_PATTERN
    return F.coalesce(is_dnf(gap) | gap.rlike(pattern), F.lit(False))


def gap_seconds(gap: Column) -> Column:
    """Seconds in ``+mm:ss.mmm`` or ``+ss.mmm``; null for DNF and unreadable text."""
    minutes = F.regexp_extract(gap, GAP_PATTERN, 2)
    seconds = F.regexp_extract(gap, GAP_PATTERN, 3)
    fraction = F.regexp_extract(gap, GAP_PATTERN, 4)
    whole = F.when(minutes == "", 0).otherwise(minutes.try_cast("int")) * 60 + seconds.try_cast("int")
    part = F.when(fraction == "", 0.0).otherwise(
        F.concat(F.lit("0."), F.substring(fraction, 2, 3)).try_cast("double")
    )
    return F.when(gap.rlike(GAP_PATTERN), whole + part)


def parse_gap(leader_time: Column, gap: Column) -> Column:
    """Finishing time from the leader's time and a gap; null for DNF and unreadable text."""
    return leader_time + gap_seconds(gap)


def parse_time(text: Column) -> Column:
    """Seconds in ``mm:ss.frac``; the fraction is read as a whole number of milliseconds."""
    parts = F.split(text, r"\.")
    clock = F.split(F.get(parts, F.lit(0)), ":")
    fraction = F.get(parts, F.lit(1))
    millis = F.when(F.size(parts) > 1, fraction.try_cast("int") / 1000).otherwise(F.lit(0.0))
    minutes = F.get(clock, F.lit(0)).try_cast("int")
    seconds = F.get(clock, F.lit(1)).try_cast("int")
    return F.when(F.size(clock) == 2, minutes * 60 + seconds + millis)


def _millis(seconds: Column) -> Column:
    """Milliseconds past the whole second, cut off rather than rounded."""
    return ((seconds - F.floor(seconds)) * 1000).cast("int")


def _minutes(seconds: Column) -> Column:
    return F.round((seconds - seconds % 60) / 60).cast("int")


def format_time(seconds: Column) -> Column:
    """``m:ss`` or ``m:ss.mmm`` when there are milliseconds."""
    rest = seconds % 60
    clock = F.format_string("%d:%02d", _minutes(seconds), rest.cast("int"))
    millis = _millis(rest)
    text = F.when(millis > 0, F.concat(clock, F.format_string(".%03d", millis))).otherwise(clock)
    return F.when(seconds.isNotNull(), text)


def format_gap(leader_time: Column, time: Column) -> Column:
    """``+mm:ss.mmm`` behind the leader; level with the leader shows the time itself."""
    gap = time - leader_time
    behind = F.format_string("+%02d:%02d.%03d", _minutes(gap), (gap % 60).cast("int"), _millis(gap))
    return (
        F.when(leader_time.isNull(), F.lit(None).cast("string"))
        .when(time.isNull(), F.lit("DNF"))
        .when(time == leader_time, format_time(leader_time))
        .otherwise(behind)
    )


def has_been_raced(date: Column, as_of: Column) -> Column:
    """True once three hours have passed since the start."""
    return as_of > date + F.expr("INTERVAL 3 HOURS")


def expires_at(moment: Column, seconds: Column) -> Column:
    """Instant a grant of ``seconds`` runs out."""
    return moment + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def local_to_utc(text: Column, zone: str = SCHEDULE_ZONE) -> Column:
    """Local wall-clock text of the schedule form as a zone-free UTC timestamp."""
    local = F.try_to_timestamp(text, F.lit(SCHEDULE_FORMAT)).cast("timestamp_ntz")
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def _end_of_next_day(moment: Column) -> Column:
    left_today = F.make_dt_interval(
        F.lit(1),
        F.lit(23) - F.hour(moment),
        F.lit(59) - F.minute(moment),
        F.lit(59) - F.extract(F.lit("SECOND"), moment),
    )
    return moment + left_today


def report_deadline(date: Column, zone: str = "UTC") -> Column:
    """23:59:59 on the day after the race, in the league's zone (dates are UTC)."""
    if zone == "UTC":
        return _end_of_next_day(date)
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), date)
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), _end_of_next_day(local))


def message_time(moment: Column) -> Column:
    return F.date_format(moment, MESSAGE_FORMAT)
