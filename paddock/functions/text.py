"""Names, links and message text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifiers, separators and words shown to users.
UUID_PATTERN = r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z"
VIDEO_SEPARATOR = "++"
GAME_ID = "hra"
GAME_NAME = "Hra"
STEWARD_SUFFIX = "fia"

# RFC 3986, appendix B: scheme, authority, path, query and fragment of a URL.
HOST_PATTERN = r"^(?:[^:/?#]+:)?//([^/?#]*)"
URL_PATTERN = r"^(?:[^:/?#]+:)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?"


def is_canonical_uuid(text: Column) -> Column:
    """True for a lower-case, hyphenated UUID."""
    return F.coalesce(text.rlike(UUID_PATTERN), F.lit(False))


def decode_name(text: Column) -> Column:
    """Percent-decoding that leaves ``+`` alone."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def encode_name(text: Column) -> Column:
    """Percent-encoding for a URL path: blanks as ``%20``, slashes kept."""
    encoded = F.url_encode(text)
    for found, wanted in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(found), F.lit(wanted))
    return encoded


def steward_role_name(season_name: Column) -> Column:
    return F.concat(season_name, F.lit(STEWARD_SUFFIX))


def split_videos(video_path: Column) -> Column:
    """The video list of a report; null stays null."""
    return F.split(video_path, r"\+\+")


def join_videos(videos: Column) -> Column:
    return F.array_join(videos, VIDEO_SEPARATOR)


def _query_value(query: Column, name: str) -> Column:
    raw = F.regexp_extract(query, rf"(?:^|&){name}=([^&]+)", 1)
    return F.when(raw != "", F.try_url_decode(raw))


def url_host(url: Column) -> Column:
    """Host of a URL, empty where it has none."""
    return F.regexp_extract(url, HOST_PATTERN, 1)


def embed_url(url: Column, host: Column, embed_parent: str) -> Column:
    """Player address of a video page, or null where the host has none.

    ``host`` is taken as a column of its own because every branch tests it.
    """
    path = F.regexp_extract(url, URL_PATTERN, 2)
    query = F.regexp_extract(url, URL_PATTERN, 3)

    live = F.when(path.contains("/live/"), F.substring_index(path, "live/", -1))
    video = F.coalesce(F.nullif(live, F.lit("")), _query_value(query, "v"))
    start = F.coalesce(_query_value(query, "t"), _query_value(query, "start"))
    youtube = F.concat(
        F.lit("https://www.youtube.com/embed/"),
        video,
        F.coalesce(F.concat(F.lit("?start="), start), F.lit("")),
    )

    def player(prefix: str, suffix: str = "") -> Column:
        slug = F.nullif(F.ltrim(path, F.lit("/")), F.lit(""))
        return F.concat(F.lit(prefix), slug, F.lit(suffix))

    return (
        F.when(host.contains("youtube.com"), youtube)
        .when(host.contains("youtu.be"), player("https://www.youtube.com/embed/"))
        .when(host.contains("streamable.com"), player("https://streamable.com/e/"))
        .when(host.contains("medal.tv"), F.replace(url, F.lit("clips"), F.lit("clip")))
        .when(host.contains("outplayed.tv"), url)
        .when(
            host.contains("clips.twitch.tv"),
            player("https://clips.twitch.tv/embed?clip=", f"&parent={embed_parent}"),
        )
    )


def mention(driver_id: Column, driver_name: Column, account: Column) -> Column:
    """One line naming a report's target: the game, a linked account or a plain name."""
    named = F.coalesce(F.concat(F.lit("<@"), account.cast("string"), F.lit(">")), driver_name)
    return F.concat(F.lit("- "), F.when(driver_id.isNull(), F.lit(GAME_NAME)).otherwise(named))


def report_link(base_url: str, season_name: Column, race_id: Column, rank: Column) -> Column:
    return F.concat(
        F.lit(f"{base_url}/seasons/"),
        encode_name(season_name),
        F.lit("/race/"),
        race_id.cast("string"),
        F.lit("/reports?report="),
        rank.cast("string"),
    )
