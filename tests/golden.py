"""A hand-written league: one season, a feature and a sprint at one instant, a future race."""

from __future__ import annotations

from datetime import datetime

from paddock.schema import TABLES
from paddock.sources.tables import League, league_of

START = datetime(2024, 5, 4, 16, 0)
FUTURE = datetime(2024, 7, 6, 16, 0)
AS_OF = "2024-06-01 00:00:00"

ROWS: dict[str, list[tuple]] = {
    "drivers": [(f"d{n}", f"Driver {n}") for n in range(1, 7)],
    "teams": [("A", "Alpha", "#aa0000", "a.svg"), ("B", "Beta", "#00bb00", "b.svg"), ("C", "Gamma", "#0000cc", "c.svg")],
    "tracks": [
        ("t1", "Spa", "be", None, "Belgian GP", ":be:"),
        ("t2", "Monza", "it", None, "Italian GP", ":it:"),
    ],
    "seasons": [("s1", "Season 1/A b", "r1")],
    "seasons_drivers": [
        ("d1", "s1", "A", False),
        ("d2", "s1", "A", False),
        ("d3", "s1", "B", False),
        ("d4", "s1", "B", False),
        ("d5", "s1", None, True),
    ],
    "races": [
        ("feature", START, False, "t1", "s1"),
        ("sprint", START, True, "t1", "s1"),
        ("future", FUTURE, False, "t2", "s1"),
    ],
    # feature: d1 and d2 level on top after d2's penalty; d3 fastest but disqualified; d4 retired;
    # d6 is not rostered. sprint: d5 replaces d2; d4 did not enter.
    "races_drivers": [
        ("feature", "d1", "A", 5005.0, 0, False, False),
        ("feature", "d2", "A", 5000.0, 0, True, False),
        ("feature", "d3", "B", 4990.0, 0, False, True),
        ("feature", "d4", "B", None, 0, False, False),
        ("feature", "d6", "B", 5010.0, 1, False, None),
        ("sprint", "d1", "A", 1500.5, 0, False, False),
        ("sprint", "d5", "A", 1499.75, 0, True, False),
        ("sprint", "d3", "B", 1501.0, 0, False, False),
        ("future", "d1", "A", None, None, False, False),
        ("future", "d2", "A", None, None, False, False),
    ],
    "reports": [
        ("p1", "feature", "d1", "contact", "https://youtu.be/abc++/media/reports/p1clip.mp4", "5 s", datetime(2024, 5, 4, 20, 0)),
        ("p2", "feature", "d2", "lag", None, None, datetime(2024, 5, 5, 23, 59, 59)),
        ("p3", "feature", "d4", "cut", "https://medal.tv/games/x/clips/1", "points", datetime(2024, 5, 4, 19, 0)),
        ("p4", "feature", "d5", "noise", None, None, datetime(2024, 5, 4, 21, 0)),
        ("p5", "feature", "d3", "early", None, None, START),
        ("p6", "feature", "d3", "late", None, None, datetime(2024, 5, 6, 0, 0)),
    ],
    "report_targets": [
        ("p1", "d2"),
        ("p2", None),
        ("p3", "d3"),
        ("p3", "d1"),
        ("p4", "d1"),
        ("p5", "d1"),
        ("p6", "d1"),
    ],
    "report_responses": [
        ("r1", "p1", "d2", "no", None, datetime(2024, 5, 4, 22, 0)),
        ("r2", "p2", "d1", "yes", None, datetime(2024, 5, 5, 23, 59, 59)),
        ("r3", "p2", "d2", "me too", "https://example.com/x", datetime(2024, 5, 6, 1, 0)),
        ("r4", "p3", "d3", "not me", None, datetime(2024, 5, 5, 18, 59)),
        ("r5", "p4", "d1", "what", None, datetime(2024, 5, 4, 22, 0)),
    ],
    "penalties": [
        ("p1", "d2", 5, 2, False),
        ("p3", "d3", None, 3, True),
        ("p3", "d4", 10, 1, False),
        ("p3", "d1", None, 0, False),
    ],
    "users": [
        ("u1", "one", "d1", "a1"),
        ("u2", "two", "d2", None),
        ("u3", "three", "d3", None),
        ("u6", "six", "d6", None),
        ("u9", "nobody", None, None),
    ],
    "roles": [("r1", "Season 1/A bfia"), ("r2", "admin")],
    "users_roles": [("u6", "r1"), ("u1", "r2"), ("u6", "r2")],
    "discord_accounts": [("a1", "111", "u1"), ("a2", "222", "u2")],
}


def league(spark) -> League:
    return league_of(**{name: spark.createDataFrame(ROWS[name], ddl) for name, ddl in TABLES.items()})
