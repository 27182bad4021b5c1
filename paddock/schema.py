"""League tables: columns, keys, foreign keys and text lengths."""

from __future__ import annotations

# Keys are strings in a live league; any orderable key type works.
TABLES: dict[str, str] = {
    "drivers": "id string, name string",
    "teams": "id string, name string, color string, icon string",
    "tracks": "id string, name string, flag string, image string, race_name string, emoji string",
    "seasons": "id string, name string, fia_role_id string",
    "seasons_drivers": "driver_id string, season_id string, team_id string, is_reserve boolean",
    "races": "id string, date timestamp_ntz, is_sprint boolean, track_id string, season_id string",
    "races_drivers": (
        "race_id string, driver_id string, team_id string, time double, plus_laps int,"
        " has_fastest_lap boolean, is_dsq boolean"
    ),
    "reports": (
        "id string, race_id string, from_driver string, content string, video_path string,"
        " verdict string, created_at timestamp_ntz"
    ),
    "report_targets": "report_id string, driver_id string",
    "report_responses": (
        "id string, report_id string, from_driver string, content string, video_path string, created_at timestamp_ntz"
    ),
    "penalties": (
        "report_id string, driver_id string, time int, penalty_points int, is_dsq boolean"
    ),
    "users": "id string, username string, driver_id string, discord_account_id string",
    "roles": "id string, name string",
    "users_roles": "user_id string, role_id string",
    "discord_accounts": "id string, discord_id string, user_id string",
}


def columns(table: str) -> list[str]:
    return [column.split()[0] for column in TABLES[table].split(",")]


UNIQUE_KEYS: dict[str, list[tuple[str, ...]]] = {
    "drivers": [("id",), ("name",)],
    "teams": [("id",), ("name",)],
    "tracks": [("id",)],
    "seasons": [("id",), ("name",)],
    "seasons_drivers": [("driver_id", "season_id")],
    "races": [("id",), ("season_id", "date", "is_sprint")],
    "races_drivers": [("race_id", "driver_id")],
    "reports": [("id",)],
    "penalties": [("driver_id", "report_id")],
    "report_responses": [("id",)],
    "users": [("id",), ("username",), ("driver_id",)],
    "roles": [("id",), ("name",)],
    "users_roles": [("user_id", "role_id")],
    "discord_accounts": [("id",), ("discord_id",)],
}

FOREIGN_KEYS: list[tuple[str, str, str]] = [
    ("seasons_drivers", "driver_id", "drivers"),
    ("seasons_drivers", "season_id", "seasons"),
    ("seasons_drivers", "team_id", "teams"),
    ("races", "track_id", "tracks"),
    ("races", "season_id", "seasons"),
    ("races_drivers", "race_id", "races"),
    ("races_drivers", "driver_id", "drivers"),
    ("races_drivers", "team_id", "teams"),
    ("reports", "race_id", "races"),
    ("reports", "from_driver", "drivers"),
    ("report_targets", "report_id", "reports"),
    ("report_targets", "driver_id", "drivers"),
    ("report_responses", "report_id", "reports"),
    ("report_responses", "from_driver", "drivers"),
    ("penalties", "report_id", "reports"),
    ("penalties", "driver_id", "drivers"),
    ("users", "driver_id", "drivers"),
    ("users", "discord_account_id", "discord_accounts"),
    ("discord_accounts", "user_id", "users"),
    ("seasons", "fia_role_id", "roles"),
    ("users_roles", "user_id", "users"),
    ("users_roles", "role_id", "roles"),
]

# Longest text each column may hold.
MAX_LENGTHS: dict[str, dict[str, int]] = {
    "drivers": {"name": 50},
    "teams": {"name": 100, "color": 7},
    "tracks": {"name": 50, "emoji": 9},
    "seasons": {"name": 50},
    "users": {"username": 50},
    "roles": {"name": 54},
}
