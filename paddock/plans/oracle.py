"""SQL for DuckDB that computes the registered queries on its own from the given tables."""

from __future__ import annotations

# The league's tables, derived as FIXTURES.md says.
TABLES = """
WITH ord AS (
  SELECT o_orderkey, o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS season_id,
         CAST(month(o_orderdate) AS INTEGER) AS mon, o_orderpriority = '1-URGENT' AS is_sprint,
         CAST(year(o_orderdate) * 1000 + month(o_orderdate) * 10 + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS INTEGER) AS race_id,
         date_trunc('month', o_orderdate) + INTERVAL 18 HOUR AS race_date
  FROM orders
),
races AS (
  SELECT DISTINCT race_id AS id, race_date AS date, is_sprint, CAST(mon AS BIGINT) AS track_id, season_id FROM ord
),
seasons AS (
  SELECT DISTINCT season_id AS id, 'Season ' || season_id AS name, season_id AS fia_role_id FROM ord
),
drivers AS (SELECT s_suppkey AS id, s_name AS name FROM supplier),
teams AS (
  SELECT n_nationkey AS id, n_name AS name,
         '#' || lpad(CAST(n_nationkey * 40503 % 1000000 AS VARCHAR), 6, '0') AS color, 'icon' || n_nationkey AS icon
  FROM nation
),
tracks AS (
  SELECT p_partkey AS id, p_name AS name, p_brand AS flag, CAST(NULL AS VARCHAR) AS image,
         'GP ' || p_partkey AS race_name, p_type AS emoji
  FROM part
),
shipped AS (
  SELECT race_id, l_suppkey AS driver_id, sum(l_partkey) AS k, min(l_extendedprice) AS price, max(l_quantity) AS quantity
  FROM lineitem JOIN ord ON l_orderkey = o_orderkey GROUP BY ALL
),
races_drivers AS (
  SELECT race_id, driver_id, s_nationkey AS team_id,
         CASE WHEN k % 10 <> 0 THEN 4800 + floor(price / 25) / 4 END AS time,
         CAST(k % 3 AS INTEGER) AS plus_laps,
         row_number() OVER (PARTITION BY race_id ORDER BY quantity DESC, driver_id) = 1 AS has_fastest_lap,
         k % 37 = 1 AS is_dsq
  FROM shipped JOIN supplier ON s_suppkey = driver_id
),
seasons_drivers AS (
  SELECT DISTINCT driver_id, season_id, CASE WHEN driver_id % 5 <> 4 THEN team_id END AS team_id, driver_id % 5 = 4 AS is_reserve
  FROM races_drivers rd JOIN races r ON r.id = rd.race_id WHERE team_id <> season_id - 1995
),
suppliers_of AS (SELECT l_orderkey AS k, min(l_suppkey) AS lo, max(l_suppkey) AS hi FROM lineitem GROUP BY 1),
reports AS (
  SELECT o_orderkey AS id, race_id, lo AS from_driver, 'report ' || o_orderkey AS content,
         (CASE o_orderkey % 7
            WHEN 0 THEN 'https://www.youtube.com/watch?v=v' || o_orderkey || '&t=30'
            WHEN 1 THEN 'https://www.youtube.com/live/v' || o_orderkey
            WHEN 2 THEN 'https://youtu.be/v' || o_orderkey
            WHEN 3 THEN 'https://streamable.com/s' || o_orderkey
            WHEN 4 THEN 'https://medal.tv/games/x/clips/m' || o_orderkey
            WHEN 5 THEN 'https://outplayed.tv/o' || o_orderkey
            ELSE 'https://clips.twitch.tv/t' || o_orderkey END)
         || CASE WHEN o_orderkey % 3 = 0 THEN '++https://example.com/' || o_orderkey ELSE '' END
         || CASE o_orderkey % 5 WHEN 0 THEN '++/media/reports/' || o_orderkey || '.mp4' WHEN 1 THEN '++https://clips.example/media/' || o_orderkey ELSE '' END AS video_path,
         CASE WHEN o_orderstatus <> 'O' THEN 'verdict ' || o_orderkey END AS verdict,
         race_date + to_hours(CAST((o_orderkey // 20) % 60 - 6 AS INTEGER)) AS created_at
  FROM ord JOIN suppliers_of ON k = o_orderkey
),
report_targets AS (
  SELECT DISTINCT l_orderkey AS report_id, CASE WHEN lo <> hi THEN l_suppkey END AS driver_id
  FROM lineitem JOIN suppliers_of ON k = l_orderkey JOIN ord ON o_orderkey = l_orderkey
  WHERE lo = hi OR l_suppkey <> lo
),
penalties AS (
  SELECT report_id, t.driver_id, CAST(CASE WHEN (t.driver_id + report_id) % 7 <> 0 THEN (t.driver_id + report_id) % 4 * 5 END AS INTEGER) AS time,
         CAST((t.driver_id + report_id) % 4 AS INTEGER) AS penalty_points, (t.driver_id + report_id) % 29 = 0 AS is_dsq
  FROM report_targets t JOIN reports r ON r.id = report_id WHERE verdict IS NOT NULL AND t.driver_id IS NOT NULL
),
report_responses AS (
  SELECT report_id || '-' || t.driver_id AS id, report_id, t.driver_id AS from_driver, 'response ' || t.driver_id || ' to ' || report_id AS content,
         (CASE t.driver_id % 7
            WHEN 0 THEN 'https://www.youtube.com/watch?v=v' || t.driver_id || '&t=30'
            WHEN 1 THEN 'https://www.youtube.com/live/v' || t.driver_id
            WHEN 2 THEN 'https://youtu.be/v' || t.driver_id
            WHEN 3 THEN 'https://streamable.com/s' || t.driver_id
            WHEN 4 THEN 'https://medal.tv/games/x/clips/m' || t.driver_id
            WHEN 5 THEN 'https://outplayed.tv/o' || t.driver_id
            ELSE 'https://clips.twitch.tv/t' || t.driver_id END)
         || CASE WHEN t.driver_id % 3 = 0 THEN '++https://example.com/' || t.driver_id ELSE '' END
         || CASE t.driver_id % 5 WHEN 0 THEN '++/media/reports/' || t.driver_id || '.mp4' WHEN 1 THEN '++https://clips.example/media/' || t.driver_id ELSE '' END AS video_path,
         created_at + to_hours(CAST((t.driver_id * 7 + report_id) % 48 AS INTEGER)) AS created_at
  FROM report_targets t JOIN reports r ON r.id = report_id WHERE t.driver_id IS NOT NULL
),
users AS (
  SELECT c_custkey AS id, c_name AS username, CASE WHEN c_mktsegment <> 'MACHINERY' THEN s_suppkey END AS driver_id,
         CASE WHEN c_acctbal >= 5000 THEN c_custkey END AS discord_account_id
  FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey
),
roles AS (
  SELECT id, name || 'fia' AS name FROM seasons UNION ALL SELECT r_regionkey, r_name FROM region
),
users_roles AS (
  SELECT c_custkey AS user_id, CAST(c_custkey % 7 + 1995 AS INTEGER) AS role_id FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT c_custkey, c_nationkey % 5 FROM customer
),
discord_accounts AS (
  SELECT c_custkey AS id, 1000000000000000 + c_custkey AS discord_id,
         CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_custkey END AS user_id
  FROM customer
),
pen AS (
  SELECT p.driver_id, r.race_id, CAST(sum(p.time) AS BIGINT) AS penalty_time, CAST(sum(p.penalty_points) AS BIGINT) AS points
  FROM penalties p JOIN reports r ON r.id = p.report_id GROUP BY ALL
),
classified AS (
  SELECT rd.* EXCLUDE (time), rd.time AS raw_time, rd.time + coalesce(penalty_time, 0) AS time, r.season_id, r.is_sprint, r.date,
         CAST(row_number() OVER (PARTITION BY rd.race_id ORDER BY is_dsq NULLS LAST, rd.time + coalesce(penalty_time, 0) NULLS LAST, rd.driver_id) AS INTEGER) AS rank,
         rank() OVER (PARTITION BY rd.race_id ORDER BY is_dsq NULLS LAST, rd.time + coalesce(penalty_time, 0) NULLS LAST) AS shared_rank
  FROM races_drivers rd JOIN races r ON r.id = rd.race_id LEFT JOIN pen ON pen.race_id = rd.race_id AND pen.driver_id = rd.driver_id
),
feature_points(place, pts) AS (VALUES (1, 25), (2, 18), (3, 15), (4, 12), (5, 10), (6, 8), (7, 6), (8, 4), (9, 2), (10, 1)),
scored AS (
  SELECT c.*,
    CAST(CASE WHEN time IS NULL OR is_dsq THEN 0
         WHEN is_sprint THEN greatest(9 - rank, 0)
         ELSE coalesce(f.pts, 0) + CASE WHEN has_fastest_lap AND rank <= 10 THEN 1 ELSE 0 END END AS BIGINT) AS points,
    CAST(CASE WHEN time IS NULL OR is_dsq THEN 0
         WHEN is_sprint THEN greatest(9 - shared_rank, 0)
         ELSE coalesce(g.pts, 0) + CASE WHEN has_fastest_lap AND shared_rank <= 10 THEN 1 ELSE 0 END END AS BIGINT) AS team_points
  FROM classified c LEFT JOIN feature_points f ON f.place = rank LEFT JOIN feature_points g ON g.place = shared_rank
),
header AS (
  SELECT r.id AS race_id, season_id, track_id, date, is_sprint, flag,
         CAST(row_number() OVER (PARTITION BY season_id ORDER BY date, is_sprint DESC, r.id) AS INTEGER) AS race_no
  FROM races r JOIN tracks t ON t.id = track_id
),
seats AS (
  SELECT sd.season_id, sd.driver_id, d.name AS driver_name, sd.is_reserve, t.color,
         CAST(coalesce(sum(points), 0) AS BIGINT) AS points_total,
         CAST(count(*) FILTER (WHERE rank = 1 AND time IS NOT NULL AND NOT s.is_dsq) AS BIGINT) AS wins_count,
         avg(rank) AS avg_position
  FROM seasons_drivers sd JOIN drivers d ON d.id = sd.driver_id LEFT JOIN teams t ON t.id = sd.team_id
  LEFT JOIN scored s ON s.season_id = sd.season_id AND s.driver_id = sd.driver_id
  GROUP BY ALL
),
ranked_seats AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY season_id ORDER BY points_total DESC, wins_count DESC, avg_position NULLS LAST,
                                    is_reserve NULLS LAST, driver_name NULLS LAST, driver_id) AS INTEGER) AS position
  FROM seats
),
cells AS (
  SELECT p.*, h.race_id, h.race_no, h.track_id, h.flag, h.date, h.is_sprint,
         count(*) OVER (PARTITION BY p.season_id, p.driver_id) AS race_count,
         TIMESTAMP '2000-06-15 00:00:00' > h.date + INTERVAL 3 HOUR AS has_been_raced,
         t.name AS team_name, s.raw_time AS time, s.has_fastest_lap, s.rank, coalesce(s.points, 0) AS points, s.is_dsq,
         CASE WHEN s.is_dsq THEN 'DSQ' WHEN t.name IS NULL AND p.is_reserve THEN '' WHEN t.name IS NULL THEN 'DNS'
              WHEN s.raw_time IS NULL THEN 'DNF' ELSE CAST(s.rank AS VARCHAR) END AS cell,
         CASE WHEN NOT (p.is_reserve AND t.name IS NULL) THEN coalesce(s.points, 0) END AS cell_points
  FROM ranked_seats p JOIN header h ON h.season_id = p.season_id
  LEFT JOIN scored s ON s.race_id = h.race_id AND s.driver_id = p.driver_id LEFT JOIN teams t ON t.id = s.team_id
),
constructors AS (
  SELECT s.id AS season_id, t.id AS team_id, t.color, t.name, t.icon, CAST(sum(team_points) AS BIGINT) AS earned
  FROM seasons s CROSS JOIN teams t LEFT JOIN scored c ON c.season_id = s.id AND c.team_id = t.id GROUP BY ALL
),
numbered AS (
  SELECT id AS report_id, race_id, created_at,
         CAST(row_number() OVER (PARTITION BY race_id ORDER BY created_at, id) AS INTEGER) AS rank
  FROM reports
),
named_targets AS (
  SELECT report_id, t.driver_id, CASE WHEN t.driver_id IS NULL THEN 'hra' ELSE CAST(t.driver_id AS VARCHAR) END AS target_id,
         CASE WHEN t.driver_id IS NULL THEN 'Hra' ELSE d.name END AS target_name
  FROM report_targets t LEFT JOIN drivers d ON d.id = t.driver_id
),
accounts AS (
  SELECT u.driver_id, min(coalesce(a.discord_id, b.discord_id)) AS account
  FROM users u LEFT JOIN discord_accounts a ON a.id = u.discord_account_id LEFT JOIN discord_accounts b ON b.user_id = u.id
  WHERE u.driver_id IS NOT NULL GROUP BY 1
),
mention_lines AS (
  SELECT report_id, t.driver_id,
         '- ' || CASE WHEN t.driver_id IS NULL THEN 'Hra' ELSE coalesce('<@' || account || '>', target_name) END AS line
  FROM named_targets t LEFT JOIN accounts a ON a.driver_id = t.driver_id
),
mentions AS (
  SELECT report_id, string_agg(line, chr(10) ORDER BY driver_id NULLS LAST) AS mentions FROM mention_lines GROUP BY 1
),
gated AS (
  SELECT r.*, race.date AS race_date,
    CASE WHEN e.driver_id IS NULL THEN 'not_entered' WHEN r.created_at <= race.date THEN 'too_early'
         WHEN r.created_at > date_trunc('day', race.date) + INTERVAL 2 DAY - INTERVAL 1 SECOND THEN 'too_late' ELSE 'accepted' END AS gate
  FROM reports r JOIN races race ON race.id = r.race_id
  LEFT JOIN races_drivers e ON e.race_id = r.race_id AND e.driver_id = r.from_driver
),
gated_responses AS (
  SELECT p.report_id, p.from_driver, p.content, p.created_at,
    CASE WHEN g.id IS NULL THEN 'no_report' WHEN e.driver_id IS NULL THEN 'not_entered'
         WHEN p.created_at <= g.race_date THEN 'too_early'
         WHEN p.created_at < date_trunc('day', g.race_date) + INTERVAL 2 DAY - INTERVAL 1 SECOND THEN 'accepted'
         WHEN p.created_at < g.created_at + INTERVAL 1 DAY AND EXISTS (
           SELECT 1 FROM report_targets t WHERE t.report_id = p.report_id AND t.driver_id = p.from_driver) THEN 'accepted'
         ELSE 'too_late' END AS gate
  FROM report_responses p LEFT JOIN gated g ON g.id = p.report_id AND g.gate = 'accepted'
  LEFT JOIN races_drivers e ON e.race_id = g.race_id AND e.driver_id = p.from_driver
),
leaders AS (SELECT race_id, min(time) AS leader_time FROM races_drivers GROUP BY 1),
clock AS (
  SELECT rd.*, leader_time,
         CASE WHEN rd.time IS NOT NULL THEN CAST(floor(rd.time / 60) AS INTEGER) || ':' || lpad(CAST(CAST(floor(rd.time % 60) AS INTEGER) AS VARCHAR), 2, '0')
           || CASE WHEN rd.time % 1 > 0 THEN '.' || lpad(CAST(CAST((rd.time % 1) * 1000 AS INTEGER) AS VARCHAR), 3, '0') ELSE '' END END AS time_text,
         '+' || lpad(CAST(CAST(floor((rd.time - leader_time) / 60) AS INTEGER) AS VARCHAR), 2, '0') || ':'
             || lpad(CAST(CAST(floor((rd.time - leader_time) % 60) AS INTEGER) AS VARCHAR), 2, '0') || '.'
             || lpad(CAST(CAST(((rd.time - leader_time) % 1) * 1000 AS INTEGER) AS VARCHAR), 3, '0') AS behind
  FROM races_drivers rd JOIN leaders l ON l.race_id = rd.race_id
),
gaps AS (
  SELECT *, CASE WHEN leader_time IS NULL THEN NULL WHEN time IS NULL THEN 'DNF' WHEN time = leader_time THEN time_text ELSE behind END AS gap
  FROM clock
),
changed_drivers AS (
  SELECT coalesce(d.id, n.id) AS id, coalesce(n.name, d.name) AS name
  FROM drivers d FULL JOIN (
    SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS op, 'Driver of order ' || max(o_orderkey) AS name
    FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1
  ) n ON n.id = d.id
  WHERE n.id IS NULL OR (n.op <> 'O' AND NOT (d.id IS NULL AND n.op = 'F'))
),
listed AS (
  SELECT race_id, driver_id, team_id FROM races_drivers
  UNION ALL SELECT race_id, driver_id, team_id FROM races_drivers WHERE is_dsq AND has_fastest_lap
),
ids AS (
  SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN upper(h) WHEN '5-LOW' THEN md5(CAST(o_orderkey AS VARCHAR)) ELSE h END AS id_text
  FROM (SELECT *, regexp_replace(md5(CAST(o_orderkey AS VARCHAR)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS h FROM orders)
),
senders AS (SELECT id AS user_id, driver_id FROM users WHERE driver_id IS NOT NULL),
videos AS (
  SELECT id AS report_id, unnest(string_split(video_path, '++')) AS path, generate_subscripts(string_split(video_path, '++'), 1) - 1 AS video_no
  FROM reports
),
punished AS (
  SELECT report_id, race_id, driver_id, s, row_number() OVER (PARTITION BY report_id, driver_id ORDER BY s % 3 * 5, s % 5, s % 2 = 0) AS n
  FROM (
    SELECT report_id, min(driver_id) AS driver_id, min(driver_id) + report_id AS s FROM report_targets GROUP BY 1
    UNION ALL SELECT report_id, max(driver_id), max(driver_id) + report_id FROM report_targets GROUP BY 1 HAVING min(driver_id) <> max(driver_id)
    UNION ALL SELECT report_id, min(driver_id), min(driver_id) + report_id + 1 FROM report_targets WHERE report_id % 3 = 0 GROUP BY 1
  ) JOIN reports ON id = report_id WHERE verdict IS NULL AND driver_id IS NOT NULL
),
posted AS (
  SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY time NULLS LAST, driver_id) = 1 AS first,
         leader_time IS NOT NULL AND first_value(driver_id) OVER (PARTITION BY race_id ORDER BY time NULLS LAST, driver_id) % 10 <> 3 AS ok
  FROM gaps
),
weekends AS (
  SELECT season_id, date, track_id, k.is_sprint, CAST(timezone('UTC', timezone('Europe/Budapest', date)) AS TIMESTAMP) AS utc
  FROM (SELECT season_id, date, track_id, bool_or(is_sprint) AS has_sprint FROM races GROUP BY ALL) w
  JOIN (VALUES (false), (true)) k(is_sprint) ON has_sprint OR NOT k.is_sprint
),
entered AS (
  SELECT driver_id, season_id, any_value(team_id = season_id - 1995) AS unseated, count(*) AS races,
         arg_max(CASE WHEN is_dsq THEN -1 ELSE team_id END, race_id) AS last_team
  FROM races_drivers JOIN races ON id = race_id GROUP BY ALL
),
new_stewards AS (
  SELECT sd.season_id, sd.driver_id, user_id FROM seasons_drivers sd JOIN senders s ON s.driver_id = sd.driver_id WHERE is_reserve
)
"""


def _embed(path: str) -> str:
    """Player address of the hosts the derived reports use."""
    return f"""CASE
      WHEN {path} LIKE 'https://www.youtube.com/watch?v=%' THEN
        'https://www.youtube.com/embed/' || regexp_extract({path}, 'v=([^&]*)&t=(.*)', 1) || '?start=' || regexp_extract({path}, 'v=([^&]*)&t=(.*)', 2)
      WHEN {path} LIKE 'https://www.youtube.com/live/%' THEN replace({path}, '/live/', '/embed/')
      WHEN {path} LIKE 'https://youtu.be/%' THEN replace({path}, 'https://youtu.be/', 'https://www.youtube.com/embed/')
      WHEN {path} LIKE 'https://streamable.com/%' THEN replace({path}, '.com/', '.com/e/')
      WHEN {path} LIKE 'https://medal.tv/%' THEN replace({path}, 'clips', 'clip')
      WHEN {path} LIKE 'https://outplayed.tv/%' THEN {path}
      WHEN {path} LIKE 'https://clips.twitch.tv/%' THEN replace({path}, '.tv/', '.tv/embed?clip=') || '&parent=league.example'
      END"""


def _video(v: str) -> tuple[str, str, str]:
    """is_local, url and embed of a video address."""
    player = _embed(v)
    local = f"starts_with({v}, '/media/')"
    return local, f"CASE WHEN {local} THEN substr({v}, 8) ELSE coalesce({player}, {v}) END", f"NOT {local} AND {player} IS NOT NULL"


def _video_json(column: str) -> str:
    local, url, embed = _video("v")
    return (
        f"CAST(to_json(list_transform(string_split({column}, '++'),"
        f" lambda v: {{'is_local': {local}, 'url': {url}, 'embed': {embed}}})) AS VARCHAR)"
    )


_LINK = "'https://league.example/seasons/Season%20' || season_id || '/race/' || n.race_id || '/reports?report=' || n.rank"
_HEADING = "'## ' || tr.emoji || ' ' || tr.race_name || ', Report #' || n.rank"
_FEED = """
  FROM reports r JOIN numbered n ON n.report_id = r.id JOIN races ra ON ra.id = r.race_id
  JOIN tracks tr ON tr.id = ra.track_id JOIN drivers d ON d.id = r.from_driver
  LEFT JOIN mentions m ON m.report_id = r.id LEFT JOIN accounts a ON a.driver_id = r.from_driver
"""
_REPORT_MESSAGE = (
    f"{_HEADING} || chr(10) || '*' || strftime(n.created_at, '%d.%m.%y %H:%M:%S') || '*' || chr(10) || chr(10)"
    f" || 'Na koho: ' || chr(10) || mentions || chr(10) || chr(10) || 'Viac info [na tomto odkaze](' || {_LINK} || ')'"
)
_VERDICT_MESSAGE = (
    f"{_HEADING} || chr(10) || chr(10) || '### Pridané rozhodnutie' || chr(10) || chr(10) || 'Účastníci:' || chr(10)"
    f" || '- ' || coalesce('<@' || account || '>', d.name) || chr(10) || mentions"
    f" || chr(10) || chr(10) || 'Viac info [na tomto odkaze](' || {_LINK} || ')'"
)

_TARGETS_JSON = (
    "(SELECT report_id, CAST(to_json(list({'target_id': target_id, 'target_name': target_name}"
    " ORDER BY driver_id NULLS LAST)) AS VARCHAR) AS targets FROM named_targets GROUP BY 1)"
)


def _absent(people: str, key: str, taken: str) -> str:
    return (
        f"FROM seasons s CROSS JOIN {people} p WHERE NOT EXISTS"
        f" (SELECT 1 FROM seasons_drivers sd WHERE sd.season_id = s.id AND sd.driver_id = p.{key} {taken})"
    )


def _orphans(child: str, column: str, parent: str = "drivers") -> str:
    return (
        f"SELECT '{child}' AS table_name, '{column}' AS column_name, '{parent}' AS parent_table,"
        f" CAST({column} AS VARCHAR) AS value, count(*) AS row_count FROM {child}"
        f" WHERE {column} NOT IN (SELECT id FROM changed_drivers) GROUP BY ALL"
    )


_SELECTS: dict[str, str] = {
    "penalty_time_totals": "SELECT driver_id, race_id, penalty_time FROM pen",
    "race_classification": "SELECT race_id, driver_id, team_id, time, is_dsq, rank FROM classified",
    "race_results": """
      SELECT race_id, c.driver_id, d.name AS driver_name, time AS result_time, rank, has_fastest_lap, t.name AS team_name,
             is_sprint, plus_laps, is_dsq, TIMESTAMP '2000-06-15 00:00:00' > date + INTERVAL 3 HOUR AS has_been_raced
      FROM classified c JOIN drivers d ON d.id = c.driver_id JOIN teams t ON t.id = c.team_id""",
    "race_wins": """
      SELECT season_id, driver_id, count(*) AS wins_count FROM classified
      WHERE rank = 1 AND time IS NOT NULL AND NOT is_dsq GROUP BY ALL""",
    "race_wins_pg_compat": "SELECT season_id, driver_id, count(*) AS wins_count FROM classified WHERE rank = 1 GROUP BY ALL",
    "driver_race_points": """
      SELECT season_id, driver_id, race_id, driver_name, is_reserve, track_id, flag, date, team_name, time,
             has_fastest_lap, rank, points, is_dsq FROM cells""",
    "team_colors": """
      SELECT season_id, driver_id, color FROM seasons_drivers sd LEFT JOIN teams t ON t.id = sd.team_id""",
    "avg_finish_position": "SELECT season_id, driver_id, avg_position, is_reserve FROM seats",
    "driver_standings_long": """
      SELECT season_id, driver_id, race_id, position, race_no, driver_name, is_reserve, color, points_total, wins_count,
             avg_position, race_count, track_id, flag, date, is_sprint, has_been_raced, team_name, time, has_fastest_lap,
             rank, points, is_dsq FROM cells""",
    "driver_standings": """
      SELECT season_id, position, driver_id, driver_name, is_reserve, points_total, color, wins_count,
             CAST(to_json(list({'race_id': race_id, 'team_name': team_name, 'has_fastest_lap': has_fastest_lap, 'rank': cell,
                                'points': cell_points, 'has_been_raced': has_been_raced} ORDER BY race_no)) AS VARCHAR) AS races
      FROM cells GROUP BY ALL""",
    "standings_race_header": "SELECT race_id, season_id, track_id, date, is_sprint, flag, race_no FROM header",
    "rank_display": "SELECT season_id, driver_id, race_id, cell, cell_points FROM cells",
    "constructor_standings": """
      SELECT season_id, team_id, color, coalesce(earned, 0) AS points, name, icon,
             CAST(row_number() OVER (PARTITION BY season_id ORDER BY coalesce(earned, 0) DESC, name, team_id) AS INTEGER) AS rank
      FROM constructors""",
    "constructor_standings_pg_compat": """
      SELECT season_id, team_id, color, coalesce(earned, 0) AS points, name, icon,
             CAST(row_number() OVER (PARTITION BY season_id ORDER BY earned DESC NULLS FIRST, name, team_id) AS INTEGER) AS rank
      FROM constructors""",
    "penalty_points_by_race": "SELECT driver_id, race_id, points FROM pen WHERE points > 0",
    "penalty_points_table": """
      SELECT sd.season_id, sd.driver_id, h.race_id, h.race_no, d.name AS driver_name, t.icon AS team_icon,
             CASE WHEN p.points > 0 THEN p.points END AS points,
             CAST(coalesce(sum(p.points) OVER (PARTITION BY sd.season_id, sd.driver_id), 0) AS BIGINT) AS points_total
      FROM seasons_drivers sd JOIN drivers d ON d.id = sd.driver_id JOIN header h ON h.season_id = sd.season_id
      LEFT JOIN pen p ON p.race_id = h.race_id AND p.driver_id = sd.driver_id LEFT JOIN teams t ON t.id = sd.team_id""",
    "penalty_points_nested": """
      SELECT sd.season_id, sd.driver_id, d.name AS driver_name, CAST(coalesce(sum(p.points), 0) AS BIGINT) AS points_total,
             t.icon AS team_icon,
             CAST(to_json(list(coalesce(p.points, 0) ORDER BY race_no)) AS VARCHAR) AS races
      FROM seasons_drivers sd JOIN drivers d ON d.id = sd.driver_id JOIN header h ON h.season_id = sd.season_id
      LEFT JOIN pen p ON p.race_id = h.race_id AND p.driver_id = sd.driver_id LEFT JOIN teams t ON t.id = sd.team_id
      GROUP BY ALL""",
    "race_entry_list": """
      SELECT race_id, tr.race_name, rd.driver_id, d.name AS driver_name, t.name AS team_name, t.icon AS logo, t.color
      FROM races_drivers rd JOIN drivers d ON d.id = rd.driver_id JOIN teams t ON t.id = rd.team_id
      JOIN races r ON r.id = rd.race_id JOIN tracks tr ON tr.id = r.track_id""",
    "race_lineup_options": """
      SELECT r.id AS race_id, tr.race_name, r.date AS race_date, o.team_id AS option_team_id, t.name AS team_name, t.color,
             o.driver_id, d.name AS driver_name, o.is_reserve,
             CASE WHEN o.is_reserve OR rd.team_id = o.team_id THEN rd.team_id END AS entered_team_id,
             CASE WHEN o.driver_id IS NULL THEN NULL WHEN n.n IS NULL THEN NOT o.is_reserve
                  ELSE rd.team_id IS NOT NULL AND (o.is_reserve OR rd.team_id = o.team_id) END AS is_picked,
             n.n IS NULL AS is_empty
      FROM races r JOIN (
        SELECT season_id, team_id, driver_id, is_reserve FROM seasons_drivers
        UNION ALL SELECT s.id, t.id, NULL, NULL FROM seasons s CROSS JOIN teams t
        WHERE NOT EXISTS (SELECT 1 FROM seasons_drivers sd WHERE sd.season_id = s.id AND sd.team_id = t.id)
      ) o ON o.season_id = r.season_id LEFT JOIN drivers d ON d.id = o.driver_id LEFT JOIN teams t ON t.id = o.team_id
      LEFT JOIN tracks tr ON tr.id = r.track_id
      LEFT JOIN races_drivers rd ON rd.race_id = r.id AND rd.driver_id = o.driver_id
      LEFT JOIN (SELECT race_id, count(*) AS n FROM races_drivers GROUP BY 1) n ON n.race_id = r.id""",
    "race_gap_sheet": """
      SELECT g.race_id, g.driver_id, d.name AS driver_name, t.name AS team_name, t.color, gap,
             CASE WHEN leader_time IS NOT NULL THEN f.driver_id END AS fastest_lap_driver_id,
             CASE WHEN leader_time IS NOT NULL THEN fd.name END AS fastest_lap_driver_name
      FROM gaps g JOIN drivers d ON d.id = g.driver_id JOIN teams t ON t.id = g.team_id
      LEFT JOIN races_drivers f ON f.race_id = g.race_id AND f.has_fastest_lap LEFT JOIN drivers fd ON fd.id = f.driver_id""",
    "incident_reports": f"""
      SELECT r.id AS report_id, r.race_id, n.rank, r.from_driver, d.name AS from_name, r.content,
             {_video_json("r.video_path")} AS videos, r.created_at, r.verdict,
             coalesce(t.targets, '[]') AS targets, coalesce(s.responses, '[]') AS responses, coalesce(p.penalties, '[]') AS penalties
      FROM reports r JOIN numbered n ON n.report_id = r.id JOIN drivers d ON d.id = r.from_driver
      LEFT JOIN {_TARGETS_JSON} t ON t.report_id = r.id
      LEFT JOIN (
        SELECT report_id, CAST(to_json(list({{'id': id, 'from_driver': from_driver, 'driver_name': name, 'content': content,
                 'videos': CAST(videos AS JSON), 'created_at': strftime(created_at, '%Y-%m-%d %H:%M:%S')}}
                 ORDER BY created_at, from_driver, content)) AS VARCHAR) AS responses
        FROM (SELECT rr.*, {_video_json("rr.video_path")} AS videos, d.name FROM report_responses rr JOIN drivers d ON d.id = rr.from_driver)
        GROUP BY 1) s ON s.report_id = r.id
      LEFT JOIN (
        SELECT report_id, CAST(to_json(list({{'driver_id': driver_id, 'driver_name': name, 'time': time,
                 'penalty_points': penalty_points, 'is_dsq': is_dsq}} ORDER BY driver_id)) AS VARCHAR) AS penalties
        FROM penalties JOIN drivers d ON d.id = driver_id GROUP BY 1) p ON p.report_id = r.id""",
    "report_rank": "SELECT report_id, race_id, created_at, rank FROM numbered",
    "stream_report_numbers": "SELECT report_id, race_id, created_at, rank FROM numbered",
    "open_reports": f"""
      SELECT r.id AS report_id, r.race_id, tr.race_name, n.rank, r.from_driver, d.name AS from_name,
             coalesce(t.targets, '[]') AS targets
      FROM reports r JOIN numbered n ON n.report_id = r.id JOIN races ra ON ra.id = r.race_id JOIN tracks tr ON tr.id = ra.track_id
      JOIN drivers d ON d.id = r.from_driver LEFT JOIN {_TARGETS_JSON} t ON t.report_id = r.id
      WHERE r.verdict IS NULL""",
    "concerned_drivers": """
      SELECT r.id AS report_id, 'reporter' AS role, r.from_driver AS driver_id, d.name AS driver_name
      FROM reports r JOIN drivers d ON d.id = r.from_driver
      UNION ALL SELECT report_id, 'target', driver_id, target_name FROM named_targets""",
    "report_notification_feed": f"""
      SELECT r.id AS report_id, r.race_id, n.rank, d.name AS sender,
             {_LINK} AS link, {_REPORT_MESSAGE} AS message {_FEED}""",
    "verdict_notification_feed": f"""
      SELECT r.id AS report_id, r.race_id, n.rank, 'FIA' AS sender,
             {_LINK} AS link, {_VERDICT_MESSAGE} AS message {_FEED} WHERE r.verdict IS NOT NULL""",
    "season_schedule": """
      SELECT h.season_id, s.name AS season_name, race_no, race_id, date, race_name, track_id, is_sprint, image
      FROM header h JOIN seasons s ON s.id = h.season_id JOIN tracks t ON t.id = h.track_id""",
    "season_list": "SELECT id, name FROM seasons",
    "track_list": "SELECT id, race_name AS name FROM tracks",
    "unrostered_drivers": "SELECT s.id AS season_id, p.id AS driver_id, p.name AS driver_name " + _absent("drivers", "id", ""),
    "available_drivers": "SELECT s.id AS season_id, p.id AS driver_id, p.name AS driver_name "
    + _absent("drivers", "id", "AND NOT sd.is_reserve"),
    "season_lineup": """
      SELECT s.id AS season_id, t.id AS team_id, t.name AS team_name, t.color, t.icon,
             CASE WHEN count(sd.driver_id) = 0 THEN '[]' ELSE
               CAST(to_json(list({'driver_id': sd.driver_id, 'driver_name': d.name} ORDER BY sd.driver_id)) AS VARCHAR) END AS drivers,
             sum(count(sd.driver_id)) OVER (PARTITION BY s.id) = 0 AS is_empty_line_up
      FROM seasons s CROSS JOIN teams t LEFT JOIN seasons_drivers sd ON sd.season_id = s.id AND sd.team_id = t.id
      LEFT JOIN drivers d ON d.id = sd.driver_id GROUP BY s.id, t.id, t.name, t.color, t.icon""",
    "season_reserves": """
      SELECT season_id, driver_id, name AS driver_name FROM seasons_drivers JOIN drivers ON id = driver_id WHERE is_reserve""",
    "signed_drivers": """
      SELECT d.id AS driver_id, d.name AS driver_name, sd.season_id, sd.team_id, t.name AS team_name, t.color
      FROM drivers d LEFT JOIN seasons_drivers sd ON sd.driver_id = d.id AND sd.team_id IS NOT NULL LEFT JOIN teams t ON t.id = sd.team_id""",
    "steward_candidates": "SELECT s.id AS season_id, p.user_id, p.name AS driver_name "
    + _absent("(SELECT user_id, driver_id, name FROM senders JOIN drivers ON id = driver_id)", "driver_id", ""),
    "current_stewards": """
      SELECT s.id AS season_id, u.user_id, d.name AS driver_name
      FROM senders u JOIN drivers d ON d.id = u.driver_id JOIN users_roles ur ON ur.user_id = u.user_id JOIN seasons s ON s.fia_role_id = ur.role_id""",
    "users_with_roles": """
      SELECT u.id AS user_id, username, u.driver_id, d.name AS driver_name, coalesce(r.roles, '[]') AS roles
      FROM users u LEFT JOIN drivers d ON d.id = u.driver_id LEFT JOIN (
        SELECT user_id, CAST(to_json(list({'role_id': role_id, 'role_name': name} ORDER BY role_id)) AS VARCHAR) AS roles
        FROM users_roles JOIN roles ON id = role_id GROUP BY 1) r ON r.user_id = u.id""",
    "role_list": "SELECT id, name FROM roles",
    "user_role_names": "SELECT user_id, name AS role_name FROM users_roles JOIN roles ON id = role_id",
    "load_league": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}"
        for t in (
            "drivers teams tracks seasons seasons_drivers races races_drivers reports report_targets report_responses"
            " penalties users roles users_roles discord_accounts"
        ).split()
    ),
    "season_by_name": "SELECT id AS race_id, 'Season ' || season_id AS season_name, season_id FROM races",
    "nested_json_sink": """
      SELECT season_id, position, driver_id, points_total, race_id, cell AS rank, cell_points AS points FROM cells""",
    "lookup": """
      SELECT CAST(driver_id AS VARCHAR) AS driver_id, CAST(season_id AS VARCHAR) AS season_id, CAST(team_id AS VARCHAR) AS team_id, is_reserve
      FROM seasons_drivers WHERE season_id = 1998""",
    "report_targets": "SELECT report_id, driver_id, target_id, target_name FROM named_targets",
    "report_penalties": """
      SELECT report_id, driver_id, d.name AS driver_name, time, penalty_points, is_dsq FROM penalties JOIN drivers d ON d.id = driver_id""",
    "ingest_schedule": """
      SELECT season_id || '-' || strftime(utc, '%Y%m%d%H%M') || CASE WHEN is_sprint THEN '-sprint' ELSE '' END AS id,
             season_id, utc AS date, is_sprint, track_id
      FROM weekends WHERE month(date) <> 6""",
    "ingest_schedule_rejected": """
      SELECT 'Season ' || season_id AS season_name, 'nowhere' AS track_id, strftime(date, '%Y-%m-%dT%H:%M') AS timestamp,
             is_sprint, 'unknown track' AS reason
      FROM weekends WHERE month(date) = 6
      UNION ALL SELECT name, NULL, NULL, false, 'no race' FROM seasons""",
    "ingest_results": """
      SELECT race_id, driver_id, team_id,
             CASE WHEN ok AND (time > leader_time OR first) THEN time END AS time,
             CASE WHEN ok AND NOT first AND (time IS NULL OR time > leader_time) THEN plus_laps END AS plus_laps,
             ok AND has_fastest_lap AS has_fastest_lap, is_dsq
      FROM posted""",
    "ingest_results_rejected": """
      SELECT race_id, CASE WHEN first AND driver_id % 10 = 3 THEN -driver_id ELSE driver_id END AS driver_id, gap AS time,
             CASE WHEN first AND driver_id % 10 = 3 THEN 'not entered' WHEN NOT ok THEN 'no leader time' ELSE 'unreadable gap' END AS reason
      FROM posted WHERE NOT ok OR (time = leader_time AND NOT first)
      UNION ALL SELECT id, NULL, '+00:01.000', 'no driver' FROM races
      UNION ALL SELECT NULL, id, '+00:01.000', 'no race' FROM seasons""",
    "replace_race_entries": """
      SELECT race_id, driver_id, team_id, CASE WHEN bad THEN time END AS time, CASE WHEN bad THEN plus_laps END AS plus_laps,
             bad AND has_fastest_lap AS has_fastest_lap, bad AND is_dsq AS is_dsq
      FROM (SELECT *, bool_or(is_dsq AND has_fastest_lap) OVER (PARTITION BY race_id) AS bad FROM races_drivers)""",
    "replace_race_entries_rejected": """
      SELECT race_id, team_id, driver_id, CASE WHEN is_dsq AND has_fastest_lap THEN 'listed twice' ELSE 'race refused' END AS reason,
             CASE WHEN is_dsq AND has_fastest_lap THEN 2 ELSE 1 END AS copies
      FROM (SELECT *, bool_or(is_dsq AND has_fastest_lap) OVER (PARTITION BY race_id) AS bad FROM races_drivers) WHERE bad
      UNION ALL SELECT id, NULL, NULL, 'no driver', 1 FROM races
      UNION ALL SELECT NULL, NULL, season_id, 'no race', 1 FROM (SELECT DISTINCT season_id FROM races)
      UNION ALL SELECT -min(id), NULL, season_id, 'unknown race', 1 FROM races GROUP BY season_id
      UNION ALL SELECT min(id), 0, -season_id, 'unknown driver', 1 FROM races GROUP BY season_id
      UNION ALL SELECT min(id), -season_id, 1, 'unknown team', 1 FROM races GROUP BY season_id""",
    "flatten_team_pairs": "SELECT driver_id, season_id, team_id FROM seasons_drivers WHERE team_id IS NOT NULL",
    "roster_to_entries": """
      SELECT r.id AS race_id, driver_id, team_id FROM seasons_drivers sd JOIN races r ON r.season_id = sd.season_id
      WHERE team_id IS NOT NULL""",
    "add_reserves": """
      SELECT driver_id, season_id, CAST(NULL AS INTEGER) AS team_id, true AS is_reserve
      FROM entered WHERE unseated AND driver_id % 11 <> 5 AND driver_id % 13 <> 0""",
    "add_reserves_rejected": """
      SELECT 'No season' AS season_name, driver_id, 'unknown season' AS reason, count(*) * CASE WHEN driver_id % 13 = 0 THEN 2 ELSE 1 END AS copies
      FROM entered WHERE driver_id % 11 = 5 GROUP BY driver_id
      UNION ALL SELECT 'Season ' || season_id, driver_id, CASE WHEN unseated THEN 'posted twice' ELSE 'already in season' END,
             CASE WHEN driver_id % 13 = 0 THEN 2 ELSE 1 END
      FROM entered WHERE driver_id % 11 <> 5 AND (driver_id % 13 = 0 OR NOT unseated)
      UNION ALL SELECT name, NULL, 'no driver', 2 FROM seasons""",
    "upsert_lineup": """
      SELECT driver_id, season_id, CASE WHEN last_team >= 0 THEN last_team END AS team_id, last_team < 0 AS is_reserve
      FROM entered WHERE driver_id % 11 <> 5 AND NOT (unseated AND last_team < 0)
      UNION ALL SELECT driver_id, season_id, team_id, is_reserve FROM seasons_drivers WHERE driver_id % 11 = 5""",
    "upsert_lineup_rejected": """
      SELECT 'No season' AS season_name, driver_id, 'unknown season' AS reason FROM races_drivers WHERE driver_id % 11 = 5
      UNION ALL SELECT 'Season ' || season_id, driver_id, 'not in season' FROM entered WHERE driver_id % 11 <> 5 AND unseated AND last_team < 0
      UNION ALL SELECT name, NULL, 'no driver' FROM seasons CROSS JOIN (VALUES (1), (2))""",
    "apply_verdicts": """
      SELECT id, coalesce(verdict, 'ruling 1 of ' || id) AS verdict FROM reports""",
    "apply_verdicts_penalties": """
      SELECT * FROM penalties UNION ALL
      SELECT report_id, driver_id, CAST(s % 3 * 5 AS INTEGER), CAST(s % 5 AS INTEGER), s % 2 = 0 FROM punished WHERE n = 1""",
    "apply_verdicts_entries": """
      SELECT race_id, driver_id, is_dsq OR (race_id, driver_id) IN (
               SELECT (race_id, driver_id) FROM punished WHERE n = 1 AND s % 2 = 0
             ) AS is_dsq
      FROM races_drivers""",
    "apply_verdicts_rejected": """
      SELECT CASE WHEN k = 2 AND id % 17 = 0 THEN -1 - id ELSE id END AS report_id, CAST(k AS INTEGER) AS seq, 'ruling ' || k || ' of ' || id AS content,
             CASE WHEN k = 2 AND id % 17 = 0 THEN 'unknown report' WHEN verdict IS NOT NULL THEN 'already decided'
                  WHEN k = 1 THEN 'sent again' ELSE 'not the first' END AS reason,
             CASE WHEN k = 1 AND verdict IS NOT NULL THEN 2 ELSE 1 END AS copies
      FROM reports CROSS JOIN (VALUES (1), (2)) x(k)""",
    "apply_verdicts_rejected_penalties": """
      SELECT report_id, driver_id, CAST(s % 3 * 5 AS INTEGER) AS time, CAST(s % 5 AS INTEGER) AS penalty_points, s % 2 = 0 AS is_dsq,
             'second penalty' AS reason, 1 AS copies
      FROM punished WHERE n > 1""",
    "append_reports": """
      SELECT r.id || '-' || target_id AS id, race_id, from_driver, content, video_path, CAST(NULL AS VARCHAR) AS verdict, created_at
      FROM reports r JOIN senders s ON s.driver_id = r.from_driver JOIN named_targets t ON t.report_id = r.id WHERE r.id % 9 <> 4""",
    "append_report_targets": """
      SELECT r.id || '-' || target_id AS report_id, t.driver_id
      FROM reports r JOIN senders s ON s.driver_id = r.from_driver JOIN named_targets t ON t.report_id = r.id WHERE r.id % 9 <> 4
      UNION ALL
      SELECT r.id || '-' || target_id, NULL
      FROM reports r JOIN senders s ON s.driver_id = r.from_driver JOIN named_targets t ON t.report_id = r.id
      WHERE t.driver_id % 2 = 0 AND r.id % 9 <> 4""",
    "append_reports_rejected": """
      SELECT r.id || '-' || target_id AS id, race_id, -1 - user_id AS user_id, 'unknown user' AS reason, 1 AS copies
      FROM reports r JOIN senders s ON s.driver_id = r.from_driver JOIN named_targets t ON t.report_id = r.id WHERE r.id % 9 = 4
      UNION ALL
      SELECT CASE WHEN k <> 0 THEN r.id || '/' || k END, CASE WHEN k = 1 THEN -race_id ELSE race_id END, user_id,
             CASE k WHEN 0 THEN 'no id' WHEN 1 THEN 'unknown race' ELSE 'no target' END, 1
      FROM reports r JOIN senders s ON s.driver_id = r.from_driver CROSS JOIN (VALUES (0), (1), (2), (3)) x(k) WHERE verdict IS NULL""",
    "append_responses": """
      SELECT report_id || '-' || user_id || '-' || md5(content || '|' || strftime(created_at, '%Y-%m-%d %H:%M:%S') || '|' || video_path) AS id,
             report_id, from_driver, content, video_path, created_at
      FROM report_responses JOIN senders ON driver_id = from_driver WHERE report_id % 8 <> 3""",
    "append_responses_rejected": """
      SELECT CASE WHEN report_id % 8 = 3 THEN -report_id ELSE report_id END AS report_id, user_id, created_at,
             CASE WHEN report_id % 8 = 3 THEN 'unknown report' ELSE 'sent again' END AS reason, 1 AS copies
      FROM report_responses JOIN senders ON driver_id = from_driver WHERE report_id % 8 = 3 OR report_id % 4 = 1""",
    "replace_role_members": """
      SELECT user_id, role_id FROM users_roles WHERE role_id NOT IN (SELECT season_id FROM new_stewards WHERE driver_id % 11 <> 5)
      UNION ALL SELECT user_id, season_id FROM new_stewards WHERE driver_id % 11 <> 5 AND driver_id % 4 <> 1""",
    "replace_role_members_rejected": """
      SELECT 'No season' AS season_name, CASE WHEN driver_id % 4 = 1 THEN -user_id ELSE user_id END AS user_id,
             'unknown season' AS reason, count(*) AS copies
      FROM new_stewards WHERE driver_id % 11 = 5 GROUP BY driver_id, user_id
      UNION ALL SELECT 'Season ' || season_id, -user_id, 'unknown user', 1 FROM new_stewards WHERE driver_id % 11 <> 5 AND driver_id % 4 = 1""",
    "apply_changes_rejected": """
      SELECT o_custkey AS id, CAST(NULL AS VARCHAR) AS op, o_orderkey AS seq, 'unknown operation' AS reason FROM orders WHERE o_orderpriority = '1-URGENT'
      UNION ALL SELECT id, 'update', seq, 'nothing to update' FROM (
        SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS op, max(o_orderkey) AS seq
        FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1)
      WHERE op = 'F' AND id NOT IN (SELECT id FROM drivers)
      UNION ALL SELECT NULL, 'insert', o_orderkey, 'no key' FROM orders WHERE o_orderstatus = 'P'""",
    "apply_changes": "SELECT id, name FROM changed_drivers",
    "points_for": "SELECT race_id, driver_id, rank, is_sprint, has_fastest_lap, is_dsq, points FROM scored",
    "parse_gap": """
      SELECT race_id, driver_id, gap,
             CASE WHEN readable THEN leader_time + coalesce(TRY_CAST(minutes AS INTEGER), 0) * 60 + CAST(seconds AS INTEGER) + CAST('0.' || fraction || '0' AS DOUBLE) END AS time,
             coalesce(readable OR gap = 'DNF', false) AS is_valid, coalesce(readable AND length(tail) <= 3 OR gap = 'DNF', false) AS is_valid_strictly
      FROM (
        SELECT *, substr(tail, 1, 3) AS fraction, starts_with(gap, '+') AND TRY_CAST(seconds AS INTEGER) BETWEEN 0 AND 59 AND length(seconds) <= 2
               AND (minutes = '' OR TRY_CAST(minutes AS INTEGER) BETWEEN 0 AND 59 AND length(minutes) <= 2) AS readable
        FROM (
          SELECT *, CASE WHEN contains(clock, ':') THEN split_part(clock, ':', 1) ELSE '' END AS minutes, split_part(clock, ':', -1) AS seconds
          FROM (
            SELECT *, split_part(substr(dotted, 2), '.', 1) AS clock, split_part(dotted, '.', 2) AS tail
            FROM (
              SELECT *, replace(gap, ',', '.') AS dotted
              FROM (SELECT race_id, driver_id, leader_time,
                           CASE WHEN has_fastest_lap THEN gap || '99' WHEN plus_laps = 1 THEN replace(gap, '.', ',')
                                WHEN plus_laps = 2 THEN '+' || substr(gap, 5, 6) ELSE gap END AS gap
                    FROM gaps)))))""",
    "format_gap": """
      SELECT race_id, driver_id,
             CASE WHEN leader IS NULL THEN NULL WHEN late IS NULL THEN 'DNF'
                  WHEN late = leader THEN CAST(floor(late / 60) AS INTEGER) || ':' || lpad(CAST(CAST(floor(late % 60) AS INTEGER) AS VARCHAR), 2, '0')
                    || CASE WHEN late % 1 > 0 THEN '.' || lpad(CAST(CAST((late % 1) * 1000 AS INTEGER) AS VARCHAR), 3, '0') ELSE '' END
                  ELSE '+' || lpad(CAST(CAST(floor((late - leader) / 60) AS INTEGER) AS VARCHAR), 2, '0') || ':'
                    || lpad(CAST(CAST(floor((late - leader) % 60) AS INTEGER) AS VARCHAR), 2, '0') || '.'
                    || lpad(CAST(CAST(((late - leader) % 1) * 1000 AS INTEGER) AS VARCHAR), 3, '0') END AS gap
      FROM (
        SELECT race_id, driver_id, CASE WHEN k % 19 <> 0 THEN k % 9000 / 4 + 3600 END AS leader,
               CASE WHEN k % 5 <> 0 THEN greatest(k % 9000 / 4 + 3600, k % 7000 / 4 + 3700) END AS late
        FROM (SELECT race_id, driver_id, driver_id * 31 + race_id AS k FROM races_drivers))""",
    "format_time": "SELECT race_id, driver_id, time_text FROM gaps",
    "parse_time": """
      SELECT race_id, driver_id, CASE WHEN k % 7 IN (2, 3) THEN NULL
               ELSE k % 90 * 60 + k // 90 % 60 + CASE WHEN k % 7 = 0 THEN 0 ELSE CAST(k // 5400 % 1000 AS DOUBLE) / 1000 END END AS time
      FROM (SELECT race_id, driver_id, driver_id * 7919 + race_id AS k FROM races_drivers)""",
    "has_been_raced": "SELECT id AS race_id, date < TIMESTAMP '2000-06-14 21:00:00' AS has_been_raced FROM races",
    "expiry_instant": "SELECT id, TIMESTAMP '2000-06-15 00:00:00' + to_seconds(id) AS expires_at FROM discord_accounts",
    "local_instant": """
      SELECT DISTINCT 'Season ' || season_id AS season_name, CASE WHEN month(date) = 6 THEN 'nowhere' ELSE CAST(track_id AS VARCHAR) END AS track_id,
             CAST(timezone('UTC', timezone('Europe/Budapest', date)) AS TIMESTAMP) AS starts_at
      FROM races""",
    "report_deadline": """
      SELECT id AS race_id, date_trunc('day', date) + INTERVAL 2 DAY - INTERVAL 1 SECOND AS deadline,
             CAST(timezone('UTC', timezone('Europe/Budapest', date_trunc('day', timezone('Europe/Budapest', timezone('UTC', date)))
               + INTERVAL 2 DAY - INTERVAL 1 SECOND)) AS TIMESTAMP) AS local_deadline
      FROM races""",
    "video_links": """
      SELECT report_id, CAST(video_no AS INTEGER) AS video_no, %s AS is_local, %s AS url, %s AS embed FROM videos"""
    % _video("path"),
    "mention_text": "SELECT report_id, mentions FROM mentions",
    "report_link": f"SELECT r.id AS report_id, {_LINK} AS link {_FEED}",
    "message_time": "SELECT id AS report_id, strftime(created_at, '%d.%m.%y %H:%M:%S') AS sent FROM reports",
    "name_decode": "SELECT id AS race_id, url_decode('Season%20' || season_id) AS season_name FROM races",
    "role_name": "SELECT id, name || 'fia' AS role_name FROM seasons",
    "is_canonical_uuid": """
      SELECT *, length(id_text) = 36 AND lower(id_text) = id_text AND TRY_CAST(id_text AS UUID) IS NOT NULL AS is_canonical FROM ids""",
    "dq_uuid": "SELECT * FROM ids WHERE CAST(TRY_CAST(id_text AS UUID) AS VARCHAR) IS DISTINCT FROM id_text",
    "dq_duplicate_keys": """
      SELECT 'races_drivers' AS table_name, 'race_id,driver_id' AS key_columns, race_id || '|' || driver_id AS key_value, count(*) AS copies
      FROM listed GROUP BY race_id, driver_id HAVING count(*) > 1""",
    "dq_orphans": " UNION ALL ".join(
        _orphans(child, column)
        for child, column in (
            ("seasons_drivers", "driver_id"),
            ("races_drivers", "driver_id"),
            ("reports", "from_driver"),
            ("report_targets", "driver_id"),
            ("report_responses", "from_driver"),
            ("penalties", "driver_id"),
            ("users", "driver_id"),
        )
    ),
    "dq_driver_two_teams": """
      SELECT race_id, driver_id, count(*) AS times_listed FROM listed GROUP BY 1, 2 HAVING count(*) > 1""",
    "dq_length": """
      SELECT 'drivers' AS table_name, 'name' AS column_name, CAST(doc_id AS VARCHAR) AS id,
             CAST(length(text) AS INTEGER) AS length, CAST(50 AS INTEGER) AS max_length
      FROM documents WHERE length(text) > 50""",
    "dq_one_fastest_lap": """
      SELECT race_id, count(*) FILTER (WHERE has_fastest_lap AND NOT is_dsq) AS fastest_laps, count(time) AS timed
      FROM races_drivers GROUP BY 1 HAVING fastest_laps <> 1 AND timed > 0""",
    "report_gate": "SELECT id AS report_id, race_id, from_driver, created_at, gate FROM gated",
    "response_gate": "SELECT report_id, from_driver, content, created_at, gate FROM gated_responses",
    "stream_report_gate": "SELECT id AS report_id, race_id, from_driver, created_at, gate FROM gated",
    "stream_response_gate": "SELECT report_id, from_driver, content, created_at, gate FROM gated_responses",
    "stream_notifications": f"""
      SELECT r.id AS report_id, false AS is_decision, d.name AS sender, {_REPORT_MESSAGE} AS message {_FEED}
      UNION ALL
      SELECT r.id, true, 'FIA', {_VERDICT_MESSAGE} {_FEED} WHERE r.verdict IS NOT NULL""",
}


#: Tables kept up by change hold what the whole tables give.
_KEPT = {
    "driver_standings_kept": "driver_standings_long",
    "constructor_standings_kept": "constructor_standings",
    "replace_race_entries_kept": "replace_race_entries",
    "upsert_lineup_kept": "upsert_lineup",
    "apply_changes_kept": "apply_changes",
}


def statements() -> dict[str, str]:
    selects = _SELECTS | {name: _SELECTS[same] for name, same in _KEPT.items()}
    return {name: f"{TABLES}{select}" for name, select in selects.items()}
