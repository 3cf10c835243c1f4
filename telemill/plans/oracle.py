"""DuckDB SQL oracles for the registry (tables are the driver's parquet views).

Every oracle restates the query from its definition, independently of the
Spark code: the machine-log view, then plain window functions over whole
machines (no blocks), so agreement checks the scalable Spark plans against
the simple formulation. Nothing is imported from the code under test.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# The domain catalog and report badges, written out.
SENSORS = ["laser_power_w", "temperature_c", "gas_pressure_psi", "beam_alignment_mm",
           "feed_rate_mm_min", "coolant_flow_lpm"]
RANGES = [("laser_power_w", 1800, 2200), ("temperature_c", 20, 35), ("gas_pressure_psi", 140, 160),
          ("beam_alignment_mm", 0, 0.05), ("feed_rate_mm_min", 1800, 2400), ("coolant_flow_lpm", 8, 12)]
SIGNATURES = {
    "THERMAL": [("temperature_c", 55, 85), ("laser_power_w", 2300, 2600), ("coolant_flow_lpm", 3, 5.5)],
    "OPTICAL": [("beam_alignment_mm", 0.15, 0.45), ("laser_power_w", 1500, 1750)],
    "PNEUMATIC": [("gas_pressure_psi", 80, 110), ("feed_rate_mm_min", 1000, 1500)],
    "MECHANICAL": [("feed_rate_mm_min", 800, 1400), ("beam_alignment_mm", 0.08, 0.2)],
    "MATERIAL": [("laser_power_w", 2100, 2500), ("feed_rate_mm_min", 1200, 1600)],
    "ELECTRICAL": [("laser_power_w", 0, 800), ("temperature_c", 15, 20)],
}
CODES = {"THERMAL": ["E-201", "E-202", "E-210"], "OPTICAL": ["E-301", "E-302", "E-315"],
         "PNEUMATIC": ["E-401", "E-402", "E-410"], "MECHANICAL": ["E-501", "E-502", "E-520"],
         "MATERIAL": ["E-601", "E-602"], "ELECTRICAL": ["E-701", "E-702", "E-710"]}
# ---------------------------------------------------------------------------

LOGS = """
logs AS (
  SELECT event_id, ts AS "timestamp",
    CASE WHEN event_id % 97 = 5 THEN NULL ELSE concat('M-', cast(user_id % 5 AS varchar)) END AS machine_id,
    CASE WHEN event_id % 101 = 7 THEN NULL WHEN c >= 0 AND value >= 100 THEN 'CRITICAL' WHEN c >= 0 THEN 'ERROR'
         WHEN event_type = 'purchase' THEN 'WARNING' ELSE 'INFO' END AS severity,
    CASE c WHEN 0 THEN (['E-201', 'E-202', 'E-210'])[(k // 6) % 3 + 1] WHEN 1 THEN (['E-301', 'E-302', 'E-315'])[(k // 6) % 3 + 1]
           WHEN 2 THEN (['E-401', 'E-402', 'E-410'])[(k // 6) % 3 + 1] WHEN 3 THEN (['E-501', 'E-502', 'E-520'])[(k // 6) % 3 + 1]
           WHEN 4 THEN (['E-601', 'E-602'])[(k // 6) % 2 + 1] WHEN 5 THEN (['E-701', 'E-702', 'E-710'])[(k // 6) % 3 + 1]
           ELSE '' END AS error_code,
    CASE WHEN event_id % 103 = 9 THEN NULL ELSE
      CASE c WHEN 0 THEN 'THERMAL' WHEN 1 THEN 'OPTICAL' WHEN 2 THEN 'PNEUMATIC' WHEN 3 THEN 'MECHANICAL'
             WHEN 4 THEN 'MATERIAL' WHEN 5 THEN 'ELECTRICAL' ELSE '' END END AS failure_category,
    CASE c WHEN 0 THEN 2300 + 300 * u WHEN 1 THEN 1500 + 250 * u WHEN 4 THEN 2100 + 400 * u
           WHEN 5 THEN 800 * u ELSE 1800 + 400 * u END AS laser_power_w,
    CASE c WHEN 0 THEN 55 + 30 * v WHEN 5 THEN 15 + 5 * v ELSE 20 + 15 * v END AS temperature_c,
    CASE WHEN k % 17 = 0 THEN NULL WHEN c = 2 THEN 80 + 30 * u ELSE 140 + 20 * u END AS gas_pressure_psi,
    CASE c WHEN 1 THEN 0.15e0 + 0.3e0 * v WHEN 3 THEN 0.08e0 + 0.12e0 * v ELSE 0.05e0 * v END AS beam_alignment_mm,
    CASE c WHEN 2 THEN 1000 + 500 * v WHEN 3 THEN 800 + 600 * v WHEN 4 THEN 1200 + 400 * v
           ELSE 1800 + 600 * v END AS feed_rate_mm_min,
    CASE c WHEN 0 THEN 3 + 2.5e0 * u ELSE 10 + 0 * u END AS coolant_flow_lpm,
    CASE WHEN k % 5 = 0 THEN NULL WHEN k % 7 = 0 THEN ''
         ELSE concat(event_type, ' note ', cast(k AS varchar)) END AS operator_notes
  FROM (SELECT *, CASE WHEN event_type = 'error' THEN k % 6 ELSE -1 END AS c,
               (value % 10) / 1e1 AS u, k / 1e2 AS v
        FROM (SELECT *, cast(json_extract_string(props, '$.k') AS int) AS k FROM events) e0) e1
)"""

FAILS = """
fails AS (
  SELECT * FROM logs
  WHERE severity IN ('ERROR', 'CRITICAL') AND machine_id IS NOT NULL AND "timestamp" IS NOT NULL
),
marked AS (
  SELECT *, CASE WHEN lag("timestamp") OVER (PARTITION BY machine_id ORDER BY "timestamp", event_id)
                      >= "timestamp" - INTERVAL 60 MINUTES THEN 0 ELSE 1 END AS brk
  FROM fails
),
sess AS (
  SELECT *, sum(brk) OVER (PARTITION BY machine_id ORDER BY "timestamp", event_id
                           ROWS UNBOUNDED PRECEDING) AS sid
  FROM marked
),
entries AS (
  SELECT *, min("timestamp") OVER (PARTITION BY machine_id, sid) AS window_start,
         row_number() OVER (PARTITION BY machine_id, sid ORDER BY "timestamp", event_id) AS seq
  FROM sess
),
windows AS (
  SELECT machine_id, min("timestamp") AS start, max("timestamp") AS "end",
         (epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 6e7 AS duration_minutes,
         count(*) AS event_count,
         CASE WHEN max(CASE WHEN severity = 'CRITICAL' THEN 1 ELSE 0 END) = 1 THEN 'CRITICAL'
              ELSE 'ERROR' END AS max_severity,
         coalesce(string_agg(DISTINCT nullif(failure_category, ''), ',' ORDER BY nullif(failure_category, '')), '')
           AS failure_categories,
         coalesce(string_agg(DISTINCT nullif(error_code, ''), ',' ORDER BY nullif(error_code, '')), '')
           AS error_codes
  FROM entries GROUP BY machine_id, sid
)"""


_FRAME = ("OVER (PARTITION BY machine_id ORDER BY \"timestamp\" "
          "RANGE BETWEEN INTERVAL 14399999999 MICROSECONDS PRECEDING AND CURRENT ROW)")
_ROLL = ",\n    ".join(
    f"CASE WHEN machine_id IS NOT NULL THEN avg({s}) {_FRAME} END AS {s}_rolling_mean,\n"
    f"    CASE WHEN machine_id IS NOT NULL THEN coalesce(stddev_samp({s}) {_FRAME}, 0) END AS {s}_rolling_std"
    for s in SENSORS)
_Z = ",\n    ".join(
    f"CASE WHEN {s}_rolling_std > 0 THEN abs({s} - {s}_rolling_mean) / {s}_rolling_std ELSE 0 END AS {s}_z"
    for s in SENSORS)
_FLAGS = ",\n    ".join(f"coalesce({s}_z > 2.5, false) AS {s}_anomaly" for s in SENSORS)
_COUNT = " + ".join(f"cast({s}_anomaly AS integer)" for s in SENSORS)

ENRICHED = f"""
rolled AS (
  SELECT *, {_ROLL}
  FROM logs
),
zs AS (SELECT *, {_Z} FROM rolled),
flagged AS (SELECT *, {_FLAGS} FROM zs),
enriched AS (SELECT *, cast({_COUNT} AS integer) AS anomaly_count, ({_COUNT}) > 0 AS is_anomaly FROM flagged)"""


def ts_text(c: str) -> str:
    return (f"CASE WHEN epoch_us({c}) % 1000000 = 0 THEN strftime({c}, '%Y-%m-%d %H:%M:%S') "
            f"ELSE strftime({c}, '%Y-%m-%d %H:%M:%S.%f') END")


def _sig_ctes() -> str:
    sums = []
    for cat, sig in SIGNATURES.items():
        inside = " + ".join(f"cast(coalesce({x} BETWEEN {lo!r} AND {hi!r}, false) AS integer)" for x, lo, hi in sig)
        seen = " + ".join(f"cast({x} IS NOT NULL AS integer)" for x, _, _ in sig)
        sums.append(f"cast(sum({inside}) AS bigint) AS {cat}_in, cast(sum({seen}) AS bigint) AS {cat}_nn")
    cands = "\n  UNION ALL ".join(
        f"SELECT machine_id, window_start, '{cat}' AS category, "
        f"CASE WHEN {cat}_nn > 0 THEN cast({cat}_in AS double) / {cat}_nn ELSE 0e0 END AS score, "
        f"{cat}_in AS matched, {cat}_nn AS considered FROM sigsum" for cat in SIGNATURES)
    return f"""
sigsum AS (SELECT machine_id, window_start, {", ".join(sums)} FROM entries GROUP BY machine_id, window_start),
cand AS ({cands}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY machine_id, window_start ORDER BY score DESC, category) AS rn
           FROM cand),
sigm AS (
  SELECT machine_id, window_start AS start,
         CASE WHEN score > 0 THEN category ELSE 'UNKNOWN' END AS failure_mode,
         CASE WHEN score > 0 THEN score ELSE 0e0 END AS confidence,
         CASE WHEN score > 0 THEN matched ELSE 0 END AS n_matched,
         CASE WHEN score > 0 THEN considered ELSE 0 END AS n_considered
  FROM ranked WHERE rn = 1),
ev AS (
  SELECT machine_id, window_start AS start,
         coalesce(string_agg(DISTINCT 'error code ' || nullif(error_code, ''), '|'
                             ORDER BY 'error code ' || nullif(error_code, '')), '') AS evidence
  FROM entries GROUP BY machine_id, window_start),
diag AS (
  SELECT w.machine_id, w.start AS start_ts, {ts_text('w.start')} AS start, {ts_text('w."end"')} AS "end",
         CASE WHEN s.failure_mode <> 'UNKNOWN'
              THEN s.failure_mode || ' signature: ' || s.n_matched || ' of ' || s.n_considered || ' readings in range'
              ELSE 'No failure signature matched' END AS root_cause,
         s.failure_mode, s.confidence,
         CASE WHEN w.max_severity = 'CRITICAL' THEN 'CRITICAL' ELSE 'HIGH' END AS severity_assessment,
         ev.evidence,
         CASE WHEN s.failure_mode <> 'UNKNOWN' THEN 1 ELSE 0 END AS n_actions,
         '' AS parts_at_risk,
         w.event_count || ' events in ' || printf('%.1f', w.duration_minutes) || ' min' AS pattern_notes,
         'ok' AS status,
         CASE WHEN w.max_severity = 'CRITICAL' THEN 'IMMEDIATE' ELSE 'NEXT_SHIFT' END AS priority,
         'Inspect the ' || lower(s.failure_mode) || ' subsystem' AS action,
         cast(printf('%.1f', w.duration_minutes / 60e0) AS double) AS downtime,
         w.max_severity
  FROM windows w JOIN sigm s ON w.machine_id = s.machine_id AND w.start = s.start
  JOIN ev ON w.machine_id = ev.machine_id AND w.start = ev.start)"""


def _section_sql() -> str:
    nl = "chr(10)"
    return f"""concat_ws({nl},
    '### Machine `' || machine_id || '` — ' || start || ' → ' || "end", '',
    '| Field | Value |', '|-------|-------|',
    '| **Root Cause** | ' || root_cause || ' |',
    '| **Failure Mode** | `' || failure_mode || '` |',
    '| **Confidence** | ' || printf('%.0f', confidence * 100) || '% |',
    '| **Severity** | ' || CASE severity_assessment WHEN 'CRITICAL' THEN '🔴 CRITICAL' WHEN 'HIGH' THEN '🟠 HIGH'
                                WHEN 'MEDIUM' THEN '🟡 MEDIUM' WHEN 'LOW' THEN '🟢 LOW'
                                ELSE '⚪ ' || severity_assessment END || ' |', '',
    CASE WHEN evidence <> '' THEN concat_ws({nl}, '**Evidence:**',
         '- ' || replace(evidence, '|', {nl} || '- '), '') END,
    CASE WHEN n_actions > 0 THEN concat_ws({nl}, '**Recommended Actions:**', '',
         '| Priority | Action | Est. Downtime |', '|----------|--------|---------------|',
         '| ' || CASE priority WHEN 'IMMEDIATE' THEN '⚡ IMMEDIATE' ELSE '📋 NEXT SHIFT' END || ' | ' || action
           || ' | ' || cast(downtime AS varchar) || 'h |', '') END,
    CASE WHEN pattern_notes <> '' THEN concat_ws({nl}, '**Pattern Notes:** ' || pattern_notes, '') END,
    '---', '')"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


# Fleet issue table from the diagnoses (the offline fleet responder's input).
_FLEET_CTES = """
issues AS (
  SELECT failure_mode, count(*) AS n, count(DISTINCT machine_id) AS n_machines,
         count(*) FILTER (WHERE severity_assessment = 'CRITICAL') AS n_crit,
         sum(CASE WHEN failure_mode <> 'UNKNOWN' THEN downtime ELSE 0e0 END) AS hours
  FROM diag GROUP BY failure_mode),
known AS (SELECT *, row_number() OVER (ORDER BY n DESC, failure_mode) AS rank FROM issues WHERE failure_mode <> 'UNKNOWN')"""

_NL = "chr(10)"
_FLEET_TEXT = f"""(SELECT (SELECT sum(n) FROM issues) || ' failure windows analysed; most frequent mode: '
         || coalesce((SELECT failure_mode FROM known WHERE rank = 1), 'none') || '.')"""
_FLEET_SECTION = f"""concat_ws({_NL}, '## Fleet Summary', '', '> ' || {_FLEET_TEXT}, '',
  (SELECT concat_ws({_NL}, '### Top Issues', '', string_agg(concat_ws({_NL}, '**' || rank || '. ' || failure_mode || ' failures**',
      '- Affected: `' || n_machines || ' machines`', '- Frequency: ' || n || ' windows',
      '- Impact: ' || n_crit || ' critical windows', ''), {_NL} ORDER BY rank)) FROM known HAVING count(*) > 0),
  (SELECT concat_ws({_NL}, '### Maintenance Priorities', '', '| Priority | Action | Machines | Rationale |',
      '|----------|--------|----------|-----------|',
      string_agg('| ' || CASE WHEN n_crit > 0 THEN '⚡ IMMEDIATE' ELSE '📋 THIS WEEK' END || ' | Inspect the ' || lower(failure_mode)
        || ' subsystem | `' || n_machines || ' machines` | ' || n || ' failure windows |', {_NL} ORDER BY rank), '')
   FROM known HAVING count(*) > 0),
  (SELECT concat_ws({_NL}, '### Trend Alerts', '', string_agg('- ⚠️ Over a tenth of ' || failure_mode || ' windows are critical', {_NL}
      ORDER BY rank), '') FROM known WHERE 10 * n_crit > n HAVING count(*) > 0),
  (SELECT '**Estimated Downtime Savings:** ' || printf('%.1f', cast(printf('%.1f', sum(hours)) AS double))
      || ' hours (if all recommended actions are completed)' || {_NL} FROM issues
   HAVING cast(printf('%.1f', sum(hours)) AS double) <> 0))"""

# Dataset-overview rows, from `o` and `windows`.
_STATS_CTES = f"""
o AS (SELECT count(*) AS n, avg(CASE WHEN severity IN ('ERROR', 'CRITICAL') THEN 1e0 ELSE 0e0 END) AS err,
             sum(cast(is_anomaly AS bigint)) AS an, min("timestamp") AS t0, max("timestamp") AS t1
      FROM enriched),
stats AS (
  SELECT 1 AS ord, '' AS tie, 'Total entries' AS metric, cast(n AS varchar) AS value FROM o
  UNION ALL SELECT 2, '', 'Time range', {ts_text('t0')} || ' → ' || {ts_text('t1')} FROM o
  UNION ALL SELECT DISTINCT 3, machine_id, 'Machines', machine_id FROM logs WHERE machine_id IS NOT NULL
  UNION ALL SELECT 4, '', 'Failure windows', cast(count(*) AS varchar) FROM windows
  UNION ALL SELECT 5, '', 'Sensor anomalies', cast(an AS varchar) FROM o
  UNION ALL SELECT 6, '', 'Error rate', printf('%.1f%%', err * 100) FROM o)"""

_PROMPT_HEAD = f"""concat('Analyze the following failure window from machine ', machine_id, '.', {_NL}, {_NL}, '**Failure Window:**', {_NL},
    '- Time range: ', start_text, ' → ', end_text, ' (', cast(minutes AS varchar), ' min)', {_NL},
    '- Events: ', event_count, {_NL}, '- Error codes: ', replace(error_codes, ',', ', '), {_NL}, {_NL},
    '**Log entries (chronological):**')"""

_FRAME_1H = ("OVER (PARTITION BY machine_id ORDER BY \"timestamp\" "
             "RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW)")
_COUNT_1H = " + ".join(
    f"CASE WHEN coalesce(stddev_samp({s}) {_FRAME_1H}, 0) > 0 AND abs({s} - avg({s}) {_FRAME_1H}) "
    f"/ stddev_samp({s}) {_FRAME_1H} > 1.6e0 THEN 1 ELSE 0 END" for s in SENSORS)


def _cell(i: int, s: str) -> str:
    """A sensor cell of the typing step: token, text that is no number, or the reading."""
    return (f"CASE WHEN event_id % {7 + i} = 0 THEN NULL WHEN event_id % {31 + i} = 1 THEN NULL ELSE {s} END AS {s}")


_BAD_CELL = " OR ".join(f"(event_id % {7 + i} <> 0 AND event_id % {31 + i} = 1)" for i in range(len(SENSORS)))


ORACLE: dict[str, str] = {
    "machine_logs": _with(LOGS) + "\nSELECT * FROM logs",
    "failure_events": _with(LOGS, FAILS) + "\nSELECT * FROM fails",
    "failure_windows": _with(LOGS, FAILS) + "\nSELECT * FROM windows",
    "window_entries": _with(LOGS, FAILS) + """
SELECT machine_id, window_start, seq, event_id, "timestamp", severity, error_code, failure_category,
       operator_notes FROM entries""",
    "time_features": _with(LOGS) + """
SELECT event_id, machine_id, "timestamp", cast(hour("timestamp") AS integer) AS hour,
       cast(isodow("timestamp") - 1 AS integer) AS day_of_week, cast("timestamp" AS date) AS date,
       CASE WHEN machine_id IS NULL THEN 0 ELSE coalesce((epoch_us("timestamp") - lag(epoch_us("timestamp"))
                 OVER (PARTITION BY machine_id ORDER BY "timestamp", event_id)) / 1e6, 0) END AS time_since_last
FROM logs""",
    "rolling_stats": _with(LOGS, ENRICHED) + "\nSELECT event_id, machine_id, \"timestamp\", " + ", ".join(
        f"floor({s}_rolling_mean * 1e6 + 0.499) / 1e6 AS {s}_rolling_mean, floor({s}_rolling_std * 1e6 + 0.499) / 1e6 AS {s}_rolling_std"
        for s in SENSORS) + " FROM enriched",
    "rolling_stats_dense": _with(LOGS, ENRICHED.replace("14399999999", "28799999999")) + "\nSELECT event_id, machine_id, \"timestamp\", " + ", ".join(
        f"floor({s}_rolling_mean * 1e6 + 0.499) / 1e6 AS {s}_rolling_mean, floor({s}_rolling_std * 1e6 + 0.499) / 1e6 AS {s}_rolling_std"
        for s in SENSORS) + " FROM enriched",
    "processed_logs": _with(LOGS, ENRICHED) + """
SELECT event_id, machine_id, "timestamp", severity, cast(hour("timestamp") AS integer) AS hour,
       cast(isodow("timestamp") - 1 AS integer) AS day_of_week, cast("timestamp" AS date) AS date,
       CASE WHEN machine_id IS NULL THEN 0 ELSE coalesce((epoch_us("timestamp") - lag(epoch_us("timestamp"))
                 OVER (PARTITION BY machine_id ORDER BY "timestamp", event_id)) / 1e6, 0) END AS time_since_last, """
    + ", ".join(
        f"floor({s}_rolling_mean * 1e6 + 0.499) / 1e6 AS {s}_rolling_mean, floor({s}_rolling_std * 1e6 + 0.499) / 1e6 AS {s}_rolling_std"
        for s in SENSORS) + ", anomaly_count, is_anomaly FROM enriched",
    "sensor_zscores": _with(LOGS, ENRICHED) + "\nSELECT event_id, machine_id, \"timestamp\", " + ", ".join(
        f"floor({s}_z * 1e6 + 0.499) / 1e6 AS {s}_z" for s in SENSORS) + " FROM enriched",
    "anomaly_flags": _with(LOGS, ENRICHED) + "\nSELECT event_id, machine_id, \"timestamp\", " + ", ".join(
        f"{s}_anomaly" for s in SENSORS) + ", anomaly_count, is_anomaly FROM enriched",
    "anomalies_by_sensor": _with(LOGS, ENRICHED) + "\n" + "\nUNION ALL\n".join(
        f"SELECT machine_id, '{s}' AS sensor, cast(sum(cast({s}_anomaly AS bigint)) AS bigint) AS n_anomalies "
        f"FROM enriched WHERE machine_id IS NOT NULL GROUP BY machine_id" for s in SENSORS),
    "sensor_trend": _with(LOGS, ENRICHED) + """
SELECT machine_id, "timestamp", event_id, temperature_c AS value,
       floor(temperature_c_rolling_mean * 1e6 + 0.499) / 1e6 AS rolling_mean, temperature_c_anomaly AS is_anomaly
FROM enriched""",
    "sensor_anomalies_top20": _with(LOGS, ENRICHED) + """
SELECT * FROM (
  SELECT machine_id, row_number() OVER (PARTITION BY machine_id ORDER BY "timestamp", event_id) AS rank,
         "timestamp", event_id, severity, temperature_c AS value, operator_notes
  FROM enriched WHERE temperature_c_anomaly AND machine_id IS NOT NULL) t
WHERE rank <= 20""",
    "severity_summary": _with(LOGS) + """
SELECT machine_id, count(*) FILTER (WHERE severity = 'INFO') AS "INFO",
       count(*) FILTER (WHERE severity = 'WARNING') AS "WARNING",
       count(*) FILTER (WHERE severity = 'ERROR') AS "ERROR",
       count(*) FILTER (WHERE severity = 'CRITICAL') AS "CRITICAL"
FROM logs WHERE machine_id IS NOT NULL AND severity IS NOT NULL GROUP BY machine_id""",
    "severity_counts": _with(LOGS) + """
SELECT d.ord, d.severity, coalesce(c.n, 0) AS n
FROM (VALUES (0, 'INFO'), (1, 'WARNING'), (2, 'ERROR'), (3, 'CRITICAL')) d(ord, severity)
LEFT JOIN (SELECT severity, count(*) AS n FROM logs GROUP BY severity) c USING (severity)""",
    "category_counts": _with(LOGS) + """
SELECT failure_category, count(*) AS n FROM logs
WHERE failure_category IS NOT NULL AND failure_category <> '' GROUP BY failure_category""",
    "overview": _with(LOGS, ENRICHED) + """
SELECT *, printf('%.1f%%', pct) AS error_rate_text, cast(printf('%.1f', pct) AS double) AS error_rate FROM (
SELECT count(*) AS total_entries, format('{:,}', count(*)) AS entries_text,
       avg(CASE WHEN severity IN ('ERROR', 'CRITICAL') THEN 1e0 ELSE 0e0 END) * 100 AS pct,
       count(DISTINCT machine_id) AS machines,
       cast(sum(cast(is_anomaly AS bigint)) AS bigint) AS sensor_anomalies,
       min("timestamp") AS time_start, max("timestamp") AS time_end
FROM enriched)""".replace("SELECT *, printf", "SELECT * EXCLUDE (pct), printf"),
    "machine_list": _with(LOGS) + "\nSELECT DISTINCT machine_id FROM logs WHERE machine_id IS NOT NULL",
    "report_stats": _with(LOGS, FAILS, ENRICHED, _STATS_CTES) + "\nSELECT * FROM stats",
    "failure_window_listing": _with(LOGS, FAILS) + """
SELECT machine_id, start,
       machine_id || ' — ' || strftime(start, '%Y-%m-%d %H:%M') || ' (' || cast(event_count AS varchar)
         || ' events, ' || printf('%.0f', duration_minutes) || ' min)' AS title,
       max_severity, event_count, printf('%.0f', duration_minutes) AS duration_text,
       replace(error_codes, ',', ', ') AS error_codes_text,
       replace(failure_categories, ',', ', ') AS categories_text
FROM windows""",
    "prepared_windows": _with(LOGS, FAILS) + f"""
SELECT machine_id, {ts_text('start')} AS start, {ts_text('"end"')} AS "end",
       cast(printf('%.1f', duration_minutes) AS double) AS duration_minutes, event_count, max_severity,
       replace(error_codes, ',', ', ') AS error_codes
FROM windows ORDER BY windows.start, machine_id LIMIT 10""",
    "prepared_entries": _with(LOGS, FAILS) + f""",
top AS (SELECT machine_id, start FROM windows ORDER BY start, machine_id LIMIT 10)
SELECT e.machine_id, e.window_start, e.seq, {ts_text('e."timestamp"')} AS "timestamp", e.severity,
       coalesce(e.error_code, '') AS error_code, {", ".join('e.' + s for s in SENSORS)},
       coalesce(e.operator_notes, '') AS operator_notes
FROM entries e JOIN top t ON e.machine_id = t.machine_id AND e.window_start = t.start""",
    "code_category": _with(LOGS, FAILS) + """
SELECT f.event_id, f.machine_id, f."timestamp", f.error_code, f.failure_category, c.catalog_category,
       coalesce(c.catalog_category = f.failure_category, false) AS category_matches
FROM fails f LEFT JOIN (VALUES """ + ", ".join(
        f"('{code}', '{cat}')" for cat, codes in CODES.items() for code in codes) + """) c(error_code, catalog_category) ON f.error_code = c.error_code""",
    "out_of_range": _with(LOGS) + "\n" + "\nUNION ALL\n".join(
        f"SELECT machine_id, '{x}' AS sensor, count({x}) AS n_readings, "
        f"count(*) FILTER (WHERE {x} < {lo!r} OR {x} > {hi!r}) AS n_out_of_range "
        f"FROM logs WHERE machine_id IS NOT NULL GROUP BY machine_id"
        for x, lo, hi in RANGES),
    "signature_match": _with(LOGS, FAILS, _sig_ctes()) + "\nSELECT * FROM sigm",
    "parsed_responses": _with(LOGS, FAILS, _sig_ctes()) + """
SELECT machine_id, start_ts AS start, status, root_cause, failure_mode, severity_assessment FROM diag""",
    "diagnoses": _with(LOGS, FAILS, _sig_ctes()) + """
SELECT machine_id, start, "end", root_cause, failure_mode, confidence, severity_assessment, evidence,
       n_actions, parts_at_risk, pattern_notes, status FROM diag""",
    "recommended_actions": _with(LOGS, FAILS, _sig_ctes()) + """
SELECT machine_id, start,
       CASE WHEN n_actions > 0 THEN 1 END AS ord,
       CASE WHEN n_actions > 0 THEN priority END AS priority,
       CASE WHEN n_actions > 0 THEN action END AS action,
       CASE WHEN n_actions > 0 THEN downtime END AS estimated_downtime_hours,
       CASE WHEN n_actions > 0 THEN cast(downtime AS varchar) END AS estimated_downtime_text
FROM diag""",
    "fleet_issues": _with(LOGS, FAILS, _sig_ctes()) + """
SELECT failure_mode, count(*) AS n_windows, count(DISTINCT machine_id) AS n_machines,
       floor(avg(confidence) * 1e6 + 0.499) / 1e6 AS mean_confidence,
       count(*) FILTER (WHERE severity_assessment = 'CRITICAL') AS n_critical
FROM diag GROUP BY failure_mode""",
    "fleet_issue_machines": _with(LOGS, FAILS, _sig_ctes()) + """
SELECT failure_mode, machine_id, count(*) AS n_windows FROM diag GROUP BY failure_mode, machine_id""",
    "fleet_prompt": _with(LOGS, FAILS, _sig_ctes()) + """
SELECT machine_id, start || ' → ' || "end" AS time_range, root_cause, failure_mode,
       severity_assessment AS severity, n_actions, true AS counted
FROM diag""",
    "fleet_summary": _with(LOGS, FAILS, _sig_ctes(), _FLEET_CTES) + f"""
SELECT {_FLEET_TEXT} AS executive_summary,
       (SELECT count(*) FROM known)::INTEGER AS n_issues,
       coalesce((SELECT string_agg(failure_mode || ' failures', '|' ORDER BY rank) FROM known), '') AS issues,
       coalesce((SELECT string_agg(CASE WHEN n_crit > 0 THEN 'IMMEDIATE' ELSE 'THIS_WEEK' END, '|' ORDER BY rank)
                 FROM known), '') AS priorities,
       (SELECT count(*) FROM known WHERE 10 * n_crit > n)::INTEGER AS n_alerts,
       cast(printf('%.1f', coalesce((SELECT sum(hours) FROM issues), 0e0)) AS double) AS savings_hours,
       'ok' AS status""",
    "fleet_top_issues": _with(LOGS, FAILS, _sig_ctes(), _FLEET_CTES) + """
SELECT CAST(rank AS INTEGER) AS rank, failure_mode || ' failures' AS issue, n_machines || ' machines' AS affected_machines,
       n || ' windows' AS frequency, n_crit || ' critical windows' AS business_impact
FROM known""",
    "fleet_priorities": _with(LOGS, FAILS, _sig_ctes(), _FLEET_CTES) + """
SELECT CAST(rank AS INTEGER) AS rank, CASE WHEN n_crit > 0 THEN 'IMMEDIATE' ELSE 'THIS_WEEK' END AS priority,
       'Inspect the ' || lower(failure_mode) || ' subsystem' AS action, n_machines || ' machines' AS machines,
       n || ' failure windows' AS rationale
FROM known""",
    "fleet_alerts": _with(LOGS, FAILS, _sig_ctes(), _FLEET_CTES) + """
SELECT CAST(row_number() OVER (ORDER BY rank) AS INTEGER) AS rank, 'Over a tenth of ' || failure_mode || ' windows are critical' AS alert
FROM known WHERE 10 * n_crit > n""",
    "fleet_section": _with(LOGS, FAILS, _sig_ctes(), _FLEET_CTES) + f"""
SELECT {_FLEET_SECTION} AS text""",
    "diagnosis_titles": _with(LOGS, FAILS, _sig_ctes()) + """
SELECT machine_id, start, CASE WHEN severity_assessment = 'CRITICAL' THEN '🔴' ELSE '🟠' END || ' ' || machine_id || ' — '
       || failure_mode || ' (' || printf('%.0f', confidence * 100) || '% confidence)' AS title FROM diag""",
    "action_lines": _with(LOGS, FAILS, _sig_ctes()) + """
SELECT machine_id, start, 1 AS ord, '- [' || priority || '] ' || action || ' (~' || cast(downtime AS varchar)
       || 'h downtime)' AS line FROM diag WHERE n_actions > 0""",
    "window_notes": _with(LOGS, FAILS) + """
SELECT machine_id, window_start AS start, seq, operator_notes AS note FROM entries WHERE operator_notes <> ''""",
    "failure_windows_gap15": _with(LOGS, FAILS.replace("INTERVAL 60 MINUTES", "INTERVAL 15 MINUTES")) + """
SELECT machine_id, start, "end", event_count, max_severity FROM windows""",
    "anomaly_flags_1h": _with(LOGS) + f"""
SELECT event_id, machine_id, cast(CASE WHEN machine_id IS NULL THEN 0 ELSE n END AS integer) AS anomaly_count,
       machine_id IS NOT NULL AND n > 0 AS is_anomaly FROM (SELECT *, {_COUNT_1H} AS n FROM logs)""",
    "machine_trend": _with(LOGS, ENRICHED) + """
SELECT machine_id, "timestamp", event_id, gas_pressure_psi AS value,
       floor(gas_pressure_psi_rolling_mean * 1e6 + 0.499) / 1e6 AS rolling_mean, gas_pressure_psi_anomaly AS is_anomaly
FROM enriched WHERE machine_id = 'M-2'""",
    "load_logs": _with(LOGS) + f"""
SELECT cast(event_id AS varchar) AS source_row, CASE WHEN event_id % 19 = 3 THEN NULL ELSE "timestamp" END AS "timestamp",
       CASE WHEN event_id % 23 = 4 THEN NULL ELSE machine_id END AS machine_id,
       CASE WHEN event_id % 29 = 5 THEN NULL ELSE severity END AS severity, nullif(error_code, '') AS error_code,
       nullif(failure_category, '') AS failure_category, {", ".join(_cell(i, s) for i, s in enumerate(SENSORS))},
       CASE WHEN event_id % 13 = 6 THEN NULL ELSE nullif(operator_notes, '') END AS operator_notes,
       cast(NULL AS varchar) AS material, event_id % 19 = 3 OR {_BAD_CELL} AS corrupt
FROM logs""",
    "fleet_tree": _with(LOGS, FAILS, _sig_ctes()) + """
SELECT failure_mode AS issue, string_agg(DISTINCT machine_id, ',' ORDER BY machine_id) AS machines, count(*) AS n,
       (SELECT count(*) FROM diag) AS num_windows, (SELECT count(*) FROM diag) || ' windows' AS executive_summary, 'ok' AS status,
       cast(0 AS BIGINT) AS failed_parts,
       round((SELECT sum(CASE WHEN failure_mode <> 'UNKNOWN' THEN downtime ELSE 0e0 END) FROM diag), 1) AS hours
FROM diag GROUP BY failure_mode""",
    "model_diagnoses": _with(LOGS, FAILS) + f"""
SELECT machine_id, {ts_text('start')} AS start, {ts_text('"end"')} AS "end",
       CASE WHEN event_count % 5 = 4 THEN 'Analysis failed: Failed to parse LLM response'
            ELSE event_count || ' events on ' || machine_id END AS root_cause,
       CASE WHEN event_count % 5 = 4 THEN 'UNKNOWN' WHEN event_count > 1 THEN 'THERMAL' ELSE 'OPTICAL' END AS failure_mode,
       CASE WHEN event_count % 5 = 4 THEN 0e0 ELSE event_count / 16e0 END AS confidence,
       CASE WHEN event_count % 5 = 4 THEN 'parse_error' ELSE 'ok' END AS status,
       CASE WHEN event_count % 5 = 4 THEN '' ELSE machine_id END AS evidence
FROM windows""",
    "window_values": _with(LOGS, FAILS) + """
SELECT machine_id, window_start AS start, 'failure_category' AS field, failure_category AS value, count(*) AS n
FROM entries WHERE failure_category <> '' GROUP BY ALL
UNION ALL
SELECT machine_id, window_start, 'error_code', error_code, count(*) FROM entries WHERE error_code <> '' GROUP BY ALL""",
    "window_value_counts": _with(LOGS, FAILS) + """
SELECT machine_id, window_start AS start, count(DISTINCT nullif(failure_category, '')) AS n_categories,
       count(DISTINCT nullif(error_code, '')) AS n_codes
FROM entries GROUP BY ALL HAVING n_categories + n_codes > 0""",
    "csv_line_breaks": _with(LOGS) + f"""
SELECT cast(l.event_id AS varchar) AS source_row, l."timestamp", l.machine_id, l.severity, nullif(l.error_code, '') AS error_code,
       {", ".join("l." + s for s in SENSORS)},
       CASE WHEN l.event_id % 3 = 0 THEN 'seen "' || e.event_type || '",' || chr(10) || 'then ' || l.event_id || chr(10) || chr(10) || '"'
            WHEN l.event_id % 3 = 1 THEN e.event_type || ', again' END AS operator_notes, false AS corrupt
FROM logs l JOIN events e ON l.event_id = e.event_id""",
    "reply_records": _with(LOGS, FAILS) + """,
kinds AS (SELECT machine_id, start, cast((event_count * 5 + minute(start)) % 8 AS bigint) AS kind FROM windows)
SELECT machine_id, start, kind,
       CASE WHEN kind IN (0, 4, 6, 7) THEN 'ok' WHEN kind = 2 THEN 'model_error' ELSE 'parse_error' END AS status,
       CASE WHEN kind IN (0, 6, 7) THEN 'cause ' || machine_id WHEN kind = 4 THEN 'typed'
            WHEN kind = 2 THEN 'Analysis failed: over quota' ELSE 'Analysis failed: Failed to parse LLM response' END AS root_cause,
       'UNKNOWN' AS failure_mode, CASE WHEN kind IN (0, 6, 7) THEN 0.25e0 ELSE 0e0 END AS confidence,
       CASE WHEN kind IN (0, 6, 7) THEN 'a|b' ELSE '' END AS evidence,
       CASE WHEN kind IN (0, 6, 7) THEN 1 ELSE 0 END AS n_actions
FROM kinds""",
    "window_prompts": _with(LOGS, FAILS) + f""",
top AS (SELECT *, {ts_text('start')} AS start_text, {ts_text('"end"')} AS end_text,
               cast(printf('%.1f', duration_minutes) AS double) AS minutes
        FROM windows ORDER BY start, machine_id LIMIT 10)
SELECT machine_id, start_text AS start, end_text AS "end", event_count, 0 AS part, {_PROMPT_HEAD} AS head,
       'Respond with ONLY valid JSON in this exact schema:' AS ask FROM top""",
    "window_prompt_entries": _with(LOGS, FAILS) + f""",
top AS (SELECT machine_id, start FROM windows ORDER BY start, machine_id LIMIT 10)
SELECT e.machine_id, {ts_text('e.window_start')} AS start, cast(e.seq AS integer) AS seq,
       {ts_text('e."timestamp"')} AS "timestamp", e.severity, coalesce(e.error_code, '') AS error_code,
       {", ".join('e.' + s for s in SENSORS)}, coalesce(e.operator_notes, '') AS operator_notes
FROM entries e JOIN top t ON e.machine_id = t.machine_id AND e.window_start = t.start""",
    "report_rows": _with(LOGS, FAILS, ENRICHED, _STATS_CTES, _sig_ctes(), _FLEET_CTES) + f"""
SELECT * FROM (VALUES (0, 0, '', '# Manufacturing Log Diagnostic Report'), (0, 1, '', ''),
  (0, 2, '', '*Generated: 2024-02-01 00:00:00*'), (0, 3, '', ''), (1, 0, '', '## Dataset Overview'), (1, 1, '', ''),
  (1, 2, '', '| Metric | Value |'), (1, 3, '', '|--------|-------|'), (1, 1000, '', ''),
  (3, 0, '', '## Detailed Failure Analysis'), (3, 1, '', '')) t(section_ord, ord, tie, text)
UNION ALL SELECT 1, ord + 10, tie, '| ' || metric || ' | ' || value || ' |' FROM stats
UNION ALL SELECT 1, 17, '', '| Failure windows analyzed | ' || count(*) || ' |' FROM diag
UNION ALL SELECT 2, 0, '', {_FLEET_SECTION}
UNION ALL SELECT 4, epoch_us(start_ts), machine_id, {_section_sql()} FROM diag""",
    "report_sections": _with(LOGS, FAILS, _sig_ctes()) + f"""
SELECT machine_id, start, {_section_sql()} AS text FROM diag""",
}

# The same results by another way: catalogs as tables, windows from a part of the log, batch by batch.
ORACLE["out_of_range_table"] = ORACLE["out_of_range"]
ORACLE["signature_match_table"] = ORACLE["signature_match"]
ORACLE["first_window_entries"] = ORACLE["prepared_entries"].replace("LIMIT 10", "LIMIT 500")
ORACLE["incremental_windows"] = _with(LOGS, FAILS, _sig_ctes(), ENRICHED) + """
SELECT w.machine_id, w.start, w."end", w.event_count, w.max_severity, s.failure_mode, w.error_codes, o.*
FROM windows w JOIN sigm s ON w.machine_id = s.machine_id AND w.start = s.start,
     (SELECT count(*) AS total_entries, cast(sum(cast(is_anomaly AS bigint)) AS bigint) AS sensor_anomalies,
             cast(printf('%.1f', avg(CASE WHEN severity IN ('ERROR', 'CRITICAL') THEN 1e0 ELSE 0e0 END) * 100) AS double) AS error_rate,
             count(DISTINCT machine_id) AS machines, min("timestamp") AS time_start, max("timestamp") AS time_end FROM enriched) o"""
