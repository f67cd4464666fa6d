"""SQL for DuckDB that gives each registered query's rows from the raw tables."""

from __future__ import annotations

from logweir.plans.tables import DUP_SQL, RAW_SQL, WIRE_SQL

WIRE = f"logs_wire AS ({WIRE_SQL})"
RAW = "logs_raw AS (%s)" % RAW_SQL.format(
    plain="strftime(timestamp, '%Y-%m-%d %H:%M:%S')",
    iso="strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%fZ')",
    logs="logs_wire",
)
DUP = "logs_dup AS (%s)" % DUP_SQL.format(logs="logs_wire")

SEVERITY = """CASE
    WHEN upper(trim({0})) IN ('FATAL', 'CRITICAL', 'EMERGENCY', 'EMERG') THEN 'FATAL'
    WHEN upper(trim({0})) IN ('ERROR', 'ERR') THEN 'ERROR'
    WHEN upper(trim({0})) IN ('WARNING', 'WARN') THEN 'WARNING'
    WHEN upper(trim({0})) IN ('INFO', 'INFORMATION', '') THEN 'INFO'
    WHEN upper(trim({0})) IN ('DEBUG', 'TRACE') THEN 'DEBUG'
    ELSE upper(trim({0})) END"""
REDACT = r"""regexp_replace(regexp_replace(regexp_replace({0},
    '(?i)(password|passwd|secret|token|api_key|apikey|authorization)\s*[:=]\s*\S+', '[REDACTED]', 'g'),
    '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}\b', '[REDACTED]', 'g'),
    '\b(?:\d{{4}}[- ]?){{3}}\d{{4}}\b', '[REDACTED]', 'g')"""
TEMPLATE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({0},
    '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}', '<UUID>', 'g'),
    '\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}', '<IP>', 'g'),
    '[0-9a-f]{{8,}}', '<HEX>', 'g'),
    '\b\d+\b', '<N>', 'g')"""
NUMBER = "CAST(event_id AS BIGINT)"
STATUS = f"(200 + {NUMBER} % 300)"
# Compact JSON text with sorted keys.
PLAIN_ATTRIBUTES = f"""CASE WHEN {NUMBER} % 7 = 0
    THEN concat('{{"api_token":"t', event_id, '","http.status_code":', {STATUS}, '}}')
    ELSE replace(attributes, ': ', ':') END"""
SAFE_ATTRIBUTES = f"""CASE WHEN {NUMBER} % 7 = 0
    THEN concat('{{"api_token":"[REDACTED]","http.status_code":', {STATUS}, '}}')
    ELSE replace(attributes, ': ', ':') END"""
K = "CASE WHEN {n} % 7 = 0 THEN NULL ELSE CAST(json_extract_string(attributes, '$.k') AS BIGINT) END".format(n=NUMBER)
REST = "trace_id, source, region, version"

HOT = f"""logs_hot AS (
  SELECT event_id, date_trunc('milliseconds', timestamp) AS timestamp, service,
    {SEVERITY.format('severity')} AS severity, {REDACT.format('message')} AS message,
    {SAFE_ATTRIBUTES} AS attributes, {REST}
  FROM logs_wire
  WHERE date_trunc('milliseconds', timestamp) > TIMESTAMP '2024-01-01 00:00:00')"""
FAULT = f"{NUMBER} % 100"
# Events that decode; every hundredth plus five has lost its service.
GOOD = f"""good AS (
  SELECT event_id, timestamp, CASE WHEN {FAULT} = 5 THEN '' ELSE service END AS service,
    severity, message, {PLAIN_ATTRIBUTES} AS attributes, {REST}
  FROM logs_wire WHERE {FAULT} > 4)"""
ERROR = "severity IN ('ERROR', 'FATAL', 'CRITICAL')"
TEXTS = """texts AS (
  SELECT concat('e', event_id) AS id, message AS text FROM logs_wire
  UNION ALL SELECT concat('d', doc_id), text FROM documents
  UNION ALL SELECT concat('c', conv_id, '.', turn), text FROM conversations)"""
WHOLE_ALERT = "CAST(floor(epoch(triggered_at)) AS BIGINT) % 3 <> 0"
PREVIEW = "CASE WHEN length({0}) > 120 THEN concat(substr({0}, 1, 120), '...') ELSE {0} END"
SAMPLES = """samples AS (
  SELECT user_id % 10 AS worker, ts, event_id, value AS latency_ms, CAST(1 AS BIGINT) AS sent,
    CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS accepted,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS rejected
  FROM events)"""
SENT_EVENTS = f"""sent AS (
  SELECT CAST(floor({NUMBER} / 20) AS BIGINT) AS request_id, {NUMBER} % 20 AS pos, event_id, timestamp,
    CASE WHEN {NUMBER} % 50 = 9 THEN '' ELSE service END AS service, severity,
    CASE WHEN {NUMBER} % 70 = 11 THEN '' ELSE message END AS message, source
  FROM logs_wire)"""
CENTS = "printf('%.2f', {0})"
RATE_ALERT = (
    "concat('Error rate ', " + CENTS.format("CAST(errors AS DOUBLE) / total * 100")
    + ", '% exceeds threshold 5.00% for service ', service)"
)
RUNNING = f"""running AS (
  SELECT service, time_bucket(INTERVAL 1 DAY, timestamp) AS window_start, timestamp, event_id,
    CAST(count(*) OVER w AS BIGINT) AS total,
    CAST(count(*) FILTER (WHERE {ERROR}) OVER w AS BIGINT) AS errors
  FROM logs_wire
  WINDOW w AS (PARTITION BY service, time_bucket(INTERVAL 1 DAY, timestamp)
    ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING))"""
ALERTS = f"""alerts AS (
  SELECT concat('alert-', service, '-', event_id) AS id, concat('error_rate_', service) AS fingerprint,
    timestamp AS triggered_at, service, CAST(errors AS DOUBLE) / total AS value, {RATE_ALERT} AS message
  FROM running WHERE total >= 20 AND CAST(errors AS DOUBLE) / total >= 0.05)"""


def chain(source: str, key: str, gap: str, strict: bool) -> str:
    """Recursive CTE `chain(key, tick)`: greedy spacing of (key, tick) in `source`."""
    compare = ">" if strict else ">="
    return f"""chain AS (
  SELECT {key}, min(tick) AS tick FROM {source} GROUP BY {key}
  UNION ALL
  SELECT c.{key}, (SELECT min(s.tick) FROM {source} s WHERE s.{key} = c.{key} AND s.tick {compare} c.tick + {gap})
  FROM chain c
  WHERE EXISTS (SELECT 1 FROM {source} s WHERE s.{key} = c.{key} AND s.tick {compare} c.tick + {gap}))"""


def recurring(events: str) -> list[str]:
    return [
        f"""hits AS (
  SELECT service, {TEMPLATE.format('message')} AS template, date_trunc('milliseconds', timestamp) AS tick
  FROM {events} WHERE {ERROR})""",
        """gaps AS (
  SELECT *, CASE WHEN tick - lag(tick) OVER (PARTITION BY service, template ORDER BY tick) <= INTERVAL 2 DAY
    THEN 0 ELSE 1 END AS fresh FROM hits)""",
        """seen AS (
  SELECT *, concat(service, '|', template, '|',
    sum(fresh) OVER (PARTITION BY service, template ORDER BY tick)) AS session FROM gaps)""",
        """counted AS (
  SELECT *, row_number() OVER (PARTITION BY session ORDER BY tick) AS n FROM seen)""",
        "over_limit AS (SELECT * FROM counted WHERE n > 20)",
        chain("over_limit", "session", "INTERVAL 15 MINUTE", True),
        """fired AS (
  SELECT o.service, o.template, concat(o.service, ':', md5(o.template)) AS fingerprint, o.tick, min(o.n) AS n
  FROM over_limit o JOIN chain c ON o.session = c.session AND o.tick = c.tick
  GROUP BY ALL)""",
        """recurring AS (
  SELECT concat('alert-fp-', fingerprint, '-', CAST(epoch_ms(tick) AS VARCHAR)) AS id,
    'recurring-error' AS rule_id, service, fingerprint, 'ERROR' AS severity, CAST(n AS DOUBLE) AS value,
    concat('Recurring error pattern detected ', n, ' times: ', template) AS message,
    tick AS triggered_at, 'firing' AS status FROM fired)""",
    ]


def anchored(events: str) -> list[str]:
    return [
        f"instants AS (SELECT *, date_trunc('milliseconds', timestamp) AS tick FROM {events})",
        chain("instants", "service", "INTERVAL 1 DAY", True),
    ]


ANCHORED_BODY = f"""SELECT i.service, c.tick AS window_start, count(*) AS total, count(*) FILTER (WHERE {ERROR}) AS errors
  FROM instants i JOIN chain c ON i.service = c.service AND i.tick >= c.tick AND i.tick <= c.tick + INTERVAL 1 DAY
  GROUP BY 1, 2"""


def sql(*parts: str) -> str:
    *ctes, body = parts
    recursive = "RECURSIVE " if any(c.startswith("chain AS") for c in ctes) else ""
    return (f"WITH {recursive}" + ",\n".join(ctes) + "\n" if ctes else "") + body


COUNTS = "counts AS (SELECT service, severity, count(*) AS n FROM logs_hot GROUP BY 1, 2)"
ERROR_SUM = f"CAST(coalesce(sum(n) FILTER (WHERE {ERROR}), 0) AS BIGINT)"
DAY = "strftime({0}, '%Y-%m-%d')"
ROUTE_DAY = (
    f"CASE WHEN p.pos % 100 IN (0, 1, 3) THEN '2024-01-31' ELSE {DAY.format('p.event_time')} END"
)
ROUTE_SERVICE = "CASE WHEN p.pos % 100 IN (0, 1, 3, 5) THEN '_unknown' ELSE w.service END"
ROUTED = f"""routed AS (
  SELECT p.value, {ROUTE_DAY} AS day,
    CASE WHEN p.pos % 100 IN (0, 1, 3) THEN 0 ELSE CAST(hour(p.event_time) AS INTEGER) END AS hour,
    {ROUTE_SERVICE} AS service
  FROM logs_raw p JOIN logs_wire w ON w.event_id = CAST(p.pos AS VARCHAR))"""
DECODE_ERROR = """CASE pos % 100 WHEN 0 THEN 'unmarshal: invalid JSON' WHEN 1 THEN 'unmarshal: invalid JSON'
    WHEN 2 THEN 'unmarshal: event_id is not a string' WHEN 3 THEN 'unmarshal: timestamp is not RFC 3339'
    WHEN 4 THEN 'unmarshal: attributes is not an object' END"""
EVENT_TEXT = f"""concat('{{"event_id":"', event_id, '","timestamp":"', strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%fZ'),
    '","service":"', service, '","severity":"', severity, '","message":"', message, '","attributes":',
    {PLAIN_ATTRIBUTES}, CASE WHEN trace_id = '' THEN '' ELSE concat(',"trace_id":"', trace_id, '"') END,
    ',"source":"', source, '","region":"', region, '","version":"', version, '"}}')"""
TIMELINE = """SELECT time_bucket(INTERVAL {bucket}, timestamp) AS bucket, count(*) AS count,
  count(*) FILTER (WHERE severity = 'ERROR') AS error_count FROM logs_hot
  WHERE timestamp >= TIMESTAMP '2024-01-31' - INTERVAL {hours} HOUR AND timestamp <= TIMESTAMP '2024-01-31'
  {more} GROUP BY 1"""
HOT_MATCH = """timestamp >= TIMESTAMP '2024-01-24 00:00:01' AND timestamp <= TIMESTAMP '2024-01-31'
  AND service = 'billing' AND severity = 'ERROR' AND contains(lower(message), 'timed out')"""
COLUMNS = "event_id, timestamp, service, severity, message, attributes, trace_id, source, region, version"
MERGED = f"""merged AS (
  SELECT {COLUMNS} FROM logs_hot WHERE timestamp >= TIMESTAMP '2024-01-24' AND timestamp <= TIMESTAMP '2024-01-31'
    AND contains(lower(message), 'cache')
  UNION ALL
  SELECT {COLUMNS} FROM good WHERE timestamp >= TIMESTAMP '2024-01-20' AND timestamp < TIMESTAMP '2024-01-24'
    AND contains(lower(message), 'cache'))"""
BOUNDS = "bounds AS (SELECT 0.001::DOUBLE * power(2, i) AS le, i FROM range(10) t(i) UNION ALL SELECT 'inf'::DOUBLE, 10)"


def buckets(keys: str) -> list[str]:
    return [
        SAMPLES,
        BOUNDS,
        "timed AS (SELECT *, latency_ms / 1000.0::DOUBLE AS seconds, strftime(ts, '%Y-%m-%d') AS day FROM samples)",
        f"""cells AS (SELECT {keys}, le, i, count(*) FILTER (WHERE seconds <= le) AS cumulative
  FROM timed, bounds GROUP BY ALL)""",
    ]


def window_values(window: str) -> str:
    return f"""SELECT l.service, time_bucket(INTERVAL {window}, l.timestamp) AS window_start, count(*) AS total,
    CAST(count(*) FILTER (WHERE {ERROR}) AS DOUBLE) / count(*) AS error_rate,
    list_sort(list(e.value))[CAST(floor(count(*) * 0.99::DOUBLE) AS BIGINT) + 1] AS p99
  FROM logs_wire l JOIN events e ON l.event_id = CAST(e.event_id AS VARCHAR) GROUP BY 1, 2"""


ORACLES: dict[str, str] = {
    # sources and sinks
    "ingest_explode": sql(WIRE, SENT_EVENTS, "SELECT * FROM sent"),
    "cold_scan": sql(WIRE, GOOD, f"SELECT {COLUMNS} FROM good"),
    "cold_scan_pruned": sql(
        WIRE, GOOD,
        """SELECT event_id, timestamp, severity, message FROM good WHERE service = 'billing'
  AND timestamp BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 18:00:00'""",
    ),
    "scan_budget": sql(
        WIRE, RAW, ROUTED,
        """SELECT day, count(*) AS scanned FROM routed GROUP BY 1
  UNION ALL SELECT 'refused', 100 WHERE (SELECT count(*) FROM routed) > 100""",
    ),
    "normalize_events": sql(WIRE, HOT, f"SELECT {COLUMNS} FROM logs_hot"),
    "hot_scan": sql(WIRE, HOT, f"SELECT {COLUMNS} FROM logs_hot"),
    "list_partitions": sql(
        WIRE, RAW, ROUTED, "SELECT DISTINCT day, service FROM routed WHERE service = 'billing'"
    ),
    "replay_archive": sql(
        WIRE,
        f"""SELECT event_id, date_trunc('milliseconds', timestamp) AS timestamp,
    CASE WHEN {FAULT} = 5 THEN '' ELSE service END AS service, {SEVERITY.format('severity')} AS severity,
    {REDACT.format('message')} AS message, {SAFE_ATTRIBUTES} AS attributes, {REST}
  FROM logs_wire WHERE {FAULT} > 4""",
    ),
    "attribute_upsert": sql(
        WIRE,
        f"""SELECT event_id, 'production' AS environment, 'otel-collector' AS source,
    CAST({K} AS VARCHAR) AS k,
    CASE WHEN {NUMBER} % 7 = 0 THEN CAST({STATUS} AS VARCHAR) END AS status_code FROM logs_wire""",
    ),
    "raw_log_events": sql(
        WIRE,
        f"""SELECT service, CASE {NUMBER} % 10 WHEN 0 THEN TIMESTAMP '2024-01-31 00:00:00'
      WHEN 1 THEN date_trunc('second', timestamp) ELSE date_trunc('milliseconds', timestamp) END AS timestamp,
    CASE WHEN {NUMBER} % 10 = 0 THEN 'INFO' ELSE {SEVERITY.format('severity')} END AS severity,
    {REDACT.format('message')} AS message, 'production' AS environment, 'files' AS source, true AS named
  FROM logs_wire""",
    ),
    "stream_raw_log_events": sql(
        WIRE,
        f"""SELECT service, CASE {NUMBER} % 10 WHEN 0 THEN TIMESTAMP '2024-01-31 00:00:00'
      WHEN 1 THEN date_trunc('second', timestamp) ELSE date_trunc('milliseconds', timestamp) END AS timestamp,
    CASE WHEN {NUMBER} % 10 = 0 THEN 'INFO' ELSE {SEVERITY.format('severity')} END AS severity,
    {REDACT.format('message')} AS message, 'production' AS environment, 'files' AS source, true AS named
  FROM logs_wire""",
    ),
    "hot_append": sql(
        WIRE, HOT,
        f"SELECT {DAY.format('timestamp')} AS day, service, severity, count(*) AS events FROM logs_hot GROUP BY 1, 2, 3",
    ),
    "hot_append_two_jobs": sql(
        WIRE, HOT,
        f"SELECT {DAY.format('timestamp')} AS day, service, severity, count(*) AS events FROM logs_hot GROUP BY 1, 2, 3",
    ),
    "archive_two_jobs": sql(WIRE, RAW, ROUTED, "SELECT value, day, service FROM routed"),
    "append_ack": sql(
        WIRE, HOT, "SELECT count(*) AS sent_rows, count(*) AS committed_rows FROM logs_hot"
    ),
    "hot_retention": sql(
        WIRE,
        """SELECT service, count(*) AS kept, min(t) AS oldest, max(t) AS newest
  FROM (SELECT service, date_trunc('milliseconds', timestamp) AS t FROM logs_wire)
  WHERE t + INTERVAL 30 DAY > TIMESTAMP '2024-02-10' GROUP BY 1""",
    ),
    "archive_write": sql(WIRE, RAW, ROUTED, "SELECT value, day, service FROM routed"),
    "archive_normalized": sql(WIRE, HOT, f"SELECT {COLUMNS} FROM logs_hot"),
    "dlq": sql(
        WIRE, RAW,
        f"""SELECT '' AS event_id, value AS raw, {DECODE_ERROR} AS error,
    TIMESTAMP '2024-01-31' AS failed_at, 'processing-worker' AS component
  FROM logs_raw WHERE pos % 100 < 5""",
    ),
    "keyed_log": sql(
        WIRE, f"SELECT concat(service, ':', source) AS key, {EVENT_TEXT} AS value FROM logs_wire"
    ),
    "alert_records": sql(
        WIRE, *recurring("logs_wire"),
        """SELECT fingerprint AS key, concat('{"id":"', id, '","rule_id":"', rule_id, '","service":"', service,
    '","fingerprint":"', fingerprint, '","severity":"ERROR","value":', printf('%.1f', value), ',"message":"',
    message, '","triggered_at":"', strftime(triggered_at, '%Y-%m-%dT%H:%M:%S.%fZ'), '","status":"firing"}') AS value
  FROM recurring""",
    ),
    "notification_payload": sql(
        WIRE, *recurring("logs_wire"),
        """SELECT id AS alert_id, service, rule_id AS rule, severity, message, value, fingerprint, triggered_at,
    status FROM recurring""",
    ),
    "decode_alerts": sql(
        WIRE, *recurring("logs_wire"),
        f"""SELECT fingerprint AS key, {", ".join(
            f"CASE WHEN {WHOLE_ALERT} THEN {c} END AS {c}" for c in
            ("id", "rule_id", "service", "fingerprint", "severity", "value", "message", "triggered_at", "status"))},
    CASE WHEN NOT ({WHOLE_ALERT}) THEN 'unmarshal: not an alert' END AS error FROM recurring""",
    ),
    "stream_notifications": sql(
        WIRE, *recurring("logs_wire"),
        f"""SELECT id AS alert_id, service, rule_id AS rule, severity, message, value, fingerprint, triggered_at,
    status FROM recurring WHERE {WHOLE_ALERT}""",
    ),
    # projections
    "decode_strict": sql(
        WIRE,
        f"""SELECT pos, {DECODE_ERROR} AS decode_error,
    CASE WHEN pos % 100 IN (0, 1) THEN '' ELSE event_id END AS event_id,
    CASE WHEN pos % 100 IN (0, 1, 3) THEN NULL ELSE timestamp END AS timestamp,
    CASE WHEN pos % 100 IN (0, 1, 5) THEN '' ELSE service END AS service,
    CASE WHEN pos % 100 IN (0, 1) THEN '' ELSE severity END AS severity,
    CASE WHEN pos % 100 IN (0, 1) THEN '' ELSE message END AS message,
    CASE WHEN pos % 100 IN (0, 1) THEN '' ELSE trace_id END AS trace_id
  FROM (SELECT *, {NUMBER} AS pos FROM logs_wire)""",
    ),
    "default_event_id": sql(
        WIRE,
        f"""SELECT event_id AS was, CASE WHEN {NUMBER} % 10 = 0
    THEN md5(concat(strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f'), '|', service, '|', message))
    ELSE event_id END AS event_id FROM logs_wire""",
    ),
    "default_timestamp": sql(
        WIRE,
        f"""SELECT event_id, CASE WHEN {NUMBER} % 10 = 0 THEN TIMESTAMP '2024-01-31' ELSE timestamp END AS timestamp
  FROM logs_wire""",
    ),
    "partition_key": sql(
        WIRE,
        """SELECT event_id, CASE WHEN source = 'src-0' THEN service ELSE concat(service, ':', source) END AS key
  FROM logs_wire""",
    ),
    "normalize_severity": sql(
        WIRE, f"SELECT event_id, {SEVERITY.format('severity')} AS severity FROM logs_wire"
    ),
    "redact_message": sql(
        WIRE, TEXTS, f"redacted AS (SELECT id, {REDACT.format('text')} AS t FROM texts)",
        "SELECT id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS chars FROM redacted",
    ),
    "message_template": sql(
        WIRE, TEXTS, f"templates AS (SELECT id, {TEMPLATE.format('text')} AS t FROM texts)",
        "SELECT id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS chars FROM templates",
    ),
    "redact_attributes": sql(
        WIRE, f"SELECT event_id, {SAFE_ATTRIBUTES} AS attributes FROM logs_wire"
    ),
    "attributes_text": sql(
        WIRE,
        f"""SELECT event_id, CASE WHEN {NUMBER} % 11 = 0 THEN 'null' ELSE {PLAIN_ATTRIBUTES} END AS attributes
  FROM logs_wire""",
    ),
    "attributes_parse": sql(
        WIRE,
        f"""SELECT event_id, {K} AS k, CASE WHEN {NUMBER} % 7 = 0 THEN {STATUS} END AS status_code
  FROM logs_wire""",
    ),
    "parse_timestamp": sql(
        WIRE,
        f"""SELECT event_id, CASE {NUMBER} % 4 WHEN 0 THEN date_trunc('milliseconds', timestamp)
    WHEN 1 THEN timestamp WHEN 2 THEN date_trunc('second', timestamp) - INTERVAL 2 HOUR END AS parsed
  FROM logs_wire""",
    ),
    "parse_timestamp_errors": sql(
        WIRE,
        f"""SELECT event_id, concat('parsing time "', strftime(timestamp, '%Y-%m-%d %H:%M'),
    '": neither a hot-table time nor RFC 3339') AS error FROM logs_wire WHERE {NUMBER} % 4 = 3""",
    ),
    "fingerprint": sql(
        WIRE,
        f"SELECT event_id, concat(service, ':', md5({TEMPLATE.format('message')})) AS fingerprint FROM logs_wire",
    ),
    "archive_routing": sql(
        WIRE, RAW, ROUTED, "SELECT day, hour, service, count(*) AS lines FROM routed GROUP BY 1, 2, 3"
    ),
    "log_preview": sql(
        WIRE, TEXTS,
        f"""SELECT id, {PREVIEW.format('text')} AS preview, '-' AS trace FROM texts
  UNION ALL SELECT concat('t', event_id), {PREVIEW.format('message')},
    CASE WHEN trace_id = '' THEN '-' ELSE concat(substr(trace_id, 1, 12), '...') END FROM logs_wire""",
    ),
    # filters and search
    "filter_time": sql(
        WIRE, HOT,
        """SELECT event_id, timestamp FROM logs_hot
  WHERE timestamp BETWEEN TIMESTAMP '2024-01-10 12:00:00' AND TIMESTAMP '2024-01-11 12:00:00'""",
    ),
    "filter_severity_hot": sql(
        WIRE, HOT, "SELECT event_id, severity FROM logs_hot WHERE severity = 'FATAL'"
    ),
    "filter_severity_cold": sql(
        WIRE, "SELECT event_id, severity FROM logs_wire WHERE lower(severity) = 'warn'"
    ),
    "search_text": sql(
        WIRE, HOT, "SELECT event_id, message FROM logs_hot WHERE contains(lower(message), 'charged')"
    ),
    "validate_events": sql(
        WIRE, GOOD,
        "SELECT CASE WHEN service = '' THEN 'false' ELSE 'true' END AS valid, count(*) AS events FROM good GROUP BY 1",
    ),
    "error_events": sql(WIRE, f"SELECT event_id, service, severity FROM logs_wire WHERE {ERROR}"),
    "attribute_filter": sql(
        WIRE, HOT,
        """SELECT event_id, service FROM logs_hot
  WHERE CAST(json_extract_string(attributes, '$."http.status_code"') AS BIGINT) >= 400""",
    ),
    "attribute_text_filter": sql(
        WIRE, HOT,
        f"""SELECT 'exact' AS match, event_id FROM logs_hot WHERE {NUMBER} % 7 = 0 AND {STATUS} = 404
  UNION ALL SELECT 'part', event_id FROM logs_hot WHERE {NUMBER} % 7 = 0""",
    ),
    "search_hot": sql(
        WIRE, HOT,
        f"SELECT {COLUMNS} FROM logs_hot WHERE {HOT_MATCH} ORDER BY timestamp DESC, event_id DESC LIMIT 20 OFFSET 5",
    ),
    "search_total": sql(WIRE, HOT, f"SELECT count(*) AS total FROM logs_hot WHERE {HOT_MATCH}"),
    "search_cold": sql(
        WIRE, GOOD,
        f"""SELECT {COLUMNS}, 'cold' AS tier FROM good
  WHERE timestamp BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-15 18:00:00'
    AND lower(severity) = 'critical' AND contains(lower(message), 'timed out')
  ORDER BY timestamp DESC, event_id DESC LIMIT 50 OFFSET 10""",
    ),
    "search_merged": sql(
        WIRE, HOT, GOOD, MERGED,
        f"SELECT {COLUMNS}, 'merged' AS tier FROM merged ORDER BY timestamp DESC, event_id DESC LIMIT 100 OFFSET 420",
    ),
    "search_merged_total": sql(WIRE, HOT, GOOD, MERGED, "SELECT count(*) AS total FROM merged"),
    "search_degraded": sql(
        WIRE, HOT,
        f"""SELECT {COLUMNS}, 'cold' AS degraded FROM logs_hot
  WHERE timestamp >= TIMESTAMP '2024-01-24' AND timestamp <= TIMESTAMP '2024-01-31'
    AND contains(lower(message), 'cache') ORDER BY timestamp DESC, event_id DESC LIMIT 100""",
    ),
    # joins
    "reconcile_tiers": sql(
        WIRE, HOT, GOOD,
        """SELECT CASE WHEN c.event_id IS NULL THEN 'hot_only' WHEN h.event_id IS NULL THEN 'cold_only' ELSE 'both' END
    AS status, count(*) AS events, count(h.event_id) AS hot_rows, count(c.event_id) AS cold_rows
  FROM logs_hot h FULL OUTER JOIN good c ON h.event_id = c.event_id GROUP BY 1""",
    ),
    "cross_check": sql(
        WIRE, RAW, ROUTED,
        """SELECT day, service, count(*) AS accepted, count(*) FILTER (WHERE NOT bad) AS processed,
    count(*) FILTER (WHERE bad) AS dead_lettered, count(*) AS archived, true AS balanced
  FROM (SELECT r.day, r.service, p.pos % 100 < 5 AS bad FROM routed r JOIN logs_raw p ON r.value = p.value AND p.pos % 100 <> 0
    UNION ALL SELECT r.day, r.service, true FROM routed r WHERE r.value = '{bad') GROUP BY 1, 2""",
    ),
    "rule_table": sql(
        WIRE, f"days AS ({window_values('1 DAY')})", f"halves AS ({window_values('12 HOUR')})",
        """SELECT 'r1' AS rule_id, 'error_rate' AS condition, service, window_start, total,
    round(error_rate, 6) AS value, 0.12::DOUBLE AS threshold FROM days WHERE total >= 20 AND error_rate >= 0.12::DOUBLE
  UNION ALL SELECT 'r2', 'error_rate', service, window_start, total, round(error_rate, 6), 0.05::DOUBLE FROM halves
    WHERE service = 'billing' AND total >= 10 AND error_rate >= 0.05::DOUBLE
  UNION ALL SELECT 'r3', 'event_volume', service, window_start, total, CAST(total AS DOUBLE), 40.0::DOUBLE FROM days
    WHERE total >= 40
  UNION ALL SELECT 'r4', 'latency_p99', service, window_start, total, round(p99, 6), 60.0::DOUBLE FROM days
    WHERE service = 'lookup' AND total >= 5 AND p99 >= 60""",
    ),
    # aggregations
    "timeline_5m": sql(WIRE, HOT, TIMELINE.format(bucket="5 MINUTE", hours=168, more="")),
    "timeline_1h": sql(
        WIRE, HOT, TIMELINE.format(bucket="1 HOUR", hours=720, more="AND service = 'billing'")
    ),
    "aggregates": sql(WIRE, HOT, COUNTS, "SELECT service, severity, n AS count FROM counts"),
    "nested_counts": sql(
        WIRE, HOT, COUNTS,
        """SELECT service, concat('{', string_agg(concat('"', severity, '":', n), ',' ORDER BY severity), '}') AS severities
  FROM counts GROUP BY 1""",
    ),
    "summary": sql(
        WIRE, HOT, COUNTS,
        f"""SELECT CAST(sum(n) AS BIGINT) AS total, {ERROR_SUM} AS errors, count(DISTINCT service) AS services,
    round({ERROR_SUM} / CAST(sum(n) AS DOUBLE) * 100, 6) AS error_rate FROM counts""",
    ),
    "service_breakdown": sql(
        WIRE, HOT, COUNTS,
        f"""SELECT *, round(errors / CAST(total AS DOUBLE) * 100, 6) AS error_rate,
    round(total / CAST(max(total) OVER () AS DOUBLE) * 100, 6) AS width
  FROM (SELECT service, CAST(sum(n) AS BIGINT) AS total, {ERROR_SUM} AS errors FROM counts GROUP BY 1)""",
    ),
    "severity_distribution": sql(
        WIRE, HOT, COUNTS,
        """SELECT severity, CAST(sum(n) AS BIGINT) AS count,
    round(sum(n) / CAST((SELECT sum(n) FROM counts) AS DOUBLE) * 100, 6) AS pct
  FROM counts WHERE severity IN ('FATAL', 'ERROR', 'WARNING', 'INFO', 'DEBUG') GROUP BY 1""",
    ),
    "timeline_scaled": sql(
        WIRE, HOT, f"t AS ({TIMELINE.format(bucket='1 HOUR', hours=720, more='')})",
        """SELECT *, round(count / CAST(max(count) OVER () AS DOUBLE), 6) AS count_share,
    round(error_count / CAST(max(count) OVER () AS DOUBLE), 6) AS error_share FROM t""",
    ),
    "fingerprint_stats": sql(
        WIRE,
        f"""hits AS (SELECT service, {TEMPLATE.format('message')} AS template, timestamp FROM logs_wire WHERE {ERROR})""",
        """SELECT concat(service, ':', md5(template)) AS fingerprint, service, template, count(*) AS count,
    min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM hits GROUP BY service, template""",
    ),
    "top_errors": sql(
        WIRE,
        f"""hits AS (SELECT service, {TEMPLATE.format('message')} AS template, timestamp FROM logs_wire WHERE {ERROR})""",
        """SELECT concat(service, ':', md5(template)) AS fingerprint, service, template, count(*) AS count,
    min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM hits GROUP BY service, template
  ORDER BY count DESC, fingerprint LIMIT 5""",
    ),
    "ingest_outcome": sql(
        WIRE, SENT_EVENTS,
        """SELECT request_id, count(*) FILTER (WHERE service != '' AND message != '' AND request_id % 40 NOT IN (7, 9)) AS accepted,
    count(*) FILTER (WHERE (service = '' OR message = '') AND request_id % 40 NOT IN (7, 9)) AS failed,
    CASE WHEN request_id % 40 = 7 THEN 'unmarshal: not a request' END AS refused FROM sent GROUP BY 1""",
    ),
    "ingest_by_service": sql(
        WIRE, SENT_EVENTS,
        """SELECT CASE WHEN service = '' OR message = '' THEN 'unknown' ELSE service END AS service,
    CASE WHEN service = '' OR message = '' THEN 'rejected' ELSE 'accepted' END AS status, count(*) AS events
  FROM sent GROUP BY 1, 2""",
    ),
    "latency_stats": sql(
        SAMPLES,
        """SELECT worker, count(*) AS samples, min(latency_ms) AS min_ms, round(avg(latency_ms), 6) AS avg_ms,
    max(latency_ms) AS max_ms,
    list_sort(list(latency_ms))[CAST(floor(count(*) * 0.50::DOUBLE) AS BIGINT) + 1] AS p50_ms,
    list_sort(list(latency_ms))[CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT) + 1] AS p95_ms,
    list_sort(list(latency_ms))[CAST(floor(count(*) * 0.99::DOUBLE) AS BIGINT) + 1] AS p99_ms
  FROM samples GROUP BY 1""",
    ),
    "rate_stats": sql(
        SAMPLES,
        """SELECT worker, count(*) AS sent, CAST(sum(accepted) AS BIGINT) AS accepted,
    CAST(sum(rejected) AS BIGINT) AS rejected, CAST(0 AS BIGINT) AS failed,
    round(count(*) / 2592000.0::DOUBLE, 9) AS actual_rate,
    round(sum(accepted) / 2592000.0::DOUBLE, 9) AS accepted_rate,
    round(sum(accepted) / CAST(count(*) AS DOUBLE) * 100, 9) AS acceptance_pct
  FROM samples GROUP BY 1""",
    ),
    "duplicate_count": sql(
        WIRE, DUP,
        """SELECT count(*) AS rows, count(DISTINCT event_id) AS distinct_ids,
    count(*) - count(DISTINCT event_id) AS duplicates FROM logs_dup""",
    ),
    "poison_rate": sql(
        WIRE,
        f"""SELECT count(*) FILTER (WHERE {FAULT} > 4) AS processed, count(*) FILTER (WHERE {FAULT} < 5) AS dead_lettered,
    round(count(*) FILTER (WHERE {FAULT} < 5) / CAST(count(*) FILTER (WHERE {FAULT} > 4) AS DOUBLE), 9) AS poison_rate
  FROM logs_wire""",
    ),
    "latency_histogram": sql(
        *buckets("worker"),
        "SELECT worker, CASE WHEN i = 10 THEN -1.0::DOUBLE ELSE round(le, 6) END AS le, cumulative FROM cells",
    ),
    "histogram_p95": sql(
        *buckets("worker, day"),
        """steps AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lower, coalesce(lag(cumulative) OVER w, 0) AS below,
    max(cumulative) OVER (PARTITION BY worker, day) * 0.95::DOUBLE AS rank
  FROM cells WINDOW w AS (PARTITION BY worker, day ORDER BY le))""",
        """SELECT worker, day, round(CASE WHEN isinf(min(le)) THEN arg_min(lower, le)
    ELSE arg_min(lower + (le - lower) * (rank - below) / (cumulative - below), le) END, 9) AS quantile
  FROM steps WHERE cumulative >= rank GROUP BY 1, 2""",
    ),
    "histogram_p95_5m": sql(
        SAMPLES, BOUNDS,
        """cells AS (SELECT worker, le, date_trunc('minute', ts) AS minute, count(*) FILTER (WHERE latency_ms / 1000.0::DOUBLE <= le) AS n
  FROM samples, bounds GROUP BY ALL)""",
        """counters AS (SELECT worker, le, minute,
    sum(n) OVER (PARTITION BY worker, le, CAST(minute AS DATE) ORDER BY minute) AS v FROM cells)""",
        """gains AS (SELECT *, CASE WHEN v >= lag(v) OVER w THEN v - lag(v) OVER w ELSE v END AS gain
  FROM counters WINDOW w AS (PARTITION BY worker, le ORDER BY minute))""",
        """ends AS (SELECT worker, le, minute + to_minutes(CAST(i AS BIGINT)) AS window_end, CAST(sum(gain) AS BIGINT) AS cumulative
  FROM gains, range(1, 6) t(i) GROUP BY ALL)""",
        """steps AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lower, coalesce(lag(cumulative) OVER w, 0) AS below,
    max(cumulative) OVER (PARTITION BY worker, window_end) AS total
  FROM ends WINDOW w AS (PARTITION BY worker, window_end ORDER BY le))""",
        """SELECT worker, window_end, round(CASE WHEN isinf(min(le)) THEN arg_min(lower, le)
    ELSE arg_min(lower + (le - lower) * (total * 0.95::DOUBLE - below) / (cumulative - below), le) END, 9) AS quantile
  FROM steps WHERE total > 0 AND cumulative >= total * 0.95::DOUBLE GROUP BY 1, 2""",
    ),
    "event_rate_5m": sql(
        WIRE,
        """ends AS (SELECT service, time_bucket(INTERVAL 1 MINUTE, timestamp) + to_minutes(CAST(i AS BIGINT)) AS window_end
  FROM logs_wire, range(1, 6) t(i))""",
        "SELECT service, window_end, round(count(*) / 300.0::DOUBLE, 9) AS rate FROM ends GROUP BY 1, 2",
    ),
    # ordered windows
    "running_error_rate": sql(
        WIRE, RUNNING, "SELECT *, round(CAST(errors AS DOUBLE) / total, 9) AS error_rate FROM running"
    ),
    "sliding_error_rate": sql(
        WIRE,
        f"""frames AS (SELECT DISTINCT service, timestamp, count(*) OVER w AS total,
    count(*) FILTER (WHERE {ERROR}) OVER w AS errors FROM logs_wire
  WINDOW w AS (PARTITION BY service ORDER BY timestamp RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW))""",
        "SELECT *, round(CAST(errors AS DOUBLE) / total, 9) AS error_rate FROM frames",
    ),
    "quota_shed": sql(
        WIRE,
        f"""requests AS (SELECT CAST(floor({NUMBER} / 20) AS BIGINT) AS request_id, min(timestamp) AS arrived,
    count(*) AS size FROM logs_wire GROUP BY 1)""",
        """sums AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY time_bucket(INTERVAL 6 HOUR, arrived)
    ORDER BY arrived, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used FROM requests)""",
        "SELECT *, used > 60 AS refused FROM sums",
    ),
    "last_n_samples": sql(
        SAMPLES,
        """SELECT worker, event_id, latency_ms FROM samples
  QUALIFY row_number() OVER (PARTITION BY worker ORDER BY ts DESC, event_id DESC) <= 100""",
    ),
    "dedup_events": sql(
        WIRE, DUP, "SELECT DISTINCT event_id, timestamp, service, message FROM logs_dup"
    ),
    # detection
    "error_rate_alerts": sql(
        WIRE, RUNNING, ALERTS,
        """SELECT id, 'error-rate-threshold' AS rule_id, service, fingerprint, 'WARNING' AS severity,
    round(value, 9) AS value, message, triggered_at, 'firing' AS status FROM alerts""",
    ),
    "window_state": sql(
        WIRE,
        f"""SELECT service, time_bucket(INTERVAL 1 DAY, timestamp) AS window_start, count(*) AS total,
    count(*) FILTER (WHERE {ERROR}) AS errors FROM logs_wire GROUP BY 1, 2""",
    ),
    "window_state_anchored": sql(WIRE, *anchored("logs_wire"), ANCHORED_BODY),
    "window_snapshot": sql(
        WIRE,
        f"""SELECT service, time_bucket(INTERVAL 1 DAY, timestamp) AS window_start, count(*) AS total,
    count(*) FILTER (WHERE {ERROR}) AS errors FROM logs_wire GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY service ORDER BY window_start DESC) = 1""",
    ),
    "recurring_errors": sql(WIRE, *recurring("logs_wire"), "SELECT * FROM recurring"),
    "alert_cooldown": sql(
        WIRE, RUNNING, ALERTS,
        "timed AS (SELECT *, date_trunc('milliseconds', triggered_at) AS tick FROM alerts)",
        chain("timed", "fingerprint", "INTERVAL 15 MINUTE", False),
        """SELECT min(id) AS id, t.fingerprint, arg_min(triggered_at, id) AS triggered_at, arg_min(message, id) AS message
  FROM timed t JOIN chain c ON t.fingerprint = c.fingerprint AND t.tick = c.tick GROUP BY t.fingerprint, t.tick""",
    ),
    # streams
    "stream_source": sql(
        WIRE, RAW,
        "SELECT count(*) AS lines, count(DISTINCT value) AS distinct_lines FROM logs_raw",
    ),
    "stream_normalize": sql(
        WIRE, RAW, GOOD,
        f"""SELECT 'hot' AS tier, service, {SEVERITY.format('severity')} AS severity, count(*) AS events FROM good
    GROUP BY 1, 2, 3
  UNION ALL SELECT 'dead', '', {DECODE_ERROR}, count(*) FROM logs_raw WHERE pos % 100 < 5 GROUP BY 1, 2, 3""",
    ),
    "stream_archive": sql(
        WIRE, RAW, ROUTED,
        "SELECT service, count(*) AS lines, count(DISTINCT value) AS distinct_lines FROM routed GROUP BY 1",
    ),
    "stream_error_rate": sql(
        WIRE, GOOD,
        f"""SELECT service, time_bucket(INTERVAL 1 DAY, timestamp) AS window_start, count(*) AS total,
    count(*) FILTER (WHERE {ERROR}) AS errors FROM good GROUP BY 1, 2""",
    ),
    "stream_error_alerts": sql(
        WIRE, GOOD,
        f"""state AS (SELECT service, time_bucket(INTERVAL 1 DAY, timestamp) AS window_start, count(*) AS total,
    count(*) FILTER (WHERE {ERROR}) AS errors FROM good GROUP BY 1, 2)""",
        f"""SELECT concat('alert-', service, '-', CAST(epoch(window_start) AS BIGINT), '-', total) AS id,
    'error-rate-threshold' AS rule_id, service, concat('error_rate_', service) AS fingerprint, 'WARNING' AS severity,
    CAST(errors AS DOUBLE) / total AS value, {RATE_ALERT} AS message, window_start AS triggered_at, 'firing' AS status
  FROM state WHERE total >= 20 AND CAST(errors AS DOUBLE) / total >= 0.05""",
    ),
    "stream_anchored_alerts": sql(
        WIRE, GOOD, *anchored("good"),
        f"""state AS (
  SELECT i.service, i.event_id, i.tick, count(*) OVER w AS total, count(*) FILTER (WHERE {ERROR}) OVER w AS errors
  FROM instants i JOIN chain c ON i.service = c.service AND i.tick >= c.tick AND i.tick <= c.tick + INTERVAL 1 DAY
  WINDOW w AS (PARTITION BY i.service, c.tick ORDER BY i.tick, i.event_id ROWS UNBOUNDED PRECEDING))""",
        f"""SELECT concat('alert-', service, '-', event_id) AS id, 'error-rate-threshold' AS rule_id, service,
    concat('error_rate_', service) AS fingerprint, 'WARNING' AS severity, CAST(errors AS DOUBLE) / total AS value,
    {RATE_ALERT} AS message, tick AS triggered_at, 'firing' AS status
  FROM state WHERE total >= 20 AND CAST(errors AS DOUBLE) / total >= 0.05""",
    ),
    "stream_window_state": sql(WIRE, GOOD, *anchored("good"), ANCHORED_BODY),
    "stream_recurring": sql(WIRE, GOOD, *recurring("good"), "SELECT * FROM recurring"),
    "stream_cooldown": sql(
        WIRE, GOOD,
        f"""timed AS (SELECT concat('alert-', service, '-', event_id) AS id, concat('error_rate_', service) AS fingerprint,
    date_trunc('milliseconds', timestamp) AS tick FROM good WHERE {ERROR})""",
        chain("timed", "fingerprint", "INTERVAL 15 MINUTE", False),
        """SELECT min(id) AS id, t.fingerprint, t.tick AS triggered_at
  FROM timed t JOIN chain c ON t.fingerprint = c.fingerprint AND t.tick = c.tick GROUP BY t.fingerprint, t.tick""",
    ),
    "stream_dedup": sql(WIRE, GOOD, "SELECT event_id, timestamp, service FROM good"),
}
