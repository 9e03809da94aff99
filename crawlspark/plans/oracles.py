"""DuckDB SQL for each registered query, over the same tables."""

from __future__ import annotations

from .. import constants as C
from .views import with_views

ORACLES: dict[str, str] = {}


def oracle(name: str, views: str, body: str) -> None:
    ORACLES[name] = with_views(views.split(), body.strip())


def _escaped(json: str) -> str:
    for char, escape in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        json = f"replace({json}, '{char}', '{escape}')"
    return json


def _hist(views: str, rows: str, seconds: str, bounds: list[float], by: str) -> str:
    """A histogram in long form. Unlike the Spark query it unfolds the bounds first."""
    labels = ", ".join(f"('{b:g}', CAST({b} AS DOUBLE))" for b in bounds) + ", ('+Inf', CAST('inf' AS DOUBLE))"
    return with_views(views.split(), f"""
SELECT {by}, b.le, CAST(count(*) FILTER ({seconds} <= b.v) AS BIGINT) AS bucket_count,
  count(*) AS observations, round(sum({seconds}), 4) AS sum_seconds
FROM ({rows}) r CROSS JOIN (VALUES {labels}) b(le, v)
GROUP BY {by}, b.le""".strip())


# --- sources and sinks -----------------------------------------------------

oracle("scan_fetches", "fetches", """
SELECT fetch_id, job_id, url, status_code, CAST(strlen(body) AS BIGINT) AS size, dur_ms, fetched_at FROM fetches""")

oracle("artifact_manifest", "stored_paths", """
SELECT id, blob_base || '/raw.html' AS path, 'text/html; charset=utf-8' AS object_type, size AS object_bytes FROM stored_paths
UNION ALL SELECT id, blob_base || '/headers.json', 'application/json', CAST(strlen(headers_text) AS BIGINT) FROM stored_paths
UNION ALL SELECT id, blob_base || '/meta.json', 'application/json', CAST(strlen(meta) AS BIGINT) FROM stored_paths""")

oracle("artifact_round_trip", "stored_paths", """
SELECT id, fetch_id, job_id, url, headers_text AS headers, meta, blob_base, strftime(fetched_at, '%Y%m') AS yyyymm,
  strftime(fetched_at, '%d') AS dd, strftime(fetched_at, '%H') AS hh, site AS host, content_hash AS body_hash
FROM stored_paths""")

oracle("blob_uri", "", r"""
SELECT page_id, 'memory://' || path AS memory_uri,
  CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'file:///srv/blobs/b' || rtrim(tail, '/')
    WHEN 2 THEN NULL ELSE 'file:///srv/blobs' || rtrim(tail, '/') END AS local_uri,
  CASE WHEN page_id % 5 <> 2 THEN 'gs://bucket/' || path END AS gcs_uri
FROM (SELECT page_id, regexp_replace(url, '^https?:/', '') AS tail,
    CASE page_id % 5 WHEN 0 THEN '../..' || regexp_replace(url, '^https?:/', '')
      WHEN 1 THEN 'a/../b' || regexp_replace(url, '^https?:/', '') WHEN 2 THEN ''
      ELSE substr(regexp_replace(url, '^https?:/', ''), 2) END AS path FROM pages) p""")

oracle("retrievals", "stored_paths", """
SELECT id, job_id, job_started_at, date_trunc('hour', fetched_at) AS partition_ts, fetched_at AS retrieval_timestamp,
  url AS retrieval_url, content_hash AS retrieval_hashcode, html_blob AS retrieval_blob_location,
  headers_text AS retrieval_headers, status_code AS retrieval_status_code, kind AS retrieval_content_type
FROM stored_paths""")

_MESSAGE = _escaped("""CAST(json_object('crawl_id', id, 'html_blob', html_blob, 'job_id', job_id,
  'meta_blob', meta_blob, 'schema_version', '1', 'site', site, 'url', norm_url) AS VARCHAR)""")
oracle("notifications", "stored_paths", f"SELECT 'crawled-pages' AS topic, {_MESSAGE} AS value FROM stored_paths")

oracle("headers_json", "fetches", """
SELECT fetch_id, CASE WHEN content_type IS NULL THEN '{}'
  ELSE CAST(json_object('Content-Type', json_array(content_type)) AS VARCHAR) END AS headers_json FROM fetches""")
oracle("meta_json", "stored_paths", "SELECT fetch_id, meta FROM stored_paths")
oracle("event_audit", "good_events", """
SELECT job_id, stage, coalesce(site, '') AS site, coalesce(url, '') AS url, bytes, visits,
  coalesce(status_class, '') AS status_class, dur_ms, coalesce(note, '') AS note FROM good_events""")

# --- expressions -----------------------------------------------------------

_NORMAL_URL = r"""CASE WHEN host = '' THEN replace(raw_url, ' ', '%20') ELSE
  lower(regexp_extract(raw_url, '^[A-Za-z]+://', 0)) ||
  CASE WHEN lower(raw_url) LIKE 'https:%' THEN regexp_replace(lower(host), ':443$', '')
    ELSE regexp_replace(lower(host), ':80$', '') END || path ||
  CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_transform(
    list_sort(list_transform(string_split(query, '&'), lambda p: {'k': split_part(p, '=', 1), 'p': p})),
    lambda s: s.p), '&') END END"""
oracle("normalize_url", "url_parts", f"SELECT page_id, {_NORMAL_URL} AS url FROM url_parts")
oracle("extract_host", "url_parts", "SELECT page_id, CASE host WHEN '' THEN 'unknown' ELSE host END AS host FROM url_parts")
oracle("sanitize_host", "url_parts", """
SELECT page_id, CASE host WHEN '' THEN 'unknown' ELSE replace(lower(host), ':', '_') END AS host FROM url_parts""")
oracle("sanitize_site", "url_parts", """
SELECT page_id, CASE WHEN host = '' THEN 'unknown' WHEN raw_url LIKE 'http%' THEN lower(host_name) ELSE lower(regexp_extract(raw_url, '^[A-Za-z]+', 0)) END AS site FROM url_parts""")
oracle("limit_domain", "url_parts", "SELECT page_id, host_name AS domain FROM url_parts")
oracle("blob_base", "fetches", """
SELECT fetch_id, concat('crawl/', strftime(fetched_at, '%Y%m/%d/%H'), '/host=',
  regexp_extract(url, '^https?://([^/?#]*)', 1), '/id=page-', fetch_id) AS blob_base FROM fetches""")
oracle("status_class", "crawl_events", """
SELECT event_id, CASE WHEN status_code BETWEEN 200 AND 299 THEN '2xx' WHEN status_code BETWEEN 300 AND 399 THEN '3xx'
  WHEN status_code BETWEEN 400 AND 499 THEN '4xx' WHEN status_code BETWEEN 500 AND 599 THEN '5xx' ELSE 'other' END AS status_class
FROM crawl_events""")
oracle("content_hash", "fetches", "SELECT fetch_id, sha256(body) AS content_hash FROM fetches")
oracle("content_type", "fetches", """
SELECT fetch_id, coalesce(content_type, 'text/html; charset=utf-8') AS content_type FROM fetches""")
oracle("script_coverage", "judged_fetches", """
SELECT fetch_id, coverage, CASE WHEN body = '' THEN false ELSE coverage * 100 // strlen(body) >= 25 END AS dense FROM judged_fetches""")
oracle("should_promote", "judged_fetches", "SELECT fetch_id, promote FROM judged_fetches")
oracle("stage_of_status", "updates", """
SELECT seq, status, CASE status WHEN 'succeeded' THEN 'JOB_DONE' WHEN 'failed' THEN 'JOB_ERROR' WHEN 'canceled' THEN 'JOB_ERROR' ELSE '' END AS stage,
  CASE status WHEN 'succeeded' THEN 'success' WHEN 'failed' THEN 'error' WHEN 'canceled' THEN 'error' ELSE '' END AS run_status
FROM updates""")
oracle("status_alias", "", """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'running' WHEN 1 THEN 'success' WHEN 2 THEN 'error' WHEN 3 THEN 'error'
  WHEN 4 THEN 'error' WHEN 5 THEN 'invalid' ELSE 'running' END AS status FROM events""")
oracle("valid_job_ids", "", """
SELECT event_id, concat('00000000-0000-7000-8000-', lpad(CAST(user_id AS VARCHAR), 12, '0')) AS job_id
FROM events WHERE event_id % 7 < 4""")
oracle("time_ordered_id", "", """
SELECT event_id, concat(substr(ms, 1, 8), '-', substr(ms, 9, 4), '-7', substr(h, 1, 3), '-',
  CASE WHEN substr(h, 4, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substr(h, 4, 1) IN ('1', '5', '9', 'd') THEN '9'
    WHEN substr(h, 4, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END,
  substr(h, 5, 3), '-', substr(h, 8, 12)) AS id
FROM (SELECT event_id, format('{:012x}', epoch_us(ts) // 1000) AS ms, sha256(CAST(event_id AS VARCHAR)) AS h FROM events) e""")
oracle("response_fallbacks", "fetches", """
SELECT fetch_id, CASE fetch_id % 3 WHEN 0 THEN url WHEN 1 THEN url || '/final' ELSE url || '/asked' END AS url,
  CASE WHEN fetch_id % 3 = 2 THEN 200 ELSE status_code END AS status_code,
  CASE WHEN content_type IS NULL THEN '{}' ELSE CAST(json_object('Content-Type', json_array(content_type)) AS VARCHAR) END AS headers
FROM fetches""")
oracle("collect_headers", "", """
SELECT page_id AS response_id, CAST(json_object('Content-Length', json_array(CAST(strlen(html) AS VARCHAR)),
  'Set-Cookie', json_array('a=' || page_id, 'b=1'), 'X-Request-Id', json_array(sha256(url))) AS VARCHAR) AS headers FROM pages""")

# --- events ----------------------------------------------------------------

oracle("valid_events", "good_events", "SELECT * FROM good_events")
oracle("event_rejects", "judged_events", "SELECT event_id, reason FROM judged_events WHERE reason IS NOT NULL")
oracle("site_deltas", "site_deltas", "SELECT * FROM site_deltas WHERE visits <> 0 OR bytes <> 0")
oracle("site_delta_rejects", "site_deltas", """
SELECT * FROM site_deltas WHERE (visits <> 0 OR bytes <> 0) AND status_class = 'other'""")
oracle("site_stats", "site_stats", "SELECT * FROM site_stats")
oracle("merge_site_stats", "good_events", """
SELECT job_id, site, max(latest) AS last_update, CAST(sum(v) AS BIGINT) AS visits, CAST(sum(b) AS BIGINT) AS bytes_total,
  CAST(coalesce(sum(v) FILTER (status_class = '2xx'), 0) AS BIGINT) AS fetch_2xx,
  CAST(coalesce(sum(v) FILTER (status_class = '3xx'), 0) AS BIGINT) AS fetch_3xx,
  CAST(coalesce(sum(v) FILTER (status_class = '4xx'), 0) AS BIGINT) AS fetch_4xx,
  CAST(coalesce(sum(v) FILTER (status_class = '5xx'), 0) AS BIGINT) AS fetch_5xx
FROM (SELECT job_id, site, status_class, ts >= TIMESTAMP '2024-01-16' AS late, sum(visits) AS v, sum(bytes) AS b, max(ts) AS latest
  FROM good_events WHERE stage = 'FETCH_DONE' AND status_class <> 'other' GROUP BY ALL) d
WHERE v <> 0 OR b <> 0 GROUP BY job_id, site""")
oracle("job_runs", "job_runs", "SELECT * FROM job_runs")
oracle("job_event_counts", "good_events", """
SELECT CASE stage WHEN 'JOB_START' THEN 'started' WHEN 'JOB_DONE' THEN 'success' ELSE 'error' END AS counter, count(*) AS value
FROM good_events WHERE stage IN ('JOB_START', 'JOB_DONE', 'JOB_ERROR') GROUP BY 1""")
ORACLES["job_runtime_hist"] = _hist("good_events", """
SELECT CASE stage WHEN 'JOB_DONE' THEN 'success' ELSE 'error' END AS result, dur_ms / 1000.0 AS s
FROM good_events WHERE stage IN ('JOB_DONE', 'JOB_ERROR') AND dur_ms > 0""", "s", C.JOB_RUNTIME_BOUNDS, "result")
_LABELLED = """SELECT coalesce(nullif(site, ''), 'unknown') AS site, coalesce(nullif(status_class, ''), 'other') AS status_class"""
oracle("fetch_requests", "dirty_events", f"""
SELECT site, status_class, count(*) AS requests FROM ({_LABELLED} FROM dirty_events WHERE stage = 'FETCH_DONE') e GROUP BY ALL""")
oracle("fetch_bytes", "good_events", """
SELECT site, CAST(sum(bytes) AS BIGINT) AS bytes FROM good_events WHERE stage = 'FETCH_DONE' AND bytes > 0 GROUP BY site""")
ORACLES["fetch_duration_hist"] = _hist("good_events", """
SELECT site, status_class, dur_ms / 1000.0 AS s FROM good_events WHERE stage = 'FETCH_DONE' AND dur_ms > 0""",
    "s", C.FETCH_DURATION_BOUNDS, "site, status_class")
oracle("running_jobs", "good_events", """
SELECT job_id, ts, event_id, step, CAST(sum(step) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running
FROM (SELECT job_id, ts, event_id, CAST(CASE WHEN stage = 'JOB_START' AND coalesce(before, '') <> 'JOB_START' THEN 1
    WHEN stage <> 'JOB_START' AND before = 'JOB_START' THEN -1 ELSE 0 END AS BIGINT) AS step
  FROM (SELECT *, lag(stage) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS before
    FROM good_events WHERE stage IN ('JOB_START', 'JOB_DONE', 'JOB_ERROR')) l) s
WHERE step <> 0""")
oracle("activity_bursts", "good_events", """
SELECT job_id, CAST((n - 1) // 4 AS BIGINT) AS part, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(event_id, (ts, event_id)) AS first_event, count(*) AS events
FROM (SELECT *, row_number() OVER (PARTITION BY job_id, stretch ORDER BY ts, event_id) AS n
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS stretch
    FROM (SELECT job_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
      FROM good_events) a) b) c
GROUP BY job_id, stretch, (n - 1) // 4""")

# --- reads on runs and statistics ------------------------------------------

oracle("get_job", "job_runs submissions", """
SELECT coalesce(r.id, s.job_id) AS id, r.job_id, r.started_at, r.finished_at, r.status, r.error_message, r.id IS NOT NULL AS found
FROM submissions s LEFT JOIN job_runs r ON r.id = s.job_id""")
oracle("list_jobs", "job_runs", """
SELECT * FROM job_runs WHERE status = 'error' ORDER BY started_at DESC, id LIMIT 40 OFFSET 10""")
oracle("list_job_sites", "site_stats", """
SELECT * FROM site_stats QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY last_update DESC, site) <= 100""")
oracle("top_sites_per_job", "site_stats", """
SELECT *, CAST(row_number() OVER (PARTITION BY job_id ORDER BY last_update DESC, site) AS INT) AS rank
FROM site_stats QUALIFY rank BETWEEN 2 AND 4""")
_TIME = r"regexp_replace(strftime({0}, '%Y-%m-%dT%H:%M:%S.%f'), '\.?0+$', '') || 'Z'"
oracle("job_dto", "job_runs", f"""
SELECT id, started_at, '{{"id":"' || id || '","job_id":"' || job_id || '","started_at":"' || {_TIME.format('started_at')} || '"' ||
  coalesce(',"finished_at":"' || {_TIME.format('finished_at')} || '"', '') || ',"status":"' || status || '"' ||
  coalesce(',"error":"' || error_message || '"', '') || '}}' AS job
FROM job_runs""")
oracle("site_dto", "site_stats", f"""
SELECT job_id, CAST(json_object('site', site, 'last_update', {_TIME.format('last_update')}, 'visits', visits, 'bytes_total', bytes_total,
  'fetch_2xx', fetch_2xx, 'fetch_3xx', fetch_3xx, 'fetch_4xx', fetch_4xx, 'fetch_5xx', fetch_5xx) AS VARCHAR) AS site_stats
FROM site_stats""")
oracle("list_pages", "fetches", """
SELECT job_id, fetch_id, url, status_code, fetched_at, row_number() OVER (PARTITION BY job_id ORDER BY fetched_at, fetch_id) AS seq FROM fetches""")

# --- pages -----------------------------------------------------------------

oracle("final_responses", "finals", """
SELECT fetch_id, job_id, requested_url, url, status_code, dur_ms, used_headless, sha256(body) AS content_hash FROM finals""")
oracle("ensure_job_runs", "job_runs fetches", """
SELECT * FROM job_runs
UNION ALL SELECT job_id, job_id, job_started_at,
  CASE WHEN CAST(right(job_id, 12) AS BIGINT) % 2 = 0 THEN min(fetched_at) END,
  CASE WHEN CAST(right(job_id, 12) AS BIGINT) % 2 = 0 THEN 'success' ELSE 'running' END, NULL
FROM fetches GROUP BY job_id, job_started_at""")
oracle("job_result", "updates fetches", """
SELECT s.job_id, status, error_text, fetch_id, url, status_code
FROM (SELECT job_id, arg_max(status, seq) AS status, arg_max(error_text, seq) AS error_text FROM updates WHERE status <> 'canceled' GROUP BY job_id) s
LEFT JOIN fetches f ON f.job_id = s.job_id""")
_TASKS = rf"""(SELECT {_NORMAL_URL} AS url, p.page_id, s.job_id, s.submitted_at, s.headless_allowed AS job_renders, p.raw_url,
    row_number() OVER (PARTITION BY p.job_no ORDER BY p.page_id) - 1 AS pos,
    CASE WHEN p.host_name = '' THEN true ELSE length(p.host_name) % 3 <> 0 OR p.path = '/p' OR p.path LIKE '/p/%' END AS fetch_allowed,
    p.host_name = '' OR length(p.host_name) % 2 = 0 AS policy_renders
  FROM url_parts p JOIN submissions s ON s.job_no = p.job_no) t"""
oracle("crawl_outcomes", "url_parts submissions", f"""
SELECT job_id, pos, url, CASE WHEN NOT fetch_allowed THEN 'blocked' WHEN page_id % 13 = 5 THEN 'failed' ELSE 'success' END AS outcome
FROM {_TASKS}""")
oracle("crawl_results", "judged_fetches url_parts submissions", rf"""
SELECT concat(substr(ms, 1, 8), '-', substr(ms, 9, 4), '-7', substr(h, 1, 3), '-',
    translate(substr(h, 4, 1), '0123456789abcdef', '89ab89ab89ab89ab'), substr(h, 5, 3), '-', substr(h, 8, 12)) AS id,
  job_id, submitted_at AS job_started_at, date_trunc('hour', fetched_at) AS partition_ts, fetched_at AS retrieval_timestamp,
  url AS retrieval_url, sha256(body) AS retrieval_hashcode,
  concat('memory://crawl/', strftime(fetched_at, '%Y%m/%d/%H'), '/host=', regexp_extract(url, '^https?://([^/?#]*)', 1), '/id=',
    substr(ms, 1, 8), '-', substr(ms, 9, 4), '-7', substr(h, 1, 3), '-',
    translate(substr(h, 4, 1), '0123456789abcdef', '89ab89ab89ab89ab'), substr(h, 5, 3), '-', substr(h, 8, 12), '/raw.html') AS retrieval_blob_location,
  CASE WHEN content_type IS NULL THEN '{{}}' ELSE CAST(json_object('Content-Type', json_array(content_type)) AS VARCHAR) END AS retrieval_headers,
  status_code AS retrieval_status_code, coalesce(content_type, 'text/html; charset=utf-8') AS retrieval_content_type
FROM (SELECT t.job_id, t.submitted_at, f.fetched_at, f.content_type, f.status_code,
    format('{{:012x}}', epoch_us(f.fetched_at) // 1000) AS ms, sha256(concat(t.job_id, ':', f.fetch_id)) AS h,
    CASE WHEN f.promote AND f.fetch_id % 4 <> 0 AND coalesce(t.job_renders, false) AND t.policy_renders THEN f.url || '/headless' ELSE f.url END AS url,
    CASE WHEN f.promote AND f.fetch_id % 4 <> 0 AND coalesce(t.job_renders, false) AND t.policy_renders THEN '<html>rendered</html>' ELSE f.body END AS body
  FROM {_TASKS} JOIN judged_fetches f ON f.fetch_id = t.page_id WHERE t.fetch_allowed AND t.page_id % 13 <> 5) r""")
oracle("scan_fetch_rows", "fetches", r"""
SELECT fetch_id, url, CAST(strlen(body) + CASE WHEN fetch_id % 9 = 2 THEN 2 ELSE 0 END AS BIGINT) AS size,
  sha256(CASE WHEN fetch_id % 9 = 2 THEN '\xFF\xFE'::BLOB || encode(body) ELSE encode(body) END) AS content_hash,
  CASE WHEN fetch_id % 5 = 0 THEN CAST(strlen(url) + 3 AS BIGINT) END AS screenshot_size,
  CASE WHEN fetch_id % 8 = 3 THEN 'indeterminate' ELSE '' END AS robots_status,
  CASE WHEN fetch_id % 8 = 3 THEN 'TLS handshake timeout' END AS robots_reason,
  sha256(CASE WHEN fetch_id % 9 = 2 THEN chr(65533) || chr(65533) || body ELSE body END) AS text_hash
FROM fetches""")
oracle("robots_warnings", "fetches", """
SELECT fetch_id, job_id, url, 'TLS handshake timeout' AS reason FROM fetches WHERE fetch_id % 8 = 3""")
oracle("hash_dedup", "fetches", """
SELECT sha256(body) AS content_hash, arg_min(fetch_id, (fetched_at, fetch_id)) AS fetch_id, count(*) AS copies FROM fetches GROUP BY body""")

# --- jobs ------------------------------------------------------------------

oracle("resolve_params", "submissions", """
SELECT job_id, CAST(coalesce(nullif(max_depth, 0), 1) AS BIGINT) AS max_depth, CAST(coalesce(nullif(max_pages, 0), 10) AS BIGINT) AS max_pages,
  CAST(coalesce(nullif(budget_seconds, 0), 15) AS BIGINT) AS budget_seconds,
  coalesce(headless_allowed, false) AS headless_allowed, coalesce(respect_robots, true) AS respect_robots, len(urls) AS url_count
FROM submissions WHERE len(urls) > 0""")
oracle("param_rejects", "submissions", "SELECT job_id, 'urls required' AS reason FROM submissions WHERE coalesce(len(urls), 0) = 0")
oracle("explode_tasks", "submissions", """
SELECT job_id, submitted_at, 1::BIGINT AS attempt, unnest(range(len(urls))) AS pos, unnest(urls) AS url FROM submissions WHERE len(urls) > 0""")
oracle("template_jobs", "submissions", """
SELECT job_id, template, 1::BIGINT AS max_depth, 60::BIGINT AS max_pages, 120::BIGINT AS budget_seconds, false AS headless_allowed,
  false AS respect_robots, 2::BIGINT AS url_count FROM submissions WHERE template = 'price-refresh'""")
oracle("template_rejects", "submissions", """
SELECT job_id, template, 'standard job template not found' AS reason FROM submissions WHERE template = 'missing-template'""")
oracle("new_jobs", "crawl_events fetches", """
SELECT job_id, min(event_id) AS seq FROM crawl_events WHERE stage = 'JOB_START' AND job_id NOT IN (SELECT job_id FROM fetches) GROUP BY job_id""")
oracle("duplicate_jobs", "crawl_events fetches", """
SELECT job_id, event_id AS seq, 'job already exists' AS reason FROM crawl_events WHERE stage = 'JOB_START'
QUALIFY job_id IN (SELECT job_id FROM fetches) OR row_number() OVER (PARTITION BY job_id ORDER BY event_id) > 1""")
oracle("job_state", "job_state", "SELECT * FROM job_state")
oracle("fold_attempts", "attempts", """
SELECT job_id, pos, url, CASE WHEN bool_or(result = 'ok') THEN 'success' WHEN bool_or(result = 'ctx') THEN 'canceled' ELSE 'exhausted' END AS outcome,
  count(*) AS attempts, count(*) - 1 AS retries FROM attempts GROUP BY job_id, pos, url""")
oracle("retry_waits", "attempts", """
SELECT job_id, pos, attempt, CAST(attempt * 1000 AS BIGINT) AS wait_ms,
  CAST(sum(attempt * 1000) OVER (PARTITION BY job_id, pos ORDER BY attempt) AS BIGINT) AS total_wait_ms FROM attempts""")
oracle("job_counters", "outcomes", """
SELECT job_id, count(*) FILTER (outcome = 'success') AS pages_succeeded,
  count(*) FILTER (outcome IN ('exhausted', 'canceled', 'persist_failed')) AS pages_failed FROM outcomes GROUP BY job_id""")
oracle("final_status", "finished", "SELECT * FROM finished")

# --- frontier and policy ---------------------------------------------------

oracle("dedup_frontier", "tasks", r"""
SELECT job_id, regexp_replace(url, '#.*$', '') AS norm_url, min(pos) AS pos, arg_min(url, pos) AS url, count(*) AS copies
FROM tasks GROUP BY job_id, regexp_replace(url, '#.*$', '')""")
oracle("domain_filter", "tasks", """
SELECT job_id, pos, host FROM tasks
WHERE (host = 'example.com' OR host LIKE '%.example.com' OR host = 'example.org' OR host LIKE '%.example.org')
  AND NOT (host = 'therou.example.com' OR host LIKE '%.therou.example.com' OR host = 'spam-farm.example.org' OR host LIKE '%.spam-farm.example.org')""")
oracle("policy_gate", "tasks", """
SELECT job_id, pos, host, host LIKE 'm.%' OR length(host) % 3 <> 0 AS fetch_allowed,
  host LIKE 'm.%' OR length(host) % 2 = 0 AS headless_allowed FROM tasks""")
_PATH = "regexp_extract({}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_PARTS = "list_filter(string_split({}, '{}'), lambda x: x <> '')"
oracle("policy_rules", "tasks", f"""
SELECT t.job_id, t.pos, t.url, t.host, t.depth, coalesce(best[6] = 0, true) AS fetch_allowed, coalesce(best[7] = 0, true) AS headless_allowed
FROM tasks t LEFT JOIN (
  SELECT a.job_id, a.pos, max([r.priority, r.n_labels, r.n_segments, CAST(r.job IS NOT NULL AS INT), CAST(r.low IS NOT NULL AS INT),
    CAST(r.no_fetch AS INT), CAST(r.no_headless AS INT)]) AS best
  FROM (
    SELECT job_id, pos, depth, array_to_string(labels[len(labels) - k + 1:], '.') AS host, array_to_string(segments[:j], '/') AS path
    FROM (SELECT job_id, pos, depth, {_PARTS.format("lower(host)", ".")} AS labels, {_PARTS.format(_PATH.format("url"), "/")} AS segments FROM tasks) p,
      unnest(range(len(labels) + 1)) AS u(k), unnest(range(len(segments) + 1)) AS v(j)
  ) a JOIN (
    SELECT CASE WHEN i % 3 = 1 THEN concat('00000000-0000-7000-8000-', lpad(CAST(page_id * 7 % 100 AS VARCHAR), 12, '0')) END AS job,
      array_to_string(labels, '.') AS host, array_to_string(segments, '/') AS path, len(labels) AS n_labels, len(segments) AS n_segments,
      CASE WHEN (page_id + i) % 5 = 0 THEN 1 END AS low, CASE WHEN (page_id + i) % 41 = 0 THEN 1 ELSE 0 END AS priority,
      (page_id + i) % 3 = 0 AS no_fetch, (page_id * 3 + i) % 4 = 0 AS no_headless
    FROM (SELECT page_id, i, {_PARTS.format("lower(CASE WHEN i % 4 = 3 THEN regexp_replace(site, '^[^.]*[.]', '') ELSE site END)", ".")} AS labels,
        {_PARTS.format("CASE WHEN i < 2 THEN '' WHEN i < 4 THEN path ELSE path || '/r' || i END", "/")} AS segments
      FROM (SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1) AS site, {_PATH.format("url")} AS path FROM pages) p,
        range(400) AS w(i)) q
  ) r ON r.host = a.host AND r.path = a.path AND (r.job IS NULL OR r.job = a.job_id) AND (r.low IS NULL OR a.depth >= r.low)
  GROUP BY a.job_id, a.pos
) d ON d.job_id = t.job_id AND d.pos = t.pos""")
oracle("cap_frontier", "tasks", """
SELECT job_id, host, pos, host_rank, job_rank
FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY pos) AS job_rank
  FROM (SELECT *, row_number() OVER (PARTITION BY job_id, host ORDER BY pos) AS host_rank FROM tasks WHERE depth <= max_depth) h
  WHERE domain_cap IS NULL OR host_rank <= domain_cap) j
WHERE job_rank <= max_pages""")
oracle("job_budget", "tasks", """
SELECT job_id, pos, CAST(before AS BIGINT) AS elapsed_ms,
  CASE WHEN before < CASE WHEN coalesce(budget_seconds, 0) > 0 THEN budget_seconds ELSE 15 END * 1000 THEN 'fetched' ELSE 'skipped' END AS decision
FROM (SELECT *, coalesce(sum(dur_ms) OVER (PARTITION BY job_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tasks) t""")
oracle("rate_limit_schedule", "schedule", "SELECT * FROM schedule")
ORACLES["rate_delay_hist"] = _hist(
    "schedule", "SELECT domain, CAST(delay_us AS DOUBLE) / 1e6 AS s FROM schedule WHERE delay_us > 1000", "s", C.RATE_DELAY_BOUNDS, "domain")

# --- counters and rates ----------------------------------------------------

_SITE = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
oracle("pages_total", "attempts outcomes", f"""
SELECT site, status, count(*) AS pages FROM (
  SELECT {_SITE} AS site, 'error' AS status FROM attempts WHERE result <> 'ok'
  UNION ALL SELECT {_SITE}, CASE outcome WHEN 'success' THEN 'success' ELSE 'error' END FROM outcomes WHERE outcome IN ('success', 'persist_failed')) p
GROUP BY ALL""")
oracle("bytes_total", "outcomes", f"""
SELECT {_SITE} AS site, CAST(sum(bytes) AS BIGINT) AS bytes FROM outcomes WHERE outcome IN ('success', 'persist_failed') AND bytes > 0 GROUP BY 1""")
oracle("jobs_total", "finished", "SELECT status, count(*) AS jobs FROM finished GROUP BY status")
oracle("http_requests", "requests", "SELECT method, CAST(code AS VARCHAR) AS code, count(*) AS requests FROM requests GROUP BY ALL")
ORACLES["http_latency_hist"] = _hist(
    "requests", "SELECT method, coalesce(route, 'unknown') AS route, dur_s AS s FROM requests", "s", C.HTTP_LATENCY_BOUNDS, "method, route")
oracle("robots_outcome", "robots", "SELECT * FROM robots")
oracle("tls_timeouts", "robots", "SELECT count(*) FILTER (outcome = 'indeterminate') AS timeouts FROM robots")
oracle("pages_rate", "observations", """
SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, site, round(count(*) / 300, 9) AS pages_per_second
FROM observations WHERE status = 'success' GROUP BY ALL""")
oracle("pages_rate_sliding", "observations", """
SELECT time_bucket(INTERVAL '1 minute', ts) - to_minutes(CAST(m AS INT)) AS window_start, site, round(count(*) / 300, 9) AS pages_per_second
FROM observations CROSS JOIN range(5) b(m) WHERE status = 'success' GROUP BY ALL""")
oracle("error_ratio", "observations", """
SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, round(count(*) FILTER (status = 'error') / count(*), 9) AS error_ratio
FROM observations GROUP BY 1""")
_LES = ", ".join(f"CAST({b} AS DOUBLE)" for b in C.HTTP_LATENCY_BOUNDS)
oracle("latency_p95", "requests", f"""
SELECT window_start, observations, round(coalesce(arg_min(low + (le - low) * (rank - below) / (reached - below), le) FILTER (reached >= rank), 5.0), 6) AS p95_seconds
FROM (SELECT *, observations * 0.95::DOUBLE AS rank, lag(le, 1, 0.0) OVER w AS low, lag(reached, 1, 0) OVER w AS below
  FROM (SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, le, count(*) AS observations, count(*) FILTER (dur_s <= le) AS reached
    FROM requests CROSS JOIN unnest([{_LES}]) b(le) GROUP BY ALL) c
  WINDOW w AS (PARTITION BY window_start ORDER BY le)) q
GROUP BY window_start, observations""")
oracle("bytes_rate", "observations", """
SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, site, round(sum(bytes) / 300, 6) AS bytes_per_second
FROM observations WHERE bytes > 0 GROUP BY ALL""")

# --- streams: the same results as in batch ---------------------------------

# --- stored tables -----------------------------------------------------------

_URL = "regexp_replace({}.url, '#.*$', '')"
oracle("new_frontier", "tasks", f"""
SELECT job_id, {_URL.format('n')} AS norm_url, min(pos) AS pos, arg_min(url, pos) AS url, count(*) AS copies FROM tasks n
WHERE pos % 2 = 1 AND NOT EXISTS (
  SELECT 1 FROM tasks o WHERE o.pos % 2 = 0 AND o.job_id = n.job_id AND {_URL.format('o')} = {_URL.format('n')})
GROUP BY ALL""")
oracle("new_bodies", "fetches", """
SELECT sha256(body) AS content_hash, arg_min(fetch_id, (fetched_at, fetch_id)) AS fetch_id, count(*) AS copies FROM fetches
WHERE fetch_id % 3 <> 0 AND body NOT IN (SELECT body FROM fetches WHERE fetch_id % 3 = 0) GROUP BY body""")
oracle("repeated_jobs", "crawl_events", """
SELECT job_id, event_id AS seq FROM crawl_events WHERE stage = 'JOB_START' AND event_id % 2 = 1
  AND job_id IN (SELECT job_id FROM crawl_events WHERE stage = 'JOB_START' AND event_id % 2 = 0)""")
ORACLES["stored_job_runs"] = ORACLES["job_runs"]
oracle("stored_site_stats", "good_events", """
SELECT job_id, site, max(latest) AS last_update, CAST(sum(v) AS BIGINT) AS visits, CAST(sum(b) AS BIGINT) AS bytes_total,
  CAST(coalesce(sum(v) FILTER (status_class = '2xx'), 0) AS BIGINT) AS fetch_2xx,
  CAST(coalesce(sum(v) FILTER (status_class = '3xx'), 0) AS BIGINT) AS fetch_3xx,
  CAST(coalesce(sum(v) FILTER (status_class = '4xx'), 0) AS BIGINT) AS fetch_4xx,
  CAST(coalesce(sum(v) FILTER (status_class = '5xx'), 0) AS BIGINT) AS fetch_5xx
FROM (SELECT job_id, site, status_class, event_id % 3 AS part, sum(visits) AS v, sum(bytes) AS b, max(ts) AS latest
  FROM good_events WHERE stage = 'FETCH_DONE' AND status_class <> 'other' GROUP BY ALL) d
WHERE v <> 0 OR b <> 0 GROUP BY job_id, site""")
oracle("get_stored_job", "job_runs", "SELECT * FROM job_runs WHERE id = '00000000-0000-7000-8000-000000000007'")
ORACLES["newest_jobs"] = ORACLES["list_jobs"]
oracle("stored_job_sites", "site_stats", """
SELECT * FROM site_stats WHERE job_id = '00000000-0000-7000-8000-000000000007'
ORDER BY last_update DESC, site LIMIT 200 OFFSET 1""")

# --- streams -------------------------------------------------------------------

for _stream, _batch in (("stream_site_stats", "site_stats"), ("stream_job_runs", "job_runs"),
                        ("stream_running_jobs", "running_jobs")):
    ORACLES[_stream] = ORACLES[_batch]
ORACLES["stream_pages_rate"] = ORACLES["stream_closing_rates"] = ORACLES["pages_rate"]

_ID = """concat(substr(ms, 1, 8), '-', substr(ms, 9, 4), '-7', substr(h, 1, 3), '-',
  translate(substr(h, 4, 1), '0123456789abcdef', '89ab89ab89ab89ab'), substr(h, 5, 3), '-', substr(h, 8, 12))"""
_STREAMED = f"""(SELECT *, {_ID} AS id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS site,
    concat('memory://crawl/', strftime(fetched_at, '%Y%m/%d/%H'), '/host=', regexp_extract(url, '^https?://([^/?#]*)', 1), '/id=', {_ID}) AS folder
  FROM (SELECT *, format('{{:012x}}', epoch_us(fetched_at) // 1000) AS ms, sha256(concat(job_id, ':', fetch_id)) AS h FROM fetches) f) s"""
oracle("stream_retrievals", "fetches", f"""
SELECT id, job_id, url AS retrieval_url, sha256(body) AS retrieval_hashcode, folder || '/raw.html' AS retrieval_blob_location,
  CASE WHEN content_type IS NULL THEN '{{}}' ELSE CAST(json_object('Content-Type', json_array(content_type)) AS VARCHAR) END AS retrieval_headers,
  status_code AS retrieval_status_code, date_trunc('hour', fetched_at) AS partition_ts, job_started_at,
  fetched_at AS retrieval_timestamp, coalesce(content_type, 'text/html; charset=utf-8') AS retrieval_content_type,
  CAST(NULL AS VARCHAR) AS parent_id, CAST(NULL AS TIMESTAMP) AS parent_ts
FROM {_STREAMED}""")
_STREAM_MESSAGE = _escaped(r"""CAST(json_object('crawl_id', id, 'html_blob', folder || '/raw.html', 'job_id', job_id,
  'meta_blob', folder || '/meta.json', 'schema_version', '1', 'site', site, 'url', regexp_replace(url, '#.*$', '')) AS VARCHAR)""")
oracle("stream_notifications", "fetches", f"SELECT {_STREAM_MESSAGE} AS value FROM {_STREAMED}")
oracle("stream_outbox", "fetches", f"""
SELECT id, {_STREAM_MESSAGE} AS value, url AS retrieval_url, sha256(body) AS retrieval_hashcode FROM {_STREAMED}""")
