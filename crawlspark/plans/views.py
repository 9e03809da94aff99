"""The derived tables as DuckDB views, for checking query results."""

from ..sources.derived import SECOND_FETCH

JOB = "concat('00000000-0000-7000-8000-', lpad(CAST({} AS VARCHAR), 12, '0'))"

# name -> (views it reads, SQL)
VIEWS: dict[str, tuple[list[str], str]] = {
    "crawl_events": ([], f"""
SELECT e.event_id, e.k, e.job_id, e.ts, e.stage, p.url,
  coalesce(nullif(regexp_extract(p.url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1), ''), 'unknown') AS site,
  CASE WHEN e.stage <> 'FETCH_DONE' OR e.k = 55 THEN 0::BIGINT ELSE CAST(strlen(p.html) AS BIGINT) END AS bytes,
  CASE WHEN e.stage <> 'FETCH_DONE' OR e.k = 55 THEN 0::BIGINT ELSE 1::BIGINT END AS visits,
  CASE e.k % 10 WHEN 0 THEN 301 WHEN 1 THEN 404 WHEN 2 THEN 503 WHEN 3 THEN 429 WHEN 4 THEN 999 WHEN 5 THEN 204 ELSE 200 END AS status_code,
  CASE WHEN e.stage = 'FETCH_DONE' THEN CASE e.k % 10 WHEN 0 THEN '3xx' WHEN 1 THEN '4xx' WHEN 2 THEN '5xx' WHEN 3 THEN '4xx' WHEN 4 THEN 'other' ELSE '2xx' END END AS status_class,
  CASE WHEN e.stage = 'FETCH_DONE' THEN CAST(floor(e.value * 20) AS BIGINT)
       WHEN e.stage IN ('JOB_DONE', 'JOB_ERROR') THEN CAST(floor(e.value * 2000) AS BIGINT)
       ELSE 0::BIGINT END AS dur_ms,
  CASE WHEN e.stage = 'JOB_ERROR' AND e.k % 2 = 0 THEN concat('err-', CAST(e.k AS VARCHAR)) END AS note
FROM (
  SELECT event_id, ts, value, k, event_id % (SELECT count(*) FROM pages) AS pid,
    {JOB.format('user_id')} AS job_id,
    CASE event_type WHEN 'signup' THEN 'JOB_START'
      WHEN 'purchase' THEN CASE WHEN k % 10 = 9 THEN 'JOB_CANCELED' ELSE 'JOB_DONE' END
      WHEN 'error' THEN CASE WHEN k < 60 THEN 'JOB_ERROR' WHEN k < 80 THEN 'JOB_HEARTBEAT' ELSE 'FETCH_START' END
      ELSE 'FETCH_DONE' END AS stage
  FROM (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) r
) e JOIN pages p ON p.page_id = e.pid"""),

    "dirty_events": (["crawl_events"], """
SELECT event_id,
  CASE WHEN k % 25 = 4 THEN '00000000-0000-0000-0000-000000000000' WHEN k % 25 = 5 THEN NULL ELSE job_id END AS job_id,
  CASE WHEN k % 25 = 3 THEN NULL ELSE ts END AS ts, stage,
  CASE WHEN k % 25 = 0 THEN NULL WHEN k % 25 = 6 THEN '' ELSE site END AS site,
  url, bytes, visits,
  CASE WHEN k % 25 = 1 THEN NULL ELSE status_class END AS status_class,
  CASE WHEN k % 25 = 2 THEN CAST(-1 AS BIGINT) ELSE dur_ms END AS dur_ms, note
FROM crawl_events"""),

    "judged_events": (["dirty_events"], """
SELECT *, CASE
  WHEN job_id IS NULL OR job_id = '' OR job_id = '00000000-0000-0000-0000-000000000000' THEN 'job id is required'
  WHEN ts IS NULL THEN 'timestamp is required'
  WHEN stage = 'FETCH_START' AND coalesce(site, '') = '' THEN 'fetch start requires site'
  WHEN stage = 'FETCH_DONE' AND coalesce(site, '') = '' THEN 'fetch done requires site'
  WHEN stage = 'FETCH_DONE' AND coalesce(status_class, '') = '' THEN 'fetch done requires status class'
  WHEN stage NOT IN ('JOB_START', 'JOB_HEARTBEAT', 'JOB_DONE', 'JOB_ERROR', 'FETCH_START', 'FETCH_DONE') THEN 'unknown stage "' || stage || '"'
  WHEN dur_ms < 0 THEN 'duration must be >= 0' END AS reason
FROM dirty_events"""),

    "good_events": (["judged_events"], "SELECT * EXCLUDE (reason) FROM judged_events WHERE reason IS NULL"),

    "site_deltas": (["good_events"], """
SELECT job_id, site, status_class, CAST(sum(visits) AS BIGINT) AS visits,
  CAST(sum(bytes) AS BIGINT) AS bytes, max(ts) AS latest
FROM good_events WHERE stage = 'FETCH_DONE' GROUP BY ALL"""),

    "site_stats": (["site_deltas"], """
SELECT job_id, site, max(latest) AS last_update, CAST(sum(visits) AS BIGINT) AS visits,
  CAST(sum(bytes) AS BIGINT) AS bytes_total,
  CAST(coalesce(sum(visits) FILTER (status_class = '2xx'), 0) AS BIGINT) AS fetch_2xx,
  CAST(coalesce(sum(visits) FILTER (status_class = '3xx'), 0) AS BIGINT) AS fetch_3xx,
  CAST(coalesce(sum(visits) FILTER (status_class = '4xx'), 0) AS BIGINT) AS fetch_4xx,
  CAST(coalesce(sum(visits) FILTER (status_class = '5xx'), 0) AS BIGINT) AS fetch_5xx
FROM site_deltas WHERE (visits <> 0 OR bytes <> 0) AND status_class IN ('2xx', '3xx', '4xx', '5xx')
GROUP BY job_id, site"""),

    "job_runs": (["good_events"], """
SELECT s.job_id AS id, s.job_id, s.ts AS started_at,
  CASE WHEN t.ts > s.ts OR (t.ts = s.ts AND t.event_id > s.event_id) THEN t.ts END AS finished_at,
  CASE WHEN t.ts > s.ts OR (t.ts = s.ts AND t.event_id > s.event_id)
       THEN CASE t.stage WHEN 'JOB_DONE' THEN 'success' ELSE 'error' END ELSE 'running' END AS status,
  CASE WHEN (t.ts > s.ts OR (t.ts = s.ts AND t.event_id > s.event_id)) AND t.stage = 'JOB_ERROR' THEN nullif(t.note, '') END AS error_message
FROM (SELECT * FROM good_events WHERE stage = 'JOB_START') s
LEFT JOIN (SELECT * FROM good_events WHERE stage IN ('JOB_DONE', 'JOB_ERROR')
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1) t
ON s.job_id = t.job_id"""),

    "url_variants": ([], """
SELECT page_id, page_id // 10 AS job_no, CASE page_id % 7
  WHEN 0 THEN url
  WHEN 1 THEN replace(url, 'http', 'HTTP')
  WHEN 2 THEN replace(url, '.example.', '.EXAMPLE.')
  WHEN 3 THEN concat(regexp_extract(url, '^(https?://[^/?#]*)', 1), CASE WHEN url LIKE 'https:%' THEN ':443' ELSE ':80' END, '/p')
  WHEN 4 THEN concat(regexp_extract(url, '^([^?#]*)', 1), '?z=9&a=1&m=5#frag')
  WHEN 5 THEN concat(regexp_extract(url, '^(https?://[^/?#]*)', 1), ':8080/x')
  ELSE 'not a url' END AS raw_url
FROM pages"""),

    "url_parts": (["url_variants"], r"""
SELECT *, regexp_extract(raw_url, '^[A-Za-z]+://([^/?#]*)', 1) AS host,
  regexp_replace(regexp_extract(raw_url, '^[A-Za-z]+://([^/?#]*)', 1), ':[0-9]*$', '') AS host_name,
  regexp_extract(raw_url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(raw_url, '\?([^#]*)', 1) AS query
FROM url_variants"""),

    "fetches": ([], f"""
SELECT page_id + variant * {SECOND_FETCH} AS fetch_id, {JOB.format('page_id % 20')} AS job_id,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(page_id % 20 AS INT)) AS job_started_at, url,
  CASE page_id % 10 WHEN 8 THEN 404 WHEN 9 THEN 503 ELSE 200 END AS status_code, body,
  CASE page_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/plain; charset=ascii' END AS content_type,
  (page_id * 37) % 5000 AS dur_ms,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id * 17 % 2592000) AS fetched_at
FROM (SELECT page_id, url, CAST(0 AS BIGINT) AS variant, CASE page_id % 6
    WHEN 3 THEN concat(html, '<div id="root"></div>') WHEN 4 THEN concat('<SCRIPT>', html) ELSE html END AS body
  FROM pages
  UNION ALL
  SELECT page_id, url, 1, CASE page_id % 6 WHEN 1 THEN ''
    WHEN 2 THEN '<html><script>var a=1;</script><p>t</p></html>'
    ELSE concat('<html><body><p>', url, '</p></body></html>') END
  FROM pages WHERE page_id % 6 IN (1, 2, 5)) p"""),

    "judged_fetches": (["fetches"], r"""
SELECT *, CAST(strlen(body) - strlen(regexp_replace(body, '(?is)<script[^>]*(?:>.*?(?:</script>|\z)|\z)', '', 'g')) AS BIGINT) AS coverage,
  CASE WHEN status_code <> 200 THEN false WHEN body = '' THEN true
    WHEN strlen(body) < 2048 AND (strlen(body) - strlen(regexp_replace(body, '(?is)<script[^>]*(?:>.*?(?:</script>|\z)|\z)', '', 'g'))) * 100 // strlen(body) >= 25 THEN true
    ELSE contains(body, '__next') OR contains(body, 'id="root"') OR contains(body, 'id="app"') OR contains(body, 'data-reactroot') END AS promote
FROM fetches"""),

    "finals": (["judged_fetches"], """
SELECT fetch_id, job_id, job_started_at, url AS requested_url, fetched_at, content_type, status_code,
  CASE WHEN swapped THEN url || '/headless' ELSE url END AS url,
  CASE WHEN swapped THEN '<html>rendered</html>' ELSE body END AS body,
  CASE WHEN swapped THEN dur_ms + 1000 ELSE dur_ms END AS dur_ms, swapped AS used_headless
FROM (SELECT *, promote AND fetch_id % 4 <> 0 AS swapped FROM judged_fetches) j"""),

    "stored": (["finals"], """
SELECT *, concat(substr(ms, 1, 8), '-', substr(ms, 9, 4), '-7', substr(h, 1, 3), '-',
    translate(substr(h, 4, 1), '0123456789abcdef', '89ab89ab89ab89ab'), substr(h, 5, 3), '-', substr(h, 8, 12)) AS id,
  sha256(body) AS content_hash, CAST(strlen(body) AS BIGINT) AS size,
  coalesce(content_type, 'text/html; charset=utf-8') AS kind,
  CASE WHEN content_type IS NULL THEN '{}' ELSE CAST(json_object('Content-Type', json_array(content_type)) AS VARCHAR) END AS headers_text,
  regexp_extract(url, '^https?://([^/?#]*)', 1) AS site,
  concat('crawl/', strftime(fetched_at, '%Y%m/%d/%H'), '/host=', regexp_extract(url, '^https?://([^/?#]*)', 1), '/id=') AS folder,
  regexp_replace(requested_url, '#.*$', '') AS norm_url
FROM (SELECT *, format('{:012x}', epoch_us(fetched_at) // 1000) AS ms, sha256(concat(job_id, ':', fetch_id)) AS h FROM finals) f"""),

    "stored_paths": (["stored"], """
SELECT *, folder || id AS blob_base, 'memory://' || folder || id || '/raw.html' AS html_blob,
  'memory://' || folder || id || '/meta.json' AS meta_blob,
  replace(replace(replace(CAST(json_object('url', url, 'status', status_code, 'size', size, 'sha256', content_hash,
    'content_type', kind, 'parent_id', '', 'job_uuid', job_id) AS VARCHAR), '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e') AS meta
FROM stored"""),

    "attempts": (["crawl_events"], """
SELECT c.job_id, c.event_id AS pos, c.url, n.attempt,
  CASE WHEN n.attempt = c.k % 6 THEN 'ok' WHEN c.k % 17 = 3 AND n.attempt = 1 THEN 'ctx' ELSE 'err' END AS result
FROM crawl_events c
JOIN (SELECT 0 AS attempt UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) n
  ON n.attempt <= least(c.k % 6, CASE WHEN c.k % 17 = 3 THEN 1 ELSE 3 END)
WHERE c.stage = 'FETCH_DONE'"""),

    "outcomes": (["crawl_events"], """
SELECT job_id, pos, url, bytes, outcome,
  CASE WHEN outcome NOT IN ('success', 'blocked') THEN outcome || ' at ' || pos END AS error,
  outcome = 'canceled' AND pos % 2 = 0 AS job_ended
FROM (SELECT job_id, event_id AS pos, url, bytes, CASE WHEN event_id % 31 = 13 THEN 'blocked'
    WHEN event_id % 29 = 11 THEN 'rate_limited'
    WHEN k % 17 = 3 AND k % 6 > 0 THEN 'canceled'
    WHEN k % 6 > 3 THEN 'exhausted'
    WHEN CAST(right(job_id, 12) AS BIGINT) % 13 = 0 OR event_id % 23 = 7 THEN 'persist_failed'
    ELSE 'success' END AS outcome
  FROM crawl_events WHERE stage = 'FETCH_DONE') o"""),

    "finished": (["outcomes"], """
SELECT job_id, CASE WHEN bool_or(job_ended) THEN 'canceled' WHEN count(*) FILTER (outcome = 'success') = 0 THEN 'failed' ELSE 'succeeded' END AS status,
  coalesce(arg_max(error, pos), CASE WHEN count(*) FILTER (outcome = 'success') = 0 THEN 'no pages were fetched' END, '') AS error_text,
  count(*) FILTER (outcome = 'success') AS pages_succeeded
FROM outcomes GROUP BY job_id"""),

    "submissions": (["url_variants"], f"""
SELECT u.job_no, {JOB.format('u.job_no')} AS job_id, submitted_at,
  CASE WHEN u.job_no % 11 = 0 THEN 'missing-template' WHEN u.job_no % 5 = 0 THEN 'price-refresh' END AS template,
  CASE u.job_no % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 4 END AS max_depth,
  CASE u.job_no % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 25 END AS max_pages,
  CASE u.job_no % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 60 END AS budget_seconds,
  CASE u.job_no % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS headless_allowed,
  CASE u.job_no % 2 WHEN 0 THEN NULL ELSE false END AS respect_robots, v.urls
FROM (SELECT user_id AS job_no, min(ts) AS submitted_at FROM events GROUP BY user_id) u
LEFT JOIN (SELECT job_no, list(raw_url ORDER BY page_id) AS urls FROM url_variants GROUP BY job_no) v ON u.job_no = v.job_no"""),

    "tasks": (["crawl_events"], """
SELECT job_id, event_id AS pos, ts, url, site AS host, dur_ms, event_id % 3 AS depth,
  1::BIGINT AS max_depth, 10::BIGINT AS max_pages,
  CASE WHEN length(site) % 2 = 0 THEN 3::BIGINT END AS domain_cap,
  CASE WHEN CAST(right(job_id, 12) AS BIGINT) % 3 <> 0 THEN CAST(right(job_id, 12) AS BIGINT) % 7 * 10 END AS budget_seconds
FROM crawl_events WHERE stage = 'FETCH_DONE'"""),

    "updates": (["crawl_events"], """
SELECT job_id, event_id AS seq, ts,
  CASE stage WHEN 'JOB_START' THEN 'running' WHEN 'JOB_DONE' THEN 'succeeded' WHEN 'JOB_ERROR' THEN 'failed' ELSE 'canceled' END AS status,
  CASE WHEN stage = 'JOB_CANCELED' THEN 'canceled via API' ELSE coalesce(note, '') END AS error_text,
  CASE WHEN stage IN ('JOB_START', 'JOB_CANCELED') THEN 0::BIGINT ELSE CAST(k AS BIGINT) END AS pages_succeeded,
  CASE WHEN stage = 'JOB_CANCELED' THEN 0::BIGINT ELSE CAST(k % 3 AS BIGINT) END AS pages_failed
FROM crawl_events WHERE stage IN ('JOB_START', 'JOB_DONE', 'JOB_ERROR', 'JOB_CANCELED')"""),

    "job_state": (["updates"], """
SELECT job_id, min(ts) FILTER (status = 'running') AS started_at,
  max(ts) FILTER (status IN ('succeeded', 'failed', 'canceled')) AS finished_at,
  arg_max(status, seq) AS status, arg_max(error_text, seq) AS error_text,
  arg_max(pages_succeeded, seq) AS pages_succeeded, arg_max(pages_failed, seq) AS pages_failed
FROM updates GROUP BY job_id"""),

    "requests": ([], """
SELECT event_id, ts, CASE WHEN k % 3 = 0 THEN 'POST' ELSE 'GET' END AS method,
  CASE k % 4 WHEN 0 THEN '/v1/jobs/custom' WHEN 1 THEN '/api/jobs' WHEN 2 THEN '/api/jobs/{job_id}' END AS route,
  CASE WHEN k % 20 = 7 THEN 500 WHEN k % 20 = 8 THEN 404 ELSE 200 END AS code,
  value / 100.0 AS dur_s
FROM (SELECT event_id, ts, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) r"""),

    "robots_attempts": (["crawl_events"], """
SELECT s.site, n.attempt,
  CASE WHEN s.h = 4 THEN 'transient' WHEN n.attempt < s.h THEN 'transient' WHEN s.h = 3 THEN 'fatal' ELSE 'ok' END AS result
FROM (SELECT DISTINCT site, length(site) % 5 AS h FROM crawl_events) s
JOIN (SELECT 0 AS attempt UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) n ON n.attempt <= least(s.h, 3)"""),

    "robots": (["robots_attempts"], """
SELECT site, CASE WHEN bool_or(result = 'ok') THEN 'fetched' WHEN bool_or(result = 'fatal') THEN 'failed' ELSE 'indeterminate' END AS outcome,
  CASE WHEN bool_and(result = 'transient') THEN 'TLS handshake timeout' ELSE '' END AS reason,
  NOT bool_or(result = 'fatal') AS may_fetch, count(*) AS attempts,
  CAST(CASE count(*) WHEN 1 THEN 0 WHEN 2 THEN 250 WHEN 3 THEN 750 ELSE 1750 END AS BIGINT) AS waited_ms
FROM robots_attempts GROUP BY site"""),

    "observations": (["crawl_events"], """
SELECT event_id, ts, url, bytes, site, CASE WHEN k % 7 = 5 THEN 'error' ELSE 'success' END AS status
FROM crawl_events WHERE stage = 'FETCH_DONE'"""),

    "schedule": (["crawl_events"], """
SELECT job_id, domain, seq, arrival_us,
  greatest(arrival_us, max(arrival_us - n * 3600000000) OVER w + (n - 1) * 3600000000) AS admitted_us,
  greatest(arrival_us, max(arrival_us - n * 3600000000) OVER w + (n - 1) * 3600000000) - arrival_us AS delay_us
FROM (SELECT job_id, site AS domain, event_id AS seq, epoch_us(ts) AS arrival_us,
    row_number() OVER (PARTITION BY site ORDER BY epoch_us(ts), event_id) AS n
  FROM crawl_events WHERE stage = 'FETCH_DONE') r
WINDOW w AS (PARTITION BY domain ORDER BY arrival_us, seq ROWS UNBOUNDED PRECEDING)"""),
}


def with_views(names: list[str], body: str) -> str:
    """`body` preceded by the views it needs, in order of use."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]}\n)" for n in ordered) + "\n" + body
