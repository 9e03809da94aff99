"""Fixed values that results depend on."""

# Progress stages.
JOB_START = "JOB_START"
JOB_HEARTBEAT = "JOB_HEARTBEAT"
JOB_DONE = "JOB_DONE"
JOB_ERROR = "JOB_ERROR"
FETCH_START = "FETCH_START"
FETCH_DONE = "FETCH_DONE"

# Status classes; site statistics only know the first four.
STATUS_CLASSES = ["2xx", "3xx", "4xx", "5xx"]
OTHER_CLASS = "other"

# Histogram bounds in seconds.
JOB_RUNTIME_BOUNDS = [1, 5, 15, 30, 60, 120, 300, 600, 1200]
FETCH_DURATION_BOUNDS = [0.01, 0.05, 0.1, 0.5, 1, 2, 5, 10]
HTTP_LATENCY_BOUNDS = [0.05, 0.1, 0.25, 0.5, 1, 2, 5]
RATE_DELAY_BOUNDS = [0.1, 0.5, 1, 2, 5, 10, 30]

# Headless promotion.
PROMOTION_THRESHOLD = 2048
SCRIPT_SHARE_PERCENT = 25
SPA_MARKERS = ["__next", 'id="root"', 'id="app"', "data-reactroot"]

# Pages.
DEFAULT_CONTENT_TYPE = "text/html; charset=utf-8"
DEFAULT_BLOB_PREFIX = "crawl"
MESSAGE_SCHEMA_VERSION = "1"

# Retries and robots.txt probing.
MAX_RETRIES = 3
RETRY_BASE_MS = 1000
ROBOTS_BACKOFF_MS = [250, 500, 1000]
ROBOTS_INDETERMINATE = "indeterminate"
ROBOTS_INDETERMINATE_REASON = "TLS handshake timeout"

# Job defaults.
DEFAULT_MAX_DEPTH = 1
DEFAULT_MAX_PAGES = 10
DEFAULT_BUDGET_SECONDS = 15
DEFAULT_HEADLESS = False
DEFAULT_IGNORE_ROBOTS = False
DEFAULT_RATE_PER_SECOND = 1.0
DEFAULT_BURST = 1
NO_PAGES_ERROR = "no pages were fetched"
CANCEL_ERROR = "canceled via API"

# Event batching and list sizes.
BATCH_MAX_EVENTS = 1000
BATCH_MAX_WAIT_MS = 500
JOBS_LIMIT, JOBS_LIMIT_MAX = 50, 500
SITES_LIMIT, SITES_LIMIT_MAX = 100, 1000

# Identifiers and labels.
NIL_UUID = "00000000-0000-0000-0000-000000000000"
UNKNOWN = "unknown"
