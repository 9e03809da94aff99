"""URL columns: normalisation, host labels and blob paths.

A URL is cut into its parts once, by one expression, and every function here
reads those parts. Only built-in expressions are used; percent-decoding runs
over hex text, so bytes that are not valid UTF-8 survive, and only for URLs
that hold an escape.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

_SPLIT = (
    r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*:)?"  # scheme
    r"(//[^/?#]*)?"                       # authority
    r"([^?#]*)"                           # path
    r"(\?[^#]*)?"                         # query
    r"(#.*)?\z"                            # fragment
)
_BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
_CONTROL = r"[\x00-\x1F\x7F]"

# Characters each part of a URL may hold or keep unescaped.
_UNRESERVED = r"A-Za-z0-9\-_.~"
_USER_LEGAL = rf"^[{_UNRESERVED}:!$&'()*+,;=%@]*\z"
_USER_KEEP = rf"{_UNRESERVED}$&+,;="
_HOST_KEEP = rf"{_UNRESERVED}!$&'()*+,;=:\[\]<>\""
_HOST_LEGAL = rf"^(?:[{_HOST_KEEP}]|[^\x00-\x7F]|%25|%[89A-Fa-f][0-9A-Fa-f])*\z"
_PATH_LEGAL = rf"^[{_UNRESERVED}!$&'()*+,;=:@/\[\]%]*\z"
_PATH_KEEP = rf"{_UNRESERVED}$&+,/:;=@"
_QUERY_KEEP = _UNRESERVED

# The usual shape of a URL: no escapes, user or brackets, simple query.
_PLAIN = (
    r"^[Hh][Tt][Tt][Pp][Ss]?://[A-Za-z0-9.\-]+(?::[0-9]+)?"
    rf"(?:/[{_UNRESERVED}!$&'()*+,;=:@/\[\]]*)?"
    rf"(?:\?[{_UNRESERVED}=&]*)?(?:#[^%]*)?\z"
)
_TWO_EQUALS = r"=[^?&#]*="
_PLAIN_HOST = (
    r"^[A-Za-z][A-Za-z0-9+.\-]*://[A-Za-z0-9.\-]+(?::[0-9]*)?(?:[/?#][^%\x00-\x1F\x7F]*)?\z"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `body`."""
    return F.transform(F.array(value), body)[0]


def _byte_hex(text: Column, plus_is_space: bool = False) -> Column:
    """Hex of the bytes a percent-encoded text stands for."""
    def token(t: Column) -> Column:
        out = F.when(F.length(t) == 3, F.upper(F.substring(t, 2, 2)))
        if plus_is_space:
            out = out.when(t == "+", "20")
        return out.otherwise(F.hex(t))

    special = r"[%+]" if plus_is_space else "%"
    tokens = F.regexp_extract_all(text, F.lit(r"(?s)%[0-9A-Fa-f]{2}|."), F.lit(0))
    return F.when(~text.rlike(special), F.hex(text)).otherwise(
        F.array_join(F.transform(tokens, token), "")
    )


def _encode_hex(hex_text: Column, keep: str, space_plus: bool = False) -> Column:
    """Percent-encode bytes given as hex, leaving the characters in `keep`."""
    def byte(b: Column) -> Column:
        char = F.char(F.conv(b, 16, 10).cast("int"))
        out = F.when(char.rlike(rf"^[{keep}]\z"), char)
        if space_plus:
            out = out.when(b == "20", "+")
        return out.otherwise(F.concat(F.lit("%"), b))

    return F.array_join(
        F.transform(F.regexp_extract_all(hex_text, F.lit(".."), F.lit(0)), byte), ""
    )


def _reencode(text: Column, keep: str, plus_is_space: bool = False) -> Column:
    return F.when(text.rlike(rf"^[{keep}]*\z"), text).otherwise(
        _encode_hex(_byte_hex(text, plus_is_space), keep, plus_is_space)
    )


def _sorted_query(query: Column) -> Column:
    """Query pairs ordered by decoded key; equal keys keep their order."""
    def usable(pair: Column) -> Column:
        return (pair != "") & ~pair.contains(";") & ~pair.rlike(_BAD_ESCAPE)

    def entry(pair: Column, index: Column) -> Column:
        key = F.substring_index(pair, "=", 1)
        value = F.when(
            pair.contains("="), F.substr(pair, F.instr(pair, "=") + F.lit(1))
        ).otherwise("")
        return F.struct(
            _byte_hex(key, True).alias("sort_key"),
            index.alias("index"),
            F.concat(
                _reencode(key, _QUERY_KEEP, True), F.lit("="),
                _reencode(value, _QUERY_KEEP, True),
            ).alias("text"),
        )

    pairs = F.transform(F.filter(F.split(query, "&"), usable), entry)
    return F.when(query == "", "").otherwise(
        F.array_join(F.transform(F.array_sort(pairs), lambda p: p["text"]), "&")
    )


def _parts(url: Column) -> Column:
    """Raw parts of a URL as a struct."""
    def group(i: int) -> Column:
        return F.regexp_extract(url, _SPLIT, i)

    return F.struct(
        F.lower(F.rtrim(group(1), F.lit(":"))).alias("scheme"),
        group(2).alias("slashes"),
        group(3).alias("rest"),
        group(4).alias("query"),
        group(5).alias("fragment"),
        url.alias("raw"),
    )


def _resolve(p: Column) -> Column:
    """Authority, host and path of the raw parts; three slashes without a scheme
    are a path."""
    bare_path = (p["scheme"] == "") & (p["slashes"] == "//") & p["rest"].startswith("/")
    authority = F.when(bare_path, "").otherwise(F.substring(p["slashes"], 3, 1 << 30))
    return F.struct(
        p["scheme"].alias("scheme"),
        ((p["slashes"] != "") & ~bare_path).alias("has_authority"),
        authority.contains("@").alias("has_user"),
        F.regexp_extract(authority, r"(?s)^(.*)@", 1).alias("user"),
        F.regexp_replace(authority, r"(?s)^.*@", "").alias("host"),
        F.when(bare_path, F.concat(p["slashes"], p["rest"])).otherwise(p["rest"]).alias("path"),
        p["query"].alias("query"),
        p["fragment"].alias("fragment"),
        p["raw"].alias("raw"),
        ((p["scheme"] != "") & (p["slashes"] == "") & ~p["rest"].startswith("/")).alias("opaque"),
    )


def _invalid(p: Column) -> Column:
    host = p["host"]
    relative = (p["scheme"] == "") & ~p["has_authority"] & ~p["path"].startswith("/")
    bracketed = host.startswith("[")
    return (
        F.substring_index(p["raw"], "#", 1).rlike(_CONTROL)
        | p["raw"].startswith(":")
        | p["fragment"].rlike(_BAD_ESCAPE)
        | (relative & p["path"].rlike(r"^[^/]*:"))
        | (~p["opaque"] & p["path"].rlike(_BAD_ESCAPE))
        | ~p["user"].rlike(_USER_LEGAL)
        | p["user"].rlike(_BAD_ESCAPE)
        | ~host.rlike(_HOST_LEGAL)
        | (bracketed & ~host.rlike(r"\](?::[0-9]*)?\z"))
        | (~bracketed & ~host.rlike(r"^[^:]*\z|:[0-9]*\z"))
    )


def _decoded_host(host: Column) -> Column:
    return F.when(
        host.contains("%"), F.decode(F.unhex(_byte_hex(host)), "UTF-8")
    ).otherwise(host)


def _with_parts(url: Column, body: Callable[[Column], Column]) -> Column:
    return let(url, lambda u: let(_parts(u), lambda raw: let(_resolve(raw), body)))


def normalize_url(url: Column) -> Column:
    """Canonical form of a URL; NULL when it cannot be parsed.

    Scheme and host in lower case, default port and fragment removed, query
    pairs decoded, ordered by key and encoded again.
    """
    def render(p: Column) -> Column:
        host = F.lower(_decoded_host(p["host"]))
        host = (
            F.when(p["scheme"] == "http", F.regexp_replace(host, r":80\z", ""))
            .when(p["scheme"] == "https", F.regexp_replace(host, r":443\z", ""))
            .otherwise(host)
        )
        host = _reencode_host(host)
        password_at = F.instr(p["user"], ":")
        user = F.when(
            password_at > 0,
            F.concat(
                _reencode(F.substring_index(p["user"], ":", 1), _USER_KEEP), F.lit(":"),
                _reencode(F.substr(p["user"], password_at + F.lit(1)), _USER_KEEP),
            ),
        ).otherwise(_reencode(p["user"], _USER_KEEP))
        path = F.when(p["path"].rlike(_PATH_LEGAL), p["path"]).otherwise(
            _encode_hex(_byte_hex(p["path"]), _PATH_KEEP)
        )
        query = _sorted_query(F.substring(p["query"], 2, 1 << 30))
        return F.struct(
            p["scheme"].alias("scheme"), p["opaque"].alias("opaque"),
            p["has_user"].alias("has_user"), p["has_authority"].alias("has_authority"),
            p["path"].alias("raw_path"),
            F.when(_invalid(p), F.lit(None)).otherwise(host).alias("host"),
            F.when(p["has_user"], F.concat(user, F.lit("@"))).otherwise("").alias("user"),
            path.alias("path"),
            F.when((p["query"] == "?"), "?")
            .when(query == "", "").otherwise(F.concat(F.lit("?"), query)).alias("query"),
        )

    def join(n: Column) -> Column:
        scheme = F.when(n["scheme"] == "", "").otherwise(F.concat(n["scheme"], F.lit(":")))
        shown = n["has_authority"] & (
            ((n["scheme"] != "") & (n["path"] != "")) | (n["host"] != "") | n["has_user"]
        )
        authority = F.when(shown, F.concat(F.lit("//"), n["user"], n["host"])).otherwise("")
        dot = F.when(
            (n["scheme"] == "") & ~shown & n["path"].rlike(r"^[^/]*:"), "./"
        ).otherwise("")
        return F.when(n["host"].isNull(), F.lit(None)).when(
            n["opaque"], F.concat(scheme, n["raw_path"], n["query"])
        ).otherwise(F.concat(scheme, authority, dot, n["path"], n["query"]))

    plain = url.rlike(_PLAIN) & ~url.rlike(_TWO_EQUALS)
    return F.when(plain, _normalize_plain(url)).otherwise(
        _with_parts(url, lambda p: let(render(p), join))
    )


def _normalize_plain(url: Column) -> Column:
    """`normalize_url` for the usual shape, where nothing needs re-encoding."""
    base = F.lower(F.regexp_extract(url, r"^[^:]*://[^/?#]*", 0))
    base = F.regexp_replace(base, r"^(http://.*):80\z|^(https://.*):443\z", "$1$2")
    path = F.regexp_extract(url, r"^[^:]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)

    def entry(pair: Column, index: Column) -> Column:
        return F.struct(
            F.substring_index(pair, "=", 1).alias("key"), index.alias("index"),
            F.when(pair.contains("="), pair).otherwise(F.concat(pair, F.lit("="))).alias("text"),
        )

    pairs = F.filter(F.split(F.substring(query, 2, 1 << 30), "&"), lambda p: p != "")
    ordered = F.transform(F.array_sort(F.transform(pairs, entry)), lambda p: p["text"])
    query = (
        F.when(query.isin("", "?"), query)
        .when(query.rlike(r"^\?&+\z"), "")
        .otherwise(F.concat(F.lit("?"), F.array_join(ordered, "&")))
    )
    return F.concat(base, path, query)


def _reencode_host(host: Column) -> Column:
    """Hosts may hold a literal percent sign after decoding, so encode the bytes."""
    return F.when(host.rlike(rf"^[{_HOST_KEEP}]*\z"), host).otherwise(
        _encode_hex(F.hex(host), _HOST_KEEP)
    )


def normalize_or_raw(url: Column) -> Column:
    """The form a crawl uses: normalised where possible, else as given."""
    return let(url, lambda u: F.coalesce(normalize_url(u), u))


def _host_of(url: Column) -> Column:
    """Decoded host with port, case kept: NULL if unparseable, '' if none."""
    return F.when(
        url.rlike(_PLAIN_HOST), F.regexp_extract(url, r"^[^/]*//([^/?#]*)", 1)
    ).otherwise(_with_parts(
        url, lambda p: F.when(_invalid(p), F.lit(None)).otherwise(_decoded_host(p["host"]))
    ))


def _strip_port(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host, r":[0-9]*\z", ""), r"(?s)^\[(.*)\]\z", "$1")


def extract_host(url: Column) -> Column:
    """Host with port, as written; `unknown` if there is none."""
    return F.coalesce(F.nullif(_host_of(url), F.lit("")), F.lit(C.UNKNOWN))


def sanitize_host(host: Column) -> Column:
    """A host as a path segment."""
    clean = F.lower(F.regexp_replace(F.coalesce(host, F.lit("")), r"(?U)^\s+|\s+\z", ""))
    clean = F.regexp_replace(clean, r"[^a-z0-9.:\-]", "-")
    clean = F.regexp_replace(F.translate(clean, ":", "_"), r"^[\-_]+|[\-_]+\z", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(C.UNKNOWN))


def sanitize_site(url: Column) -> Column:
    """Metric label: lower-case host name without port."""
    full = F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("http://"), url))
    host = let(full, _host_of)
    return F.coalesce(F.nullif(F.lower(_strip_port(host)), F.lit("")), F.lit(C.UNKNOWN))


def crawl_site(url: Column) -> Column:
    """Metric label of a task's URL: `sanitize_site` of its normalised form."""
    plain = url.rlike(_PLAIN) & ~url.rlike(_TWO_EQUALS)
    return F.when(
        plain, F.lower(F.regexp_extract(url, r"^[^:]*://([^/?#:]*)", 1))
    ).otherwise(let(normalize_or_raw(url), sanitize_site))


def limit_domain(url: Column) -> Column:
    """Rate-limit key: host name without port; only unparseable URLs are `unknown`."""
    return F.coalesce(_strip_port(_host_of(url)), F.lit(C.UNKNOWN))


def blob_base(ts: Column, host: Column, page_id: Column,
              prefix: str = C.DEFAULT_BLOB_PREFIX) -> Column:
    """Folder of a stored page: [prefix/]yyyyMM/dd/HH/host=<h>/id=<id>."""
    prefix = prefix.strip("/")
    if prefix:
        prefix = posixpath.normpath(prefix) + "/"
    return F.concat(
        F.lit(prefix), F.date_format(ts, "yyyyMM/dd/HH"), F.lit("/host="),
        sanitize_host(host), F.lit("/id="), page_id,
    )


def blob_uri(path: Column, backend: str, base: str = "") -> Column:
    """URI of a stored object; NULL where the backend refuses the path.

    The local backend resolves `.` and `..` and refuses what leaves its base.
    """
    blank = F.regexp_replace(path, r"(?U)\s", "") == ""
    if backend == "memory":
        return F.concat(F.lit("memory://"), path)
    if backend == "gcs":
        return F.when(~blank, F.concat(F.lit(f"gs://{base}/"), path))
    if backend != "local":
        raise ValueError(f"unknown blob backend {backend!r}")

    root = posixpath.normpath(base)
    top = [s for s in root.split("/") if s]
    start = F.array(*map(F.lit, top)) if top else F.array().cast("array<string>")

    def step(done: Column, segment: Column) -> Column:
        dropped = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        above = done if root.startswith("/") else F.concat(done, F.array(segment))
        return (
            F.when(segment.isin("", "."), done)
            .when((segment == "..") & (F.size(done) > 0),
                  F.when(F.try_element_at(done, F.lit(-1)) != "..", dropped).otherwise(above))
            .when(segment == "..", above)
            .otherwise(F.concat(done, F.array(segment)))
        )

    resolved = F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")
    if root.startswith("/"):
        resolved = F.concat(F.lit("/"), resolved)
    inside = resolved.startswith(root.rstrip("/") + "/")
    return F.when(~blank & inside, F.concat(F.lit("file://"), resolved))
