"""Fetch rules as a table of any size; the most specific rule decides.

A rule (`job_id`, `host`, `path`, `min_depth`, `max_depth`, `priority`,
`allow_fetch`, `allow_headless`) holds for a job or for all (NULL), for a host and
its subdomains or for all ('' or NULL), for a path and what lies below it, and
between two depths (NULL: no limit). Every URL has few ancestors, a suffix of its
host's labels and a prefix of its path's segments each, so rules are found by
equality of ancestors and not by comparing every URL with every rule. Only
ancestors of a shape that some rule has (so many labels and segments, for one job or
all) are looked up.

Of the rules that hold, the one of the highest priority decides, then the one with
most labels, most segments, for the one job, with a depth limit; of equals, one that
refuses. What decides is packed into one number, so the choice is a hash aggregate.
Tasks without a host meet only rules for all hosts. Without a rule all is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_run_dir

RULES = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("host", T.StringType()),
    T.StructField("path", T.StringType()), T.StructField("min_depth", T.LongType()),
    T.StructField("max_depth", T.LongType()), T.StructField("priority", T.IntegerType()),
    T.StructField("allow_fetch", T.BooleanType()), T.StructField("allow_headless", T.BooleanType()),
])

_KEY = ["_own", "_job", "_host", "_path"]


def _joined(text: Column, mark: str) -> Column:
    """The non-empty parts of a text between marks, with one mark between them."""
    single = F.when(text.contains(mark * 2), F.regexp_replace(text, f"[{mark}]+", mark)).otherwise(text)
    return F.btrim(single, F.lit(mark))


def _parts(joined: Column, mark: str) -> Column:
    marks = F.length(joined) - F.length(F.replace(joined, F.lit(mark), F.lit("")))
    return F.when(joined == "", 0).otherwise(marks + 1)


def _host(host: Column) -> Column:
    given = F.coalesce(host, F.lit(""))
    plain = F.when(given.contains(":"), F.regexp_replace(given, r":[0-9]*$", "")).otherwise(given)
    return _joined(F.lower(plain), ".")


def _path(path: Column) -> Column:
    return _joined(F.coalesce(path, F.lit("")), "/")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _keyed(rules: DataFrame) -> DataFrame:
    """Rules by what they are found by, and what each says as one number."""
    limited = F.col("min_depth").isNotNull() | F.col("max_depth").isNotNull()
    refuses_fetch = ~F.coalesce("allow_fetch", F.lit(True))
    refuses_headless = ~F.coalesce("allow_headless", F.lit(True))
    packed = F.coalesce(F.col("priority"), F.lit(0)).cast("bigint")
    for part, bits in ((F.col("_labels"), 10), (F.col("_segments"), 16), (F.col("_own"), 1), (limited, 1),
                       (refuses_fetch, 1), (refuses_headless, 1)):
        packed = packed * (1 << bits) + part.cast("bigint")
    return rules.withColumns({
        "_own": F.col("job_id").isNotNull(), "_job": F.coalesce("job_id", F.lit("")),
        "_host": _host(F.col("host")), "_path": _path(F.col("path")),
    }).withColumns({"_labels": _parts(F.col("_host"), "."), "_segments": _parts(F.col("_path"), "/")}).select(
        *_KEY, "_labels", "_segments", F.col("min_depth").alias("_min"), F.col("max_depth").alias("_max"),
        packed.alias("_says"))


def _shapes(places: DataFrame) -> DataFrame:
    """How many labels and segments the ancestors of these URLs have."""
    sizes = places.select(_parts(F.col("_h"), ".").alias("l"), _parts(F.col("_p"), "/").alias("s")).distinct()
    return sizes.select("s", F.explode(F.sequence(F.lit(0), F.col("l"))).alias("_labels")).select(
        "_labels", F.explode(F.sequence(F.lit(0), F.col("s"))).alias("_segments")).distinct()


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """The rows in a table in the shared folder, so that what they come from is computed once."""
    path = new_run_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _said(rules: DataFrame, places: DataFrame) -> DataFrame:
    """What rules of one key and one span of depths say together, for shapes met here."""
    met = _keyed(rules).join(F.broadcast(_shapes(places)), ["_labels", "_segments"], "left_semi")
    return met.groupBy(*_KEY, "_labels", "_segments", "_min", "_max").agg(F.max("_says").alias("_says"))


def _ancestors(asked: DataFrame, shapes: DataFrame) -> DataFrame:
    """The ancestors of every URL asked for, of the shapes that rules have."""
    spread = asked.withColumn("_labels", F.explode(F.sequence(F.lit(0), _parts(F.col("_h"), ".")))).withColumn(
        "_segments", F.explode(F.sequence(F.lit(0), _parts(F.col("_p"), "/"))))
    return spread.join(F.broadcast(shapes), shapes.columns, "left_semi").select(
        *asked.columns, F.expr("substring_index(_h, '.', -_labels)").alias("_host"),
        F.expr("substring_index(_p, '/', _segments)").alias("_path"))


def decide(tasks: DataFrame, rules: DataFrame) -> DataFrame:
    """Tasks (`job_id`, `pos`, `url`, `host`, `depth` and others) with `fetch_allowed` and `headless_allowed`."""
    placed = _kept(tasks.select("job_id", "pos", _host(F.col("host")).alias("_h"),
                                _path(path_of(F.col("url"))).alias("_p"), F.col("depth").alias("_d")), "placed")
    places = placed.select("_h", "_p", "_d").distinct()
    said = _kept(_said(rules, places), "rules")
    # at most a few hundred rows: labels of a host by segments of a path
    shapes = said.select("_own", "_labels", "_segments").distinct()
    jobs = said.where("_own").select(F.col("_job").alias("job_id")).distinct()
    own = placed.join(jobs, "job_id", "left_semi").select(
        F.lit(True).alias("_own"), F.col("job_id").alias("_job"), *places.columns).distinct()
    asked = places.select(F.lit(False).alias("_own"), F.lit("").alias("_job"), "*").unionByName(own)
    met = _ancestors(asked, shapes).join(said.drop("_labels", "_segments"), _KEY).where(
        (F.col("_min").isNull() | (F.col("_d") >= F.col("_min")))
        & (F.col("_max").isNull() | (F.col("_d") <= F.col("_max"))))
    best = met.groupBy(*asked.columns).agg(F.max("_says").alias("_says"))

    def answers(name: str, own: bool) -> DataFrame:
        return best.where(F.col("_own") == own).select(
            *[F.col(c).alias(f"{c}_{name}") for c in ("_job", *places.columns)], F.col("_says").alias(name))

    def same(name: str) -> Column:
        return ((F.col("_h") == F.col(f"_h_{name}")) & (F.col("_p") == F.col(f"_p_{name}"))
                & F.col("_d").eqNullSafe(F.col(f"_d_{name}")))

    decided = placed.join(answers("_any", False), same("_any"), "left").join(
        answers("_one", True), same("_one") & (F.col("job_id") == F.col("_job__one")), "left").groupBy(
        "job_id", "pos").agg(F.max(F.greatest("_any", "_one")).alias("_says"))
    return tasks.join(decided, ["job_id", "pos"], "left").select(
        *tasks.columns,
        F.coalesce(F.col("_says").bitwiseAND(2) == 0, F.lit(True)).alias("fetch_allowed"),
        F.coalesce(F.col("_says").bitwiseAND(1) == 0, F.lit(True)).alias("headless_allowed"))


def of_domain_lists(lists: DataFrame) -> DataFrame:
    """Rules for lists of domains (`job_id`, `domain`, `allow`), one row a domain; a job of NULL means all.

    A list with allowed domains refuses all others; refused domains win over
    allowed ones, however special those are.
    """
    others = lists.where("allow").select("job_id").distinct().select(
        "job_id", F.lit("").alias("host"), F.lit(0).alias("priority"), F.lit(False).alias("allow_fetch"))
    named = lists.select("job_id", F.col("domain").alias("host"),
                         F.when(F.col("allow"), 0).otherwise(1).alias("priority"), F.col("allow").alias("allow_fetch"))
    return named.unionByName(others).select(
        "job_id", "host", F.lit("").alias("path"), F.lit(None).cast("bigint").alias("min_depth"),
        F.lit(None).cast("bigint").alias("max_depth"), "priority", "allow_fetch", F.lit(True).alias("allow_headless"))
