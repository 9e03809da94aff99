"""Joins against stored keys: exact, and the stored side stays where it is."""

import re

import pytest
from pyspark.sql import functions as F

from crawlspark.stored.history import History


def made(spark, n=6000):
    number = F.col("id")
    return spark.range(n).select(
        F.when(number % 11 != 0, number % 7).alias("job"),
        F.when(number % 97 != 0, F.concat(F.lit("u"), number.cast("string"))).alias("url"),
        number.alias("k_job"), (number * 2).alias("block"), F.lit("x").alias("_hash"))


@pytest.mark.parametrize("blocks", [1, 16, 4096])
def test_new_and_known(spark, tmp_path, blocks):
    """Exact with a full filter and an empty one, with null keys, repeats and clashing columns."""
    history = History(spark, f"{tmp_path}/h", {"job": "bigint", "url": "string"}, 8, blocks)
    rows = made(spark)
    assert history.new(rows).count() == 6000 and history.known(rows).count() == 0  # nothing stored yet
    for _ in range(2):  # a repeated run counts once
        history.add(rows.where("k_job % 2 = 0 AND k_job < 3000"))
    history.add(rows.where("k_job % 3 = 0 AND k_job < 3000"))
    stored = {(r["job"], r["url"]) for r in rows.where("(k_job % 2 = 0 OR k_job % 3 = 0) AND k_job < 3000").collect()}
    incoming = rows.unionByName(rows.where("k_job < 100"))
    want = {True: [], False: []}
    for r in incoming.collect():
        want[(r["job"], r["url"]) in stored].append(str(r))
    assert sorted(map(str, history.new(incoming).collect())) == sorted(want[False])
    assert sorted(map(str, history.known(incoming).collect())) == sorted(want[True])


def test_another_session_finds_the_buckets(spark, tmp_path):
    keys = {"url": "string"}
    History(spark, f"{tmp_path}/h", keys, 4, 8).add(made(spark, 100))
    spark.sql(f"DROP TABLE {History(spark, f'{tmp_path}/h', keys).table}")  # the files stay
    again = History(spark, f"{tmp_path}/h", keys, 99, 99)
    assert (again.buckets, again.blocks) == (4, 8)
    assert again.new(made(spark, 200)).count() == 200 - 100 - 1  # 0 and 97 have none
    with pytest.raises(ValueError):
        History(spark, f"{tmp_path}/h", {"url": "string", "job": "bigint"})


def above(plan: str, scan: str) -> list[str]:
    """The operators between a scan of a table and the join that takes it in."""
    lines, found = plan.splitlines(), []
    for i, line in enumerate(lines):
        if scan not in line or "FileScan" not in line:
            continue
        depth = len(re.match(r"[\s:+|-]*", line)[0])
        for upper in reversed(lines[:i]):
            here = len(re.match(r"[\s:+|-]*", upper)[0])
            if here < depth:
                depth = here
                if "Join" in upper:
                    break
                found.append(upper.strip(" :+-").split()[0])
    return found


def test_stored_side_is_not_moved(spark, tmp_path):
    history = History(spark, f"{tmp_path}/h", {"url": "string"}, 8, 64)
    history.add(made(spark, 500))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = history.new(made(spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for table in (history.table, history.filter):
        operators = above(plan, table)
        assert operators and not any("Exchange" in o for o in operators), operators
    assert "Exchange" in plan
