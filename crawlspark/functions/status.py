"""Status codes, job states and job ids as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def status_class(code: Column) -> Column:
    """`2xx` to `5xx`; anything else, NULL included, is `other`."""
    hundred = F.floor(code / 100).cast("int")
    return F.when(
        hundred.between(2, 5), F.concat(hundred.cast("string"), F.lit("xx"))
    ).otherwise(C.OTHER_CLASS)


def stage_of_status(job_status: Column) -> Column:
    """Progress stage announced for a job status; NULL if none is."""
    return (
        F.when(job_status == "succeeded", C.JOB_DONE)
        .when(job_status.isin("failed", "canceled"), C.JOB_ERROR)
    )


def run_status_of_stage(stage: Column) -> Column:
    return (
        F.when(stage == C.JOB_START, "running")
        .when(stage == C.JOB_DONE, "success")
        .when(stage == C.JOB_ERROR, "error")
    )


def parse_status(text: Column) -> Column:
    """Run status named by a list filter; NULL if the name is not known."""
    name = F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+\z", ""))
    return (
        F.when(name.isin("", "running"), "running")
        .when(name == "success", "success")
        .when(name.isin("error", "failed", "failure"), "error")
    )


_HYPHENED = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
# Plain, urn:uuid: prefixed, enclosed in one character on each side, or bare hex.
_UUID = rf"(?is)^(?:(?:urn:uuid:)?{_HYPHENED}|.{_HYPHENED}.|[0-9a-f]{{32}})\z"


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(_UUID), F.lit(False))


def canonical_uuid(text: Column) -> Column:
    """Lower-case hyphened form of any accepted spelling; NULL otherwise."""
    digits = F.lower(F.translate(F.regexp_extract(
        text, rf"(?i)({_HYPHENED}|^[0-9a-f]{{32}}$)", 1), "-", ""))
    hyphened = F.regexp_replace(digits, r"^(.{8})(.{4})(.{4})(.{4})(.{12})\z", "$1-$2-$3-$4-$5")
    return F.when(is_uuid(text), hyphened)


def reports_progress(job_id: Column) -> Column:
    """Only jobs with a UUID other than the nil one emit progress events."""
    return is_uuid(job_id) & (canonical_uuid(job_id) != C.NIL_UUID)
