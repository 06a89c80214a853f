"""Expressions for report rows: statuses, identifiers, addresses, durations, text lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: result words accepted from tests -> reported status; anything else is an ERROR ----
STATUS_WORDS = {
    "pass": "PASS",
    "ok": "PASS",
    "success": "PASS",
    "fail": "FAIL",
    "failed": "FAIL",
    "skip": "SKIP",
    "skipped": "SKIP",
    "error": "ERROR",
    "errored": "ERROR",
    "incomplete": "ERROR",
    "miss": "MISS",
    "done": "DONE",
}
# ---- Fixed values: report schema version, field formats, names reported under the boot path ----
REPORT_VERSION = (5, 3)
PATH_FORMAT = r"\A([a-zA-Z0-9_-]+(\.[a-zA-Z0-9_-]+)*)?\z"
ORIGIN_FORMAT = r"\A[a-z0-9_]+\z"
BOOT_NAMES = ["baseline", "url-kernel-boot", "boot"]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def report_status(raw: Column) -> Column:
    words = F.create_map(*[F.lit(x) for pair in STATUS_WORDS.items() for x in pair])
    return F.coalesce(F.try_element_at(words, F.lower(strip(raw))), F.lit("ERROR"))


def valid_path(path: Column) -> Column:
    return F.coalesce(path.rlike(PATH_FORMAT), F.lit(False))


def valid_origin(origin: Column) -> Column:
    return F.coalesce(origin.rlike(ORIGIN_FORMAT), F.lit(False))


def test_path(name: Column) -> Column:
    return F.when(F.lower(strip(name)).isin(BOOT_NAMES), F.lit("boot")).otherwise(name)


def public_url(bucket: Column, region: Column, key: Column) -> Column:
    return F.concat(F.lit("https://"), bucket, F.lit(".s3."), region, F.lit(".amazonaws.com/"), key)


def runtime_text(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return F.concat(F.floor(whole / 60).cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s"))


def regression_line() -> Column:
    """Report line of a comparison row, as produced by ``operators.verdicts.compare``.

    Numbers print as Java rounds them: a last digit on the tie goes up, where Python looks at the binary value.
    """
    # fixed value: the line as its readers know it
    return F.format_string(
        "%s: base=%.2f±%.2f (cv: %.2f) → tip=%.2f±%.2f (cv: %.2f) %s (%+.1f%%) "
        "[t-test p=%.4f, U-test p=%.4f, Cohen's d=%.2f]",
        "metric",
        "mean_base",
        "stddev_base",
        "cv_base",
        "mean_tip",
        "stddev_tip",
        "cv_tip",
        "unit",
        "pct_change",
        "t_pvalue",
        "u_pvalue",
        "cohens_d",
    )
