"""Secret scans with multipart credential linking.

Assignments to secret names, access identifiers and long hex strings are reported for what they are. Further
identifiers, mixed tokens and endpoints are weak: alone they are ordinary text. They are reported where complementary
parts begin within ``SCOPE`` code points: an identifier beside a secret, a secret beside an identifier, an endpoint
beside both. The parts meet in an interval join, not in a pass over a text's pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import written

# Fixed patterns: the base kinds. "[0-9a-f]+ of 32 and more" are the runs that hold 32.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
# Weak parts: other identifiers, tokens of mixed letters and digits, and addresses.
IDENT = r"""(?:ASIA|AIDA|AROA)[A-Z0-9]{12,}|(?i:user(?:name)?|login|client_?id)["']?\x20{0,8}[:=]\x20{0,8}["']?[A-Za-z0-9._@+-]{3,64}"""
MIXED = r"[A-Za-z0-9+/_-]{20,200}"
ENDPOINT = r"""[a-z]{2,12}://[^\s"'<>]{3,200}|[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){1,6}:[0-9]{2,5}"""
BASE, WEAK = ["assign", "access", "hex"], ["ident", "secret", "endpoint"]
SCOPE, LEAST_VALUE = 256, 8


def _parts(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``_base`` and ``_weak``, arrays of spans; the weak kinds only in texts that may have a pair."""
    t = F.coalesce(F.col(text), F.lit(""))
    assign = spans.where(t.rlike(ASSIGN), F.filter(spans.matches(t, ASSIGN, "assign", 2), lambda s: F.length(s["text"]) >= LEAST_VALUE))
    access = spans.where(F.contains(t, F.lit("AKIA")), spans.matches(t, ACCESS, "access"))
    hexes = spans.where(t.rlike(HEX), spans.matches(t, HEX, "hex"))
    out = docs.withColumn("_base", F.concat(assign, access, hexes))
    out = out.withColumn("_ident", spans.where(t.rlike(IDENT), spans.matches(t, IDENT, "ident")))
    has_id = (F.size("_ident") > 0) | F.exists("_base", lambda s: s["kind"] == "access")
    varied = lambda s: s["text"].rlike("[A-Z]") & s["text"].rlike("[a-z]") & s["text"].rlike("[0-9]")
    out = out.withColumn("_secret", spans.where(has_id & t.rlike(MIXED), F.filter(spans.matches(t, MIXED, "secret"), varied)))
    has_secret = (F.size("_secret") > 0) | F.exists("_base", lambda s: s["kind"] != "access")
    out = out.withColumn("_endpoint", spans.where(has_id & has_secret, spans.matches(t, ENDPOINT, "endpoint")))
    weak = F.when(has_id & has_secret, F.concat("_ident", "_secret", "_endpoint")).otherwise(F.array().cast(spans.EMPTY))
    return out.withColumn("_weak", weak).drop("_ident", "_secret", "_endpoint")


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``spans``, an array of (start, end, kind, text, base) in order of start, for every row.

    Null and empty texts have none. Weak spans that overlap a base span are left out. Rows of equal key and text have
    equal results; a null key is a key like others. What is linked depends on the one text only.
    """
    lean = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    parts = _parts(lean, "_text").withColumn("_hash", F.xxhash64("_text"))
    parts = written(parts.select("_key", "_hash", "_base", "_weak"), "parts")
    same = ["_key", "_hash"]
    some = parts.filter(F.size("_weak") > 0).dropDuplicates(same)
    # a text's parts are few thousands at most for each hundred kilobytes: as rows they are dealt out by place
    every = some.select(*same, F.explode(F.concat("_base", "_weak")).alias("_s"))
    every = written(every.select(*same, F.col("_s.start").alias("start"), F.col("_s.end").alias("end"), F.col("_s.kind").alias("kind")).distinct(), "spans")
    weak = every.filter(F.col("kind").isin(WEAK))
    others = every.select(*same, F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("kind").alias("r_kind"))
    pairs = spans.near(weak, others, same, SCOPE)
    overlaps = F.col("r_kind").isin(BASE) & (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    ident = F.col("r_kind").isin("access", "ident") & (F.abs(F.col("start") - F.col("r_start")) <= SCOPE)
    secret = F.col("r_kind").isin("assign", "hex", "secret") & (F.abs(F.col("start") - F.col("r_start")) <= SCOPE)
    seen = pairs.groupBy(*same, "start", "end", "kind").agg(
        F.max(overlaps).alias("_over"), F.max(ident).alias("_ident"), F.max(secret).alias("_secret")
    )
    complete = (
        F.when(F.col("kind") == "ident", F.col("_secret"))
        .when(F.col("kind") == "secret", F.col("_ident"))
        .otherwise(F.col("_ident") & F.col("_secret"))
    )
    linked = seen.filter(complete & ~F.col("_over"))
    linked = linked.groupBy(*[F.col(c).alias(f"_l{c}") for c in same]).agg(F.collect_list(F.struct("start", "end", "kind")).alias("_linked"))
    out = parts.join(linked, F.col("_key").eqNullSafe(F.col("_l_key")) & F.col("_hash").eqNullSafe(F.col("_l_hash")), "left")

    def as_found(array, base):
        shape = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(base).alias("base"))
        return F.transform(array, shape)

    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    both = F.concat(as_found(F.col("_base"), True), as_found(F.coalesce("_linked", none), False))
    return out.select(F.col("_key").alias(key), F.array_sort(both).alias("spans"))


def digest(found: DataFrame, base: list[str], added: list[str], key: str = "doc_id") -> DataFrame:
    """Counts, the hash of the base spans and all spans as text, from rows with ``spans``."""
    own = F.filter("spans", lambda s: s["base"])
    counts = [spans.count(own, k).alias(f"n_{k}") for k in base]
    base_text = F.sha2(spans.joined(own, base), 256).alias("base_sha256")
    return found.select(key, *counts, base_text, spans.joined(F.col("spans"), base + added).alias("spans"))
