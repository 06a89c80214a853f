"""Personal data: high-recall candidates, boosted trees, calibrated thresholds.

Addresses, IP numbers, cards and phones of fixed form are reported as they are. Generators propose further, overlapping
candidates: numbers in groups, disguised addresses, account numbers. Gradient-boosted trees score them by format and by
the words beside them. They learn from the corpus itself: of the generators' finds of one kind, those that meet a fixed
form are the positive examples, those that break its rule (a check digit, a part over 255, a wrong length) the negative
ones, and the rule itself is hidden from the features, so what is learnt is how such data are written and introduced.
A candidate is redacted where its score reaches the threshold, the lowest at which ``PRECISION`` of the examples set
aside for calibration are positive; of overlapping ones the best stays.

All examples take part, in the fit or, every ``SET_ASIDE``-th by a hash of its text, in the calibration. Examples of equal
features are one row that weighs as many. The examples of a kind and label weigh ``MOST`` together where they are more, so
that a frequent kind does not drown the others. All texts are scanned and scored whole.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import written

# Fixed patterns, written so that no text takes long: runs are taken whole, since what follows a run can never be found
# by giving back a part of it, and only begin where a run or the rest of one after a match begins.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ["email", "ip", "card", "phone"]

# Generators of candidates beyond these.
NUMBER = r"(?<![0-9A-Za-z])\(?[0-9]{1,5}+\)?(?:[\x20./-]{1,2}\(?[0-9]{1,5}+\)?){1,6}(?![0-9A-Za-z])"
DIGITS = r"(?<![0-9A-Za-z])[0-9]{9,19}+(?![0-9A-Za-z])"
DISGUISED = r"[A-Za-z0-9._%+-]{2,40}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{2,40}(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\.)[A-Za-z]{2,10}"
ACCOUNT = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
ADDED = ["number", "digits", "disguised", "account"]

# Words that introduce personal data, looked for in the NEAR code points before a candidate.
HINTS = r"(?i)\b(?:phone|tel|call|mobile|cell|fax|whatsapp|telefon|t\xe9l\xe9phone|tel\xe9fono|mail|e-mail|contact|reach|card|visa|account|konto|compte|cuenta|iban|ssn|passport|id)\b"
NEAR = 32
MOST, TREES, DEPTH = 4000, 12, 4
PRECISION, SET_ASIDE = 0.9, 4
# Spark looks for splits in a sample where there are more rows than the square of this; and all values of a feature are bins.
BINS = 1 << 12
# Rows of different features that a task of the fit takes.
FIT_ROWS = 100_000
# Longest candidate, for the join of overlapping ones.
REACH = 128


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check: from the right, every second one doubled, its digits summed."""
    turned = F.reverse(digits)
    values = F.transform(F.split(turned, ""), lambda c: F.expr("0") + c.try_cast("int"))
    total = F.aggregate(
        F.transform(
            F.filter(values, lambda v: v.isNotNull()),
            lambda v, i: F.when(i % 2 == 0, v).when(v < 5, 2 * v).otherwise(2 * v - 9),
        ),
        F.lit(0),
        lambda a, v: a + v,
    )
    return total % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def is_card(value: Column) -> Column:
    return F.length(_digits(value)).between(12, 19) & _luhn(_digits(value))


def is_ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("long") <= 255, F.lit(False)))


def is_phone(value: Column) -> Column:
    return F.length(_digits(value)).between(9, 15)


def _base(t: Column) -> dict[str, Column]:
    """Matches of the fixed patterns, not yet held against their rules."""
    return {
        "email": spans.where(F.contains(t, F.lit("@")), spans.matches(t, EMAIL, "email")),
        "ip": spans.where(t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), spans.matches(t, IP, "ip")),
        "card": spans.where(t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), spans.matches(t, CARD, "card")),
        "phone": spans.where(t.rlike(r"\+[0-9]"), spans.matches(t, PHONE, "phone")),
    }


def _kept(kind: str, found: Column) -> Column:
    rules = {"ip": is_ip, "card": is_card, "phone": is_phone}
    return F.filter(found, lambda s: rules[kind](s["text"])) if kind in rules else found


def _with_context(array: Column, t: Column) -> Column:
    """Spans with what the features need of the text beside them."""

    def widen(s: Column) -> Column:
        low = F.greatest(s["start"] - NEAR, F.lit(0))
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["kind"].alias("kind"),
            s["text"].alias("text"),
            F.substring(t, low + 1, s["start"] - low).alias("before"),
            F.substring(t, s["end"] + 1, F.lit(2)).alias("after"),
        )

    return F.transform(array, widen)


def _features() -> dict[str, Column]:
    """How a candidate is written and introduced. Whether it begins with "+", its check digit and its parts' values are
    not among them: these are the rules that label the examples."""
    text = F.col("text")
    digits = _digits(text)
    groups = F.filter(F.split(text, "[^0-9]+"), lambda g: g != "")
    longest = F.aggregate(F.transform(groups, lambda g: F.length(g)), F.lit(0), lambda a, n: F.greatest(a, n))
    shortest = F.aggregate(F.transform(groups, lambda g: F.length(g)), F.lit(99), lambda a, n: F.least(a, n))
    made = {
        "digits": F.length(digits),
        "kinds_of_digits": F.size(F.array_distinct(F.split(digits, ""))),
        "groups": F.size(groups),
        "longest": longest,
        "shortest": F.least(shortest, F.lit(20)),
        "length": F.length(text),
        "letters": F.length(F.regexp_replace(text, "[^A-Za-z]", "")),
        "dots": F.length(F.regexp_replace(text, r"[^.]", "")),
        "dashes": F.length(F.regexp_replace(text, r"[^-]", "")),
        "spaces": F.length(F.regexp_replace(text, r"[^\x20]", "")),
        "brackets": F.length(F.regexp_replace(text, r"[^()\[\]]", "")),
        "hinted": F.col("before").rlike(HINTS).cast("int"),
        "after_word": F.col("before").rlike(r"[A-Za-z\xc0-\xff]\x20?$").cast("int"),
        "after_colon": F.col("before").rlike(r"[:=#]\x20?$").cast("int"),
        "ends_line": F.col("after").rlike(r"^[\n]").cast("int"),
    }
    return {f"f_{k}": v.cast("double") for k, v in made.items()}


def _examples(raw: DataFrame) -> DataFrame:
    """Base matches as labelled examples, 1 where they meet their kind's rule: (kind, label, aside, features, n), a row
    for the ``n`` of equal features. Equal texts of equal features count once."""
    rule = (
        F.when(F.col("kind") == "ip", is_ip(F.col("text")))
        .when(F.col("kind") == "card", is_card(F.col("text")))
        .when(F.col("kind") == "phone", is_phone(F.col("text")))
        .otherwise(F.lit(True))
    )
    # numbers far from any kind's length are no examples of how such data are written
    some = raw.filter(F.col("text").rlike("^.{5,48}$") & (F.length(_digits(F.col("text"))).between(7, 22) | (F.col("kind") == "email")))
    aside = F.pmod(F.xxhash64("text"), F.lit(SET_ASIDE)) == 0
    each = some.select("kind", "text", rule.cast("double").alias("label"), aside.alias("aside"), *[v.alias(k) for k, v in _features().items()]).distinct()
    return each.groupBy("kind", "label", "aside", *_features()).agg(F.count("*").alias("n"))


def fitted(raw: DataFrame):
    """The trees and the score from which candidates are redacted; None where the examples are of one class.

    ``raw`` is a written table of base matches with their context.
    """
    examples = written(_examples(raw), "examples")
    totals = examples.groupBy("kind", "label").agg(F.sum("n").alias("_total"))  # a row for each kind and label
    weight = F.col("n") * F.least(F.lit(1.0), MOST / F.col("_total"))
    examples = examples.join(F.broadcast(totals), ["kind", "label"]).withColumn("weight", weight)
    fit, aside = examples.filter("not aside"), examples.filter("aside")
    if fit.select("label").distinct().count() < 2:
        return None
    pack = VectorAssembler(inputCols=list(_features()), outputCol="features")
    trees = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=BINS)
    # as many tasks as the rows need, in one order: the fit is the same whatever the cluster
    columns = ["label", *_features()]
    dealt = fit.repartitionByRange(1 + fit.count() // FIT_ROWS, *columns).sortWithinPartitions(*columns, "kind")
    model = trees.fit(pack.transform(dealt))
    # twenty steps of the score: how much the examples in each weigh, and how much of that the positive ones
    scored = _scored(aside, model).withColumn("_step", F.floor(F.col("score") * 20).cast("int"))
    steps = {r._step: (r.n, r.good) for r in scored.groupBy("_step").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("good")).collect()}
    threshold = None
    for low in range(20, 9, -1):
        n, good = (sum(v[i] for k, v in steps.items() if k >= low) for i in (0, 1))
        if n and good >= PRECISION * n:
            threshold = low / 20
    return (model, threshold) if threshold is not None else None


def _scored(rows: DataFrame, model) -> DataFrame:
    pack = VectorAssembler(inputCols=list(_features()), outputCol="features")
    out = model.transform(pack.transform(rows))
    return out.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``spans``, an array of (start, end, kind, base) in order of start, for every row.

    Null and empty texts have none; rows of equal key and text have equal results, whatever their key. Candidates that
    overlap a base span go; of overlapping candidates the one of the higher score stays, then the earlier, the longer.
    """
    lean = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    t = F.coalesce(F.col("_text"), F.lit(""))
    number = t.rlike(r"[0-9][\x20()./-]{0,3}[0-9]")
    more = {
        "number": spans.where(number, spans.matches(t, NUMBER, "number")),
        "digits": spans.where(t.rlike("[0-9]{9}"), spans.matches(t, DIGITS, "digits")),
        "disguised": spans.where(t.rlike(r"[\[(]\x20?at\x20?[\])]"), spans.matches(t, DISGUISED, "disguised")),
        "account": spans.where(t.rlike("[A-Z]{2}[0-9]{2}"), spans.matches(t, ACCOUNT, "account")),
    }
    out = lean.withColumn("_hash", F.xxhash64("_text")).withColumns({f"_b_{k}": v for k, v in _base(t).items()})
    out = out.withColumns({f"_m_{k}": v for k, v in more.items()})
    out = out.withColumns(
        {
            "_base": F.concat(*[_kept(k, F.col(f"_b_{k}")) for k in BASE]),
            "_raw": _with_context(F.concat(*[F.col(f"_b_{k}") for k in BASE]), t),
            # the number of digits that any personal number has
            "_more": _with_context(
                F.filter(F.concat(*[F.col(f"_m_{k}") for k in ADDED]), lambda s: F.length(_digits(s["text"])).between(7, 22) | (s["kind"] == "disguised")), t
            ),
        }
    )
    same = ["_key", "_hash"]
    found = written(out.select(*same, "_base", "_raw", "_more"), "found")
    rows = lambda name: found.select(*same, F.explode_outer(name).alias("_s")).filter("_s is not null").select(*same, "_s.*")
    raw = written(rows("_raw").drop(*same), "raw")
    made = fitted(raw)
    shape = lambda s, base: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(base).alias("base"))
    own = F.transform("_base", lambda s: shape(s, True))
    if made is None:
        return found.select(F.col("_key").alias(key), F.array_sort(own).alias("spans"))
    model, threshold = made
    candidates = rows("_more").dropDuplicates([*same, "start", "end"]).withColumns(_features())
    chosen = _scored(candidates, model).filter(F.col("score") >= threshold)
    chosen = written(chosen.select(*same, "start", "end", "kind", "score"), "chosen")
    # overlaps: with a base span, or with a better candidate
    base = rows("_base").select(*same, "start", "end").distinct().withColumn("score", F.lit(2.0))
    rivals = base.unionByName(chosen.select(*same, "start", "end", "score"))
    rivals = rivals.select(*same, *[F.col(c).alias(f"r_{c}") for c in ("start", "end", "score")])
    rank = lambda p: F.struct(F.col(f"{p}score"), -F.col(f"{p}start"), F.col(f"{p}end"))
    over = (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")) & (rank("r_") > rank(""))
    beaten = spans.near(chosen, rivals, same, REACH).filter(over).select(*same, "start", "end").distinct()
    on = [chosen[c].eqNullSafe(beaten[c]) for c in (*same, "start", "end")]
    left = chosen.join(beaten, on, "left_anti")
    linked = left.groupBy(*[F.col(c).alias(f"_l{c}") for c in same]).agg(F.collect_list(F.struct("start", "end", "kind")).alias("_added"))
    out = found.join(linked, F.col("_key").eqNullSafe(F.col("_l_key")) & F.col("_hash").eqNullSafe(F.col("_l_hash")), "left")
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    added = F.transform(F.coalesce("_added", none), lambda s: shape(s, False))
    return out.select(F.col("_key").alias(key), F.array_sort(F.concat(own, added)).alias("spans"))
