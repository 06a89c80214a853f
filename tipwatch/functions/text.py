"""Expressions over log text: redaction, crash markers, line excerpts, names and versions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipwatch.sources import cut

# ---- Fixed values: redaction rules, in the order they apply: (name, pattern, text kept in front of the marker) ----
SCRUB_RULES = [
    ("pem-private-key", r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----", ""),
    ("ssh-public-key", r"(?U)\bssh-(?:rsa|ed25519|dss|ecdsa-[a-z0-9-]+)\s+[A-Za-z0-9+/=]{40,}", ""),
    ("jwt", r"(?U)\beyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", ""),
    ("github-token", r"(?U)\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}\b", ""),
    ("aws-access-key-id", r"(?U)\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", ""),
    ("bearer-token", r"(?iU)\b(Bearer\s+)([A-Za-z0-9._\-+/=]{8,})", "$1"),
    (
        "credential-kv",
        r"(?iU)(?=[pasc])\b((?:password|passwd|secret|api[_-]?key|access[_-]?key|private[_-]?key|session[_-]?token"
        r"|auth[_-]?token|client[_-]?secret)\s*[:=]\s*['\"]?)[^\s'\"]{6,}",
        "$1",
    ),
]
# Plain text without which a rule cannot match (rules ignoring case: in upper case). Most texts stop here, long before
# a pattern runs. A marker left by an earlier rule cannot complete a match, so the original text is what to look at.
_NEEDED = {
    "pem-private-key": ["PRIVATE KEY-----"],
    "ssh-public-key": ["ssh-"],
    "jwt": [".eyJ"],
    "github-token": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "aws-access-key-id": ["AKIA", "ASIA"],
    "bearer-token": ["BEARER"],
    "credential-kv": ["PASSW", "SECRET", "KEY", "TOKEN"],
}
_ANY_CASE = {"bearer-token", "credential-kv"}
REDACTION = "[REDACTED:{kind}]"

# ---- Fixed values: markers looked for in a scrubbed console, first listed wins; plain case-sensitive text ----
PANIC_MARKERS = [
    "Kernel panic - not syncing",
    "Oops: ",
    "BUG: ",
    "Call Trace:",
    "general protection fault",
    "Unable to handle kernel",
    "double fault",
    "watchdog: BUG: soft lockup",
    "rcu_sched detected stalls",
    "page fault in interrupt",
]

# ---- Fixed values: patterns that abort a running test when a console line matches ----
CRASH_PATTERNS = [
    r"Kernel panic - not syncing",
    r"\bOops\s*:",
    r"\bBUG\s*:",
    r"general protection fault",
    r"unable to handle kernel paging request",
    r"double fault",
    r"Internal error\s*:",
    r"watchdog: BUG: soft lockup",
    r"soft lockup - CPU#",
    r"rcu_(?:sched|preempt|bh) detected stalls",
    r"INFO: task .* blocked for more than",
]

SUCCESS_LINE = "Test execution completed: SUCCESS"
EXCERPT_LINES = 3
EXCERPT_CHARS = 200
ALERT_CHARS = 300


def may_contain(text: Column, capitals: Column, words: list[str]) -> Column:
    """False only if no word occurs in any case. ``capitals`` is ``upper(text)``, the words are in upper case.

    Upper case makes the long s and the dotless i plain; the dotted capital I and the Kelvin sign have no plain upper
    case though patterns take them for i and k, so texts with these pass.
    """
    return any_of([capitals.contains(w) for w in words]) | text.contains("\u0130") | text.contains("\u212a")


def scrub(df: DataFrame, text: str = "text", counts: str = "redactions") -> DataFrame:
    """Redact ``text`` rule by rule and add ``counts``, a map of the rules that hit to how often.

    Each rule counts on the text the rules before it left. Whole texts stay on one row: keys span lines.
    """
    fields = df.columns
    work = df.withColumns({"_text0": F.col(text), "_capitals": F.upper(text)})
    plain = F.col("_text0")
    possible = {
        f"_may{i}": may_contain(plain, F.col("_capitals"), _NEEDED[kind])
        if kind in _ANY_CASE
        else any_of([plain.contains(w) for w in _NEEDED[kind]])
        for i, (kind, _, _) in enumerate(SCRUB_RULES)
    }
    work = work.withColumns(possible).drop("_capitals")
    hits = []
    for i, (kind, pattern, keep) in enumerate(SCRUB_RULES):
        marker = REDACTION.format(kind=kind)
        before, after = F.col(f"_text{i}"), F.col(f"_text{i + 1}")
        work = work.withColumn(
            f"_text{i + 1}", F.when(F.col(f"_may{i}"), F.regexp_replace(before, pattern, keep + marker)).otherwise(before)
        )
        # an unchanged text was not hit, unless what was replaced is the marker itself
        hit = F.col(f"_may{i}") & ((before != after) | before.contains(marker))
        count = F.when(hit, F.regexp_count(before, F.lit(pattern))).otherwise(0)
        hits.append(F.struct(F.lit(kind).alias("key"), count.alias("value")))
    found = F.map_from_entries(F.filter(F.array(*hits), lambda e: e["value"] > 0))
    columns = [F.col(f"_text{len(SCRUB_RULES)}").alias(c) if c == text else F.col(c) for c in fields]
    return work.select(*columns, found.alias(counts))


# What a rule that may reach over a line end has at the end of a line, and lines that may stand between that and the rest.
_KEY_BEGIN, _KEY_END = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", r"-----END [A-Z0-9 ]*PRIVATE KEY-----"
_HANGING = (
    r"(?iU)(?:ssh-(?:rsa|ed25519|dss|ecdsa-[a-z0-9-]+)|bearer|(?:password|passwd|secret|api[_-]?key|access[_-]?key|private[_-]?key"
    r"|session[_-]?token|auth[_-]?token|client[_-]?secret)(?:\s*[:=]\s*['\"]?)?)\s*$"
)
_BETWEEN = r"(?U)^\s*[:=]?\s*['\"]?\s*$"


def scrub_lines(lines: DataFrame, counts: str = "redactions") -> DataFrame:
    """``scrub`` of files that are cut over many tasks, from ``(path, block, line, value)`` as ``sources.cut`` reads them.

    Lines are redacted one by one, but for those that a key block or the two halves of a hit hold together: these are one
    ``value``, wherever the file is cut.
    """
    value = F.col("value")
    key = any_of([value.contains(w) for w in _NEEDED["pem-private-key"]])
    opens, closes = key & value.rlike(f"(?s){_KEY_BEGIN}(?!.*{_KEY_END})"), key & value.rlike(_KEY_END)
    hangs = may_contain(value, F.upper(value), ["SSH-", *_NEEDED["bearer-token"], *_NEEDED["credential-kv"]]) & value.rlike(_HANGING)
    together = cut.stretches(lines, [(opens, closes), (hangs, ~value.rlike(_BETWEEN))])
    return scrub(together, "value", counts)


def scrub_bytes(df: DataFrame, data: str, counts: str = "redactions") -> DataFrame:
    """Redact a binary column: undecodable bytes become the replacement character first."""
    readable = df.withColumn(data, F.make_valid_utf8(F.col(data).cast("string")))
    return scrub(readable, data, counts).withColumn(data, F.encode(data, "UTF-8"))


def redaction_totals(scrubbed: DataFrame, counts: str = "redactions") -> DataFrame:
    """Hits per rule over all rows, rules without any left out. Sums first; only their one row is turned."""
    kinds = [kind for kind, _, _ in SCRUB_RULES]
    sums = scrubbed.agg(*[F.sum(F.try_element_at(counts, F.lit(k))).alias(k) for k in kinds])
    return sums.unpivot([], kinds, "rule", "hits").filter("hits > 0")


def panic_marker(text: Column) -> Column:
    """First of the markers (in list order) contained in ``text``; null if none."""
    return F.coalesce(*[F.when(text.contains(m), F.lit(m)) for m in PANIC_MARKERS])


def is_crash(message: Column) -> Column:
    """True if a console message matches any crash pattern; a missing message never does."""
    return F.coalesce(message.rlike("(?dU)" + "|".join(CRASH_PATTERNS)), F.lit(False))


# Every character that ends a line ends one here; \r\n makes an extra empty line, which no search finds.
_LINE_ENDS = r"[\n\r\x0B\f\x1C\x1D\x1E\u0085\u2028\u2029]"


def split_lines(text: Column) -> Column:
    return F.split(text, _LINE_ENDS)


def lines_within(line: Column) -> Column:
    """The lines of what a reader that knows line feeds only took for one."""
    return F.when(line.rlike(_LINE_ENDS), split_lines(line)).otherwise(F.array(line))


def _strip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


# What makes a line a warning or an error.
_WARNING, _ERROR = r"warning|warn\b", r"error|failed"


def _tells(line: Column, pattern: str, words: list[str]) -> Column:
    """Whether a line matches and is no shell trace. A plain search spares most lines the pattern."""
    return may_contain(line, F.upper(line), words) & line.rlike("(?iU)" + pattern) & ~line.startswith("+")


def is_warning(line: Column) -> Column:
    return _tells(line, _WARNING, ["WARN"])


def is_error(line: Column) -> Column:
    return _tells(line, _ERROR, ["ERROR", "FAILED"])


def excerpt(line: Column) -> Column:
    """A line as it is shown: trimmed and cut."""
    return F.substring(_strip(line), 1, EXCERPT_CHARS)


def _first(lines: Column, tells: Callable[[Column], Column]) -> Column:
    return F.transform(F.slice(F.filter(lines, tells), 1, EXCERPT_LINES), excerpt)


def warning_lines(lines: Column) -> Column:
    return _first(lines, is_warning)


def error_lines(lines: Column) -> Column:
    return _first(lines, is_error)


def is_failure(line: Column) -> Column:
    return line.contains("FAILED") | line.contains("✗ Test result")


def failure_text(line: Column) -> Column:
    """A container log line without the timestamp and source in front."""
    return F.regexp_replace(_strip(line), r"(?s)^.*?\[CONTAINER\] ", "")


def failure_lines(lines: Column) -> Column:
    """Container log lines that report a failure, without the timestamp and source in front."""
    return F.transform(F.filter(lines, is_failure), failure_text)


def test_of_log(text: Column) -> Column:
    """Test name from the first line that names an input folder; null if there is none."""
    line = F.regexp_extract(text, r"(?d)(?<![^\n])((?=[^\n]*test_)[^\n]*/input/[^\n]*)", 1)
    named = F.regexp_extract(line, r"test_([^/]+)/input/", 1)
    loose = F.regexp_extract(line, r"test_([^/]*?)(?:/|test_|$)", 1)
    found = F.coalesce(F.nullif(named, F.lit("")), loose)
    return F.when(text.contains("/input/") & (line != ""), found)


def first_alert_text(message: Column) -> Column:
    return F.substring(_strip(message), 1, ALERT_CHARS)


def kernel_base(version: Column) -> Column:
    """Kernel version without the architecture at its end."""
    return F.regexp_replace(version, r"\.(x86_64|aarch64|arm64)\z", "")


# Ranks of a version key, in the order of ``sort -V`` where a run of characters that are no digits may go on: a tilde, a
# zero before a tilde, the end, another zero, a number, and then letters before all other characters.
_TILDE, _ZERO_TILDE, _END, _ZERO, _NUMBER, _LETTER, _OTHER = 0, 1, 2, 3, 4, 10, 300


def _version_ranks(name: Column) -> Column:
    """Ranks of the characters and numbers of a name; comparing the arrays compares the names as versions."""
    pieces = F.regexp_extract_all(name, F.lit(r"([0-9]+|[^0-9])"), F.lit(1))

    def rank(piece: Column, place: Column) -> Column:
        digits = F.regexp_replace(piece, r"^0+", "")
        following = F.get(pieces, place + 1)
        zero = F.when(following.isNull(), F.array().cast("array<int>")).otherwise(F.array(F.when(following == "~", _ZERO_TILDE).otherwise(_ZERO)))
        number = F.concat(F.array(F.lit(_NUMBER), F.length(digits)), F.transform(F.split(digits, ""), lambda d: d.cast("int")))
        code = F.ascii(piece)
        other = F.when(piece == "~", _TILDE).when(piece.rlike("[A-Za-z]"), code + _LETTER).otherwise(code + _OTHER)
        return F.when(~piece.rlike("[0-9]"), F.array(other)).when(digits == "", zero).otherwise(number)

    return F.concat(F.flatten(F.transform(pieces, rank)), F.array(F.lit(_END)))


def version_key(name: Column) -> Column:
    """Sort key in the order of ``sort -V``: numbers by their value (6.9 before 6.10), a tilde before the end
    (6.1~rc1 before 6.1), letters before other characters (6.1a before 6.1-1), names with a leading dot first, endings
    such as ``.rpm`` only where all before them is equal, and names of equal versions (6.01 and 6.1) by their text."""
    leading = F.when(name == "", 0).when(name == ".", 1).when(name == "..", 2).when(name.startswith("."), 3).otherwise(4)
    stem = F.regexp_extract(name, r"(?s)\A(.*?)(?:\.[A-Za-z~][A-Za-z0-9~]*)*\z", 1)
    key = F.struct(leading.alias("leading"), _version_ranks(stem).alias("stem"), _version_ranks(name).alias("whole"), name.alias("text"))
    return F.when(name.isNotNull(), key)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
