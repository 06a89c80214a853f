"""Records and fields of headed CSV texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A record runs to a line end outside quotes; loops run over characters or quoted stretches, never both at once.
RECORDS = r'([^"\r\n]+(?:"[^"]*"[^"\r\n]*)*|(?:"[^"]*"[^"\r\n]*)+)'
_FIELDS = r',("[^"]*(?:""[^"]*)*"|[^,]*)'
BOUND = ["_places", "present", "_extra_names", "_extra_places"]


def fields_of(line: Column) -> Column:
    """Fields of one CSV record; the comma in front makes every field, also an empty one, match once."""

    def unquoted(f: Column) -> Column:
        inner = F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))
        return F.when(f.startswith('"') & f.endswith('"') & (F.length(f) >= 2), inner).otherwise(f)

    quoted = F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELDS), F.lit(1)), unquoted)
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, ",", -1))


def bound_header(headers: DataFrame, columns: list[str]) -> DataFrame:
    """Where the ``columns`` and all others are in the fields ``_header``, worked out once per file; of repeated headers the
    last one counts."""
    backwards = F.reverse("_header")
    found = [F.array_position(backwards, c) for c in columns]
    extra_names = F.array_distinct(F.array_except("_header", F.lit(columns)))
    return headers.withColumns(
        {
            "_places": F.array(*[F.when(p > 0, F.size("_header") - p).cast("int") for p in found]),
            "present": F.array_intersect(F.lit(columns), "_header"),
            "_extra_names": extra_names,
            "_extra_places": F.transform(extra_names, lambda n: (F.array_position(F.col("_header"), n) - 1).cast("int")),
        }
    )


def named_fields(lines: DataFrame, columns: list[str]) -> DataFrame:
    """The fields of ``_line`` by the names of its bound header, and ``extras``."""
    rows = lines.withColumn("_row", fields_of(F.col("_line")))
    named = {c: F.get("_row", F.get("_places", F.lit(i))) for i, c in enumerate(columns)}
    extra_values = F.transform("_extra_places", lambda p: F.get(F.col("_row"), p))
    return rows.withColumns(named).withColumn("extras", F.map_from_arrays("_extra_names", extra_values))
