"""The layout of documents about a group: a header and one document for each of its entries.

No list of a group is ever collected, so the layout is the same for every size; the sink sorts header and entries of a
group next to each other (``sinks.write_documents``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER, ENTRY = 0, 1


def documents(heads: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, part, id, document`` from heads ``(keys, body)`` and entries ``(keys, id, body)``; null fields are kept."""

    def text(body: str):
        return F.to_json(body, {"ignoreNullFields": "false"}).alias("document")

    top = heads.select(*keys, F.lit(HEADER).alias("part"), F.lit("").alias("id"), text("body"))
    return top.unionByName(entries.select(*keys, F.lit(ENTRY).alias("part"), F.col("id").cast("string").alias("id"), text("body")))
