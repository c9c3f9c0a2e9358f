"""Search and display of entities and relations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How a missing value reads in a search.
MISSING = "nan"


def matching(df: DataFrame, query: str, literal: bool = False) -> DataFrame:
    """Rows any column of which contains the pattern, case aside; all rows for an empty query."""
    if not query:
        return df
    pattern = "(?i)" + (re.escape(query) if literal else query)
    texts = F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(MISSING)) for c in df.columns])
    return df.where(F.exists(texts, lambda x: x.rlike(pattern)))


def relations_display(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """``Source, Relationship, Target, Evidence``: labels of the ends, or their ids where there is none."""
    named = relations
    for end in ("source", "target"):
        label = entities.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
        named = named.join(label, end, "left")
    return named.select(
        F.coalesce("source_label", "source").alias("Source"),
        F.coalesce("type", F.lit("")).alias("Relationship"),
        F.coalesce("target_label", "target").alias("Target"),
        F.coalesce("evidence_span", F.lit("")).alias("Evidence"),
    )


def shown(df: DataFrame, query: str, literal: bool = False) -> DataFrame:
    """``shown, total``: rows that match, of all."""
    hit = matching(df, query, literal).agg(F.count("*").alias("shown"))
    return hit.join(df.agg(F.count("*").alias("total")), how="cross")
