"""Entities and relations from generated text that marks triplets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import evidence, strip

MARKED = r"(?s)<triplet>(.*?)</triplet>"
MARKS = r"<subj>|<obj>"
KIND = "Concept"


def parse_triplets(texts: DataFrame, *key: str) -> DataFrame:
    """``*key, pos, subject, relation, object`` of well-formed triplets, in order.

    A triplet has three parts between marks, none blank; which mark stands where isn't checked.
    """
    found = texts.select(*key, F.posexplode(F.regexp_extract_all("generated_text", F.lit(MARKED), 1)).alias("pos", "t"))
    parts = found.select(*key, "pos", F.transform(F.split("t", MARKS, -1), strip).alias("p"))
    good = parts.where((F.size("p") == 3) & F.forall("p", lambda x: x != ""))
    return good.select(*key, "pos", F.get("p", 0).alias("subject"), F.get("p", 1).alias("relation"), F.get("p", 2).alias("object"))


def triplet_entities(texts: DataFrame, *key: str) -> DataFrame:
    """``*key, id, label, type``: labels numbered by first appearance within each text, subject before object."""
    ends = parse_triplets(texts, *key).select(
        *key,
        F.explode(
            F.array(
                F.struct((2 * F.col("pos")).alias("ord"), F.col("subject").alias("label")),
                F.struct((2 * F.col("pos") + 1).alias("ord"), F.col("object").alias("label")),
            )
        ).alias("e"),
    )
    first = ends.groupBy(*key, F.col("e.label").alias("label")).agg(F.min("e.ord").alias("ord"))
    number = F.row_number().over(Window.partitionBy(*key).orderBy("ord")) - 1
    return first.select(*key, F.concat(F.lit("e"), number.cast("string")).alias("id"), "label", F.lit(KIND).alias("type"))


def triplet_relations(texts: DataFrame, *key: str) -> DataFrame:
    """``*key, pos, source, target, type, evidence_span``: repeats and self-loops stay."""
    triplets = parse_triplets(texts, *key)
    ids = triplet_entities(texts, *key)
    source = ids.select(*key, F.col("label").alias("subject"), F.col("id").alias("source"))
    target = ids.select(*key, F.col("label").alias("object"), F.col("id").alias("target"))
    joined = triplets.join(source, [*key, "subject"]).join(target, [*key, "object"])
    return joined.select(
        *key,
        "pos",
        "source",
        "target",
        F.col("relation").alias("type"),
        evidence(F.col("subject"), F.col("relation"), F.col("object")).alias("evidence_span"),
    )
