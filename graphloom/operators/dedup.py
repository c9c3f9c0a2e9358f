"""Merging of entities that mean the same, and of the relations between them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import strip
from graphloom.operators.similarity import clusters, embed_labels
from graphloom.session import materialize


def canonical(entities: DataFrame, by: str = "cluster_id", order: str = "ord") -> DataFrame:
    """One entity of each group: the longest label, then the smallest, then the first."""
    best = Window.partitionBy(by).orderBy(F.length("label").desc(), "label", order)
    return entities.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")


def entity_mapping(entities: DataFrame, labels: DataFrame) -> DataFrame:
    """``old_id, canonical_id`` from ``id, label, ord`` and ``id, cluster_id``.

    Only the canonical row of each cluster is found by aggregation; no task holds a cluster. As in
    ``canonical``, a null label stands behind all others.
    """
    placed = entities.join(labels, "id")
    best = placed.groupBy("cluster_id").agg(
        F.min_by("id", F.struct(F.isnull("label").alias("none"), (-F.length("label")).alias("n"), "label", "ord")).alias("canonical_id")
    )
    return placed.join(best, "cluster_id").select(F.col("id").alias("old_id"), "canonical_id")


def remap(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Ends replaced by their canonical ids; unmapped ends stay."""
    out = relations
    for end in ("source", "target"):
        to = mapping.select(F.col("old_id").alias(end), F.col("canonical_id").alias("__to"))
        out = out.join(to, end, "left").withColumn(end, F.coalesce("__to", end)).drop("__to")
    return out.select(*relations.columns)


def distinct_relations(relations: DataFrame, order: str = "ord") -> DataFrame:
    """The first relation of each (source, target, type)."""
    rest = [c for c in relations.columns if c not in ("source", "target", "type")]
    first = relations.groupBy("source", "target", "type").agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("r"))
    return first.select("source", "target", "type", *[F.col(f"r.{c}").alias(c) for c in rest]).select(*relations.columns)


def deduplicate(
    entities: DataFrame, relations: DataFrame, embedder: Callable, threshold: float = 0.85, linkage: str = "average",
    block_by_type: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Canonical entities, remapped distinct relations, and ``old_id, canonical_id``.

    Entities (``id, label, type, ord, ...``) with blank labels stay by themselves. Without entities the
    relations come back unchanged. ``block_by_type`` keeps entities of different types apart.
    """
    entities = materialize(entities, "entities")
    empty = not entities.limit(1).count()
    label = strip(F.col("label"))
    vectors = materialize(embed_labels(entities, embedder), "label-vectors")
    named = clusters(vectors.select(F.col("label").alias("id"), "embedding"), threshold, linkage)
    to = named.select(F.col("id").alias("__label"), F.col("cluster_id").alias("__cluster"))
    kind = F.coalesce("type", F.lit("")) if block_by_type else F.lit("")
    cluster = F.coalesce(F.concat(F.lit("c/"), kind, F.lit("/"), F.col("__cluster")), F.concat(F.lit("e/"), F.col("id")))
    labels = entities.withColumn("__label", label).join(to, "__label", "left").select("id", cluster.alias("cluster_id"))
    labels = materialize(labels, "labels")
    mapping = materialize(entity_mapping(entities, labels), "mapping")
    kept = entities.join(mapping.select(F.col("canonical_id").alias("id")).distinct(), "id", "left_semi")
    if empty:
        return kept, relations, mapping
    return kept, distinct_relations(remap(relations, mapping)), mapping


def statistics(mapping: DataFrame, relations_before: DataFrame, relations_after: DataFrame) -> DataFrame:
    """One row of counts before and after, their reduction, and the average cluster size."""
    both = mapping.agg(F.count("*").alias("original_entities"), F.countDistinct("canonical_id").alias("deduplicated_entities"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    both = both.join(one(relations_before, "original_relations"), how="cross")
    both = both.join(one(relations_after, "deduplicated_relations"), how="cross")
    n, m = F.col("original_entities"), F.col("deduplicated_entities")
    return both.select(
        "*",
        (n - m).alias("entities_removed"),
        F.round(F.when(n > 0, (n - m) / n * 100).otherwise(0.0), 6).alias("reduction_percent"),
        F.round(F.when(m > 0, n / m).otherwise(1.0), 6).alias("avg_cluster_size"),
    )


def violations(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``kind, item, problem``: entities without id or label, relations with unknown ends."""
    out = None
    for name in ("id", "label"):
        found = entities.where(F.col(name).isNull()).select(
            F.lit("entity").alias("kind"), F.col("id").cast("string").alias("item"), F.lit(f"{name} is missing").alias("problem")
        )
        out = found if out is None else out.unionByName(found)
    for end in ("source", "target"):
        lost = relations.join(entities.select(F.col("id").alias(end)), end, "left_anti")
        out = out.unionByName(
            lost.select(F.lit("relation").alias("kind"), F.col(end).alias("item"), F.lit(f"{end} is unknown").alias("problem"))
        )
    return out
