"""Nodes and edges: building, collapsing, filtering, validating."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP = ("id", "label", "type")


def nodes_of(entities: DataFrame) -> DataFrame:
    """Entities as nodes: a missing label is the id, a missing type Unknown; other columns are carried."""
    label = F.coalesce("label", "id") if "label" in entities.columns else F.col("id")
    kind = F.coalesce("type", F.lit("Unknown")) if "type" in entities.columns else F.lit("Unknown")
    rest = [c for c in entities.columns if c not in KEEP]
    return entities.select("id", label.alias("label"), kind.alias("type"), *rest)


def edges_of(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations between known entities as edges, self-loops left out, parallel edges kept.

    The relation's type is the edge's label unless the relation has a label of its own.
    """
    ids = entities.select("id")
    kept = relations.where("source <> target")
    for end in ("source", "target"):
        kept = kept.join(ids.withColumnRenamed("id", end), end, "left_semi")
    kind = F.coalesce("type", F.lit("related_to"))
    label = F.coalesce("label", kind) if "label" in relations.columns else kind
    rest = [c for c in relations.columns if c not in ("source", "target", "type", "label")]
    return kept.select("source", "target", label.alias("label"), *rest)


def build(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    return nodes_of(entities), edges_of(entities, relations)


def collapse(edges: DataFrame, order: str = "ord") -> DataFrame:
    """``source, target, label``: one edge for each pair, the label that came last."""
    label = F.max_by(F.coalesce("label", F.lit("")), order) if order in edges.columns else F.max(F.coalesce("label", F.lit("")))
    return edges.groupBy("source", "target").agg(label.alias("label"))


def all_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, label, type`` of the nodes and of the ends that no node has."""
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct()
    new = ends.join(nodes.select("id"), "id", "left_anti")
    added = new.select("id", F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("type"))
    return nodes.select(*KEEP).unionByName(added)


def between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both ends of which are among the nodes."""
    ids = nodes.select("id")
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return edges


def filter_types(nodes: DataFrame, edges: DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of the types, and edges between them; a missing type never matches."""
    kept = nodes.where(F.col("type").isin(*types)) if types else nodes.limit(0)
    return kept, between(edges, kept)


def view_types(nodes: DataFrame, edges: DataFrame, types: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """As the interactive view filters: no types means all, a missing type is Default."""
    if not types:
        return nodes, between(edges, nodes)
    kept = nodes.where(F.coalesce("type", F.lit("Default")).isin(*types))
    return kept, between(edges, kept)


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``kind, item, problem``: missing ids and labels, repeated ids, edges with unknown ends."""
    row = lambda kind, item, problem: (F.lit(kind).alias("kind"), item.cast("string").alias("item"), F.lit(problem).alias("problem"))
    out = nodes.where("id is null").select(*row("node", F.lit(None), "id is missing"))
    out = out.unionByName(nodes.where("label is null").select(*row("node", F.col("id"), "label is missing")))
    twice = nodes.where("id is not null").groupBy("id").count().where("count > 1")
    out = out.unionByName(twice.select(*row("node", F.col("id"), "id is repeated")))
    for end in ("source", "target"):
        lost = edges.join(nodes.select(F.col("id").alias(end)), end, "left_anti")
        out = out.unionByName(lost.select(*row("edge", F.col(end), f"{end} is unknown")))
    return out


def dangling(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations with an end that no node has."""
    source, target = (nodes.select(F.col("id").alias(end)) for end in ("source", "target"))
    no_source = relations.join(source, "source", "left_anti")
    no_target = relations.join(source, "source", "left_semi").join(target, "target", "left_anti")
    return no_source.select(*relations.columns).unionByName(no_target.select(*relations.columns))
