"""Tables as pages, entities and relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "id STRING, label STRING, type STRING"
EDGES = "source STRING, target STRING, label STRING"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_pages(docs: DataFrame) -> DataFrame:
    """Each document as one page."""
    return docs.select("doc_id", F.lit(1).alias("page_number"), "text")


def conversation_pages(turns: DataFrame) -> DataFrame:
    """Each conversation as a document, each turn as a page."""
    return turns.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_number"), "text")


def _entity(df: DataFrame, kind: str, key: str, label: Column) -> DataFrame:
    return df.select(
        F.concat(F.lit(f"{kind}_"), F.col(key).cast("string")).alias("id"), label.cast("string").alias("label"), F.lit(kind).alias("type")
    )


def star_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, label, type``: regions, nations, customers, suppliers, parts and orders as entities."""
    t = lambda name: table(spark, sf_dir, name)
    frames = [
        _entity(t("region"), "region", "r_regionkey", F.col("r_name")),
        _entity(t("nation"), "nation", "n_nationkey", F.col("n_name")),
        _entity(t("customer"), "customer", "c_custkey", F.col("c_name")),
        _entity(t("supplier"), "supplier", "s_suppkey", F.col("s_name")),
        _entity(t("part"), "part", "p_partkey", F.col("p_name")),
        _entity(t("orders"), "order", "o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))),
    ]
    return reduce(DataFrame.unionByName, frames)


def _relation(df: DataFrame, a: str, akey: str, name: str, b: str, bkey: str, *order: str) -> DataFrame:
    key = F.concat_ws("/", F.lit(name), *[F.lpad(F.col(c).cast("string"), 12, "0") for c in (akey, bkey, *order)])
    source = F.concat(F.lit(f"{a}_"), F.col(akey).cast("string"))
    target = F.concat(F.lit(f"{b}_"), F.col(bkey).cast("string"))
    return df.select(
        source.alias("source"), target.alias("target"), F.lit(name).alias("type"),
        F.concat_ws(" ", source, F.lit(name), target).alias("evidence_span"), key.alias("ord"),
    )


def star_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source, target, type, evidence_span, ord``: the foreign keys as relations; line items run parallel."""
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem")
    frames = [
        _relation(t("nation"), "nation", "n_nationkey", "in_region", "region", "n_regionkey"),
        _relation(t("customer"), "customer", "c_custkey", "located_in", "nation", "c_nationkey"),
        _relation(t("supplier"), "supplier", "s_suppkey", "located_in", "nation", "s_nationkey"),
        _relation(t("orders"), "customer", "o_custkey", "placed", "order", "o_orderkey"),
        _relation(lines, "order", "l_orderkey", "contains", "part", "l_partkey", "l_linenumber"),
        _relation(lines, "part", "l_partkey", "supplied_by", "supplier", "l_suppkey", "l_orderkey", "l_linenumber"),
    ]
    return reduce(DataFrame.unionByName, frames)


def load_graph(spark: SparkSession, path: str, nodes: str = "", edges: str = "") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from a file with one object ``{"nodes": [...], "edges": [...]}``.

    Further fields of nodes and edges are those that the file has, or, where a DDL of them is given, those.
    """
    if nodes or edges:
        kinds = (", ".join(filter(None, x)) for x in ((NODES, nodes), (EDGES, edges)))
        n, e = (_fields(x) for x in kinds)
        whole = spark.read.schema(f"nodes array<struct<{n}>>, edges array<struct<{e}>>").json(path, multiLine=True)
        return whole.select(F.inline("nodes")), whole.select(F.inline("edges"))
    found = spark.read.json(path, multiLine=True)
    return tuple(_with_declared(found, name, ddl) for name, ddl in (("nodes", NODES), ("edges", EDGES)))


def _with_declared(whole: DataFrame, name: str, ddl: str) -> DataFrame:
    """The rows of one array: the declared fields first, null where the file lacks them, then all others."""
    kind = whole.schema[name].dataType if name in whole.columns else None
    fields = [f.name for f in kind.elementType.fields] if kind is not None and hasattr(kind, "elementType") and hasattr(kind.elementType, "fields") else []
    declared = [x.split()[0] for x in ddl.split(", ")]
    rows = whole.select(F.explode(name).alias("x")) if fields else whole.limit(0).select(F.lit(None).alias("x"))
    first = [(F.col(f"x.`{c}`") if c in fields else F.lit(None)).cast("string").alias(c) for c in declared]
    return rows.select(*first, *[F.col(f"x.`{c}`") for c in fields if c not in declared])


def _fields(ddl: str) -> str:
    return ", ".join(x.strip().replace(" ", ": ", 1) for x in ddl.split(","))
