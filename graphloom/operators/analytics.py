"""Statistics of multigraphs and of their collapsed digraphs, rankings, and insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import percent
from graphloom.operators.components import connected_components
from graphloom.operators.graph import all_nodes, collapse
from graphloom.session import materialize

#: The insights' sentences, in the order in which they come.
INSIGHTS = {
    "size": "**%s unique entities** and **%s relationships** extracted from this document.",
    "best": "**%s** (%s) is the most connected entity with **%s direct relationships**.",
    "dense": "The graph is **highly interconnected** — entities have rich, complex interdependencies throughout the document.",
    "moderate": "The graph has **moderate connectivity**, indicating a well-structured document with clear topic clusters.",
    "sparse": "The graph is **sparsely connected**, typical of broad documents covering many independent topics.",
    "components": "**%s distinct knowledge clusters** detected — consider cross-referencing these topic groups.",
    "type": "**%s** is the most prevalent entity type, representing **%s%%** of all entities.",
    "degree": "Entities have an average of **%s connections** each.",
    "isolated": "**%s isolated entities** detected — these may represent standalone concepts worth reviewing manually.",
}


def type_histogram(df: DataFrame, column: str, missing: str) -> DataFrame:
    """``type, count``: nodes miss as Unknown, edges as unknown."""
    return df.groupBy(F.coalesce(column, F.lit(missing)).alias("type")).agg(F.count("*").alias("count"))


def distinct_types(nodes: DataFrame, missing: str = "Unknown") -> DataFrame:
    """``ord, type``: the types that occur, by name."""
    kinds = nodes.select(F.coalesce("type", F.lit(missing)).alias("type")).distinct()
    # One row for each type.
    return kinds.select((F.row_number().over(Window.orderBy("type")) - 1).cast("bigint").alias("ord"), "type")


def _as_map(histogram: DataFrame, name: str) -> DataFrame:
    entries = F.sort_array(F.collect_list(F.struct("type", "count")))
    return histogram.agg(F.map_from_entries(entries).alias(name))


def density(n: Column, e: Column) -> Column:
    return F.when(n > 1, e / (n * (n - 1))).otherwise(F.lit(0.0))


def average_degree(n: Column, e: Column) -> Column:
    return F.when(n > 0, 2 * e / n).otherwise(F.lit(0.0))


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id")))
    return nodes.join(ends, "id", "left_anti")


def _beside(*frames: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, how="cross")
    return out


def graph_scalars(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``num_nodes, num_edges, density, avg_degree, isolated_nodes`` of the multigraph, unrounded."""
    # Each edge is one end's out-degree, and an edge's ends are nodes: one table of degrees has all the figures.
    ends = degrees(edges)
    found = nodes.select("id").join(ends, "id", "left")
    counts = _beside(
        found.agg(F.count("*").alias("num_nodes"), F.count_if(F.col("out_degree").isNull()).alias("isolated_nodes")),
        edges.agg(F.count("*").alias("num_edges")),
    )
    n, e = F.col("num_nodes"), F.col("num_edges")
    return counts.select("num_nodes", "num_edges", density(n, e).alias("density"), average_degree(n, e).alias("avg_degree"), "isolated_nodes")


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the scalars and ``node_types, edge_types`` as maps."""
    return _beside(
        graph_scalars(nodes, edges),
        _as_map(type_histogram(nodes, "type", "Unknown"), "node_types"),
        _as_map(type_histogram(edges, "label", "unknown"), "edge_types"),
    )


def degrees(edges: DataFrame) -> DataFrame:
    """``id, in_degree, out_degree`` of all ends of edges, each edge counted."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
    )).alias("x"))
    return ends.groupBy(F.col("x.id").alias("id")).agg(
        F.sum("x.i").cast("bigint").alias("in_degree"), F.sum("x.o").cast("bigint").alias("out_degree")
    )


def node_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, label, type, in_degree, out_degree, total_degree`` of the nodes, 0 where there is no edge."""
    joined = nodes.select("id", "label", "type").join(degrees(edges), "id", "left")
    i, o = F.coalesce("in_degree", F.lit(0)), F.coalesce("out_degree", F.lit(0))
    return joined.select("id", "label", "type", i.alias("in_degree"), o.alias("out_degree"), (i + o).alias("total_degree"))


def top(df: DataFrame, column: str, k: int, tie: str = "id") -> DataFrame:
    """The k rows with the largest values, the smallest tie first among equals."""
    return df.orderBy(F.col(column).desc(), tie).limit(k)


def top_in_degree(edges: DataFrame, k: int = 10) -> DataFrame:
    return top(degrees(edges).where("in_degree > 0").select("id", "in_degree"), "in_degree", k)


def top_out_degree(edges: DataFrame, k: int = 10) -> DataFrame:
    return top(degrees(edges).where("out_degree > 0").select("id", "out_degree"), "out_degree", k)


def top_entities(nodes: DataFrame, edges: DataFrame, k: int = 15) -> DataFrame:
    """``id, label, type, degree`` of the collapsed digraph's k nodes with most edges."""
    one = collapse(edges)
    ranked = node_degrees(all_nodes(nodes, one), one)
    named = ranked.select("id", F.coalesce("label", "id").alias("label"), F.coalesce("type", F.lit("Unknown")).alias("type"), F.col("total_degree").alias("degree"))
    return top(named, "degree", k)


def degree_centrality(nodes: DataFrame, edges: DataFrame, k: int | None = 10) -> DataFrame:
    """``id, label, centrality``: degree over n - 1, none for fewer than two nodes; all nodes if k is None."""
    one = collapse(edges)
    every = all_nodes(nodes, one)
    n = every.agg(F.count("*").alias("n"))
    scored = node_degrees(every, one).join(n, how="cross").where("n > 1")
    named = scored.select("id", F.coalesce("label", "id").alias("label"), F.round(F.col("total_degree") / (F.col("n") - 1), 4).alias("centrality"), "total_degree")
    ranked = named.orderBy(F.col("total_degree").desc(), "id")
    return (ranked.limit(k) if k else named).drop("total_degree")


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component``: direction aside; a node without edges is a component of its own."""
    found = connected_components(edges, "source", "target")
    every = all_nodes(nodes, edges)
    return every.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("size"))


def analytics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of the collapsed digraph's figures; zeros for a graph without nodes.

    Relation types are counted on the edges as they came. Rankings are arrays of structs.
    """
    one = materialize(collapse(edges), "digraph")
    # Each figure but the components comes from one table of nodes and their degrees.
    placed = node_degrees(all_nodes(nodes, one), one).select(
        "id", F.coalesce("label", "id").alias("label"), F.coalesce("type", F.lit("Unknown")).alias("type"), F.col("total_degree").alias("degree")
    )
    placed = materialize(placed, "degrees")
    joined = connected_components(one, "source", "target")
    row = F.struct((-F.col("degree")).alias("r"), "id", "label", "degree", "type")
    counts = _beside(
        placed.agg(F.count("*").alias("num_nodes"), F.count_if(F.col("degree") == 0).alias("isolated_nodes")),
        one.agg(F.count("*").alias("num_edges")),
        joined.agg(F.countDistinct("component").alias("joined"), F.count("*").alias("within")),
        _as_map(type_histogram(nodes, "type", "Unknown"), "entity_types"),
        _as_map(type_histogram(edges, "label", "unknown"), "relation_types"),
        top(placed, "degree", 15).agg(F.sort_array(F.collect_list(row)).alias("t")),
    )
    n, e = F.col("num_nodes"), F.col("num_edges")
    central = lambda x: F.struct(x["label"].alias("label"), F.round(x["degree"] / (n - 1), 4).alias("centrality"))
    return counts.select(
        "num_nodes", "num_edges",
        F.round(density(n, e), 4).alias("density"), F.round(average_degree(n, e), 2).alias("avg_degree"),
        # A node that no edge names is a component of its own.
        (n - F.col("within") + F.col("joined")).alias("num_components"), "isolated_nodes", "entity_types", "relation_types",
        F.transform("t", lambda x: F.struct(x["label"].alias("label"), x["degree"].alias("degree"), x["type"].alias("type"))).alias("top_entities_by_degree"),
        F.when(n > 1, F.transform(F.slice("t", 1, 10), central)).otherwise(F.array()).alias("top_by_centrality"),
    )


def insights(figures: DataFrame) -> DataFrame:
    """``ord, insight`` from the one row of ``analytics``."""
    n, d = F.col("num_nodes"), F.col("density")
    say = lambda name, *values: F.format_string(INSIGHTS[name], *values)
    best = F.get("top_entities_by_degree", 0)
    # Of equal counts the first type by name wins.
    ranked = F.sort_array(F.transform(F.map_entries("entity_types"), lambda x: F.struct((-x["value"]).alias("r"), x["key"].alias("k"), x["value"].alias("v"))))
    first = F.get(ranked, 0)
    lines = [
        F.when(n > 0, say("size", n, F.col("num_edges"))),
        F.when(best.isNotNull(), say("best", best["label"], best["type"], best["degree"])),
        F.when(d > 0.3, F.lit(INSIGHTS["dense"])).when(d > 0.1, F.lit(INSIGHTS["moderate"])).when(d > 0, F.lit(INSIGHTS["sparse"])),
        F.when(F.col("num_components") > 1, say("components", F.col("num_components"))),
        F.when(first.isNotNull(), say("type", first["k"], percent(first["v"], n))),
        F.when(F.col("avg_degree") > 0, say("degree", F.col("avg_degree"))),
        F.when(F.col("isolated_nodes") > 0, say("isolated", F.col("isolated_nodes"))),
    ]
    kept = F.filter(F.array(*lines), lambda x: x.isNotNull())
    return figures.select(F.posexplode(kept).alias("ord", "insight"))


def text_totals(pages: DataFrame) -> DataFrame:
    """``doc_id, num_pages, total_characters, full_text``: pages joined by a blank line, in order."""
    rows = F.sort_array(F.collect_list(F.struct("page_number", "text")))
    whole = pages.groupBy("doc_id").agg(F.count("*").alias("num_pages"), F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n").alias("full_text"))
    return whole.select("doc_id", "num_pages", F.length("full_text").cast("bigint").alias("total_characters"), "full_text")
