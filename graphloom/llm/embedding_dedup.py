"""Near-duplicate embeddings by an exact metric range join.

On unit vectors, cosine c means distance sqrt(2 - 2c), so near-duplicates lie within a fixed radius r.
Within each label, pivots partition the vectors: each vector's home is its nearest pivot's cell. A
vector x visits another cell q if a y of that cell may lie within r of x. By the triangle inequality such
a y makes d(x, q) <= d(x, home) + 2r; since y is nearer to q than to any other pivot s, and the space is
Euclidean, x also lies within r of the plane halfway between q and s:
d(x, q)^2 - d(x, s)^2 <= 2r d(q, s). Each cell compares its own vectors with all that are there, in blocks
of both, independently of other cells, and so counts all links of its own vectors. Equal vectors of a
label are one and take part once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, only, table
from graphloom.operators.components import connected_components
from graphloom.session import discard

#: Distinct vectors of a label for each of its pivots, and most pivots of a label, whose cells then grow.
PER_PIVOT, PIVOTS = 1500, 256
#: Own vectors of a cell, and vectors that visit it, in one block; fewer if a block's bytes are over ``BYTES``.
SIDE, ACROSS = 1024, 4096
BYTES = 32 << 20


def _vectors(df: DataFrame) -> DataFrame:
    """``vec_id, label, v, norm``: doubles, for the vectors that can link; null labels are left out."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    # Scaled by the largest component, so that squares neither overflow nor vanish.
    unit = F.transform("v", lambda x: x / F.col("top"))
    norm = F.sqrt(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x))
    good = df.where("label is not null and vec_id is not null and embedding is not null").withColumn("v", v).where(ok)
    good = good.withColumn("top", top).where("top > 0").withColumn("u", unit).withColumn("norm", norm)
    return good.select("vec_id", "label", "v", F.transform("u", lambda x: x / F.col("norm")).alias("u"))


def _pivots(distinct: DataFrame) -> DataFrame:
    """``label, pivot, p``: the vectors with the smallest hashes, more for larger labels, ``PIVOTS`` at most."""
    sizes = distinct.groupBy("label").agg(F.count("*").alias("m"))
    few = F.least(F.lit(PIVOTS), F.ceil(F.col("m") / PER_PIVOT)).cast("bigint")
    unit = F.pmod(F.xxhash64("u"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.least(F.lit(1.0), (4 * few + 40) / F.col("m"))
    drawn = distinct.join(sizes.withColumn("few", few), "label").where(unit < rate)
    order = Window.partitionBy("label").orderBy(unit, "cid")
    ranked = drawn.withColumn("pivot", F.row_number().over(order)).where("pivot <= few")
    return ranked.select("label", "pivot", F.col("u").alias("p"))


def link(df: DataFrame, cosine: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vec_id, embedding, label``.

    Vectors of equal labels link at a cosine of at least ``cosine``, in double precision. Vectors that
    are null, empty, zero, or hold null or non-finite components, and those with a null label, link with
    nothing, nor do vectors of different lengths. ``n_links`` counts other vectors, equal ones included;
    a component's id is its smallest vec_id. Rows with a null vec_id get 0, null and false. Rows that
    repeat a vec_id are one vector with several embeddings, which join its components; each counts by itself
    for the others' links, and ``n_links`` is the most that one of them has. Extra columns are left out.
    """
    slim = only(df, "vec_id", "embedding", "label").select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", "label")
    good = _vectors(slim).select("vec_id", "label", "v", "u")
    same = good.groupBy("label", "v").agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies"), F.first("u").alias("u"))
    same = materialize(same.withColumn("h", F.xxhash64("v")), "vec-classes")
    found = _cells(same, cosine)
    near = found.groupBy("cid", "h").agg(F.sum("near").alias("near")).where("near > 0")
    edges = found.where("root <> cid").select("cid", "root").distinct()
    which = F.xxhash64("label", "v")
    several = good.groupBy("vec_id").agg(F.min(which).alias("a"), F.max(which).alias("b")).where("a < b").select("vec_id")
    if several.limit(1).count():
        own = good.join(several, "vec_id").join(same.select("label", "v", "cid"), ["label", "v"])
        edges = edges.unionByName(own.select("cid", F.col("vec_id").alias("root")).distinct())
    groups = connected_components(edges, "cid", "root").select(F.col("id").alias("cid"), "component")
    members = good.select("vec_id", "label", "v").join(same.select("label", "v", "h", "cid", "copies"), ["label", "v"])
    members = members.join(near, ["cid", "h"], "left").join(groups, "cid", "left").select(
        F.col("vec_id").alias("vid"),
        (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("links"),
        F.coalesce("component", "cid").alias("comp"),
    )
    members = members.groupBy("vid").agg(F.max("links").alias("links"), F.min("comp").alias("comp"))
    out = slim.select("vec_id").join(members, F.col("vec_id") == F.col("vid"), "left")
    component = F.coalesce("comp", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )


def _homes(same: DataFrame, radius: float) -> DataFrame:
    """``label, cid, h, copies, v, cell, own``: each vector in its home and in the cells that it visits."""
    chosen = materialize(_pivots(same.select("label", "cid", "u")), "pivots")
    dealt = same.groupBy("label").agg(F.ceil(F.sum(F.size("u")) * 8 / BYTES).cast("int").alias("salts"))
    packs = chosen.join(dealt, "label").withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).select("label", "salt", "pivot", "p")
    salted = same.join(dealt, "label").withColumn("salt", F.pmod(F.xxhash64("cid"), F.col("salts")).cast("int"))

    def assign(vectors: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        rows: dict[str, list] = {k: [] for k in ("label", "cid", "h", "copies", "v", "cell", "own")}
        pivots = pivots.sort_values("pivot")
        lengths = pivots["p"].map(len).to_numpy()
        for length, part in vectors.groupby(vectors["u"].map(len)):
            # Vectors of another length than a pivot's can't be placed by it: they visit its cell.
            known = np.flatnonzero(lengths == length)
            p = np.stack(pivots["p"].iloc[known].to_list()) if len(known) else np.zeros((0, length))
            between = _distances(p, p)
            for i in range(0, len(part), 1024):
                some = part.iloc[i : i + 1024]
                d = _distances(np.stack(some["u"].to_list()), p)
                visits = np.ones((len(some), len(lengths)), bool)
                home = np.full(len(some), 0)
                if len(known):
                    home = known[d.argmin(axis=1)]
                    near = d <= d.min(axis=1, keepdims=True) + 2 * radius + 1e-9
                    square = d * d
                    for s in range(len(known)):
                        near &= square - square[:, s : s + 1] <= 2 * radius * between[:, s] + 1e-9
                    visits[:, known] = near
                    visits[np.arange(len(some)), home] = True
                at, cell = np.nonzero(visits)
                for k in ("label", "cid", "h", "copies", "v"):
                    column = some[k].to_list()
                    rows[k] += [column[j] for j in at]
                rows["cell"] += cell.tolist()
                rows["own"] += (cell == home[at]).tolist()
        return pd.DataFrame(rows)

    kind = same.schema["label"].dataType.simpleString()
    schema = f"label {kind}, cid bigint, h bigint, copies bigint, v array<double>, cell int, own boolean"
    return salted.groupBy("label", "salt").cogroup(packs.groupBy("label", "salt")).applyInPandas(
        lambda x, y: assign(x, y) if len(x) else pd.DataFrame(), schema
    )


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0))


def _cells(same: DataFrame, cosine: float) -> DataFrame:
    """``cid, h, near, root``: for each own vector of a block its number of links there (copies counted), and
    for each vector of the block its component's smallest id within it."""
    # Distances from products of unit vectors are off by some 1e-8 where they are small.
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-7
    there = materialize(_homes(same, radius), "cells")
    sizes = there.groupBy("label", "cell").agg(
        F.count_if("own").alias("m"), F.count("*").alias("n"), (F.lit(BYTES) / F.greatest(F.lit(1), 8 * F.max(F.size("v")))).alias("fit")
    )
    cut = lambda n, most: F.ceil(F.col(n) / F.greatest(F.lit(1.0), F.least(F.lit(float(most)), F.col("fit")))).cast("int")
    sizes = sizes.where("m > 0").select("label", "cell", cut("m", SIDE).alias("parts"), cut("n", ACROSS).alias("across"))
    cells = there.join(sizes, ["label", "cell"])
    one = cells.where("own").withColumns({"i": F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"), "side": F.lit(0)})
    one = one.withColumn("j", F.explode(F.expr("sequence(0, across - 1)")))
    two = cells.withColumns({"j": F.pmod(F.xxhash64(F.lit(1), "cid"), F.col("across")).cast("int"), "side": F.lit(1)})
    two = two.withColumn("i", F.explode(F.expr("sequence(0, parts - 1)")))
    kept = ("label", "cell", "i", "j", "side", "cid", "h", "copies", "v")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        own, all_ = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        out: dict[str, list] = {"cid": [], "h": [], "near": [], "root": []}
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for length in sorted(set(own["v"].map(len))):
            a, b = own[own["v"].map(len) == length], all_[all_["v"].map(len) == length]
            if not len(b):
                continue
            ids, copies = b["cid"].to_numpy(), b["copies"].to_numpy()
            y, ny = _scaled(np.stack(b["v"].to_list()))
            x, nx = _scaled(np.stack(a["v"].to_list()))
            mine, hashes = a["cid"].to_numpy(), a["h"].to_numpy()
            for i in range(0, len(x), 256):
                like = (x[i : i + 256] @ y.T) / (nx[i : i + 256, None] * ny)
                close = (like >= cosine) & (mine[i : i + 256, None] != ids)
                near = close @ copies
                some = np.flatnonzero(near)
                out["cid"] += mine[i : i + 256][some].tolist()
                out["h"] += hashes[i : i + 256][some].tolist()
                out["near"] += near[some].tolist()
                for row, col in zip(*np.nonzero(close), strict=True):
                    p, q = top(int(mine[i + row])), top(int(ids[col]))
                    if p != q:
                        parent[max(p, q)] = min(p, q)
        out["root"] = [top(c) for c in out["cid"]]
        mine_too = set(out["cid"])
        extra = [c for c in parent if c not in mine_too and top(c) != c]
        out["cid"] += extra
        out["h"] += [0] * len(extra)
        out["near"] += [0] * len(extra)
        out["root"] += [top(c) for c in extra]
        return pd.DataFrame(out)

    both = one.select(*kept).unionByName(two.select(*kept))
    links = both.groupBy("label", "cell", "i", "j").applyInPandas(compare, "cid bigint, h bigint, near bigint, root bigint")
    links = materialize(links, "vec-links")
    discard(there)
    return links


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows over their largest component where that is extreme, and their norms."""
    top = np.abs(x).max(axis=1, keepdims=True)
    x = np.where((top > 1e100) | (top < 1e-100), x / top, x)
    return x, np.sqrt((x * x).sum(axis=1))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))
