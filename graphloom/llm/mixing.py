"""Mixing sources to target weights by systematic sampling.

Targets share out all words by source weights, none above a multiple of what its source has. A
document's expected copies are its source's target over its source's words. They are summed along the
source's documents, one random offset is added, and a document is taken once for each integer that its
stretch of the sum crosses. The offset is the best of some evenly spaced ones from a random one on, by
the words that it takes.

The running sum needs a document's place among its source's documents, by size class and id. All rows are
dealt by ranges of that order, so a source is spread over as many parts as its rows need; a part's rows
are counted, and the counts are summed along the parts. No task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, only, table
from graphloom.session import discard

WORDS = r"[^\x20\x09-\x0D]+"
#: Evenly spaced offsets of which a source takes the one that comes nearest its target.
DRAWS = 32
#: Rows with one id and text that are numbered together.
TOGETHER = 50_000
#: No document is taken more often, and no target is above this many times its source's words.
MOST = 3
SEED = "mix"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row for each source.

    The weights repeat along the sources in code-point order, null last. Where a share is above
    ``most`` times the source's size it stops there, and the excess is shared again among the others by
    weight until none is above. Only three sums reach the driver in each round.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.select(
        "source", "source_size", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).alias("w")
    )
    ranked = materialize(ranked.withColumn("stop", F.col("source_size") * most), "mix-sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    stopped: Column = F.lit(False)
    while True:
        row = ranked.agg(
            F.sum(F.when(stopped, F.col("stop")).otherwise(0)), F.sum(F.when(~stopped, F.col("w")).otherwise(0))
        ).first()
        rest, weight = total - (row[0] or 0), row[1] or 0
        if not weight:
            share = F.lit(0.0)
            break
        # A literal of under 2^31 is an int, and its product with a weight would overflow.
        share = (F.lit(rest).cast("bigint") * F.col("w")).cast("double") / F.lit(weight)
        over = ~stopped & (share > F.col("stop"))
        if not ranked.where(over).limit(1).count():
            break
        # Stopped sources are those whose share at this level is above their stop: levels only rise.
        stopped = stopped | over
    return ranked.select(
        "source", "source_size", F.when(stopped, F.col("stop").cast("double")).otherwise(share).alias("target")
    )


def place(docs: DataFrame) -> DataFrame:
    """Adds ``place``, from 0, along ``source`` by (size class, doc_id, text hash); repeated rows take any order."""
    kind = F.length(F.bin("size"))
    order = ("source", "kind", "doc_id", "h")
    # The ranges come from a sample, so the part that a row falls in is written down.
    dealt = docs.withColumn("kind", kind).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "mix-parts")
    totals = dealt.groupBy("source", "part").agg(F.count("*").alias("n"))
    along = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("source").alias("s"), F.col("part").alias("b"), F.coalesce(F.sum("n").over(along), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "part").orderBy("kind", F.col("doc_id").asc_nulls_first(), "h")
    numbered = dealt.withColumn("i", F.row_number().over(inside) - 1)
    joined = numbered.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("b")))
    return joined.withColumn("place", F.col("start") + F.col("i")).drop("s", "b", "start", "i", "kind", "part")


def offset(source: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and the source alone."""
    text = F.concat(F.lit(seed + "/"), F.coalesce(source, F.lit("\x00null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def _shifted(draw: int, draws: int) -> Column:
    """The offset ``first``, moved on by a share of the interval and around its end."""
    u = F.col("first") + draw / draws
    return u - F.floor(u)


def _crossed(u: Column) -> Column:
    """Integers in a document's stretch of the running sum."""
    upto = lambda i: F.floor(u + i * F.col("rate"))
    return upto(F.col("place") + 1) - upto(F.col("place"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, seed: str = SEED, draws: int = DRAWS) -> DataFrame:
    """``doc_id, source, h, size, source_size, target, copies, taken`` for every row.

    ``size`` counts the text's words, 0 for a null text, ``h`` is the text's hash. ``taken`` is copies
    times size. Of ``draws`` evenly spaced offsets, the first of them random, a source takes the one with
    which its taken words come nearest its target, the first of equals. Sources whose documents have no words have target 0. Null sources are
    one source; null ids come first within their size class. Equal inputs give equal results; repeated
    rows count one by one. Extra columns are left out.
    """
    slim = only(docs, "doc_id", "source", "text").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        words_in(F.col("text").cast("string")).alias("size"),
        F.xxhash64(F.col("text").cast("string")).alias("h"),
    )
    slim = materialize(slim, "mix-sizes")
    sums = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sums, weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = goals.withColumns({"rate": rate, "first": offset(F.col("source"), seed)}).withColumnRenamed("source", "s")
    goals = materialize(goals, "mix-goals")
    placed = materialize(place(slim).join(goals, F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-placed")
    discard(slim)
    taken = [F.sum(_crossed(_shifted(k, draws)) * F.col("size")).alias(f"t{k}") for k in range(draws)]
    tried = placed.groupBy("source", "target", "first").agg(*taken)
    misses = F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("target")), F.lit(k), _shifted(k, draws).alias("u")) for k in range(draws)])
    chosen = tried.select(F.col("source").alias("s"), F.array_min(misses)["u"].alias("u"))
    copies = _crossed(F.col("u"))
    return placed.join(chosen, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "h", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: The same rows by DuckDB: the levels of the shares are found one source at a time.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source
), t AS (
  SELECT *, 3 * source_size AS stop, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s
), o AS (
  SELECT *, CAST(total - coalesce(sum(stop) OVER x, 0) AS BIGINT) AS rest,
         CAST(sum(w) OVER () - coalesce(sum(w) OVER x, 0) AS BIGINT) AS weight,
         row_number() OVER (ORDER BY CAST(stop AS DOUBLE) / w, source) AS k
  FROM t WINDOW x AS (ORDER BY CAST(stop AS DOUBLE) / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), a AS (
  SELECT *, CAST(rest * w AS DOUBLE) / weight <= stop AS fits FROM o
), f AS (
  SELECT min(k) AS k FROM a WHERE fits
), g AS (
  SELECT a.source, a.source_size,
         CASE WHEN a.k < f.k OR f.k IS NULL THEN CAST(a.stop AS DOUBLE)
              ELSE CAST((SELECT rest FROM a AS b WHERE b.k = f.k) * a.w AS DOUBLE)
                   / (SELECT weight FROM a AS b WHERE b.k = f.k) END AS target
  FROM a, f
), p AS (
  SELECT d.doc_id, d.source, d.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY length(bin(d.size)), d.doc_id) - 1 AS i
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), o0 AS (
  SELECT source, CAST('0x' || substr(md5('mix/' || coalesce(source, chr(0) || 'null')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS first FROM s
), u AS (
  SELECT source, k, first + k / 32.0::DOUBLE - floor(first + k / 32.0::DOUBLE) AS u FROM o0, range(32) AS r(k)
), x AS (
  SELECT p.source, u.u, row_number() OVER (
           PARTITION BY p.source
           ORDER BY abs(sum((floor(u.u + (p.i + 1) * p.rate) - floor(u.u + p.i * p.rate)) * p.size) - min(p.target)), u.k) AS best
  FROM p JOIN u ON p.source IS NOT DISTINCT FROM u.source GROUP BY p.source, u.k, u.u
)
SELECT p.doc_id, p.size, p.source_size, p.target,
       CAST(floor(x.u + (p.i + 1) * p.rate) - floor(x.u + p.i * p.rate) AS BIGINT) * p.size AS taken
FROM p JOIN x ON p.source IS NOT DISTINCT FROM x.source AND x.best = 1
"""


def mixing_stage(docs: DataFrame) -> DataFrame:
    """The documents, each as often as the mix takes it: left out, once, or up to three times.

    Copies carry the same ``doc_id``. All columns stay as they are. Rows with one id, text and source are
    as many as the mix takes of them together, shared out as evenly as can be.
    """
    key = ("__id", "__h", "__s")
    mixed = mix(docs).groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("source").alias("__s"))
    mixed = materialize(mixed.agg(F.count("*").alias("__m"), F.sum("copies").alias("__c")).where("__c > 0"), "mix-copies")
    keyed = docs.withColumns(
        {
            "__id": F.col("doc_id").cast("bigint"),
            "__h": F.xxhash64(F.col("text").cast("string")),
            "__s": F.col("source").cast("string"),
        }
    )
    names = [f"`{c}`" for c in docs.columns]

    def taken(rows: DataFrame, copies: Column) -> DataFrame:
        return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).select(*names)

    def among(few: DataFrame) -> DataFrame:
        other = few.select(*[F.col(k).alias(f"{k}2") for k in key], "__m", "__c")
        return keyed.join(other, F.expr(" AND ".join(f"{k} <=> {k}2" for k in key)))

    out = taken(among(mixed.where("__m = 1")), F.col("__c"))
    if not mixed.where("__m > 1").limit(1).count():
        return out
    salt = F.floor(F.rand(7) * F.ceil(F.col("__m") / F.lit(TOGETHER)))
    same = materialize(among(mixed.where("__m > 1")).withColumn("__salt", salt), "mix-same")
    totals = same.groupBy(*key, "__salt").agg(F.count("*").alias("n"))
    along = Window.partitionBy(*key).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *[F.col(k).alias(f"{k}3") for k in key], F.col("__salt").alias("__t"), F.coalesce(F.sum("n").over(along), F.lit(0)).alias("__start")
    )
    inside = Window.partitionBy(*key, "__salt").orderBy("__salt")
    numbered = same.withColumn("__i", F.row_number().over(inside))
    numbered = numbered.join(starts, F.expr(" AND ".join(f"{k} <=> {k}3" for k in key) + " AND __salt = __t"))
    each = F.floor(F.col("__c") / F.col("__m")) + F.when(F.col("__start") + F.col("__i") <= F.col("__c") % F.col("__m"), 1).otherwise(0)
    numbered = numbered.withColumn("__each", each).where("__each > 0")
    return out.unionByName(taken(numbered, F.col("__each")))
