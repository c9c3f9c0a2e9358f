"""Document fingerprints: the k smallest distinct hashes of a text's word shingles.

Everything is a DataFrame expression. Sketches of parts merge into that of the whole: the k smallest
of their union. Two sketches estimate resemblance, containment and, each by itself, the number of
distinct shingles; sketches with fewer than k hashes hold all of them, and then the figures are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, only, table

K = 128
SHINGLE = 5
#: Rows of one block of neighbouring ids, and most blocks whose first rows are broadcast.
BLOCK_ROWS = 4000
FEW_BLOCKS = 100_000
#: Quantiles that one aggregate finds; blocks are quantiles of quantiles, so their number may be its square.
CUTS = 1000
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The sketch of a text: ascending distinct hashes, at most k.

    Fewer words than a shingle count as one shingle; a text without words has an empty sketch.
    """
    return F.transform(F.array(words(text)), lambda w: _bottom(_hashes(w, shingle), k))[0]


def _hashes(w: Column, shingle: int) -> Column:
    n = F.size(w)
    starts = F.sequence(F.lit(1), F.greatest(n - (shingle - 1), F.lit(1)))
    return F.when(n > 0, F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, shingle)))).otherwise(F.array().cast("array<bigint>"))


def _bottom(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return _bottom(F.concat(a, b), k)


def merge_all(df: DataFrame, by: str, column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each key. Hashes are cut to k for each key and salt before the keys meet."""
    hashes = df.select(by, F.explode(column).alias("h")).withColumn("salt", F.pmod("h", F.lit(32)))
    first = Window.partitionBy(by, "salt").orderBy("h")
    second = Window.partitionBy(by).orderBy("h")
    kept = hashes.withColumn("r", F.rank().over(first)).where(F.col("r") <= k).select(by, "h").distinct()
    kept = kept.withColumn("r", F.row_number().over(second)).where(F.col("r") <= k)
    return kept.groupBy(by).agg(F.sort_array(F.collect_list("h")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Jaccard likeness of the shingle sets; 1 if both are empty."""
    both = F.sort_array(F.array_union(a, b))
    seen = F.when((F.size(a) < k) & (F.size(b) < k), both).otherwise(F.slice(both, 1, k))
    shared = F.size(F.array_intersect(seen, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(seen))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Number of distinct shingles."""
    top = (F.element_at(a, -1).cast("double") + 9223372036854775808.0) / 18446744073709551616.0
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of a's shingles that b has; 1 if a is empty."""
    j = resemblance(a, b, k)
    part = j / (1 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k)) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), part))


def encoded(a: Column) -> Column:
    """A sketch as text: base64 of its hashes as big-endian 64-bit integers."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def in_blocks(docs: DataFrame) -> DataFrame:
    """Adds ``block``: rows in blocks of neighbouring ids, ascending, of about ``BLOCK_ROWS`` rows.

    Quantiles of the ids cut them into parts, and the parts' own quantiles into blocks, wherever ids
    cluster. Null ids come before all others, in blocks by text hash. At most ``CUTS`` ids reach the
    driver, and the blocks' bounds, at most ``CUTS`` for each of as many parts, are broadcast: 8 MB.
    """
    n, some = docs.agg(F.count("*"), F.count("doc_id")).first()
    most = F.lit(max(1, (n - some) // BLOCK_ROWS))
    unit = F.col("h").cast("double") / 18446744073709551616.0 + 0.5
    nulls = F.least(F.floor(unit * most), most - 1).cast("bigint") - most
    parts = max(1, min(CUTS, some // (BLOCK_ROWS * CUTS)))
    each = max(1, min(CUTS, some // (BLOCK_ROWS * parts)))
    cuts = [i / parts for i in range(1, parts)]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", cuts, 10 * CUTS)).first()[0] or [])) if cuts else []
    place = lambda edges: F.size(F.filter(edges, lambda b: b <= F.col("doc_id")))
    part = place(F.array(*[F.lit(b).cast("bigint") for b in bounds])) if bounds else F.lit(0)
    dealt = docs.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(part))
    inner = F.percentile_approx("doc_id", [i / each for i in range(1, each)] or [0.5], 10 * CUTS)
    edges = dealt.where("part >= 0").groupBy("part").agg(inner.alias("edges") if each > 1 else F.array().cast("array<bigint>").alias("edges"))
    edges = materialize(edges, "block-edges").withColumnRenamed("part", "of")
    both = dealt.join(F.broadcast(edges), F.col("part") == F.col("of"), "left")
    block = F.col("part").cast("bigint") * (CUTS + 1) + place(F.array_distinct("edges"))
    return both.withColumn("block", F.when(F.col("doc_id").isNull(), nulls).otherwise(block)).drop("part", "of", "edges")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows that a window over (block, ghost, doc_id descending) can pair with their next one.

    Each block gets, as a ghost after its last row, the first row of the block below it; the lowest
    block gets the first row of all. So texts move once, and no task orders the whole table.
    """
    blocks = in_blocks(docs)
    heads = blocks.groupBy("block").agg(F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", "h")).alias("head"))
    heads = materialize(heads, "block-heads")  # one row for each block
    along = Window.orderBy("block")
    lowest = heads.agg(F.min("block")).first()[0]
    above = F.coalesce(F.lead("block").over(along), F.lit(lowest))
    ghosts = heads.select(F.col("head.doc_id").alias("g"), F.col("head.h").alias("gh"), above.alias("to"))
    if ghosts.limit(FEW_BLOCKS + 1).count() <= FEW_BLOCKS:
        ghosts = F.broadcast(ghosts)
    copied = docs.join(ghosts, F.col("doc_id").eqNullSafe(F.col("g")) & (F.col("h") == F.col("gh")))
    copied = copied.dropDuplicates(["doc_id", "h", "to"]) if _repeats(copied) else copied
    return blocks.withColumn("ghost", F.lit(False)).unionByName(
        copied.select("doc_id", "text", "h", F.col("to").alias("block"), F.lit(True).alias("ghost"))
    )


def _repeats(copied: DataFrame) -> bool:
    """Whether a ghost stands for repeated rows, of which one is enough."""
    return copied.groupBy("doc_id", "h", "to").count().where("count > 1").limit(1).count() > 0


def fingerprint_edits(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of texts and of their edited texts.

    ``doc_id, n_chars, edited, sketch, edited_sketch, near_edited, near_next``. The edited text has its
    last third replaced by the start of the next document's, descending ``doc_id`` (null ids last, equal
    ids by text hash, equal rows in any order); after the last comes the first, which for a table of
    one row is the row itself. Null texts count as empty. Extra columns are left out.
    """
    slim = only(docs, "doc_id", "text").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    slim = slim.withColumn("h", F.xxhash64("text"))
    rows = with_next(slim).repartition("block").withColumn("sketch", sketch(F.col("text"), k, shingle))
    order = Window.partitionBy("block").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    paired = rows.withColumns({"next": F.lead("text").over(order), "next_sketch": F.lead("sketch").over(order)})
    paired = paired.where(~F.col("ghost")).withColumn("n_chars", F.length("text"))
    edited = F.expr("concat(substring(text, 1, n_chars - n_chars div 3), substring(next, 1, int(n_chars div 3)))")
    done = paired.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited"), k, shingle))
    return done.select(
        "doc_id",
        F.col("n_chars").cast("bigint").alias("n_chars"),
        "edited",
        "sketch",
        "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        encoded(F.col("sketch")).alias("fingerprint"),
        encoded(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
