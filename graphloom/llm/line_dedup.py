"""Line deduplication within one edit, by deletion neighbourhoods, in DataFrame operations only.

Equal lines (white space at the ends aside) are one: hashes are grouped, and the earliest place stays.
Among distinct lines, two are within one edit exactly if they share a variant of at most one deletion:
at the same place of both for a replaced character, or one line is the other's variant. All variants
are emitted as hashed keys, equal keys meet, and the edit distance of what meets is verified.

Emitting a variant for each character of every line would multiply the corpus, so variants that leave
out a wide gap come first. Two lines within one edit share a start and an end around some gap, hence a
key; a line that shares no such key with another line has no neighbour and needs no finer variants.
Two rounds, of wide gaps and of narrow ones, lose no neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import bitmap, matching, materialize, only, sift, table
from graphloom.session import discard

#: Characters of the shortest lines that have neighbours; a caller may ask for more.
LEAST = 1
#: Characters of one hash block of a variant.
BLOCK = 64


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id, th, ln, line, n, h1, h2`` of every line that isn't blank; ``th`` is the text's hash.

    Here and below rows are exploded as ``outer``: else the optimizer filters by the array's size first,
    and so makes each array twice. The text is hashed before that, not again for each line.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n", -1).alias("lines"))
    cut = texts.select("doc_id", "th", F.posexplode_outer("lines").alias("ln", "line"))
    cut = cut.withColumn("line", _stripped(F.col("line"))).where("line <> ''")
    return cut.select("*", F.length("line").alias("n"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _gap_keys(lines: DataFrame, finer: int) -> DataFrame:
    """A row for each gap of each line, with ``key``: what precedes and what follows the gap.

    For a length m, g is the largest power of two up to (m - 1) / 2, over ``finer``. A key holds T
    characters, those before p * g and those from the end, with T + g < m. Lines whose lengths differ by
    one share the grid of the shorter, so each line has the grids of m = n - 1, n and n + 1.
    """

    def grid(m: str) -> str:
        # `bin` has one digit for each bit.
        g = f"greatest(1, shiftleft(1, length(bin((n + {m} - 1) div 2)) - 1) div {finer})"
        return f"named_struct('g', {g}, 't', greatest(0, (((n + {m} - 1) div {g}) - 1) * {g}))"

    grids = F.expr(f"explode_outer(array_distinct(array({grid('(-1)')}, {grid('0')}, {grid('1')})))")
    placed = lines.withColumn("grid", grids).withColumn("p", F.expr("explode_outer(sequence(0, int(grid.t div grid.g)))"))
    key = F.expr(
        "xxhash64(grid.g, grid.t, p, substring(line, 1, int(p * grid.g)), "
        "substring(line, int(n - grid.t + p * grid.g + 1), int(grid.t - p * grid.g)))"
    )
    return placed.withColumn("key", key).drop("grid", "p")


def _shared(keyed: DataFrame) -> DataFrame:
    """Keys that more than one distinct line has."""
    ends = keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b"))
    return ends.where("a < b").select("key")


def _variants(lines: DataFrame) -> DataFrame:
    """``h1, h2, first, v, n, i``: each line without its character i, hashed; for i = -1 the line itself.

    A string's hash combines those of its blocks, so a variant costs one block and not its whole line:
    blocks before the deletion are the line's own, those after it are the line's one character later.
    """
    blocks = lines.select(
        "h1", "h2", "first", "n", F.expr(f"explode_outer(sequence(0, (n - 1) div {BLOCK}))").alias("j"), "line"
    ).select("h1", "h2", "first", "n", "j", F.expr(f"substring(line, int(j * {BLOCK} + 1), {BLOCK + 1})").alias("seg"))
    own, later = F.expr(f"substring(seg, 1, {BLOCK})"), F.expr("substring(seg, 2)")
    hashed = lambda x: F.when(F.length(x) > 0, F.xxhash64("j", x)).otherwise(F.lit(0).cast("bigint"))
    blocks = blocks.withColumns({"own": hashed(own), "later": hashed(later)})
    line = Window.partitionBy("h1", "h2")
    upto = line.orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.select(
        "h1", "h2", "first", "n", "j", "seg",
        F.bit_xor("own").over(line).alias("whole"),
        F.bit_xor("own").over(upto).bitwiseXOR(F.col("own")).alias("before"),
        F.bit_xor("later").over(line).bitwiseXOR(F.bit_xor("later").over(upto)).alias("after"),
    )
    selves = blocks.where("j = 0").select("h1", "h2", "first", F.col("whole").alias("v"), "n", F.lit(-1).alias("i"))
    cuts = blocks.withColumn("k", F.expr(f"explode_outer(sequence(0, least({BLOCK}, length(seg)) - 1))"))
    mixed = F.expr("concat(substring(seg, 1, k), substring(seg, k + 2))")
    v = F.col("before").bitwiseXOR(hashed(mixed)).bitwiseXOR(F.col("after"))
    cuts = cuts.select("h1", "h2", "first", v.alias("v"), (F.col("n") - 1).alias("n"), F.expr(f"int(j * {BLOCK} + k)").alias("i"))
    return selves.unionByName(cuts)


def near_lines(docs: DataFrame, distinct: DataFrame, least: int = LEAST) -> DataFrame:
    """``h1, h2`` of each distinct line of ``least`` characters or more that is one edit from an earlier one."""
    lines = lines_of(docs).where(F.col("n") >= least).select("line", "n", "h1", "h2")
    shared = materialize(_shared(_gap_keys(lines, 1)), "gap-keys")
    wide = matching(_gap_keys(lines, 1), "key", shared).groupBy("h1", "h2").agg(F.first("line").alias("line"), F.first("n").alias("n"))
    wide = materialize(wide.join(distinct.select("h1", "h2", "first"), ["h1", "h2"]), "gap-wide")
    keyed = _gap_keys(wide, 16)
    found = keyed.join(_shared(keyed), "key", "left_semi").select("h1", "h2").distinct()
    narrow = materialize(wide.join(found, ["h1", "h2"], "left_semi"), "gap-narrow")
    discard(shared)
    discard(wide)
    variants = materialize(_variants(narrow), "variants")
    cuts, selves = variants.where("i >= 0"), variants.where("i < 0")
    # Replaced: all lines with one key are one edit apart; a line's earliest fellow decides.
    keyed = cuts.withColumn("key", F.xxhash64("v", "n", "i"))
    several = materialize(_shared(keyed), "variant-keys")
    group = Window.partitionBy("v", "n", "i")
    earliest = matching(keyed, "key", several).withColumn("e", F.min(F.struct("first", "h1", "h2")).over(group)).where("first > e.first")
    replaced = earliest.select("h1", "h2", F.col("e.h1").alias("e1"), F.col("e.h2").alias("e2"))
    # Inserted or deleted: a line and another's variant.
    short = selves.select("v", "n", F.col("first").alias("f"), F.col("h1").alias("s1"), F.col("h2").alias("s2"))
    both = sift(cuts, "v", bitmap(selves, "v")).join(short, ["v", "n"])
    longer_goes = both.where("first > f").select("h1", "h2", F.col("s1").alias("e1"), F.col("s2").alias("e2"))
    shorter_goes = both.where("first < f").select(
        F.col("s1").alias("h1"), F.col("s2").alias("h2"), F.col("h1").alias("e1"), F.col("h2").alias("e2")
    )
    pairs = replaced.unionByName(longer_goes).unionByName(shorter_goes).distinct()
    text = narrow.select("h1", "h2", "line")
    other = text.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("line").alias("other"))
    verified = pairs.join(text, ["h1", "h2"]).join(other, ["e1", "e2"]).where(F.levenshtein("line", "other", 1) >= 0)
    near = materialize(verified.select("h1", "h2").distinct(), "lines-near")
    discard(narrow)
    discard(variants)
    discard(several)
    return near


def decide(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Every row, with all its columns, and its lines that stay: ``__id, __n, __gone, __kept``.

    A line stays at its earliest place, by doc_id (null first), text hash and line number, unless a
    line whose earliest place is before that is one edit away. Lines are compared without spaces, tabs
    and carriage returns at their ends; lines under ``least`` characters, none by default, have no
    neighbours. Blank lines
    stay and aren't counted. ``__kept`` joins what stays as it was written, ``__n`` counts lines and
    ``__gone`` those that go; null texts stay null and have no lines. Repeated rows count as one and get
    equal results.
    """
    slim = only(docs, "doc_id", "text").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    first = lines_of(slim).groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th", "ln")).alias("first"))
    distinct = materialize(first, "lines")
    near = near_lines(slim, distinct, least)
    stay = distinct.join(near, ["h1", "h2"], "left_anti").select("first.*")
    lists = stay.groupBy("doc_id", "th").agg(F.collect_list("ln").alias("__stay"))
    lists = lists.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "__stay")
    rows = docs.withColumns({"__text": _column(docs, "text", "string"), "__id": _column(docs, "doc_id", "bigint")})
    rows = rows.withColumn("__th", F.xxhash64("__text"))
    both = rows.join(lists, F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__t")), "left")
    both = both.withColumns(
        {
            "__lines": F.split("__text", "\n", -1),
            "__stay": F.coalesce("__stay", F.array().cast("array<int>")),
        }
    ).withColumn(
        "__blank",
        F.filter(F.transform("__lines", lambda x, i: F.when(_stripped(x) == "", i)), lambda i: i.isNotNull()),
    )
    places = F.sort_array(F.concat("__stay", "__blank"))
    kept = F.array_join(F.transform(places, lambda i: F.get("__lines", i)), "\n")
    n = (F.size("__lines") - F.size("__blank")).cast("bigint")
    some = F.col("__text").isNotNull()
    return both.select(
        *[docs[f"`{c}`"] for c in docs.columns],
        "__id",
        F.when(some, n).otherwise(0).alias("__n"),
        F.when(some, n - F.size("__stay")).otherwise(0).cast("bigint").alias("__gone"),
        F.when(some, kept).alias("__kept"),
    )


def _column(docs: DataFrame, name: str, kind: str) -> Column:
    return (F.col(f"`{name}`") if name in docs.columns else F.lit(None)).cast(kind)


def dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept`` of every row; see ``decide``."""
    return decide(docs, least).select(
        F.col("__id").alias("doc_id"), F.col("__n").alias("n_lines"), F.col("__gone").alias("n_removed"), F.col("__kept").alias("kept")
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256")
    )


#: The same rows by DuckDB: of two lines within one edit, the first or the last half of the shorter one is common.
ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, ln, raw, trim(raw, chr(32) || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
               generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents)
), u AS (
  SELECT line, min((doc_id, ln)) AS place, length(line) AS n FROM l WHERE line <> '' GROUP BY line
), w AS (
  SELECT line, place, n, unnest([n - 1, n]) AS least FROM u
), h AS (
  SELECT *, 'L' || left(line, least // 2) AS key FROM w UNION ALL SELECT *, 'R' || right(line, least // 2) FROM w
), c AS (
  SELECT DISTINCT a.line, a.n, b.line AS other, b.n AS m FROM h a JOIN h b ON a.least = b.least AND a.key = b.key
  WHERE a.place > b.place AND least(a.n, b.n) = a.least
), near AS (
  SELECT DISTINCT line FROM c
  WHERE (n = m AND list_sum(list_transform(range(1, n + 1), lambda i: CAST(line[i] <> other[i] AS INT))) = 1)
     OR (n = m + 1 AND list_contains(list_transform(range(1, n + 1), lambda i: left(line, i - 1) || substr(line, i + 1)), other))
     OR (n = m - 1 AND list_contains(list_transform(range(1, m + 1), lambda i: left(other, i - 1) || substr(other, i + 1)), line))
), k AS (
  SELECT l.doc_id, l.ln, l.raw, l.line,
         l.line = '' OR (u.place = (l.doc_id, l.ln) AND l.line NOT IN (SELECT line FROM near)) AS stays
  FROM l LEFT JOIN u ON l.line = u.line
)
SELECT d.doc_id,
       CAST(count(*) FILTER (WHERE line <> '') AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE line <> '' AND NOT stays) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY ln) FILTER (WHERE stays), '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
GROUP BY d.doc_id
"""


def line_stage(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents with the lines that stay as their text; ``n_chars``, if there, is counted again.

    A document that had lines and keeps none is a copy of earlier ones and goes; texts that are null or
    blank stay.
    """
    both = decide(docs, least).where("__gone < __n or __n = 0").withColumn("text", F.col("__kept"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        both = both.withColumn("n_chars", F.length("text").cast(kind))
    return both.select(*[f"`{c}`" for c in docs.columns])
