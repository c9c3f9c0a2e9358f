"""Chunks of text: fixed windows, sentences, and windows that end at sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import SPACE, strip

SIZE, OVERLAP = 3000, 300


def check_window(size: int, overlap: int) -> None:
    if overlap < 0 or size <= overlap:
        raise ValueError("a window needs 0 <= overlap < size")


def window_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, key: str = "doc_id") -> DataFrame:
    """``key, chunk_id, start_char, end_char, text``: windows over the stripped text.

    A window starts every ``size - overlap`` characters; the first that reaches the end is the last.
    Windows are stripped and blank ones dropped; offsets are those before stripping. ``key`` tells one
    text from another. Nothing is shuffled: a text's windows come from its own row.
    """
    check_window(size, overlap)
    return _windows(_bodies(docs.select(key, "text"), size, overlap), size, overlap).select(
        key, F.col("place").cast("int").alias("chunk_id"), "start_char", "end_char", "text"
    )


def _bodies(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Adds ``body``, the stripped text, its length ``n``, ``count`` of its windows, and the numbers of those that are ``blank``.

    A window can only be blank where white space runs on for a window's length, so few bodies are cut here.
    """
    step = size - overlap
    body = docs.withColumn("body", strip(F.col("text"))).drop("text")
    body, n = body.withColumn("n", F.length("body")), F.col("n")
    body = body.withColumn("count", F.when(n <= size, F.lit(1)).otherwise(1 + F.ceil((n - size) / step)).cast("int"))
    empty = F.filter(
        F.sequence(F.lit(0), F.col("count") - 1),
        lambda k: strip(F.substring(F.col("body"), k * step + 1, F.lit(size))) == "",
    )
    none = F.array().cast("array<int>")
    return body.withColumn("blank", F.when((n == 0) | F.col("body").rlike(rf"(?U){SPACE}{{{size}}}"), empty).otherwise(none))


def _windows(bodies: DataFrame, size: int, overlap: int) -> DataFrame:
    """A row for each window that isn't blank: ``place`` among them, offsets and text.

    The numbers of the windows are exploded and each is cut from the body then, so the plan holds one
    strip of the text. An outer explode and a null-safe filter let the optimizer infer none that would evaluate
    it again in the scan.
    """
    start = F.col("k") * (size - overlap)
    each = bodies.withColumn("k", F.explode_outer(F.sequence(F.lit(0), F.col("count") - 1)))
    kept = each.where(F.col("k").isNotNull() & ~F.coalesce(F.array_contains("blank", F.col("k")), F.lit(False)))
    return kept.select(
        *[c for c in bodies.columns if c not in ("body", "n", "count", "blank")],
        (F.col("k") - F.size(F.filter("blank", lambda b: b < F.col("k")))).alias("place"),
        start.alias("start_char"),
        F.least(start + size, F.col("n")).alias("end_char"),
        strip(F.substring(F.col("body"), start + 1, F.lit(size))).alias("text"),
    )


def page_chunks(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, chunk_id, page_number, start_char, end_char, text``: windows that don't cross pages.

    Ids run through a document's pages in order; a missing page number counts as 0. Only the number of
    chunks of each page takes part in the window over a document.
    """
    check_window(size, overlap)
    numbered = pages.select("doc_id", F.coalesce("page_number", F.lit(0)).alias("page_number"), "text")
    cut = _bodies(numbered, size, overlap)
    before = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    n = F.coalesce(F.col("count") - F.size("blank"), F.lit(0))
    placed = cut.withColumn("base", F.coalesce(F.sum(n).over(before), F.lit(0)))
    return _windows(placed, size, overlap).select(
        "doc_id", (F.col("base") + F.col("place")).cast("bigint").alias("chunk_id"), "page_number", "start_char", "end_char", "text"
    )


def chunk_texts(docs: DataFrame, size: int = 500, overlap: int = 50, key: str = "doc_id") -> DataFrame:
    """Windows without their offsets, at the configured size."""
    return window_chunks(docs, size, overlap, key).select(key, "chunk_id", "text")


def sentence_chunks(docs: DataFrame, most: int = 5, key: str = "doc_id") -> DataFrame:
    """``key, chunk_id, text``: groups of ``most`` sentences joined by a space; none if ``most`` is negative."""
    if most == 0:
        raise ValueError("a group needs at least one sentence")
    if most < 0:
        return docs.select(key, F.lit(0).alias("chunk_id"), "text").limit(0)
    parts = F.filter(F.transform(F.split(strip(F.col("text")), r"(?U)(?<=[.!?])[\s\x1c-\x1f]+"), strip), lambda s: s != "")
    cut = docs.select(key, parts.alias("s")).where(F.size("s") > 0)
    groups = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("s") - 1) / most).cast("int")),
        lambda i: F.array_join(F.slice("s", i * most + 1, most), " "),
    )
    return cut.select(key, F.posexplode(groups).alias("chunk_id", "text"))


def smart_cuts(text: str, size: int, overlap: int) -> list[tuple[int, int, str]]:
    """``(start, end, text)`` of windows that end after a sentence where one ends near.

    A window's end moves to the last sentence end between its last fifth and 50 characters past it.
    The next starts ``overlap`` before that; starts that go back to where one was, or before the text,
    raise ValueError.
    """
    text, out, start, seen = text.strip(), [], 0, set()
    while start < len(text):
        if start < 0 or start in seen:
            raise ValueError(f"windows of {size} with overlap {overlap} make no progress at {start}")
        seen.add(start)
        end = start + size
        last = end >= len(text)
        if not last:
            near = end - int(size * 0.2)
            ends = [m.end() for m in re.finditer(r"[.!?]\s+", text[near : end + 50])]
            end = near + ends[-1] if ends else end
        piece = text[start : None if last else end].strip()
        if piece:
            out.append((start, min(end, len(text)), piece))
        if last:
            break
        start = end - overlap
    return out


def smart_chunks(docs: DataFrame, size: int = 500, overlap: int = 50, respect_sentences: bool = True, key: str = "doc_id") -> DataFrame:
    """``key, chunk_id, start_char, end_char, text``; each window depends on the one before, hence Python."""
    if not respect_sentences:
        return window_chunks(docs, size, overlap, key)
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (k, i, start, end, piece)
                for k, text in zip(pdf[key], pdf["text"], strict=True)
                for i, (start, end, piece) in enumerate(smart_cuts(text or "", size, overlap))
            ]
            yield pd.DataFrame(rows, columns=[key, "chunk_id", "start_char", "end_char", "text"])

    schema = f"{key} {kind}, chunk_id int, start_char int, end_char int, text string"
    return docs.select(key, "text").where("text is not null").mapInPandas(cut, schema)


def chunk_violations(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, chunk_id, problem`` of chunks that lack an id or text, are blank or untrimmed, or are out of place."""
    order = Window.partitionBy(key).orderBy(F.col("chunk_id").asc_nulls_last())
    placed = chunks.withColumn("place", F.row_number().over(order) - 1)
    problem = (
        F.when(F.col("chunk_id").isNull(), "chunk_id is missing")
        .when(F.col("text").isNull(), "text is missing")
        .when(strip(F.col("text")) == "", "text is blank")
        .when(strip(F.col("text")) != F.col("text"), "text is not trimmed")
        .when(F.col("chunk_id") != F.col("place"), "chunk_id is out of place")
    )
    return placed.select(key, "chunk_id", problem.alias("problem")).where("problem is not null")


def validate_chunks(chunks: DataFrame, key: str = "doc_id") -> bool:
    first = chunk_violations(chunks, key).limit(1).collect()
    if first:
        raise ValueError(f"{first[0][key]}/{first[0]['chunk_id']}: {first[0]['problem']}")
    return True


def chunk_statistics(chunks: DataFrame, *by: str) -> DataFrame:
    """Number of chunks, and total, average, least and greatest length; zeros for none."""
    n = F.length("text")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return chunks.groupBy(*by).agg(
        F.count("*").alias("total_chunks"),
        zero(F.sum(n)).cast("bigint").alias("total_characters"),
        F.round(zero(F.avg(n)), 6).cast("double").alias("avg_chunk_size"),
        zero(F.min(n)).cast("bigint").alias("min_chunk_size"),
        zero(F.max(n)).cast("bigint").alias("max_chunk_size"),
    )
