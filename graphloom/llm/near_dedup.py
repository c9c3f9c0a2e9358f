"""Near-duplicate documents by b-bit MinHash.

Each document's set of word shingles gives ``MINIMA`` minima. Bands of whole minima find candidates;
the low bits of the minima, packed, estimate a candidate's similarity from the number of equal fields,
corrected for fields that are equal by chance; what may reach the threshold is confirmed on the full
sets. Documents with equal sets are one class and take part once.

The members of a bucket aren't paired with each other: all are compared with one hub of the bucket, and
what the hubs' links join, over all buckets, needs no further link. Where a bucket still holds members of
several components, those apart from its hub's are compared with all of the bucket, in blocks: first by
the estimate, which only marks members, then the marked ones by the full sets. So no link that joins
components is missed, and only links leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_map, bitmap, matching, materialize, only, sift, table
from graphloom.operators.components import connected_components
from graphloom.session import discard

MINIMA = 128
#: Minima of a band: pairs at 0.85 share one of the 32 bands but for 6 in 10^11, at 0.8 but for 5 in 10^8.
ROWS = 4
#: Low bits kept of each minimum.
BITS = 4
#: Members of one block on the side of those apart, and on the side of the whole bucket.
SIDE, ACROSS = 256, 1024
#: Members of blocks that one task compares, by their signatures and by their sets.
SIGNED, FULL = 20_000, 500
#: Documents that are compared with a copy of their hub's set in one task.
SPOKES = 512

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd factors and addends of the minima's hash functions.
_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(0, 2**63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _RANDOM.integers(0, 2**63, MINIMA, np.uint64)
_STEPS = _RANDOM.integers(0, 2**63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sets of word shingles as ascending distinct 64-bit hashes.

    Words are what stands between ASCII white space; A-Z are lower-cased. Fewer words than a shingle
    count as one shingle of all of them; without words the set is empty.
    """

    def __init__(self, size: int):
        self.size, self.known = size, _Words()

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > 200_000:
            self.known.clear()
        ids = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(ids))
        n = len(ids) - size + 1
        h = np.full(n, size, np.uint64)
        for k in range(size):
            h = mixed(h * _STEPS[0] + ids[k : k + n])
        return np.unique(h)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def minima(shingles: np.ndarray) -> np.ndarray:
    out = np.full(MINIMA, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 1024):
        part = shingles[i : i + 1024, None] * _FACTORS + _ADDENDS
        np.minimum(out, part.min(axis=0), out=out)
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """The low ``BITS`` bits of each minimum, in 64-bit words."""
    fields = (mixed(low) & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    shifts = np.arange(0, 64, BITS, dtype=np.uint64)
    return np.bitwise_or.reduce(fields << shifts, axis=1)


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two packed signatures: the share of equal fields, corrected for chance."""

    def unequal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for shift in (1, 2):
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
        return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    words = [unequal(F.element_at(a, i + 1), F.element_at(b, i + 1)) for i in range(MINIMA * BITS // 64)]
    differ = sum(words[1:], words[0]) / F.lit(MINIMA)
    chance = 1 / 2**BITS
    return (1 - differ - chance) / (1 - chance)


def lowest_estimate(threshold: float) -> float:
    """Pairs at the threshold are estimated under this but for one in a thousand million."""
    return threshold - 6 * (threshold * (1 - threshold) / MINIMA) ** 0.5


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, n, class, bands, sig``: set size, hash of the whole set, band keys, packed signature."""

    def make():
        import xxhash

        shingles = Shingles(shingle)

        def run(c):
            out = {"doc_id": c["doc_id"], "n": [], "class": [], "bands": [], "sig": []}
            for text in c["text"]:
                s = shingles.of(text)
                out["n"].append(len(s))
                out["class"].append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    low = minima(s)
                    keys = low.reshape(-1, ROWS)
                    h = np.arange(len(keys), dtype=np.uint64)
                    for k in range(ROWS):
                        h = mixed(h * _STEPS[1] + keys[:, k])
                    out["bands"].append(h.astype(np.int64))
                    out["sig"].append(packed(low).astype(np.int64))
                else:
                    out["bands"].append([])
                    out["sig"].append([])
            return out

        return run

    return arrow_map(docs, make, "doc_id bigint, n bigint, class binary, bands array<bigint>, sig array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``cid, shingles`` of the wanted ``cid``; others are sifted out before Python sees their texts."""
    marks = bitmap(wanted.select(F.xxhash64("cid").alias("key")), "key")
    near = sift(docs.withColumn("key", F.xxhash64("doc_id")), "key", marks).select("doc_id", "text")

    def make():
        shingles = Shingles(shingle)

        def run(c):
            return {"cid": c["doc_id"], "shingles": [shingles.of(t).tobytes() for t in c["text"]]}

        return run

    found = arrow_map(near, make, "cid bigint, shingles binary")
    return found.join(wanted.select("cid"), "cid", "left_semi")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``a, b`` of the pairs whose sets' similarity reaches the threshold.

    An ``a`` of many pairs is dealt to many groups; each gets its set once.
    """
    hundredths = round(threshold * 100)
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPOKES).cast("int").alias("salts"))
    salted = pairs.select("a", "b").join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    left = salted.join(sets.select(F.col("cid").alias("b"), "shingles"), "b").select("a", "salt", "b", "shingles")
    right = sets.select(F.col("cid").alias("a"), "shingles").join(salts, "a")
    right = right.select("a", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), F.col("shingles").alias("own"))

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        found = {"a": [], "b": []}
        if x.num_rows and y.num_rows:
            own = [np.frombuffer(s, np.uint64) for s in set(y["own"].to_pylist())]
            for other, shingles in zip(x["b"].to_pylist(), x["shingles"].to_pylist(), strict=True):
                if any(reaches(s, np.frombuffer(shingles, np.uint64), hundredths) for s in own):
                    found["a"].append(y["a"][0].as_py())
                    found["b"].append(other)
        return pa.table(found, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return left.groupBy("a", "salt").cogroup(right.groupBy("a", "salt")).applyInArrow(compare, "a bigint, b bigint")


def reaches(x: np.ndarray, y: np.ndarray, hundredths: int) -> bool:
    """Whether two ascending sets' similarity is at least so many hundredths."""
    n, m = len(x), len(y)
    if 100 * min(n, m) < hundredths * max(n, m):
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= hundredths * (n + m - shared)


def _blocks(members: DataFrame, together: int, *columns: str) -> DataFrame:
    """``deal, key, i, j, side, cid, comp`` and columns: members ``apart`` from their bucket's hub, cut into
    parts (side 0), beside all members of the bucket (side 1), cut as well. Each two parts are a block, and
    blocks of about ``together`` members have one ``deal``."""
    counts = members.groupBy("key").agg(
        F.ceil(F.count_if("apart") / SIDE).cast("int").alias("parts"), F.ceil(F.count("*") / ACROSS).cast("int").alias("across")
    )
    cut = members.join(counts.where("parts > 0"), "key")
    left = F.pmod(F.xxhash64(F.lit(3), "cid"), F.col("parts")).cast("int")
    right = F.pmod(F.xxhash64(F.lit(5), "cid"), F.col("across")).cast("int")
    kept = ("key", "i", "j", "side", "cid", "comp", *columns)
    one = cut.where("apart").withColumns({"i": left, "side": F.lit(0)}).withColumn("j", F.explode(F.expr("sequence(0, across - 1)")))
    two = cut.withColumns({"j": right, "side": F.lit(1)}).withColumn("i", F.explode(F.expr("sequence(0, parts - 1)")))
    deals = max(1, members.count() // together)
    return one.select(*kept).unionByName(two.select(*kept)).withColumn("deal", F.pmod(F.xxhash64("key", "i", "j"), F.lit(deals)))


def _pieces(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each block the rows of either side."""
    places = [pdf[k].to_numpy() for k in ("side", "j", "i", "key")]
    order = np.lexsort(places)
    side, *block = (x[order] for x in places)
    cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in block], axis=0)) + 1
    for rows, sides in zip(np.split(order, cuts), np.split(side, cuts), strict=True):
        n = len(sides) - np.count_nonzero(sides)
        if 0 < n < len(sides):
            yield rows[:n], rows[n:]


def _alike(x: np.ndarray, y: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """For parts of the packed signatures ``x``, from where they start, which of ``y`` may be as similar to each."""
    step, chance = max(1, 65_536 // len(y)), 1 / 2**BITS
    for i in range(0, len(x), step):
        d = x[i : i + step, None, :] ^ y[None, :, :]
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        differ = np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(axis=2) / MINIMA
        yield i, (1 - differ - chance) / (1 - chance) >= least


def _signed(members: pd.DataFrame) -> np.ndarray:
    return np.array(members["sig"].to_list(), np.int64).view(np.uint64)


def _marked(members: DataFrame, threshold: float) -> DataFrame:
    """``key, cid`` of members that may be linked with one of another component in their bucket.

    Two members of several buckets, each of whose ``keys`` are given, are marked in the smallest one alone.
    """
    least = lowest_estimate(threshold)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sig, comp, key, marks = _signed(pdf), pdf["comp"].to_numpy(), pdf["key"].to_numpy(), np.zeros(len(pdf), bool)
        keys = [frozenset(x.tolist()) for x in pdf["keys"]]
        for left, right in _pieces(pdf):
            for i, hit in _alike(sig[left], sig[right], least):
                hit &= comp[left[i : i + len(hit)]][:, None] != comp[right]
                for r, k in zip(*(x.tolist() for x in np.nonzero(hit)), strict=True):
                    x, y = left[i + r], right[k]
                    if not (marks[x] and marks[y]) and min(keys[x] & keys[y]) == key[x]:
                        marks[x] = marks[y] = True
        return pdf.loc[marks, ["key", "cid"]]

    return _blocks(members, SIGNED, "sig", "keys").groupBy("deal").applyInPandas(compare, "key bigint, cid bigint").distinct()


def _rest(members: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: confirmed links of ``key, cid, comp, apart, sig, shingles`` that join components.

    Each task gives a link for each two components that it joins.
    """
    hundredths, least = round(threshold * 100), lowest_estimate(threshold)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sig, comp, cid = _signed(pdf), pdf["comp"].to_list(), pdf["cid"].to_list()
        sets = [np.frombuffer(b, np.uint64) for b in pdf["shingles"]]
        parent: dict[int, int] = {}

        def top(v: int) -> int:
            while parent.setdefault(v, v) != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        out = []
        for left, right in _pieces(pdf):
            for i, hit in _alike(sig[left], sig[right], least):
                for r, k in zip(*(x.tolist() for x in np.nonzero(hit)), strict=True):
                    x, y = left[i + r], right[k]
                    p, q = top(comp[x]), top(comp[y])
                    if p != q and reaches(sets[x], sets[y], hundredths):
                        parent[max(p, q)] = min(p, q)
                        out.append((min(cid[x], cid[y]), max(cid[x], cid[y])))
        return pd.DataFrame(out, columns=["a", "b"]) if out else pd.DataFrame()

    return _blocks(members, FULL, "sig", "shingles").groupBy("deal").applyInPandas(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Documents are linked if the shared shingles are at least ``threshold`` of both sets together (in
    whole hundredths); a component's id is its smallest doc_id, and that document is kept. Texts without
    words are linked with nothing. Rows with a null doc_id are counted but take no part: their
    component is null and they aren't kept. Repeated rows give equal results. Rows of one doc_id with
    different texts are one document, linked by any of its texts. Extra columns are left out.
    """
    slim = only(docs, "doc_id", "text").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    drawn = materialize(sketches(slim, shingle), "sketches")
    filled = drawn.where("n > 0 and doc_id is not null")
    classes = materialize(filled.groupBy("class").agg(F.min("doc_id").alias("cid")), "classes")
    chosen = drawn.join(classes.select("class", F.col("cid").alias("doc_id")), ["class", "doc_id"], "left_semi").where("n > 0")
    chosen = chosen.dropDuplicates(["class"]) if _several(chosen.groupBy("class").agg(F.count("*").alias("k"))) else chosen
    banded = chosen.select(F.col("doc_id").alias("cid"), "sig", F.explode("bands").alias("key"))
    full = banded.groupBy("key").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo < hi").select("key")
    full = materialize(full, "bands")
    members = matching(banded, "key", full)
    members = materialize(members, "members")
    links = _links(slim, members, shingle, threshold)
    out = drawn.select("doc_id", "n", "class").join(classes, "class", "left")
    texts = filled.groupBy("doc_id").agg(F.min("class").alias("x"), F.max("class").alias("y"))
    several = texts.where("x < y").select("doc_id")
    if several.limit(1).count():
        own = filled.join(several, "doc_id").join(classes, "class").select(F.col("doc_id").alias("a"), F.col("cid").alias("b")).distinct()
        links = own if links is None else links.unionByName(own)
    if links is not None:
        groups = connected_components(links, "a", "b").select(F.col("id").alias("cid"), "component")
        out = out.join(groups, "cid", "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("bigint"))
    component = F.when(F.col("n") > 0, F.coalesce("component", "cid")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"),
    )


def _several(counts: DataFrame) -> bool:
    return counts.where("k > 1").limit(1).count() > 0


def _links(docs: DataFrame, members: DataFrame, shingle: int, threshold: float) -> DataFrame | None:
    """``a, b``: confirmed links, enough of them to join every component; None if there is none.

    ``members``: ``key, cid, sig``, a row for each document of each bucket.
    """
    least = lowest_estimate(threshold)
    if not members.limit(1).count():
        return None
    hubs = members.groupBy("key").agg(F.min(F.struct("cid", "sig")).alias("hub"))
    spoked = members.join(hubs, "key").where("cid <> hub.cid")
    near = spoked.where(estimate(F.col("sig"), F.col("hub.sig")) >= least)
    pairs = materialize(near.select(F.col("hub.cid").alias("a"), F.col("cid").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    sets = materialize(_sets(docs, wanted, shingle), "sets")
    links = materialize(_confirmed(pairs, sets, threshold), "links")
    discard(sets)
    groups = connected_components(links, "a", "b").select(F.col("id").alias("cid"), "component")
    labelled = members.join(groups, "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")
    labelled = materialize(labelled, "labelled")
    mains = labelled.groupBy("key").agg(F.min(F.struct("cid", "comp"))["comp"].alias("main"), F.min("comp").alias("c"), F.max("comp").alias("d"))
    mains = mains.where("c < d").select("key", "main")
    mixed = materialize(labelled.join(mains, "key").withColumn("apart", F.col("comp") != F.col("main")).drop("main"), "apart")
    discard(labelled)
    if not mixed.limit(1).count():
        return links
    keys = mixed.groupBy("cid").agg(F.collect_set("key").alias("keys"))
    marked = materialize(_marked(mixed.join(keys, "cid"), threshold), "marked")
    if not marked.limit(1).count():
        return links
    sets = materialize(_sets(docs, marked.select("cid").distinct(), shingle), "sets")
    rest = materialize(mixed.join(marked, ["key", "cid"]).join(sets, "cid"), "rest")
    discard(sets)
    more = materialize(_rest(rest, threshold), "links")
    discard(rest)
    discard(mixed)
    return links.unionByName(more)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, threshold=0.85)


def near_stage(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id. All columns stay."""
    gone = near_duplicates(docs, shingle, threshold).where("not kept and doc_id is not null")
    gone = gone.select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
