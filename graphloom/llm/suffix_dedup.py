"""Removal of long repeated byte strings with logarithmic families of suffix arrays.

A window is a string of ``WINDOW`` bytes. Each picks the smallest of its grams' hashes, so equal windows
pick equal grams, wherever they stand. Neighbouring windows share a pick, so a text becomes stretches of
windows, each with the place of its gram; equal stretches are one kind with a count. The suffixes that
are indexed start at those places: about one in 170, and any two equal windows start that near before two
suffixes with one gram. Grams that one stretch alone has are done, others are dealt to buckets.

A bucket's index is a logarithmic family. Its stretches come in batches: a batch gets a suffix array, its
suffixes in the order of their bytes, is merge-scanned against the arrays of all levels for long matches,
and joins the family, where two levels of one size merge into one of twice the size. A match is what two
suffixes share from their places on and, before them, backwards; where both together are as long as a
window, the windows in it repeat. Suffixes are met in falling order of the length they share, each with
its neighbours by what precedes it only, so no group is compared pair by pair.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_map, bitmap, matching, materialize, only, sift, table
from graphloom.session import discard

WINDOW = 400
GRAM = 50
#: Windows that one pass over a text takes; longer texts take more passes.
CHUNK = 1 << 20
#: Kinds of stretches in a batch, and in a bucket.
BATCH, TOGETHER = 512, 2_000
#: Kinds of one gram up to which they are in one bucket; beyond, their windows are dealt one by one.
LARGE = 5_000

KIND = ("q", "lo", "hi", "c1", "c2")
ENTRY = "doc_id bigint, th bigint, pos bigint, q bigint, lo int, hi int, c1 bigint, c2 bigint, inner boolean"


class Hasher:
    """Hashes of all substrings of a text, two of 64 bits each, from sums of weighted bytes."""

    @staticmethod
    @lru_cache(maxsize=1)
    def constants() -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        draw = np.random.default_rng(20240301)
        bytes_ = draw.integers(0, 2**64, (2, 256), np.uint64, endpoint=False)
        up, down = [], []
        for k in range(2):
            factor = int(draw.integers(0, 2**63, 1, np.uint64)[0]) * 2 + 1 & (1 << 64) - 1
            for powers, f in ((up, factor), (down, pow(factor, -1, 1 << 64))):
                x = np.ones(CHUNK + WINDOW + 1, np.uint64)
                x[1:] = np.uint64(f)
                powers.append(np.multiply.accumulate(x))
        return bytes_, up, down

    def __init__(self, data: np.ndarray):
        bytes_, up, self.down = self.constants()
        n = len(data)
        self.sums = []
        for k in range(2):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(bytes_[k][data] * up[k][:n], out=sums[1:])
            self.sums.append(sums)

    def of(self, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[k][end] - self.sums[k][start]) * self.down[k][start]

    def runs(self, k: int, length: int) -> np.ndarray:
        """Of all substrings of one length."""
        n = len(self.sums[k]) - length
        return (self.sums[k][length:] - self.sums[k][:n]) * self.down[k][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(data: np.ndarray, window: int):
    """Parts of a text, each with its offset; every window starts in exactly one."""
    for at in range(0, len(data) - window + 1, CHUNK):
        yield at, data[at : at + CHUNK + window - 1]


def anchors(data: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray] | None:
    """``pos, q, lo, hi, c1, c2, inner`` of a text's stretches.

    The windows that picked the gram at ``pos`` start from ``pos - hi`` to ``pos - lo``; ``c1, c2`` hash
    all their text. ``inner`` tells that they hold the gram more than once, so that windows of one
    stretch may be equal.
    """
    out = []
    for at, part in chunks(data, window):
        h = Hasher(part)
        grams = _mixed(h.runs(0, gram))
        low = np.uint64((1 << 21) - 1)
        # Of equal grams in a window the last one is picked, which stays in the window for longest.
        order = grams & ~low | low - np.arange(len(grams), dtype=np.uint64)
        span, width = window - gram + 1, 1
        least = order
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(order) - span + 1], least[span - width :])
        chosen = (low - (least & low)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        pos = chosen[first]
        first, pos, inner = _steady(first, pos, grams[pos], len(chosen))
        last = np.concatenate((first[1:] - 1, [len(chosen) - 1]))
        out.append(
            (pos + at, grams[pos].view(np.int64), pos - last, pos - first,
             h.of(0, first, last + window).view(np.int64), h.of(1, first, last + window).view(np.int64), inner)
        )
    if not out:
        return None
    return dict(zip(("pos", "q", "lo", "hi", "c1", "c2", "inner"), map(np.concatenate, zip(*out, strict=True)), strict=True))


def _steady(first: np.ndarray, pos: np.ndarray, q: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches in which a place is left only when it leaves the window, though others hold equal grams.

    Periodic text would else change its place with every window.
    """
    same = q[1:] == q[:-1]
    inner = np.zeros(len(first), bool)
    if not same.any():
        return first, pos, inner
    keep = np.concatenate(([True], ~same))
    turns = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
    for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):  # entries a to b have one gram
        end = first[b + 1] if b + 1 < len(first) else windows
        at = a
        while True:
            inner[at] = at < b
            until = pos[at] + 1  # the first window without this place
            if until >= end:
                break
            # The last entry that starts at or before that window holds it.
            after = int(np.searchsorted(first[a : b + 1], until, "right")) + a - 1
            if after <= at:
                break
            first[after] = max(first[after], until)
            keep[after], at = True, after
    return first[keep], pos[keep], inner[keep]


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def stretches(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The stretches of ``doc_id, th, text``."""
    names = ("pos", "q", "lo", "hi", "c1", "c2", "inner")

    def make():
        def run(c):
            out: dict[str, list] = {k: [] for k in ("doc_id", "th", *names)}
            for doc, th, text in zip(c["doc_id"], c["th"], c["text"], strict=True):
                found = anchors(_bytes(text), window, gram)
                if found:
                    n = len(found["pos"])
                    out["doc_id"] += [doc] * n
                    out["th"] += [th] * n
                    for k, x in found.items():
                        out[k].append(x)
            kinds = {"lo": np.int32, "hi": np.int32, "inner": bool}
            return out | {k: np.concatenate(out[k]).astype(kinds.get(k, np.int64)) if out[k] else [] for k in names}

        return run

    return arrow_map(docs, make, ENTRY)


Suffixes = list[tuple[bytes, int]]


def shared(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8


class SuffixFamily:
    """Levels of suffix arrays, the sizes of which double.

    An array holds ``(suffix, number)`` in the order of the suffixes' bytes. ``marks`` has, for each text
    added, a mark for each of its windows that is found to repeat.
    """

    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.levels: list[tuple[int, Suffixes]] = []
        self.marks: list[bytearray] = []
        #: Of each suffix: its text's number, its place there, and what precedes it, backwards.
        self.places: list[tuple[int, int, bytes]] = []

    def add(self, stretches: list[tuple[bytes, int, bool, bool]]) -> None:
        """A batch of stretches: text, place of the gram, whether the text stands in several places, and
        whether it may hold the gram again; then every place that is a window's last one starts a suffix:
        equal windows have their last place in common, and a stretch of one place has that one."""
        array: Suffixes = []
        old = len(self.places)
        for text, place, several, inner in stretches:
            own = text[place : place + self.gram]
            at = text.rfind(own, 0, self.window) if inner else place
            while at >= 0:
                array.append((text[at:], len(self.places)))
                self.places.append((len(self.marks), at, text[:at][::-1]))
                at = text.find(own, at + 1) if inner else -1
            self.marks.append(bytearray([several]) * max(0, len(text) - self.window + 1))
        array.sort()
        runs = self._runs(array)
        for run in runs:
            self._settle(run)
        for _, level in self.levels:
            self._scan(runs, level, old)
        self.levels.append((0, array))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((size + 1, self._merged(b, a)))

    def _merged(self, a: Suffixes, b: Suffixes) -> Suffixes:
        both = a + b
        both.sort()  # two ascending runs: one merge
        return both

    def _runs(self, array: Suffixes) -> list[Suffixes]:
        """Neighbours that start with one gram."""
        runs: list[Suffixes] = []
        for x in array:
            if runs and x[0].startswith(runs[-1][0][0][: self.gram]):
                runs[-1].append(x)
            else:
                runs.append([x])
        return runs

    def _scan(self, runs: list[Suffixes], level: Suffixes, old: int) -> None:
        """Settle the batch's runs with the level's suffixes that start alike; its place only moves forward.

        The batch's suffixes are those from ``old`` on.
        """
        at = 0
        for run in runs:
            head = run[0][0][: self.gram]
            at = first = bisect_left(level, (head,), at)
            while at < len(level) and level[at][0].startswith(head):
                at += 1
            if at > first:
                self._settle(self._merged(level[first:at], run), old)

    def _settle(self, run: Suffixes, old: int = 0) -> None:
        """Mark the windows in the long matches among suffixes that are in order.

        Neighbours' suffixes join in falling order of the length they share, and with them all that
        share as much. In each such set the longest match of a suffix is with one of its two neighbours
        in the order of what precedes them, so only new neighbours are looked at. Two suffixes before ``old``,
        or two after, were settled when the later one came.
        """
        before = [self.places[i][2] for _, i in run]
        longest = max(map(len, before))
        sets = [[(left, k)] for k, left in enumerate(before)]
        edges = sorted(((shared(a[0], b[0]), k) for k, (a, b) in enumerate(pairwise(run))), reverse=True)
        top = list(range(len(run)))  # a set spans neighbours, and both its ends know the index of its list
        fresh = [i >= old for _, i in run]

        def meet(x: tuple[bytes, int], y: tuple[bytes, int], right: int) -> None:
            if old and fresh[x[1]] == fresh[y[1]]:
                return
            left = shared(x[0], y[0])
            if left + right >= self.window:
                for _, k in (x, y):
                    number, at, _ = self.places[run[k][1]]
                    marks = self.marks[number]
                    low, high = at - left, min(len(marks), at + right - self.window + 1)
                    marks[low:high] = b"\1" * (high - low)

        spans = [(k, k) for k in range(len(run))]
        for right, k in edges:
            if right + longest < self.window:
                break
            a, b = top[k], top[k + 1]
            low, high = spans[a][0], spans[b][1]
            many, few = (sets[a], sets[b]) if len(sets[a]) >= len(sets[b]) else (sets[b], sets[a])
            for x in few:
                i = bisect_left(many, x)
                if i:
                    meet(many[i - 1], x, right)
                if i < len(many):
                    meet(x, many[i], right)
                many.insert(i, x)
            sets[a], spans[a] = many, (low, high)
            top[low] = top[high] = a


def marked_runs(marks: bytes | bytearray) -> list[tuple[int, int]]:
    """Maximal ranges of marks that are set."""
    turns = np.flatnonzero(np.diff(np.frombuffer(b"\0" + bytes(marks) + b"\0", np.int8))).tolist()
    return list(zip(turns[::2], turns[1::2], strict=True))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, th, spans``: byte ranges covered by windows that also start elsewhere.

    ``docs``: ``doc_id, th, text``, th the text's hash. A row's ranges may overlap.
    """
    entries = materialize(stretches(docs, window, gram), "stretches")
    place = F.min(F.struct("doc_id", "th", "pos")).alias("rep")
    kinds = materialize(entries.groupBy(*KIND).agg(F.count("*").alias("n"), F.max("inner").alias("inner"), place), "kinds")
    grams = kinds.groupBy("q").agg(F.sum("n").alias("all"), F.max("inner").alias("some"), F.count("*").alias("k"))
    grams = materialize(grams.where("all > 1 or some").select("q", (F.col("k") > LARGE).alias("large")), "grams")
    parts = matching(kinds, "q", grams).select("rep.*", *KIND, (F.col("n") > 1).alias("several"), "inner", "large")
    asked = parts.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*KIND, "pos", "several", "inner", "large")).alias("parts"))
    asked = materialize(asked.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "parts"), "asked")
    discard(kinds)
    near = sift(docs, "th", bitmap(asked, "t"))
    there = near.join(asked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    # Rows that repeat an id and a text ask for the same stretches: one of them is enough.
    there = there.select("doc_id", "th", "text", "parts").dropDuplicates(["doc_id", "th"]) if _repeats(there) else there
    brought = materialize(_brought(there.select("text", "parts"), window), "brought")
    found = _indexed(brought.where("not large"), window, gram)
    if brought.where("large").limit(1).count():
        found = found.unionByName(_dealt(brought.where("large"), window))
    found = materialize(found.withColumn("key", F.xxhash64(*KIND)), "found")
    discard(brought)
    alike = sift(entries.withColumn("key", F.xxhash64(*KIND)), "key", bitmap(found, "key")).drop("key")
    alike = alike.join(found.drop("key"), list(KIND)).select("doc_id", "th", (F.col("pos") - F.col("hi")).alias("at"), F.explode("runs").alias("run"))
    spans = F.struct((F.col("at") + F.col("run.s")).alias("s"), (F.col("at") + F.col("run.e") - 1 + window).alias("e"))
    return alike.groupBy("doc_id", "th").agg(F.collect_set(spans).alias("spans"))


def _repeats(there: DataFrame) -> bool:
    return there.groupBy("doc_id", "th").count().where("count > 1").limit(1).count() > 0


PART = "q bigint, lo int, hi int, c1 bigint, c2 bigint, several boolean, inner boolean, large boolean, bytes binary"
FOUND = "q bigint, lo int, hi int, c1 bigint, c2 bigint, runs array<struct<s: int, e: int>>"


def _brought(docs: DataFrame, window: int) -> DataFrame:
    """A row for each asked stretch with the text of its windows."""

    def make():
        def run(c):
            out: dict[str, list] = {k: [] for k in (*KIND, "several", "inner", "large", "bytes")}
            for text, parts in zip(c["text"], c["parts"], strict=True):
                data = _bytes(text).tobytes()
                for p in parts:
                    for k in (*KIND, "several", "inner", "large"):
                        out[k].append(p[k])
                    out["bytes"].append(data[p["pos"] - p["hi"] : p["pos"] - p["lo"] + window])
            return out

        return run

    return arrow_map(docs, make, PART)


def _indexed(parts: DataFrame, window: int, gram: int) -> DataFrame:
    """``FOUND``: for each kind the ranges of its windows that repeat, by a family for each bucket.

    Equal windows have equal grams ``q``, so stretches may be dealt by it; a bucket has about ``TOGETHER``
    of them, and no gram has more than ``LARGE``.
    """
    n = max(1, parts.count() // TOGETHER)
    schema = pa.schema([(k, pa.int32() if k in ("lo", "hi") else pa.int64()) for k in KIND] + [("runs", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))])

    def index(rows: pa.Table) -> pa.Table:
        family = SuffixFamily(window, gram)
        columns = (rows[k].to_pylist() for k in ("bytes", "hi", "several", "inner"))
        every = list(zip(*columns, strict=True))  # a stretch's first window starts ``hi`` before its gram
        for i in range(0, len(every), BATCH):
            family.add(every[i : i + BATCH])
        runs = [[{"s": s, "e": e} for s, e in marked_runs(m)] for m in family.marks]
        out = rows.select(list(KIND)).append_column("runs", pa.array(runs, schema.field("runs").type)).cast(schema)
        return out.filter(pa.array([bool(r) for r in runs], pa.bool_()))

    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("q"), F.lit(n)))
    return dealt.groupBy("bucket").applyInArrow(index, FOUND)


def window_hashes(text: bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
    h = Hasher(np.frombuffer(text, np.uint8))
    return h.runs(0, window), h.runs(1, window)


def _dealt(parts: DataFrame, window: int) -> DataFrame:
    """The same, for grams of so many kinds that their windows are dealt one by one, by two hashes of all their bytes.

    Windows of one batch that are equal are counted before they are dealt.
    """

    def make():
        def run(c):
            out: dict[str, list] = {k: [] for k in (*KIND, "i", "several", "w1", "w2")}
            for row in zip(*(c[k] for k in KIND), c["several"], c["bytes"], strict=True):
                one, two = window_hashes(row[-1], window)
                for k, x in zip((*KIND, "several"), row[:-1], strict=True):
                    out[k] += [x] * len(one)
                out["i"].append(np.arange(len(one), dtype=np.int32))
                out["w1"].append(one.view(np.int64))
                out["w2"].append(two.view(np.int64))
            return out | {k: np.concatenate(out[k]) if out[k] else [] for k in ("i", "w1", "w2")}

        return run

    hashed = arrow_map(parts, make, "q bigint, lo int, hi int, c1 bigint, c2 bigint, i int, several boolean, w1 bigint, w2 bigint")
    windows = materialize(hashed, "windows")
    counts = windows.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.max("several").alias("more"))
    hit = windows.join(counts.where("n > 1 or more").select("w1", "w2"), ["w1", "w2"], "left_semi")
    starts = hit.groupBy(*KIND).agg(F.collect_list(F.struct(F.col("i").alias("s"), (F.col("i") + 1).alias("e"))).alias("runs"))
    return starts


def merged_runs(spans: list) -> list[tuple[int, int]]:
    """Maximal runs of byte ranges, ascending."""
    runs: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    return [(s, e) for s, e in runs]


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, runs, kept`` of every row; ``kept`` is what stays, as bytes.

    A byte goes if a string of ``window`` bytes that covers it starts anywhere else too, in the same
    text or another; strings are judged on the input. All occurrences go, the first one too. Null texts
    count as empty. Repeated rows repeat each other's strings. Extra columns are left out.
    """
    slim = only(docs, "doc_id", "text").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    slim = slim.withColumn("th", F.xxhash64("text"))
    spans = repeated_spans(slim, window, gram)
    spans = spans.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "spans")
    both = slim.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")

    def make():
        def run(c):
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "runs", "kept")}
            out["doc_id"] = c["doc_id"]
            for text, found in zip(c["text"], c["spans"], strict=True):
                data = _bytes(text).tobytes()
                runs = merged_runs(found or [])
                ends = [0, *(x for r in runs for x in r), len(data)]
                out["n_bytes"].append(len(data))
                out["n_removed"].append(sum(e - s for s, e in runs))
                out["n_spans"].append(len(runs))
                out["runs"].append([{"s": s, "e": e} for s, e in runs])
                out["kept"].append(b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
            return out

        return run

    return arrow_map(
        both.select("doc_id", "text", "spans"), make,
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, runs array<struct<s: bigint, e: bigint>>, kept binary",
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the digest, then ``text``, what stays (a character that a cut divides is U+FFFD), and ``spans``,
    the removed runs as ``start:end`` in bytes, comma-joined."""
    done = remove_repeats(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("runs", lambda r: F.concat_ws(":", r["s"], r["e"])), ",")
    return done.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"), spans.alias("spans"),
    )
