"""Operators that compare texts or vectors with each other, against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import embedding_dedup, line_dedup, near_dedup, suffix_dedup
from tests.llm.conftest import prose


def distance_is_one(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute_lines(docs: list[tuple], least: int = line_dedup.LEAST) -> dict:
    """Line deduplication straight from its definition; doc ids are distinct and not null."""
    first: dict[str, tuple] = {}
    for d, text in sorted(docs):
        for n, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\r")
            if line:
                first.setdefault(line, (d, n))
    near = {
        x for x in first for y in first
        if first[y] < first[x] and min(len(x), len(y)) >= least and distance_is_one(x, y)
    }
    out = {}
    for d, text in docs:
        lines = [] if text is None else text.split("\n")
        stay = [s == "" or first[s] == (d, n) and s not in near for n, s in enumerate(x.strip(" \t\r") for x in lines)]
        full = sum(x.strip(" \t\r") != "" for x in lines)
        gone = sum(not s for s in stay)
        out[d] = (full, gone, None if text is None else "\n".join(x for x, s in zip(lines, stay, strict=True) if s))
    return out


def test_lines_within_one_edit(spark):
    r = random.Random(4)
    base = [prose(i, r.randrange(3, 40)) for i in range(25)] + ["x" * 300, "ab" * 100, prose(90, 300)]
    docs = []
    for d in range(120):
        lines = []
        for _ in range(r.randrange(0, 5)):
            line = r.choice(base)
            i = r.randrange(len(line))
            kind = r.randrange(6)
            if kind == 1:
                line = line[:i] + r.choice("zé😀") + line[i + 1 :]
            elif kind == 2:
                line = line[:i] + line[i + 1 :]
            elif kind == 3:
                line = line[:i] + "q" + line[i:]
            elif kind == 4:
                line = f"  {line}\t"
            lines.append(line)
        docs.append((d, "\n".join(lines) if d % 17 else None))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {x.doc_id: (x.n_lines, x.n_removed, x.kept) for x in line_dedup.dedup(df).collect()}
    assert got == brute_lines(docs)


def test_short_lines_within_one_edit(spark):
    r = random.Random(14)
    docs = [(d, "\n".join("".join(r.choice("abcé") for _ in range(r.randrange(7))) for _ in range(r.randrange(4)))) for d in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for least in (1, 4):
        got = {x.doc_id: (x.n_lines, x.n_removed, x.kept) for x in line_dedup.dedup(df, least).collect()}
        assert got == brute_lines(docs, least)


def test_lines_of_odd_tables(odd_docs, no_docs):
    got = line_dedup.dedup(odd_docs)
    rows = {x.doc_id: x for x in got.where("doc_id is not null").collect()}
    assert got.count() == odd_docs.count() and rows[1].kept is None and rows[2].kept == "" and rows[3].kept == " \t\n\r\n "
    # A null id comes first, so the shared text stays there; its near copy goes as well.
    assert rows[8].kept == rows[9].kept == "" and rows[10].n_removed in (0, 1)
    assert rows[13].n_lines == 3 and rows[13].n_removed == 1 and rows[14].n_removed == 1
    assert line_dedup.dedup(no_docs).count() == 0
    stage = line_dedup.line_stage(odd_docs)
    assert stage.columns == odd_docs.columns and stage.where("doc_id in (8, 9)").count() == 0
    assert {x.doc_id for x in stage.collect()} >= {1, 2, 3, 4, 6, 13, 15}


def brute_near(docs: list[tuple], size: int, hundredths: int) -> dict:
    sets = {}
    for d, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= hundredths * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), top(d), top(d) == d) for d, s in sets.items()}


def test_near_duplicates(spark):
    r = random.Random(8)
    docs = []
    for d in range(240):
        words = prose(d % 40, 30 + d % 40 * 3).split(" ")
        for _ in range(r.randrange(4)):
            words[r.randrange(len(words))] = f"new{d}"
        docs.append((d * 3, " ".join(words).upper() if d % 11 == 0 else " ".join(words)))
    docs += [(1000, None), (1001, ""), (1002, "Two words"), (1003, "two  WORDS"), (1004, "\xa0"), (1005, "two")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for size, threshold in ((3, 0.85), (5, 0.8)):
        got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_dedup.near_duplicates(df, size, threshold).collect()}
        assert got == brute_near(docs, size, round(threshold * 100))


def test_a_group_without_a_common_centre(spark):
    """A chain: neighbours are near, the ends aren't, so a bucket needs more than one hub."""
    words = prose(77, 400).split(" ")
    docs = [(d, " ".join([f"n{i}" if i < 5 * d else w for i, w in enumerate(words)])) for d in range(30)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(df, 3, 0.85).collect()}
    assert got == {d: v[1] for d, v in brute_near(docs, 3, 85).items()}


def test_rest_of_a_bucket_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SIDE", 8)
    monkeypatch.setattr(near_dedup, "ACROSS", 64)
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 2**62, 50).astype(np.uint64)) for _ in range(300)]
    sets += [np.unique(np.concatenate((s[:-2], [np.uint64(i)]))) for i, s in enumerate(sets[:40])]
    rows = [
        (1, i, i, i >= 280, [int(x) for x in near_dedup.packed(near_dedup.minima(s)).view(np.int64)], s.tobytes())
        for i, s in enumerate(sets)
    ]
    members = spark.createDataFrame(rows, "key bigint, cid bigint, comp bigint, apart boolean, sig array<bigint>, shingles binary")
    assert {tuple(x) for x in near_dedup._rest(members, 0.85).collect()} == {(i, i + 300) for i in range(40)}
    monkeypatch.setattr(near_dedup, "SIGNED", 50)
    monkeypatch.setattr(near_dedup, "FULL", 50)
    members = members.unionByName(members.withColumn("key", F.lit(2).cast("bigint"))).withColumn("keys", F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")))
    assert {tuple(x) for x in near_dedup._rest(members, 0.85).collect()} == {(i, i + 300) for i in range(40)}
    found = near_dedup._marked(members.drop("shingles"), 0.85).collect()
    assert {x.key for x in found} == {1}
    marked = {x.cid for x in found}
    assert marked >= {*range(40), *range(300, 340)} and len(marked) < 200
    # One component has nothing to join.
    assert near_dedup._marked(members.drop("shingles").withColumn("comp", F.lit(5).cast("bigint")), 0.85).count() == 0


def test_documents_of_several_texts(spark):
    """Rows of one id are one document: it is linked by each of its texts."""
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    docs = [(1, a), (2, a + " more"), (2, b), (3, b + " words"), (4, c), (5, c + " too"), (5, c + " too"), (5, ""), (6, prose(6, 80)), (6, prose(7, 80)), (6, c)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted((x.doc_id, x.n_shingles > 0, x.component_id) for x in near_dedup.near_duplicates(df, 3, 0.85).collect())
    assert got == [(1, True, 1), (2, True, 1), (2, True, 1), (3, True, 1), (4, True, 4), (5, False, 5), (5, True, 4), (5, True, 4), (6, True, 4), (6, True, 4), (6, True, 4)]


def test_estimate_is_corrected_for_chance(spark):
    r = np.random.default_rng(2)
    a = r.integers(0, 2**62, near_dedup.MINIMA).astype(np.uint64)
    for share in (0.0, 0.5, 0.9, 1.0):
        b = np.where(r.random(near_dedup.MINIMA) < share, a, r.integers(0, 2**62, near_dedup.MINIMA).astype(np.uint64))
        rows = [([int(x) for x in near_dedup.packed(v).astype(np.int64)]) for v in (a, b)]
        df = spark.createDataFrame([tuple(rows)], "x array<bigint>, y array<bigint>")
        got = df.select(near_dedup.estimate(F.col("x"), F.col("y"))).first()[0]
        assert abs(got - float((a == b).mean())) < 0.12


def test_near_duplicates_of_odd_tables(odd_docs, no_docs):
    got = near_dedup.near_duplicates(odd_docs, 3, 0.85)
    rows = collections.defaultdict(set)
    for x in got.collect():
        rows[x.doc_id].add((x.component_id, x.kept))
    assert got.count() == odd_docs.count() and rows[None] == {(None, False)} and rows[7] == {(6, False)}
    assert rows[8] == {(8, True)} and rows[9] == {(8, False)} and rows[1] == {(1, True)} and rows[4] == {(4, True)}
    assert near_dedup.near_duplicates(no_docs).count() == 0
    stage = near_dedup.near_stage(odd_docs)
    assert stage.columns == odd_docs.columns and stage.where("doc_id in (7, 9)").count() == 0 and stage.where("doc_id is null").count() == 2


def brute_repeats(docs: list[tuple], window: int) -> list[tuple]:
    data = [(d, (t or "").encode()) for d, t in docs]
    seen = collections.Counter(b[i : i + window] for _, b in data for i in range(len(b) - window + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = True
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("window,gram,large", [(400, 50, 20_000), (40, 12, 20_000), (40, 12, 3)])
def test_repeated_strings(spark, monkeypatch, window, gram, large):
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    r = random.Random(window)
    pieces = [prose(i, 60) for i in range(8)] + ["ab" * 300, "é" * 250, "x" * 900]
    docs = []
    for d in range(60):
        text = "".join(r.choice(pieces)[r.randrange(50) :] + prose(1000 + d, r.randrange(40)) for _ in range(r.randrange(4)))
        docs.append((d, text if d % 13 else None))
    docs += [(100, docs[7][1]), (100, docs[7][1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = suffix_dedup.remove_repeats(df, window, gram).collect()
    key = lambda x: (x[0], x[1])
    assert sorted([(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got], key=key) == sorted(brute_repeats(docs, window), key=key)


def test_repeated_strings_of_odd_tables(odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect() if r.doc_id not in (6, 7)]
    df = odd_docs.where("doc_id is null or doc_id not in (6, 7)")
    got = suffix_dedup.remove_repeats(df).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    assert sorted([(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got], key=key) == sorted(brute_repeats(docs, 400), key=key)
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_a_text_longer_than_a_pass(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    suffix_dedup.Hasher.constants.cache_clear()
    text = prose(3, 900)
    found = suffix_dedup.anchors(np.frombuffer(text.encode(), np.uint8), 400, 50)
    suffix_dedup.Hasher.constants.cache_clear()
    starts = sorted(x for p, lo, hi in zip(found["pos"], found["lo"], found["hi"], strict=True) for x in range(p - hi, p - lo + 1))
    assert starts == list(range(len(text.encode()) - 399))


def family_of(batches: list[list[str]], window: int, gram: int) -> tuple[suffix_dedup.SuffixFamily, set]:
    """A family of the batches' stretches, and the windows that it found to repeat."""
    family, all_ = suffix_dedup.SuffixFamily(window, gram), []
    for batch in batches:
        stretches = []
        for text in batch:
            data = np.frombuffer(text.encode(), np.uint8)
            found = suffix_dedup.anchors(data, window, gram)
            for p, lo, hi, inner in zip(*(found[k].tolist() for k in ("pos", "lo", "hi", "inner")), strict=True):
                stretches.append((data[p - hi : p - lo + window].tobytes(), hi, False, inner))
        family.add(stretches)
        all_ += [s[0] for s in stretches]
    assert [len(m) for m in family.marks] == [len(t) - window + 1 for t in all_]
    return family, {t[i : i + window] for t, m in zip(all_, family.marks, strict=True) for i, x in enumerate(m) if x}


def repeated(batches: list[list[str]], window: int) -> set:
    texts = [t.encode() for batch in batches for t in batch]
    seen = collections.Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    return {w for w, n in seen.items() if n > 1}


def mosaics(seed: int, n: int) -> list[list[str]]:
    """Batches of texts that share parts of many lengths, periodic ones as well."""
    r = random.Random(seed)
    pool = [prose(i, 30) for i in range(6)] + ["ab" * 60, "=" * 90, "abc" * 20 + "x" + "abc" * 20]
    cut = lambda t: t[r.randrange(len(t) // 2) : len(t) - r.randrange(len(t) // 2)]
    return [["".join(cut(r.choice(pool)) for _ in range(r.randrange(1, 6))) + prose(100 * seed + k, 12) for _ in range(4)] for k in range(n)]


@pytest.mark.parametrize("seed", range(8))
def test_the_family_finds_what_repeats(seed):
    batches = mosaics(seed, 7)
    family, found = family_of(batches, 40, 12)
    assert found == repeated(batches, 40)
    assert [size for size, _ in family.levels] == [2, 1, 0]
    for _, level in family.levels:
        assert level == sorted(level) and all(family.places[i][1] >= 0 for _, i in level)


def test_repeated_words_start_few_suffixes(monkeypatch):
    """A place of the gram starts a suffix only if it is the last one in a window; pairs are compared once, as the later comes."""
    r = random.Random(4)
    texts = [prose(50 + k, 20) + " the" * r.randrange(110, 200) + prose(80 + k, 20) for k in range(12)]
    batches, compared = [texts[:4], texts[4:8], texts[8:]], []
    shared = suffix_dedup.shared
    monkeypatch.setattr(suffix_dedup, "shared", lambda a, b: compared.append(1) or shared(a, b))
    family, found = family_of(batches, 400, 50)
    assert found == repeated(batches, 400)
    of = collections.Counter(number for number, _, _ in family.places)
    windows = [len(m) for m in family.marks]
    assert max(of.values()) > 50 and all(n <= 2 + windows[k] // 4 for k, n in of.items())
    assert len(compared) < 8 * len(family.places)


def test_the_family_needs_its_order(monkeypatch):
    """With levels out of order the merge scan misses what repeats."""
    batches = mosaics(1, 7)

    def shuffled(self, a, b):
        out = a + b
        random.Random(5).shuffle(out)
        return out

    monkeypatch.setattr(suffix_dedup.SuffixFamily, "_merged", shuffled)
    assert family_of(batches, 40, 12)[1] < repeated(batches, 40)


@pytest.mark.parametrize("text", ["=" * 200_000, "-- " * 66_667, "abcdefg" * 400 + prose(5, 200) + "abcdefg" * 400])
def test_stretches_of_periodic_texts(spark, text):
    data = np.frombuffer(text.encode(), np.uint8)
    found = suffix_dedup.anchors(data, 400, 50)
    assert len(found["pos"]) < len(data) / 50
    starts = [x for p, lo, hi in zip(found["pos"], found["lo"], found["hi"], strict=True) for x in range(p - hi, p - lo + 1)]
    assert starts == list(range(len(data) - 399)) and (found["lo"] >= 0).all() and (found["hi"] <= 350).all()
    docs = [(1, text), (2, text[:450]), (3, prose(9, 100))]
    if len(text) < 10_000:
        got = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
        assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got) == brute_repeats(docs, 400)
    alone = suffix_dedup.remove_repeats(spark.createDataFrame([(1, "=" * 401), (2, "=" * 400 + "x" * 399)], "doc_id bigint, text string"))
    assert {x.doc_id: x.n_removed for x in alone.collect()} == {1: 401, 2: 400}


def brute_vectors(rows: list[tuple], cosine: float) -> dict:
    ok = [r for r in rows if r[1] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links, parent = collections.Counter(), {r[0]: r[0] for r in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ok):
        for b in ok[i + 1 :]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                    links[a[0]] += 1
                    links[b[0]] += 1
                    p, q = top(a[0]), top(b[0])
                    parent[max(p, q)] = min(p, q)
    return {r[0]: (links[r[0]], top(r[0]), top(r[0]) == r[0]) for r in rows}


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PER_PIVOT", 20)
    monkeypatch.setattr(embedding_dedup, "SIDE", 16)
    monkeypatch.setattr(embedding_dedup, "ACROSS", 24)
    r = np.random.default_rng(6)
    centres = r.normal(size=(30, 16))
    rows = []
    for i in range(300):
        v = centres[i % 30] + r.normal(scale=r.choice([0.02, 0.1, 0.4]), size=16)
        rows.append((i * 2, [float(np.float32(x)) for x in v], int(i % 3) if i % 10 else None))
    rows += [(1001, rows[1][1], rows[1][2]), (1003, rows[1][1], rows[1][2]), (1005, None, 1), (1007, [0.0] * 16, 1), (1009, [float("nan")] + [1.0] * 15, 1)]
    rows += [(1011, [None] + [1.0] * 15, 1), (1013, [], 1), (1015, [1.0, 2.0], 1), (1017, [2.0, 4.0], 1), (1019, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumns({"v": F.lit(1), "u": F.lit(2), "cid": F.lit(3), "copies": F.lit(4)})
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding_dedup.link(df).collect()}
    assert got == brute_vectors(rows, 0.98)
    assert embedding_dedup.link(df.limit(0)).count() == 0
    null = df.limit(1).withColumn("vec_id", F.lit(None).cast("bigint"))
    assert tuple(embedding_dedup.link(null).first()) == (None, 0, None, False)


def test_vectors_of_one_id(spark):
    """Rows of one id count one by one for others; the id has the most links of its rows, and joins their components."""
    x, y = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, x, 0), (2, x, 0), (2, y, 0), (3, y, 0), (4, [1.0, 0.01], 0), (5, x, 1)]
    got = {tuple(r) for r in embedding_dedup.link(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert got == {(1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 2, 1, False), (5, 0, 5, True)}


def test_far_cells_are_not_visited(spark):
    """Clustered vectors stay in their cell, and no link is lost where cells meet."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 8))
    rows = [(i, [float(x) for x in centres[i % 12] + r.normal(scale=0.05, size=8)], 1) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    u = F.transform("embedding", lambda x: x / F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, b: a + b * b)))
    same = df.select(F.col("vec_id").alias("cid"), "label", F.lit(0).cast("bigint").alias("h"), F.lit(1).cast("bigint").alias("copies"), F.col("embedding").alias("v"), u.alias("u"))
    embedding_dedup.PER_PIVOT, kept = 50, embedding_dedup.PER_PIVOT
    try:
        cells = embedding_dedup._homes(same, 0.2).collect()
    finally:
        embedding_dedup.PER_PIVOT = kept
    assert sum(c.own for c in cells) == 600 and len(cells) < 600 * 6


def test_lines_are_split_once(spark, odd_docs):
    lines = line_dedup.lines_of(odd_docs)
    for df in (lines, line_dedup._gap_keys(lines, 1), line_dedup._variants(lines.withColumn("first", F.lit(1)))):
        # A filter by the size of an exploded array would make the array twice.
        assert "size(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_suffix_dedup_query_returns_what_stays(spark, tmp_path):
    """A passage of two texts goes, one of under 400 bytes stays; a cut may divide a character."""
    long, short = "".join(f"passage {i} " for i in range(60)), "".join(f"bit {i} " for i in range(55))
    texts = ["head \u00e9" + long + " tail", "\u00e8" + long, short + "one", "two " + short, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in suffix_dedup.op4_suffix_dedup(spark, str(tmp_path)).collect()}
    n = len(long)
    assert len(short) < 400 < n
    assert [rows[i].text for i in range(5)] == ["head \u00e9 tail", "\u00e8", texts[2], texts[3], ""]
    assert [rows[i].spans for i in range(5)] == [f"7:{7 + n}", f"2:{2 + n}", "", "", ""]
    cut = ["a\u00e9" + long, "\u00a9" + long]  # \u00e9 and \u00a9 share their last byte
    docs = spark.createDataFrame(list(enumerate(cut)), "doc_id bigint, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/more/documents.parquet")
    more = {r.doc_id: r for r in suffix_dedup.op4_suffix_dedup(spark, f"{tmp_path}/more").collect()}
    assert (more[0].text, more[0].spans, more[0].n_removed) == ("a\ufffd", f"2:{3 + n}", n + 1)
    assert hashlib.sha256(more[0].text.encode()).hexdigest() != more[0].kept_sha256 == hashlib.sha256(b"a\xc3").hexdigest()
