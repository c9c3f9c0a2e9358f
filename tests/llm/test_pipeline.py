"""The stages one by one, and the rows of the whole beside a brute-force pipeline."""

import collections
import random

import pytest

from tests.llm.conftest import prose

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "mixing sources", "byte-level BPE"]
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, "").cache()
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if k == 0:
            # 11 and 12 repeat one letter: whether that tells a language is the model's affair.
            assert {r.doc_id for r in docs.collect()} - {11, 12} == {4, 5, 6, 7, 8, 9, 10, 13, 14, 16, None}
        if k == 1:
            assert docs.where("length(text) <> n_chars").count() == 0 and docs.where("doc_id in (8, 9)").count() == 0
        if k == 2:
            assert docs.where("doc_id = 7").count() <= 1
    assert docs.where("not round_trip").count() == 0 and counts[0] >= counts[1] >= counts[2] > 0


def test_run(spark, tmp_path, odd_docs):
    odd_docs.select("doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "source", "lang", "n_tokens", "token_ids", "round_trip"] and out.count() > 0


def brute_pipeline(rows):
    """The five stages one document at a time: (doc_id, token ids) of each emitted copy."""
    from tests.llm.test_dedup import brute_lines, brute_near
    from tests.llm.test_texts import LIBRARY, brute_mix

    docs = {d: (text, source) for d, text, _, source in rows if any(c.isalpha() for c in text or "")}
    lines = brute_lines([(d, text) for d, (text, _) in docs.items()])
    docs = {d: (lines[d][2], source) for d, (_, source) in docs.items() if lines[d][0] == 0 or lines[d][1] < lines[d][0]}
    near = brute_near([(d, text) for d, (text, _) in docs.items()], 5, 80)
    docs = {d: x for d, x in docs.items() if near[d][2]}
    out = collections.Counter()
    for d, size, _, _, taken in brute_mix([(d, *x) for d, x in docs.items()]):
        out[d, tuple(LIBRARY.encode_ordinary(docs[d][0]))] += taken // size
    return +out


def test_run_equals_brute_force(spark, tmp_path):
    r = random.Random(17)
    rows = []
    for i in range(70):
        text = "\n".join(prose(r.randrange(25) if k else 100 + i, r.randrange(5, 40)) for k in range(r.randrange(1, 5)))
        if i % 9 == 1:
            text = rows[-1][1].replace("river", "rivers", 1)
        rows.append((i, "12 34 !" if i % 23 == 7 else text, None if i % 10 == 3 else "en", f"s{i % 4}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((x.doc_id, tuple(x.token_ids)) for x in out) == brute_pipeline(rows)
    assert {x.lang for x in out} == {"en"} and all(x.round_trip for x in out)


def test_run_of_odd_tables(spark, tmp_path, no_docs):
    columns = ("doc_id", "text", "lang", "source")
    no_docs.select(*columns).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    # Nothing is labelled, and each row stands three times.
    rows = [(i, prose(i, 50), None, "ab"[i % 2]) for i in range(20)] * 3
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/same/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/same").collect()
    assert len(out) > 20 and {x.lang for x in out} == {None} and max(collections.Counter(x.doc_id for x in out).values()) <= 9
