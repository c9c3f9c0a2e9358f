import io
import json
import zipfile
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pytest

from graphloom.config import Settings, engine_rows, engines
from graphloom.operators import analytics, dedup, extraction, graph, search, similarity, triplets
from graphloom.operators.components import connected_components
from graphloom.plans.pipeline import Pipeline
from graphloom.sources import pdf, sinks, tables


@pytest.fixture(scope="module")
def example(spark):
    entities = spark.createDataFrame(
        [("e1", "Marie Curie", "Person"), ("e2", "Radium", "Concept"), ("e3", "Nobel Prize", "Award"), ("e4", "Sorbonne", "Organization"), ("e5", "Paris", "Location")],
        "id string, label string, type string",
    )
    relations = spark.createDataFrame(
        [("e1", "e2", "discovered", "s", 0), ("e1", "e3", "won", "s", 1), ("e1", "e4", "worked_at", "s", 2), ("e4", "e5", "located_in", "s", 3), ("e1", "e5", "lived_in", "s", 4)],
        "source string, target string, type string, evidence_span string, ord int",
    )
    return entities, relations


def test_worked_example(example):
    entities, relations = example
    nodes, edges = graph.build(entities, relations)
    row = analytics.graph_statistics(nodes, edges).first()
    assert (row.num_nodes, row.num_edges, row.density, row.avg_degree, row.isolated_nodes) == (5, 5, 0.25, 2.0, 0)
    assert row.node_types["Person"] == 1 and row.edge_types == {r: 1 for r in ("discovered", "won", "worked_at", "located_in", "lived_in")}
    assert analytics.top_out_degree(edges).first().asDict() == {"id": "e1", "out_degree": 4}
    assert analytics.top_in_degree(edges).first().asDict() == {"id": "e5", "in_degree": 2}
    kept, between = graph.filter_types(nodes, edges, ["Person", "Organization"])
    assert {r.id for r in kept.collect()} == {"e1", "e4"} and [(r.source, r.target) for r in between.collect()] == [("e1", "e4")]
    row = analytics.analytics(nodes, edges).first()
    assert (row.num_components, row.density, row.avg_degree) == (1, 0.25, 2.0)
    assert row.top_entities_by_degree[0].label == "Marie Curie" and row.top_by_centrality[0].centrality == 1.0
    lines = [r.insight for r in analytics.insights(analytics.analytics(nodes, edges)).orderBy("ord").collect()]
    assert lines[0] == "**5 unique entities** and **5 relationships** extracted from this document."
    assert lines[1] == "**Marie Curie** (Person) is the most connected entity with **4 direct relationships**."
    assert "moderate connectivity" in lines[2] and lines[-1] == "Entities have an average of **2.0 connections** each."


def test_multigraph_and_digraph_differ(spark, example):
    entities, _ = example
    relations = spark.createDataFrame(
        [("e1", "e2", "a", "s", 0), ("e1", "e2", "b", "s", 1), ("e2", "e2", "c", "s", 2), ("e1", "zz", "d", "s", 3), ("e3", "e1", None, "s", 4)],
        "source string, target string, type string, evidence_span string, ord int",
    )
    nodes, edges = graph.build(entities, relations)
    assert sorted((r.source, r.target, r.label) for r in edges.collect()) == [("e1", "e2", "a"), ("e1", "e2", "b"), ("e3", "e1", "related_to")]
    assert {(r.source, r.target): r.label for r in graph.collapse(edges).collect()} == {("e1", "e2"): "b", ("e3", "e1"): "related_to"}
    assert {r.id for r in analytics.isolated_nodes(nodes, edges).collect()} == {"e4", "e5"}
    assert {r.component: r["size"] for r in analytics.component_sizes(analytics.weak_components(nodes, edges)).collect()} == {"e1": 3, "e4": 1, "e5": 1}
    assert [tuple(r) for r in graph.dangling(nodes, relations).select("source", "target").collect()] == [("e1", "zz")]


def test_empty_graph(spark):
    nodes, edges = spark.createDataFrame([], "id string, label string, type string"), spark.createDataFrame([], "source string, target string, label string, ord int")
    row = analytics.analytics(nodes, edges).first()
    assert (row.num_nodes, row.num_edges, row.density, row.avg_degree, row.num_components) == (0, 0, 0.0, 0.0, 0)
    assert analytics.insights(analytics.analytics(nodes, edges)).count() == 0


def test_violations(spark):
    nodes = spark.createDataFrame([("a", "A"), ("a", "B"), (None, "C"), ("d", None)], "id string, label string")
    edges = spark.createDataFrame([("a", "q")], "source string, target string")
    assert {r.problem for r in graph.violations(nodes, edges).collect()} == {"id is missing", "label is missing", "id is repeated", "target is unknown"}
    with pytest.raises(ValueError):
        extraction.require_valid(graph.violations(nodes, edges))


def test_triplets(spark):
    texts = [
        "<triplet> Marie Curie <subj> discovered <obj> Radium </triplet> <triplet> Marie Curie <obj> won <subj> Nobel </triplet>",
        "<triplet> a <subj> b </triplet><triplet> a <subj> b <obj> c <obj> d </triplet><triplet> x <subj> y <obj>  </triplet>",
        "<triplet> x <subj> is\n <obj> x </triplet><triplet> open <subj> no <obj> end",
        "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, generated_text string")
    ids = {(r.chunk_id, r.label): r.id for r in triplets.triplet_entities(df, "chunk_id").collect()}
    assert ids == {(0, "Marie Curie"): "e0", (0, "Radium"): "e1", (0, "Nobel"): "e2", (2, "x"): "e0"}
    rel = sorted((r.chunk_id, r.pos, r.source, r.target, r.type, r.evidence_span) for r in triplets.triplet_relations(df, "chunk_id").collect())
    assert rel == [(0, 0, "e0", "e1", "discovered", "Marie Curie discovered Radium"), (0, 1, "e0", "e2", "won", "Marie Curie won Nobel"), (2, 0, "e0", "e0", "is", "x is x")]


def test_merging_worked_example(spark):
    entities = spark.createDataFrame(
        [("e1", "Einstein"), ("e2", "Albert Einstein"), ("e3", "A. Einstein"), ("e4", "Microsoft"), ("e5", "Microsoft Corporation"), ("e6", "Marie Curie"), ("e7", "Curie"), ("e8", " ")],
        "id string, label string",
    ).selectExpr("id", "label", "'T' AS type", "id AS ord")
    relations = spark.createDataFrame(
        [("e1", "e4", "works_at", 0), ("e2", "e5", "employed_by", 1), ("e3", "e4", "works_at", 2), ("e6", "e7", "same_person", 3)],
        "source string, target string, type string, ord int",
    )
    axis = {"Einstein": 0, "Microsoft": 1, "Curie": 2}
    embed = lambda labels: np.array([[float(k in x) for k in axis] for x in labels])
    kept, linked, mapping = dedup.deduplicate(entities, relations, embed, 0.85)
    assert {r.old_id: r.canonical_id for r in mapping.collect()} == {"e1": "e2", "e2": "e2", "e3": "e2", "e4": "e5", "e5": "e5", "e6": "e6", "e7": "e6", "e8": "e8"}
    assert {r.id for r in kept.collect()} == {"e2", "e5", "e6", "e8"}
    assert sorted((r.source, r.target, r.type) for r in linked.collect()) == [("e2", "e5", "employed_by"), ("e2", "e5", "works_at"), ("e6", "e6", "same_person")]
    row = dedup.statistics(mapping.where("old_id <> 'e8'"), relations, linked).first()
    assert (row.entities_removed, row.reduction_percent, row.avg_cluster_size) == (4, 57.142857, 2.333333)
    none, same, _ = dedup.deduplicate(entities.limit(0), relations, embed)
    assert none.count() == 0 and same.count() == 4
    assert dedup.violations(kept, linked).count() == 0


def brute_labels(v, threshold, linkage):
    groups = [[i] for i in range(len(v))]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = 1 - u @ u.T
    while len(groups) > 1:
        f = {"average": np.mean, "complete": np.max, "single": np.min}[linkage]
        best = min(((f(d[np.ix_(a, b)]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        if not best[0] < 1 - threshold:
            break
        groups[best[1]] += groups.pop(best[2])
    return sorted(tuple(sorted(g)) for g in groups)


def test_clusters_equal_global_clustering(spark):
    rng = np.random.default_rng(1)
    v = np.repeat(rng.normal(size=(12, 6)), 3, axis=0) + rng.normal(scale=0.35, size=(36, 6))
    df = spark.createDataFrame(pd.DataFrame({"id": range(36), "embedding": list(v.tolist())}))
    for linkage in similarity.LINKAGES:
        got: dict[int, list[int]] = {}
        for r in similarity.clusters(df, 0.8, linkage).collect():
            got.setdefault(r.cluster_id, []).append(r.id)
        assert sorted(tuple(sorted(g)) for g in got.values()) == brute_labels(v, 0.8, linkage)
        assert all(k == min(g) for k, g in got.items())


def test_cluster_edges(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0, 0.0])], "id bigint, embedding array<double>")
    assert {r.id: r.cluster_id for r in similarity.clusters(df, 0.8).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 0}
    assert {r.id: r.cluster_id for r in similarity.clusters(df, 1.0).collect()} == {i: i for i in range(5)}
    assert similarity.similarity_matrix(df).count() == 16
    with pytest.raises(ValueError):
        similarity.clusters(df, 0.5, most=2)
    with pytest.raises(ValueError):
        similarity.clusters(df, 0.5, "ward")


@pytest.mark.parametrize("linkage", similarity.LINKAGES)
def test_wide_labels_equal_the_matrix(linkage):
    rng = np.random.default_rng(2)
    for dims, threshold in ((3, 0.9), (8, 0.5), (16, 0.3), (16, -0.5)):
        v, sizes = rng.normal(size=(200, dims)), rng.integers(1, 9, 200)
        want = similarity.linkage_labels(v, threshold, linkage, sizes).tolist()
        for links in (0, similarity.LINKS):
            assert similarity.wide_labels(v, threshold, linkage, sizes, links).tolist() == want
        each = np.repeat(np.arange(200), sizes)
        whole = similarity.linkage_labels(v[each], threshold, linkage)
        first = np.searchsorted(each, np.arange(200))
        assert each[whole[first]].tolist() == want


def test_a_forest_of_pairs_has_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TILE", 40)
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=(90, 4)), rng.normal(scale=0.01, size=(60, 4)) + 1])
    df = spark.createDataFrame(pd.DataFrame({"id": range(150), "embedding": list(v.tolist())}))
    every, some = (similarity.similar_pairs(df, 0.93, f) for f in (False, True))
    assert some.count() < every.count() / 3 and some.where("a >= b").count() == 0
    assert set(map(tuple, some.select("a", "b").collect())) <= set(map(tuple, every.select("a", "b").collect()))
    a, b = ({r.id: r.component for r in connected_components(x, "a", "b").collect()} for x in (every, some))
    assert a == b


def test_components_over_5000_are_clustered(spark):
    rng = np.random.default_rng(3)
    angles = np.sort(rng.uniform(0, 2 * np.pi, 5200))
    v = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    threshold = np.cos(0.02)
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(v)), "embedding": list(v.tolist())}))
    got = {r.id: r.cluster_id for r in similarity.clusters(df, threshold).collect()}
    assert [got[i] for i in range(len(v))] == similarity.wide_labels(v, threshold, "average", links=0).tolist()
    copies = spark.range(5001).selectExpr("id", "array(1D, 2D) AS embedding")
    others = spark.createDataFrame([(9000, [2.0, 4.1]), (9001, [-1.0, 0.0]), (9002, [float("nan"), 1.0]), (9003, [float("nan"), 1.0])], "id bigint, embedding array<double>")
    got = {r.id: r.cluster_id for r in similarity.clusters(copies.unionByName(others), 0.9).collect()}
    assert got == {**dict.fromkeys([*range(5001), 9000], 0), 9001: 9001, 9002: 9002, 9003: 9003}


def test_components_of_paths_stars_and_loops(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 30)]
    df = spark.createDataFrame([*path, *star, (5000, 5000), (7, 3), (None, 1)], "src bigint, dst bigint")
    got = {r.id: r.component for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(30)}, 5000: 5000}
    assert connected_components(df.limit(0)).count() == 0


def test_search(spark, example):
    entities, relations = example
    assert [r.id for r in search.matching(entities, "CURIE").collect()] == ["e1"]
    assert search.matching(entities, "").count() == 5 and search.matching(entities, "a.i", literal=True).count() == 0
    shown = search.relations_display(relations, entities.where("id <> 'e5'"))
    assert {r.Target for r in shown.collect()} == {"Radium", "Nobel Prize", "Sorbonne", "e5"}
    assert search.shown(entities, "curie").first().asDict() == {"shown": 1, "total": 5}


def test_exports(spark, example, tmp_path):
    entities, relations = example
    nodes, edges = graph.build(entities, relations)
    sinks.write_graph_json(nodes, edges.drop("ord"), f"{tmp_path}/g.json")
    n, e = tables.load_graph(spark, f"{tmp_path}/g.json")
    assert n.count() == 5 and e.where("label = 'won'").count() == 1
    assert sinks.entities_csv(entities).splitlines()[:2] == ["label,type,id", "Marie Curie,Person,e1"]
    assert sinks.entities_csv(entities.limit(0)) == "id,label,type\n" and sinks.relations_csv(relations.limit(0)).startswith("source,target")
    book = zipfile.ZipFile(io.BytesIO(sinks.workbook(entities, relations, {"n": 5, "nested": {}})))
    assert len([x for x in book.namelist() if "sheet" in x]) == 3 and b"Nobel Prize" in book.read("xl/worksheets/sheet1.xml")
    root = ElementTree.fromstring(sinks.graphml(nodes, edges).encode())
    assert len(root.findall(".//{*}node")) == 5 and len(root.findall(".//{*}edge")) == 5
    web = sinks.cytoscape(nodes, edges)["elements"]
    assert [x["data"]["id"] for x in web["edges"]] == [f"edge_{i}" for i in range(5)]
    assert "Marie Curie" in sinks.html_graph(nodes, edges)
    assert json.loads(sinks.export("statistics", nodes, edges, entities, relations, {"a": 1})) == {"a": 1}
    with pytest.raises(ValueError):
        sinks.export("pdf", nodes, edges, entities, relations, {})
    with pytest.raises(ValueError):
        sinks.rows_of(entities, 2)
    sinks.write_graph(nodes, edges, f"{tmp_path}/lines")
    assert spark.read.json(f"{tmp_path}/lines/nodes").count() == 5
    sinks.write_csv(entities, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).columns == ["label", "type", "id"]


def test_edges_are_numbered_in_ranges(spark):
    df = spark.range(3000).selectExpr("concat('s', id) AS source", "'t' AS target", "'l' AS label", "CASE WHEN id % 500 = 7 THEN NULL ELSE (id * 7919) % 1000 END AS ord").repartition(5)
    numbered = sinks.cytoscape_edges(df)
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(numbered._jdf.queryExecution(), "simple")
    assert "row_number" not in plan
    order = sorted(df.collect(), key=lambda r: (r.ord is not None, r.ord or 0, r.source))
    assert {r.id: r.source for r in numbered.collect()} == {f"edge_{i}": r.source for i, r in enumerate(order)}
    assert sinks.cytoscape_edges(df.limit(0)).count() == 0


def test_extraction_and_pipeline(spark):
    pages = spark.createDataFrame([(1, 1, "Marie Curie discovered Radium. Albert Einstein met Marie Curie."), (2, 1, "Albert Einstein wrote to Niels Bohr."), (3, 1, " ")], "doc_id bigint, page_number int, text string")
    result = Pipeline().run(pages, strict=True)
    assert {r.label for r in result.nodes.collect()} == {"Marie Curie", "Radium", "Albert Einstein", "Niels Bohr"}
    assert result.edges.count() == 3 and result.insights().count() >= 4
    with pytest.raises(ValueError):
        Pipeline().run(pages.where("doc_id = 3"), strict=True)
    with pytest.raises(ValueError):
        Pipeline(chunk_size=50, chunk_overlap=50)


def test_engine_failures_keep_their_chunks(spark):
    chunks = spark.createDataFrame([(1, 0, "good"), (1, 1, "bad"), (1, 2, " "), (1, 3, "junk")], "doc_id bigint, chunk_id int, text string")
    payload = json.dumps({"entities": [{"id": "a", "label": "A", "type": "T"}], "relations": [{"source": "a", "target": "zz", "type": "r", "evidence_span": "s"}]})

    def make():
        def call(text):
            if text == "bad":
                raise RuntimeError("no")
            return payload if text == "good" else "not json"

        return call

    got = extraction.extract(chunks, make)
    assert [(r.chunk_id, r.id) for r in got.entities.collect()] == [(0, "chunk0_a")]
    assert sorted(r.chunk_id for r in got.errors.collect()) == [1, 3]
    assert got.counts().first().asDict() == {"chunk_count": 4, "entity_count": 1, "relation_count": 1}
    assert [r.problem for r in extraction.violations(got.entities, got.relations).collect()] == ["target is unknown"]
    recorded = spark.createDataFrame([("good", payload)], "text string, payload string")
    replayed = extraction.extract(chunks, extraction.Replay(recorded))
    assert replayed.entities.count() == 1 and replayed.errors.count() == 2

    def generate():
        return lambda text: "<triplet> X <subj> r <obj> Y </triplet>"

    made = extraction.extract(chunks.where("text = 'good'"), generate, generates=True)
    assert {r.id for r in made.entities.collect()} == {"chunk0_e0", "chunk0_e1"} and made.relations.first().source == "chunk0_e0"


def test_retry_waits_longer_each_time():
    waits, calls = [], []

    def call(text):
        calls.append(text)
        if len(calls) < 3:
            raise extraction.RateLimited
        return "ok"

    assert extraction.with_retry(call, sleep=waits.append)("x") == "ok" and waits == [1.0, 2.0]
    calls.clear()
    with pytest.raises(extraction.RateLimited):
        extraction.with_retry(call, attempts=2, sleep=waits.append)("x")


def test_pdf_source(spark, tmp_path):
    for name, data in (("a.PDF", b"one\fsecond"), ("b.pdf", b"!"), ("c.txt", b"x"), ("d.pdf", b"0")):
        (tmp_path / name).write_bytes(data)

    def parser(data):
        if data == b"!":
            raise ValueError("broken")
        return pdf.Parsed([] if data == b"0" else data.decode().split("\f"), title="T")

    parsed = pdf.parse(pdf.files(spark, str(tmp_path)), parser)
    valid = {r.path[-5:]: r.is_valid for r in pdf.validity(parsed).collect()}
    assert valid == {"a.PDF": True, "b.pdf": False, "c.txt": False, "d.pdf": False}
    assert sorted((r.page_number, r.text) for r in pdf.pages(parsed).collect() if r.doc_id.endswith("a.PDF")) == [(1, "one"), (2, "second")]
    assert {r.text for r in pdf.full_text(parsed).collect()} == {"one\n\nsecond", "x", ""}
    assert pdf.info(parsed).count() == 3
    with pytest.raises(pdf.PDFError):
        pdf.read_pages(spark, str(tmp_path), parser)
    with pytest.raises(FileNotFoundError):
        pdf.read_pages(spark, str(tmp_path / "none.pdf"), parser)
    with pytest.raises(ValueError):
        pdf.read_pages(spark, "", parser)


def test_settings():
    s = Settings.from_env({"CHUNK_SIZE": "700", "OPENAI_API_KEY": "k", "DEDUP_SIMILARITY_THRESHOLD": "0.9"})
    assert (s.chunk_size, s.dedup_similarity_threshold, s.problems()) == (700, 0.9, [])
    assert s.public_dict()["has_openai_key"] is True and "k" not in s.public_dict().values()
    assert engines(Settings()) == {"openai": False, "rebel": True}
    with pytest.raises(ValueError):
        Settings(chunk_size=10, chunk_overlap=20).validate()


def test_stream_of_pages(spark, tmp_path):
    from graphloom.streaming import ingest

    for k in range(2):
        spark.createDataFrame([(k, "word " * 300)], "doc_id bigint, text string").write.mode("append").parquet(f"{tmp_path}/in")
        chunks = ingest.chunk_stream(ingest.page_stream(spark, f"{tmp_path}/in"))
        ingest.write_chunks(chunks, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("doc_id").count().count() == 2


def test_engines_by_name(spark):
    settings = Settings(extraction_engine="rules", chunk_size=300, chunk_overlap=20)
    plan = Pipeline.from_settings(settings)
    assert (plan.engine, plan.generates, plan.size, plan.overlap) == (extraction.rule_based, False, 300, 20)
    assert Pipeline.from_settings(Settings(extraction_engine="rebel")).generates
    assert not Pipeline.from_settings(Settings(openai_api_key="k")).generates
    for bad in (Settings(extraction_engine="other"), Settings(), Settings(extraction_engine="rules", chunk_overlap=900)):
        with pytest.raises(ValueError):
            Pipeline.from_settings(bad)
    with pytest.raises(ValueError):
        extraction.engine_for(Settings(extraction_engine="other"))
    rows = {tuple(r) for r in engine_rows(spark, Settings(openai_api_key="k")).collect()}
    assert rows == {("openai", True, True), ("rebel", True, False)}


def test_json_graphs_keep_their_fields(spark, tmp_path):
    whole = {
        "nodes": [{"id": "a", "type": "Person", "age": 3}, {"id": "b", "label": "B", "note": "x"}],
        "edges": [{"source": "a", "target": "b", "label": "knows", "evidence_span": "a knows b"}],
    }
    with open(f"{tmp_path}/g.json", "w") as f:
        json.dump(whole, f)
    nodes, edges = tables.load_graph(spark, f"{tmp_path}/g.json")
    assert nodes.columns[:3] == ["id", "label", "type"] and {(r.id, r.label, r.age, r.note) for r in nodes.collect()} == {("a", None, 3, None), ("b", "B", None, "x")}
    assert edges.first().evidence_span == "a knows b" and edges.first().label == "knows"
    nodes, edges = tables.load_graph(spark, f"{tmp_path}/g.json", nodes="age STRING")
    assert nodes.columns == ["id", "label", "type", "age"] and edges.columns == ["source", "target", "label"]
    with open(f"{tmp_path}/e.json", "w") as f:
        json.dump({"nodes": [], "edges": []}, f)
    assert [x.count() for x in tables.load_graph(spark, f"{tmp_path}/e.json")] == [0, 0]


def test_pairs_rounded_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TILE", 7)
    rng = np.random.default_rng(8)
    v = rng.normal(size=(30, 5)).round(2)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for ids in (list(range(30)), [f"v{i:02}" for i in range(30)]):
        rows = [*zip(ids, v.tolist(), strict=True), (None, [1.0] * 5), (None, [2.0] * 5)]
        df = spark.createDataFrame(rows, f"id {'bigint' if ids[0] == 0 else 'string'}, embedding array<double>")
        got = {(r.a, r.b): r.similarity for r in similarity.similar_pairs(df, -2.0, decimals=3).collect()}
        assert got == {(ids[i], ids[j]): pytest.approx(unit[i] @ unit[j], abs=5.01e-4) for i in range(30) for j in range(i + 1, 30)}
        assert all(s == round(s, 3) for s in got.values())
    assert similarity.rounded(np.array([0.0625, -0.0625, 0.1874, 1 + 2**-52]), 3).tolist() == [0.063, -0.063, 0.187, 1.0]
    uneven = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id bigint, embedding array<double>")
    with pytest.raises(Exception, match="differ in length"):
        similarity.similar_pairs(uneven, 0.5).collect()


def test_vectors_are_copied_once_for_each_of_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TILE", 16)
    rng = np.random.default_rng(9)
    v = rng.normal(size=(640, 64)).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"id": range(640), "embedding": list(v.tolist())}), "id bigint, embedding array<float>")
    sc = spark.sparkContext._jsc.sc()

    def written() -> int:
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "128")  # in few partitions copies lie together and are compressed
    try:
        before = written()
        got = similarity.similar_pairs(df, -2.0).toPandas()
        # 16 blocks, not 40, and floats of 4 bytes.
        assert 0 < written() - before < 640 * 16 * (64 * 4 + 64)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert len(got) == len(got[["a", "b"]].drop_duplicates()) == 640 * 639 // 2 and (got["a"] < got["b"]).all()
    w = v.astype(np.float64)
    unit = w / np.linalg.norm(w, axis=1, keepdims=True)
    assert np.allclose(got["similarity"], (unit[got["a"]] * unit[got["b"]]).sum(axis=1), rtol=0, atol=1e-12)
