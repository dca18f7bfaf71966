import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.operators import density, explore, tickets, tuning, vectors, web
from ticketloom.plans import vector_queries
from ticketloom.sources import files, sinks


def test_rename(spark):
    df = spark.createDataFrame([("a", "b", "c")], ["Custom field (Country)", tickets.CALCULATED, "Component/s"])
    assert tickets.rename_fields(df).columns == ["Country", "Classification (Calculated)", "Components"]
    with pytest.raises(ValueError):
        tickets.rename_fields(df.drop(tickets.CALCULATED))


def test_batches(spark):
    df = spark.range(1001).repartition(7)
    got = tickets.numbered_batches(df, "id", 100).collect()
    assert all(r.batch_no == r.id // 100 for r in got) and len(got) == 1001


def test_segments(spark):
    good = json.dumps({"1": {"text": "a b"}, "2": {"text": ""}, "meta": {"x": 1}})
    rows = spark.createDataFrame([("a", good), ("b", "{"), ("c", json.dumps({"1": {}})), ("d", "{}")], "f string, j string")
    got = {r.file: (r.n_segments, r.n_tokens, r.error) for r in tickets.segment_tokens(rows, "f", "j").collect()}
    assert got == {"a": (2, 2, None), "b": (None, None, "invalid JSON"), "c": (None, None, "segment without text"), "d": (0, 0, None)}


def test_exports(spark, tmp_path):
    head = ";".join(files.EXPORT_COLUMNS)
    row = ";".join(['"a ""q""\nb"', "HD-1", "NA"] + ["x"] * 18)
    (tmp_path / "Export 1.csv").write_text(f"﻿{head};Component/s\n{row};second\n", encoding="utf-8")
    got = files.read_exports(spark, str(tmp_path / "Export 1.csv"))
    r = got.first()
    assert r["Summary"] == 'a "q"\nb' and r["Inward issue link (Relates)"] is None and r["Component/s"] == "x"
    assert tickets.rename_fields(got).columns[10] == "Components"
    with pytest.raises(ValueError):
        (tmp_path / "bad.csv").write_text("a;b\n1;2\n")
        files.read_exports(spark, str(tmp_path / "bad.csv"))


def test_cleaned_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"\nc'), (2, "x")], "i long, t string")
    sinks.write_cleaned(df, str(tmp_path / "x_cleaned.csv"), single=True)
    got = files.read_cleaned(spark, str(tmp_path / "x_cleaned.csv"), suffix=".csv")
    assert sorted((r.i, r.t) for r in got.collect()) == [("1", 'a,"b"\nc'), ("2", "x")]


def test_json_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"1": {"text": "a b c"}}')
    (tmp_path / "b.txt").write_text("x")
    assert [(r.n_segments, r.n_tokens) for r in files.read_segmented_json(spark, str(tmp_path)).collect()] == [(1, 3)]
    for bad in (tmp_path / "b.txt", tmp_path / "none"):
        with pytest.raises((ValueError, FileNotFoundError)):
            files.read_segmented_json(spark, str(bad))


def test_collection(spark, tmp_path):
    path = str(tmp_path / "c")
    sinks.append_new(spark.createDataFrame([(1, "a")], "id long, t string"), path)
    sinks.append_new(spark.createDataFrame([(1, "b"), (2, "c")], "id long, t string"), path)
    assert sorted((r.id, r.t) for r in files.read_collection(spark, path).collect()) == [(1, "a"), (2, "c")] and files.collection_count(spark, path) == 2


def test_fetch_and_files(spark, tmp_path):
    def fetch(url, timeout):
        if "bad" in url:
            raise OSError("no")
        return (404, "") if "gone" in url else (200, "<p>x</p>")

    urls = files.literal_pages(spark, "https://h/", ["a", "bad", "gone"])
    got = {r.url: (r.status, r.html, r.error) for r in files.fetch_pages(urls, fetch, delay=0).collect()}
    assert got == {"https://h/a": (200, "<p>x</p>", None), "https://h/bad": (None, None, "OSError: no"), "https://h/gone": (404, None, "status 404")}
    rows = spark.createDataFrame([("a.md", "1"), ("a.md", "2"), ("b.md", None)], "filename string, content string")
    assert [r.error for r in sinks.write_files(rows, str(tmp_path / "p")).collect()] == [None, None]
    assert (tmp_path / "p/a.md").read_text() == "2"


def test_tuning_sink(spark, tmp_path):
    t = spark.createDataFrame([(1, 5)], "run_id int, n_neighbors int")
    path = sinks.write_tuning(t, "random", 3, str(tmp_path))
    assert spark.read.option("header", True).csv(path).columns[-1] == "cost"
    assert sinks.write_tuning(t.limit(0), "random", 3, str(tmp_path)) is None
    with pytest.raises(ValueError):
        sinks.write_tuning(t, "grid", 3, str(tmp_path))


def test_embedder(spark):
    df = spark.createDataFrame([("1", "a b"), ("2", None)], "id string, document string")
    got = {r.id: r.embedding for r in sinks.embed_in_batches(df, sinks.hashed_embedder(8), 1).collect()}
    assert abs(sum(x * x for x in got["1"]) - 1) < 1e-5 and not any(got["2"])


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_nearest_against_brute_force(spark, metric, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    x = np.random.default_rng(0).standard_normal((40, 5)).astype(np.float32)
    x[3] = x[4]
    df = points(spark, x)
    got = {}
    for r in vectors.nearest(df.repartition(3), df.where("vec_id % 2 = 0"), 4, metric).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    y = x.astype(float)
    for q, ids in got.items():
        d = 1 - y @ y[q] / np.linalg.norm(y, axis=1) / np.linalg.norm(y[q]) if metric == "cosine" else ((y - y[q]) ** 2).sum(1)
        assert [ids[k] for k in (1, 2, 3, 4)] == sorted(range(40), key=lambda i: (round(d[i], 9), i))[:4]


def test_dimensions(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, 3.0]), (4, None)], "i long, v array<float>")
    assert [(r.id, r.dimension) for r in vectors.dimension_offenders(df, "i", "v").collect()] == [(2, 1)]


def test_hdbscan(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (30, 3)) for c in ((0, 0, 0), (5, 5, 5))] + [rng.uniform(-20, 20, (6, 3))])
    got = density.hdbscan(points(spark, x), 10, neighbours=65).orderBy("id").toPandas()
    assert got.cluster_label[:30].nunique() == 1 and got.cluster_label[30:60].nunique() == 1 and got.cluster_label[0] != got.cluster_label[30]
    assert ((got.cluster_label == -1) == (got.probability == 0)).all() and got.probability.between(0, 1).all() and (got.cluster_label[60:] == -1).sum() >= 4
    sizes = got.cluster_label[got.cluster_label >= 0].value_counts()
    assert (sizes >= 10).all()


def test_spanning_tree_against_prim():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 3))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    a, b = np.triu_indices(60, 1)
    tree = density.spanning_tree(60, a, b, d[a, b])
    inside, total = {0}, 0.0
    while len(inside) < 60:
        w, j = min((d[i, j], j) for i in inside for j in range(60) if j not in inside)
        inside.add(j)
        total += w
    assert len(tree) == 59 and abs(sum(w for *_, w in tree) - total) < 1e-9


def test_copies_and_small_inputs(spark):
    same = density.hdbscan(points(spark, np.ones((12, 3))), 5).toPandas()
    assert len(same) == 12 and density.hdbscan(points(spark, np.ones((1, 3))), 5).count() == 1


def test_umap(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.05, (25, 8)) for c in (np.eye(8)[0], np.eye(8)[3], np.eye(8)[6])])
    layout = density.Layout(8, 2, epochs=80)
    one = np.array([r.v for r in density.umap(points(spark, x), layout).orderBy("id").collect()])
    two = np.array([r.v for r in density.umap(points(spark, x), layout).orderBy("id").collect()])
    assert one.shape == (75, 2) and np.isfinite(one).all() and np.allclose(one, two)
    d = np.linalg.norm(one[:, None] - one[None], axis=2) + np.eye(75) * 1e9
    assert np.mean([(np.argsort(d[i])[:5] // 25 == i // 25).mean() for i in range(75)]) > 0.9
    assert density.umap(points(spark, x[:, :2]), layout).first().v == [float(v) for v in x[0, :2].astype(np.float32)]


def test_score(spark):
    df = spark.createDataFrame([(-1, 0.0), (-1, 0.0)], "l int, p double")
    assert tuple(explore.cluster_score(df, "l", "p").first()) == (0, 1.0) and tuple(explore.cluster_score(df.limit(0), "l", "p").first()) == (0, 1.0)


def test_trim_keeps_all_when_none_survives(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 0.0)], "x double, y double")
    assert explore.trimmed(df, ["x", "y"], 0.3).count() == 2 and explore.trimmed(df.limit(0), ["x"]).count() == 0


@pytest.mark.parametrize("choice,want", [("2", "b"), ("a", "a"), ("9", "cluster_label"), (None, "cluster_label")])
def test_color_key(choice, want):
    assert explore.color_key(["a", "b", "cluster_label"], choice) == want


@pytest.mark.parametrize("method", ["random", "bayesian"])
def test_search(method):
    def score(p):
        if p["n_components"] == 3:
            raise ValueError
        return 20, abs(p["n_neighbors"] - 25) / 100 + abs(p["min_cluster_size"] - 15) / 100

    got = tuning.tune(method, score, evals=40)
    name = "cost" if method == "random" else "loss"
    ok = [t for t in got.trials if t.get("status", "ok") == "ok"]
    assert got.best[name] == min(t[name] for t in ok) and got.best[name] <= 0.15
    assert got.trials == tuning.tune(method, score, evals=40).trials
    assert tuning.tune(method, lambda p: 1 / 0, evals=3).best is None
    with pytest.raises(ValueError):
        tuning.tune("grid", score)


def test_select_best_outside(spark):
    t = spark.createDataFrame([(1, 5, 0.3), (2, 4, 0.2), (3, 90, 0.2)], "run_id int, label_count int, cost double")
    assert tuning.select_best(t, "cost", "run_id").first().run_id == 2


def test_links(spark):
    html = ''.join(f'<a href="{h}">x</a>' for h in ["#a", "mailto:x", "/f.PDF", "//other/x", "/ok#frag", "../up", ""])
    pages = spark.createDataFrame([("https://h/d/p", html), ("https://h/q", None)], "url string, html string")
    assert sorted(r.link for r in web.page_links(pages).collect()) == ["https://h/ok", "https://h/up"]


def test_crawl(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "url string, link string")
    start = spark.createDataFrame([("a",)], "url string")
    assert sorted((r.url, r.depth) for r in web.crawl(edges, start).collect()) == [("a", 0), ("b", 1), ("c", 2)]
    assert web.crawl(edges, start, limit=1).count() == 2


def test_latest(spark):
    df = spark.createDataFrame([("u", 1, 1), ("u", 2, 2)], "url string, fetched_at int, page_id int")
    assert web.latest(df).first().page_id == 2


def test_stream(spark, tmp_path):
    from ticketloom.streaming import tickets as streaming

    rows = spark.read.parquet("/root/testdata/sf0.001/tickets.parquet")
    rows.write.parquet(str(tmp_path / "in"))
    stream = streaming.ticket_stream(spark, str(tmp_path / "in"), rows.schema)
    streaming.append_to_collection(streaming.cleaned_stream(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = tickets.clean_tickets(rows).select("issue_id").distinct()
    assert got.select("issue_id").count() == want.count() and got.join(want, "issue_id", "left_anti").count() == 0
    assert streaming.daily_counts(stream).isStreaming
    assert got.where(F.col("cleaned_summary").isNull()).count() == 0


@pytest.mark.parametrize("method", ["random", "bayesian"])
def test_registered_tuning_searches_the_whole_space(spark, monkeypatch, method):
    seen = []
    monkeypatch.setattr(density, "score_configuration", lambda v, p: (20, seen.append(p) or abs(p["n_neighbors"] - 30) / 50))
    got = vector_queries._tuned(spark, "/root/testdata/sf0.001", method)
    assert got.count() == len(seen) == 30 and {p["n_neighbors"] for p in seen} - {5, 10, 15}
    rng = random.Random(42)
    drawn = [{k: rng.choice(v) for k, v in tuning.Space().axes().items()} for _ in range(30)]
    assert (seen == drawn) == (method == "random")  # estimated ones are not drawn at random


@pytest.mark.parametrize("method", ["random", "bayesian"])
def test_tuning_lets_size_errors_surface(spark, monkeypatch, method):
    monkeypatch.setattr(density, "MAX_POINTS", 3)
    with pytest.raises(ValueError, match="more than 3 rows"):
        vector_queries._tuned(spark, "/root/testdata/sf0.001", method)


def _prim(d):
    """The weights of the minimum spanning tree of a full distance matrix, sorted."""
    best, inside, out = d[0].copy(), np.zeros(len(d), bool), []
    inside[0] = True
    for _ in range(len(d) - 1):
        j = np.where(inside, np.inf, best).argmin()
        out.append(best[j])
        inside[j] = True
        best = np.minimum(best, d[j])
    return sorted(out)


def test_tree_is_that_of_all_distances(spark, monkeypatch):
    """Two dense groups whose rows all have their neighbours inside, and a row far from both: no neighbour list holds the edge
    between the groups, and the tree must not go through the far row."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 0.05, (40, 2)), rng.normal((3, 0), 0.05, (40, 2)), [(1.5, 4.0)], np.zeros((5, 2)), rng.uniform(-9, 9, (12, 2))]).astype(np.float32)
    trees = []
    plain = density.completed_tree
    monkeypatch.setattr(density, "completed_tree", lambda *a: trees.append(plain(*a)) or trees[-1])
    monkeypatch.setattr(density, "BLOCK", 7)
    labels = [density.hdbscan(points(spark, x), 5, neighbours=k).orderBy("id").toPandas() for k in (6, 97)]
    y = x.astype(float)
    d = np.sqrt(((y[:, None] - y[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, 5]
    full = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    for tree in trees:
        assert len(tree) == len(x) - 1 and np.allclose(sorted(w for *_, w in tree), _prim(full))
    assert labels[0].equals(labels[1])


def test_final_run(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.05, (20, 6)) for c in np.eye(6)[:3]])
    best = {"n_neighbors": 6, "n_components": 3, "min_cluster_size": 5}
    same = density.final_run(points(spark, x), best, dims=3).toPandas()
    other = density.final_run(points(spark, x), best, dims=2).toPandas()
    assert len(same) == len(other) == 60 and {len(v) for v in same.v} == {3} and {len(v) for v in other.v} == {2}
    assert list(same.sort_values("id").cluster_label) == list(other.sort_values("id").cluster_label)
    reduced = density.umap(points(spark, x), density.Layout(6, 3)).toPandas().set_index("id").v
    assert all(list(v) == list(reduced[i]) for i, v in zip(same.id, same.v))


def test_labels_join(spark):
    meta = spark.createDataFrame([(1, "a", 9), (2, "b", 9), (3, "c", 9)], "doc_id long, t string, cluster_label int")
    labels = spark.createDataFrame([(1, 4), (2, -1), (1, 5)], "id long, cluster_label int")
    got = {r.doc_id: r.cluster_label for r in explore.with_labels(meta, labels).collect()}
    assert got == {1: 4, 2: -1, 3: -1} and explore.with_labels(meta.limit(0), labels).count() == 0


def test_aligned_lists(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], [1, 2]), (2, None, [1]), (3, [], [1])], "i long, x array<string>, y array<int>")
    assert [tuple(r) for r in explore.aligned(df, ["x", "y"]).orderBy("position").collect()] == [(1, 0, "a", 1), (1, 1, "b", 2)]


def test_label_variants(spark):
    from ticketloom.functions import text

    df = spark.createDataFrame([(None,), (-1,), (3,)], "l int")
    assert [r[0] for r in df.select(text.label_text_or_unknown(F.col("l"))).collect()] == ["Unknown", "Noise", "3"]
    assert [r[0] for r in df.select(text.label_text(F.col("l"))).collect()] == ["Noise", "Noise", "3"]


def test_sections(spark):
    inner = "<section id='b'>in</section>"
    page = f"<section>out</section><div class='x ted'><p/><section>a{inner}</section><div>y</div><!-- <section> --><section>c</div><section>after</section>"
    df = spark.createDataFrame([(page,), (None,), ("<p>none</p>",)], "h string")
    got = [r[0] for r in df.select(web.sections(F.col("h"), "ted")).collect()]
    assert got == [f"<section>a{inner}</section>{inner}<section>c", None, None]
    assert df.select(web.sections(F.col("h"))).first()[0].startswith(f"<section>out</section><section>a{inner}</section>{inner}")


def test_crawl_limit_and_depth(spark):
    """The limit counts processed pages one by one, in order; depth has no bound."""
    edges = spark.createDataFrame([("s", f"p{k:03}") for k in range(60)] + [(f"p{k:03}", f"q{k:03}") for k in range(60)], "url string, link string")
    start = spark.createDataFrame([("s",)], "url string")
    got = web.crawl(edges, start, limit=50).toPandas()
    assert (got.depth == 1).sum() == 60 and sorted(got.url[got.depth == 2]) == [f"q{k:03}" for k in range(49)]
    content = spark.createDataFrame([("s",), ("p001",), ("p002",), ("p059",)], "url string")
    assert sorted(r.url for r in web.crawl(edges, start, limit=3, with_content=content).where("depth = 2").collect()) == ["q001", "q002"]
    chain = spark.range(130).select(F.col("id").cast("string").alias("url"), (F.col("id") + 1).cast("string").alias("link"))
    assert web.crawl(chain, spark.createDataFrame([("0",)], "url string")).agg(F.max("depth")).first()[0] == 130


def test_cleaned_file_has_mark_and_name(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"\nc'), (2, "é")], "i long, `t,x` string").repartition(2)
    path = sinks.write_cleaned_file(df, f"{tmp_path}/Export 1.csv")
    raw = open(path, "rb").read()
    assert path.endswith("/Export 1_cleaned.csv") and raw.startswith(b'\xef\xbb\xbfi,"t,x"\n')
    assert sinks.write_cleaned_file(df, f"{tmp_path}/Export 1.csv") == path and open(path, "rb").read().count(b"\xef\xbb\xbf") == 1
    got = files.read_cleaned(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == [("1", 'a,"b"\nc'), ("2", "é")]


def test_collection_is_made_once(spark, tmp_path):
    path = str(tmp_path / "c")
    assert sinks.create_collection(spark, path, "id long, t string", description="d") and not sinks.create_collection(spark, path, "id long, t string", description="e")
    assert sinks.about_collection(spark, path)["description"] == "d" and "created" in sinks.about_collection(spark, path)
    sinks.append_new(spark.createDataFrame([(1, "a")], "id long, t string"), path)
    assert files.collection_count(spark, path) == 1 and sinks.about_collection(spark, str(tmp_path / "none")) == {}


def test_the_last_page_of_a_name_is_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a.md", "z"), (2, "a.md", "b"), (3, "no/dir", "c")], "page_id long, filename string, content string")
    got = {r.filename: r.error for r in sinks.write_files(rows, f"file://{tmp_path}/p", order="page_id").collect()}
    assert (tmp_path / "p/a.md").read_text() == "b" and got["a.md"] is None and got["no/dir"]


def test_tokens(spark):
    from ticketloom.functions import tokens

    texts = ["Hello world", "", None, "a  b\n\nc " * 2000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    encode = tokens.encoding(tokens.TOKENIZER).encode_ordinary
    assert [r[1] for r in df.select("i", tokens.token_count(F.col("t"))).orderBy("i").collect()] == [len(encode(t)) if t else 0 for t in texts]
    docs = tickets.embedding_documents(df.select(F.col("i").alias("issue_id"), F.col("t").alias("cleaned_summary")), count=tokens.token_count)
    assert docs.where("id = '0'").select("metadata.token_count").first()[0] == 2


def test_json_totals(spark):
    from ticketloom.functions import text, tokens

    rows = [("a", json.dumps({"1": {"text": "Hello world"}, "2": {"text": ""}})), ("b", "{"), ("c", json.dumps({"1": {}})), ("d", "{}")]
    raw = spark.createDataFrame(rows, "f string, j string")
    got = tickets.segment_token_totals(raw, "f", "j", tokens.token_count)
    assert {r.file: (r.n_segments, r.n_tokens, r.error) for r in got.collect()} == {"a": (2, 2, None), "b": (None, None, "invalid JSON"), "c": (None, None, "segment without text"), "d": (0, 0, None)}
    plain = tickets.segment_token_totals(raw, "f", "j", text.word_count)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, tickets.segment_tokens(raw, "f", "j").select("file", "n_segments", "n_tokens", "error").collect()), key=str)
    total = [tuple(r) for r in tickets.with_grand_total(got).collect() if r.is_total]
    assert total == [(None, 1, 2, 2, 2)]


@pytest.mark.parametrize("method", ["random", "bayesian"])
def test_trials_are_timed_and_errors_of_programming_surface(spark, tmp_path, method):
    found = tuning.tune(method, lambda p: (20, 0.1), evals=3)
    table = found.table(spark)
    assert table.where("eval_time >= 0").count() == 3
    path = sinks.write_tuning(table, method, 3, str(tmp_path))
    assert ("eval_time" in spark.read.option("header", True).csv(path).columns) == (method == "bayesian")
    with pytest.raises(KeyError):
        tuning.tune(method, lambda p: p["nothing"], evals=3)


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from ticketloom import session

    conf = SimpleNamespace(get=lambda key, default=None: default, set=lambda key, value: None)
    with pytest.raises(RuntimeError):
        session.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    assert session.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]"))).startswith("file://")


def test_least_hashed_is_a_bounded_sample_of_keys(spark):
    from ticketloom.session import least_hashed

    rows = spark.range(5000).select(F.when(F.col("id") < 3000, F.lit(7)).otherwise(F.col("id")).alias("k"), F.lit("x").alias("t"))
    got = least_hashed(rows, F.col("k"), 100).toPandas()
    assert len(got) == 100 == got.k.nunique() and list(got.h) == sorted(got.h)
    every = rows.select(F.pmod(F.xxhash64("k"), F.lit(1 << 40)).alias("h")).distinct().orderBy("h").limit(100).toPandas()
    assert list(every.h) == list(got.h) and least_hashed(rows.limit(0), F.col("k"), 5).count() == 0
