import numpy as np
from pyspark.sql import functions as F

from ticketloom.llm import mcl


def table(spark, groups, noise=60, dim=96, seed=0):
    """Vectors of groups (size, spread) and of rows that are like no other; ids start at 1."""
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for k, (n, spread) in enumerate(groups):
        c = rng.standard_normal(dim)
        for _ in range(n):
            rows.append(c / np.linalg.norm(c) + spread * rng.standard_normal(dim) / np.sqrt(dim))
            labels.append(k)
    rows += list(rng.standard_normal((noise, dim)))
    labels += [-1] * noise
    order = rng.permutation(len(rows))
    data = [(int(i) + 1, [float(v) for v in rows[i] * rng.uniform(0.5, 2)], "clash") for i in order]
    return spark.createDataFrame(data, "id long, v array<float>, cluster string"), {i + 1: c for i, c in enumerate(labels)}


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cluster, set()).add(r.id)
    return sorted(map(sorted, out.values()))


def test_against_planted_groups(spark):
    df, truth = table(spark, [(300, 0.2), (40, 0.6), (5, 0.15), (6, 0.5), (4, 0.1)])
    want = sorted(sorted(i for i, c in truth.items() if c == k) for k in range(4))  # the last group is too small
    got = mcl.cluster_vectors(df, "id", "v").cache()
    assert found(got) == want
    assert {(r.first_id, r.id) for r in mcl.first_members(got).collect()} == {(w[0], i) for w in want for i in w[1:]}
    summary = mcl.cluster_summary(got, 3).collect()
    assert sorted(r["size"] for r in summary) == sorted(map(len, want)) and all(len(r.members) == 3 for r in summary)


def test_bad_vectors_and_repeats(spark):
    df, truth = table(spark, [(6, 0.2)], noise=0)
    nan, inf = float("nan"), float("inf")
    one = df.first().v
    bad = [(101, None), (102, [1.0] * 95), (103, [0.0] * 96), (104, [nan] * 96), (105, [inf] + [1.0] * 95), (None, list(one))]
    both = df.select("id", "v").unionByName(spark.createDataFrame(bad, "id long, v array<float>")).unionByName(df.select("id", "v"))
    assert found(mcl.cluster_vectors(both, "id", "v")) == [sorted(truth)]


def test_copies_and_empty(spark):
    """Copies are one node of their number's weight, however the rows lie in partitions."""
    same = spark.range(1, 2001).select("id", F.array_repeat(F.lit(1.0).cast("float"), 96).alias("v"))
    for partitions in (2, 8):
        assert found(mcl.cluster_vectors(same.repartition(partitions), "id", "v")) == [list(range(1, 2001))]
    few = same.limit(4)
    assert mcl.cluster_vectors(few, "id", "v").count() == 0
    assert mcl.cluster_vectors(same.limit(0), "id", "v").count() == 0


def test_markov_clustering_against_dense(spark):
    """The distributed rounds equal plain matrix algebra on a small graph of two cliques and a bridge."""
    edges = [(a, b, 1.0) for g in ((0, 1, 2, 3), (4, 5, 6, 7)) for a in g for b in g if a != b] + [(3, 4, 1.0), (4, 3, 1.0)]
    got = mcl._joined_attractors(mcl.markov_clusters(spark.createDataFrame(edges, "a long, b long, w double"), inflation=2.0)).toPandas().set_index("node").attractor
    assert got[:4].nunique() == 1 and got[4:].nunique() == 1 and got[0] != got[7]
    m = np.zeros((8, 8))
    for a, b, w in edges:
        m[b, a] = w
    m += np.eye(8)
    m /= m.sum(0)
    for _ in range(30):
        m = (m @ m) ** 2.0
        m /= m.sum(0)
        m[m < mcl.PRUNE] = 0
        m /= m.sum(0)
    dense = [set(np.flatnonzero(m[:, i] > 0.01)) for i in range(8)]
    assert len({frozenset(d) for d in dense[:4]}) == 1 and not dense[0] & dense[7]


def test_recall_of_the_index(spark):
    """Rows and their nearest row meet in a leaf in at least nine of ten cases."""
    df, truth = table(spark, [(200, 0.4), (150, 0.6), (30, 0.7)], noise=100, seed=4)
    base, ids = mcl.nodes_of(mcl.valid(df, "id", "v"))
    pivots = mcl.pivots_of(base, base.count(), 60)
    leaf = mcl.leafed(base, pivots, mcl.PROBES, mcl.NEAR).withColumnRenamed("id", "node").join(ids, "node").select("leaf", "id").toPandas()
    x = df.orderBy("id").toPandas()
    u = mcl.unit_rows(x.v)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    near = dict(zip(x.id, x.id.to_numpy()[s.argmax(1)]))
    leaves = leaf.groupby("id").leaf.agg(set)
    hit = [bool(leaves[i] & leaves[near[i]]) for i in x.id if truth[i] >= 0]
    assert np.mean(hit) >= 0.9


def test_big_leaves_are_split(spark, monkeypatch):
    monkeypatch.setattr(mcl, "LEAF_MAX", 50)
    df, _ = table(spark, [(300, 0.3)], noise=20)
    base, _ = mcl.nodes_of(mcl.valid(df, "id", "v"))
    pivots = mcl.pivots_of(base, base.count(), 40)
    sizes = mcl.leafed(base, pivots, 2, 0.0).groupBy("leaf").count().toPandas()["count"]
    assert sizes.max() <= 150 and sizes.sum() == 640


def test_a_circle_of_attractors_is_one(spark):
    rows = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 2), (7, 1), (8, 8)]
    got = mcl._joined_attractors(spark.createDataFrame([(a, b, 1.0) for a, b in rows], "node long, attractor long, flow double")).collect()
    assert {r.node: r.attractor for r in got} == {k: 2 for k in range(1, 8)} | {8: 8}


def test_a_wide_column_keeps_its_largest_entry(spark):
    """A column of 1,000 equal entries, each below the pruning bound, does not vanish."""
    n = 1000
    edges = spark.range(n).withColumnRenamed("id", "a").crossJoin(spark.range(n).withColumnRenamed("id", "b")).where("a <> b").withColumn("w", F.lit(1.0))
    got = mcl._joined_attractors(mcl.markov_clusters(edges)).select("attractor").distinct().collect()
    assert len(got) == 1


def test_a_cluster_with_a_third_of_the_rows(spark):
    """Against brute force: the connected parts of the graph of all near pairs, with a cluster and copies of a third of the rows each."""
    df, truth = table(spark, [(900, 0.35), (40, 0.5), (30, 0.3), (12, 0.4)], noise=600, seed=7)
    copies = spark.range(10_001, 10_901).select("id", F.array([F.lit(float(i % 7 - 3)) for i in range(96)]).cast("array<float>").alias("v"))
    got = found(mcl.cluster_vectors(df.select("id", "v").unionByName(copies), "id", "v"))
    want = sorted(sorted(i for i, c in truth.items() if c == k) for k in range(4)) + [list(range(10_001, 10_901))]
    assert sum(len(set(g) & set(w)) for g in got for w in want) >= 0.99 * sum(map(len, want))
    assert sorted(got) == sorted(want)


def test_markov_clustering_of_random_graphs(spark):
    """On graphs in which columns end at different rounds, the result is that of plain matrix algebra with the same pruning."""
    rng = np.random.default_rng(6)
    n = 60
    edges = {(a, a + 1): 4.0 for a in range(n - 1) if (a + 1) % 10}
    for a in range(n):
        for b in rng.choice(n, 4, replace=False):
            near = a // 10 == b // 10
            if a != b and (near or rng.random() < 0.25):
                edges[min(a, b), max(a, b)] = float(rng.integers(1, 6)) * (4 if near else 1)
    rows = [(int(x), int(y), w) for (a, b), w in edges.items() for x, y in ((a, b), (b, a))]
    got = mcl.markov_clusters(spark.createDataFrame(rows, "a long, b long, w double"), inflation=1.6).toPandas().set_index("node").attractor
    m = np.zeros((n, n))
    for a, b, w in rows:
        m[b, a] = np.sqrt(w)
    m += np.diag(m.max(0))
    m /= m.sum(0)
    for _ in range(200):
        before = m.copy()
        m = (m @ m) ** 1.6
        m = np.round(m / m.sum(0), mcl.PLACES)
        keep = (m >= mcl.PRUNE) & (m > 0)
        keep[m.argmax(0), np.arange(n)] = True
        m = np.where(keep, m, 0)
        m = np.round(m / m.sum(0), mcl.PLACES)
        if np.allclose(m, before, atol=1e-6):
            break
    want = m.argmax(0)
    assert len(got) == n and list(got[range(n)]) == list(want)


def test_pivots_grow_with_the_rows(spark, monkeypatch):
    """A table that needs far more pivots than are sent to the tasks: small clusters are found whole."""
    monkeypatch.setattr(mcl, "SAMPLE", 16)
    monkeypatch.setattr(mcl, "LEAF_ROWS", 8)
    monkeypatch.setattr(mcl, "LEAF_MAX", 40)
    monkeypatch.setattr(mcl, "CELL_ROWS", 100, raising=False)
    df, truth = table(spark, [(12, 0.6)] * 60 + [(80, 0.4)] * 4, noise=300, seed=11)
    got = found(mcl.cluster_vectors(df, "id", "v"))
    want = [sorted(i for i, c in truth.items() if c == k) for k in range(64)]
    assert sum(w in got for w in want) >= 0.95 * len(want)


def test_every_two_rows_of_a_split_leaf_meet(spark, monkeypatch):
    """In a leaf that no prefix splits, and in one that prefixes split, no pair is dropped; no part exceeds the bound by much."""
    monkeypatch.setattr(mcl, "LEAF_MAX", 40)
    df, _ = table(spark, [(150, 0.3)], noise=0, seed=3)
    base, _ = mcl.nodes_of(mcl.valid(df, "id", "v"))

    def meet(pdf):
        return mcl.pd.DataFrame([(a, b) for a in pdf.id for b in pdf.id if a < b] + [(-1, len(pdf))], columns=["a", "b"])

    for rows in (1000, 75):
        kept = mcl._leafed(base, meet, "a long, b long", rows, 1, 0.0)
        assert kept.where("a <> -1").distinct().count() >= (150 * 149 // 2 if rows == 1000 else 2 * (75 * 74 // 2))
        assert kept.where("a = -1").agg(F.max("b")).first()[0] <= 60
