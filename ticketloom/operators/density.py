"""Density clustering and layouts of vectors: HDBSCAN labels with probabilities, UMAP coordinates.

The neighbour graph is made by Spark; tree and layout are worked out in numpy on the driver from `MAX_POINTS` rows at
most, each with a bounded number of neighbours. More rows are an error, never a sample. The spanning tree is that of all
distances: where a part's neighbour lists cannot tell which edge leaves it, its rows are compared with all others, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.operators.tuning import TooLarge
from ticketloom.operators.vectors import BLOCK, _matrix, core_distances, distances, mutual_reachability, nearest
from ticketloom.session import written

MAX_POINTS = 200_000


def _bounded(rows: DataFrame, id_col: str, vector_col: str) -> np.ndarray:
    """The ids of the rows with a vector, in order."""
    got = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id")).distinct().limit(MAX_POINTS + 1).toPandas()
    if len(got) > MAX_POINTS:
        raise TooLarge(f"more than {MAX_POINTS} rows")
    return np.sort(got.id.to_numpy())


def spanning_tree(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> list[tuple[int, int, float]]:
    """Kruskal's minimum spanning forest; equal weights in order of the ends."""
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for k in np.lexsort((b, a, w)):
        x, y = root(a[k]), root(b[k])
        if x != y:
            parent[y] = x
            out.append((int(a[k]), int(b[k]), float(w[k])))
    return out


def completed_tree(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, beyond: np.ndarray, outside) -> list[tuple[int, int, float]]:
    """Boruvka's minimum spanning tree over the known edges (a, b, w) and all that are not known.

    beyond: a lower bound of the weights of each row's unknown edges. outside(rows, part) gives for each of the rows its lightest
    edge (other, weight) into another part, of all edges; it is asked for the rows whose bound is under the lightest known edge
    that leaves their part. Equal weights go to the smaller ends, so no circle arises."""
    part, out = np.arange(n), []
    low, high = np.minimum(a, b), np.maximum(a, b)
    while len(np.unique(part)) > 1:
        open_ = part[low] != part[high]
        low, high, w = low[open_], high[open_], w[open_]
        best = np.full(n, np.inf)  # by part
        for ends in (low, high):
            np.minimum.at(best, part[ends], w)
        ask = np.flatnonzero(beyond <= best[part])
        x, y, z = low, high, w
        if len(ask):
            other, weight = outside(ask, part)
            x, y, z = np.concatenate([low, np.minimum(ask, other)]), np.concatenate([high, np.maximum(ask, other)]), np.concatenate([w, weight])
        chosen: dict[int, tuple[float, int, int]] = {}
        order = np.lexsort((y, x, z))
        for ends in (x, y):
            at, first = np.unique(part[ends[order]], return_index=True)
            for p, k in zip(at, order[first]):
                edge = (float(z[k]), int(x[k]), int(y[k]))
                if p not in chosen or edge < chosen[p]:
                    chosen[p] = edge
        joined = np.arange(n)

        def root(p: int) -> int:
            while joined[p] != p:
                joined[p] = joined[joined[p]]
                p = joined[p]
            return p

        for weight_, i, j in sorted(set(chosen.values())):
            p, q = root(part[i]), root(part[j])
            if p != q:
                joined[q] = p
                out.append((i, j, weight_))
        while (joined[joined] != joined).any():
            joined = joined[joined]
        part = joined[part]
    return sorted(out, key=lambda e: (e[2], e[0], e[1]))


def lightest_outside(rows: DataFrame, ids: np.ndarray, core: np.ndarray, metric: str, id_col: str, vector_col: str):
    """The search that `completed_tree` asks for: the asked rows are sent block by block against all rows, like queries of
    `nearest`. Parts and core distances are arrays of `MAX_POINTS` numbers at most."""
    base = written(rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).dropDuplicates(["id"]))
    spark = rows.sparkSession

    def of(asked: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = base.schema["id"].dataType.simpleString()
        other, weight = np.zeros(len(asked), np.int64), np.full(len(asked), np.inf)
        for at in range(0, len(asked), BLOCK):
            block = asked[at : at + BLOCK]
            wanted = spark.createDataFrame([(v.item() if isinstance(v, np.generic) else v,) for v in ids[block]], f"id {kind}")
            got = base.join(F.broadcast(wanted), "id").toPandas()  # BLOCK vectors
            here = np.searchsorted(ids, got.id.to_numpy())
            shared = spark.sparkContext.broadcast((here, _matrix(got.v), ids, part, core))

            def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                here, q, ids, part, core = shared.value
                for pdf in batches:
                    if not len(pdf):
                        continue
                    there = np.searchsorted(ids, pdf.id.to_numpy())
                    d = np.maximum(np.maximum(distances(q, _matrix(pdf.v), metric), core[here][:, None]), core[there][None, :])
                    d[part[here][:, None] == part[there][None, :]] = np.inf
                    order = np.argsort(there, kind="stable")  # of equal weights the smaller row
                    j = order[d[:, order].argmin(1)]
                    w = d[np.arange(len(here)), j]
                    ok = np.isfinite(w)
                    yield pd.DataFrame({"row": here[ok], "other": there[j[ok]], "w": w[ok]})

            found = base.mapInPandas(scan, "row long, other long, w double").groupBy("row").agg(F.min(F.struct("w", "other")).alias("e")).select("row", "e.*").toPandas()
            place = at + np.searchsorted(block, found.row.to_numpy())
            other[place], weight[place] = found.other.to_numpy(), found.w.to_numpy()
            shared.unpersist()
        return other, weight

    return of


def labels_of_tree(n: int, tree: list[tuple[int, int, float]], min_cluster_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels (-1: noise) and probabilities, by excess of mass over the condensed tree; the root is never chosen."""
    # single-linkage merges: node n + i joins left and right at a distance
    left, right, dist, size, top = [], [], [], [1] * n, list(range(n))
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b, w in tree:
        x, y = root(a), root(b)
        left.append(top[x])
        right.append(top[y])
        dist.append(w)
        size.append(size[top[x]] + size[top[y]])
        parent[y] = x
        top[x] = n + len(left) - 1
    roots = sorted({top[root(i)] for i in range(n)})
    while len(roots) > 1:  # parts without an edge join at infinity
        x, y = roots.pop(), roots.pop()
        left.append(x)
        right.append(y)
        dist.append(np.inf)
        size.append(size[x] + size[y])
        roots.append(n + len(left) - 1)
    labels, probability = np.full(n, -1), np.zeros(n)
    if n < 2:
        return labels, probability

    def points(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            v = stack.pop()
            if v < n:
                out.append(v)
            else:
                stack += [left[v - n], right[v - n]]
        return out

    # condense: a cluster lives until it splits into two of at least the least size
    birth, kids, falls, top_node = [0.0], [[]], [[]], [roots[0]]
    stack = [(roots[0], 0)]
    while stack:
        node, c = stack.pop()
        while node >= n:
            l, r, d = left[node - n], right[node - n], dist[node - n]
            lam = 0.0 if d == np.inf else (1 / d if d > 0 else np.inf)
            big = [v for v in (l, r) if size[v] >= min_cluster_size]
            if len(big) == 2:
                for v in (l, r):
                    birth.append(lam)
                    kids.append([])
                    falls.append([])
                    top_node.append(v)
                    kids[c].append(len(birth) - 1)
                    stack.append((v, len(birth) - 1))
                break
            for v in (l, r):
                if v not in big:
                    falls[c] += [(p, lam) for p in points(v)]
            if not big:
                break
            node = big[0]
        else:
            falls[c].append((node, np.inf))
    finite = [x for f in falls for _, x in f if np.isfinite(x)] + [x for x in birth if np.isfinite(x)]
    cap = max(finite, default=1.0) * 2 or 1.0  # copies have no distance: their density counts as twice the greatest finite one
    leave = [min(birth[k[0]], cap) if k else 0.0 for k in kids]
    stability = []
    for c in range(len(birth)):
        own = sum(min(x, cap) - min(birth[c], cap) for _, x in falls[c])
        own += sum(size[top_node[k]] for k in kids[c]) * (leave[c] - min(birth[c], cap))
        stability.append(own)
    chosen = [False] * len(birth)
    for c in range(len(birth) - 1, 0, -1):
        below = sum(stability[k] for k in kids[c])
        if not kids[c] or stability[c] >= below:
            chosen[c] = True
        else:
            stability[c] = below
    label = 0
    stack2 = [0]
    while stack2:
        c = stack2.pop()
        if not chosen[c] or c == 0:
            stack2 += kids[c][::-1]
            continue
        members, todo = [], [c]
        while todo:
            k = todo.pop()
            members += [(p, min(x, cap)) for p, x in falls[k]]
            todo += kids[k]
        peak = max(x for _, x in members) or 1.0
        for p, x in members:
            labels[p], probability[p] = label, x / peak
        label += 1
    probability[labels >= 0] = np.maximum(probability[labels >= 0], 1e-12)
    return labels, probability


def hdbscan(rows: DataFrame, min_cluster_size: int = 10, min_samples: int | None = None, metric: str = "euclidean", neighbours: int = 60, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster_label, probability) of every row with a vector, from the spanning tree of all mutual reachability distances.

    neighbours: so many of each row are found at once; fewer mean more comparisons later, not another result."""
    ids = _bounded(rows, id_col, vector_col)
    k = min_samples or min_cluster_size
    graph = written(nearest(rows, rows, max(neighbours, k), metric, id_col, vector_col, skip_self=True))
    cores = core_distances(graph, min(k, max(1, len(ids) - 1)))
    edges = mutual_reachability(graph, cores).toPandas()  # MAX_POINTS x neighbours at most
    core, beyond = np.zeros(len(ids)), np.full(len(ids), np.inf)
    far = graph.groupBy(F.col("query_id").alias("id")).agg(F.max("distance").alias("far"), F.count("*").alias("n")).join(cores, "id").toPandas()
    at = np.searchsorted(ids, far.id.to_numpy())
    core[at] = far.core.to_numpy(float)
    beyond[at] = np.where(far.n < len(ids) - 1, np.maximum(far.far, far.core), np.inf)
    a, b = np.searchsorted(ids, edges.a.to_numpy()), np.searchsorted(ids, edges.b.to_numpy())
    tree = completed_tree(len(ids), a, b, edges.weight.to_numpy(float), beyond, lightest_outside(rows, ids, core, metric, id_col, vector_col))
    labels, probability = labels_of_tree(len(ids), tree, min_cluster_size)
    kind = rows.schema[id_col].dataType.simpleString()
    data = [(int(i) if isinstance(i, np.integer) else i, int(c), float(p)) for i, c, p in zip(ids, labels, probability)]
    return rows.sparkSession.createDataFrame(data, f"id {kind}, cluster_label int, probability double")


@dataclass(frozen=True)
class Layout:
    n_neighbors: int = 15
    n_components: int = 3
    min_dist: float = 0.1
    metric: str = "cosine"
    epochs: int = 200
    seed: int = 42


def fuzzy_graph(d: np.ndarray) -> np.ndarray:
    """Membership strengths of each row's neighbours from their sorted distances (rows, k)."""
    rho = np.where(d > 0, d, np.inf).min(1)
    rho[~np.isfinite(rho)] = 0
    low, high, sigma = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    goal = np.log2(max(2, d.shape[1]))
    for _ in range(64):
        total = np.exp(-np.maximum(d - rho[:, None], 0) / sigma[:, None]).sum(1)
        above = total > goal
        high, low = np.where(above, sigma, high), np.where(above, low, sigma)
        sigma = np.where(np.isinf(high), sigma * 2, (low + high) / 2)
    sigma = np.maximum(sigma, 1e-3 * np.maximum(d.mean(1), 1e-12))
    return np.exp(-np.maximum(d - rho[:, None], 0) / sigma[:, None])


def _curve(min_dist: float) -> tuple[float, float]:
    """a and b of 1 / (1 + a x^2b), fitted to the wanted fall-off by Gauss-Newton steps on a grid."""
    x = np.linspace(1e-3, 3, 300)
    y = np.where(x < min_dist, 1, np.exp(-(x - min_dist)))
    best, a, b = np.inf, 1.0, 1.0
    for bb in np.linspace(0.5, 2, 61):
        for aa in np.geomspace(0.1, 10, 61):
            e = ((1 / (1 + aa * x ** (2 * bb)) - y) ** 2).sum()
            if e < best:
                best, a, b = e, aa, bb
    return float(a), float(b)


def umap(rows: DataFrame, layout: Layout = Layout(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): coordinates of `n_components` numbers. Vectors that have no more are passed through unchanged."""
    have = rows.where(F.col(vector_col).isNotNull()).select(F.max(F.size(vector_col))).first()[0]
    if have is not None and have <= layout.n_components:
        return rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    ids = _bounded(rows, id_col, vector_col)
    n, k = len(ids), min(layout.n_neighbors, max(1, len(ids) - 1))
    kind = rows.schema[id_col].dataType.simpleString()
    if n < 3:
        return rows.sparkSession.createDataFrame([(int(i), [0.0] * layout.n_components) for i in ids], f"id {kind}, v array<double>")
    g = nearest(rows, rows, k, layout.metric, id_col, vector_col, skip_self=True).toPandas().sort_values(["query_id", "rank"])
    i, j = np.searchsorted(ids, g.query_id.to_numpy()), np.searchsorted(ids, g.id.to_numpy())
    d = np.maximum(g.distance.to_numpy().reshape(n, k), 0)
    w = fuzzy_graph(d).ravel()
    table: dict[tuple[int, int], float] = {}
    for x, y, s in zip(i, j, w):
        table[x, y] = s
    pairs = np.array([(x, y) for x, y in table if x < y or (y, x) not in table])
    union = np.array([table.get((x, y), 0) + table.get((y, x), 0) - table.get((x, y), 0) * table.get((y, x), 0) for x, y in pairs])
    rng = np.random.default_rng(layout.seed)
    p = rng.uniform(-10, 10, (n, layout.n_components))
    # neighbours' means from a few rounds of smoothing give the layout its large shape
    for _ in range(15):
        q = np.zeros_like(p)
        total = np.zeros(n)
        for x, y in ((0, 1), (1, 0)):
            np.add.at(q, pairs[:, x], union[:, None] * p[pairs[:, y]])
            np.add.at(total, pairs[:, x], union)
        p = 0.5 * p + 0.5 * q / np.maximum(total, 1e-9)[:, None]
        p = (p - p.mean(0)) / np.maximum(p.std(0), 1e-9) * 5
    a, b = _curve(layout.min_dist)
    every = union.max() / np.maximum(union, union.max() / layout.epochs)
    due = every.copy()
    for epoch in range(layout.epochs):
        rate = 1 - epoch / layout.epochs
        live = due <= epoch + 1
        due[live] += every[live]
        x, y = pairs[live, 0], pairs[live, 1]
        diff = p[x] - p[y]
        sq = (diff**2).sum(1)
        pull = np.where(sq > 0, -2 * a * b * np.maximum(sq, 1e-12) ** (b - 1) / (1 + a * sq**b), 0)
        step = np.clip(pull[:, None] * diff, -4, 4) * rate
        np.add.at(p, x, step)
        np.add.at(p, y, -step)
        for _ in range(5):
            z = rng.integers(0, n, len(x))
            diff = p[x] - p[z]
            sq = (diff**2).sum(1)
            push = 2 * b / ((0.001 + sq) * (1 + a * sq**b))
            np.add.at(p, x, np.clip(push[:, None] * diff, -4, 4) * rate * (z != x)[:, None])
    data = [(int(v) if isinstance(v, np.integer) else v, [float(c) for c in row]) for v, row in zip(ids, p)]
    return rows.sparkSession.createDataFrame(data, f"id {kind}, v array<double>")


def score_configuration(rows: DataFrame, params: dict, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 42, threshold: float = 0.05) -> tuple[int, float]:
    """(label_count, cost) of reducing and then clustering the rows with one configuration."""
    reduced = umap(rows, Layout(params["n_neighbors"], params["n_components"], seed=seed, epochs=params.get("epochs", Layout.epochs)), id_col, vector_col)
    got = hdbscan(reduced, params["min_cluster_size"], id_col="id", vector_col="v").toPandas()
    count = got.cluster_label[got.cluster_label != -1].nunique()
    return int(count), float((got.probability < threshold).mean()) if len(got) else 1.0


def final_run(rows: DataFrame, best: dict, dims: int = 3, min_dist: float = 0.1, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 42) -> DataFrame:
    """(id, cluster_label, probability, v): the rows clustered with the best configuration, and their coordinates for a plot of
    `dims` dimensions. The reduced vectors that were clustered are taken if they have so many, else the rows are laid out again."""
    reduced = written(umap(rows, Layout(best["n_neighbors"], best["n_components"], seed=seed), id_col, vector_col))
    labels = hdbscan(reduced, best["min_cluster_size"], id_col="id", vector_col="v")
    fits = best["n_components"] == dims
    shown = reduced if fits else umap(rows, Layout(best["n_neighbors"], dims, min_dist, seed=seed), id_col, vector_col)
    return labels.join(shown, "id")
