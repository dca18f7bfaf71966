"""Clusters of similar vectors, by Markov clustering.

Method: rows of equal direction become one node of their number's weight. A similarity graph of the nodes is built by an
inverted file over pivots (bounded sample, every node indexed, several probes a node), and coarsened: in each leaf nodes
join the star of a leader that lies within their common local scale. Stars that share nodes or have close nodes are linked,
and Markov clustering runs on that graph: the sparse column-stochastic matrix is squared, its entries raised to the
inflation power and small ones pruned, until every column stands still. The attractor rows of the limit define the
clusters; the members nearest to the flow's attractors describe them.

Only direction counts, in half precision. Null vectors, those of another length, with a NaN, an infinity, or all zero belong
to no cluster. An id embedded more than once counts once, by the direction of the smallest key. Issues without `min_size - 1`
neighbours at least `min_similarity` near stay alone. Ties are broken by the smaller key, and entries are rounded before they
are compared, so the result doesn't depend on the layout of tasks. An empty table gives an empty result. Only the named
columns are read. A leaf of more than `LEAF_MAX` nodes is split by their next pivots until none is, so no task holds an
unbounded group. Whatever the parts are, every two nodes of such a leaf also meet: each pair of its blocks by hash is compared. Directions are told apart by a 64-bit key. Where leaves of `LEAF_ROWS` rows need more pivots than
are sent to the tasks, pivots and rows meet in the cells of a coarser sample, so the pivots grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.session import written

DIM = 96
MIN_SIZE = 5
MIN_SIMILARITY = 0.5
#: Neighbours of one scale: the squared distance is at most so many times the smaller one to the 4th neighbour.
SCALE = 2.0
SAMPLE, LEAF_ROWS, LEAF_MAX, PREFIX = 4096, 150, 1500, 4
#: Beyond `SAMPLE` pivots each stands in the so many cells nearest to it. Cells are the means of so many sampled rows a cell, after
#: so many rounds; a block holds about so many of a cell's rows.
ROUTES, MEAN_ROWS, MEAN_ROUNDS, CELL_ROWS = 32, 16, 3, 40_000
#: A row is ranked against about so many times `SAMPLE` pivots of its cell; rows that found no star, of which there are fewer, more.
RANKED, AGAIN_RANKED = 4, 8
#: A row goes to its two nearest pivots, and to more that are about as near, up to so many.
PROBES, NEAR = 4, 0.04
#: Rows that found no star are indexed again among themselves and so many rows of each star, with more probes.
AGAIN_ROWS, AGAIN_LEAF_ROWS, AGAIN_PROBES, AGAIN_NEAR, PAIR_NEIGHBOURS = 5, 60, 10, 0.13, 8
INFLATION, PRUNE = 1.6, 0.002
#: A column stands still when its largest entry exceeds its sum of squares by no more. More rounds than these are an error.
STILL, MOST_ROUNDS = 1e-3, 200
#: Entries are rounded to so many places, since the order of a sum depends on the tasks' layout.
PLACES = 9
SALTS = 16


def unit_rows(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float32).reshape(len(vectors), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid(rows: DataFrame, id_col: str, vector_col: str, dim: int = DIM) -> DataFrame:
    """(id, v): the vectors of `dim` finite numbers that are not all zero. A NaN or infinity spoils the sum of squares."""
    v = F.col(vector_col)
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sized = rows.where(F.col(id_col).isNotNull() & (F.size(v) == dim))
    return sized.where((square > 0) & (square < float("inf")) & ~F.isnan(square)).select(F.col(id_col).cast("long").alias("id"), v.cast("array<float>").alias("v"))


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, n, x) and (members: id, node) of the rows (id, v).

    A node is a distinct direction, packed in half precision, with the number of ids that have it. Rows of one direction meet
    in partial aggregates, so copies of one vector may be a third of all rows."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                packed = (unit_rows(pdf.v) + np.float32(0)).astype("<f2") + np.float16(0)  # no negative zeros
                yield pd.DataFrame({"id": pdf.id, "x": [r.tobytes() for r in packed]})

    rows = written(vectors.mapInPandas(pack, "id long, x binary").withColumn("node", F.xxhash64("x")))
    members = written(rows.groupBy("id").agg(F.min("node").alias("node")))
    # only what is there more than once is grouped, so most directions are not shuffled; the small side of each join is a
    # written table, of whose size Catalyst knows
    often = written(rows.groupBy("node").agg(F.count("*").alias("rows")).where("rows > 1").select("node"))
    other = written(rows.select("id", "node").join(often, "node", "left_anti").join(members, ["id", "node"], "left_anti"))
    once = rows.join(often, "node", "left_anti").join(other, ["id", "node"], "left_anti").select("node", F.lit(1).cast("long").alias("n"), "x")
    counts = members.join(often, "node", "left_semi").groupBy("node").agg(F.count("*").alias("n"))
    copied = rows.join(often, "node", "left_semi").groupBy("node").agg(F.min("x").alias("x")).join(counts, "node").select("node", "n", "x")
    return written(once.unionByName(copied).withColumnRenamed("node", "id")), members


def pivots_of(rows: DataFrame, n: int, leaf_rows: int, most: int | None = None) -> np.ndarray:
    """Directions of the rows of least hash, about one for `leaf_rows` rows; at most `most`, else `SAMPLE`.

    A cut-off of the hash, from n, filters before anything is sorted, so a small multiple of the sample leaves the scan."""
    count = int(min(most or SAMPLE, max(1, n // leaf_rows)))
    h = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 40)).alias("h")
    cut = min(1 << 40, int((2 * count + 100) / max(n, 1) * (1 << 40)))
    got = rows.select("x", h, "id").where(F.col("h") < cut).orderBy("h", "id").limit(count).toPandas()
    return _directions(got) if len(got) else np.zeros((0, DIM), np.float32)


def _nearest(x: np.ndarray, pivots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the numbers of its k nearest pivots, the nearest first, and their similarities."""
    parts = []
    for at in range(0, len(x), 2000):
        s = x[at : at + 2000] @ pivots.T
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(s, top, 1)
        order = near.argsort(1)[:, ::-1]
        parts.append((np.take_along_axis(top, order, 1).astype(np.int64), np.take_along_axis(near, order, 1)))
    return np.concatenate([t for t, _ in parts]), np.concatenate([n for _, n in parts])


def _ranked(x: np.ndarray, pivots: np.ndarray, keys: np.ndarray, probes: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the keys of its nearest pivots, -1 where there are no more, and how many of them it probes."""
    k = max(probes, PREFIX)
    top, near = _nearest(x, pivots, min(k, len(pivots)))
    used = np.maximum((near[:, :probes] >= near[:, :1] - reach).sum(1), min(2, probes, len(pivots)))
    return np.pad(keys[top], ((0, 0), (0, k - top.shape[1])), constant_values=-1), used


def _paths(top: np.ndarray, used: np.ndarray, probes: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Per probe the rows that take it and the codes of their paths' prefixes: the probed pivot, then the row's nearest others.

    A code is a 64-bit hash of up to `PREFIX` pivots' keys."""
    k = top.shape[1]
    for p in range(min(probes, k)):
        rows = np.flatnonzero(used > p)
        code, codes = np.zeros(len(rows), np.uint64), []
        for c in [p, *range(p), *range(p + 1, k)][:PREFIX]:
            code = (code ^ top[rows, c].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            code = code ^ code >> np.uint64(29)
            codes.append(code.view(np.int64))
        yield rows, codes


def _means(x: np.ndarray, count: int) -> np.ndarray:
    """Mean directions of `count` parts of the rows, by `MEAN_ROUNDS` rounds of k-means from the first rows."""
    means = x[:count].copy()
    for _ in range(MEAN_ROUNDS):
        sums = np.zeros_like(means)
        np.add.at(sums, _nearest(x, means, 1)[0][:, 0], x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        means = np.where(size > 0, sums / np.maximum(size, 1e-9), means)
    return means


def routed(rows: DataFrame, n: int, leaf_rows: int, probes: int, reach: float, ranked: int = RANKED) -> DataFrame:
    """(id, n, x, top, used): the rows with the keys of their nearest pivots, of which there is one for `leaf_rows` rows.

    The pivots are too many to be sent to each task. The means of a sample, `SAMPLE` at most, make cells: a row goes to its nearest
    cell, a pivot to the `ROUTES` nearest, and there rows are ranked against about `ranked` times `SAMPLE` pivots. A cell with many
    rows, as the pivots in it tell, is several blocks, each with all of the cell's pivots."""
    h = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 40))
    fine = written(rows.select("id", "x").where(h < (1 << 40) // leaf_rows))
    count = min(SAMPLE, max(1, n // leaf_rows * ROUTES // (ranked * SAMPLE)))
    context = rows.sparkSession.sparkContext
    coarse = context.broadcast(_means(pivots_of(rows, n, 1, MEAN_ROWS * count), count))

    def homes(batches: Iterator[pd.DataFrame], means=coarse) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"cell": _nearest(_directions(pdf), means.value, 1)[0][:, 0]})

    at_home = {r.cell: r["count"] for r in fine.select("x").mapInPandas(homes, "cell long").groupBy("cell").count().collect()}  # a row a cell
    kept = np.array(sorted(at_home), np.int64)  # cells without a pivot of their own are none
    blocks = np.array([max(1, -(-at_home[c] * leaf_rows // CELL_ROWS)) for c in kept])
    coarse = context.broadcast(coarse.value[kept])

    def pivots_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cells = _nearest(_directions(pdf), coarse.value, min(ROUTES, len(coarse.value)))[0]
                for c in cells.T:
                    at = np.repeat(np.arange(len(pdf)), blocks[c])
                    block = np.arange(len(at)) - np.repeat(np.cumsum(blocks[c]) - blocks[c], blocks[c])
                    yield pd.DataFrame({"cell": c[at], "block": block, "own": False, "id": pdf.id.to_numpy()[at], "n": 0, "x": pdf.x.to_numpy()[at]})

    def rows_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cell = _nearest(_directions(pdf), coarse.value, 1)[0][:, 0]
                yield pd.DataFrame({"cell": cell, "block": pdf.id.to_numpy() % blocks[cell], "own": True, "id": pdf.id, "n": pdf.n, "x": pdf.x})

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, held, pivots, keys = None, [], None, None  # a block's pivots come before its rows
        for pdf in batches:
            if not len(pdf):
                continue
            kind = pdf[["cell", "block", "own"]].to_numpy(np.int64)
            cuts = np.flatnonzero((kind[1:] != kind[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(pdf)]):
                part, block = pdf.iloc[a:b], tuple(kind[a, :2])
                if block != here:
                    here, held, pivots = block, [], None
                if not kind[a, 2]:
                    held.append(part[["id", "x"]])
                    continue
                if pivots is None:
                    both = pd.concat(held or [part[:1]])
                    pivots, keys, held = _directions(both), both.id.to_numpy(np.int64), []
                top, used = _ranked(_directions(part), pivots, keys, probes, reach)
                yield pd.DataFrame({"id": part.id.to_numpy(), "n": part.n.to_numpy(), "x": part.x.to_numpy(), "top": list(top), "used": used})

    schema = "cell long, block long, own boolean, id long, n long, x binary"
    both = fine.mapInPandas(pivots_in, schema).unionByName(rows.select("id", "n", "x").mapInPandas(rows_in, schema))
    sorted_ = both.repartition("cell", "block").sortWithinPartitions("cell", "block", "own", "id")
    return written(sorted_.mapInPandas(rank, "id long, n long, x binary, top array<long>, used int"))


def _ranks(pivots, probes: int, reach: float):
    """A function of a batch that gives its rows' ranked pivots: those sent to the tasks, or else those that its columns name."""

    def of(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        if pivots is None:
            return np.stack(pdf.top.to_numpy()), pdf.used.to_numpy()
        return _ranked(_directions(pdf), pivots.value, np.arange(len(pivots.value)), probes, reach)

    return of


def big_prefixes(rows: DataFrame, ranks, probes: int) -> DataFrame:
    """(code, n): the prefixes that more than `LEAF_MAX` rows take. A batch counts before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                codes = np.concatenate([c for _, cs in _paths(*ranks(pdf), probes) for c in cs])
                code, n = np.unique(codes, return_counts=True)
                yield pd.DataFrame({"code": code, "n": n})

    return rows.mapInPandas(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).where(f"n > {LEAF_MAX}")


def leafed(rows: DataFrame, pivots: np.ndarray | None, probes: int, reach: float, crossed: bool = False) -> DataFrame:
    """(leaf, across, id, n, x): each row once per probe, by the pivots or, without, by those that its columns name. A leaf is the shortest prefix that at most `LEAF_MAX` rows take; what no
    prefix splits falls into blocks by hash. With `crossed` the rows of a first prefix that was split also come in pairs of blocks
    by hash (across), `LEAF_MAX` rows a pair, so that every two of them meet.

    The counts of large prefixes stay a table, of about a row for a thousand rows; Catalyst sends it to the tasks where its
    size is under the broadcast threshold, and shuffles beyond."""
    shared = None if pivots is None else rows.sparkSession.sparkContext.broadcast(pivots)  # SAMPLE directions at most
    ranks = _ranks(shared, probes, reach)
    read = ["top", "used"] if pivots is None else ["x"]
    big = written(big_prefixes(rows.select(*read), ranks, probes))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                ids, n, x = pdf.id.to_numpy(), pdf.n.to_numpy(), pdf.x.to_numpy()
                for at, codes in _paths(*ranks(pdf), probes):
                    yield pd.DataFrame({"id": ids[at], "n": n[at], "x": x[at]} | {f"c{k}": c for k, c in enumerate(codes)})

    out = rows.select(*dict.fromkeys(["id", "n", "x", *read])).mapInPandas(scan, "id long, n long, x binary, " + ", ".join(f"c{k} long" for k in range(PREFIX)))
    out = out.withColumn("leaf", F.col("c0"))
    for k in range(PREFIX):
        # a prefix can only be large where its shorter one is, so the joins beyond the first have null keys but for those
        key = F.col("c0") if k == 0 else F.when(F.col(f"n{k - 1}").isNotNull(), F.col(f"c{k}"))
        out = out.withColumn("key", key).join(big.select(F.col("code").alias("key"), F.col("n").alias(f"n{k}")), "key", "left")
        out = out.withColumn("leaf", F.coalesce(F.col("key"), F.col("leaf")))
    # other blocks in each leaf, so that rows of several leaves join the blocks' stars
    last = F.col(f"n{PREFIX - 1}")
    block = F.when(last.isNotNull(), F.pmod(F.xxhash64("id", "leaf"), F.ceil(last / LEAF_MAX))).otherwise(F.lit(0))
    parts = F.array(F.struct(F.xxhash64("leaf", block).alias("leaf"), F.lit(False).alias("across")))
    if crossed:
        count = F.ceil(F.col("n0") * 2 / LEAF_MAX)  # 3 at least
        own = F.pmod(F.xxhash64("id", "c0", F.lit(1)), count)
        others = F.filter(F.sequence(F.lit(0).cast("long"), count - 1), lambda b: b != own)
        pairs = F.transform(others, lambda b: F.struct(F.xxhash64("c0", F.least(b, own), F.greatest(b, own)).alias("leaf"), F.lit(True).alias("across")))
        parts = F.when(F.col("n0").isNotNull(), F.concat(parts, pairs)).otherwise(parts)
    return out.withColumn("to", F.explode(parts)).select("to.leaf", "to.across", "id", "n", "x")


def _directions(pdf: pd.DataFrame) -> np.ndarray:
    x = np.frombuffer(b"".join(pdf.x), "<f2").reshape(len(pdf), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def stars(ids: np.ndarray, weight: np.ndarray, x: np.ndarray, min_size: int = MIN_SIZE, min_similarity: float = MIN_SIMILARITY) -> tuple[list[tuple], list[tuple]]:
    """Stars of one leaf: (node, leader, squared distance, node's scale) and (leader, leader, close pairs).

    A node's scale is its squared distance to the neighbour with which its neighbours and its own copies are `min_size - 1`."""
    ids, first = np.unique(ids, return_index=True)
    x, weight = x[first], weight[first]
    n = len(ids)
    s = np.minimum(np.round(x @ x.T, 6), 1)
    np.fill_diagonal(s, -1)
    k = min(min_size - 1, n - 1)
    scale = np.full(n, 4.0)
    if k:
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(s, top, 1)
        order = np.lexsort((ids[top], -near), axis=1)
        near, top = np.take_along_axis(near, order, 1), np.take_along_axis(top, order, 1)
        enough = (weight - 1)[:, None] + np.cumsum(weight[top], axis=1) >= min_size - 1
        enough[:, -1] = True
        scale = 2 - 2 * np.take_along_axis(near, enough.argmax(1)[:, None], 1)[:, 0]
    scale[weight >= min_size] = 0
    np.maximum(scale, 1e-4, out=scale)  # near copies have no distance; rounding must not part them
    d = np.maximum(2 - 2 * s, 0)
    close = (d <= SCALE * np.minimum(scale[:, None], scale[None, :])) & (s >= min_similarity)
    degree = close @ weight + weight - 1
    leader = np.full(n, -1)
    for i in np.lexsort((ids, -degree)):
        if degree[i] == 0:
            break
        if leader[i] < 0:
            free = close[i] & (leader < 0)
            leader[free] = i
            leader[i] = i
    # a later leader may be nearer than the first one that came
    heads = np.flatnonzero(leader == np.arange(n))
    if not len(heads):
        return [], []
    to_heads = np.where(close[:, heads], d[:, heads], np.inf)
    to_heads[heads, np.arange(len(heads))] = 0
    best = to_heads.argmin(1)
    rows = np.flatnonzero(np.isfinite(to_heads.min(1)))
    members = [(int(ids[i]), int(ids[heads[best[i]]]), float(max(0, d[i, heads[best[i]]]) if i != heads[best[i]] else 0.0), float(scale[i])) for i in rows]
    inside = np.zeros((n, len(heads)), np.float32)
    inside[rows, best[rows]] = 1
    pairs = inside.T @ close.astype(np.float32) @ inside
    size = inside.sum(0)
    links = []
    for a, b in zip(*np.nonzero(np.triu(pairs, 1))):
        links.append((int(ids[heads[a]]), int(ids[heads[b]]), float(pairs[a, b] / min(size[a], size[b]))))
    return members, links


_STARS = "member boolean, a long, b long, w double, scale double"
_PAIRS = "a long, b long, code long"


def _star_leaf(pdf: pd.DataFrame) -> pd.DataFrame:
    members, links = stars(pdf.id.to_numpy(np.int64), pdf.n.to_numpy(np.int64), _directions(pdf))
    if pdf.across.iloc[0]:  # scales are those of a part of the neighbours: memberships are verified, links are not
        links = []
    rows = [(True, a, b, d, s) for a, b, d, s in members] + [(False, a, b, w, 0.0) for a, b, w in links]
    return pd.DataFrame(rows, columns=["member", "a", "b", "w", "scale"])


def _pair_leaf(pdf: pd.DataFrame) -> pd.DataFrame:
    """Each row of a leaf with its `PAIR_NEIGHBOURS` nearest others that are similar enough.

    code packs the squared distance in millionths, as fine as it is rounded, and both weights, of which `MIN_SIZE` and more are
    alike; the least code of a pair is that of the least distance."""
    ids, first = np.unique(pdf.id.to_numpy(np.int64), return_index=True)
    x, n = _directions(pdf)[first], np.minimum(pdf.n.to_numpy(np.int64)[first], MIN_SIZE)
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -1)
    k = min(PAIR_NEIGHBOURS, len(ids) - 1)
    if k < 1:
        return pd.DataFrame({"a": [], "b": [], "code": []}, dtype="int64")
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(s, top, 1)
    i, j = np.nonzero(near >= MIN_SIMILARITY)
    to = top[i, j]
    d = np.maximum(np.round((2 - 2 * near[i, j].astype(float)) * 1e6), 0).astype(np.int64) << 6
    return pd.DataFrame({"a": ids[i], "b": ids[to], "code": d | n[i] << 3 | n[to]})


def _turned(pairs: DataFrame) -> DataFrame:
    """(b, a, code) with the weights in the other order."""
    code = F.col("code")
    turned = F.shiftleft(F.shiftright(code, 6), 6) + F.shiftleft(code.bitwiseAND(7), 3) + F.shiftright(code, 3).bitwiseAND(7)
    return pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), turned.alias("code"))


def _by_leaf(of_leaf):
    """A mapInPandas function for rows sorted by leaf; one leaf is held at a time."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            leaf = pdf.leaf.to_numpy()
            cuts = np.flatnonzero(leaf[1:] != leaf[:-1]) + 1
            for part in (pdf.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, len(pdf)])):
                if held and len(part) and held[0].leaf.iloc[0] != part.leaf.iloc[0]:
                    yield of_leaf(pd.concat(held))
                    held = []
                if len(part):
                    held.append(part)
        if held:
            yield of_leaf(pd.concat(held))

    return scan


def _leafed(base: DataFrame, of_leaf, schema: str, rows: int, probes: int, reach: float, ranked: int = RANKED) -> DataFrame:
    n = base.count()
    if n // rows > SAMPLE:
        base, pivots = routed(base, n, rows, probes, reach, ranked), None
    else:
        pivots = pivots_of(base, n, rows)
        if not len(pivots):
            return base.sparkSession.createDataFrame([], schema)
    by_leaf = leafed(base, pivots, probes, reach, crossed=True).repartition("leaf").sortWithinPartitions("leaf")
    return written(by_leaf.mapInPandas(_by_leaf(of_leaf), schema))


def star_table(base: DataFrame) -> DataFrame:
    """(member, a, b, w, scale): the memberships and links of all leaves' stars. base: (id, n, x)."""
    return _leafed(base, _star_leaf, _STARS, LEAF_ROWS, PROBES, NEAR)


def verified(table: DataFrame) -> DataFrame:
    """(id, star, d): the memberships within the row's scale, its least over all leaves.

    That undoes what a leaf that held only a part of the row's neighbours let pass."""
    m = table.where("member").groupBy("a", "b").agg(F.min("w").alias("d"), F.min("scale").alias("scale"))
    scale = m.groupBy("a").agg(F.min("scale").alias("least"))
    enough = scale.where(F.col("least") <= 2 - 2 * MIN_SIMILARITY)
    m = m.join(enough, "a").join(enough.select(F.col("a").alias("b"), F.col("least").alias("of_b")), "b")
    return written(m.where(F.col("d") <= SCALE * F.least("least", "of_b")).select(F.col("a").alias("id"), F.col("b").alias("star"), "d"))


def _least_scales(table: DataFrame) -> DataFrame:
    return table.where("member").groupBy(F.col("a").alias("id")).agg(F.min("scale").alias("scale"))


def leftovers(base: DataFrame, table: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """More memberships (id, star, d) and links (a, b, w) for the rows that found no star.

    They are indexed again, with more probes, among themselves and at most `AGAIN_ROWS` rows of each star, which only serve as
    neighbours. A row's scale comes from its neighbours in all leaves together, so the few members of a small cluster need not
    all meet in one leaf. Each row that has a neighbour in scale becomes a star of its own, linked with its neighbours'."""
    rank = F.row_number().over(Window.partitionBy("star").orderBy("d", "id"))
    some = written(placed.withColumn("rank", rank).where(f"rank <= {AGAIN_ROWS}").select("id", "star"))
    out = base.join(placed.select("id").distinct(), "id", "left_anti")
    chosen = some.select("id").distinct().withColumn("free", F.lit(False))
    pool = written(out.withColumn("free", F.lit(True)).unionByName(base.join(chosen, "id")))
    pairs = _leafed(pool.select("id", "n", "x"), _pair_leaf, _PAIRS, AGAIN_LEAF_ROWS, AGAIN_PROBES, AGAIN_NEAR, AGAIN_RANKED)
    # one shuffle by the pair's first end: its pairs once each, and the neighbour with which neighbours and own copies are enough
    once = pairs.unionByName(_turned(pairs)).repartition("a").groupBy("a", "b").agg(F.min("code").alias("code"))
    upto = F.sum(F.col("code").bitwiseAND(7)).over(Window.partitionBy("a").orderBy("code", "b").rowsBetween(Window.unboundedPreceding, 0))
    once = once.withColumn("d", F.shiftright("code", 6) / 1e6).withColumn("enough", upto + F.shiftright("code", 3).bitwiseAND(7) - 1 >= MIN_SIZE - 1)
    scale = F.min(F.when(F.col("enough"), F.greatest("d", F.lit(1e-4)))).over(Window.partitionBy("a"))
    pairs = written(once.select("a", "b", "d", scale.alias("scale")))
    fourth = pairs.where("scale is not null").groupBy(F.col("a").alias("id")).agg(F.min("scale").alias("scale"))
    scales = written(fourth.unionByName(_least_scales(table)).groupBy("id").agg(F.min("scale").alias("scale")))
    free = written(pool.where("free").select(F.col("id").alias("a")).distinct())
    kept = pairs.select("a", "b", "d").join(free, "a", "left_semi").join(scales.select(F.col("id").alias("a"), F.col("scale").alias("of_a")), "a").join(scales.select(F.col("id").alias("b"), F.col("scale").alias("of_b")), "b")
    kept = written(kept.where(F.col("d") <= SCALE * F.least("of_a", "of_b")).select("a", "b", "d"))
    own = kept.select(F.col("a").alias("id"), F.col("a").alias("star"), F.lit(0.0).alias("d")).distinct()
    # a neighbour's star is one it belongs to, or itself if it was free too
    there = some.select(F.col("id").alias("b"), "star").unionByName(own.select(F.col("id").alias("b"), "star"))
    links = kept.join(there, "b").select("a", F.col("star").alias("b"), F.lit(1.0).alias("w")).where("a <> b")
    return own, links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def star_graph(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: id, star, d) and (graph: a, b, w, both directions, without loops) of the nodes (id, n, x)."""
    table = star_table(base)
    placed = verified(table)
    own, more = leftovers(base, table, placed)
    m = written(placed.unionByName(own))
    # a row has as many memberships as probes at most, so this makes a bounded number of pairs a row
    shared = m.alias("x").join(m.alias("y"), F.expr("x.id = y.id and x.star <> y.star")).select(F.col("x.star").alias("a"), F.col("y.star").alias("b"), F.lit(1.0).alias("w"))
    alive = m.select(F.col("star").alias("s")).distinct()
    linked = table.where("not member").select("a", "b", "w")
    linked = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).unionByName(more)
    linked = linked.join(alive, F.col("a") == F.col("s"), "left_semi").join(alive, F.col("b") == F.col("s"), "left_semi")
    graph = shared.unionByName(linked).groupBy("a", "b").agg(F.sum("w").alias("w"))
    return m, written(graph)


def markov_clusters(graph: DataFrame, inflation: float = INFLATION, prune: float = PRUNE) -> DataFrame:
    """(node, attractor, flow): Markov clustering of the nodes of a symmetric graph (a, b, w).

    The matrix is a table (col, row, w) whose columns sum to 1. Each round joins it with itself, which squares it, raises the
    entries to the inflation power and drops those below `prune` of their column, its largest excepted; the written rounds cut
    the lineage. Columns that flow wholly to a row that flows to itself have ended: they are not squared again, only read by
    the columns that still flow through them, so an attractor that many nodes have reached is no hot key. What of a row is still
    large AQE splits as a skewed join."""
    loops = graph.groupBy("a").agg(F.max("w").alias("w")).select("a", F.col("a").alias("b"), "w")
    # weights differ by orders of magnitude between large and small stars; their root keeps the flow between both
    matrix = written(_inflated(graph.unionByName(loops).select(F.col("a").alias("col"), F.col("b").alias("row"), F.sqrt("w").alias("p")), 0.0))
    for _ in range(MOST_ROUNDS):
        right = matrix.select(F.col("col").alias("row"), F.col("row").alias("far"), F.col("w").alias("w2"))
        squared = matrix.where("not ended").join(right, "row").groupBy("col", "far").agg(F.sum(F.col("w") * F.col("w2")).alias("w"))
        active = _inflated(squared.select("col", F.col("far").alias("row"), F.pow("w", F.lit(inflation)).alias("p")), prune)
        fixed = matrix.where("attractor").select("row", F.lit(True).alias("fixed"))
        active = active.join(fixed, "row", "left").withColumn("ended", F.col("single") & F.coalesce("fixed", F.lit(False))).drop("fixed")
        matrix = written(active.unionByName(matrix.where("ended")))
        if matrix.where(f"chaos > {STILL}").isEmpty():
            break
    else:
        raise RuntimeError(f"Markov clustering did not stand still in {MOST_ROUNDS} rounds")
    best = F.max_by(F.struct("row", "w"), F.struct("w", -F.col("row")))
    return matrix.groupBy("col").agg(best.alias("best")).select(F.col("col").alias("node"), F.col("best.row").alias("attractor"), F.col("best.w").alias("flow"))


def _inflated(powers: DataFrame, prune: float) -> DataFrame:
    """(col, row, w, chaos, single, attractor, ended) of the entries (col, row, p): pruned, each column's sum 1.

    Kept are the entries of at least `prune` of their column and its largest. chaos is 0 where a column's entries are equal."""
    column = Window.partitionBy("col")
    p = powers.withColumn("w", F.round(F.col("p") / F.sum("p").over(column), PLACES)).drop("p")
    p = p.withColumn("top", F.max(F.struct("w", (-F.col("row")).alias("row"))).over(column))
    p = p.where((F.col("w") >= prune) & (F.col("w") > 0) | (F.col("row") == -F.col("top.row"))).drop("top")
    p = p.withColumn("w", F.round(F.col("w") / F.sum("w").over(column), PLACES))
    p = p.withColumn("chaos", F.max("w").over(column) - F.sum(F.col("w") * F.col("w")).over(column)).withColumn("single", F.count("*").over(column) == 1)
    return p.withColumn("attractor", F.col("single") & (F.col("row") == F.col("col"))).withColumn("ended", F.lit(False))


def _joined_attractors(clusters: DataFrame) -> DataFrame:
    """(node, attractor, flow) with the attractors that flow to each other as one: the smallest of the circle that they reach.

    Paths of attractors double in each round, with the smallest attractor on each, until no circle's smallest one changes. Only
    attractors take part; the nodes follow by one join."""
    clusters = written(clusters)
    seen = clusters.select(F.col("attractor").alias("node")).distinct()
    step = seen.join(clusters, "node", "left").select("node", F.coalesce("attractor", "node").alias("next"))
    step = written(step.withColumn("least", F.least("node", "next")))
    while True:
        there = step.select(F.col("node").alias("next"), F.col("next").alias("after"), F.col("least").alias("least_after"))
        both = step.join(there, "next")
        moved = written(both.select("node", F.col("after").alias("next"), F.least("least", "least_after").alias("least"), F.col("least_after").alias("root")))
        last = moved.select(F.col("node").alias("next"), F.col("least").alias("new_root"))
        if moved.join(last, "next").where("new_root <> root").isEmpty():
            break
        step = moved.drop("root")
    roots = moved.select(F.col("node").alias("attractor"), "root")
    return _salted(clusters.withColumnRenamed("node", "id"), roots, "attractor").select(F.col("id").alias("node"), F.col("root").alias("attractor"), "flow")


def cluster_vectors(rows: DataFrame, id_col: str, vector_col: str, min_size: int = MIN_SIZE, dim: int = DIM) -> DataFrame:
    """(id, cluster, distance, flow): the clusters of at least `min_size` ids; cluster is the smallest id of its members."""
    nodes, ids = nodes_of(valid(rows, id_col, vector_col, dim))
    members, graph = star_graph(nodes)
    flows = _joined_attractors(markov_clusters(graph))
    placed = members.join(flows.select(F.col("node").alias("star"), "attractor", "flow"), "star", "left")
    placed = placed.withColumn("cluster", F.coalesce("attractor", "star"))
    # a node whose stars fell into several clusters goes where most and the nearest of them are
    votes = placed.groupBy("id", "cluster").agg(F.count("*").alias("k"), F.min("d").alias("distance"), F.max(F.coalesce("flow", F.lit(1.0))).alias("flow"))
    best = votes.groupBy("id").agg(F.max_by(F.struct("cluster", "distance", "flow"), F.struct("k", -F.col("distance"), -F.col("cluster"))).alias("b")).select(F.col("id").alias("node"), "b.*")
    # a direction that a third of the ids have is a skewed join of narrow rows, which AQE splits
    best = written(ids.join(best, "node").select("id", "cluster", "distance", "flow"))
    large = best.groupBy("cluster").agg(F.count("*").alias("size"), F.min("id").alias("first")).where(f"size >= {min_size}")
    return _salted(best, large, "cluster").select("id", F.col("first").alias("cluster"), "distance", "flow")


def _salted(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """`rows` joined with the one row of each key in `table`; a key with a third of all rows meets `SALTS` tasks."""
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("long")).join(spread, [key, "_salt"]).drop("_salt")


def first_members(clusters: DataFrame) -> DataFrame:
    """(first_id, id): each cluster's smallest id with each other member."""
    return clusters.where("id <> cluster").select(F.col("cluster").alias("first_id"), "id")


def cluster_summary(clusters: DataFrame, typical: int = 5) -> DataFrame:
    """(cluster, size, members): the size and the `typical` members of strongest flow, the nearest to their star first.

    Each of a cluster's `SALTS` parts keeps its `typical` best rows by rank, so no group is collected whole."""
    order = [F.col("flow").desc(), F.col("distance"), F.col("id")]
    part = clusters.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    kept = part.withColumn("rank", F.row_number().over(Window.partitionBy("cluster", "part").orderBy(*order))).where(f"rank <= {typical}")
    best = kept.groupBy("cluster").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("flow")).alias("f"), "distance", "id"))), 1, typical).alias("best"))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    return sizes.join(best, "cluster").select("cluster", "size", F.col("best.id").alias("members"))
