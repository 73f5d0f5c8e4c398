"""Approximate nearest neighbours with robust-pruned directed graphs, one per shard.

Equal vectors are one node. Nodes are dealt to shards by a hash; in each shard they are
inserted in batches: a greedy beam search on the graph so far proposes neighbours, relaxed
distance pruning keeps diverse ones (an edge goes when a kept neighbour is ``alpha`` times
closer to its end), and back edges are pruned alike. A query runs a beam search in every
shard, and the shards' nearest are merged by exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize

#: Nodes of a shard (about 1 KB each while its graph is built): a 64th of all, within these bounds.
SHARD_NODES = (8192, 131_072)
#: Edges of a node, beam widths of inserting and of querying, and the pruning's relaxation.
DEGREE, BUILD_BEAM, QUERY_BEAM, ALPHA = 32, 64, 192, 1.1
#: Nodes that every search starts from: the middle one and those far from the others.
ENTRIES = 8
#: Nodes or queries that walk the graph side by side, and expansions of each in one step.
BATCH, EXPAND = 512, 4


def _gaps(q: np.ndarray, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own row of nodes; inf where a node is -1."""
    d = x[np.maximum(ids, 0)] - q[:, None, :]
    return np.where(ids < 0, np.inf, np.einsum("bnd,bnd->bn", d, d))


def beam_search(x: np.ndarray, graph: np.ndarray, entry: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest nodes found (-1 where fewer) and their squared distances, nearest first, (queries, width)."""
    b = len(q)
    ids, gap, done = np.full((b, width), -1, np.int32), np.full((b, width), np.inf), np.zeros((b, width), bool)
    first = entry[:width]
    ids[:, : len(first)] = first
    gap[:, : len(first)] = _gaps(q, x, ids[:, : len(first)])
    live = np.arange(b)
    while len(live):
        open_gap = np.where(done[live] | (ids[live] < 0), np.inf, gap[live])
        take = np.argpartition(open_gap, min(EXPAND, width) - 1, axis=1)[:, :EXPAND]
        good = np.isfinite(np.take_along_axis(open_gap, take, 1))
        some = good.any(1)
        live, take, good = live[some], take[some], good[some]
        if not len(live):
            break
        done[live[:, None], take] |= good
        near = graph[np.where(good, ids[live[:, None], take], -1)]
        near[~good] = -1
        near = np.sort(near.reshape(len(live), -1), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[(near[:, :, None] == ids[live][:, None, :]).any(2)] = -1
        all_ids = np.concatenate([ids[live], near], 1)
        all_gap = np.concatenate([gap[live], _gaps(q[live], x, near)], 1)
        all_done = np.concatenate([done[live], np.zeros(near.shape, bool)], 1)
        best = np.argpartition(all_gap, width - 1, axis=1)[:, :width]
        ids[live], gap[live], done[live] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_gap, all_done))
    order = np.argsort(gap, axis=1, kind="stable")
    ids, gap = np.take_along_axis(ids, order, 1), np.take_along_axis(gap, order, 1)
    return np.where(np.isinf(gap), -1, ids), gap


def robust_prune(x: np.ndarray, nodes: np.ndarray, options: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each node among its row of options (-1: none)."""
    options = np.sort(np.where(options == nodes[:, None], -1, options), axis=1)
    options[:, 1:][options[:, 1:] == options[:, :-1]] = -1
    v = x[np.maximum(options, 0)] - x[nodes][:, None, :]  # from the node on: single precision must tell near options apart
    gap = _gaps(x[nodes], x, options)
    square = np.einsum("bcd,bcd->bc", v, v)
    between = np.maximum(square[:, :, None] + square[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1)), 0)
    out, row, relax = np.full((len(nodes), degree), -1, np.int32), np.arange(len(nodes)), alpha * alpha
    alive = gap.copy()
    for k in range(min(degree, options.shape[1])):
        pick = alive.argmin(1)
        has = np.isfinite(alive[row, pick])
        if not has.any():
            break
        out[:, k] = np.where(has, options[row, pick], -1)
        alive[relax * between[row, pick] <= gap] = np.inf
        alive[row, pick] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of every node (-1 where fewer than ``degree``) and the nodes searches start from."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int32)
    entry = _entries(x)
    order = np.random.default_rng(seed).permutation(n).astype(np.int32)
    order = np.concatenate([entry, order[~np.isin(order, entry)]])
    at, size = 0, max(8, len(entry))
    while at < n:
        batch = order[at : at + size]
        found, _ = beam_search(x, graph, entry[:at] if at < len(entry) else entry, x[batch], beam)
        if size < BATCH:  # while the graph is small, those inserted together are options too
            found = np.concatenate([found, np.broadcast_to(batch, (len(batch), len(batch)))], 1)
        graph[batch] = robust_prune(x, batch, found, degree, alpha)
        _add_back_edges(x, graph, batch, degree, alpha)
        at, size = at + len(batch), min(2 * size, BATCH)
    return _link_unreached(x, graph, entry, beam), entry


def _entries(x: np.ndarray) -> np.ndarray:
    """The middle node, then the farthest from those chosen, while any is apart from them."""
    if not len(x):
        return np.zeros(0, np.int32)
    out = [int(((x - x.mean(0)) ** 2).sum(1).argmin())]
    gap = ((x - x[out[0]]) ** 2).sum(1)
    while len(out) < ENTRIES and gap.max() > 0:
        out.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[out[-1]]) ** 2).sum(1))
    return np.array(out, np.int32)


def _reach(graph: np.ndarray, reached: np.ndarray, front: np.ndarray) -> None:
    """Mark all that can be reached from ``front``."""
    while len(front):
        reached[front] = True
        near = np.unique(graph[front])
        front = near[(near >= 0) & ~reached[near]]


def _link_unreached(x: np.ndarray, graph: np.ndarray, entry: np.ndarray, beam: int) -> np.ndarray:
    """The graph with an edge to every node that pruning has cut off, from a near one that searches
    reach; such edges are not pruned, and a node without room for one gets it in a further column."""
    reached = np.zeros(len(x), bool)
    _reach(graph, reached, entry)
    while not reached.all():
        batch = np.flatnonzero(~reached)[:BATCH]
        found, _ = beam_search(x, graph, entry, x[batch], beam)
        used = (graph >= 0).sum(1)
        for node, near in zip(batch, found):
            near = near[near >= 0]
            room = near[used[near] < graph.shape[1]]
            if not len(room):
                graph = np.concatenate([graph, np.full((len(graph), 4), -1, np.int32)], 1)
                room = near
            graph[room[0], used[room[0]]] = node
            used[room[0]] += 1
        _reach(graph, reached, batch)
    return graph


def _add_back_edges(x, graph, batch, degree, alpha) -> None:
    source, target = np.repeat(batch, degree), graph[batch].reshape(-1)
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, start, count = np.unique(target, return_index=True, return_counts=True)
    for lo in range(0, len(nodes), BATCH):
        part, s, c = nodes[lo : lo + BATCH], start[lo : lo + BATCH], count[lo : lo + BATCH]
        width = int(c.max())
        k = np.arange(width)
        new = np.where(k < c[:, None], source[np.minimum(s[:, None] + k, len(source) - 1)], -1)
        new[(new[:, :, None] == graph[part][:, None, :]).any(2)] = -1
        both = -np.sort(-np.concatenate([graph[part], new], 1), axis=1)
        fits = (both >= 0).sum(1) <= degree
        graph[part[fits]] = both[fits][:, :degree] if both.shape[1] >= degree else np.pad(both[fits], ((0, 0), (0, degree - both.shape[1])), constant_values=-1)
        full = np.flatnonzero(~fits)
        for m in range(0, len(full), 128):  # a row may have many options
            sub = full[m : m + 128]
            most = int((both[sub] >= 0).sum(1).max())
            graph[part[sub]] = robust_prune(x, part[sub], both[sub][:, :most], degree, alpha)


def _distinct(kind: str, keep: int):
    """mapInPandas body: (vec_id, embedding) to one row per distinct vector of a batch with its least ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [(np.asarray(v, kind) + np.dtype(kind).type(0)).tobytes() for v in pdf["embedding"]]
            ids: dict[bytes, list[int]] = {}
            for vec, i in sorted(set(zip(raw, pdf["vec_id"].tolist()))):
                ids.setdefault(vec, []).append(i)
            yield pd.DataFrame({"vec": list(ids), "ids": [x[:keep] for x in ids.values()]})

    return run


def vectors_of(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, embedding) of the rows with an id and a usable vector: not null, not all zero,
    no null or non-finite component."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding")).where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def _build(kind: str, degree: int, beam: int, alpha: float):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec")
        x = np.frombuffer(b"".join(pdf["vec"]), kind).reshape(len(pdf), -1)
        wide = x.astype(np.float64)
        graph, entry = build_graph(((wide - wide.mean(0)) * _walk_scale(x)).astype(np.float32), degree, beam, alpha, seed=int(key[1]))
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "nodes": [len(pdf)], "vecs": [x.tobytes()], "graph": [graph.tobytes()], "entry": [entry.tobytes()], "ids": [list(pdf["ids"])]})

    return run


def _walk_scale(x: np.ndarray) -> float:
    """Single precision suffices for walking the graph, but sums of squares must not overflow it."""
    most = float(np.abs(x).max()) if x.size else 0.0
    return 1 / most if most > 1e15 or 0 < most < 1e-15 else 1.0


def build_index(rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", keep: int = 11, shard_nodes: int | None = None, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> DataFrame:
    """The written index, one row per shard: (dim, shard, nodes, vecs, graph, entry, ids).

    Every usable vector is in it, in shards whose size follows from their number unless
    ``shard_nodes`` gives it. A node carries the ``keep`` least ids of its equal vectors:
    a result of fewer than ``keep`` places can hold no other, since ties go to the least id."""
    kind = "<f4" if rows.schema[vec_col].dataType.elementType.typeName() == "float" else "<f8"
    if kind == "<f8":
        rows = rows.withColumn(vec_col, F.col(vec_col).cast("array<double>"))
    local = vectors_of(rows, id_col, vec_col).mapInPandas(_distinct(kind, keep), "vec binary, ids array<long>")
    some = local.groupBy("vec", F.spark_partition_id().alias("p")).agg(F.collect_list("ids").alias("ids"))
    least = lambda c: F.slice(F.array_distinct(F.sort_array(F.flatten(c))), 1, keep)
    nodes = materialize(some.select("vec", least(F.col("ids")).alias("ids")).groupBy("vec").agg(F.collect_list("ids").alias("ids")).select("vec", least(F.col("ids")).alias("ids"), F.length("vec").alias("dim")))
    total = F.count(F.lit(1))
    held = F.least(F.greatest(total / 64, F.lit(SHARD_NODES[0])), F.lit(SHARD_NODES[1])) if shard_nodes is None else F.lit(shard_nodes)
    shards = materialize(nodes.groupBy("dim").agg(F.ceil(total / held).cast("long").alias("shards")))
    tasks = shards.agg(F.coalesce(F.sum("shards"), F.lit(1))).first()[0]
    dealt = nodes.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("vec"), F.col("shards")))
    # by an own number of partitions, so that no two shards are put into one task to save tasks
    dealt = dealt.repartition(4 * tasks, "dim", "shard")
    return materialize(dealt.groupBy("dim", "shard").applyInPandas(_build(kind, degree, beam, alpha), "dim int, shard long, nodes long, vecs binary, graph binary, entry binary, ids array<array<long>>"))


class _Shard:
    """One shard of the index, as a query meets it."""

    def __init__(self, row, kind: str):
        n = int(row["nodes"])
        self.exact, self.graph = np.frombuffer(row["vecs"], kind).reshape(n, -1).astype(np.float64), np.frombuffer(row["graph"], np.int32).reshape(n, -1)
        self.entry, self.scale, self.ids = np.frombuffer(row["entry"], np.int32), _walk_scale(self.exact), row["ids"]
        self.middle = self.exact.mean(0)
        self.x = ((self.exact - self.middle) * self.scale).astype(np.float32)

    def nearest(self, queries: pd.DataFrame, kind: str, k: int, beam: int) -> pd.DataFrame:
        """Each query's ``k`` nearest of the shard: (query_id, q, vec_id, score)."""
        out = []
        for lo in range(0, len(queries), BATCH):
            rows = queries.iloc[lo : lo + BATCH]
            part = np.frombuffer(b"".join(rows["vec"]), kind).reshape(len(rows), -1).astype(np.float64)
            found, _ = beam_search(self.x, self.graph, self.entry, ((part - self.middle) * self.scale).astype(np.float32), beam)
            for i, (nodes, own, q) in enumerate(zip(found, rows["query_id"], rows["q"])):
                nodes = nodes[nodes >= 0]
                score = np.sqrt(((self.exact[nodes] - part[i]) ** 2).sum(1))
                hits, last = [], np.inf
                for j in np.argsort(score, kind="stable"):
                    if len(hits) >= k and score[j] > last:
                        break
                    hits += [(score[j], int(v)) for v in self.ids[nodes[j]] if v != own]
                    last = score[j]
                out += [(own, q, v, d) for d, v in sorted(hits)[:k]]
        return pd.DataFrame(out, columns=["query_id", "q", "vec_id", "score"])


def _search(kind: str, k: int, beam: int):
    """mapInPandas body over rows sorted by (dim, shard), the shard's own row first: its queries stream past it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, shard = None, None
        for pdf in batches:
            for key, here in pdf.groupby(["dim", "shard"], sort=True):
                if key != current:
                    current, shard = key, None
                stored, asked = here[here["turn"] == 0], here[here["turn"] > 0]
                if len(stored):
                    shard = _Shard(stored.iloc[0], kind)
                if len(asked) and shard is not None:
                    yield shard.nearest(asked, kind, k, beam)

    return run


def search_index(index: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", beam: int = QUERY_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query row by Euclidean
    distance in double precision, ties to the smaller vec_id; a row's own id is no candidate.

    Unusable query vectors (null, zero, null or non-finite components) and null ids are left
    out; repeated rows are one query; only vectors of the same length are compared; fewer
    candidates than ``k`` give fewer ranks; empty tables give no rows. A shard is moved once,
    however many queries there are."""
    kind = "<f4" if queries.schema[vec_col].dataType.elementType.typeName() == "float" else "<f8"
    if kind == "<f8":
        queries = queries.withColumn(vec_col, F.col(vec_col).cast("array<double>"))
    asked = vectors_of(queries, id_col, vec_col).mapInPandas(_distinct(kind, 1 << 62), "vec binary, ids array<long>")
    asked = materialize(asked.select("vec", F.explode("ids").alias("query_id")).distinct())
    asked = asked.select("query_id", "vec", F.xxhash64("vec").alias("q"), F.length("vec").alias("dim"))
    shards = index.groupBy("dim").agg((F.max("shard") + 1).alias("shards"))
    number = index.count()
    sent = asked.join(shards, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).drop("shards")
    # no nulls in integer columns: they would reach the task as doubles
    zero = F.lit(0).cast("long")
    held = index.select("*", F.lit(0).alias("turn"), zero.alias("query_id"), zero.alias("q"))
    met = held.unionByName(sent.withColumn("turn", F.lit(1)).withColumn("nodes", zero), allowMissingColumns=True)
    met = met.repartition(max(1, 4 * number), "dim", "shard").sortWithinPartitions("dim", "shard", "turn")
    found = met.mapInPandas(_search(kind, k, beam), "query_id long, q long, vec_id long, score double")
    place = F.row_number().over(W.partitionBy("query_id", "q").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_neighbours(rows: DataFrame, query_rows: Column, *, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Index all rows and search it with those that ``query_rows`` picks."""
    return search_index(build_index(rows, id_col=id_col, vec_col=vec_col, keep=k + 1), rows.where(query_rows), k=k, id_col=id_col, vec_col=vec_col)
