"""Nearest neighbours: a hierarchical navigable small-world graph per shard in flat arrays, shard results merged."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Written


class Graph:
    """A hierarchical navigable small-world graph over distinct vectors, built by greedy insertion.

    Level 0 holds all nodes, each further level about one in `degree` of the one below. Nodes are inserted in growing
    batches: a node descends from the entry to its own level and looks there for its nearest nodes with a beam, among
    those inserted before and the others of its batch. Of these it keeps ones that are nearer to it than to any it has
    kept. Links run both ways; a node with too many keeps the ones such a choice leaves. In the end nodes out of reach
    of the entry are tied to their nearest reachable node, and a level's neighbours lie one after another in one array
    (neighbours of node i at first[i]:first[i + 1])."""

    def __init__(self, vectors: np.ndarray, degree: int = 16, candidates: int = 48, batch: int = 32):
        self.vectors, self.degree, self.candidates = vectors, degree, candidates
        self.scale = float(np.abs(vectors).max()) or 1.0
        self.near = self._scaled(vectors)
        n = len(vectors)
        draw = np.random.default_rng(n).random(n)
        level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / math.log(degree)).astype(int), 8)
        level[0] = level.max()
        self.entry = 0
        #: While building, a row of neighbours for each node and level, -1 where there is none.
        self.rows = [np.full((n, 2 * degree if depth == 0 else degree), -1, dtype=np.int32) for depth in range(int(level.max()) + 1)]
        at = 1
        while at < n:
            nodes = np.arange(at, min(at + max(batch, min(at // 4, 512)), n))
            self._insert(nodes, level[nodes])
            at += len(nodes)
        self.levels = [self._flat(depth, np.flatnonzero(level >= depth)) for depth in range(len(self.rows))]
        del self.rows

    def _scaled(self, points: np.ndarray) -> np.ndarray:
        """Points in single precision, as the graph compares them; answers are measured on the vectors as given."""
        return (points / self.scale).astype(np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "near"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.near = self._scaled(self.vectors)

    def _insert(self, nodes: np.ndarray, level: np.ndarray) -> None:
        start = np.full((len(nodes), 1), self.entry)
        for depth in range(len(self.rows) - 1, -1, -1):
            wide = np.flatnonzero(level >= depth)
            narrow = np.flatnonzero(level < depth)
            fresh = start.copy()
            if len(narrow):
                fresh[narrow] = self._beam(self.near[nodes[narrow]], start[narrow], self._row_of(depth), 1)[0][:, :1]
            if len(wide):
                found, far = self._beam(self.near[nodes[wide]], start[wide], self._row_of(depth), self.candidates)
                fresh[wide] = found[:, :1]
                self._connect(depth, nodes[wide], found, far)
            start = fresh

    def _connect(self, depth: int, nodes: np.ndarray, found: np.ndarray, far: np.ndarray) -> None:
        points = self.near[nodes]
        norms = (points**2).sum(axis=1)
        beside = np.maximum(norms[:, None] + norms[None, :] - 2 * points @ points.T, 0)
        np.fill_diagonal(beside, np.inf)
        m = min(self.candidates, len(nodes))
        own = np.argpartition(beside, m - 1, axis=1)[:, :m]
        near = np.concatenate((found, nodes[own]), axis=1)
        far = np.concatenate((far, np.take_along_axis(beside, own, axis=1)), axis=1)
        order = np.argsort(far, axis=1, kind="stable")[:, : self.candidates]
        near, far = np.take_along_axis(near, order, axis=1), np.take_along_axis(far, order, axis=1)
        row, column = np.nonzero(self._diverse(near, far, self.degree))
        one, two = nodes[row], near[row, column]
        self._link(depth, np.concatenate((one, two)), np.concatenate((two, one)))

    def _diverse(self, near: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
        """Which of the neighbours (nearest first, inf: none) are nearer to the node than to any chosen before."""
        chosen = np.zeros(near.shape, dtype=bool)
        for at in range(0, len(near), 256):
            rows = slice(at, at + 256)
            points = self.near[near[rows]]
            norms = (points**2).sum(axis=2)
            cross = norms[:, :, None] + norms[:, None, :] - 2 * points @ points.transpose(0, 2, 1)
            closest = np.full(near[rows].shape, np.inf)
            for k in range(near.shape[1]):
                take = np.isfinite(far[rows, k]) & (far[rows, k] < closest[:, k]) & (chosen[rows].sum(axis=1) < most)
                chosen[rows, k] = take
                closest = np.where(take[:, None], np.minimum(closest, cross[:, k, :]), closest)
        return chosen

    def _link(self, depth: int, heads: np.ndarray, others: np.ndarray) -> None:
        table = self.rows[depth]
        touched = np.unique(heads)
        row, column = np.nonzero(table[touched] >= 0)
        pairs = np.unique(np.stack((np.concatenate((heads, touched[row])), np.concatenate((others, table[touched][row, column]))), axis=1), axis=0)
        far = self._far(pairs[:, 0], self.near[pairs[:, 1]])
        order = np.lexsort((far, pairs[:, 0]))
        pairs, far = pairs[order], far[order]
        place = np.searchsorted(touched, pairs[:, 0])
        count = np.bincount(place, minlength=len(touched))
        spot = np.arange(len(pairs)) - np.repeat(np.cumsum(count) - count, count)
        near = np.zeros((len(touched), int(count.max())), dtype=np.int64)
        span = np.full(near.shape, np.inf)
        near[place, spot], span[place, spot] = pairs[:, 1], far
        full = np.flatnonzero(count > table.shape[1])
        kept = np.isfinite(span)
        kept[full] = self._diverse(near[full], span[full], table.shape[1])
        front = np.argsort(~kept, axis=1, kind="stable")[:, : table.shape[1]]
        fresh = np.full((len(touched), table.shape[1]), -1, dtype=np.int32)
        fresh[:, : front.shape[1]] = np.where(np.take_along_axis(kept, front, axis=1), np.take_along_axis(near, front, axis=1), -1)
        table[touched] = fresh

    def _row_of(self, depth: int) -> Callable[[np.ndarray], np.ndarray]:
        return self.rows[depth].__getitem__

    def _flat(self, depth: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, column = np.nonzero(self.rows[depth][nodes] >= 0)
        inner = np.zeros(len(self.vectors), dtype=np.int64)
        inner[nodes] = np.arange(len(nodes))
        links = np.stack((row, inner[self.rows[depth][nodes][row, column]]), axis=1)
        links = self._reach(links, self.near[nodes], len(nodes))
        first = np.zeros(len(self.vectors) + 1, dtype=np.int64)
        np.add.at(first, nodes[links[:, 0]] + 1, 1)
        return np.cumsum(first), nodes[links[:, 1]].astype(np.int32)

    @staticmethod
    def _reach(links: np.ndarray, points: np.ndarray, n: int) -> np.ndarray:
        """The links, with more where they leave nodes that can't be reached from node 0."""
        links = np.unique(links, axis=0)
        seen = np.zeros(n, dtype=bool)
        seen[0] = True
        first = np.searchsorted(links[:, 0], np.arange(n + 1))
        front = np.array([0])
        while True:
            while len(front):
                size = first[front + 1] - first[front]
                ahead = links[np.repeat(first[front] - (np.cumsum(size) - size), size) + np.arange(int(size.sum())), 1]
                front = np.unique(ahead[~seen[ahead]])
                seen[front] = True
            lost = np.flatnonzero(~seen)
            if not len(lost):
                return links
            inside = np.flatnonzero(seen)
            near = inside[((points[inside] - points[lost[0]]) ** 2).sum(axis=1).argmin()]
            links = np.unique(np.concatenate((links, [[near, lost[0]], [lost[0], near]])), axis=0)
            first = np.searchsorted(links[:, 0], np.arange(n + 1))
            front = lost[:1]
            seen[front] = True

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the nodes of its final beam, nearest first, and their scaled squared distances (inf: none)."""
        queries = self._scaled(queries)
        at = np.full((len(queries), 1), self.entry)
        for depth in range(len(self.levels) - 1, 0, -1):
            at = self._beam(queries, at, self._flat_row_of(depth), 4)[0][:, :1]
        return self._beam(queries, at, self._flat_row_of(0), min(beam, len(self.vectors)))

    def _flat_row_of(self, depth: int) -> Callable[[np.ndarray], np.ndarray]:
        first, links = self.levels[depth]
        widest = int(np.diff(first).max()) if len(links) else 0

        def row(heads: np.ndarray) -> np.ndarray:
            reach = first[heads][:, None] + np.arange(widest)
            return np.where(reach < first[heads + 1][:, None], links[np.minimum(reach, max(len(links) - 1, 0))] if widest else -1, -1)

        return row

    def _far(self, nodes: np.ndarray, points: np.ndarray) -> np.ndarray:
        apart = self.near[nodes]
        apart -= points
        return np.einsum("ij,ij->i", apart, apart)

    def _beam(self, queries: np.ndarray, start: np.ndarray, neighbours: Callable[[np.ndarray], np.ndarray], beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, rows = len(queries), np.arange(len(queries))
        seen = np.zeros((n, len(self.vectors)), dtype=bool)
        node = np.full((n, beam), -1)
        far = np.full((n, beam), np.inf)
        done = np.ones((n, beam), dtype=bool)
        node[:, 0], done[:, 0] = start[:, 0], False
        far[:, 0] = self._far(start[:, 0], queries)
        seen[rows, start[:, 0]] = True
        while True:
            open_far = np.where(done, np.inf, far)
            best = open_far.argmin(axis=1)
            who = np.flatnonzero(np.isfinite(open_far[rows, best]))
            if not len(who):
                break
            best = best[who]
            done[who, best] = True
            next_node = neighbours(node[who, best])
            fresh = next_node >= 0
            fresh &= ~seen[who[:, None], np.maximum(next_node, 0)]
            row, column = np.nonzero(fresh)
            seen[who[row], next_node[row, column]] = True
            next_far = np.full(next_node.shape, np.inf)
            next_far[row, column] = self._far(next_node[row, column], queries[who[row]])
            every = np.concatenate((far[who], next_far), axis=1)
            pick = np.argpartition(every, beam - 1, axis=1)[:, :beam]
            far[who] = np.take_along_axis(every, pick, axis=1)
            node[who] = np.take_along_axis(np.concatenate((node[who], next_node), axis=1), pick, axis=1)
            done[who] = np.take_along_axis(np.concatenate((done[who], ~fresh), axis=1), pick, axis=1)
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(node, order, axis=1), np.take_along_axis(far, order, axis=1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector, dim) of the rows that take part: with an id, and neither null nor zero nor with null or non-finite
    components."""
    value = F.col(vector_col).cast("array<double>")
    fine = F.forall(value, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(fine & F.exists(value, lambda x: x != 0.0))
    return rows.select(F.col(id_col).cast("bigint").alias("id"), value.alias("vector"), F.size(vector_col).alias("dim"))


def _stacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = table.column("vector").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return table.column("id").to_numpy().astype(np.int64), column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def build_index(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 4096, degree: int = 16) -> DataFrame:
    """(shard, dim, graph): one graph for about shard_rows vectors of one dimension, as bytes of flat arrays.

    Rows are dealt out by a hash of their id, so neither sources nor equal vectors gather in a shard. Equal vectors of
    a shard are one node with all their ids; vectors of several dimensions have graphs of their own. Rows that usable()
    leaves out (null ids and vectors, zero ones, null or non-finite components) are in no shard, repeated rows are in
    one each, an empty table has none; other columns are not looked at."""
    rows = usable(vectors, id_col, vector_col)
    shards = int(rows.count() // shard_rows) + 1

    def build(table: pa.Table) -> pa.Table:
        ids, points = _stacked(table)
        order = np.argsort(ids, kind="stable")
        ids, points = ids[order], points[order]
        nodes, owner = np.unique(points, axis=0, return_inverse=True)
        members = np.argsort(owner.reshape(-1), kind="stable")
        first = np.concatenate(([0], np.cumsum(np.bincount(owner.reshape(-1), minlength=len(nodes)))))
        blob = pickle.dumps((Graph(nodes, degree), ids[members], first), protocol=5)
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "dim": pa.array([points.shape[1]], pa.int32()), "graph": pa.array([blob], pa.binary())})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard", "dim").applyInArrow(build, "shard int, dim int, graph binary")


def _packed(queries: DataFrame, block_rows: int) -> DataFrame:
    """(dim, chunk, ids, points): queries of one dimension in blocks, as bytes; a chunk is some blocks."""
    blocks = int(queries.count() // block_rows) + 1

    def pack(table: pa.Table) -> pa.Table:
        ids, points = _stacked(table)
        return pa.table({
            "dim": pa.array([points.shape[1]], pa.int32()), "chunk": pa.array([table.column("block")[0].as_py() // CHUNK], pa.int64()),
            "ids": pa.array([ids.tobytes()], pa.binary()), "points": pa.array([points.astype(np.float64).tobytes()], pa.binary()),
        })

    dealt = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    return dealt.groupBy("block", "dim").applyInArrow(pack, "dim int, chunk bigint, ids binary, points binary")


#: So many blocks of queries are answered by a shard's graph at a time.
CHUNK = 16


def nearest(
    vectors: DataFrame, queries: DataFrame, *, k: int = 10, beam: int = 96, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_rows: int = 4096, degree: int = 16, block_rows: int = 512,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest vectors found, nearest first.

    score is the Euclidean distance in double precision on the given vectors; ties go to the smaller vec_id. A query's
    own id is no candidate; only vectors of its dimension are. queries are rows like vectors. Rows without id, null or
    zero vectors and those with null or non-finite components take no part. Repeated rows of vectors count once for an
    id and vector; of query rows that share an id one is asked. Every shard answers every block of queries, a chunk of
    blocks for each time its graph is loaded; what a shard finds for a query is k rows."""
    kept = Written(vectors.sparkSession, "graphs")
    distinct = vectors.select(id_col, vector_col).dropDuplicates()
    graphs = kept.put("graphs", build_index(distinct, id_col=id_col, vector_col=vector_col, shard_rows=shard_rows, degree=degree))
    blocks = kept.put("blocks", _packed(usable(queries, id_col, vector_col).dropDuplicates(["id"]), block_rows))
    shards = graphs.select(F.col("shard").alias("at"), F.col("dim").alias("size"))
    asked = blocks.join(shards, F.col("dim") == F.col("size")).select("at", "size", F.col("chunk").alias("part"), "ids", "points")
    chunks = blocks.select(F.col("dim").alias("length"), F.col("chunk").alias("turn")).distinct()
    loaded = graphs.join(chunks, F.col("dim") == F.col("length")).select("shard", "length", "turn", "graph")

    def answer(shard: pa.Table, work: pa.Table) -> pa.Table:
        out = [FOUND.empty_table()]
        if shard.num_rows:
            tree, members, first = pickle.loads(shard.column("graph")[0].as_py())
            for ids, points in zip(work.column("ids"), work.column("points"), strict=True):
                query_ids = np.frombuffer(ids.as_py(), dtype=np.int64)
                rows = np.frombuffer(points.as_py(), dtype=np.float64).reshape(len(query_ids), -1)
                out.append(pa.Table.from_batches([_answers(tree, members, first, query_ids, rows, k, beam)]))
        return pa.concat_tables(out)

    found = loaded.groupBy("shard", "length", "turn").cogroup(asked.groupBy("at", "size", "part")).applyInArrow(answer, "query_id bigint, vec_id bigint, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _answers(tree: Graph, members: np.ndarray, first: np.ndarray, ids: np.ndarray, asked: np.ndarray, k: int, beam: int) -> pa.RecordBatch:
    nodes, _ = tree.search(asked, max(beam, k + 1))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for row, (query, point) in enumerate(zip(ids.tolist(), asked, strict=True)):
        own = nodes[row][nodes[row] >= 0]
        score = np.sqrt(((tree.vectors[own] - point) ** 2).sum(axis=1))
        # A node holds its ids in ascending order; k + 1 of them are enough, as one may be the query.
        take = np.minimum(first[own + 1] - first[own], k + 1)
        who = members[np.repeat(first[own] - np.concatenate(([0], np.cumsum(take)[:-1])), take) + np.arange(int(take.sum()))]
        far = np.repeat(score, take)[who != query]
        who = who[who != query]
        best = np.lexsort((who, far))[:k]
        out.append((np.full(len(best), query), who[best], far[best]))
    columns = [pa.array(np.concatenate(c)) if out else pa.array([], t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=FOUND)
