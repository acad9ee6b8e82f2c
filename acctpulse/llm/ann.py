"""Approximate nearest neighbours by largest inner product: a robust-pruned directed graph per shard.

Vectors are dealt to shards by hash. In each shard a graph is built by greedy searches from a fixed entry: the nodes a
search meets are the candidates for a node's neighbours, and relaxed distance pruning keeps those that no kept
neighbour is much nearer to, which leaves diverse edges. A query is answered by a beam search in every shard; the best
of all shards are scored again on the original vectors in double precision.

Largest inner product becomes smallest distance by one more dimension: a vector ``x`` gets ``sqrt(M^2 - |x|^2)``, with ``M``
the largest length in its shard, and a query gets 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acctpulse.session import staged

K, QUERY_EVERY = 20, 20
DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAX = 32, 64, 96, 1.2
SHARDS, SHARD_ROWS = 8, 200_000
_BATCH = 256


def beam_search(points: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes each query meets, nearest first, and their squared distances (-1 and inf: none).

    ``edges`` has a row of neighbours per node, -1 where there are fewer. All queries advance together: in every round each
    opens its nearest node that is not opened yet, until all nodes in its beam are open.
    """
    n, many = len(points), len(queries)
    lengths = np.einsum("ij,ij->i", points, points)
    own = np.einsum("ij,ij->i", queries, queries)
    ids = np.full((many, beam), -1, np.int64)
    far = np.full((many, beam), np.inf, np.float32)
    opened = np.zeros((many, beam), bool)
    seen = np.zeros((many, n + 1), bool)  # the last column stands for "no node"
    seen[:, [entry, n]] = True
    ids[:, 0] = entry
    far[:, 0] = lengths[entry] + own - 2 * (queries @ points[entry])
    live = np.arange(many)
    while len(live):
        waiting = np.where(opened[live] | (ids[live] < 0), np.inf, far[live])
        best = waiting.argmin(axis=1)
        go = np.isfinite(waiting[np.arange(len(live)), best])
        live, best = live[go], best[go]
        if not len(live):
            break
        opened[live, best] = True
        new = edges[ids[live, best]]
        fresh = ~seen[live[:, None], new]
        new = np.where(fresh, new, -1)
        seen[live[:, None], new] = True
        at = np.maximum(new, 0)
        dots = np.einsum("qrd,qd->qr", points[at], queries[live])
        found = np.where(new >= 0, lengths[at] + own[live, None] - 2 * dots, np.inf).astype(np.float32)
        all_ids, all_far = np.concatenate([ids[live], new], 1), np.concatenate([far[live], found], 1)
        all_open = np.concatenate([opened[live], np.zeros(new.shape, bool)], 1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        ids[live], far[live] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_far, order, 1)
        opened[live] = np.take_along_axis(all_open, order, 1)
    return ids, far


def prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Up to ``degree`` neighbours for each node out of its candidates (-1: none): the nearest one is kept, candidates
    that it is ``relax`` times nearer to than the node are dropped, and so on."""
    many, width = candidates.shape
    at = np.maximum(candidates, 0)
    apart = points[at] - points[nodes][:, None]
    far = np.where(candidates >= 0, np.einsum("ncd,ncd->nc", apart, apart), np.inf)
    far[candidates == nodes[:, None]] = np.inf
    order = np.argsort(far, axis=1, kind="stable")
    candidates, far, at = (np.take_along_axis(x, order, 1) for x in (candidates, far, at))
    # A node that is named twice counts once: rounding may set two mentions of it apart.
    by_name = np.argsort(candidates, axis=1, kind="stable")
    names = np.take_along_axis(candidates, by_name, 1)
    again = np.zeros(candidates.shape, bool)
    again[:, 1:] = names[:, 1:] == names[:, :-1]
    np.put_along_axis(far, by_name, np.where(again, np.inf, np.take_along_axis(far, by_name, 1)), 1)
    own = points[at]
    lengths = np.einsum("ncd,ncd->nc", own, own)
    between = lengths[:, :, None] + lengths[:, None, :] - 2 * own @ own.transpose(0, 2, 1)
    alive = np.isfinite(far)
    kept = np.full((many, degree), -1, np.int64)
    rows = np.arange(many)
    for k in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        kept[some, k] = candidates[rows, first][some]
        alive &= ~((relax * relax * between[rows, first] <= far) & some[:, None])
        alive[rows, first] = False
    return kept


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX) -> tuple[np.ndarray, int]:
    """``(edges, entry)``. Starts from random edges and improves nodes batch by batch; the outcome is always the same."""
    n = len(points)
    rng = np.random.default_rng(n)
    edges = rng.integers(0, n, (n, degree))
    middle = points.mean(axis=0)
    entry = int(np.einsum("ij,ij->i", points - middle, points - middle).argmin())
    order = rng.permutation(n)
    for at in range(0, n, _BATCH):
        nodes = order[at : at + _BATCH]
        met, _ = beam_search(points, edges, entry, points[nodes], min(beam, n))
        chosen = prune(points, nodes, np.concatenate([met, edges[nodes]], 1), degree, relax)
        edges[nodes] = chosen
        # Edges back: every chosen neighbour takes the node as a candidate.
        source, target = np.repeat(nodes, degree), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        by_target = np.argsort(target, kind="stable")
        source, target = source[by_target], target[by_target]
        hosts, first, count = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(first, count)
        extra = np.full((len(hosts), int(count.max(initial=0))), -1, np.int64)
        extra[np.repeat(np.arange(len(hosts)), count), rank] = source
        for part in range(0, len(hosts), _BATCH):  # a host's candidates, in as many rounds as they need
            some = slice(part, part + _BATCH)
            wide = extra[some]
            for k in range(0, wide.shape[1], 2 * degree):
                edges[hosts[some]] = prune(points, hosts[some], np.concatenate([edges[hosts[some]], wide[:, k : k + 2 * degree]], 1), degree, relax)
    return connect(points, edges, entry, beam), entry


def reached(edges: np.ndarray, entry: int) -> np.ndarray:
    """Whether a walk from the entry comes to each node."""
    seen = np.zeros(len(edges) + 1, bool)  # the last one stands for "no node"
    seen[[entry, -1]] = True
    front = np.array([entry])
    while len(front):
        near = np.unique(edges[front])
        front = near[~seen[near]]
        seen[front] = True
    return seen[:-1]


def connect(points: np.ndarray, edges: np.ndarray, entry: int, beam: int = BUILD_BEAM) -> np.ndarray:
    """``edges`` with a further edge to every node that none leads to, from the nearest node that a search for it meets.

    The edge goes into a free place, or into a new column beyond the degree: pruning cannot take it away. One node per host
    and round, as others near it may be reached through it.
    """
    while not (seen := reached(edges, entry)).all():
        lost = np.nonzero(~seen)[0]
        hosts = np.concatenate([
            beam_search(points, edges, entry, points[lost[at : at + _BATCH]], min(beam, len(points)))[0][:, 0]
            for at in range(0, len(lost), _BATCH)
        ])
        hosts, first = np.unique(hosts, return_index=True)
        free = edges[hosts] < 0
        if not free.any(axis=1).all():
            edges = np.concatenate([edges, np.full((len(edges), 1), -1, edges.dtype)], 1)
            free = edges[hosts] < 0
        edges[hosts, free.argmax(axis=1)] = lost[first]
    return edges


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` without vectors that are null, empty or zero or hold null or non-finite components."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists(F.col("v"), lambda x: x != 0))


_GRAPH = "shard bigint, dim int, node int, ids array<bigint>, v array<double>, edges array<int>, entry int"


def build_index(vectors: DataFrame, k: int = K, shards: int = SHARDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The graphs of all shards, a row per distinct vector, written to the shared work folder.

    Equal vectors are one node, which names its ``k + 1`` smallest ids: no search returns more of them. There are ``shards``
    shards, or more once they would exceed ``shard_rows`` rows. Vectors of different length are never compared.
    """
    rows = valid_vectors(vectors)
    first = Window.partitionBy("v").orderBy("vec_id")
    # The rank limit cuts a vector with very many ids before the exchange.
    few = rows.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k + 1)
    nodes = staged(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    count = max(shards, -(-nodes.count() // shard_rows))
    dealt = nodes.select(F.pmod(F.xxhash64("v"), F.lit(count)).alias("shard"), F.size("v").alias("dim"), "ids", "v")
    schema = pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("node", pa.int32()), ("ids", pa.list_(pa.int64())),
                        ("v", pa.list_(pa.float64())), ("edges", pa.list_(pa.int32())), ("entry", pa.int32())])

    def graph(table: pa.Table) -> pa.Table:
        table = table.sort_by([("first", "ascending")])
        n, dim = table.num_rows, table["dim"][0].as_py()
        points = augmented(_matrix(table["v"], dim))
        edges, entry = build_graph(points)
        flat = pa.array(edges.astype(np.int32).ravel())
        lists = pa.FixedSizeListArray.from_arrays(flat, edges.shape[1]).cast(pa.list_(pa.int32()))
        columns = [table["shard"], table["dim"], pa.array(np.arange(n, dtype=np.int32)), table["ids"], table["v"], lists, pa.array(np.full(n, entry, np.int32))]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    keyed = dealt.withColumn("first", F.col("ids")[0])
    return staged(keyed.groupBy("shard", "dim").applyInArrow(graph, _GRAPH), "graph")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def augmented(x: np.ndarray) -> np.ndarray:
    lengths = np.einsum("ij,ij->i", x, x)
    more = np.sqrt(np.maximum(lengths.max() - lengths, 0))
    return np.concatenate([x, more[:, None]], 1).astype(np.float32)


def search(index: DataFrame, queries: DataFrame, k: int = K, beam: int = SEARCH_BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for every query ``vec_id, v``, never itself.

    Each shard's rows and all queries, sorted so that the graph comes first, are one task's stream: it holds one graph and a
    batch of queries at a time. The index is shuffled once, however many queries there are; queries are copied to every shard.
    """
    shards = index.select(F.col("shard").alias("of_shard"), F.col("dim").alias("of_dim")).distinct()
    count = (index.agg(F.max("shard")).first()[0] or 0) + 1
    asked = queries.select("vec_id", "v").join(shards, F.size("v") == F.col("of_dim"))
    none = {f: F.lit(None).cast(index.schema[f].dataType).alias(f) for f in ("node", "ids", "edges", "entry")}
    graph = index.select("shard", "dim", F.lit(False).alias("asks"), *none.keys(), "v", F.lit(None).cast("bigint").alias("vec_id"))
    wanted = asked.select(F.col("of_shard").alias("shard"), F.col("of_dim").alias("dim"), F.lit(True).alias("asks"), *none.values(), "v", "vec_id")
    streams = graph.unionByName(wanted).repartitionById(count, F.col("shard").cast("int"))
    streams = streams.sortWithinPartitions("shard", "dim", "asks", "node")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        shard: _Shard | None = None
        for rows in map(pa.Table.from_batches, ([b] for b in batches)):
            # Where another shard, another length of vectors or the queries begin.
            marks = np.stack([rows[c].to_numpy().astype(np.int64) for c in ("shard", "dim", "asks")])
            cuts = [0, *(np.nonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0))[0] + 1).tolist(), rows.num_rows]
            for at, end in zip(cuts, cuts[1:]):
                part = rows.slice(at, end - at)
                if end == at:
                    continue
                if not part["asks"][0].as_py():
                    if shard is not None or (held and (held[0]["shard"][0], held[0]["dim"][0]) != (part["shard"][0], part["dim"][0])):
                        held, shard = [], None
                    held.append(part)
                    continue
                if shard is None:
                    shard, held = _Shard(pa.concat_tables(held)), []
                yield from shard.answers(part, k, beam)

    found = streams.mapInArrow(look, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


class _Shard:
    """One shard's graph in memory."""

    def __init__(self, graph: pa.Table):
        self.x = _matrix(graph["v"], graph["dim"][0].as_py())
        self.edges = np.stack(graph["edges"].to_numpy()).astype(np.int64)
        self.points, self.members = augmented(self.x), graph["ids"].to_pylist()
        self.entry = graph["entry"][0].as_py()

    def answers(self, wanted: pa.Table, k: int, beam: int) -> Iterator[pa.RecordBatch]:
        queries, asking = _matrix(wanted["v"], self.x.shape[1]), wanted["vec_id"].to_numpy()
        unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        flat = np.concatenate([unit, np.zeros((len(queries), 1))], 1).astype(np.float32)
        for at in range(0, len(queries), _BATCH):
            ids, _ = beam_search(self.points, self.edges, self.entry, flat[at : at + _BATCH], min(beam, len(self.points)))
            out: list[list[np.ndarray]] = [[], [], []]
            for row, own in enumerate(ids, at):
                own = own[own >= 0]
                scores = self.x[own] @ queries[row]
                # Ties of many equal scores must not be cut before the smallest ids are known.
                names = [self.members[i] for i in own.tolist()]
                found = np.concatenate([np.array(m, np.int64) for m in names])
                worth = np.repeat(scores, [len(m) for m in names])
                other = found != asking[row]
                found, worth = found[other], worth[other]
                best = np.lexsort((found, -worth))[:k]
                for column, values in zip(out, (np.full(len(best), asking[row]), found[best], worth[best])):
                    column.append(values)
            types = (pa.int64(), pa.int64(), pa.float64())
            columns = [pa.array(np.concatenate(c), t) for c, t in zip(out, types)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, every: int = QUERY_EVERY, k: int = K, beam: int = SEARCH_BEAM, **index) -> DataFrame:
    """The ``k`` nearest of every vector whose id is divisible by ``every``, against all others.

    Vectors that are null, empty or zero, or hold null or non-finite components, take no part, nor do rows without an id.
    Of repeated ids each vector is a row of its own; a query never returns its own id. No vectors give no rows. Other
    columns are not read.
    """
    queries = valid_vectors(vectors).filter(F.col("vec_id") % every == 0)
    return search(build_index(vectors, k, **index), queries, k, beam)
