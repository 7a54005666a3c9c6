"""Approximate nearest neighbours by balanced posting lists.

Largest inner product becomes smallest distance by one more component,
sqrt(M^2 - |v|^2) with M the longest vector's norm over all rows.  Centroids are
fitted on a bounded sample (``SAMPLE`` rows, smallest hash of the id) by k-means
whose assignment is charged for crowded lists, so posting lists stay balanced.

Every row is indexed: in its nearest list, and near a boundary in several
(``REPLICAS`` at most: a copy goes to a further list within ``SPREAD`` of the
nearest distance unless a list that it already has is closer to that list than
the row is).  Copies only help; the nearest list always holds the row.

A query walks an in-memory neighbour graph over the centroids and visits the
lists within ``REACH`` of its nearest distance, and more until the lists hold
enough rows.  Neighbouring lists form groups; a group's rows and the queries
that visit any of its lists meet in tiles of bounded size, so neither a hot list
nor a popular query region gathers in one task; a tile returns each query's
``k`` best, the rest is a window over those.

Scores are inner products of the original vectors in double precision, summed
alike wherever a pair meets, so equal vectors tie exactly and ties go to the
smaller id.

Defined cases: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part, neither do null ids; equal rows
count once, and an id with several vectors is found by its best one and asks with
its smallest; fewer than ``k`` other rows give as many; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import files_for, hash_sample, stage

K = 20
SAMPLE = 20_000
LIST_ROWS = 512           # rows a list should hold, as far as the sample carries so many centroids
PER_CENTROID = 8          # sampled rows behind a centroid at least
REPLICAS = 8
SPREAD = 1.03
REACH = 1.15
TILE_ROWS = 32_768
TILE_QUERIES = 2048


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def lift(x: np.ndarray, longest: float) -> np.ndarray:
    """One more component that makes all rows equally long."""
    return np.hstack([x, np.sqrt(np.maximum(longest ** 2 - (x * x).sum(1), 0))[:, None]])


def balanced_centroids(x: np.ndarray, n: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means with a charge on crowded lists."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), n, replace=False)].copy()
    charge = np.zeros(n)
    for _ in range(rounds):
        d = np.vstack([_squares(part, c) for part in np.array_split(x, max(1, len(x) // 2048))])
        own = np.argmin(d + charge, axis=1)
        sizes = np.bincount(own, minlength=n)
        scale = float(d[np.arange(len(x)), own].mean()) + 1e-12
        charge = np.maximum(charge + 0.1 * scale * (sizes * n / len(x) - 1), 0)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], c)
    return c


class CentroidGraph:
    """Neighbour graph over the centroids with best-first search."""

    def __init__(self, c: np.ndarray, degree: int = 24):
        self.c = c
        d = _squares(c, c)
        near = np.argsort(d, axis=1, kind="stable")[:, 1:degree + 1]
        links = [set(row) for row in near.tolist()]
        for i, row in enumerate(near.tolist()):
            for j in row:
                links[j].add(i)
        order = np.argsort(((c - c.mean(0)) ** 2).sum(1), kind="stable")
        for a, b in zip(order[:-1].tolist(), order[1:].tolist()):      # a path through all keeps the graph connected
            links[a].add(b)
            links[b].add(a)
        self.links = [np.array(sorted(s), np.int64) for s in links]
        self.entry = order[:: max(1, len(order) // 16)]

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest centroids found and their distances, nearest first."""
        known = np.zeros(len(self.c), bool)
        known[self.entry] = True
        best_i, best_d = self.entry, ((self.c[self.entry] - q) ** 2).sum(1)
        open_ = np.ones(len(best_i), bool)
        while open_.any():
            at = np.flatnonzero(open_)[:8]
            open_[at] = False
            new = np.unique(np.concatenate([self.links[i] for i in best_i[at]]))
            new = new[~known[new]]
            if not len(new):
                continue
            known[new] = True
            best_i = np.concatenate((best_i, new))
            best_d = np.concatenate((best_d, ((self.c[new] - q) ** 2).sum(1)))
            open_ = np.concatenate((open_, np.ones(len(new), bool)))
            order = np.argsort(best_d, kind="stable")[:width]
            best_i, best_d, open_ = best_i[order], best_d[order], open_[order]
        order = np.argsort(best_d, kind="stable")
        return best_i[order], np.sqrt(best_d[order])


def memberships(x: np.ndarray, c: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) for every list a row goes to."""
    d = np.sqrt(_squares(x, c))
    order = np.argsort(d, axis=1, kind="stable")[:, :4 * REPLICAS]
    rows, lists = [], []
    for i, near in enumerate(order.tolist()):
        mine = [near[0]]
        for j in near[1:]:
            if d[i, j] > SPREAD * d[i, near[0]] or len(mine) == REPLICAS:
                break
            if all(between[j, m] > d[i, j] for m in mine):
                mine.append(j)
        rows += [i] * len(mine)
        lists += mine
    return np.array(rows, np.int64), np.array(lists, np.int64)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    return rows.distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def cut_lists(c: np.ndarray, full: np.ndarray, tile_rows: int) -> np.ndarray:
    """The group of every list: neighbours along the centroids' main axis, about ``tile_rows`` rows together."""
    axis = np.linalg.svd(c - c.mean(0), full_matrices=False)[2][0]
    order = np.argsort(c @ axis, kind="stable")
    group = np.empty(len(c), np.int64)
    group[order] = (np.cumsum(full[order]) - 1) // tile_rows
    return group


def best_in_tile(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """Each query's ``k`` best rows among those of its lists in one tile."""
    if not queries.num_rows or not rows.num_rows:
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    queries, rows = queries.combine_chunks(), rows.combine_chunks()
    ids, lists = rows["vec_id"].to_numpy(), rows["list"].to_numpy()
    v = _matrix(rows["v"].combine_chunks())
    # equal vectors are scored once; `members` are their rows, smallest id first
    order = np.lexsort((ids, *v.T))
    new = np.ones(len(v), bool)
    new[1:] = (v[order[1:]] != v[order[:-1]]).any(1)
    distinct = np.cumsum(new) - 1
    begin = np.append(np.flatnonzero(new), len(v))
    u = v[order[new]]
    # vectors beyond one for each id: so many of the best vectors may add no row
    pairs = np.unique(np.rec.fromarrays((ids[order], distinct)))
    several = len(pairs) - len(np.unique(ids))
    names = np.unique(lists)
    holds = np.zeros((len(names), len(u)), np.float32)
    holds[np.searchsorted(names, lists[order]), distinct] = 1

    q, query_ids = _matrix(queries["v"].combine_chunks()), queries["query_id"].to_numpy()
    wanted = queries["lists"].combine_chunks()
    sizes = np.diff(wanted.offsets.to_numpy())
    flat = wanted.flatten().to_numpy()
    at = np.searchsorted(names, flat).clip(max=len(names) - 1)
    found = names[at] == flat
    visited = np.zeros((len(q), len(names)), np.float32)
    visited[np.repeat(np.arange(len(q)), sizes)[found], at[found]] = 1
    slack = 4 * u.shape[1] * np.finfo(float).eps * np.linalg.norm(u, axis=1).max()     # over twice what a rough score may be off, per query length
    out = []
    for block in np.array_split(np.lexsort(visited.T), max(1, len(q) // 64)):
        near = visited[block].any(0)
        cols = np.flatnonzero(holds[near].any(0))
        if not len(cols):
            continue
        rough = q[block] @ u[cols].T
        rough[visited[block][:, near] @ holds[near][:, cols] == 0] = -np.inf
        # the k + 1 best distinct vectors (and one for each that an id has beside another) hold k ids besides the
        # query's own; all that may tie with the last of them stay
        last = len(cols) - min(k + 1 + several, len(cols))
        least = np.partition(rough, last, axis=1)[:, last] - slack * np.linalg.norm(q[block], axis=1)
        for i, row in enumerate(block.tolist()):
            best = cols[np.flatnonzero((rough[i] >= least[i]) & np.isfinite(rough[i]))]
            score = np.concatenate([(u[part] * q[row]).sum(axis=1) for part in np.split(best, range(4096, len(best), 4096))])
            n = np.minimum(begin[best + 1] - begin[best], 2 * REPLICAS * (k + 1))    # copies beyond those rank too low
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            copies = ids[order[np.repeat(begin[best], n) + inside]]
            score = np.repeat(score, n)
            down = np.argsort(-score, kind="stable")                   # an id counts by its best vector
            copies, first = np.unique(copies[down], return_index=True)
            score = score[down][first]
            other = copies != query_ids[row]
            copies, score = copies[other], score[other]
            rank = np.lexsort((copies, -score))[:k]
            out.append((np.full(len(rank), query_ids[row]), copies[rank], score[rank]))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))


def nearest(vectors: DataFrame, is_query: F.Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding",
            sample: int = SAMPLE, tile_rows: int = TILE_ROWS, tile_queries: int = TILE_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows found nearest to each row for which ``is_query`` (of vec_id) holds."""
    files = files_for(vectors)
    rows = stage(usable(vectors, id_col, vec_col), "vectors", files)
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if sizes is None:
        return empty
    rows = rows.where(F.size("v") == sizes["dims"])
    longest = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    total = sizes["count"]
    fit = hash_sample(rows, "vec_id", sample, total).toPandas()      # the documented bound
    x = lift(np.stack(fit["v"].to_numpy()), longest)
    n_lists = max(1, min(total // LIST_ROWS, len(x) // PER_CENTROID))
    c = balanced_centroids(x, n_lists)
    between = np.sqrt(_squares(c, c))

    def index(batches):
        for b in batches:
            if not b.num_rows:
                continue
            r, lists = memberships(lift(_matrix(b.column("v")), longest), c, between)
            yield pa.RecordBatch.from_arrays([pa.array(lists), b.column("vec_id").take(pa.array(r)), b.column("v").take(pa.array(r))],
                                             names=["list", "vec_id", "v"])

    postings = stage(rows.mapInArrow(index, "list long, vec_id long, v array<double>"), "postings", files)
    held = {r["list"]: r["count"] for r in postings.groupBy("list").count().collect()}   # one row per centroid
    full = np.array([held.get(i, 0) for i in range(n_lists)])
    group = cut_lists(c, full, tile_rows)
    graph = CentroidGraph(c)
    enough = REPLICAS * (k + 1)

    def visit(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("v"))
            at, groups, lists = [], [], []
            for i, q in enumerate(np.hstack([v, np.zeros((len(v), 1))])):
                width = 64
                while True:
                    near, d = graph.search(q, min(width, n_lists))
                    inside = int(np.searchsorted(d, REACH * d[0], side="right"))
                    upto = max(inside, int(np.searchsorted(np.cumsum(full[near]), enough)) + 1)
                    if upto < len(near) or len(near) < width or width >= n_lists:
                        break
                    width *= 2                 # every found list is near enough: look further
                near = near[:upto]
                for g in np.unique(group[near]).tolist():
                    at.append(i)
                    groups.append(g)
                    lists.append(near[group[near] == g])
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(groups, pa.int64()), b.column("vec_id").take(take), b.column("v").take(take), pa.array(lists, pa.list_(pa.int64()))],
                names=["group", "query_id", "v", "lists"])

    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))      # of an id with several vectors, the smallest asks
    visits = stage(asked.mapInArrow(visit, "group long, query_id long, v array<double>, lists array<long>"), "visits", files)
    # one row per centroid, and one per group: how many tiles a group's rows and its queries are dealt to
    groups = spark.createDataFrame(list(enumerate(group.tolist())), "list long, group long")
    rows_in = np.bincount(group, full, minlength=1)
    row_tiles = spark.createDataFrame([(g, -(-int(n) // (2 * tile_rows))) for g, n in enumerate(rows_in) if n], "group long, row_tiles int")
    tiles = row_tiles.join(visits.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / tile_queries).cast("int").alias("query_tiles")), "group")

    def dealt(df, own, mine, other, tag, far):
        return (df.join(F.broadcast(tiles), "group").withColumn(tag, F.pmod(F.xxhash64(own), F.col(mine)).cast("int"))
                .withColumn(far, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("row_tiles", "query_tiles"))

    left = dealt(visits, "query_id", "query_tiles", "row_tiles", "qt", "rt")
    right = dealt(postings.join(F.broadcast(groups), "list"), "vec_id", "row_tiles", "query_tiles", "rt", "qt")
    found = left.groupBy("group", "qt", "rt").cogroup(right.groupBy("group", "qt", "rt")).applyInArrow(
        lambda q, r: best_in_tile(q, r, k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, F.col("vec_id") % 20 == 0)
