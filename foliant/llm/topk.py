"""Exact top-k search by inner product with a pivot-distance index.

Vectors gain one coordinate that gives all the same length M; the nearest in
Euclidean distance is then the one with the greatest inner product. Every vector
is keyed by its nearest pivot and its distance to it. Sorted by that key the
index is cut into cells of about equal size, each a few annuli around pivots.
Queries with the same vector are one. A query first searches the cell that may
hold the greatest score; then, by the triangle inequality, it is sent only to
cells that may hold a score of at least the k-th best known, and a cell is copied
only to the blocks of queries that it is reached by. Within a cell annuli are
taken in order of their bound until the bound falls below the query's k-th best,
and only scores that reach it leave the task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm._shared import arrow_batches, salted, stored

#: Pivots at least (more with more cells), vectors of the sample, vectors of a cell, queries of a block, vectors of an annulus.
PIVOTS, SAMPLE, CELL_ROWS, BLOCK, ANNULUS = 32, 2048, 16_384, 4096, 512
LOWEST = -(2**62)
INDEX = "vec_id long, vector array<long>, norm double, pivot int, dist double"


def _matrix(rows, width: int) -> np.ndarray:
    """Rows of integers, padded with zeros; int64, or float64 where that is exact and faster."""
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    high = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if high < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def integers(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (vec_id, vector of floor(64 x)) without nulls or components that are not finite."""
    good = F.forall(vector_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    ints = F.transform(vector_col, lambda x: F.floor(x.cast("double") * 64))
    return table.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & good).select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("vector"))


def distinct_vectors(rows: DataFrame, copies: int) -> DataFrame:
    """Of rows with the same vector the ``copies`` smallest ids stay, as no
    others can be among the results, first within each batch and then overall.
    """

    def fewest(batches):
        import pyarrow as pa

        for b in batches:
            ids, vecs = b.column(0).to_pylist(), b.column(1).to_pylist()
            order, seen, keep = sorted(range(len(ids)), key=ids.__getitem__), {}, []
            for i in order:
                n = seen[k] = seen.get(k := tuple(vecs[i]), 0) + 1
                if n <= copies:
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    arrow_batches(rows.sparkSession)
    rows = rows.mapInArrow(fewest, "vec_id long, vector array<long>").withColumn("digest", F.sha2(F.to_json("vector"), 256))
    return rows.dropDuplicates(["digest", "vec_id"]).withColumn("nth", F.row_number().over(W.partitionBy("digest").orderBy("vec_id"))).filter(F.col("nth") <= copies).select("vec_id", "vector")


def top_k(table: DataFrame, k: int = 20, query_filter=None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` greatest inner products of each query.

    Queries are the rows that satisfy ``query_filter`` (default: id divisible by
    20), candidates all rows but those with the query's own id. Ties go to the
    smaller id; rows with the same id and vector count once. Rows with a null id,
    a null vector or a component that is null or not finite take no part. Vectors
    of unequal length meet as if the shorter ended in zeros; scores must fit a
    long. Fewer than ``k`` candidates give fewer rows, an empty table none.

    Other columns are not read. Queries and index rows meet in blocks, so no task
    holds all queries of a cell. The driver holds the sample and one row for each
    cell and pivot in it, 24 bytes for every 16,384 vectors.
    """
    spark = table.sparkSession
    arrow_batches(spark)
    query_filter = F.col("vec_id") % 20 == 0 if query_filter is None else query_filter
    valid = integers(table, id_col, vector_col).withColumn("digest", F.xxhash64("vector"))
    asked = stored(valid.filter(query_filter).select("vec_id", "vector", "digest").distinct(), "asked")
    # hashes of 64 bits may collide: queries are told apart by their vectors, and numbered when they are written
    queries = asked.groupBy("digest").agg(F.sort_array(F.collect_set("vector")).alias("v")).select(F.explode("v").alias("query"))
    queries = stored(queries.select(F.monotonically_increasing_id().alias("query_id"), "query"), "queries")
    most_copies, k = k + 1, k + 1  # a query's own row is found, and left out at the end
    rows = stored(distinct_vectors(valid.select("vec_id", "vector"), most_copies), "vectors")
    norm2 = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    facts = rows.agg(F.count("*"), F.max(F.size("vector")), F.max(norm2)).first()
    total, width, most = facts[0], facts[1] or 1, (facts[2] or 0.0)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    sample = _matrix([r[1] for r in picked], width)
    cells = max(1, -(-total // CELL_ROWS))
    pivots = sample[: max(PIVOTS, int(4 * cells**0.5))].astype(np.float64)
    pivot_norm = (pivots**2).sum(1)
    lift = np.sqrt(np.maximum(most - pivot_norm, 0))

    def distances(x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """To the pivots, in the space with one coordinate more."""
        d2 = (x**2).sum(1)[:, None] + (extra**2)[:, None] + most - 2 * (x @ pivots.T + np.outer(extra, lift))
        return np.sqrt(np.maximum(d2, 0))

    def keyed(batches):
        import pyarrow as pa

        for b in batches:
            x = _matrix(b.column(1).to_pylist(), width).astype(np.float64)
            n2 = (x**2).sum(1)
            d = distances(x, np.sqrt(np.maximum(most - n2, 0)))
            near = d.argmin(1) if len(d) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.sqrt(n2)), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], ["vec_id", "vector", "norm", "pivot", "dist"])

    index = rows.mapInArrow(keyed, INDEX).repartitionByRange(cells, "pivot", "dist", "vec_id").withColumn("cell", F.spark_partition_id())
    index = stored(index, "index")
    # one row for each cell and pivot in it: with sorted keys at most cells + pivots rows
    bounds = [tuple(r) for r in index.groupBy("cell", "pivot").agg(F.min("dist"), F.max("dist")).collect()]
    blocks = max(1, -(-queries.count() // BLOCK))
    slack = 1e-6 * (1.0 + most)

    cell, pivot, low, high = (np.array([b[i] for b in bounds]) for i in range(4)) if bounds else (np.zeros(0),) * 4

    def routed(batches):
        """Each query to its most promising cell, or (where it has a floor from there) to all others that may hold one of its results."""
        import pyarrow as pa

        for b in batches:
            ids, x = b.column(0).to_numpy(), _matrix(b.column(1).to_pylist(), width)
            if not len(ids) or not len(cell):
                continue
            first = b.num_columns == 2
            scores = _product(x, sample)
            floor = np.sort(scores, 1)[:, -k] if len(sample) >= k else np.full(len(ids), LOWEST)
            if not first:
                floor = np.maximum(floor, b.column(2).fill_null(LOWEST).to_numpy())
            xf = x.astype(np.float64)
            d = distances(xf, np.zeros(len(ids)))[:, pivot.astype(int)]
            least = np.maximum(0, np.maximum(low - d, d - high))
            best = ((xf**2).sum(1)[:, None] + most - least**2) / 2 + slack
            top = best.argmax(1)
            if first:
                q, c = np.arange(len(ids)), top
            else:
                q, c = np.nonzero((best >= floor[:, None]) & (cell[None, :] != cell[top][:, None]))
            pairs = np.unique(np.stack([q, cell[c].astype(np.int64)], 1), axis=0)
            take = pa.array(pairs[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1].astype(np.int32)), b.column(0).take(take), b.column(1).take(take), pa.array(floor[pairs[:, 0]])], ["cell", "query_id", "query", "floor"])

    def searched(key, left, right):
        import pyarrow as pa

        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        qid, x, floor = left["query_id"].to_numpy(), _matrix(left["query"].to_pylist(), width), left["floor"].to_numpy().copy()
        pivot, dist = right["pivot"].to_numpy(), right["dist"].to_numpy()
        order = np.lexsort((dist, pivot))
        vid, y = right["vec_id"].to_numpy()[order], _matrix(right["vector"].to_pylist(), width)[order]
        pivot, dist = pivot[order], dist[order]
        xf = x.astype(np.float64)
        d, x2 = distances(xf, np.zeros(len(x))), (xf**2).sum(1)
        edges = np.unique(np.r_[np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1]]), np.arange(0, len(y), ANNULUS), len(y)])
        annuli = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            dq = d[:, pivot[lo]]
            least = np.maximum(0, np.maximum(dist[lo] - dq, dq - dist[hi - 1]))
            annuli.append((lo, hi, (x2 + most - least**2) / 2 + slack))
        annuli.sort(key=lambda a: -a[2].mean())
        low = LOWEST
        best_s, best_v = np.full((len(x), k), low), np.full((len(x), k), np.iinfo(np.int64).max)
        for lo, hi, bound in annuli:
            need = np.flatnonzero(bound >= floor)
            if not len(need):
                continue
            s = _product(x[need], y[lo:hi])
            s = np.concatenate([best_s[need], s], 1)
            v = np.concatenate([best_v[need], np.broadcast_to(vid[lo:hi], (len(need), hi - lo))], 1)
            pick = np.lexsort((v, -s), axis=1)[:, :k] if s.shape[1] else np.zeros((len(need), 0), int)
            best_s[need], best_v[need] = np.take_along_axis(s, pick, 1), np.take_along_axis(v, pick, 1)
            floor[need] = np.maximum(floor[need], best_s[need][:, -1])
        q, c = np.nonzero((best_s > low) & (best_s >= floor[:, None]))
        return pa.table({"query_id": qid[q], "vec_id": best_v[q, c], "score": best_s[q, c]})

    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")

    def search(sent: DataFrame, name: str) -> DataFrame:
        sent = stored(sent.repartition(max(2, blocks)).mapInArrow(routed, "cell int, query_id long, query array<long>, floor long").select("*", block), f"sent-{name}")
        reached = stored(sent.select("cell", "block").distinct(), f"reached-{name}")
        held = index.join(reached.hint("merge"), "cell").select(*index.columns, "block")
        return stored(sent.groupBy("cell", "block").cogroup(held.groupBy("cell", "block")).applyInArrow(searched, "query_id long, vec_id long, score long"), name)

    near = search(queries, "near")
    reverse = F.sort_array(F.collect_list("score"), asc=False)
    floors = near.groupBy("query_id").agg(F.get(reverse, F.lit(k - 1)).alias("floor"))
    far = search(queries.join(floors.hint("merge"), "query_id", "left").select("query_id", "query", "floor"), "far")
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = near.unionByName(far).withColumn("n", best).filter(F.col("n") <= k)
    lists = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))  # k rows at most
    vectors = queries.join(lists.hint("merge"), "query_id").select(F.xxhash64("query").alias("digest"), "query", "found")
    answered = salted(asked.select(F.col("vec_id").alias("query_id"), "vector", "digest"), vectors.groupBy("digest").agg(F.collect_list(F.struct("query", "found")).alias("answers")), "digest")
    mine = F.get(F.filter("answers", lambda a: a["query"] == F.col("vector")), F.lit(0))["found"]
    others = F.slice(F.filter(mine, lambda x: x["vec_id"] != F.col("query_id")), 1, k - 1)
    out = answered.select("query_id", F.posexplode(others).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).alias("rank"), "x.vec_id", "x.score")
