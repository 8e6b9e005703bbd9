"""Hard negatives from a tree of multiway hyperplane splits, searched by windows of distance.

Vectors gain one coordinate that gives all the same length, so a score (inner
product) and a Euclidean distance tell the same: a window of scores is an annulus
around the anchor. A node of the tree has split points; each row belongs to the
nearest, which parts the space by hyperplanes. Every split point stores the range
of its distances to the rows of each sibling's subtree. A sibling is eliminated
if, by the triangle inequality, that range can't meet the anchor's annulus.
Leaves are compared exactly.

The root's split points come from a bounded sample; its ranges cover all rows.
A subtree of the root is dealt by hash into cells of bounded size, and the nodes
below are made inside the task that searches a cell, for a block of anchors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm._shared import arrow_batches, stored
from foliant.llm.topk import _matrix, _product

SCALE, POSITIVES, NEGATIVES, LOW_PERCENT, HIGH_PERCENT = 256, 5, 3, 50, 95
#: Split points of the root at most, rows of the sample, rows of a cell, windows of a block; split points of an inner node, rows of a leaf.
ROOT, SAMPLE, CELL_ROWS, BLOCK, FANOUT, LEAF = 256, 4096, 16_384, 2048, 16, 256
#: Windows whose bounds are taken at once.
PART = 256
NONE = -(2**62)
FOUND = "window long, vec_id long, score long, label int"


def labelled_vectors(table: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (vec_id, label, vector of floor(scale c)) without nulls or entries that are not finite; where the id is divisible by 7 the label is the next of ten."""
    good = F.forall(vector_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    known = table.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & good)
    vid, label = F.col(id_col).cast("long"), F.col(label_col).cast("int")
    return known.select(vid.alias("vec_id"), F.when(vid % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector"))


class Space:
    """Distances in the space with one coordinate more, where all rows have the squared length ``most``."""

    def __init__(self, most: float):
        self.most, self.slack = most, 1e-6 * (1.0 + most)

    def between(self, x: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Of rows to rows."""
        a, b = (np.sqrt(np.maximum(self.most - (v**2).sum(1), 0)) for v in (x, points))
        d2 = (x**2).sum(1)[:, None] + (a**2)[:, None] + (points**2).sum(1)[None] + (b**2)[None] - 2 * (x @ points.T + np.outer(a, b))
        return np.sqrt(np.maximum(d2, 0))

    def from_anchors(self, x: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Of anchors (the coordinate more is 0) to rows."""
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] + self.most - 2 * (x @ points.T), 0))

    def distance(self, square: np.ndarray, score: np.ndarray, more: float) -> np.ndarray:
        """The distance at which an anchor of that squared length meets a score, with some slack."""
        return np.sqrt(np.maximum(square + self.most - 2 * score.astype(np.float64) + more * self.slack, 0))


def surviving(space: Space, d: np.ndarray, low: np.ndarray, high: np.ndarray, square: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, siblings) that may meet, and the nearest that each sibling's rows can be.

    ``d``: from anchors to split points; ``low`` and ``high`` (point, sibling): the
    ranges; ``least`` and ``most``: the scores wanted. Empty siblings have low > high.
    """
    near = np.maximum(d[:, :, None] - high[None], low[None] - d[:, :, None]).max(1)
    far = (d[:, :, None] + high[None]).min(1)
    inner = space.distance(square, np.minimum(most, 1 << 60), -1)[:, None]
    outer = space.distance(square, np.maximum(least, -(1 << 60)), 1)[:, None]
    tiny = 1e-9 * (1 + outer)
    there = (low <= high).any(0)[None]
    return there & (near <= outer + tiny) & (far >= inner - tiny), np.maximum(near, 0)


def ranges(d: np.ndarray, owner: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(point, sibling): least and greatest distance of each split point to the rows of each sibling."""
    low, high = np.full((count, count), np.inf), np.full((count, count), -np.inf)
    for j in np.unique(owner):
        low[:, j], high[:, j] = d[owner == j].min(0), d[owner == j].max(0)
    return low, high


class Windows:
    """For each window of scores: the best rows found so far that lie in it, ties to the smaller id."""

    def __init__(self, x: np.ndarray, own: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.x, self.own, self.label, self.low, self.high, self.same = x, own, label, low.copy(), high, same
        self.square = (x.astype(np.float64) ** 2).sum(1)
        self.score, self.vec, self.of = np.full((len(x), k), NONE), np.full((len(x), k), np.iinfo(np.int64).max), np.zeros((len(x), k), np.int64)

    def scores(self, need: np.ndarray, y: np.ndarray, ids: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Scores of the rows ``y``; NONE where a row is not wanted or lies outside the window."""
        s = _product(self.x[need], y)
        alike = self.label[need][:, None] == label[None]
        fits = alike & (self.own[need][:, None] != ids[None]) if self.same else ~alike
        return np.where(fits & (s >= self.low[need][:, None]) & (s <= self.high[need][:, None]), s, NONE)

    def meet(self, need: np.ndarray, y: np.ndarray, ids: np.ndarray, label: np.ndarray) -> None:
        """Take what is better from the rows ``y`` for the windows ``need``."""
        s = self.scores(need, y, ids, label)
        some = (s > NONE).any(1)
        need, s = need[some], s[some]
        if not len(need):
            return
        k, shape = self.score.shape[1], s.shape
        s = np.concatenate([self.score[need], s], 1)
        v = np.concatenate([self.vec[need], np.broadcast_to(ids, shape)], 1)
        o = np.concatenate([self.of[need], np.broadcast_to(label, shape)], 1)
        pick = np.lexsort((o, v, -s), axis=1)[:, :k]
        self.score[need], self.vec[need], self.of[need] = (np.take_along_axis(z, pick, 1) for z in (s, v, o))
        self.low[need] = np.maximum(self.low[need], self.score[need][:, -1])


def search(space: Space, win: Windows, need: np.ndarray, y: np.ndarray, ids: np.ndarray, label: np.ndarray) -> None:
    """The rows ``y`` against the windows ``need``: a node of the tree, its subtrees in the order of their nearness, leaves exactly."""
    owner = np.zeros(len(y), np.int64)
    if len(y) > LEAF:
        points = y[np.unique(np.linspace(0, len(y) - 1, FANOUT).astype(int))].astype(np.float64)
        d = space.between(y.astype(np.float64), points)
        owner = d.argmin(1)
    if (owner == 0).all():
        for at in range(0, len(y), LEAF):
            win.meet(need, y[at : at + LEAF], ids[at : at + LEAF], label[at : at + LEAF])
        return
    low, high = ranges(d, owner, len(points))
    to_points = space.from_anchors(win.x[need].astype(np.float64), points)

    def left(a: int, siblings) -> tuple[np.ndarray, np.ndarray]:
        part = need[a : a + PART]
        return surviving(space, to_points[a : a + PART], low[:, siblings], high[:, siblings], win.square[part], win.low[part], win.high[part])

    for j in np.argsort(left(0, slice(None))[1].mean(0)):
        rows = np.flatnonzero(owner == j)
        if len(rows):
            still = need[np.concatenate([left(a, [j])[0][:, 0] for a in range(0, len(need), PART)])]
            if len(still):
                search(space, win, still, y[rows], ids[rows], label[rows])


class Index:
    """The root of the tree over ``rows`` (vec_id, label, vector), all of them, dealt into cells."""

    def __init__(self, rows: DataFrame):
        norm2 = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
        total, width, most = rows.agg(F.count("*"), F.max(F.size("vector")), F.max(norm2)).first()
        self.width, self.space = width or 1, Space(most or 0.0)
        sample = rows.orderBy(F.xxhash64("vec_id", "label"), "vec_id").limit(SAMPLE).collect()
        ids, labels = (np.array([r[k] for r in sample], np.int64) for k in (0, 1))
        self.sample = _matrix([r[2] for r in sample], self.width), ids, labels
        self.points = np.unique(self.sample[0][: int(np.clip(-(-total // CELL_ROWS), 1, ROOT))], axis=0).astype(np.float64)
        points, space, width, m = self.points, self.space, self.width, len(self.points)
        self.low, self.high, self.cells, self.rows = np.full((m, m), np.inf), np.full((m, m), -np.inf), np.ones(m, np.int64), None
        if not m:
            return

        def placed(batches):
            import pyarrow as pa

            for b in batches:
                near = space.between(_matrix(b.column(2).to_pylist(), width).astype(np.float64), points).argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], [*b.schema.names, "sub"])

        def spans(batches):
            import pyarrow as pa

            low, high = np.full((m, m), np.inf), np.full((m, m), -np.inf)
            for b in batches:
                here = ranges(space.between(_matrix(b.column(2).to_pylist(), width).astype(np.float64), points), b.column(3).to_numpy(), m)
                low, high = np.minimum(low, here[0]), np.maximum(high, here[1])
            i, j = np.nonzero(low <= high)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(low[i, j]), pa.array(high[i, j])], ["i", "j", "low", "high"])

        found = stored(rows.mapInArrow(placed, "vec_id long, label int, vector array<long>, sub int"), "placed")
        # as many rows as split points, squared: a bound that does not grow with the input
        for i, j, least, greatest in found.mapInArrow(spans, "i int, j int, low double, high double").groupBy("i", "j").agg(F.min("low"), F.max("high")).collect():
            self.low[i, j], self.high[i, j] = least, greatest
        for j, n in found.groupBy("sub").count().collect():
            self.cells[j] = -(-n // CELL_ROWS)
        parts = F.create_map(*[F.lit(int(v)) for j in range(m) for v in (j, self.cells[j])])[F.col("sub")]
        self.rows = found.withColumn("cell", F.pmod(F.xxhash64("vec_id", "label"), parts).cast("int"))

    def best(self, windows: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        """Rows (window, vec_id, score, label, n): the ``k`` greatest scores in each window, numbered.

        ``windows``: (window, own, label, low, high, vector), scores from low to high
        wanted; of rows with that label and another id than ``own`` (``same``), or of
        rows with another label.
        """
        sample, points, cells, low, high, width, space = self.sample, self.points, self.cells, self.low, self.high, self.width, self.space

        def read(b) -> Windows:
            own, label, least, most = (b.column(c).to_numpy() for c in ("own", "label", "low", "high"))
            return Windows(_matrix(b.column("vector").to_pylist(), width), own, label.astype(np.int64), least, most, k, same)

        def routed(batches):
            """Each window to the cells that may hold one of its results; what the sample holds narrows it first."""
            import pyarrow as pa

            for b in batches:
                for at in range(0, b.num_rows, 32):
                    c = b.slice(at, 32)
                    win, every = read(c), np.arange(c.num_rows)
                    s = win.scores(every, *sample)
                    if s.shape[1] >= k:
                        win.low = np.maximum(win.low, np.partition(s, -k)[:, -k])
                    meets, _ = surviving(space, space.from_anchors(win.x.astype(np.float64), points), low, high, win.square, win.low, win.high)
                    q, j = np.nonzero(meets)
                    many = cells[j]
                    cell = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    q, j = np.repeat(q, many), np.repeat(j, many)
                    out = c.take(pa.array(q))
                    out = out.set_column(out.schema.get_field_index("low"), "low", pa.array(win.low[q]))
                    yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array(cell.astype(np.int32)), *out.columns], ["sub", "cell", *out.schema.names])

        def run(key, left, right):
            import pyarrow as pa

            kinds = pa.schema([("window", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("label", pa.int32())])
            if not left.num_rows or not right.num_rows:
                return kinds.empty_table()
            win = read(left)
            search(space, win, np.arange(left.num_rows), _matrix(right["vector"].to_pylist(), width), right["vec_id"].to_numpy(), right["label"].to_numpy().astype(np.int64))
            q, c = np.nonzero(win.score > NONE)
            return pa.Table.from_pydict({"window": left["window"].to_numpy()[q], "vec_id": win.vec[q, c], "score": win.score[q, c], "label": win.of[q, c].astype(np.int32)}, schema=kinds)

        if self.rows is None:
            return windows.sparkSession.createDataFrame([], f"{FOUND}, n int")
        blocks = max(1, -(-windows.count() // BLOCK))
        sent = windows.repartition(max(2, blocks)).mapInArrow(routed, "sub int, cell int, window long, own long, label int, low long, high long, vector array<long>")
        sent = stored(sent.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)).cast("int")), f"sent-{name}")
        reached = stored(sent.select("sub", "cell", "block").distinct(), f"reached-{name}")
        held = self.rows.join(reached.hint("merge"), ["sub", "cell"]).select("vec_id", "label", "vector", "sub", "cell", "block")
        near = sent.groupBy("sub", "cell", "block").cogroup(held.groupBy("sub", "cell", "block")).applyInArrow(run, FOUND)
        order = F.row_number().over(W.partitionBy("window").orderBy(F.desc("score"), "vec_id", "label"))
        return stored(near.withColumn("n", order).filter(F.col("n") <= k), name)


def hard_negatives(table: DataFrame, anchor_filter=None, positives: int = POSITIVES, negatives: int = NEGATIVES, low_percent: int = LOW_PERCENT, high_percent: int = HIGH_PERCENT, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows that satisfy ``anchor_filter`` (default: id divisible by
    50). The positives of an anchor are the ``positives`` rows of its label with
    another id and the greatest inner product; for each, the negatives are the
    ``negatives`` best rows of other labels whose score lies between ``low_percent``
    and ``high_percent`` of the positive's. Ties go to the smaller id. Rows equal in
    id, label and vector count once; where an id has several rows, each of them is
    an anchor. Rows with a null id, label or vector, or an entry that is null or not
    finite, take no part. Vectors of unequal length meet as if the shorter ended in
    zeros; scores, times 100, must fit a long. Other columns are not read; an empty
    table, or one with one label, gives no rows. All rows are in the index, and the
    search is exact.
    """
    spark = table.sparkSession
    arrow_batches(spark)
    rows = stored(labelled_vectors(table, scale, id_col, vector_col, label_col).distinct(), "labelled")
    index = Index(rows)
    anchors = rows.filter(F.col("vec_id") % 50 == 0 if anchor_filter is None else anchor_filter)
    all_scores = [F.lit(NONE).alias("low"), F.lit(-NONE).alias("high")]
    # numbered once they are written: an id may have several rows
    anchors = stored(anchors.select(F.monotonically_increasing_id().alias("window"), F.col("vec_id").alias("own"), "label", *all_scores, "vector"), "anchors")
    near = index.best(anchors, positives, True, "positives").select("window", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "n")
    # p·low% <= s and s <= p·high%, rounded up and down to whole scores
    least, most = (f"{sign}(({sign}{x} * positive_score - pmod({sign}{x} * positive_score, 100)) div 100)" for sign, x in (("-", low_percent), ("", high_percent)))
    pairs = near.join(anchors.drop("low", "high").hint("merge"), "window").select((F.col("window") * positives + F.col("n") - 1).alias("window"), "own", "label", F.expr(least).alias("low"), F.expr(most).alias("high"), "vector", "positive_id", "positive_score")
    pairs = stored(pairs.filter("low <= high"), "pairs")
    found = index.best(pairs.drop("positive_id", "positive_score"), negatives, False, "negatives").select("window", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("n").alias("rank"))
    named = pairs.select("window", F.col("own").alias("anchor_id"), "positive_id", "positive_score").join(found.hint("merge"), "window")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
