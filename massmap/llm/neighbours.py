"""Approximate nearest neighbours: stable projections, kd-trees, and a chi-square stopping test.

The largest inner product becomes the smallest distance: every vector gets one
more component that lifts all of them to the same norm, queries get a zero there.
Vectors are then projected to a few dimensions by Gaussian (2-stable) weights: the
squared projected distance of a pair, divided by its true squared distance, follows
a chi-square distribution. A query walks its projected neighbours outwards and
verifies each on the original vectors; it stops when a neighbour of the present
k-th distance would have come up by now with the wanted probability.

The projected space is cut into cells by a kd-tree whose planes come from a bounded
sample; every vector is in one cell, and a task indexes one cell with a kd-tree of
its own. A query first searches its own cell. Its k-th distance then bounds the
projected distance at which it would stop, and it goes only to the other cells that
lie within that bound.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massmap.session import written

#: Planes come from this many vectors at most; every vector is indexed.
SAMPLE = 20_000
#: Cells at most; with more vectors a cell holds more of them.
MOST_CELLS = 4096
_LEAF = 128
_FOUND = "query_id long, score double, vec_ids array<long>"


def chi_square_quantile(p: float, dims: int) -> float:
    """The value below which a chi-square variable of ``dims`` degrees of freedom stays with probability p."""

    def below(x: float) -> float:
        # the regularised lower incomplete gamma function by its series
        a, x = dims / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))

    low, high = 1e-9, 10.0 * dims + 100
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def directions(dims: int, width: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, dims))


# --- cells ----------------------------------------------------------------------------------
class Cells:
    """Planes of a kd-tree in heap order: node k has the children 2k + 1 and 2k + 2."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros((1 << depth) - 1, np.int64)
        self.cut = np.zeros((1 << depth) - 1)
        self._split(points, 0)

    def _split(self, points: np.ndarray, node: int) -> None:
        if node >= len(self.axis):
            return
        if len(points):
            self.axis[node] = axis = int(np.argmax(points.var(axis=0)))
            self.cut[node] = cut = float(np.median(points[:, axis]))
            left = points[:, axis] < cut
        else:
            left = np.zeros(0, bool)
        self._split(points[left], 2 * node + 1)
        self._split(points[~left], 2 * node + 2)

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axis[node]] >= self.cut[node]
            node = 2 * node + 1 + right
        return node - len(self.axis)

    def within(self, point: np.ndarray, squared: float) -> list[int]:
        """Cells that reach into the ball around ``point``."""
        out, stack = [], [(0, np.zeros(len(point)))]
        while stack:
            node, offsets = stack.pop()
            if node >= len(self.axis):
                out.append(node - len(self.axis))
                continue
            axis, gap = self.axis[node], point[self.axis[node]] - self.cut[node]
            near = 2 * node + 1 + (gap >= 0)
            far = 2 * node + 1 + (gap < 0)
            stack.append((near, offsets))
            beyond = offsets.copy()
            beyond[axis] = max(beyond[axis], abs(gap))
            if float(beyond @ beyond) <= squared:
                stack.append((far, beyond))
        return out


class Tree:
    """A kd-tree over one cell: leaves of neighbouring points with their bounding boxes."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.leaves: list[tuple[int, int]] = []
        stack = [(0, len(points))]
        while stack:
            a, b = stack.pop()
            if b - a <= _LEAF:
                if b > a:
                    self.leaves.append((a, b))
                continue
            held = self.order[a:b]
            axis = int(np.argmax(np.ptp(points[held], axis=0)))
            middle = (b - a) // 2
            self.order[a:b] = held[np.argpartition(points[held, axis], middle)]
            stack += [(a, a + middle), (a + middle, b)]
        self.points = points[self.order]
        self.low = np.array([self.points[a:b].min(axis=0) for a, b in self.leaves])
        self.high = np.array([self.points[a:b].max(axis=0) for a, b in self.leaves])

    def outwards(self, point: np.ndarray):
        """Batches (squared distances, places), ascending within and across batches.

        Leaves are opened in the order of their boxes, twice as many at a time as
        before; points beyond the next unopened box wait for a later batch.
        """
        gaps = np.maximum(self.low - point, 0) + np.maximum(point - self.high, 0)
        boxes = np.einsum("ij,ij->i", gaps, gaps)
        nearest = np.argsort(boxes, kind="stable")
        near, held = np.zeros(0), np.zeros(0, np.int64)
        at, step = 0, 4
        while at < len(nearest):
            opened = nearest[at : at + step]
            at, step = at + step, step * 2
            bound = boxes[nearest[at]] if at < len(nearest) else math.inf
            rows = np.concatenate([np.arange(*self.leaves[leaf]) for leaf in opened.tolist()])
            away = self.points[rows] - point
            near = np.concatenate((near, np.einsum("ij,ij->i", away, away)))
            held = np.concatenate((held, self.order[rows]))
            ready = near <= bound
            if ready.any():
                order = np.argsort(near[ready], kind="stable")
                yield near[ready][order], held[ready][order]
            near, held = near[~ready], held[~ready]


def _search(dims: int, limit: float, k: int, lifted: float):
    """One cell: ``k`` best classes per query, by incremental search until the chi-square test holds."""

    def find(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, float, list[int]]] = []
        if len(queries) and len(vectors):
            base = np.array(vectors["vector"].tolist(), float)
            ids = [list(held) for held in vectors["vec_ids"]]
            tree = Tree(np.array(vectors["projected"].tolist(), float))
            columns = (queries["query_id"], queries["vector"], queries["projected"], queries["worst"])
            for query, vector, point, worst in zip(*columns):
                vector = np.array(vector, float)
                own = float(vector @ vector)
                best: list[tuple[float, int, int]] = []  # the worst of the best on top
                held = 0
                for squared, places in tree.outwards(np.array(point, float)):
                    # squared distance of the k-th best so far, here or in the query's own cell
                    kth = worst if held < k else min(worst, own + lifted - 2 * best[0][0])
                    reached = int(np.searchsorted(squared, limit * max(kth, 0.0), side="right"))
                    if not reached:
                        break
                    places = places[:reached]
                    scores = np.einsum("ij,j->i", base[places], vector)
                    # a class has at least one id, so no more than the k best scores of a batch can count
                    least = np.partition(scores, -k)[-k] if len(scores) > k else -math.inf
                    for j in np.flatnonzero(scores >= max(least, best[0][0] if held >= k else -math.inf)).tolist():
                        score, place = float(scores[j]), int(places[j])
                        if held >= k and score < best[0][0]:
                            continue
                        heapq.heappush(best, (score, -min(ids[place]), place))
                        held += len(ids[place])
                        while held - len(ids[best[0][2]]) >= k:
                            held -= len(ids[heapq.heappop(best)[2]])
                    if reached < len(squared):
                        break
                out += [(query, score, ids[place]) for score, _, place in best]
        return pd.DataFrame(out, columns=["query_id", "score", "vec_ids"])

    return find


def _projected(columns: np.ndarray, lifted: float, cells: Cells | None, lift: bool):
    """Add the projection, and the cell if the planes are known."""

    def add(frames):
        for frame in frames:
            if not len(frame):
                continue
            vectors = np.array(frame["vector"].tolist(), float)
            extra = np.sqrt(np.maximum(lifted - np.einsum("ij,ij->i", vectors, vectors), 0)) if lift else np.zeros(len(vectors))
            points = np.column_stack([vectors, extra]) @ columns
            frame = frame.assign(projected=list(points))
            yield frame.assign(cell=cells.of(points)) if cells else frame

    return add


def _routed(cells: Cells, limit: float):
    def send(frames):
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                for cell in cells.within(np.array(row.projected, float), limit * max(row.worst, 0.0)):
                    if cell != row.cell:
                        rows.append((row.query_id, row.vector, row.projected, row.worst, cell))
            yield pd.DataFrame(rows, columns=["query_id", "vector", "projected", "worst", "cell"])

    return send


def usable(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector): rows with an id and a finite, non-zero vector of the usual length, as doubles.

    The usual length is the most frequent one, the smaller of equally frequent ones.
    Negative zeros become zeros, so equal vectors are equal in every bit.
    """
    rows = embeddings.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("raw"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < math.inf)
    rows = rows.where(
        F.col("vec_id").isNotNull() & F.col("raw").isNotNull() & F.forall("raw", fine) & F.exists("raw", lambda x: x != 0)
    )
    lengths = rows.groupBy(F.size("raw").alias("width")).agg(F.count("*").alias("n"))
    usual = lengths.orderBy(F.col("n").desc(), "width").first()
    width = usual.width if usual else 0
    return rows.where(F.size("raw") == width).select(
        "vec_id", F.transform("raw", lambda x: x.cast("double") + 0.0).alias("vector")
    )


def nearest(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, queries: str = "vec_id % 20 = 0",
    k: int = 20, dims: int = 8, probability: float = 0.97, cell_rows: int = 8192, seed: int = 7,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` others with the largest inner product found.

    ``queries`` is a condition on ``vec_id``. Scores are inner products of the
    original vectors in double precision; equal scores go to the smaller id. Equal
    vectors are one class in the index with its k + 1 smallest ids: more than that no
    query can need. Equal query vectors are one search, whose answer each of them gets. A neighbour is missed with a probability of at most
    1 - ``probability``.

    Rows with a null id, or whose vector is null, zero, of unusual length or holds a
    null or non-finite component take no part. A row that comes twice counts once. Other
    columns are not read, so their names cannot clash. An empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    rows = written(usable(embeddings, id_col, vector_col).distinct(), "vectors")
    norm = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    facts = rows.agg(F.max(norm).alias("lifted"), F.max(F.size("vector")).alias("width"), F.count("*").alias("n")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not facts.n:
        return empty
    lifted = float(facts.lifted)
    columns = directions(dims, facts.width + 1, seed)
    # the k + 1 smallest ids of each vector; Spark cuts groups before the shuffle
    smallest = Window.partitionBy("vector").orderBy("vec_id")
    classes = rows.withColumn("__rank", F.row_number().over(smallest)).where(F.col("__rank") <= k + 1)
    classes = classes.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("vec_ids"))
    shape = "vector array<double>, vec_ids array<long>, projected array<double>"
    points = classes.mapInPandas(_projected(columns, lifted, None, True), shape)
    points = written(points, "points")

    wanted = math.ceil(facts.n / cell_rows)
    depth = min(max(0, math.ceil(math.log2(max(1, wanted)))), int(math.log2(MOST_CELLS)))
    sample = points.orderBy(F.xxhash64("vec_ids")).limit(SAMPLE).select("projected").toPandas()
    cells = Cells(np.array(sample["projected"].tolist(), float), depth)

    def celled(frames):
        for frame in frames:
            if len(frame):
                yield frame.assign(cell=cells.of(np.array(frame["projected"].tolist(), float)))

    vectors = points.mapInPandas(celled, shape + ", cell long")
    # equal query vectors are searched for once, under the smallest of their ids
    members = written(rows.where(queries).select(F.col("vec_id").alias("member"), "vector"), "members")
    asked = members.groupBy("vector").agg(F.min("member").alias("query_id")).select("query_id", "vector")
    asked = asked.mapInPandas(
        _projected(columns, lifted, cells, False), "query_id long, vector array<double>, projected array<double>, cell long"
    )
    asked = written(asked.withColumn("worst", F.lit(math.inf)), "queries")
    limit = chi_square_quantile(probability, dims)
    search = _search(dims, limit, k + 1, lifted)

    def searched(questions: DataFrame) -> DataFrame:
        both = questions.groupBy("cell").cogroup(vectors.groupBy("cell"))
        return both.applyInPandas(search, _FOUND)

    home = written(searched(asked), "home")
    # the k-th score a query has so far, as a squared distance
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    so_far = home.withColumn("__held", F.sum(F.size("vec_ids")).over(ranked)).where(F.col("__held") >= k + 1)
    bounds = so_far.groupBy("query_id").agg(F.max("score").alias("__score"))
    further = asked.drop("worst").join(bounds, "query_id", "left").withColumn(
        "worst",
        F.coalesce(
            F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x) + F.lit(lifted) - 2 * F.col("__score"),
            F.lit(math.inf),
        ),
    )
    further = further.select("query_id", "vector", "projected", "cell", "worst").mapInPandas(
        _routed(cells, limit), "query_id long, vector array<double>, projected array<double>, worst double, cell long"
    )
    found = home.unionByName(searched(further))
    each = found.select("query_id", "score", F.explode("vec_ids").alias("vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    # one more than asked for, since each member leaves itself out
    best = each.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= k + 1)
    best = best.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("__rank", "vec_id", "score"))).alias("best"))
    best = best.join(asked.select("query_id", "vector"), "query_id").select("vector", "best")
    answers = members.join(best, "vector").select(
        F.col("member").alias("query_id"),
        F.posexplode(F.slice(F.filter("best", lambda one: one["vec_id"] != F.col("member")), 1, k)).alias("at", "one"),
    )
    return answers.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "one.vec_id", "one.score")
