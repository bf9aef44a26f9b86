"""Operator 10: exact top-k by inner product with two cover trees.

Candidates are dealt into groups around pivots.  A fixed sample of candidates gives every
query a kth score to beat, and a table of the groups' centres and radii tells which
groups can hold a better one; only those meet the query.  There a cover tree over the
queries meets a cover tree over the candidates: a pair of nodes is left when the bound
<q0,c0> + |q0| rc + |c0| rq + rq rc on any product below it cannot reach the worst kth
score in the query node.  Scores are exact integers of any size; bounds are floats that
are widened to be safe.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

LEAF = 128
BASE = 1.3  # a base under 2 gives fewer children a node
BLOCK = 8192
#: Pivots and rows of the sample at most: with 64 components they take 2 MB in every task.
PIVOTS, SAMPLE = 1024, 4096
K = 10
_LONG = 1 << 63


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly: as floats where none can pass 2**53, as longs
    where none can pass 2**62, else as Python's integers, kept within the range of a long."""
    most = q.shape[1] * (np.abs(q).max(initial=0.0) * np.abs(c).max(initial=0.0))
    if most < float(1 << 53):
        return q @ c.T
    if most < float(1 << 62):
        return q.astype(np.int64) @ c.astype(np.int64).T
    left, right = ([[int(x) for x in row] for row in m] for m in (q, c))
    out = np.empty((len(q), len(c)), dtype=object)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            out[i, j] = max(-_LONG, min(_LONG - 1, sum(x * y for x, y in zip(a, b, strict=True))))
    return out


class Node:
    __slots__ = ("center", "children", "norm", "radius", "rows", "worst")

    def __init__(self, center, radius, rows, children):
        self.center, self.radius, self.rows, self.children = center, radius, rows, children
        self.norm = float(np.sqrt(center @ center))
        self.worst = -np.inf


def cover_tree(points: np.ndarray, leaf: int = LEAF, base: float = BASE) -> Node:
    """A cover tree built from the top: the children of a node cover its points at
    1/``base`` of its scale and their centres, which are points, are further apart
    than that.  Cells of a few points become shared leaves, which keeps the tree short.
    """
    squares = (points * points).sum(1)

    def gaps(rows: np.ndarray, center: int) -> np.ndarray:
        return np.sqrt(np.maximum(squares[rows] + squares[center] - 2 * (points[rows] @ points[center]), 0.0))

    def build(rows: np.ndarray, center: int, distance: np.ndarray) -> Node:
        radius = float(distance.max())
        if len(rows) <= leaf or radius == 0.0:
            return Node(points[center], radius, rows, [])
        scale = radius / base
        free, near, first = rows, distance, center
        cells = []
        while len(free):
            inside = (near <= scale) | (free == first)
            cells.append((free[inside], first, near[inside]))
            free, near = free[~inside], near[~inside]
            if len(free):
                first = int(free[near.argmax()])
                near = gaps(free, first)
        small = [rows for rows, _, _ in cells if len(rows) <= 4]
        children = [build(*cell) for cell in cells if len(cell[0]) > 4]
        if small:
            loose = np.concatenate(small)
            gap = gaps(loose, center)
            order = np.argsort(gap, kind="stable")
            for low in range(0, len(loose), leaf):
                part = order[low : low + leaf]
                children.append(Node(points[center], float(gap[part].max()), loose[part], []))
        return Node(points[center], radius, rows, children)

    rows = np.arange(len(points))
    center = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    return build(rows, center, gaps(rows, center))


def dual_tree(
    queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, floor: np.ndarray | None = None
) -> list[list[tuple[int, int]]]:
    """The ``k`` best (score, row id) of each query among ``rows``, best first.

    Both sides hold whole numbers as floats.  A row with a query's own id does not count;
    ties go to the smaller row id.  ``floor`` has a score for each query that better rows
    must reach; rows below it may be left out.
    """
    best: list[list[tuple[int, int]]] = [[] for _ in queries]  # (-score, id), sorted
    least = np.full(len(queries), -np.inf) if floor is None else floor.astype(float).copy()
    top, data = cover_tree(queries), cover_tree(rows)

    def low(values):  # of scores that floats may have rounded
        return values - 1e-12 * np.abs(values)

    def bound(q: Node, c: Node) -> float:
        b = float(q.center @ c.center) + q.norm * c.radius + c.norm * q.radius + q.radius * c.radius
        return b + 1e-6 * (1 + abs(b))

    def meet(q: np.ndarray, c: np.ndarray) -> None:
        score = products(queries[q], rows[c])
        shown = score.astype(float)
        shown[query_ids[q][:, None] == row_ids[c][None, :]] = -np.inf
        for i in np.flatnonzero(shown.max(axis=1) >= low(least[q])):
            at = int(q[i])
            good = np.flatnonzero((shown[i] >= low(least[at])) & (shown[i] > -np.inf))
            if len(good) > k:
                cut = np.partition(shown[i][good], len(good) - k)[len(good) - k]
                good = good[shown[i][good] >= low(cut)]
            best[at] = found = sorted(best[at] + [(-int(score[i, j]), int(row_ids[c[j]])) for j in good])[:k]
            if len(found) == k:
                least[at] = max(least[at], float(-found[-1][0]))

    def visit(q: Node, c: Node) -> None:
        if bound(q, c) < low(float(least[q.rows].min())):  # an equal score may still win by its id
            return
        if not c.children:
            if q.children:
                for part in q.children:
                    visit(part, c)
                return
            for i in range(0, len(q.rows), LEAF):  # leaves of equal points have any size
                for j in range(0, len(c.rows), 4 * LEAF):
                    meet(q.rows[i : i + LEAF], c.rows[j : j + 4 * LEAF])
            return
        parts = q.children if q.children and q.radius >= c.radius else [q]
        for part in parts:
            for b, _, child in sorted(((bound(part, x), i, x) for i, x in enumerate(c.children)), key=lambda t: (-t[0], t[1])):
                if not b < low(float(least[part.rows].min())):
                    visit(part, child)

    visit(top, data)
    return [[(-s, i) for s, i in found] for found in best]


def _whole(vectors, n: int, scale: float) -> np.ndarray:
    """floor(scale * x) of vectors of ``n`` components, as floats."""
    return np.floor(scale * np.array([np.asarray(v, dtype=float) for v in vectors], dtype=float).reshape(len(vectors), n))


def top_k(
    queries: DataFrame, rows: DataFrame, k: int = K, scale: float = 1024.0, id_column: str = "vec_id", vector: str = "embedding", block: int = BLOCK,
    pivots: int = PIVOTS, met: list | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best other rows of each query.

    Components become floor(scale * x) and scores are integer inner products, kept within
    the range of a long.  Vectors that are null or hold null or non-finite components
    take no part, nor do rows without an id.  Queries meet only vectors of their own length,
    and no row with their own id.  Rows that repeat an id count one by one, on both sides.
    Fewer candidates than ``k`` give fewer rows, an empty table none.  Other
    columns are not read.

    Groups hold about ``block`` vectors: those nearest to one of ``pivots`` vectors, which are
    taken by a hash, cut further by a hash where they are many.  Of equal vectors the
    k + 1 smallest ids stand for all, k rows of each, as no others can be in a result.
    ``met``, if given, receives the numbers of pairs of groups and of those that met.
    """
    spark = rows.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        good = df.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull()).where(~bad)
        return good.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v"))

    held = clean(rows)
    hashed = F.xxhash64("v")
    often = held.select(hashed.alias("h")).groupBy("h").count().where(F.col("count") > k * (k + 1)).select("h", F.lit(True).alias("often"))
    marked = held.withColumn("h", hashed).join(often, "h", "left").drop("h")
    of_one = Window.partitionBy("v", "id").orderBy("id")
    of_all = Window.partitionBy("v").orderBy("id")
    equal = marked.where("often").drop("often").withColumn("_i", F.row_number().over(of_one)).where(F.col("_i") <= k).drop("_i")
    equal = equal.withColumn("_i", F.dense_rank().over(of_all)).where(F.col("_i") <= k + 1).drop("_i")
    held = marked.where("often is null").drop("often").unionByName(equal)

    n_rows, n_queries = rows.count(), queries.count()
    parallel = spark.sparkContext.defaultParallelism
    n_pivots = max(1, min(pivots, max(-(-n_rows // block), min(parallel, n_rows // 512))))
    sample: dict[int, list] = {}
    for r in clean(rows).orderBy(hashed, "id").limit(max(SAMPLE, pivots)).collect():
        sample.setdefault(len(r["v"]), []).append((r["id"], r["v"]))
    known = {}  # by length: pivots, ids and vectors of the sample
    for n, given in sample.items():
        vectors = _whole([v for _, v in given], n, scale)
        known[n] = (np.unique(vectors[:n_pivots], axis=0), np.array([i for i, _ in given]), vectors)

    @F.pandas_udf("n int, cell int, gap double, floor double")
    def place(ids: pd.Series, v: pd.Series, asked: pd.Series) -> pd.DataFrame:
        size = v.map(len).to_numpy()
        out = pd.DataFrame({"n": size.astype("int32"), "cell": np.zeros(len(v), "int32"), "gap": np.inf, "floor": -np.inf})
        for n in np.unique(size):
            if int(n) not in known:  # none of that length in the sample: one group without bounds
                continue
            at = np.flatnonzero(size == n)
            x = _whole(v.iloc[at], int(n), scale)
            centers, names, vectors = known[int(n)]
            cell = ((centers * centers).sum(1)[None, :] - 2 * (x @ centers.T)).argmin(1)
            out.loc[at, "cell"] = cell.astype("int32")
            out.loc[at, "gap"] = np.sqrt(((x - centers[cell]) ** 2).sum(1))
            if asked.iloc[0] and len(names) > k:
                score = x @ vectors.T
                score[ids.iloc[at].to_numpy()[:, None] == names[None, :]] = -np.inf
                kth = np.partition(score, len(names) - k, axis=1)[:, len(names) - k]
                out.loc[at, "floor"] = kth - 1e-9 * np.abs(kth)
        return out

    def dealt(df: DataFrame, asked: bool) -> DataFrame:
        return checkpointed(df.withColumn("_p", place("id", "v", F.lit(asked))).select("id", "v", "_p.*"))

    right = dealt(held, False)
    sizes = right.groupBy("n", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    right = right.join(sizes, ["n", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int"))
    groups = checkpointed(right.groupBy("n", "cell", "part").agg(F.max("gap").alias("rc")))
    q_blocks = max(1, -(-n_queries // block))
    left = dealt(clean(queries), True).withColumn("qb", F.pmod("cell", F.lit(q_blocks)))
    left = left.withColumn("qn", F.monotonically_increasing_id())  # over written rows, so it stays
    cells = left.groupBy("n", F.col("cell").alias("qc"), "qb").agg(F.max("gap").alias("rq"), F.min("floor").alias("worst"))

    # every cell of queries with every group of candidates: two short tables, the second dealt over the tasks
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    deal = F.pmod(F.xxhash64("cell", "part"), F.lit(tasks)).cast("int")
    every = cells.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).join(groups.withColumn("_d", deal), ["n", "_d"]).drop("_d")

    @F.pandas_udf("double")
    def most(n: pd.Series, qc: pd.Series, cc: pd.Series, rq: pd.Series, rc: pd.Series) -> pd.Series:
        out = np.full(len(n), np.inf)
        for size in n.unique():
            if int(size) in known:
                centers, at = known[int(size)][0], np.flatnonzero(n.to_numpy() == size)
                a, b = centers[qc.to_numpy()[at]], centers[cc.to_numpy()[at]]
                ra, rb = rq.to_numpy()[at], rc.to_numpy()[at]
                value = (a * b).sum(1) + np.sqrt((a * a).sum(1)) * rb + np.sqrt((b * b).sum(1)) * ra + ra * rb
                out[at] = value + 1e-6 * (1 + np.abs(value))
        return pd.Series(out)

    able = ~(most("n", "qc", "cell", "rq", "rc") < F.col("worst"))
    open_ = checkpointed(every.where(able).select("n", "qc", "qb", "cell", "part"))
    if met is not None:
        met += [cells.count() * groups.count(), open_.count()]

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            n = len(q["v"].iloc[0])
            found = dual_tree(_whole(q["v"], n, scale), q["id"].to_numpy(), _whole(c["v"], n, scale), c["id"].to_numpy(), k, q["floor"].to_numpy())
            out = [(qid, qn, vec_id, score) for qid, qn, best in zip(q["id"], q["qn"], found, strict=True) for score, vec_id in best]
        return pd.DataFrame(out, columns=["query_id", "qn", "vec_id", "score"]).astype("int64")

    keys = ["n", "qb", "cell", "part"]
    mine = left.withColumnRenamed("cell", "qc").join(open_, ["n", "qc", "qb"]).select(*keys, "id", "qn", "v", "floor")
    theirs = right.join(open_.select(*keys).distinct(), ["n", "cell", "part"]).select(*keys, "id", "v")
    found = mine.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInPandas(search, "query_id long, qn long, vec_id long, score long")
    by_score = Window.partitionBy("query_id", "qn").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of every row for the rows whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows.where(F.col("vec_id") % 100 == 0), rows)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (
  SELECT *, row_number() OVER (ORDER BY vec_id) AS qn FROM v WHERE vec_id % 100 = 0
), s AS (
  SELECT q.qn, q.vec_id AS query_id, c.vec_id AS vec_id,
    coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) AS score
  FROM q JOIN v c ON c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY qn ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 10
"""
