"""Approximate nearest neighbours along shifted Hilbert curves.

Each of CURVES curves projects the vectors to a few dimensions of its own,
shifts them by a random offset and orders them by Hilbert index.  The keys of a
curve are range-partitioned; a query meets the points whose place on a curve is
near its own.  What travels along the curves is a point's number and its vector
rounded to a byte a component; a block puts the NEAR best by these forward, a
query keeps the SHORT best of all blocks, fetches their vectors, and ranks them
by the cosine of the original vectors, summed in one fixed order in extended
precision and rounded once.

The window is measured: PROBES queries (the first by hash of the id) are
compared with every point, and the window is so wide that RECALL of their true
neighbours lie in it on some curve.  It so grows with the table as far as the
vectors need it, up to the whole table, and blocks with it, within BLOCK.

Equal vectors are one point of the index that carries its smallest ids, as many
as can be asked for, so that any number of copies takes one place in a window.
Only the projections' quantiles come from a sample (FIT_ROWS rows, the first by
hash of the id); every row is indexed.

Vectors that are null, zero, or hold null or non-finite components take no
part, nor do those of another length than the commonest.  Ties go to the smaller
id.  An id that occurs twice is two candidates for others and none for itself.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import table, temporary

CURVES, DIMS, BITS = 24, 8, 7
#: Points of a block: the fewest, and the most.
BLOCK = 512, 65_536
FIT_ROWS = 10_000
#: Queries that are compared with all points, and the share of their neighbours to be reached.
PROBES, RECALL = 200, 0.96
#: Candidates of a query that a block puts forward, and those whose vectors are fetched.
NEAR, SHORT = 12, 40
#: Scores that are held at once while a block is compared.
CELLS = 1 << 22


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (n, dims) with coordinates below 2**bits."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    level = 1 << (bits - 1)
    while level > 1:  # undo the turns of each level, from the coarsest
        low = level - 1
        for d in range(dims):
            high = (x[d] & level) != 0
            swap = np.where(high, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(high, low, swap)
            if d:
                x[d] ^= swap
        level >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[-1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):  # the bits of all axes in turn
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


@dataclass(frozen=True)
class Curves:
    """Projections of all curves, with the sample's sorted values on each axis."""

    axes: np.ndarray  # curves, dims, vector length
    ladder: np.ndarray  # curves, dims, sample
    shift: np.ndarray  # curves, dims

    @staticmethod
    def fit(sample: np.ndarray, curves: int = CURVES, dims: int = DIMS, seed: int = 5) -> Curves:
        rng = np.random.default_rng(seed)
        dims = min(dims, sample.shape[1])
        axes = np.stack([np.linalg.qr(rng.normal(size=(sample.shape[1], dims)))[0].T for _ in range(curves)])
        return Curves(axes, np.sort(np.einsum("cdv,nv->cdn", axes, unit(sample)), axis=2), rng.random((curves, dims)))

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """Hilbert keys, (curves, n)."""
        v, out = unit(vectors), []
        for axes, ladder, shift in zip(self.axes, self.ladder, self.shift, strict=True):
            p = v @ axes.T
            u = np.stack([np.searchsorted(ladder[d], p[:, d]) for d in range(len(ladder))], 1) / (ladder.shape[1] + 1)
            out.append(hilbert_index(((u + shift) / 2 * (1 << BITS)).astype(np.int64), BITS))
        return np.stack(out)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1)[:, None]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.where(F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()) if len(col) else np.zeros((0, 1))


def _nearest(points: DataFrame, probes: pd.DataFrame, k: int) -> DataFrame:
    """(probe, point) of the k + 1 points nearest to each probe, by comparison with all."""
    v = unit(_matrix(probes["v"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cos = v @ unit(_matrix(b["v"])).T
            few = min(k + 1, cos.shape[1])
            top = np.argpartition(-cos, few - 1, axis=1)[:, :few]
            yield pd.DataFrame({"probe": np.repeat(probes["point"].to_numpy(), few), "score": np.take_along_axis(cos, top, 1).ravel(), "point": b["point"].to_numpy()[top.ravel()]})

    near = points.select("point", "v").mapInPandas(run, "probe long, score double, point long")
    rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "point"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k + 1).select("probe", "point")


def reach_of(points: DataFrame, placed: DataFrame, asked: DataFrame, k: int) -> int:
    """Places to either side within which RECALL of the true neighbours of PROBES queries lie on some curve, 1 at least."""
    probes = asked.orderBy(F.xxhash64("point"), "point").limit(PROBES).toPandas()
    if not len(probes):
        return 1
    near = _nearest(points, probes, k).where("probe <> point")
    spots = lambda name: placed.select(F.col("point").alias(name), "curve", F.col("place").alias(f"{name}_place"))
    few = table(near, "ann-near")  # k + 1 rows a probe
    apart = spots("point").join(F.broadcast(few), "point").join(spots("probe").join(F.broadcast(few.select("probe").distinct()), "probe"), ["probe", "curve"])
    least = sorted(r["d"] for r in apart.groupBy("probe", "point").agg(F.min(F.abs(F.col("point_place") - F.col("probe_place"))).alias("d")).collect())
    return max(1, least[ceil(RECALL * len(least)) - 1]) if least else 1


def _codes(v: np.ndarray) -> np.ndarray:
    """Vectors rounded to a byte a component of their largest one."""
    return np.rint(v / np.abs(v).max(axis=1)[:, None] * 127).astype(np.int8)


def _decoded(col: pd.Series) -> np.ndarray:
    """Whole numbers, of a kind that holds sums of their products exactly, so that equal codes have equal scores."""
    v = np.frombuffer(b"".join(col), np.int8).reshape(len(col), -1)
    return v.astype(np.float32 if v.shape[1] <= 1000 else np.float64)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with that of b, rounded to double once."""
    a, b = a.astype(np.longdouble), b.astype(np.longdouble)
    return ((a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))).astype(np.float64)


def _short(found: DataFrame, most: int) -> DataFrame:
    """The best points of each query by rounded vectors."""
    rows = found.groupBy("query", "point").agg(F.max("about").alias("about"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("about"), "point"))
    return rows.withColumn("n", rank).where(F.col("n") <= most).select("query", "point")


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", reach: int | None = None, curves: int = CURVES) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest found for the rows where ``is_query`` holds (over ``id``).

    reach: places of a window to either side; None: as many as RECALL takes.
    """
    with temporary(vectors.sparkSession):
        return table(_search(vectors, is_query, k, id_col, vec_col, reach, curves), "ann", keep=True)


def _search(vectors: DataFrame, is_query: Column, k: int, id_col: str, vec_col: str, reach: int | None, curves: int) -> DataFrame:
    spark = vectors.sparkSession
    rows = table(usable(vectors, id_col, vec_col), "ann-rows")
    # points: distinct vectors, with their k + 1 smallest ids (one may be the query's own), numbered by the smallest
    firsts = F.row_number().over(Window.partitionBy("v", "part").orderBy("id"))
    some = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("n", firsts).where(F.col("n") <= k + 1)
    points = some.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    first = F.get("ids", F.lit(0))
    points = table(points.repartitionByRange(first).sortWithinPartitions(first).withColumn("point", F.monotonically_increasing_id()), "ann-points")
    sample = points.orderBy(F.xxhash64(first)).limit(FIT_ROWS).select("v").toPandas()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = Curves.fit(_matrix(sample["v"]), curves)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = _matrix(b["v"])
            keys, codes = fitted.keys(v), [x.tobytes() for x in _codes(v)]
            for c in range(len(keys)):
                yield pd.DataFrame({"point": b["point"], "curve": c, "key": keys[c], "code": codes})

    # points in the order of each curve; a written copy keeps the places fixed
    keys = points.select("point", "v").mapInPandas(keyed, "point long, curve int, key long, code binary")
    order = ["curve", "key", "point"]
    placed = table(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("key"), "ann-keys")
    part = F.shiftright("at", 33)
    runs = placed.groupBy("curve", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))  # a few rows a partition
    before = F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("curve", "part", "first", F.coalesce(before, F.lit(0)).alias("before"))
    placed = placed.withColumn("part", part).join(runs, ["curve", "part"]).select("point", "curve", "code", (F.col("at") - F.col("first") + F.col("before")).alias("place"))

    asked = table(rows.where(is_query).select("v").distinct().join(points.select("v", "point"), "v"), "ann-asked")
    reach = reach or reach_of(points, placed.drop("code"), asked, k)
    block = min(max(reach, BLOCK[0]), BLOCK[1])  # a query so meets three blocks of a curve at most, up to the largest
    cells = placed.withColumn("block", F.floor(F.col("place") / block))
    # a query visits the blocks that hold places in reach of its own
    lowest, highest = (F.floor((F.col("place") + d) / block) for d in (-reach, reach))
    asks = placed.join(asked.select("point"), "point").select(F.col("point").alias("query"), F.col("code").alias("code"), F.col("curve").alias("curve"), F.explode(F.sequence(F.greatest(lowest, F.lit(0)), highest)).alias("block"))

    def compare(queries: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(near):
            near = near.sort_values("point")
            v, point = _decoded(near["code"]), near["point"].to_numpy()
            size = np.sqrt((v * v).sum(1))
            step = max(1, CELLS // len(near))
            few = min(max(NEAR, 2 * k), len(near))
            for at in range(0, len(queries), step):
                some = queries.iloc[at : at + step]
                own = _decoded(some["code"])
                cos = (own @ v.T) / size / np.sqrt((own * own).sum(1))[:, None]
                least = -np.partition(-cos, few - 1, axis=1)[:, few - 1]
                q, j = np.nonzero(cos >= least[:, None])  # all that tie with the last, points in order
                score = cos[q, j]
                best = np.lexsort((j, -score, q))
                q, j, score = q[best], j[best], score[best]
                start = np.searchsorted(q, np.arange(len(some)))
                take = np.arange(len(q)) - start[q] < few
                found.append(pd.DataFrame({"query": some["query"].to_numpy()[q[take]], "point": point[j[take]], "about": score[take]}))
        return pd.concat(found) if found else pd.DataFrame({"query": [], "point": [], "about": []})

    hits = asks.groupBy("curve", "block").cogroup(cells.select("curve", "block", "point", "code").groupBy("curve", "block")).applyInPandas(compare, "query long, point long, about double")
    short = table(_short(hits, max(SHORT, 4 * k)), "ann-short")

    # the vectors of the short list, and the score
    a = points.select(F.col("point").alias("query"), F.col("v").alias("a"))
    b = points.select("point", "ids", F.col("v").alias("b"))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"query": x["query"], "ids": x["ids"], "score": _cosines(_matrix(x["a"]), _matrix(x["b"])) if len(x) else []})

    pairs = short.join(a, "query").join(b, "point").select("query", "ids", "a", "b")
    lists = pairs.mapInPandas(scored, "query long, ids array<long>, score double")
    # of each queried point the candidates in order: k besides any copies of a query's own id
    each = lists.select("query", "score", F.explode("ids").alias("vec_id"))
    lists = each.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))).alias("list"))
    mine = rows.where(is_query).select(F.col("id").alias("query_id"), "v").join(asked, "v").select("query_id", F.col("point").alias("query"))
    other = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = mine.join(lists, "query").select("query_id", F.posexplode(other).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", (-F.col("x.less")).alias("score"))
