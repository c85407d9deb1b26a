"""Clustering metrics: WCSS, silhouettes, elbow, majority labels of bins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators import kmeans

# Fixed value: rows of the sample whose pairs make the Euclidean silhouette.
SILHOUETTE_ROWS = 5000


def wcss(assigned: DataFrame) -> DataFrame:
    """One row: wcss and wcss_n of (cell_id, cluster, distance) rows."""
    return assigned.agg(F.sum("distance").alias("wcss"), (F.sum("distance") / F.count("*")).alias("wcss_n"))


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """(cluster, n, pct)."""
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("n"))
    return sizes.crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("all")))).select("cluster", "n", (F.col("n") * 100.0 / F.col("all")).alias("pct"))


def silhouettes_squared(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(cell_id, cluster, s) with squared Euclidean distances, exact, without pairs.

    The sum of squared distances from x to a cluster of n points, sum S and square sum Q is
    n |x|^2 - 2 x.S + Q.  A point alone in its cluster has a = 0, so s = 1; with one cluster s is 0.
    """
    points = rows.join(labels.select("cell_id", "cluster"), "cell_id")
    long = points.select("cell_id", "cluster", F.posexplode("pc").alias("dim", "x"))
    stats = long.groupBy("cluster", "dim").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    whole = stats.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("dim", "s"))).alias("e"), F.sum("q").alias("q"), F.max("n").alias("n")).select(F.col("cluster").alias("other"), F.col("e.s").alias("s"), "q", "n")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda t, v: t + v)
    clusters = whole.agg(F.collect_list(F.struct("other", "s", "q", "n")).alias("clusters"))  # one row of k sums
    each = points.withColumn("xx", dot("pc", "pc")).crossJoin(F.broadcast(clusters))

    def mean(c):
        total = F.greatest(c["n"] * F.col("xx") - 2 * dot("pc", c["s"]) + c["q"], F.lit(0.0))
        own = c["other"] == F.col("cluster")
        return F.struct(own.alias("own"), F.when(own, F.when(c["n"] > 1, total / (c["n"] - 1)).otherwise(0.0)).otherwise(total / c["n"]).alias("mean"))

    means = each.select("cell_id", "cluster", F.transform("clusters", mean).alias("means"))
    of = lambda own: F.transform(F.filter("means", lambda m: m["own"] if own else ~m["own"]), lambda m: m["mean"])
    by = means.select("cell_id", "cluster", F.array_max(of(True)).alias("a"), F.array_min(of(False)).alias("b"))
    top = F.greatest("a", "b")
    return by.select("cell_id", "cluster", F.when(F.col("b").isNull() | (top <= 0), 0.0).otherwise((F.col("b") - F.col("a")) / top).alias("s"))


def mean_silhouettes(rows: DataFrame, sets: dict[int, np.ndarray]) -> dict[int, float]:
    """The means of ``silhouettes_squared`` with each row in the cluster of its nearest centroid, for several sets of centroids in the same two passes."""
    shared = rows.sparkSession.sparkContext.broadcast((sets, kmeans.tables(rows, sets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, tables = shared.value
        total, count = dict.fromkeys(sets, 0.0), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = kmeans.coordinates(batch)
            at, xx = np.arange(len(x)), (x * x).sum(axis=1)
            for key, centroids in sets.items():
                own, _ = kmeans.nearest(x, centroids, xx)
                n, q, s = tables[key][:, 0], tables[key][:, 2], tables[key][:, 3:]
                far = np.maximum(xx[:, None] * n - 2 * x @ s.T + q, 0)
                a = np.where(n[own] > 1, far[at, own] / np.maximum(n[own] - 1, 1), 0)
                far = np.where(n > 0, far / np.maximum(n, 1), np.inf)
                far[at, own] = np.inf
                b = far.min(axis=1)
                top = np.maximum(a, b)
                none = np.isinf(b) | (top <= 0)
                total[key] += np.where(none, 0, np.where(none, 0, b - a) / np.where(none, 1, top)).sum()
            count += len(x)
        yield pa.RecordBatch.from_pydict({"key": list(total), "s": list(total.values()), "n": [count] * len(total)}, pa.schema([("key", pa.int32()), ("s", pa.float64()), ("n", pa.int64())]))

    found = rows.select("pc").mapInArrow(run, "key int, s double, n long").groupBy("key").agg((F.sum("s") / F.sum("n")).alias("s")).collect()
    return {r.key: r.s for r in found}


def silhouettes_euclidean(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(cell_id, cluster, s) with Euclidean distances, by pairs: for a bounded sample.  A point alone in its cluster has s = 0."""
    points = rows.join(labels.select("cell_id", "cluster"), "cell_id").select("cell_id", "cluster", "pc")
    others = points.toDF("o_id", "o_cluster", "o_pc")
    distance = F.sqrt(F.aggregate(F.zip_with("pc", "o_pc", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda t, v: t + v))
    # the sample is sent to tasks of some rows each: a sample drawn by a limit is in one partition
    means = points.repartition(32, "cell_id").join(F.broadcast(others), F.col("cell_id") != F.col("o_id")).groupBy("cell_id", "cluster", "o_cluster").agg(F.avg(distance).alias("mean"))
    own = F.col("cluster") == F.col("o_cluster")
    by = means.groupBy("cell_id", "cluster").agg(F.max(F.when(own, F.col("mean"))).alias("a"), F.min(F.when(~own, F.col("mean"))).alias("b"))
    top = F.greatest("a", "b")
    return by.select("cell_id", "cluster", F.when(F.col("a").isNull() | F.col("b").isNull() | (top <= 0), 0.0).otherwise((F.col("b") - F.col("a")) / top).alias("s"))


def second_differences(curve: DataFrame) -> DataFrame:
    """(k, wcss, bend): the second derivative of WCSS by position, spacing of k ignored; one-sided at the ends."""
    w = Window.orderBy("k")  # one row a k

    def slope(c: str):
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        return F.when(before.isNull(), after - F.col(c)).when(after.isNull(), F.col(c) - before).otherwise((after - before) / 2)

    return curve.select("k", "wcss").withColumn("d", slope("wcss")).withColumn("bend", slope("d")).select("k", "wcss", F.coalesce("bend", F.lit(0.0)).alias("bend"))


def elbow(curve: DataFrame) -> DataFrame:
    """One row: the k of the largest second difference, the first of equals."""
    return second_differences(curve).orderBy(F.desc("bend"), "k").limit(1).select("k")


def best_silhouette(curve: DataFrame) -> DataFrame:
    """One row: the k of the largest silhouette, the first of equals."""
    return curve.orderBy(F.desc("silhouette"), "k").limit(1).select("k")


def majority_bins(points: DataFrame, size: float) -> DataFrame:
    """(bin_x, bin_y, cluster, n): the commonest cluster of each square bin of (x, y, cluster) points; ties go to the lowest."""
    bins = points.groupBy(F.floor(F.col("x") / size).alias("bin_x"), F.floor(F.col("y") / size).alias("bin_y"), "cluster").agg(F.count("*").alias("n"))
    best = bins.groupBy("bin_x", "bin_y").agg(F.max(F.struct("n", (-F.col("cluster")).alias("minus"))).alias("m"))
    return best.select("bin_x", "bin_y", (-F.col("m.minus")).alias("cluster"), "m.n")


def majority_hexagons(points: DataFrame, width: float) -> DataFrame:
    """(bin_x, bin_y, cluster, n): the commonest cluster of each hexagon of (x, y, cluster) points; ties go to the lowest.

    Hexagons of ``width`` from side to side tile the plane: their centres are a lattice of width x sqrt(3) width
    cells (whole bin numbers) and its copy moved by half a cell (halves); a point belongs to the nearer of both
    lattices' nearest centres, to the moved one on a tie.
    """
    u, v = F.col("x") / width, F.col("y") / (width * 3**0.5)
    near = [F.floor(u + 0.5), F.floor(v + 0.5), F.floor(u) + 0.5, F.floor(v) + 0.5]
    distance = lambda a, b: (u - a) * (u - a) + 3 * (v - b) * (v - b)
    whole = distance(*near[:2]) < distance(*near[2:])
    pick = lambda a, b: F.when(whole, a.cast("double")).otherwise(b)
    bins = points.groupBy(pick(near[0], near[2]).alias("bin_x"), pick(near[1], near[3]).alias("bin_y"), "cluster").agg(F.count("*").alias("n"))
    best = bins.groupBy("bin_x", "bin_y").agg(F.max(F.struct("n", (-F.col("cluster")).alias("minus"))).alias("m"))
    return best.select("bin_x", "bin_y", (-F.col("m.minus")).alias("cluster"), "m.n")


def moving_average(shifts: DataFrame, share: float) -> DataFrame:
    """One row: the exponentially weighted average of (position, shift) rows, in order; the first one starts it."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "shift"))), lambda s: s["shift"])
    value = F.aggregate(F.slice("x", 2, F.size("x")), F.element_at("x", 1), lambda t, v: t * (1 - share) + v * share)
    return shifts.agg(ordered.alias("x")).select(value.alias("average"))
