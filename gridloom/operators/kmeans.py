"""K-means on dense score rows (cell_id, pc) and its sparse forms; seeds, Lloyd, mini-batches, sweeps over K.

Centroids, k x d numbers, live on the driver between passes; a pass over the rows
returns partial sums of each partition, summed by key before they are collected (a sweep
deals its rows to few partitions, whose sums are collected as they are).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.scratch import saved

MAX_ITER, TOL, N_INIT, SEED = 300, 1e-4, 3, 42
SEED_ROWS = 10_000
#: Rows of a sweep's partition: the least that make another one worth its task, and the most.
LEAST_ROWS, MOST_ROWS = 1000, 200_000
#: Partitions whose sums the driver adds up itself.
FEW = 64


@dataclass(frozen=True)
class Fit:
    centroids: np.ndarray
    wcss: float
    n: int
    n_iters: int


def _matrix(column: pd.Series, d: int) -> np.ndarray:
    return np.concatenate(column.to_numpy()).reshape(-1, d).astype(np.float64) if len(column) else np.zeros((0, d))


def coordinates(batch: pa.RecordBatch) -> np.ndarray:
    """The rows x d numbers of a batch's column pc."""
    column = batch.column(batch.schema.get_field_index("pc"))
    d = len(column[0]) if len(column) and not column.null_count else 0
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(x) != len(column) * d or column.null_count:
        raise ValueError("rows need the same number of coordinates")
    return x.reshape(len(column), d)


def nearest(x: np.ndarray, centroids: np.ndarray, squares: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each row; ties go to the lowest cluster.  ``squares`` are the rows' squared norms, if they are at hand."""
    d = x @ (-2 * centroids).T
    d += ((x * x).sum(axis=1) if squares is None else squares)[:, None]
    d += (centroids * centroids).sum(axis=1)
    own = d.argmin(axis=1)
    return own, np.maximum(d[np.arange(len(x)), own], 0)


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cell_id, cluster, distance): squared distances to the nearest centroid."""
    shared = rows.sparkSession.sparkContext.broadcast(np.asarray(centroids, np.float64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, distance = nearest(_matrix(batch["pc"], shared.value.shape[1]), shared.value)
            yield pd.DataFrame({"cell_id": batch["cell_id"], "cluster": own.astype(np.int32), "distance": distance})

    return rows.select("cell_id", "pc").mapInPandas(run, "cell_id long, cluster int, distance double")


def cluster_sums(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, dim, total, n) of dense rows by their labels."""
    long = rows.join(labels.select("cell_id", "cluster"), "cell_id").select("cluster", F.posexplode("pc").alias("dim", "x"))
    return long.groupBy("cluster", "dim").agg(F.sum("x").alias("total"), F.count("*").alias("n"))


def sparse_cluster_sums(expr: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, gene_id, total) of a sparse matrix by its cells' labels."""
    return expr.join(labels.select("cell_id", "cluster"), "cell_id").groupBy("cluster", "gene_id").agg(F.sum("value").alias("total"))


def sparse_assign(expr: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cell_id, cluster, distance) for sparse rows and sparse centroids (cluster, gene_id, value).

    |x|^2 - 2 x.c + |c|^2 with stored entries alone; ties go to the lowest cluster.  Centroids are k rows a gene.
    """
    norms = expr.groupBy("cell_id").agg(F.sum(F.col("value") * F.col("value")).alias("xn"))
    cn = centroids.groupBy("cluster").agg(F.sum(F.col("value") * F.col("value")).alias("cn"))
    dots = expr.join(centroids.select("cluster", "gene_id", F.col("value").alias("c")), "gene_id").groupBy("cell_id", "cluster").agg(F.sum(F.col("value") * F.col("c")).alias("dot"))
    every = norms.crossJoin(F.broadcast(cn)).join(dots, ["cell_id", "cluster"], "left")
    distance = F.greatest(F.col("xn") - 2 * F.coalesce("dot", F.lit(0.0)) + F.col("cn"), F.lit(0.0))
    best = every.groupBy("cell_id").agg(F.min(F.struct(distance.alias("distance"), F.col("cluster"))).alias("best"))
    return best.select("cell_id", "best.cluster", "best.distance")


def squared_norms(expr: DataFrame) -> DataFrame:
    return expr.groupBy("cell_id").agg(F.sum(F.col("value") * F.col("value")).alias("norm"))


TABLE = pa.schema([("key", pa.int32()), ("sums", pa.binary())])


def tables(rows: DataFrame, fits: dict[int, np.ndarray], few: bool = False) -> dict[int, np.ndarray]:
    """Under each of several sets of centroids a row a cluster: n, WCSS, sum of squares, sums; in one pass over the rows.

    Tables of rows in ``few`` partitions are added up on the driver, others by key before they are collected.
    """
    shape = {key: (len(c), c.shape[1] + 3) for key, c in fits.items()}

    def packed(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key": list(sums), "sums": [table.tobytes() for table in sums.values()]}, TABLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = coordinates(batch)
            squares = (x * x).sum(axis=1)
            for key, centroids in fits.items():
                own, distance = nearest(x, centroids, squares)
                k = len(centroids)
                n = np.bincount(own, minlength=k)
                table = sums.setdefault(key, np.zeros(shape[key]))
                table[:, 0] += n
                table[:, 1] += np.bincount(own, distance, k)
                table[:, 2] += np.bincount(own, squares, k)
                some = np.flatnonzero(n)
                table[some, 3:] += np.add.reduceat(x[np.argsort(own, kind="stable")], (np.cumsum(n) - n)[some], axis=0)
        yield packed(sums)

    def add(pairs) -> dict[int, np.ndarray]:
        sums: dict[int, np.ndarray] = {}
        for key, table in pairs:
            sums[key] = sums.get(key, 0) + np.frombuffer(table).reshape(shape[key])
        return sums

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield packed(add(p for batch in batches for p in zip(*(c.to_pylist() for c in batch.columns), strict=True)))

    schema = "key int, sums binary"
    found = rows.select("pc").mapInArrow(run, schema)
    if not few:
        found = found.repartition("key").mapInArrow(merge, schema)
    sums = add((r.key, r.sums) for r in found.collect())
    return {key: sums.get(key, np.zeros(shape[key])) for key in fits}


def _pass(rows: DataFrame, fits: dict[int, np.ndarray], few: bool = False) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Sums, counts and WCSS under each of several sets of centroids, in one pass over the rows."""
    return {key: (table[:, 3:], table[:, 0], float(table[:, 1].sum())) for key, table in tables(rows, fits, few).items()}


def lloyd(rows: DataFrame, starts: dict[int, np.ndarray], max_iter: int = MAX_ITER, tol: float = TOL, few: bool = False) -> dict[int, Fit]:
    """Lloyd's iteration from each start, all in the same passes; WCSS is that of the centroids before the last update.

    An empty cluster keeps its centroid.  A run stops when the Frobenius shift relative to the
    centroids' norm is below ``tol``, or when nothing has moved.  Rows without cells give WCSS 0.
    """
    open_, done = {k: np.asarray(c, np.float64) for k, c in starts.items()}, {}
    for i in range(1, max_iter + 1):
        for key, (total, n, wcss) in _pass(rows, open_, few).items():
            old = open_[key]
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], old)
            shift = np.linalg.norm(new - old)
            if shift <= 1e-12 or shift / max(np.linalg.norm(old), 1e-12) < tol or i == max_iter:
                done[key] = Fit(new, wcss, int(n.sum()), i)
            open_[key] = new
        open_ = {k: c for k, c in open_.items() if k not in done}
        if not open_:
            break
    return done


def uniform_sample(rows: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """``n`` rows without replacement (all, if fewer), the same in each run: those of least hash."""
    return rows.orderBy(F.xxhash64(F.lit(seed), "cell_id"), "cell_id").limit(n)


def lowest_ids(rows: DataFrame, k: int) -> np.ndarray:
    """The rows of the ``k`` lowest ids as centroids: a start that needs no random numbers."""
    return np.array([r.pc for r in rows.orderBy("cell_id").limit(k).select("pc").collect()], np.float64)


def plus_plus(x: np.ndarray, k: int, seed: int = SEED) -> np.ndarray:
    """k-means++ over an array: each next centroid with probability proportional to the squared distance."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    distance = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    for _ in range(1, k):
        total = distance.sum()
        chosen.append(int(rng.choice(len(x), p=distance / total)) if total > 0 else int(rng.integers(len(x))))
        distance = np.minimum(distance, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def sampled_plus_plus(rows: DataFrame, k: int, seed: int = SEED, size: int = SEED_ROWS) -> np.ndarray:
    """k-means++ on a uniform sample of ``size`` rows."""
    return plus_plus(np.array([r.pc for r in uniform_sample(rows, size, seed).select("pc").collect()], np.float64), k, seed)


def gumbel_seeds(rows: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """k-means++ over all rows without their distribution: the next centroid has the largest ln(distance) + Gumbel noise."""
    return gumbel_chains(rows, k, [seed])[0]


BEST = pa.schema([("chain", pa.int32()), ("score", pa.float64()), ("cell_id", pa.int64()), ("pc", pa.list_(pa.float64()))])


def gumbel_chains(rows: DataFrame, k: int, seeds: list[int], few: bool = False) -> list[np.ndarray]:
    """``gumbel_seeds`` of several seeds, in the same passes: one a centroid, whatever the chains.

    A pass gives the best row of each partition and chain, and the best of these with its
    coordinates (found on the driver for ``few`` partitions), so nothing is sorted or read again.
    Noise comes from a hash of the id, so reruns agree.  The first centroid is the row of the
    largest noise; ties go to the lowest id.
    """
    chosen: list[list[np.ndarray]] = [[] for _ in seeds]
    unit = lambda seed, step: ((F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "cell_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52))
    for step in range(k):
        so_far = [np.array(c) for c in chosen]

        def run(batches: Iterator[pa.RecordBatch], so_far=so_far) -> Iterator[pa.RecordBatch]:
            top: dict[int, tuple[float, int, np.ndarray]] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, ids = coordinates(batch), batch.column(0).to_numpy()
                squares = (x * x).sum(axis=1)
                for chain, centroids in enumerate(so_far):
                    score = -np.log(-np.log(batch.column(2 + chain).to_numpy()))
                    if len(centroids):
                        score = score + np.log(nearest(x, centroids, squares)[1] + 1e-10)
                    best = np.lexsort((ids, -score))[0]
                    if chain not in top or (score[best], -ids[best]) > (top[chain][0], -top[chain][1]):
                        top[chain] = (score[best], ids[best], x[best])
            for chain, (score, cell, pc) in top.items():
                yield pa.RecordBatch.from_pydict({"chain": [chain], "score": [score], "cell_id": [cell], "pc": [pc]}, BEST)

        noisy = rows.select("cell_id", "pc", *[unit(s, step).alias(f"u{c}") for c, s in enumerate(seeds)])
        found = noisy.mapInArrow(run, "chain int, score double, cell_id long, pc array<double>")
        if few:
            best = {r.chain: r for r in sorted(found.collect(), key=lambda r: (r.score, -r.cell_id))}.values()
        else:
            best = found.groupBy("chain").agg(F.max_by("pc", F.struct("score", -F.col("cell_id"))).alias("pc")).collect()
        if not best:
            break
        for r in best:
            chosen[r.chain].append(np.array(r.pc, np.float64))
    return [np.array(c) for c in chosen]


def fit_k(rows: DataFrame, k: int, chains: list[np.ndarray], max_iter: int = MAX_ITER, tol: float = TOL) -> Fit:
    """The best of one run from the first ``k`` seeds of each chain: least WCSS, the first of equals."""
    fits = lloyd(rows, {r: c[:k] for r, c in enumerate(chains)}, max_iter, tol)
    return min(fits.items(), key=lambda f: (f[1].wcss, f[0]))[1]


def sweep(rows: DataFrame, ks: list[int], n_init: int = N_INIT, seed: int = SEED, max_iter: int = MAX_ITER, tol: float = TOL) -> dict[int, Fit]:
    """Fits for each K, from shared seed chains as long as the largest; the runs of all K and chains share their passes."""
    whole = rows.select("cell_id", "pc").persist()
    n = whole.count()
    # a task for each core, so that a table in one file keeps all of them at work; more where their rows get many
    parts = max(min(rows.sparkSession.sparkContext.defaultParallelism, n // LEAST_ROWS), -(-n // MOST_ROWS), 1)
    rows = whole.repartition(parts).persist()
    try:
        rows.count()
        whole.unpersist()
        few = parts <= FEW
        chains = gumbel_chains(rows, max(ks), [seed + 1000 * r for r in range(n_init)], few)
        runs = [(k, r) for k in ks for r in range(n_init)]
        fits = lloyd(rows, {i: chains[r][:k] for i, (k, r) in enumerate(runs)}, max_iter, tol, few)
        best: dict[int, tuple[float, int]] = {}
        for i, (k, _) in enumerate(runs):
            best[k] = min(best.get(k, (math.inf, i)), (fits[i].wcss, i))
        return {k: fits[i] for k, (_, i) in best.items()}
    finally:
        whole.unpersist()
        rows.unpersist()


@dataclass
class MiniBatch:
    """Mini-batch k-means: counts-weighted running means, and a moving average of the relative shift."""

    centroids: np.ndarray
    counts: np.ndarray
    average: float | None = None

    @classmethod
    def start(cls, centroids: np.ndarray) -> MiniBatch:
        return cls(np.array(centroids, np.float64), np.zeros(len(centroids)))

    def update(self, sums: np.ndarray, n: np.ndarray, share: float | None) -> float | None:
        """Move centroids towards a batch's means; ``share`` is the weight of its shift in the average, which is returned; None leaves the average."""
        old = self.centroids
        self.counts = self.counts + n
        means = sums / np.maximum(n, 1)[:, None]
        rate = np.where(n > 0, n / np.maximum(self.counts, 1), 0)[:, None]
        self.centroids = old + rate * (np.where(n[:, None] > 0, means, old) - old)
        if share is None:
            return self.average
        shift = float(np.linalg.norm(self.centroids - old) / max(np.linalg.norm(old), 1e-12))
        self.average = shift if self.average is None else (1 - share) * self.average + share * shift
        return self.average


def fit_minibatch(rows: DataFrame, k: int, batch: int = 5000, max_iter: int = 2000, tol: float = 3e-4, seed: int = SEED, eval_every: int = 1, patience: int = 1) -> tuple[np.ndarray, int]:
    """Centroids and iterations: batches by hash of the id, until the average relative shift is below ``tol``.

    The shift of every ``eval_every``-th batch goes into the average; ``patience`` evaluations
    in a row must be below.  A batch larger than the data is all of it.  Rows are
    written once in order of their batch, so that a batch reads its own row groups, not the table;
    epochs take the batches in orders of their own.
    """
    rows = rows.select("cell_id", "pc")
    n = rows.count()
    parts = max(1, n // batch)
    if parts > 1:
        dealt = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "cell_id"), F.lit(parts)))
        rows = saved(dealt.repartitionByRange("part").sortWithinPartitions("part"), "batches")
    model = MiniBatch.start(sampled_plus_plus(rows, k, seed))
    share, below = min(1.0, 5.0 * batch / max(n, 1)), 0
    for i in range(max_iter):
        epoch, place = divmod(i, parts)
        drawn = rows if parts == 1 else rows.filter(F.col("part") == int(np.random.default_rng((seed, epoch)).permutation(parts)[place]))
        total, counts, _ = _pass(drawn, {0: model.centroids})[0]
        judged = (i + 1) % eval_every == 0
        average = model.update(total, counts, share if judged else None)
        if judged:
            below = below + 1 if average < tol else 0
            if below >= patience:
                return model.centroids, i + 1
    return model.centroids, max_iter


def minibatch_sweep(rows: DataFrame, ks: list[int], batch: int = 10_000, n_init: int = 3, max_iter: int = 100, tol: float = 3e-4, seed: int = SEED) -> dict[int, Fit]:
    """For each K the best of ``n_init`` mini-batch fits by WCSS over all rows, the first of equals."""
    out = {}
    for k in ks:
        runs = [fit_minibatch(rows, k, batch, max_iter, tol, seed + 1000 * r) for r in range(n_init)]
        found = _pass(rows, {r: c for r, (c, _) in enumerate(runs)})
        best = min(found, key=lambda r: (found[r][2], r))
        out[k] = Fit(runs[best][0], found[best][2], int(found[best][1].sum()), runs[best][1])
    return out
