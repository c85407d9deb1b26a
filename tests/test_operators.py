"""Fixtures with known answers, brute force, and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import describe, features, kmeans, metrics, normalize, pca, qc
from gridloom.plans import domain
from gridloom.sources import arrays, matrix

EXPR = "cell_id long, gene_id int, value double"


def expr_of(spark, dense):
    rows = [(int(c), int(g), float(dense[c, g])) for c, g in zip(*np.nonzero(dense), strict=True)]
    return spark.createDataFrame(rows, EXPR)


def cells_of(spark, n, clusters=None):
    return spark.createDataFrame([(i, f"b{i}", clusters[i] if clusters else "c") for i in range(n)], "cell_id long, barcode string, cluster string")


def rows_of(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "cell_id long, pc array<double>")


@pytest.mark.parametrize(("least", "cells", "genes", "entries"), [(20, 92, 200, 3552), (30, 70, 200, 2989)])
def test_qc_golden(spark, least, cells, genes, entries):
    m = domain.customer_parts(spark, "/root/testdata/sf0.001")
    out = qc.quality_control(m, least, 3, 15.0, 0.5)
    assert (out.cells.count(), out.genes.count(), out.expr.count()) == (cells, genes, entries)


def test_qc_edges(spark):
    genes = qc.flag_mt(spark.createDataFrame([(0, "MT-a", ""), (1, "Mt-b", ""), (2, "mt-c", ""), (3, "x", "")], "gene_id int, gene_name string, gene_ref string"))
    assert [r.mt for r in genes.orderBy("gene_id").collect()] == [True, False, True, False]
    expr = spark.createDataFrame([(0, 0, 5.0), (0, 3, 95.0), (1, 3, 0.0), (2, 2, 4.0), (2, 3, 96.0)], EXPR)
    got = {r.cell_id: r for r in qc.cell_metrics(expr, genes).collect()}
    assert got[0].pct_mt == 5.0 and got[1].pct_mt == 0.0 and got[1].n_genes == 1
    assert {r.cell_id for r in qc.valid_cells(qc.cell_metrics(expr, genes), 2, 5.0).collect()} == {2}
    none = qc.quality_control(matrix.Matrix(expr, cells_of(spark, 3), genes), 50)
    assert none.expr.count() == none.cells.count() == none.genes.count() == 0


def test_unique_names(spark):
    names = ["a", "a", "a-1", "a", "b", "a-1", "b", "a-02"]
    genes = spark.createDataFrame([(i, n, "") for i, n in enumerate(names)], "gene_id int, gene_name string, gene_ref string")
    got = [r.unique_name for r in qc.unique_names(genes).orderBy("gene_id").collect()]
    assert len(set(got)) == len(names) and got[0] == "a" and got[2] == "a-1" and got[1] == "a-2" and got[3] == "a-3" and got[6] == "b-1"


def test_layouts():
    assert matrix.probe_layout({"matrix": {}, "x": {}})[0] == "matrix"
    assert matrix.probe_layout({"misc": {}, "hg": {"data": 1}})[0] == "hg"
    with pytest.raises(matrix.LayoutError):
        matrix.probe_layout({"misc": {}, "hg": {"data": 1}}, strict=True)
    with pytest.raises(matrix.LayoutError):
        matrix.probe_layout({"misc": {}})


def test_compressed_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    dense = rng.poisson(0.5, (17, 9)).astype(float)
    indptr = np.concatenate([[0], np.cumsum((dense != 0).sum(axis=1))])
    c, g = np.nonzero(dense)
    m = matrix.from_compressed(spark, indptr, g, dense[c, g], [f"b{i}".encode() for i in range(17)], list("abcdefghi"), list("ABCDEFGHI"), chunk=5)
    matrix.write_matrix(m, str(tmp_path / "m"))
    back = matrix.read_matrix(spark, str(tmp_path / "m"))
    out = np.zeros_like(dense)
    for r in back.expr.collect():
        out[r.cell_id, r.gene_id] = r.value
    assert (out == dense).all() and back.cells.count() == 17 and back.cells.first().barcode.startswith("b")


def test_array_files(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(30, 4))
    np.save(tmp_path / "s.npy", x)
    np.savez(tmp_path / "l.npz", k2=np.arange(30) % 2, k3=np.arange(30) % 3)
    got = arrays.read_npy(spark, str(tmp_path / "s.npy")).orderBy("cell_id").collect()
    assert np.allclose([r.pc for r in got], x)
    labels = arrays.read_npz_labels(spark, str(tmp_path / "l.npz"))
    assert labels.filter("k = 3 and cluster = 2").count() == 10 and labels.count() == 60
    found, report = arrays.guarded(spark, "raw", lambda: spark.read.parquet(str(tmp_path / "absent")))
    assert found is None and report.first().status == "FALHA"


def test_pool_solution_is_least_squares():
    rng = np.random.default_rng(2)
    n, widths = 130, (1, *normalize.WIDTHS)
    ratios = rng.normal(1, 0.1, (len(widths), n))
    a = np.concatenate([[[1.0 if (c - s) % n < w else 0.0 for c in range(n)] for s in range(n)] for w in widths])
    want = np.linalg.lstsq(a, ratios.ravel(), rcond=None)[0]
    assert np.abs(normalize.solve_pools(ratios, widths) - want).max() < 1e-9


def test_deconvolution_recovers_factors(spark):
    rng = np.random.default_rng(3)
    truth = rng.uniform(0.4, 2.5, 220)
    counts = rng.poisson(truth[:, None] * rng.gamma(2, 2, 300)[None, :]).astype(float)
    theta = normalize.deconvolve(counts)
    assert np.corrcoef(theta, truth)[0, 1] > 0.98 and math.isclose(theta.mean(), 1)
    blocked = normalize.blocks(cells_of(spark, 220, ["x"] * 120 + ["y"] * 60 + ["z"] * 40), 100)
    sizes = {(r.cluster, r.block): r.n for r in blocked.groupBy("cluster", "block").agg(F.count("*").alias("n")).collect()}
    assert sizes == {("x", 0): 100, ("x", 1): 20, ("y", 0): 60, ("z", 0): 40}
    expr = expr_of(spark, counts)
    thetas = normalize.deconvolution_factors(expr, blocked)
    factors = normalize.size_factors(thetas, normalize.block_scales(expr, thetas)).orderBy("cell_id").collect()
    got = np.array([r.size_factor for r in factors])
    assert len(got) == 220 and math.isclose(got.mean(), 1) and np.corrcoef(got, truth)[0, 1] > 0.97


def test_deconvolution_edges(spark):
    assert normalize.deconvolve(np.zeros((60, 4))).tolist() == [1.0] * 60
    with_empty = np.ones((60, 4))
    with_empty[3] = 0
    assert np.isfinite(normalize.deconvolve(with_empty)).all()
    assert np.isfinite(normalize.deconvolve(np.full((60, 2), 0.01))).all()


def test_equal_frequency_bins(spark):
    n = 13_897
    moments = spark.createDataFrame([(i, float(i + 1), float(i % 7 + 1)) for i in range(n)], "gene_id int, mean double, variance double")
    sizes = [r["count"] for r in features.dispersions(moments).groupBy("bin").count().collect()]
    assert len(sizes) == 20 and set(sizes) <= {694, 695}


def test_undefined_dispersions_come_last(spark):
    moments = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 2.0), (3, 2.0, 2.0)], "gene_id int, mean double, variance double")
    assert [r.gene_id for r in features.top_genes(features.dispersions(moments, 1), 4).collect()] == [2, 3, 0, 1]


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(4)
    dense = rng.poisson(1.0, (150, 12)) * rng.uniform(0.5, 3, 12)
    rows = matrix.packed(expr_of(spark, dense))
    genes = spark.createDataFrame([(i,) for i in range(12)], "gene_id int")
    c = pca.fit(rows.repartition(4), genes, 5)
    centred = dense - dense.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(c.eigenvalues, (s**2 / 149)[:5]) and math.isclose(c.total, (s**2).sum() / 149)
    assert np.allclose(np.abs(c.loadings), np.abs(vt[:5].T), atol=1e-8)
    scores = pca.project(rows, c)
    got = np.array([r.pc for r in scores.orderBy("cell_id").collect()])
    assert np.allclose(got, centred[[r.cell_id for r in scores.orderBy("cell_id").select("cell_id").collect()]] @ c.loadings)
    turned = pca.reordered(scores, c.eigenvalues[::-1])
    assert np.allclose([r.pc for r in turned.orderBy("cell_id").collect()], got[:, ::-1])
    bad = spark.createDataFrame([(0, 0, float("nan")), (1, 0, 1.0)], EXPR)
    with pytest.raises(ValueError, match="NaN"):
        pca.fit(matrix.packed(bad), genes, 2)


def test_silhouette_golden(spark):
    x = [[0.0], [1.0], [2.0], [10.0], [11.0], [50.0]]
    labels = spark.createDataFrame(list(enumerate([0, 0, 0, 1, 1, 2])), "cell_id long, cluster int")
    rows = rows_of(spark, x)
    mean = lambda df: df.agg(F.avg("s")).first()[0]
    assert math.isclose(mean(metrics.silhouettes_squared(rows, labels)), 0.984944, abs_tol=1e-6)
    assert math.isclose(mean(metrics.silhouettes_euclidean(rows, labels)), 0.727383, abs_tol=1e-6)
    assert mean(metrics.silhouettes_squared(rows, labels.withColumn("cluster", F.lit(0)))) == 0.0


def test_minibatch_golden():
    model = kmeans.MiniBatch.start(np.array([[0.0], [20.0]]))
    for batch in ([1.0, 2.0, 30.0], [3.0, 40.0]):
        x = np.array(batch)[:, None]
        own, _ = kmeans.nearest(x, model.centroids)
        sums = np.zeros((2, 1))
        np.add.at(sums, own, x)
        model.update(sums, np.bincount(own, minlength=2), 0.5)
    assert model.centroids.ravel().tolist() == [2.0, 35.0]


def test_kmeans_finds_blobs_and_keeps_empty_clusters(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.1, (60, 2)) for m in ((0, 0), (5, 5), (0, 9))])
    rows = rows_of(spark, x)
    fits = kmeans.sweep(rows, [1, 3], 2, max_iter=20)
    assert fits[3].wcss < 6 < fits[1].wcss and fits[3].n == 180
    far = kmeans.lloyd(rows, {0: np.array([[0.0, 0.0], [1e6, 1e6]])}, 5, 1e-4)[0]
    assert far.centroids[1].tolist() == [1e6, 1e6]
    centres, _ = kmeans.fit_minibatch(rows, 3, 1000, 40)
    assert centres.shape == (3, 2)
    curve = spark.createDataFrame([(k, f.wcss / f.n) for k, f in kmeans.sweep(rows, [2, 3, 4, 5], 2, max_iter=20).items()], "k int, wcss double")
    assert metrics.elbow(curve).first().k == 3


def test_sweep_takes_a_job_a_pass_on_all_cores(spark):
    """A table in one partition is dealt out, and a pass is one job: 3 seeds, 4 steps, and some to deal the rows."""
    rows = rows_of(spark, np.random.default_rng(8).normal(size=(3000, 4))).coalesce(1)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one-sweep", "")
    fits = kmeans.sweep(rows, [2, 3], 2, max_iter=4, tol=0)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {f.n_iters for f in fits.values()} == {4}
    jobs = sorted(tracker.getJobIdsForGroup("one-sweep"))
    assert len(jobs) <= 3 + 4 + 6
    assert all(max(tracker.getStageInfo(s).numTasks for s in tracker.getJobInfo(j).stageIds) == 2 for j in jobs[-7:])


@pytest.mark.parametrize("few", [True, False])
def test_tables_are_sums_by_cluster(spark, few):
    x = np.random.default_rng(9).normal(size=(500, 3))
    sets = {7: x[:3], 2: np.array([[0.0, 0, 0], [9e9, 0, 0]])}
    got = kmeans.tables(rows_of(spark, x).repartition(3), sets, few)
    for key, centroids in sets.items():
        own, distance = kmeans.nearest(x, centroids)
        for c in range(len(centroids)):
            part = x[own == c]
            assert np.allclose(got[key][c], [len(part), distance[own == c].sum(), (part**2).sum(), *part.sum(axis=0)])


def test_mean_silhouettes_are_those_of_each_set(spark):
    x = np.concatenate([np.random.default_rng(10).normal(m, 1, (40, 2)) for m in (0, 3)] + [[[50.0, 50.0]]])
    rows = rows_of(spark, x).repartition(3)
    sets = {1: x[:1], 2: x[[0, 40]], 3: x[[0, 40, 80]], 4: np.array([x[0], x[40], [-1e6, 0], [50, 50]])}
    got = metrics.mean_silhouettes(rows, sets)
    for key, centroids in sets.items():
        want = metrics.silhouettes_squared(rows, kmeans.assign(rows, centroids)).agg(F.avg("s")).first()[0]
        assert math.isclose(got[key], want, abs_tol=1e-9)


def test_lloyd_never_worsens(spark):
    rows = domain.vectors(spark, "/root/testdata/sf0.001")
    seeds = kmeans.lowest_ids(rows, 4)
    costs = [kmeans.lloyd(rows, {0: seeds}, i, 0)[0].wcss for i in (1, 2, 4)]
    assert costs == sorted(costs, reverse=True)


def test_validator_verdicts(spark):
    genes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "gene_id int, gene_name string")
    expr = spark.createDataFrame([(0, 0, float("nan")), (0, 1, float("inf")), (1, 1, -1.0), (1, 0, 0.5)], EXPR)
    got = {r.check: r.status for r in describe.stage_report("raw", describe.quality_counts(expr, cells_of(spark, 3), genes), True).collect()}
    assert got == {"nan_inf": "FALHA", "negative": "FALHA", "integer": "AVISO", "density": "OK", "zero_cells": "AVISO", "zero_genes": "AVISO"}
    scores = rows_of(spark, [[3.0, 0.1], [-3.0, -0.1]])
    assert {r.check: r.status for r in describe.pca_report("pca", scores, 2).collect()} == {"nan_inf": "OK", "n_components": "OK", "decreasing_variance": "OK", "centred": "OK"}
    with pytest.raises(RuntimeError):
        describe.raise_on_failure(describe.stage_report("raw", describe.quality_counts(expr, cells_of(spark, 3), genes), True))


@pytest.mark.parametrize(("lost", "status"), [(0, "OK"), (1, "AVISO"), (5, "FALHA")])
def test_losses_between_stages(spark, lost, status):
    cells, genes = cells_of(spark, 200), spark.createDataFrame([(0, "a")], "gene_id int, gene_name string")
    normal = cells.filter(F.col("cell_id") >= lost)
    report = describe.consistency_report(cells, cells, cells, normal, normal, genes, genes, genes)
    assert {r.check: r.status for r in report.collect()}["kept_to_normal"] == status


def test_online_kmeans(spark, tmp_path):
    from gridloom.streaming.online_kmeans import OnlineKMeans

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(m, 0.1, (100, 2)) for m in (0, 5)])
    rows = rows_of(spark, x)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    model = OnlineKMeans(np.array([[1.0, 1.0], [4.0, 4.0]]))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    model.start(stream, str(tmp_path / "state")).awaitTermination()
    assert np.abs(model.model.centroids - [[0, 0], [5, 5]]).max() < 0.1 and model.model.counts.sum() == 200
    before = model.model.centroids
    model.update(rows, 0)
    assert (model.model.centroids == before).all()


def test_hvg_refuses_bad_values(spark):
    genes = spark.createDataFrame([(1,), (2,)], "gene_id int")
    cells = spark.createDataFrame([(3,)], "n long")
    for bad in (float("nan"), float("inf"), 1e6):
        expr = spark.createDataFrame([(1, 1, 0.5), (2, 2, bad)], "cell_id long, gene_id int, value double")
        with pytest.raises(Exception, match="NaN or infinite"):
            features.gene_moments(expr, genes, cells).collect()


def test_pools_in_parts(spark, monkeypatch):
    """Memory follows POOL_CELLS: some starts at a time give the same factors."""
    rng = np.random.default_rng(4)
    counts = rng.poisson(rng.uniform(0.2, 6, (1, 40)) * rng.uniform(0.5, 2, (150, 1)))
    whole = normalize.deconvolve(counts.astype(float))
    monkeypatch.setattr(normalize, "POOL_CELLS", 40 * 108)
    assert np.allclose(normalize.deconvolve(counts.astype(float)), whole)


def test_patience_and_evaluations(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(10 * (i % 3), 0.1, 2)]) for i in range(300)], "cell_id long, pc array<double>")
    steps = [kmeans.fit_minibatch(rows, 3, 1000, 60, tol=0.5, eval_every=e, patience=p)[1] for e, p in ((1, 1), (4, 1), (4, 3))]
    assert steps == [1, 4, 12]
    centres, _ = kmeans.fit_minibatch(rows, 3, 60, 30, tol=0.0)
    assert sorted(round(c[0] / 10) for c in centres) == [0, 1, 2]
