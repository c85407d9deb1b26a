"""Queries without SQL, over all rows of a small fixture, against brute force."""

import math
import random
import statistics

import duckdb
import pytest

from gridloom.operators import metrics
from gridloom.plans.registry import ORACLES, QUERIES


def silhouettes(points):
    out = {}
    for i, p, c in points:
        to = {}
        for j, q, d in points:
            if j != i:
                to.setdefault(d, []).append(math.dist(p, q))
        mean = {d: sum(x) / len(x) for d, x in to.items()}
        a, b = mean.pop(c, None), min(mean.values(), default=None)
        out[i] = 0.0 if a is None or b is None or max(a, b) <= 0 else (b - a) / max(a, b)
    return out


@pytest.mark.parametrize("most", [5000, 60])
def test_silhouette_euclid(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(metrics, "SILHOUETTE_ROWS", most)
    rng = random.Random(3)
    points = [(i, [rng.random() for _ in range(3)], 9 if i == 250 else i % 4) for i in range(150, 330)]
    spark.createDataFrame(points, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.cell_id: r.s for r in QUERIES["silhouette_euclid"](spark, str(tmp_path)).collect()}
    assert len(got) == min(most, 180) and max(got) > 300
    want = silhouettes([p for p in points if p[0] in got])
    assert all(math.isclose(got[i], want[i], abs_tol=2e-6) for i in want)


def test_pool_medians_all(spark, tmp_path):
    rng = random.Random(5)
    cells = [(c, f"c{c}", "a" if c < 640 else "b") for c in range(400, 670)]
    counts = {(c, p): float(rng.randrange(1, 9)) for c, *_ in cells for p in range(9) if rng.random() < 0.6 or p == c % 9}
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    save(cells, "c_custkey long, c_name string, c_mktsegment string", "customer")
    save([(p, f"p{p}", "x") for p in range(9)], "p_partkey long, p_name string, p_brand string", "part")
    save([(c, c) for c, *_ in cells], "o_orderkey long, o_custkey long", "orders")
    save([(c, p, v) for (c, p), v in counts.items()], "l_orderkey long, l_partkey long, l_quantity double", "lineitem")
    got = QUERIES["pool_medians_all"](spark, str(tmp_path)).collect()
    want = {}
    for cluster, block, ids in (("a", 0, range(400, 600)), ("a", 1, range(600, 640)), ("b", 0, range(640, 670))):
        lib = {c: sum(counts.get((c, p), 0) for p in range(9)) for c in ids}
        mean = sum(lib.values()) / len(lib)
        z = {c: [counts.get((c, p), 0) * mean / lib[c] for p in range(9)] for c in ids}
        ref = [sum(x[p] for x in z.values()) / len(z) for p in range(9)]
        ring = sorted(ids, key=lambda c: (lib[c], c))
        for width in (1, *(w for w in range(21, 102, 5) if w <= len(ring))):
            for start in range(len(ring)):
                pool = [ring[(start + k) % len(ring)] for k in range(width)]
                want[cluster, block, start, width] = statistics.median(sum(z[c][p] for c in pool) / ref[p] for p in range(9))
    assert {(r.cluster, r.block, r.start, r.width) for r in got} == set(want) and len(got) == len(want)
    assert all(math.isclose(r.ratio, want[r.cluster, r.block, r.start, r.width], abs_tol=2e-6) for r in got)


def write_orders(spark, folder, n_cells, n_parts, lines):
    """The tables of a matrix; ``lines`` are (cell, gene, value)."""
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(str(folder / f"{name}.parquet"))
    save([(c, f"c{c}", "a") for c in range(n_cells)], "c_custkey long, c_name string, c_mktsegment string", "customer")
    save([(p, f"p{p}", "x") for p in range(n_parts)], "p_partkey long, p_name string, p_brand string", "part")
    save([(c, c) for c in range(n_cells)], "o_orderkey long, o_custkey long", "orders")
    save(lines, "l_orderkey long, l_partkey long, l_quantity double", "lineitem")


def by_sql(folder, name):
    con = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return con.execute(ORACLES[name]).fetchall()


def test_entry_bounds_of_nothing(spark, tmp_path):
    """Genes of one cell are dropped, so no entry is left: a count of 0, as SQL's."""
    write_orders(spark, tmp_path, 4, 100, [(p // 25, p, 1.0) for p in range(100)])
    got = QUERIES["qc_entry_bounds"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == by_sql(tmp_path, "qc_entry_bounds") == [(0, None)]


def test_integrity_report_of_nothing(spark, tmp_path):
    """Cells stay, but no gene does: a whole report, not an error."""
    write_orders(spark, tmp_path, 4, 100, [(p // 25, p, 1.0) for p in range(100)])
    got = QUERIES["integrity_report"](spark, str(tmp_path)).select("stage", "check", "status", "detail").collect()
    want = by_sql(tmp_path, "integrity_report")
    assert ("pipeline", "kept_is_clustered", "FALHA", "4 to 0") in want and len(want) == 25
    assert sorted(map(tuple, got)) == sorted(want)
