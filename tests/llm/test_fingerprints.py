import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import fingerprints
from gridloom.llm.fingerprints import compare_neighbours, fingerprint, unpacked
from gridloom.llm.queries import op3_document_fingerprints
from gridloom.llm.scratch import BATCH_BYTES, READ_ROWS


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a or b else 1.0


@pytest.mark.parametrize("range_bytes", [100, 3000, 1 << 22])
def test_matches_brute_force(spark, range_bytes):
    rng = random.Random(1)
    vocabulary = [f"wé{k}" for k in range(3000)]
    rows = [(i * 7, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 4, 5, 7, 40, 900])))) for i in range(60)]
    rows += [(2000, rows[9][1]), (2001, rows[9][1]), (2001, rows[9][1]), (2001, "another one"), (2002, None), (None, "null id"), (None, None), (-5, "日本 🎉 x y")]
    table = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, range int, key string").repartition(4)
    got = compare_neighbours(table, range_bytes).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t)
        edited = t[: n - n // 4] + after[: n // 4]
        want.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), jaccard(t, edited), jaccard(t, after)))
    key = lambda r: (str(r[0]), r[2])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted((w[:3] for w in want), key=key)
    want = sorted(want, key=lambda w: (str(w[0]), w[2], w[4]))
    error = [(r.near_edited - w[3], r.near_next - w[4]) for r, w in zip(sorted(got, key=lambda r: (str(r.doc_id), r.edited_sha256, r.near_next)), want, strict=True)]
    assert np.abs(error).max() < 0.16 and np.abs(np.mean(error)) < 0.02
    by = {(r.doc_id, r.n_chars): r.fingerprint for r in got}
    assert by[2000, len(rows[9][1])] == by[2001, len(rows[9][1])]
    assert by[2002, 0] == ""
    plain = {(r.doc_id, r.fingerprint) for r in fingerprint(table).collect()}
    assert plain == {(r.doc_id, r.fingerprint) for r in got}


def test_estimates_are_unbiased(spark):
    rng = random.Random(2)
    rows, truth = [], []
    for i in range(150):
        w = [str(rng.random()) for _ in range(300)]
        v = w[: 300 - 2 * (i % 100)] + [str(rng.random()) for _ in range(2 * (i % 100))]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        truth.append(jaccard(*(r[1] for r in rows[-2:])))
    got = {r.doc_id: unpacked(r.fingerprint) for r in fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    c = np.array([(got[2 * i] == got[2 * i + 1]).mean() for i in range(150)])
    error = (c - 1 / 16) / (15 / 16) - truth
    assert abs(error.mean()) < 0.006 and error.std() < 0.04


def test_sole_and_none(spark):
    [r] = compare_neighbours(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1
    assert compare_neighbours(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_memory_of_a_worker_is_bounded():
    """By bytes and rows: many short texts are sketched some at a time, as are the random sequences made."""
    n = 10_000
    batch = pa.RecordBatch.from_pydict({"range": [0] * n, "copied": [False] * (n - 1) + [True], "doc_id": list(range(n)), "text": [f"a b c d e f {k}" for k in range(n)]})
    fingerprints._sequences.cache_clear()
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in fingerprints._compare(iter([batch])))
        assert rows == n - 1 and tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()


def test_batches_and_reads_of_the_query_are_bounded(spark, tmp_path, monkeypatch):
    def measured(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": [b.num_rows], "n_chars": [b.nbytes], "edited_sha256": [""], "fingerprint": [""], "edited_fingerprint": [""], "near_edited": [0.0], "near_next": [0.0]})

    names = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "spark.sql.parquet.columnarReaderBatchSize": str(READ_ROWS)}
    text = "the house is near " * 6000
    spark.createDataFrame([(i, text, len(text)) for i in range(80)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(fingerprints, "_compare", measured)
    for name in names:
        spark.conf.unset(name)
    try:
        sizes = [r.n_chars for r in op3_document_fingerprints(spark, str(tmp_path)).collect()]
        assert max(sizes) < 3 << 20 and sum(sizes) >= 80 * len(text)
        assert {name: spark.conf.get(name) for name in names} == names
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "1000")
        op3_document_fingerprints(spark, str(tmp_path))
        assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "1000"
    finally:
        for name in names:
            spark.conf.unset(name)


@pytest.mark.parametrize("size", ["n", "0", "null", "-5", "1e300", "double('nan')", "double('inf')", "9223372036854775807"])
def test_told_sizes_leave_texts_unread_and_rows_as_they_are(spark, size):
    docs = spark.createDataFrame([(i // 2, f"w{i} " * (i % 7 * 50), i % 7 * 100) for i in range(40)] + [(None, None, None)], "doc_id long, text string, n long")
    assert sorted(compare_neighbours(docs, text_size=F.expr(size)).collect(), key=str) == sorted(compare_neighbours(docs).collect(), key=str)
    compare_neighbours(docs.withColumn("text", F.raise_error(F.lit("read")).cast("string")), text_size=F.expr(size))  # as yet, no text is read


@pytest.mark.parametrize("n_chars", [None, "absent", 0, "text"])
def test_query_with_odd_sizes(spark, tmp_path, n_chars):
    rows = [(i, f"w{i} x y z") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if n_chars != "absent":
        docs = docs.withColumn("n_chars", F.lit(n_chars).cast("string" if n_chars == "text" else "long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op3_document_fingerprints(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_chars) for r in got) == [(i, len(t)) for i, t in rows]
