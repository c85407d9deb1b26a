import itertools
import random
from collections import Counter

import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from gridloom.llm import kernels  # noqa: E402
from gridloom.llm.mixing import placements  # noqa: E402
from gridloom.llm.scratch import local_table, saved  # noqa: E402
from gridloom.llm.sharding import shard  # noqa: E402

WORDS = {"en": "the house is near river and water flows with great force through other valley where they think of it".split(), "de": "das haus ist nahe dem fluss wasser fliesst mit großer kraft durch andere tal wo sie denken daran".split()}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(0)
    rows = []
    for i in range(240):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randrange(30, 90))), lang, f"s{i % 4}" if i % 10 else None))
    item = " ".join(rng.choices(WORDS["en"], k=30))
    extra = [(1000, rows[3][1], "en", "s1"), (1001, rows[4][1] + " indeed", "en", "s1"), (1002, rows[5][1][:40] + f" {item} " + rows[6][1], "en", "s0"), (1003, "123 456", "en", "s2"), (1004, None, "de", "s2"), (1005, "", None, None), (7, rows[7][1], "en", "s3"), (None, rows[8][1] + " null id here", "en", "s3"), (None, None, None, None)]
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(*r, 0, i) for i, r in enumerate(rows + extra)], "doc_id long, text string, lang string, source string, n_chars long, shard int")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def test_stages(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = saved(stage(spark, docs, folder), name)
        out[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    ids = {name: Counter(r.doc_id for r in df.select("doc_id").collect()) for name, df in out.items()}
    clean = {i for i, *_ in rows}
    assert clean <= set(ids["language_id"]) and not {1003, 1004, 1005} & set(ids["language_id"])
    assert set(ids["ngram_jaccard_join"]) == set(ids["language_id"]) - {1000, 1001} and ids["ngram_jaccard_join"][7] == 1
    assert set(ids["benchmark_decontamination"]) == set(ids["ngram_jaccard_join"]) - {1002}
    taken = Counter()
    for r in placements(out["benchmark_decontamination"]).collect():
        taken[r.doc_id] += len(r.mix_shards)
    assert ids["mixing"] == +taken
    assert ids["sharding"] == ids["mixing"]


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables[0])
    assert out.count() > 100 and {"doc_id", "text", "lang", "source", "n_chars"} <= set(out.columns)


def test_empty(spark, tables, tmp_path):
    spark.read.parquet(f"{tables[0]}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{tables[0]}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_mixture_is_shuffled(spark):
    """Sources that lie together in the input, and copies of a document, are apart in the mixture's files."""
    rows = [(1000 * s + i, "w " * 20 + f"{s} {i}", f"s{s}") for s in range(3) for i in range(1500)]
    docs = saved(spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1), "sorted")
    out = saved(corpus_pipeline.mixing(spark, docs, ""), "mixed").collect()
    share = Counter(r.source for r in out)
    for k in range(0, len(out) - 499, 500):
        part = Counter(r.source for r in out[k : k + 500])
        assert all(abs(part[s] / 500 - share[s] / len(out)) < 0.1 for s in share)
    near = sum(a.doc_id == b.doc_id for a, b in itertools.pairwise(out))
    assert max(Counter(r.doc_id for r in out).values()) > 1 and near < 20


def test_batches_of_workers(spark, monkeypatch):
    """A batch that goes to a worker is bounded in bytes and holds the texts once."""
    text = "the house is near " * 6000
    docs = saved(spark.createDataFrame([(i, text, "en", "s", 0) for i in range(80)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1), "large")

    def measured(*_):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"doc_id": [0], "held_out": [False], "lang_pred": ["en"], "score": [1.0], "spans": pa.array([[]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))), "kept_doc_id": [0], "kept_text": [""], "kept_lang": ["en"], "kept_source": ["s"], "kept_n_chars": [b.nbytes]})

        return run

    monkeypatch.setattr("gridloom.llm.language_id._predict", measured)
    sizes = [r.n_chars for r in corpus_pipeline.language_id(spark, docs, "").collect()]
    assert max(sizes) < 3 << 20 and sum(sizes) < 1.1 * 80 * len(text)


def test_workers_give_memory_back(monkeypatch):
    freed = []
    monkeypatch.setattr(kernels, "release", lambda: freed.append(1))
    batches = kernels.freeing(lambda given: (x + 1 for x in given))(iter([1, 2]))
    assert next(batches) == 2 and not freed
    assert list(batches) == [3] and freed == [1]


def test_plans_of_the_driver_need_no_worker(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    for df in (corpus_pipeline.mixing(spark, docs, ""), shard(docs).located("doc_id")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "LocalRelation" in plan and "RDD" not in plan
    assert local_table(spark, [(None, [1], (2, 3)), ("a", [], None)], "a string, b array<int>, c struct<x:int,y:bigint>").collect() == [(None, [1], (2, 3)), ("a", [], None)]
    assert local_table(spark, [], "a string, b int").collect() == []
