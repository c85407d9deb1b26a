import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from gridloom.llm.mixing import LEAST_SHARDS, default_weights, mix, placements, split, targets
from gridloom.llm.queries import op4_mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(0)
    rows = [(i, " \n".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(0, 60))), f"s{min(i % 11, 4)}" if i % 9 else None, "x") for i in range(900)]
    return [*rows, rows[5], rows[5], (rows[6][0], "another text here", "s1", "x"), (None, None, "s1", "x"), (5000, None, None, "x"), (5001, "", "blank", "x"), (5002, "w " * 30_000, "long", None)]


def test_targets():
    sizes = {"a": 100, "b": 10, "c": 1000, None: 5}
    assert default_weights(["b", None, "é", "a", "Z"]) == {"Z": 5, "a": 2, "b": 1, "é": 5, None: 2}
    got = targets(sizes, {"a": Fraction(5), "b": Fraction(2), "c": Fraction(1), None: Fraction(5)})
    assert got == {"a": 300, "b": 30, "c": 770, None: 15}
    assert sum(got.values()) == sum(sizes.values())


def test_split_is_exact():
    counts = np.array([100, 7, 0, 33])
    got = split(counts, 7, np.random.default_rng(1))
    assert (got.sum(axis=0) == counts).all() and got.sum(axis=1).max() - got.sum(axis=1).min() <= 2 and (got >= 0).all()


@pytest.mark.parametrize("blocks", [1, 16, 512])
def test_mixture(spark, blocks):
    rows = corpus()
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size string").repartition(5)
    got = placements(table, blocks=blocks).collect()
    assert sorted(((r.doc_id, r.text, r.source) for r in got), key=str) == sorted((r[:3] for r in rows), key=str)
    size, taken, goal = Counter(), Counter(), {}
    for r in got:
        assert r.mix_size == len(WORD.findall(r.text or "")) and len(r.mix_shards) <= 3
        size[r.source] += r.mix_size
        taken[r.source] += r.mix_size * len(r.mix_shards)
        goal[r.source] = r.mix_target
    assert all(r.mix_source_size == size[r.source] for r in got)
    want = targets(dict(size), default_weights(list(size)))
    longest = defaultdict(int)
    for r in got:
        longest[r.source] = max(longest[r.source], r.mix_size)
    for s in size:
        assert goal[s] == float(want[s])
        assert abs(taken[s] - want[s]) <= longest[s] / 2
    again = placements(table.repartition(2), blocks=blocks).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_rows(spark):
    table = spark.createDataFrame([r[:3] for r in corpus()], "doc_id long, text string, source string")
    placed = placements(table).collect()
    out = mix(table.withColumns({"mix_block": table.doc_id, "mix_plan_source": table.source})).collect()
    assert len(out) == sum(len(r.mix_shards) for r in placed)
    assert Counter(r.mix_shard for r in out) == Counter(s for r in placed for s in r.mix_shards)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert placements(none).collect() == [] and mix(none).collect() == []


def test_query_tells_shards(spark, tmp_path):
    table = spark.createDataFrame([r[:3] for r in corpus()], "doc_id long, text string, source string")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    got = op4_mixing(spark, str(tmp_path)).collect()
    assert all(r.taken == r["size"] * len(r.mix_shards) for r in got)
    assert {s for r in got for s in r.mix_shards} == set(range(LEAST_SHARDS))


@pytest.mark.parametrize("blocks", [1, 4])
def test_long_document_leaves_no_gap(spark, blocks):
    rows = [(i, "w " * 20, "ab"[i % 2]) for i in range(600)] + [(1000, "w " * 5000, "a")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    for seed in range(5):
        got = placements(table, blocks=blocks, seed=seed).filter("source = 'a'").collect()
        assert abs(sum(r.mix_size * len(r.mix_shards) for r in got) - got[0].mix_target) <= 10


@pytest.mark.parametrize("seed", range(4))
def test_no_row_is_taken_more_often_than_allowed(spark, seed):
    """A source whose target is three times its size, with many rows without words."""
    rows = [(i, "w " * (i % 7) if i % 3 else "", "small") for i in range(90)] + [(1000 + i, "w " * 100, "t") for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for blocks in (None, 3):
        got = placements(table, seed=seed, blocks=blocks).filter("source = 'small'").collect()
        assert {len(r.mix_shards) for r in got} == {3} and got[0].mix_target == 3 * got[0].mix_source_size


def test_many_sources_raise(spark, monkeypatch):
    monkeypatch.setattr("gridloom.llm.mixing.MAX_SOURCES", 3)
    table = spark.createDataFrame([(i, "a b", str(i)) for i in range(4)], "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        placements(table)
