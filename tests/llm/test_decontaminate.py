import itertools
import random

import pytest

from gridloom.llm.decontaminate import AGREE, SHORTEST, SPAN, STRETCH, contaminated, decontaminate, longest_stretch


def brute(docs, items):
    found = set()
    for d, text in docs:
        w = (text or "").lower().split()
        for i, item in items:
            v = (item or "").lower().split()
            if len(v) < SHORTEST:
                continue
            for shift in range(-len(v) + 1, len(w)):
                pairs = [(k, w[k + shift] == v[k]) for k in range(len(v)) if 0 <= k + shift < len(w)]
                same = [s for _, s in pairs]
                if len(v) < SPAN:
                    if len(same) == len(v) and all(same):
                        found.add((d, i))
                    continue
                best = max((b - a for a in range(len(same)) for b in range(a + 1, len(same) + 1) if same[a] and same[b - 1] and 100 * sum(same[a:b]) >= AGREE * (b - a)), default=0)
                if best >= min(STRETCH, len(v)):
                    found.add((d, i))
    return found


def tables():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([40, 30, 16, 12, 8, 5, 4, 1])] + [(20, None), (21, "")]
    docs = [(1000, None), (1001, ""), (1002, "one"), (None, items[0][1])]
    for d in range(70):
        w = rng.choices(vocabulary, k=rng.randrange(0, 50))
        v = rng.choice(items[:8])[1].split()
        a = rng.randrange(0, max(1, len(v) // 2))
        v = v[a:] if d % 2 else v
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            v[rng.randrange(len(v))] = "other"
        at = rng.randrange(len(w) + 1)
        docs.append((d, "\n".join(w[:at] + [x.upper() for x in v] + w[at:])))
    return docs, items


@pytest.mark.parametrize("max_words", [500_000, 60])
def test_matches_brute_force(spark, max_words):
    docs, items = tables()
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = contaminated(d, b, max_words=max_words).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    kept = decontaminate(d, b, max_words=max_words)
    assert kept.columns == d.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(i) for i, _ in docs if i not in {x for x, _ in want})


def test_short_overlaps_and_substitutions(spark):
    item = " ".join(f"i{k}" for k in range(30))
    w = item.split()
    swapped = " ".join("x" if k % 7 == 3 else x for k, x in enumerate(w))
    docs = spark.createDataFrame([(1, "a b " + item + " c"), (2, "a " + swapped), (3, " ".join(w[:10])), (4, " ".join(w[5:18])), (4, " ".join(w[5:18])), (5, "z " * 50_000 + item)], "doc_id long, text string")
    got = contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted((r.doc_id, r.doc_start, r.n_words, r.n_same) for r in got.collect()) == [(1, 2, 30, 30), (2, 1, 30, 26), (4, 0, 13, 13), (4, 0, 13, 13), (5, 50_000, 30, 30)]


def test_longest_stretch():
    rng = random.Random(0)
    for _ in range(300):
        import numpy as np

        same = np.array([rng.random() < 0.7 for _ in range(rng.randrange(1, 20))])
        a, b = longest_stretch(same)
        best = max((y - x for x in range(len(same)) for y in range(x + 1, len(same) + 1) if same[x] and same[y - 1] and 100 * same[x:y].sum() >= 80 * (y - x)), default=0)
        assert b - a == best


def test_empty(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a " * 40)], "item_id long, text string")
    assert contaminated(none, some).collect() == []
    docs = spark.createDataFrame([(1, "a " * 40)], "doc_id long, text string")
    assert contaminated(docs, some.limit(0)).collect() == [] and decontaminate(docs, some.limit(0)).count() == 1


def test_every_placement_of_substitutions(spark):
    """Edited passages alone in their text, wherever the edits fall, against a rule that knows no masks."""
    rng = random.Random(1)
    item = [f"i{k}" for k in range(40)]
    patterns = [[k not in gone for k in range(n)] for n, m in ((13, 2), (14, 2), (15, 3)) for gone in itertools.combinations(range(1, n - 1), m)]
    for n, m in ((16, 3), (20, 4), (25, 5), (30, 6), (40, 8), (13, 3), (16, 4), (25, 6)):
        for _ in range(60):
            gone = set(rng.sample(range(n), m))
            patterns.append([k not in gone for k in range(n)])
    docs, want = [], set()
    for d, same in enumerate(patterns):
        a = rng.randrange(len(item) - len(same) + 1)
        docs.append((d, " ".join(["before"] * (d % 3) + [item[a + k] if s else f"x{k}" for k, s in enumerate(same)] + ["after"] * (d % 2))))
        if any(same[x] and same[y - 1] and 100 * sum(same[x:y]) >= AGREE * (y - x) for x in range(len(same)) for y in range(x + STRETCH, len(same) + 1)):
            want.add(d)
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert len(want) > 400 and len(want) < len(docs)
    assert {r.doc_id for r in got} == want and len(got) == len(want)


def test_stretch_of_an_item_of_twelve(spark):
    item = [f"i{k}" for k in range(12)]
    docs = [(10 * a + b, " ".join("x" if k in (a, b) else w for k, w in enumerate(item))) for a in range(1, 11) for b in range(a, 11)]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == sorted(d for d, _ in docs)


def test_repeated_words_take_bounded_time():
    import time

    import pyarrow as pa

    from gridloom.llm.decontaminate import _index, _matches

    start = time.time()
    items = _index(pa.array([1, None, 3]), pa.array(["a " * 200, "a b " * 100, "a b c " * 50 + "d"]))
    texts = ["a " * 100_000, "b a " * 50_000, "c a b " * 30_000, "a b c " * 50 + "d"]
    got = _matches(pa.RecordBatch.from_pydict({"text": texts}), items, STRETCH, AGREE)
    assert time.time() - start < 20
    assert {(t, i): (doc, item, n, same) for t, i, doc, item, n, same in got} == {(0, 0): (0, 0, 200, 200), (1, 1): (1, 0, 200, 200), (2, 2): (1, 0, 150, 150), (3, 2): (0, 0, 151, 151)}


def test_repeated_words_match_brute_force(spark):
    rng = random.Random(8)
    items = [(1, "a " * 30), (2, "a b " * 12), (None, "a b a c " * 5), (-1, "a a a b " * 9), (5, "a b a a a b a c")]
    docs = [(d, " ".join(rng.choices("aaaabbc", k=rng.randrange(0, 70)) if d % 2 else rng.choice(["a ", "a b ", "a b a c ", "a a a b "]).split() * rng.randrange(1, 25))) for d in range(60)]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame([*items, items[0]], "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
