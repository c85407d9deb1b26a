import random
import re

import pytest

from gridloom.llm.jaccard_join import LIST_PAIRS, _across, jaccard_components
from gridloom.llm.scratch import saved

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, width, percent):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(AZ))
        sets.append((i, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            both = len(a & b)
            if a and b and i is not None and j is not None and 100 * both >= percent * (len(a) + len(b) - both):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(4000)]
    rows = [(None, None), (None, "a b c d e f"), (900, None), (901, " \n"), (902, "x"), (903, "X"), (904, "a b c d e f"), (905, "a a a a a a"), (906, "a a a a a a a a"), (907, "É a b c d"), (908, "é a b c d")]
    n = 0
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([6, 30, 120, 400]))
        for _ in range(rng.choice([1, 2, 8, 30])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [own[k], rng.choice(vocabulary)]])
            rows.append((n, " ".join(own)))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "percent", "over", "list_pairs"), [(4, 85, 64, 1 << 14), (5, 80, 1, 3), (4, 85, 0, 0)])
def test_matches_brute_force(spark, monkeypatch, width, percent, over, list_pairs):
    monkeypatch.setattr("gridloom.llm.jaccard_join.FREQUENT_OVER", over)
    rows = corpus(width)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, k int, n int").repartition(3)
    got, _ = jaccard_components(docs, width, percent, sketch_bits=16, list_pairs=list_pairs)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, width, percent)


def test_chain_and_repeated_rows(spark):
    words = [f"t{k}" for k in range(400)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 200])) for i in range(20)]
    rows += [rows[3], (77, rows[5][1].upper())]
    got, links = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, sketch_bits=16)
    assert {tuple(r) for r in got.collect()} == {(i, 197, 0) for i in [*range(20), 77]}
    assert got.count() == 22


def test_unlike_sets_on_hot_signatures(spark, monkeypatch):
    """Sets of frequent tokens alone: prefixes put thousands of them into each list, and nearly none are similar."""
    rng = random.Random(2)
    pool = [f"p{k}" for k in range(120)]
    rows = [(i, " ".join(rng.sample(pool, 20))) for i in range(2000)]
    rows += [(5000 + i, " ".join([*rows[i][1].split()[1:], "other"])) for i in range(0, 300, 3)]
    written = []

    def counted(df, name):
        out = saved(df, name)
        if name == "pairs":
            written.append(out.count())
        return out

    monkeypatch.setattr("gridloom.llm.jaccard_join.saved", counted)
    got, _ = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 1, 85, sketch_bits=16, list_pairs=1 << 10)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 1, 85)
    assert max(written) < 60 * len(rows)  # of 2,200,000 pairs


def test_long_lists_are_not_expanded(spark):
    postings = spark.range(20_000).selectExpr("1L as sig", "id as node", "30 as n", "30 as rem", "0L as hub", "30 as n_hub", "30 as rem_hub")
    labels = spark.createDataFrame([], "node long, label long")
    pairs, long = _across(postings, labels, 85, LIST_PAIRS)
    assert pairs.count() == 0 and long.count() == 20_000


def test_empty(spark):
    got, _ = jaccard_components(spark.createDataFrame([], "doc_id long, text string"), sketch_bits=16)
    assert got.collect() == []
