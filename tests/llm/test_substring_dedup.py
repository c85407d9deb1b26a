import hashlib
import random
import re
from collections import Counter

import pytest

from gridloom.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    count = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [5, 35])
def test_matches_brute_force(spark, window):
    rng = random.Random(window)
    words = ["a", "b", "é x", "日本", "d.", "Ee"]
    shared = [" ".join(rng.choices(words, k=60)) for _ in range(3)]
    rows = [(None, None), (None, "x y z"), (1, None), (1, ""), (2, " \t\n"), (3, "a " * 200), (4, "lone")]
    for i in range(60):
        own = rng.choices([f"w{n}" for n in range(5000)], k=rng.randrange(1, 120))
        if i % 3 == 0:
            own[len(own) // 2 : len(own) // 2] = rng.choice(shared).split(" ")[rng.randrange(20) :]
        rows.append((10 + i, rng.choice([" ", "\n", "  \t"]).join(own)))
    rows += [rows[9], rows[12], (500, rows[15][1]), (rows[20][0], "another text of the same id " * 30), (None, rows[21][1]), (None, rows[9][1] + " more")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, rid string, tag string").repartition(3)
    got = sorted((tuple(r) for r in substring_dedup(docs, window).collect()), key=str)
    assert got == brute(rows, window)


def test_full_sketch_loses_nothing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=80))) for i in range(40)]
    rows.append((99, rows[0][1] + " z"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in substring_dedup(docs, 35, max_cells=16).collect()), key=str)
    assert got == brute(rows, 35)


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_copies_give_their_windows_to_others(spark, parts):
    rng = random.Random(7)
    passage = rng.choices([f"p{k}" for k in range(900)], k=60)
    copied = " ".join(rng.choices("uvwxyz", k=20) + passage)
    rows = [(i, copied) for i in (9, 7, 2, 8, 1, 30)] + [(100 + i, " ".join([f"own{i}"] * 10 + passage[i : i + 40])) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).repartition(parts, "doc_id")
    assert sorted((tuple(r) for r in substring_dedup(docs).collect()), key=str) == brute(rows, 35)


def test_empty(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
