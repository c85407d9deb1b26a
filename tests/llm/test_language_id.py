import itertools
import random
import zlib

import numpy as np
import pyarrow as pa

from gridloom.llm import kernels as K
from gridloom.llm.language_id import SWITCH, identify, label, train, viterbi, word_scores

WORDS = {
    "en": "the house is near river and water flows with great force through this other valley where they think".split(),
    "de": "das haus ist nahe dem fluss und wasser fliesst mit großer kraft durch dieses andere tal wo sie übel denken".split(),
    "ru": "дом стоит у реки и вода течет с большой силой через эту другую долину где они думают".split(),
    "uk": "будинок стоїть біля річки і вода тече з великою силою через цю іншу долину де вони думають її".split(),
}


def docs(n, seed=0):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[lang], k=rng.randrange(8, 60))), lang) for i in range(n) for lang in [rng.choice(list(WORDS))]]


def test_held_out_accuracy_and_defined_cases(spark):
    rows = docs(400)
    odd = [(9000, None, "en"), (9001, "", "en"), (9002, "12 34 -- !", "de"), (None, WORDS["en"][0] * 3, "en"), (9003, rows[0][1], None), (9003, rows[0][1], None), (9004, "x" * 300_000, None)]
    table = spark.createDataFrame([(*r, "z", 0.5) for r in rows + odd], "doc_id long, text string, lang string, lang_pred string, score double").repartition(3)
    model = train(table)
    assert model.languages == sorted(WORDS)
    got = identify(table, model).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: lang for i, _, lang in rows}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]) > 0.97
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (9000, 9001, 9002)] == ["und"] * 3
    assert all(by[i].score == 0 for i in (9000, 9001, 9002)) and by[9004].lang_pred != "und"
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_never_reach_a_prediction(spark):
    rows = docs(200, 1)
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(table)
    swapped = spark.createDataFrame([(i, t, "zz") for i, t, _ in rows], "doc_id long, text string, lang string")
    key = lambda r: r.doc_id
    assert sorted(identify(table, model).collect(), key=key) == sorted(identify(swapped, model).collect(), key=key)


def test_mixed_text_is_split_where_the_language_changes(spark):
    table = spark.createDataFrame(docs(300, 2), "doc_id long, text string, lang string")
    model = train(table)
    a, b = " ".join(WORDS["en"]), " ".join(WORDS["ru"])
    [r] = identify(spark.createDataFrame([(1, f"{a}  {b}")], "doc_id long, text string"), model).collect()
    assert [(s.start, s.end, s.lang) for s in r.spans] == [(0, len(a), "en"), (len(a) + 2, len(a) + 2 + len(b), "ru")]


def test_path_is_optimal(spark):
    rng = np.random.default_rng(0)
    for _ in range(60):
        scores = -rng.exponential(6, (3, 6))
        best = max(itertools.product(range(3), repeat=6), key=lambda p: sum(scores[c, k] for k, c in enumerate(p)) - SWITCH * sum(x != y for x, y in itertools.pairwise(p)))
        assert list(viterbi(scores)) == list(best)
    table = spark.createDataFrame(docs(300, 3), "doc_id long, text string, lang string")
    model = train(table)
    r = random.Random(5)
    texts = [" ".join(w for lang in r.choices(list(WORDS), k=r.choice([1, 1, 2, 3])) for w in r.choices(WORDS[lang], k=r.randrange(1, 12))) for _ in range(80)]
    words = K.Words(pa.array(texts))
    path, _ = label(words, model)
    scores = word_scores(words, model)
    cost = lambda s, p: s[p, np.arange(len(p))].sum() - SWITCH * (p[1:] != p[:-1]).sum()
    for i in range(len(texts)):
        a, b = words.row[i], words.row[i + 1]
        assert np.isclose(cost(scores[:, a:b], path[a:b].astype(int)), cost(scores[:, a:b], viterbi(scores[:, a:b]).astype(int)))


def test_empty(spark):
    table = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = train(table)
    assert model.languages == [] and identify(table, model).collect() == []
    [r] = identify(spark.createDataFrame([(1, "word")], "doc_id long, text string"), model).collect()
    assert (r.lang_pred, r.score) == ("und", 0.0)
