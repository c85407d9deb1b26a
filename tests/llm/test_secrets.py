import math
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from gridloom.llm.secrets import ALLOW, ASSIGN, CANDIDATE, CLASSES, WINDOW, best_entropy, scan

ORDER = ("assign", "access", "hex", "entropy")


def entropy(s):
    return max(-sum(c / WINDOW * math.log2(c / WINDOW) for c in Counter(s[k : k + WINDOW]).values()) for k in range(len(s) - WINDOW + 1))


def brute(text):
    base = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.ASCII) if len(m[2]) >= 8]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    base.sort()
    more = []
    for m in re.finditer(CANDIDATE, text):
        s = m[0]
        asked = next(bits for _, p, bits in CLASSES if re.search(p, s))
        if re.search("[A-Za-z]", s) and not any(re.search(p, s, re.ASCII) for p in ALLOW) and entropy(s) >= asked - 1e-9 and not any(a <= m.start() and b >= m.end() for a, _, b in base):
            more.append((m.start(), 3, m.end()))
    name = lambda spans: ",".join(f"{ORDER[k]}:{a}:{b}" for a, k, b in spans)
    return tuple(sum(k == x for _, k, _ in base) for x in range(3)), name(base), name(sorted(base + more))


def texts():
    rng = random.Random(3)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n, c=chars: "".join(rng.choices(c, k=n))
    pieces = ["é🎉 ", "word ", "Password: ", "passwd=", 'api_key="', "APIKEY = '", "token:", "token==", 'password="secret:', "secret : ", "AKIA", "AKIAAKIA", "deadbeef", "ſecret=abcdefgh", "Token\n=abcdefgh1", "example", "x" * 40, "\n", "12345678-1234-1234-1234-123456789abc "]
    out = [None, "", "tokenabcdefgh", 'password="secret:abcdefghij', "AKIA" + "A" * 11, "AKIA" + "A" * 12, "f" * 31, "f" * 32, "é" * 50 + key(32, "0123456789abcdef"), "sha256-" + key(40), key(20), key(64) + "==", "x" * 100_000, ("k" * 30 + "1 ") * 300]
    for _ in range(150):
        out.append("".join(rng.choice([rng.choice(pieces), key(rng.randrange(1, 45)), key(rng.randrange(6, 36), "0123456789abcdef"), key(rng.randrange(4, 20), "ABCDEF012")]) for _ in range(rng.randrange(1, 14))))
    return out


def test_matches_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, "token=abcdefghi"), (3, "again"), (3, "again")]
    table = spark.createDataFrame([(i, t, "b", "h") for i, t in rows], "doc_id long, text string, base string, hex string").repartition(3)
    got = sorted(((r.doc_id, (r.n_assign, r.n_access, r.n_hex), r.base, r.spans) for r in scan(table).collect()), key=str)
    assert got == sorted(((i, *brute(t or "")) for i, t in rows), key=str)
    assert sum("entropy" in r[3] for r in got) > 20


def test_entropy_is_incremental_and_exact(spark):
    rng = random.Random(9)
    strings = ["".join(rng.choices("abcdE0123", k=rng.randrange(WINDOW, 80))) for _ in range(60)] + ["a" * 20, "ab" * 400]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in strings], "s string").coalesce(1).select(best_entropy(F.col("s"))).collect()]
    assert max(abs(a - entropy(s)) for a, s in zip(got, strings, strict=True)) < 1e-9


def test_many_matches_in_one_text(spark):
    """Scans in blocks: spans and what base spans hold, for a text of many more matches than a block."""
    rng = random.Random(5)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: rng.choice(["token=", "", "", "AKIA"]) + "".join(rng.choices(chars, k=rng.choice([7, 24, 33])))
    text = " ".join(word() for _ in range(9000))
    (row,) = scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert ((row.n_assign, row.n_access, row.n_hex), row.base, row.spans) == brute(text)
    start = time.time()
    (row,) = scan(spark.createDataFrame([(1, "token=abcdefgh1 " * 100_000)], "doc_id long, text string")).collect()
    assert row.n_assign == 100_000 and row.spans.endswith("assign:1599984:1599999") and time.time() - start < 60


def test_empty(spark):
    assert scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
