"""Secret scans in Spark SQL expressions: patterns, then sliding-window entropy over candidate strings.

Three patterns give the base spans.  Besides, runs of key-like characters with a
digit and a letter are candidates: Shannon entropy is slid over each in windows of
``WINDOW`` characters.  With c_x the count of x in a window, its entropy is log2(W) - S / W,
S the sum of c_x log2 c_x.  The counts of all characters are kept while the window
slides, packed five bits each into a few longs: a step subtracts the character that leaves and
adds the one that enters, and never looks at the rest of the window.  A candidate is a span
if its best window reaches the threshold of its character class, unless the
allow-list names it or a base span holds it.

Everything is a projection: no row moves, and no group forms.  Where matches lie is
told by splitting the text at them and summing lengths; which candidates base spans hold, by
one sweep over all spans in order with the furthest end so far.  Both are scans in two levels,
blocks and items of a block, so arrays that grow item by item stay short however many
matches a text has.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base spans.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # whole runs, so the same as all runs less those below 32
LONGEST_FAILING_ASSIGN, LONGEST_FAILING_ACCESS = 7, 15
KINDS = ("assign", "access", "hex", "entropy")

#: A candidate: a whole run of key-like characters that has a digit; at least WINDOW of them.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
# For each character class, the pattern of its strings and the bits a character that make a secret; the first class that fits counts.
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 3.0), ("alphanumeric", r"^[A-Za-z0-9]+$", 3.7), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.9))
# Strings that look random and are no secrets: placeholders, ids, digests named as such, runs of an alphabet.
ALLOW = (r"(?i)example|sample|placeholder|dummy|redacted|x{6}|0{8}", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"(?i)^sha(1|256|384|512)-", r"(?i)0123456789|abcdefghij")

#: Counts of characters are packed: so many bits a count, so many counts a long, from the character FIRST on.
BITS, PACKED, FIRST = 5, 12, ord("+")
#: Least items of a block of a scan.
BLOCK = 64

_SPAN = "struct<start:int,kind:int,end:int>"


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(items: Column, kind: str, zero: Column, step: Callable[[Column, Column], Column], join: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column]) -> Column:
    """The arrays (of type ``kind``) that ``emit`` gives for each item and the state before it, put one after the other.

    ``step`` takes a state and an item to the next state; ``join`` puts a state before that of a later block.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")
    no_states = F.slice(F.array(zero), 1, 0)

    def blocks(all_: Column) -> Column:
        size = F.size(all_)
        block = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(size))).cast("int")
        return _let(block, lambda b: F.transform(F.sequence(F.lit(0), F.floor((size - 1) / b).cast("int")), lambda k: F.slice(all_, k * b + 1, b)))

    def starts(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, zero, step))
        return F.aggregate(totals, F.struct(zero.alias("at"), no_states.alias("list")), lambda s, t: F.struct(join(s["at"], t).alias("at"), F.concat(s["list"], F.array(s["at"])).alias("list")), lambda s: s["list"])

    def inner(part: Column, start: Column) -> Column:
        return F.aggregate(part, F.struct(start.alias("at"), none.alias("list")), lambda s, x: F.struct(step(s["at"], x).alias("at"), F.concat(s["list"], emit(s["at"], x)).alias("list")), lambda s: s["list"])

    whole = lambda all_: _let(blocks(all_), lambda parts: F.flatten(F.zip_with(parts, starts(parts), inner)))
    return F.when(F.size(items) > 0, _let(items, whole)).otherwise(none)


def _placed(gaps: Column, matches: Column, kind: int) -> Column:
    """Spans of ``matches``, which lie between ``gaps``."""
    zipped = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size")))

    def span(at: Column, x: Column) -> Column:
        start = at + x["gap"]
        return F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["size"]).alias("end")))

    return _scan(zipped, _SPAN, F.lit(0), lambda at, x: at + x["gap"] + x["size"], lambda a, b: a + b, span)


def _not_held(spans: Column) -> Column:
    """Sorted ``spans`` less those of entropy that a base span holds: one that starts no later and ends no earlier."""
    entropy = KINDS.index("entropy")
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    furthest = lambda end, x: F.when(x["kind"] < entropy, F.greatest(end, x["end"])).otherwise(end)
    return _scan(spans, _SPAN, F.lit(0), furthest, lambda a, b: F.greatest(a, b), lambda end, x: F.when((x["kind"] < entropy) | (x["end"] > end), F.array(x)).otherwise(none))


def _plogp(count: Column) -> Column:
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)])
    return F.element_at(table, (count + 1).cast("int"))


def best_entropy(text: Column) -> Column:
    """The largest entropy, in bits a character, of any WINDOW consecutive characters of ``text``.

    ``text`` has WINDOW key-like characters (ASCII + to z) at least.
    """
    words = range(-(-(ord("z") - FIRST + 1) // PACKED))
    place = lambda code: F.struct(F.floor(code / PACKED).cast("int").alias("word"), (F.pmod(code, F.lit(PACKED)) * BITS).alias("shift"))

    def count(state: Column, char: Column) -> Column:
        held = F.lit(None).cast("long")
        for k in reversed(words):
            held = F.when(char["word"] == k, state[f"w{k}"]).otherwise(held)
        return F.call_function("shiftright", held, char["shift"]).bitwiseAND(F.lit((1 << BITS) - 1))

    def changed(state: Column, char: Column, by: int) -> Column:
        """The state with one more or one less of a character: its count and the sum."""
        one = F.call_function("shiftleft", F.lit(by).cast("long"), char["shift"])
        packed = [F.when(char["word"] == k, state[f"w{k}"] + one).otherwise(state[f"w{k}"]).alias(f"w{k}") for k in words]
        return _let(count(state, char), lambda n: F.struct(*packed, (state["sum"] - _plogp(n) + _plogp(n + by)).alias("sum"), state["least"].alias("least")))

    def move(state: Column, x: Column) -> Column:
        left = F.when(x["leaves"].isNull(), state).otherwise(changed(state, x["leaves"], -1))
        entered = _let(left, lambda s: changed(s, x["enters"], 1))
        least = lambda s: F.when(x["at"] >= WINDOW - 1, F.least(s["least"], s["sum"])).otherwise(s["least"])
        return _let(entered, lambda s: F.struct(*[s[f"w{k}"].alias(f"w{k}") for k in words], s["sum"].alias("sum"), least(s).alias("least")))

    def slid(chars: Column) -> Column:
        steps = F.transform(chars, lambda c, at: F.struct(c.alias("enters"), F.get(chars, at - WINDOW).alias("leaves"), at.alias("at")))
        start = F.struct(*[F.lit(0).cast("long").alias(f"w{k}") for k in words], F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("least"))
        return F.aggregate(steps, start, move, lambda s: s["least"])

    chars = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: place(F.ascii(c) - FIRST))
    return F.lit(math.log2(WINDOW)) - _let(chars, slid) / WINDOW


def _suspicious(text: Column) -> Column:
    """Whether a candidate has a letter, is not allowed, and has the entropy that its class asks for."""
    asked = F.when(text.rlike(CLASSES[0][1]), F.lit(CLASSES[0][2]))
    for _, pattern, bits in CLASSES[1:]:
        asked = asked.when(text.rlike(pattern), F.lit(bits))
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | text.rlike(pattern)
    return F.when(text.rlike("[A-Za-z]") & ~allowed, best_entropy(text) >= asked).otherwise(F.lit(False))


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Secret spans of each row's text: doc_id, n_assign, n_access, n_hex, base, spans.

    ``base`` and ``spans`` are kind:start:end joined by commas, by start, then kind as
    listed, in code points, end exclusive: of the base spans, and of all.  Null and
    empty texts have none.  A null doc_id stays null; repeated rows are scanned each;
    other columns are ignored; an empty table gives no rows.
    """
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    nothing = F.expr("cast(array() as array<string>)")
    low = F.lower(F.col("text"))
    mention = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("mention", mention)
    df = df.withColumns({
        "assign": F.when(F.col("mention"), _matches(F.col("text"), ASSIGN)).otherwise(nothing),
        "value": F.when(F.col("mention"), _matches(F.col("text"), ASSIGN, 2)).otherwise(nothing),
        "access": F.when(F.col("text").contains("AKIA"), _matches(F.col("text"), ACCESS)).otherwise(nothing),
        "hex": _matches(F.col("text"), HEX),
        "candidate": _matches(F.col("text"), CANDIDATE),
    })
    df = df.withColumn("good", F.transform("candidate", _suspicious))

    def spans(name: str, pattern: str, kind: int) -> Column:
        return F.when(F.size(name) > 0, _placed(F.split("text", pattern, -1), F.col(name), kind)).otherwise(none)

    def passing(all_: Column, passes: Column) -> Column:
        """Those of ``all_`` whose place in ``passes`` is true."""
        both = F.zip_with(all_, passes, lambda s, p: F.struct(s.alias("s"), p.alias("p")))
        return F.transform(F.filter(both, lambda x: x["p"]), lambda x: x["s"])

    some = F.exists("good", lambda g: g)
    df = df.select(
        "doc_id",
        passing(spans("assign", ASSIGN, 0), F.transform("value", lambda v: F.length(v) > LONGEST_FAILING_ASSIGN)).alias("assign"),
        passing(spans("access", ACCESS, 1), F.transform("access", lambda v: F.length(v) > LONGEST_FAILING_ACCESS)).alias("access"),
        spans("hex", HEX, 2).alias("hex"),
        F.when(some, passing(_placed(F.split("text", CANDIDATE, -1), F.col("candidate"), 3), F.col("good"))).otherwise(none).alias("entropy"),
    )
    df = df.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    df = df.withColumn("all", F.when(F.size("entropy") > 0, _not_held(F.array_sort(F.concat("base", "entropy")))).otherwise(F.col("base")))
    count = lambda name: F.size(name).cast("long").alias(f"n_{name}")
    return df.select("doc_id", count("assign"), count("access"), count("hex"), _named(F.col("base")).alias("base"), _named(F.col("all")).alias("spans"))
