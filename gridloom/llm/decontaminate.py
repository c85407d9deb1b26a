"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some of a few consecutive words and ignore the others; the hashes
of the picked words of every position of the benchmark items and of the training
texts are joined.  Around each hit the item is laid on the text without gaps, and
the longest stretch in which enough words agree decides, so that a few
substituted words hide nothing: any stretch of STRETCH words or more (12 for an item
of 12) of which AGREE percent agree holds a hit.  Hits without so dense a
window around them are put aside before that, all at once.  Hits are counted by pair
of text and item before they are listed: where repeated words give more than a few for
each way to lay the item on the text, each way is looked at once instead.

A benchmark of up to ``max_words`` words, which is counted first, is held in memory by each
worker; the training side is then only mapped over: no row of it is moved, so no document,
item or passage is hot.  A larger one is joined as a table: a bitmap of its seeds, of bounded size, lets the
texts that may have one pass; their seeds that pass are joined with the benchmark's, and the
pairs of text and item that meet are verified, each once.  The corpus is read twice, whatever the benchmark's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import kernels as K
from gridloom.llm.scratch import near_members, saved

# The masks, 1 where a word counts.  The words that agree in a stretch of 12 words or more, 80 percent
# of them or more, lie in runs between the others; one run has four words, but for a stretch of 15 in four runs of three.
MASKS = ("1111", "1110111")
#: Items of fewer words than this carry no evidence; from here to SPAN - 1 words the whole item must occur.
SPAN = 12
SHORTEST = 5
#: A stretch of so many words (or the whole item, if shorter) of which AGREE percent agree is contamination.
STRETCH = 13
AGREE = 80
MAX_WORDS = 500_000
#: log2 of the most bits of a larger benchmark's bitmap (32 MB), and the column that holds a text's key meanwhile.
MAX_BITS, KEY = 28, "__text_key"
#: So many hits, groups of hits, and words of an item laid on a text in some ways, are looked at together.
HITS, GROUPS, CELLS = 1 << 11, 1 << 18, 1 << 20
#: A text and an item with so many hits for each way to lay one on the other are compared in all ways, without listing the hits.
HEAVY = 4

_FOUND = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_same long"
_MUL = np.uint64(0xC6A4A7935BD1E995)


@dataclass(frozen=True)
class Items:
    """Word hashes of some items one after the other, and where their seeds lie.

    Seed ``u`` has the groups ``first[u]:first[u + 1]``, one for each item that has it;
    group ``g`` is of ``item[g]`` and has the words ``places[start[g]:start[g + 1]]``.
    """

    ids: pa.Array
    row: np.ndarray
    words: np.ndarray
    seeds: np.ndarray
    first: np.ndarray
    item: np.ndarray
    start: np.ndarray
    places: np.ndarray
    short: tuple[int, ...]
    bitmap: np.ndarray


def _seeded(h: np.ndarray, mask: str) -> np.ndarray:
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, len(mask), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            total *= _MUL
            total += h[k : k + n]
    return K.mix(total)


def _index(ids: pa.Array, texts: pa.Array) -> Items:
    words = K.Words(texts, lower=True)
    h, n = words.hashes(), words.counts()
    seeds, places = [], []
    for mask in MASKS:
        found = _seeded(h, mask)
        at = np.flatnonzero((K.inside(words.row, len(mask)) & np.repeat(n >= SPAN, n))[: len(found)])
        seeds.append(found[at])
        places.append(at)
    short = tuple(sorted({int(x) for x in n if SHORTEST <= x < SPAN}))
    for length in short:
        at = words.row[:-1][n == length]
        seeds.append(_seeded(h, "1" * length)[at])
        places.append(at)
    seeds, places = np.concatenate(seeds), np.concatenate(places).astype(np.int64)
    order = np.lexsort((places, seeds))  # places of an item follow each other
    seeds, places = seeds[order], places[order]
    item = np.searchsorted(words.row, places, "right") - 1
    fresh = np.diff(seeds, prepend=seeds[:1] + np.uint64(1)) != 0
    group = fresh | (np.diff(item, prepend=-1) != 0)
    start = np.append(np.flatnonzero(group), len(seeds))
    first = np.append(np.flatnonzero(fresh[group]), len(start) - 1)
    seeds = seeds[fresh]
    bits = min(26, max(16, (512 * len(seeds)).bit_length()))
    bitmap = np.zeros(1 << bits, bool)
    bitmap[(seeds >> np.uint64(64 - bits)).astype(np.int64)] = True
    return Items(ids, words.row, h, seeds, first, item[group], start, places, short, np.packbits(bitmap, bitorder="little"))


def longest_stretch(same: np.ndarray, agree: int = AGREE) -> tuple[int, int]:
    """Bounds of the longest stretch of which ``agree`` percent are true, trimmed to true ends; the first of equals; (0, 0) if none."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 100 - agree, -agree))])
    floor = np.minimum.accumulate(total)  # the earliest start for each end is where the floor comes down to the end's total
    start = np.searchsorted(-floor, -total)
    length = np.arange(len(total)) - start
    end = int(length.argmax())
    begin = int(start[end])
    inner = np.flatnonzero(same[begin:end])
    return (begin + int(inner[0]), begin + int(inner[-1]) + 1) if len(inner) else (0, 0)


def _dense(h: np.ndarray, words: K.Words, at: np.ndarray, items: Items, place: np.ndarray, stretch: int, agree: int) -> np.ndarray:
    """Which hits lie in a window of which ``agree`` percent agree, of SPAN words or more and fewer than twice ``stretch``.

    A longer stretch that agrees as much has such a window: one half of it agrees as much.
    """
    reach = 2 * stretch - 1
    steps = np.arange(-reach, reach + 1)
    text, item = np.searchsorted(words.row, at, "right") - 1, np.searchsorted(items.row, place, "right") - 1
    low = np.maximum(words.row[text] - at, items.row[item] - place)[:, None]
    high = np.minimum(words.row[text + 1] - at, items.row[item + 1] - place)[:, None]
    laid = (steps >= low) & (steps < high)
    same = laid & (h[np.where(laid, at[:, None] + steps, 0)] == items.words[np.where(laid, place[:, None] + steps, 0)])
    total = np.zeros((len(at), len(steps) + 1), np.int32)
    np.cumsum(same, axis=1, out=total[:, 1:])
    found = np.zeros(len(at), bool)
    for length in range(min(SPAN, stretch), reach + 1):
        first = np.arange(reach - length + 1, reach + 1)  # windows that hold the hit's first word
        found |= (100 * (total[:, first + length] - total[:, first]) >= agree * length).any(axis=1)
    return found


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after the other, and the range that each is of."""
    which = np.repeat(np.arange(len(count)), count)
    return np.arange(len(which)) + np.repeat(first - np.cumsum(count) + count, count), which


def _best(own: np.ndarray, theirs: np.ndarray, shifts: np.ndarray, stretch: int, agree: int) -> tuple[int, int, int, int] | None:
    """(n_same, -doc_start, -item_start, n_words) of the best stretch of an item laid on a text at each of ``shifts``; None if there is none.

    All words that agree at a shift bound what it can give, so shifts are looked at
    from the largest bound on, until no other can be better.
    """
    n, m = len(own), len(theirs)
    least = min(stretch, m)
    total = np.empty(len(shifts), np.int64)
    step = max(1, CELLS // m)
    for a in range(0, len(shifts), step):
        at = shifts[a : a + step, None] + np.arange(m)
        laid = (at >= 0) & (at < n)
        total[a : a + step] = (laid & (own[np.where(laid, at, 0)] == theirs)).sum(axis=1)
    some = 100 * total >= (agree * least if m >= SPAN else 100 * m)
    shifts, total = shifts[some], total[some]
    best = None
    for k in np.lexsort((np.maximum(0, -shifts), np.maximum(0, shifts), -total)).tolist():
        d = int(shifts[k])
        a, b = max(0, -d), min(m, n - d)
        if best and (int(total[k]), -(d + a), -a) <= best[:3]:
            break
        same = own[d + a : d + b] == theirs[a:b]
        begin, end = longest_stretch(same, agree) if m >= SPAN else (0, m)
        if end - begin >= least:
            found = (int(same[begin:end].sum()), -(d + a + begin), -(a + begin), end - begin)
            best = max(best or found, found)
    return best


def _hits(words: K.Words, h: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Words of a slice at which a seed of the items begins, and the seed's number, in order of the words."""
    bits = (len(items.bitmap) * 8).bit_length() - 1
    at, seed = [], []
    for mask in (*MASKS, *("1" * n for n in items.short)):
        seeds = _seeded(h, mask)
        cell = (seeds >> np.uint64(64 - bits)).astype(np.int64)
        place = np.flatnonzero(items.bitmap[cell >> 3] >> (cell & 7).astype(np.uint8) & 1)
        place = place[K.inside(words.row, len(mask))[place]] if len(place) else place
        which = np.searchsorted(items.seeds, seeds[place])
        hit = which < len(items.seeds)
        hit[hit] = items.seeds[which[hit]] == seeds[place[hit]]
        at.append(place[hit])
        seed.append(which[hit])
    at, seed = np.concatenate(at), np.concatenate(seed)
    order = np.argsort(at, kind="stable")
    return at[order], seed[order]


def _matches(part: pa.RecordBatch, items: Items, stretch: int, agree: int) -> list[tuple[int, int, int, int, int, int]]:
    """(row, item, doc_start, item_start, n_words, n_same) of each contaminated row of a slice, the best one for each item."""
    words = K.Words(part.column("text"), lower=True)
    h = words.hashes()
    at, seed = _hits(words, h, items)
    text = np.searchsorted(words.row, at, "right") - 1
    found = []
    # some texts at a time, so that their hits' groups are few, or one text
    edges = np.flatnonzero(np.diff(text, prepend=-1))
    size = np.add.reduceat(items.first[seed + 1] - items.first[seed], edges) if len(edges) else np.zeros(0, np.int64)
    lot = np.cumsum(size) // GROUPS
    for one in np.split(np.arange(len(edges)), np.flatnonzero(np.diff(lot)) + 1) if len(edges) else []:
        a, b = edges[one[0]], edges[one[-1] + 1] if one[-1] + 1 < len(edges) else len(at)
        found += _lot(words, h, at[a:b], seed[a:b], text[a:b], items, stretch, agree)
    return sorted(found)


def _lot(words: K.Words, h: np.ndarray, at: np.ndarray, seed: np.ndarray, text: np.ndarray, items: Items, stretch: int, agree: int) -> list[tuple[int, int, int, int, int, int]]:
    many, n_words, n_items = len(items.row) - 1, words.counts(), np.diff(items.row)
    # how many hits each pair of text and item has, without listing them
    cell, times = np.unique(text * len(items.seeds) + seed, return_counts=True)
    of = cell % len(items.seeds)
    group, which = _ranges(items.first[of], items.first[of + 1] - items.first[of])
    pairs, back = np.unique((cell // len(items.seeds))[which] * many + items.item[group], return_inverse=True)
    hits = np.bincount(back, times[which] * (items.start[group + 1] - items.start[group]))
    heavy = hits > HEAVY * (n_words[pairs // many] + n_items[pairs % many])
    # pairs with more hits than a few for each way to lay the item on the text (repeated words) are looked at in all these ways
    ways = {int(p): np.arange(1 - n_items[p % many], n_words[p // many]) for p in pairs[heavy]}
    # of the others each hit is listed; those in no dense window go
    group, which = _ranges(items.first[seed], items.first[seed + 1] - items.first[seed])
    light = ~heavy[np.searchsorted(pairs, text[which] * many + items.item[group])]
    group, which = group[light], which[light]
    count = items.start[group + 1] - items.start[group]
    laid = []
    for one in np.split(np.arange(len(group)), np.flatnonzero(np.diff(np.cumsum(count) // HITS)) + 1):
        number, of = _ranges(items.start[group[one]], count[one])
        for a in range(0, len(number), HITS):
            place, where = items.places[number[a : a + HITS]], at[which[one][of[a : a + HITS]]]
            item = np.searchsorted(items.row, place, "right") - 1
            kept = (n_items[item] < SPAN) | _dense(h, words, where, items, place, stretch, agree)
            place, where, item = place[kept], where[kept], item[kept]
            t = np.searchsorted(words.row, where, "right") - 1
            laid.append(np.stack([t * many + item, (where - words.row[t]) - (place - items.row[item])]))
    if laid:
        pair, shift = np.unique(np.concatenate(laid, axis=1), axis=1)
        for one in np.split(np.arange(len(pair)), np.flatnonzero(np.diff(pair)) + 1) if len(pair) else []:
            ways[int(pair[one[0]])] = shift[one]
    found = []
    for p, shifts in ways.items():
        t, i = divmod(p, many)
        best = _best(h[words.row[t] : words.row[t + 1]], items.words[items.row[i] : items.row[i + 1]], shifts, stretch, agree)
        if best:
            found.append((t, i, -best[1], -best[2], best[3], best[0]))
    return found


def _find(shared, stretch: int, agree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for batch in batches:
            for part in K.slices(batch, "text"):
                found = _matches(part, items, stretch, agree)
                if found:
                    row, item, *rest = (np.array(x, np.int64) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), items.ids.take(pa.array(item)), *map(pa.array, rest)], ["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_same"])

    return run


def _keep(shared, stretch: int, agree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text"):
                clean = np.ones(part.num_rows, bool)
                clean[[r for r, *_ in _matches(part, shared.value, stretch, agree)]] = False
                yield part.filter(pa.array(clean))

    return run


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()


def _held(items: DataFrame, max_words: int) -> Items | None:
    """The benchmark's different items, if they have ``max_words`` words or fewer."""
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > 2 * max_words:  # a word and its separator have two bytes at least
        return None
    got = items.orderBy("item_id", "text").toArrow().combine_chunks()
    ids, texts = (got.column(c).chunk(0) if got.num_rows else pa.array([], t) for c, t in (("item_id", pa.int64()), ("text", pa.string())))
    return _index(ids, texts)


def _seeds_of(h: np.ndarray, row: np.ndarray, least: int, short: tuple[int, ...], whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of some texts and the words at which they begin: by the masks in texts of ``least`` words or more, and of ``short`` lengths (``whole``: of texts of that length alone)."""
    n = np.diff(row)
    seeds, at = [], []
    for mask in (*MASKS, *("1" * k for k in short)):
        found = _seeded(h, mask)
        long = len(mask) >= SHORTEST and set(mask) == {"1"}
        of = n == len(mask) if long and whole else n >= (len(mask) if long else least)
        where = np.flatnonzero((K.inside(row, len(mask)) & np.repeat(of, n))[: len(found)])
        seeds.append(found[where])
        at.append(where)
    return np.concatenate(seeds), np.concatenate(at)


def _keys(words: K.Words, h: np.ndarray) -> np.ndarray:
    """A 64-bit key of each text, the same for equal word sequences."""
    return K.signed(words.whole(h))


def _emit_seeds(bitmap, short: tuple[int, ...], item: bool):
    """(key, seed) of texts, each once in a text; of a corpus those alone that ``bitmap`` lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            for part in K.slices(batch, "text"):
                words = K.Words(part.column("text"), lower=True)
                h = words.hashes()
                seeds, at = _seeds_of(h, words.row, SPAN if item else 1, short, item)
                if bits is not None:
                    cell = (seeds >> np.uint64(64 - len(bits).bit_length() - 2)).astype(np.int64)
                    passed = (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
                    seeds, at = seeds[passed], at[passed]
                text = np.searchsorted(words.row, at, "right") - 1
                order = np.lexsort((seeds, text))
                seeds, text = seeds[order], text[order]
                fresh = (np.diff(seeds, prepend=seeds[:1] + np.uint64(1)) != 0) | (np.diff(text, prepend=-1) != 0)
                yield pa.RecordBatch.from_pydict({"key": _keys(words, h)[text[fresh]], "seed": K.signed(seeds[fresh])})

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.slices(batch, "text"):
            words = K.Words(part.column("text"), lower=True)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_keys(words, words.hashes()))], [*part.schema.names, KEY])


def _verify(stretch: int, agree: int, short: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, item, own, theirs in zip(*(batch.column(c).to_pylist() for c in ("key", "item", "text", "item_text")), strict=True):
                a, b = (K.Words(pa.array([t], pa.large_string()), lower=True) for t in (own, theirs))
                ha, hb = a.hashes(), b.hashes()
                sa, at = _seeds_of(ha, a.row, 1, short, False)
                sb, place = _seeds_of(hb, b.row, SPAN, short, True)
                order = np.argsort(sb, kind="stable")
                first, last = np.searchsorted(sb[order], sa, "left"), np.searchsorted(sb[order], sa, "right")
                if (last - first).sum() > HEAVY * (len(ha) + len(hb)):
                    shifts = np.arange(1 - len(hb), len(ha))
                else:
                    number, which = _ranges(first, last - first)
                    shifts = np.unique(at[which] - place[order[number]])
                best = _best(ha, hb, shifts, stretch, agree) if len(shifts) else None
                if best:
                    rows.append((key, item, -best[1], -best[2], best[3], best[0]))
            names = ("key", "item", "doc_start", "item_start", "n_words", "n_same")
            yield pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(names)})

    return run


def _joined(docs: DataFrame, items: DataFrame, stretch: int, agree: int) -> tuple[DataFrame, DataFrame]:
    """(key, item_id, doc_start, ...) of the texts that hold enough of an item, and (doc_id, text, key) of the rows that may."""
    spark = docs.sparkSession
    items = saved(items.withColumn("item", F.xxhash64("item_id", "text")), "items")
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    short = tuple(sorted(r.n for r in items.select(words.alias("n")).filter(f"n >= {SHORTEST} and n < {SPAN}").distinct().collect()))  # SPAN lengths at most
    seeds = items.select("text").mapInArrow(_emit_seeds(None, short, True), "key long, seed long")
    keyed_items = items.mapInArrow(_keyed, f"item_id long, text string, item long, {KEY} long").select(F.col(KEY).alias("item_key"), "item", "item_id", "text")
    seeds = saved(seeds.distinct().withColumnRenamed("key", "item_key"), "seeds")
    n = seeds.count()
    bits = min(MAX_BITS, max(16, (16 * max(1, n)).bit_length()))
    cell = F.shiftrightunsigned("seed", 64 - bits)
    masks = seeds.select(F.shiftright(cell, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - bits}) & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("mask")).toArrow()  # 2**bits / 64 rows
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[masks.column("word").to_numpy()] = masks.column("mask").to_numpy()
    shared = spark.sparkContext.broadcast(bitmap.tobytes())
    hits = saved(docs.select("text").mapInArrow(_emit_seeds(shared, short, False), "key long, seed long").distinct(), "hits")
    pairs = saved(hits.join(seeds, "seed").select("key", "item_key").distinct().join(keyed_items.select("item_key", "item"), "item_key").select("key", "item"), "pairs")
    wanted = pairs.select("key").distinct()
    may = saved(near_members(docs.mapInArrow(_keyed, f"doc_id long, text string, {KEY} long"), KEY, wanted, wanted.count()), "may")
    texts = saved(may.groupBy(F.col(KEY).alias("key")).agg(F.min("text").alias("text")), "texts")
    both = pairs.join(texts, "key").join(items.select("item", F.col("text").alias("item_text")), "item").repartition("key", "item")
    found = both.select("key", "item", "text", "item_text").mapInArrow(_verify(stretch, agree, short), "key long, item long, doc_start long, item_start long, n_words long, n_same long")
    return saved(found.join(items.select("item", "item_id"), "item").drop("item"), "found"), may


def contaminated(docs: DataFrame, benchmark: DataFrame, stretch: int = STRETCH, agree: int = AGREE, max_words: int = MAX_WORDS) -> DataFrame:
    """One row for each document and benchmark item that it holds enough of.

    (doc_id, item_id, doc_start, item_start, n_words, n_same): where the best
    stretch begins, in words, its length, and how many of its words agree (most
    agreeing words; the earliest on a tie).  Words are split at white space, A-Z lower-cased.
    Null, empty and short texts match nothing; null ids stay null; repeated rows of
    ``docs`` are reported each, repeated items (id and text) count once; an empty table on either
    side gives no rows.  Texts and items of repeated words take time in proportion
    to the ways to lay one on the other times the item's length, and bounded memory.
    """
    source, items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _items(benchmark)
    held = _held(items, max_words)
    if held is not None:
        return source.mapInArrow(K.freeing(_find(docs.sparkSession.sparkContext.broadcast(held), stretch, agree)), _FOUND)
    found, may = _joined(source, items, stretch, agree)
    return may.select("doc_id", F.col(KEY).alias("key")).join(found, "key").select("doc_id", "item_id", "doc_start", "item_start", "n_words", "n_same")


def decontaminate(docs: DataFrame, benchmark: DataFrame, stretch: int = STRETCH, agree: int = AGREE, max_words: int = MAX_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, that ``contaminated`` doesn't report."""
    items = _items(benchmark)
    held = _held(items, max_words)
    if held is not None:
        return docs.mapInArrow(K.freeing(_keep(docs.sparkSession.sparkContext.broadcast(held), stretch, agree)), docs.schema)
    found, _ = _joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, stretch, agree)
    bad = saved(found.select(F.col("key").alias(KEY)).distinct(), "bad")
    keyed = docs.mapInArrow(_keyed, T.StructType([*docs.schema.fields, T.StructField(KEY, T.LongType())]))
    # rows that the bitmap of contaminated texts doesn't let pass aren't moved
    count = bad.count()
    maybe = near_members(keyed, KEY, bad, count).join(bad, KEY, "left_anti")
    return near_members(keyed, KEY, bad, count, others=True).unionByName(maybe).select(*docs.columns)
