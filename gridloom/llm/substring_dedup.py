"""Exact removal of word windows that repeat in a corpus, behind a count-min prefilter.

Each window of ``WINDOW`` words has an anchor: its ``GRAM``-word gram of least
hash (the leftmost one).  The anchor depends on the window's words alone, and
two places of one window have two places of its anchor, so the number of places
of the anchor, and with it a count-min estimate of that number, is never below
the number of places of the window.  The steps:

1. One pass over the texts counts the anchor places of each partition in a
   count-min sketch with counters that stop at 2; sums of these sketches (also
   stopping at 2) are merged by slices.
2. A second pass gives the anchor places estimated to repeat.  Grouping them
   exactly drops those that don't: the sketch keeps most of them from being
   shuffled while it is large enough, and where it is full this costs a shuffle of all
   anchors, about a third of the text's size.
3. The texts that have repeated anchors emit, under 128-bit hashes of their words, the
   windows of these anchors alone.  Grouping them exactly tells the
   repeated ones; none is lost, as no estimate or count is too low.
4. Covered words are removed from these texts.

Texts that occur more than once are told by a 128-bit hash first: every window
of theirs repeats, so nothing of them needs to be grouped, and one of them
emits its windows for the others' sake.  A very common window costs one row for each text that has
it; counts are summed before they are shuffled, and the join back to the places
is an ordinary sort-merge join that adaptive execution splits at hot windows.  The few keys
of the largest groups of equal texts are broadcast instead of shuffled.

Limits: the sketch has at most ``max_cells`` cells a row (64 MB of counters in
a worker).  A smaller or full sketch never changes the result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import kernels as K
from gridloom.llm.scratch import join_counted, near_members, saved

WINDOW = 35
GRAM = 8
SKETCH_ROWS = 2
#: Cells of a slice of the sketch, the unit in which sketches are merged.
SLICE = 1 << 20
MAX_CELLS = 1 << 25

_PLACES = "kind int, rid long, tag int, doc_id long, k1 long, k2 long, n int, sha binary, slice int, cells binary"
_ANCHORS = "gram long, rid long, place long"
_WINDOWS = "w1 long, w2 long, rid long, place long"


def _cells(grams: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for r in range(SKETCH_ROWS):
        yield (K.mix(grams + np.uint64(0x51_7C_C1_B7 * (r + 1))) >> np.uint64(64 - bits)).astype(np.int64)


def _anchors(words: K.Words, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows start, the place of each one's anchor, and the gram hashes of the slice."""
    gram = min(GRAM, window)
    grams = words.windows(h, gram)
    at = K.argmin_windows(grams, window - gram + 1)
    starts = np.flatnonzero(K.inside(words.row, window)[: len(at)])
    return starts, at[starts], grams


def _keys(batch: pa.RecordBatch, words: K.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A key for each row (doc_id, or for null the text's hash), a tag of the text, and the text's 128-bit hash."""
    k1, k2 = words.whole(h), words.whole(words.hashes(1), 1)
    ids = batch.column("doc_id").cast(pa.int64())
    rid = np.where(np.asarray(ids.is_null()), K.signed(k1), np.asarray(ids.fill_null(0)))
    return rid, (k1 >> np.uint64(33)).astype(np.int32), K.signed(k1), K.signed(k2)


def _survey(bits: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(1 << bits, np.uint8) for _ in range(SKETCH_ROWS)]
        seen: set[int] = set()
        names = [f.split()[0] for f in _PLACES.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]

        def rows(n: int, /, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in zip(names, types, strict=True)], names)

        for batch in batches:
            for part in K.slices(batch, "text"):
                words = K.Words(part.column("text"))
                h = words.hashes()
                rid, tag, k1, k2 = _keys(part, words, h)
                data, at = K.joined(words)
                data = data.tobytes()
                sha = [hashlib.sha256(data[a:b]).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
                n = part.num_rows
                yield rows(n, kind=np.zeros(n, np.int32), rid=rid, tag=tag, doc_id=part.column("doc_id").cast(pa.int64()), k1=k1, k2=k2, n=words.counts().astype(np.int32), sha=sha)
                fresh = np.array([not (x in seen or seen.add(x)) for x in k1.tolist()], bool)
                starts, places, grams = _anchors(words, h, window)
                places = np.unique(places[np.repeat(fresh, words.counts())[starts]])
                for row, cells in zip(counts, _cells(grams[places], bits), strict=True):
                    cell, many = np.unique(cells, return_counts=True)
                    row[cell] = np.minimum(row[cell] + np.minimum(many, 2), 2)
        for r, row in enumerate(counts):
            for s in range(0, len(row), SLICE):
                if row[s : s + SLICE].any():
                    yield rows(1, kind=[1], slice=[(r << 16) + s // SLICE], cells=[zlib.compress(row[s : s + SLICE].tobytes(), 1)])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, cells in zip(batch.column("slice").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            cells = np.frombuffer(zlib.decompress(cells), np.uint8)
            total[s] = np.minimum(total[s] + cells, 2) if s in total else cells
    for s, cells in total.items():
        yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int32()), "cells": [np.packbits(cells > 1, bitorder="little").tobytes()]})


def _suspects(sketch, bits: int, window: int):
    """Anchor places estimated to repeat, of each text once in a partition; a place has the text's tag in its high half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, (1 << bits) // 8)
        repeated = np.frombuffer(sketch.value, np.uint8).reshape(SKETCH_ROWS, size)
        seen: set[int] = set()
        for batch in batches:
            for part in K.slices(batch, "text"):
                words = K.Words(part.column("text"))
                h = words.hashes()
                _, places, grams = _anchors(words, h, window)
                places = np.unique(places)
                text = np.searchsorted(words.row, places, "right") - 1
                rid, tag, k1, _ = _keys(part, words, h)
                hit = np.array([not (x in seen or seen.add(x)) for x in k1.tolist()], bool)[text]
                for row, cells in zip(repeated, _cells(grams[places], bits), strict=True):
                    hit &= (row[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)
                places, text = places[hit], text[hit]
                if len(places):
                    yield pa.RecordBatch.from_pydict({"gram": K.signed(grams[places]), "rid": rid[text], "place": (tag[text].astype(np.int64) << 32) | (places - words.row[text])})

    return run


def _marked(part: pa.RecordBatch, column: str, words: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Words of a slice that ``column``'s lists point at; and which rows' texts are those that their tag means."""
    same = (words.whole(words.hashes()) >> np.uint64(33)).astype(np.int64) == np.asarray(part.column("tag"))
    lists = part.column(column)
    row = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
    return (words.row[row] + np.asarray(lists.flatten()))[same[row]], same


def _emit(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text"):
                words = K.Words(part.column("text"))
                h = words.hashes()
                starts, places, _ = _anchors(words, h, window)
                marked = np.zeros(len(words) + 1, bool)
                marked[_marked(part, "anchors", words)[0]] = True
                starts = starts[marked[places]]
                if len(starts):
                    text = np.searchsorted(words.row, starts, "right") - 1
                    place = (np.asarray(part.column("tag"))[text].astype(np.int64) << 32) | (starts - words.row[text])
                    yield pa.RecordBatch.from_pydict({"w1": K.signed(words.windows(h, window)[starts]), "w2": K.signed(words.windows(words.hashes(1), window, 1)[starts]), "rid": np.asarray(part.column("rid"))[text], "place": place})

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text"):
                words = K.Words(part.column("text"))
                first, same = _marked(part, "places", words)
                covered = np.zeros(len(words) + 1, np.int64)
                np.add.at(covered, first, 1)
                np.add.at(covered, first + window, -1)
                kept = np.cumsum(covered)[:-1] == 0
                data, bounds = K.joined(words, kept)
                data = data.tobytes()
                removed = np.zeros(len(words) + 1, np.int64)
                np.cumsum(~kept, out=removed[1:])
                out = pa.RecordBatch.from_pydict({
                    "rid": part.column("rid"),
                    "tag": part.column("tag"),
                    "cut": pa.array((removed[words.row[1:]] - removed[words.row[:-1]]).astype(np.int64)),
                    "cut_sha": pa.array([hashlib.sha256(data[a:b]).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                    "kept_text": pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]),
                })
                yield out.filter(pa.array(same))

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, max_cells: int = MAX_CELLS, with_text: bool = False) -> DataFrame:
    """Each document's word counts and what is left when repeated windows are removed.

    Takes ``doc_id`` and ``text`` of ``docs``; other columns are ignored.  A word is
    removed if a window that covers it has the words of a window that starts
    anywhere else, in the same text or another; windows are judged on the input.
    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one
    space) and, if ``with_text``, kept_text.

    Null or empty texts, and texts below ``window`` words, have nothing removed.  Rows
    that repeat a text (also a whole row, or a null doc_id) count as places of their
    own, so their windows repeat.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max_cells.bit_length() - 1, max(10, int(size / 25).bit_length()))
    survey = saved(docs.mapInArrow(_survey(bits, window), _PLACES), "places")
    slices = survey.filter("kind = 1").select("slice", "cells").repartition("slice").mapInArrow(_merge, "slice int, cells binary")
    length = max(1, (1 << bits) // 8)
    sketch = np.zeros((SKETCH_ROWS, length), np.uint8)
    for s, cells in slices.collect():  # bounded by SKETCH_ROWS * max_cells / 8 bytes
        start = (s & 0xFFFF) * SLICE // 8
        sketch[s >> 16, start : start + len(cells)] = np.frombuffer(cells, np.uint8)
    shared = spark.sparkContext.broadcast(sketch.tobytes())

    places = survey.filter("kind = 0").drop("kind", "slice", "cells")
    # written first, as all aggregates that are joined on a key that may be hot: a join of two plain exchanges is one that adaptive execution can split
    copies = saved(places.groupBy("k1", "k2").agg(F.count("*").alias("copies")).filter("copies > 1"), "copies")
    places = join_counted(places, copies, ["k1", "k2"], "copies", "left")

    def by_text(marks: DataFrame, name: str) -> DataFrame:
        """(rid, tag, ``name``): the places of each text."""
        return marks.groupBy("rid", F.shiftright("place", 32).cast("int").alias("tag")).agg(F.collect_list(F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias(name))

    anchors = saved(docs.mapInArrow(_suspects(shared, bits, window), _ANCHORS), "anchors")
    # written first: a join of two plain exchanges is one that adaptive execution can split at a hot key
    repeated = saved(anchors.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "grams")
    anchored = saved(by_text(anchors.join(repeated, "gram"), "anchors"), "anchored")
    # of equal texts that several partitions have given, one is enough
    equal = anchored.select("rid", "tag").join(places.filter("copies is not null").select("rid", "tag", "k1", "k2").distinct(), ["rid", "tag"])
    equal = saved(equal, "equal")
    first = saved(equal.groupBy("k1", "k2").agg(F.min("rid").alias("first")), "first")
    spare = equal.join(first, ["k1", "k2"]).filter("rid <> first").select("rid", "tag")
    anchored = saved(anchored.join(spare, ["rid", "tag"], "left_anti"), "anchored")
    texts = docs.select(F.col("doc_id").alias("rid"), "text").filter("rid is not null")
    texts = near_members(texts, "rid", anchored.select("rid"), anchored.count())
    if docs.filter("doc_id is null").limit(1).count():  # a null doc_id: found by its text's hash
        texts = texts.unionByName(docs.filter("doc_id is null").mapInArrow(_keyed, "rid long, text string"))
    texts = saved(anchored.join(texts, "rid").select("rid", "tag", "text", "anchors"), "texts")

    def windows() -> DataFrame:
        return texts.mapInArrow(_emit(window), _WINDOWS)

    repeated = saved(windows().groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").select("w1", "w2"), "windows")
    hits = by_text(windows().join(repeated, ["w1", "w2"]), "places")
    cut = hits.join(texts.select("rid", "tag", "text"), ["rid", "tag"]).mapInArrow(_cut(window), "rid long, tag int, cut long, cut_sha binary, kept_text string")
    if not with_text:
        cut = cut.drop("kept_text")
    whole = F.col("copies").isNotNull() & (F.col("n") >= window)
    cut = cut.dropDuplicates(["rid", "tag"])
    out = places.join(cut, ["rid", "tag"], "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.when(whole, F.col("n").cast("long")).otherwise(F.coalesce("cut", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex(F.coalesce("cut_sha", "sha")))).alias("kept_sha256"),
        *([F.when(whole, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []),
    )
    return out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.slices(batch, "text"):
            words = K.Words(part.column("text"))
            rid, _, _, _ = _keys(part, words, words.hashes())
            yield pa.RecordBatch.from_pydict({"rid": rid, "text": part.column("text").cast(pa.string())})
