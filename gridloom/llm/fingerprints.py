"""Document fingerprints: one-permutation MinHash, optimally densified, packed and bias-corrected.

The hashes of a text's distinct five-word shingles are dealt once into ``BINS`` bins
by their high bits, and each bin keeps its least.  An empty bin
takes the value of the first filled bin in a fixed random sequence of its own
(optimal densification), the same for every text.  ``BITS`` bits of each bin's value,
mixed with the bin's number, are stored.  Two fingerprints that agree in a
share ``c`` of their bins have the estimated similarity (c - 2**-BITS) / (1 - 2**-BITS).

``compare_neighbours`` needs each document's successor by id: documents are dealt
into ranges of ids, sorted there, and the first document of a range is copied to
the end of the range before it, so one shuffle of the texts is enough.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import kernels as K
from gridloom.llm.jaccard_join import shingle_sets

WIDTH = 5
BINS = 512
BITS = 4
#: A range of ids holds about so many bytes of text, and there are MAX_RANGES at most.
RANGE_BYTES = 4 << 20
MAX_RANGES = 4096
#: Bytes of a text at least, on average, where a column tells its size.
LEAST_BYTES = 256
#: Texts that are sketched at once: BINS numbers each.
SLICE_ROWS = 512
_TRIES, _STEP = 16384, 512
_FIRST_TRIES = 24


@functools.cache
def _sequences() -> tuple[np.ndarray, np.ndarray]:
    """tries x bins: the bin that an empty bin asks at each try; bins x bins: at which try it first asks another."""
    when = np.full((BINS, BINS), _TRIES, np.int32)
    bins = np.arange(BINS)
    for first in range(_TRIES - _STEP, -1, -_STEP):  # some tries at a time, the first ones last
        numbers = np.arange(first * BINS, (first + _STEP) * BINS, dtype=np.uint64)
        asked = (K.mix(numbers + np.uint64(0xA5A5_0000_1234)) % np.uint64(BINS)).astype(np.int64).reshape(_STEP, BINS)
        for t in range(_STEP - 1, -1, -1):
            when[bins, asked[t]] = first + t
    return asked[:_FIRST_TRIES].copy(), when


def sketch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """texts x BINS: the packed-to-be values, and whether each text has any shingle."""
    values, bounds = shingle_sets(texts, WIDTH)
    n = len(bounds) - 1
    text = np.repeat(np.arange(n), np.diff(bounds))
    bins = (values >> np.uint64(64 - (BINS - 1).bit_length())).astype(np.int64)
    first = np.ones(len(values), bool)
    first[1:] = (bins[1:] != bins[:-1]) | (text[1:] != text[:-1])
    least = np.zeros((n, BINS), np.uint64)
    least[text[first], bins[first]] = values[first]
    filled = np.zeros((n, BINS), bool)
    filled[text[first], bins[first]] = True
    has = filled.any(axis=1)
    row, empty = np.nonzero(~filled & has[:, None])
    asked, when = _sequences()
    for tries in asked:
        if not len(row):
            break
        target = tries[empty]
        hit = filled[row, target]
        least[row[hit], empty[hit]] = least[row[hit], target[hit]]
        row, empty = row[~hit], empty[~hit]
    edges = np.flatnonzero(np.diff(row, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = np.flatnonzero(filled[row[a]])
        least[row[a], empty[a:b]] = least[row[a], own[when[np.ix_(empty[a:b], own)].argmin(axis=1)]]
    # bits that depend on the bin too: else a value that fills many bins would agree with another one in all or none
    codes = K.mix(least + np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
    return codes.astype(np.int8), has


def packed(codes: np.ndarray, has: np.ndarray) -> list[str]:
    """The fingerprints as base64 text, two values a byte; empty for texts without words."""
    two = (codes[:, ::2] | codes[:, 1::2] << BITS).astype(np.uint8)
    return [base64.b64encode(x.tobytes()).decode() if h else "" for x, h in zip(two, has, strict=True)]


def unpacked(fingerprint: str) -> np.ndarray:
    two = np.frombuffer(base64.b64decode(fingerprint), np.uint8)
    return np.stack([two & 15, two >> 4], axis=1).reshape(-1)


def likeness(a: np.ndarray, b: np.ndarray, has_a: np.ndarray, has_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarities, row by row; 1 for two texts without words, 0 for one."""
    chance = 1 / (1 << BITS)
    c = (a == b).mean(axis=1)
    return np.where(has_a & has_b, np.clip((c - chance) / (1 - chance), 0, 1), (has_a == has_b).astype(float))


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row; equal texts have equal fingerprints; null and blank texts have the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text", rows=SLICE_ROWS):
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "fingerprint": packed(*sketch(part.column("text")))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(K.freeing(run), "doc_id long, fingerprint string")


_COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # the last row so far, which waits for its successor: (range, copied, id, text, codes, has)
    for batch in batches:
        for part in K.slices(batch, "text", rows=SLICE_ROWS):
            texts = ["" if t is None else t for t in part.column("text").to_pylist()]
            ids, ranges, copied = part.column("doc_id").to_pylist(), part.column("range").to_pylist(), part.column("copied").to_pylist()
            codes, has = sketch(part.column("text"))
            if held:
                ranges, copied, ids, texts = [held[0], *ranges], [held[1], *copied], [held[2], *ids], [held[3], *texts]
                codes, has = np.concatenate([held[4], codes]), np.concatenate([held[5], has])
            last = len(texts) - 1
            held = (ranges[last], copied[last], ids[last], texts[last], codes[last:], has[last:])
            own = np.array([k for k in range(last) if not copied[k]], np.int64)
            if not len(own):
                continue
            edited, n_chars = [], []
            for k in own.tolist():
                n = len(texts[k])
                n_chars.append(n)
                edited.append(texts[k][: n - n // 4] + texts[k + 1][: n // 4])
            changed, changed_has = sketch(pa.array(edited, pa.large_string()))
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([ids[k] for k in own], pa.int64()),
                "n_chars": n_chars,
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                "fingerprint": packed(codes[own], has[own]),
                "edited_fingerprint": packed(changed, changed_has),
                "near_edited": likeness(codes[own], changed, has[own], changed_has),
                "near_next": likeness(codes[own], codes[own + 1], has[own], has[own + 1]),
            })


def compare_neighbours(docs: DataFrame, range_bytes: int = RANGE_BYTES, text_size: Column | None = None) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    Documents follow each other by doc_id (null first), then text (null first); the last
    one's next is the first.  The edited text has its last quarter of code points
    (rounded down) replaced by as many of the next text's first ones, or by all of them.
    A null text counts as empty; rows that repeat an id, or a whole row, are documents of
    their own; a sole document is its own next; an empty table gives no rows; other columns are ignored.

    ``text_size``, a number, says about how long a text is and deals the ranges alone: any values give the same rows.
    Without it all texts are decoded once more to be measured, which widens an executor's heap by half.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("key"))
    if text_size is None:
        size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    else:
        told, n = docs.agg(F.sum(text_size.cast("double")), F.count("*")).first()
        size = int(min(max(LEAST_BYTES * n, told or 0), 1e18))
    count = min(MAX_RANGES, 1 + size // range_bytes)
    side = max(1, round(count**0.5))
    points = [k / (side * side) for k in range(1, side * side)]
    bounds = sorted(set(source.agg(F.percentile_approx("key", points, 20 * side * side)).first()[0] or [])) if points else []
    bounds += [(1 << 63) - 1] * (side * side - len(bounds))
    coarse, fine = bounds[side - 1 :: side], F.array(*[F.lit(b) for b in bounds])
    # a range's number is how many bounds are below the key: first in steps of ``side``, then within that step
    step = F.least(F.size(F.filter(F.array(*[F.lit(b) for b in coarse]), lambda b: b < F.col("key"))), F.lit(side - 1))
    ranged = source.withColumn("step", step).withColumn("range", F.col("step") * side + F.size(F.filter(F.slice(fine, F.col("step") * side + 1, side), lambda b: b < F.col("key"))))
    firsts = sorted((r.range, r.key) for r in ranged.groupBy("range").agg(F.min("key").alias("key")).collect())  # MAX_RANGES rows
    if not firsts:
        return docs.sparkSession.createDataFrame([], _COMPARED)
    before = dict(zip([k for _, k in firsts], [firsts[-1][0], *(r for r, _ in firsts[:-1])], strict=True))
    copies = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    own = F.struct(F.col("range"), F.lit(False).alias("copied"))
    placed = ranged.withColumn("to", F.when(F.col("key").isin(*before), F.array(own, F.struct(copies[F.col("key")].alias("range"), F.lit(True).alias("copied")))).otherwise(F.array(own)))
    placed = placed.select("doc_id", "text", "key", F.inline("to"))
    return placed.repartition("range").sortWithinPartitions("range", "copied", "key", F.col("text").asc_nulls_first()).select("range", "copied", "doc_id", "text").mapInArrow(K.freeing(_compare), _COMPARED)
