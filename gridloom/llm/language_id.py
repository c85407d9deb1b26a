"""Language identification: script ranges, per-word scores, and a Viterbi path with a switching penalty.

Each word gets a score for each learned language: the sum of log probabilities
of its byte trigrams (with the separators beside it), against the best language
and floored.  The scripts of a word's letters, told by code point ranges, narrow its
candidates to the languages whose training text uses one of these scripts.
Viterbi over the words, with a penalty for each change of language, labels the
spans.  A text's language is the one that labels most of its letters' bytes.

Most texts need no step-by-step path: if no run of words gains more under any
other language than one switch costs, the constant path is optimal; this is
tested for all texts of a slice at once.  The others take the exact recursion.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm import kernels as K
from gridloom.llm.scratch import near_members

GRAM_BITS = 16
SWITCH = 12.0
FLOOR = -8.0
#: Training takes this many documents of each language at most, those of least hash.
TRAIN_DOCS = 3000
SPARE = 4
#: Rows of a range of hashes in which training rows are ranked, about.
RANGE = 64

# First code points of Unicode's main script ranges, and a bit for the script that begins there (0: no letters of one script).
SCRIPT_STARTS = np.array([0x0, 0x41, 0x5B, 0x61, 0x7B, 0xAA, 0xAB, 0xB5, 0xB6, 0xBA, 0xBB, 0xC0, 0xD7, 0xD8, 0xF7, 0xF8, 0x250, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xA00, 0xB80, 0xC00, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0xFB50, 0xFE00, 0x10000, 0x20000, 0x30000])
SCRIPT_BITS = np.array([0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 2, 4, 8, 16, 32, 0, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768, 1, 2, 0, 65536, 131072, 0, 262144, 0, 16384, 0, 262144, 0, 32, 0, 0, 262144, 0])

_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Model:
    """Learned languages, their log probabilities (grams x languages) and script bits."""

    languages: list[str]
    weights: np.ndarray
    scripts: np.ndarray


def _grams(words: K.Words) -> np.ndarray:
    """A trigram code for each byte: the byte with those beside it, A-Z lower-cased, all separators alike."""
    data = K._LOWER[words.data]
    data = np.where(K._WORDY[data], data, 0x20).astype(np.uint32)
    edge = np.zeros(len(data) + 1, bool)
    edge[words.offsets] = True
    before, after = np.full(len(data), 0x20, np.uint32), np.full(len(data), 0x20, np.uint32)
    before[1:] = np.where(edge[1:-1], 0x20, data[:-1])
    after[:-1] = np.where(edge[1:-1], 0x20, data[1:])
    code = before * np.uint32(0x01000193) ^ data * np.uint32(0x9E3779B1) ^ after * np.uint32(0x85EBCA77)
    code ^= code >> np.uint32(15)
    return ((code * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - GRAM_BITS)).astype(np.int32)


def _scripts(words: K.Words) -> np.ndarray:
    """Script bits of each word, 0 for words without letters of a known script."""
    data = words.data
    bits = np.zeros(len(data), np.int32)
    bits[((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)] = 1
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        b = [padded[lead + k] for k in range(4)]
        low = [x & 0x3F for x in b]
        point = np.where(b[0] < 0xE0, (b[0] & 0x1F) << 6 | low[1], np.where(b[0] < 0xF0, (b[0] & 0xF) << 12 | low[1] << 6 | low[2], (b[0] & 7) << 18 | low[1] << 12 | low[2] << 6 | low[3]))
        bits[lead] = SCRIPT_BITS[np.searchsorted(SCRIPT_STARTS, point, "right") - 1]
    return np.bitwise_or.reduceat(bits, words.starts) if len(words) else np.zeros(0, np.int32)


def _sums(values: np.ndarray, words: K.Words) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[words.ends] - total[words.starts]


def in_training(doc_id: Column) -> Column:
    """Whether crc32 of the id as text, modulo 4, is not 2 (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Learn from ``doc_id``, ``text`` and ``lang`` of the training rows: ``train_docs`` a language at most.

    Rows with a null id, text or lang are left out.  Which rows are taken depends on their ids alone.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).filter(in_training(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    # hashes below a bound that lets about SPARE * train_docs rows of each language pass; of these the least are ranked
    ids = rows.select("doc_id", "lang").withColumn("hash", F.xxhash64("doc_id"))
    counts = ids.groupBy("lang").agg(F.count("*").alias("n"))  # a row a language
    near = ids.join(F.broadcast(counts), "lang").filter(F.col("hash") < F.least(F.lit(SPARE * train_docs) / F.col("n"), F.lit(1.0)) * 2.0**64 - 2.0**63)
    # ranks in two levels: of ranges of hashes that hold about RANGE rows each, and of rows within a range
    near = near.withColumn("range", F.floor((F.col("hash") + F.lit(2.0**63)) / 2.0**64 * F.col("n") / RANGE))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = near.groupBy("lang", "range").agg(F.count("*").alias("rows")).select("lang", "range", before.alias("before"))  # SPARE * train_docs / RANGE rows a language
    rank = F.row_number().over(Window.partitionBy("lang", "range").orderBy("hash", "doc_id"))
    sample = near.withColumn("rank", rank).join(F.broadcast(ranges), ["lang", "range"]).filter(F.col("rank") + F.col("before") <= train_docs).select("doc_id", "lang").distinct().cache()
    languages = [r.lang for r in sample.select("lang").distinct().orderBy("lang").collect()]
    code = F.array_position(F.array(*[F.lit(x) for x in languages] or [F.lit("")]), F.col("lang")).cast("int") - 1
    taken = near_members(rows, "doc_id", sample.select("doc_id"), train_docs * max(1, len(languages))).join(sample, ["doc_id", "lang"])
    counted = taken.select("text", code.alias("code")).mapInArrow(K.freeing(_count(len(languages))), "code int, counts binary").repartition("code").mapInArrow(_add, "code int, counts binary").collect()
    sample.unpersist()
    size = 1 << GRAM_BITS
    weights, scripts = np.zeros((size, len(languages)), np.float32), np.zeros(len(languages), np.int32)
    for c, counts in counted:  # one row a language
        counts = np.frombuffer(counts, np.int64)
        grams, letters = counts[:size], counts[size:]
        weights[:, c] = np.log((grams + 0.2) / (grams.sum() + 0.2 * size))
        used = letters > 0.01 * letters.sum()
        scripts[c] = int(sum(1 << b for b in np.flatnonzero(used)))
    return Model(languages, weights, scripts)


def _count(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << GRAM_BITS
        total = np.zeros((n, size + 32), np.int64)
        for batch in batches:
            for part in K.slices(batch, "text"):
                words = K.Words(part.column("text"))
                code = np.asarray(part.column("code"))
                owner = np.repeat(code, np.diff(words.offsets))
                wordy = K._WORDY[words.data]
                total[:, :size] += np.bincount(owner[wordy] * size + _grams(words)[wordy], minlength=n * size).reshape(n, size)
                bits, owner = _scripts(words), np.repeat(code, words.counts())
                for b in range(32):
                    total[:, size + b] += np.bincount(owner[(bits >> b & 1) > 0], minlength=n)
        for c in range(n):
            if total[c].any():
                yield pa.RecordBatch.from_pydict({"code": pa.array([c], pa.int32()), "counts": [zlib.compress(total[c].tobytes(), 1)]})

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, counts in zip(batch.column("code").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            counts = np.frombuffer(zlib.decompress(counts), np.int64)
            total[c] = total[c] + counts if c in total else counts
    for c, counts in total.items():
        yield pa.RecordBatch.from_pydict({"code": pa.array([c], pa.int32()), "counts": [counts.tobytes()]})


def word_scores(words: K.Words, model: Model) -> np.ndarray:
    """Languages x words: log scores against the word's best language, floored; 0 throughout for words without letters."""
    if not model.languages:
        return np.zeros((0, len(words)))
    grams = _grams(words)
    scores = np.stack([_sums(model.weights[:, c][grams], words) for c in range(len(model.languages))]).reshape(len(model.languages), len(words))
    bits = _scripts(words)
    allowed = (model.scripts[:, None] & bits[None, :]) > 0
    allowed |= ~allowed.any(axis=0)
    scores[~allowed] = -np.inf
    scores -= scores.max(axis=0)
    np.maximum(scores, FLOOR, out=scores)
    scores[:, bits == 0] = 0
    return scores


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best path through languages x words with a cost for each switch; ties go to the language listed first."""
    n, t = scores.shape
    came = np.empty((t, n), np.int16)
    value = np.zeros(n)
    own = np.arange(n)
    for k in range(t):
        best = int(value.argmax())
        stay = value >= value[best] - switch
        came[k] = np.where(stay, own, best)
        value = np.where(stay, value, value[best] - switch) + scores[:, k]
    path = np.empty(t, np.int16)
    state = int(value.argmax())
    for k in range(t - 1, -1, -1):
        path[k] = state
        state = came[k][state]
    return path


def label(words: K.Words, model: Model, switch: float = SWITCH) -> tuple[np.ndarray, np.ndarray]:
    """The language of each word of a slice, by the optimal path of its text; and the score sums, languages x texts."""
    scores = word_scores(words, model)
    n = words.counts()
    total = np.zeros((scores.shape[0], len(words) + 1))
    np.cumsum(scores, axis=1, out=total[:, 1:])
    sums = total[:, words.row[1:]] - total[:, words.row[:-1]]
    best = sums.argmax(axis=0) if len(model.languages) else np.zeros(len(n), np.int64)
    text = np.repeat(np.arange(len(n)), n)
    path = best[text].astype(np.int16)
    if not len(words) or not model.languages:
        return path, sums
    base = np.take_along_axis(scores, path[None, :].astype(np.int64), 0)[0]
    gain = np.zeros(len(n))
    for c in range(len(model.languages)):  # the largest gain of any run of words under language c, by text
        run = np.cumsum(scores[c] - base)
        start = np.concatenate([[0.0], run[:-1]])
        step = (run.max() - min(0.0, run.min())) + 1.0
        low = np.minimum.accumulate(start - text * step) + text * step
        np.maximum.at(gain, text, run - low)
    for i in np.flatnonzero(gain > switch):
        a, b = words.row[i], words.row[i + 1]
        path[a:b] = viterbi(scores[:, a:b], switch)
    return path, sums


def _predict(model, switch: float, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        names = np.array([*m.languages, "und"], dtype=object)
        for batch in batches:
            for part in K.slices(batch, "text"):
                words = K.Words(part.column("text"))
                path, sums = label(words, m, switch)
                texts = part.num_rows
                text = np.repeat(np.arange(texts), words.counts())
                lettered = (_scripts(words) > 0) | np.isin(text, np.flatnonzero(~_has(words, text)))
                size = np.where(lettered, words.ends - words.starts, 0)
                share = np.zeros((texts, len(m.languages)))
                np.add.at(share, (text, path), size) if len(m.languages) else None
                every = share.sum(axis=1)
                known = np.array([t is not None and _LETTER.search(t) is not None for t in part.column("text").to_pylist()], bool) & (every > 0)
                top = share.argmax(axis=1) if len(m.languages) else np.zeros(texts, np.int64)
                odds = np.exp(sums - sums.max(axis=0, initial=-np.inf)).sum(axis=0) if len(m.languages) else np.ones(texts)
                posterior = np.exp(sums[top, np.arange(texts)] - sums.max(axis=0)) / odds if len(m.languages) else np.zeros(texts)
                part_of = np.divide(share.max(axis=1, initial=0), every, out=np.zeros(texts), where=every > 0)
                score = np.where(known, part_of * np.where(part_of < 0.999, 1.0, posterior), 0.0)
                change = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (text[1:] != text[:-1])])) if len(words) else np.zeros(0, np.int64)
                stop = np.append(change[1:], len(words))
                point = np.zeros(len(words.data) + 1, np.int64)
                np.cumsum((words.data & 0xC0) != 0x80, out=point[1:])
                origin = point[words.offsets[:-1]][text[change]]
                spans = pa.StructArray.from_arrays([pa.array((point[words.starts[change]] - origin).astype(np.int64)), pa.array((point[words.ends[stop - 1]] - origin).astype(np.int64)), pa.array(names[path[change]], pa.string())], ["start", "end", "lang"])
                bounds = np.searchsorted(text[change], np.arange(texts + 1)).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"),
                    "held_out": part.column("held_out"),
                    "lang_pred": pa.array(np.where(known, names[top], "und"), pa.string()),
                    "score": score,
                    "spans": pa.ListArray.from_arrays(pa.array(bounds), spans),
                    **{f"kept_{c}": part.column("text" if c == "text" else f"kept_{c}") for c in keep},
                })

    return run


def _has(words: K.Words, text: np.ndarray) -> np.ndarray:
    """Whether each text has a word in a known script."""
    has = np.zeros(len(words.offsets) - 1, bool)
    has[text[_scripts(words) > 0]] = True
    return has


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, spans) for each row of ``docs``, and ``keep``'s columns as kept_<name>.

    ``lang_pred`` is a learned language, or ``und`` with score 0 if the text is null, has
    no letter, or nothing was learned.  ``score`` is the share of the letters' bytes
    that the language labels, or for texts of one language its posterior.  ``spans``
    are (start, end, lang) in code points, end exclusive, from word to word.  A null doc_id is not held out.
    Other columns are never read; repeated rows are labelled alike; no rows give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = ~F.coalesce(in_training(F.col("doc_id")), F.lit(True))
    keep = keep or []
    extra = [F.col(c).alias(f"kept_{c}") for c in keep if c != "text"]  # the texts go to the workers once
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text", *extra)
    kept = "".join(f", `kept_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(K.freeing(_predict(shared, switch, keep)), "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>" + kept)
