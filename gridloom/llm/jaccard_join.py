"""Exact Jaccard self-join on word shingles, by prefixes of token combinations.

A document is the set of its distinct shingles (tokens).  Tokens have one global
order, by an estimate of how many sets have them (rare first), then by hash; any
order gives right results, a good one gives few candidates.  Tokens estimated
below a bound are *rare*, the others *frequent*.

Let a set of ``n`` tokens miss at most ``e`` tokens of any set it is similar to.
Its prefix is extended until it covers ``e + 1``: each rare token covers one;
frequent tokens are dealt by hash into ``m`` bins, and a bin that holds ``g``
prefix tokens covers ``g - 1``.  If two similar sets shared neither a rare prefix
token nor two frequent prefix tokens of one bin, the one whose prefix ends first
would miss more than ``e`` tokens.  So rare tokens are indexed singly, frequent
ones in pairs within their bin.  ``m`` follows the size of the set; as both sets of
a pair must agree on it, sets are indexed for their size band and the next one
(similar sizes differ by one band at most).

Candidates come from lists of equal signatures.  Sets that are equal count as
one node.  Lists are not expanded into pairs: first every member is verified with
one hub of its list; then, in short lists whose members are not yet in one component,
those outside the list's largest component meet the members of other components
that size and position bounds leave.  Members of long lists of several components are
indexed once more, by larger combinations instead of prefixes: all tokens are dealt by
hash into one part more than two similar sets of their size band can differ in tokens, so
similar sets have one part in common as a whole.  Lists of whole parts are as short as sets
are unlike, and go the same way: a hub first, then what is left.  Before texts are
compared, parity bitmaps bound the overlap: sets that differ in ``d`` tokens differ in ``d``
bits at most.  All bounds are lossless, so the components are those of all links.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import kernels as K
from gridloom.llm.components import connected_components
from gridloom.llm.scratch import near_members, saved, settled

#: log2 of the number of counters that estimate how many sets have a token.
SKETCH_BITS = 22
#: A list whose members would meet in more pairs than this is indexed by parts instead.
LIST_PAIRS = 1 << 26
SLICE = 1 << 18
#: A token is frequent if its counter is above this many times the mean counter, plus FREQUENT_OVER.
FREQUENT_TIMES = 2.0
FREQUENT_OVER = 64

#: Bits of the parity bitmaps: bit b of a set's is whether an odd number of its tokens hash to b.
PARITY_BITS = 1024

_SURVEY = "kind int, doc_id long, k long, n long, parity array<bigint>, slice int, counts binary"
_POSTINGS = "sig long, node long, n int, rem int"


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, ascending, and the bounds of each text's run."""
    words = K.Words(texts, lower=True)
    h = words.hashes()
    grams = words.windows(h, width)
    starts = np.flatnonzero(K.inside(words.row, width)[: len(grams)])
    n = words.counts()
    text = np.repeat(np.arange(len(n)), n)[starts]
    short = np.flatnonzero((n > 0) & (n < width))
    values = np.concatenate([grams[starts], words.whole(h)[short]])
    text = np.concatenate([text, short])
    order = np.argsort(values)
    kind = np.uint16 if len(n) < 1 << 16 else np.int64
    order = order[np.argsort(text[order].astype(kind), kind="stable")]
    values, text = values[order], text[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[fresh], text[fresh]
    return values, np.searchsorted(text, np.arange(len(n) + 1))


def set_keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set, which depends on its members and size alone."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(K.mix(values + np.uint64(0x2545F4914F6CDD1D)), out=total[1:])
    n = np.diff(bounds).astype(np.uint64)
    return K.mix((total[bounds[1:]] - total[bounds[:-1]]) + n * np.uint64(0x9E3779B97F4A7C15))


def _parity(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    n, words = len(bounds) - 1, PARITY_BITS // 64
    cell = np.repeat(np.arange(n), np.diff(bounds)) * PARITY_BITS + (values >> np.uint64(11)).astype(np.int64) % PARITY_BITS
    odd = np.bincount(cell, minlength=n * PARITY_BITS) & 1
    bits = np.packbits(odd.astype(bool), bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * words + 1, words), pa.int32()), pa.array(bits))


def _survey(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for part in K.slices(batch, "text"):
                values, bounds = shingle_sets(part.column("text"), width)
                np.add.at(counts, (values >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
                n = part.num_rows
                yield pa.RecordBatch.from_pydict({"kind": np.zeros(n, np.int32), "doc_id": part.column("doc_id").cast(pa.int64()), "k": K.signed(set_keys(values, bounds)), "n": np.diff(bounds).astype(np.int64), "parity": _parity(values, bounds), "slice": pa.nulls(n, pa.int32()), "counts": pa.nulls(n, pa.binary())})
        for s in range(0, len(counts), SLICE):
            if counts[s : s + SLICE].any():
                yield pa.RecordBatch.from_pydict({"kind": pa.array([1], pa.int32()), "doc_id": pa.nulls(1, pa.int64()), "k": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int64()), "parity": pa.nulls(1, pa.list_(pa.int64())), "slice": pa.array([s // SLICE], pa.int32()), "counts": [zlib.compress(counts[s : s + SLICE].tobytes(), 1)]})

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of slices; what goes on is the logarithm of each counter in steps of an eighth, one byte, and the sum."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            counts = np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.uint64)
            total[s] = total[s] + counts if s in total else counts
    for s, counts in total.items():
        yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int32()), "levels": [_level(counts).tobytes()], "total": [int(counts.sum())]})


def _level(counts: np.ndarray) -> np.ndarray:
    return np.minimum(8 * np.log2(1.0 + counts), 255).astype(np.uint8)


def most_missed(n: np.ndarray, percent: int) -> np.ndarray:
    """How many tokens a set of ``n`` can miss of a set whose similarity to it is ``percent`` or more."""
    return n - (n * percent + 99) // 100


def _pairs_of_frequent(tokens: np.ndarray, rare: int, n: int, percent: int) -> np.ndarray:
    """Signatures of the pairs of frequent prefix tokens; ``tokens`` are a set's frequent ones in the global order."""
    need = int(most_missed(np.int64(n), percent)) + 1 - rare
    found = []
    growth = 100 / (percent - 1)  # of size bands: similar sizes differ by one band at most
    band = int(math.log(n) / math.log(growth))
    for c in (band, band + 1):
        m = max(1, math.ceil((100 - percent) / 100 * growth ** (c + 1) / 3))
        bins = (K.mix(tokens) >> np.uint64(20)) % np.uint64(m)
        gain = np.ones(len(tokens), np.int64)
        gain[np.unique(bins, return_index=True)[1]] = 0
        end = int(np.searchsorted(np.cumsum(gain), need)) + 1
        prefix, bins = tokens[:end], bins[:end]
        order = np.argsort(bins, kind="stable")
        prefix, bins = prefix[order], bins[order]
        for gap in range(1, len(prefix)):
            same = bins[gap:] == bins[:-gap]
            if not same.any():
                break
            a, b = prefix[:-gap][same], prefix[gap:][same]
            found.append(K.mix(np.minimum(a, b) * np.uint64(0x9FB21C651E98DF25) ^ K.mix(np.maximum(a, b))))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _signatures(levels, width: int, percent: int, bits: int, frequent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels.value, np.uint8)
        seen: set[int] = set()
        for batch in batches:
            for part in K.slices(batch, "text"):
                values, bounds = shingle_sets(part.column("text"), width)
                nodes = set_keys(values, bounds)
                fresh = np.array([not (x in seen or seen.add(x)) for x in nodes.tolist()], bool)
                n = np.diff(bounds)
                text = np.repeat(np.arange(len(n)), n)
                lev = level[(values >> np.uint64(64 - bits)).astype(np.int64)]
                tokens = (lev.astype(np.uint64) << np.uint64(56)) | (values & np.uint64((1 << 56) - 1))
                order = np.argsort(tokens)
                kind = np.uint16 if len(n) < 1 << 16 else np.int64
                order = order[np.argsort(text[order].astype(kind), kind="stable")]
                tokens = tokens[order]
                is_rare = (tokens >> np.uint64(56)).astype(np.int64) <= frequent
                rares = np.zeros(len(tokens) + 1, np.int64)
                np.cumsum(is_rare, out=rares[1:])
                rares = rares[bounds[1:]] - rares[bounds[:-1]]
                place = np.arange(len(tokens)) - bounds[:-1][text]
                missed = most_missed(n, percent)
                take = is_rare & (place <= missed[text]) & fresh[text]
                sig, node, size, rem = [K.mix(tokens[take])], [nodes[text[take]]], [n[text[take]]], [(n[text] - place)[take]]
                for i in np.flatnonzero(fresh & (n > 1) & (rares < missed + 1)):
                    found = _pairs_of_frequent(tokens[bounds[i] + rares[i] : bounds[i + 1]], int(rares[i]), int(n[i]), percent)
                    sig.append(found)
                    node.append(np.full(len(found), nodes[i]))
                    size.append(np.full(len(found), n[i]))
                    rem.append(np.full(len(found), n[i] - rares[i]))
                yield pa.RecordBatch.from_pydict({"sig": K.signed(np.concatenate(sig)), "node": K.signed(np.concatenate(node)), "n": np.concatenate(size).astype(np.int32), "rem": np.concatenate(rem).astype(np.int32)})

    return run


def _part_signatures(width: int, percent: int):
    """Signatures of whole parts of each set, under its size band and the next one.

    Sets of sizes a and b with a similarity of ``percent`` or more differ in (100 - percent) / (100 + percent) * (a + b) tokens at most.
    """
    growth = 100 / (percent - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text"):
                values, bounds = shingle_sets(part.column("text"), width)
                nodes = np.asarray(part.column("node"))
                right = K.signed(set_keys(values, bounds)) == nodes
                n = np.diff(bounds)
                text = np.repeat(np.arange(len(n)), n)
                hashed = K.mix(values + np.uint64(0x632BE59BD9B4E019))
                band = np.floor(np.log(np.maximum(n, 1)) / math.log(growth)).astype(np.int64)
                found = []
                for c in (band, band + 1):
                    parts = np.floor(2 * (100 - percent) / (100 + percent) * growth ** (c + 1)).astype(np.int64) + 1
                    first = np.concatenate([[0], np.cumsum(parts)])
                    cell = first[:-1][text] + ((hashed >> np.uint64(20)) % parts[text].astype(np.uint64)).astype(np.int64)
                    total = np.zeros(first[-1], np.uint64)
                    np.add.at(total, cell, hashed)
                    owner = np.repeat(np.arange(len(n)), parts)
                    number = np.arange(first[-1]) - first[:-1][owner]
                    sig = K.mix(total ^ K.mix((c[owner] << 32 | number).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
                    keep = right[owner]
                    found.append((sig[keep], owner[keep]))
                sig, owner = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_pydict({"sig": K.signed(sig), "node": nodes[owner], "n": n[owner].astype(np.int32), "rem": n[owner].astype(np.int32)})

    return run


def _verify(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text_a"):
                va, ba = shingle_sets(part.column("text_a"), width)
                vb, bb = shingle_sets(part.column("text_b"), width)
                na, nb = np.diff(ba), np.diff(bb)
                right = (K.signed(set_keys(va, ba)) == np.asarray(part.column("a"))) & (K.signed(set_keys(vb, bb)) == np.asarray(part.column("b")))
                row = np.concatenate([np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)])
                values = np.concatenate([va, vb])
                order = np.argsort(values)
                kind = np.uint16 if len(na) < 1 << 16 else np.int64
                order = order[np.argsort(row[order].astype(kind), kind="stable")]
                values, row = values[order], row[order]
                twice = (values[1:] == values[:-1]) & (row[1:] == row[:-1])
                both = np.bincount(row[1:][twice], minlength=len(na))
                linked = (100 * both >= percent * (na + nb - both)) & right
                out = pa.RecordBatch.from_pydict({"a": part.column("a"), "b": part.column("b"), "shared": both.astype(np.int64)})
                yield out.filter(pa.array(linked))

    return run


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, sketch_bits: int = SKETCH_BITS, list_pairs: int = LIST_PAIRS) -> tuple[DataFrame, DataFrame]:
    """Sets and components of documents whose shingle sets have a Jaccard similarity of ``percent`` or more.

    Takes ``doc_id`` and ``text``; other columns are ignored.  Words are runs of
    characters other than white space (space, U+0009 to U+000D), A-Z lower-cased;
    a set is the text's distinct ``width``-word shingles, or the whole sequence
    as one shingle if it has fewer words.

    Returns two tables: (doc_id, n_shingles, component_id), one row for each row
    of ``docs``, with the least doc_id reachable by links; and the verified links
    (a, b, shared) between set keys that held the components together.

    A null or blank text has the empty set, which links with nothing.  A null doc_id
    links with nothing and has a null component.  Rows that repeat a doc_id are
    the same document: the component joins all their texts' links only where their
    sets are equal or linked.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bits = sketch_bits
    survey = saved(docs.mapInArrow(K.freeing(_survey(width, bits)), _SURVEY), "sets")
    slices = survey.filter("kind = 1").select("slice", "counts").repartition("slice").mapInArrow(_merge, "slice int, levels binary, total long")
    level, total = np.zeros(1 << bits, np.uint8), 0
    for s, part, many in slices.collect():  # 2**bits bytes
        level[s * SLICE : s * SLICE + len(part)] = np.frombuffer(part, np.uint8)
        total += many
    frequent = int(_level(np.array([FREQUENT_TIMES * total / len(level) + FREQUENT_OVER]))[0])
    shared = spark.sparkContext.broadcast(level.tobytes())

    sets = survey.filter("kind = 0").select("doc_id", "k", "n", "parity")
    classes = saved(sets.filter("n > 0 and doc_id is not null").groupBy("k").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "classes")
    reps = classes.select(F.col("k").alias("node"), F.col("rep").alias("doc_id"))

    def texts_of(nodes: DataFrame) -> DataFrame:
        """(node, text) of one document of each node."""
        wanted = saved(nodes.distinct().join(reps, "node"), "wanted")
        return near_members(docs.filter("doc_id is not null"), "doc_id", wanted.select("doc_id"), wanted.count()).join(wanted, "doc_id").select("node", "text")

    def checked(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(reps, "node")
        bitmaps = saved(nodes.join(sets.select(F.col("k").alias("node"), "doc_id", "n", "parity"), ["node", "doc_id"]).dropDuplicates(["node"]), "bitmaps")
        side = lambda x: bitmaps.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"parity_{x}"))
        differ = F.aggregate(F.zip_with("parity_a", "parity_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        close = pairs.join(side("b"), "b").join(side("a"), "a").filter((100 + percent) * (F.col("n_a") + F.col("n_b") - differ) >= 2 * percent * (F.col("n_a") + F.col("n_b")))
        close = saved(close.select("a", "b"), "close")
        texts = saved(texts_of(close.select(F.explode(F.array("a", "b")).alias("node"))), "texts")
        side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
        both = close.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
        return both.mapInArrow(K.freeing(_verify(width, percent)), "a long, b long, shared long")

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among ``pairs`` (a, b): by parity bitmaps first, then exactly by the texts."""
        return settled(lambda: checked(pairs), "links")

    postings = docs.filter("doc_id is not null").mapInArrow(K.freeing(_signatures(shared, width, percent, bits, frequent)), _POSTINGS)
    postings = _listed(postings)
    pairs = _with_hubs(postings, percent)
    links = verified(pairs)
    labels = saved(connected_components(links), "labels")
    across, long = _across(postings, labels, percent, list_pairs)
    across = saved(across.join(pairs, ["a", "b"], "left_anti"), "pairs")
    if long.limit(1).count():
        postings = _listed(texts_of(long).mapInArrow(K.freeing(_part_signatures(width, percent)), _POSTINGS))
        met = saved(_with_hubs(postings, percent).unionByName(across).distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
        more = verified(met)
        links, pairs = links.unionByName(more), pairs.unionByName(met)
        if more.limit(1).count():
            labels = _merged(labels, more)
        across = saved(_across(postings, labels, percent, None)[0].join(pairs, ["a", "b"], "left_anti"), "pairs")
    more = verified(across)
    if more.limit(1).count():
        links = links.unionByName(more)
        labels = _merged(labels, more)
    labels = classes.join(labels, classes.k == labels.node, "left").select("k", "rep", "rows", F.coalesce("label", "k").alias("label"))
    least = labels.groupBy("label").agg(F.min("rep").alias("component_id"), F.sum("rows").alias("members")).filter("members > 1")
    found = saved(labels.join(least, "label").select("k", "component_id"), "found")
    out = sets.join(found, "k", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out, links


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after more ``links``: components of components, so that only these are gone through again."""
    label = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
    ends = links.select("a", "b").join(label("a"), "a", "left").join(label("b"), "b", "left")
    ends = saved(ends.select("a", "b", F.coalesce("label_a", "a").alias("x"), F.coalesce("label_b", "b").alias("y")), "ends")
    over = saved(connected_components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))), "over").toDF("old", "new")
    fresh = ends.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("x").alias("label")), F.struct(F.col("b").alias("node"), F.col("y").alias("label")))))
    every = labels.unionByName(fresh).distinct()
    return saved(every.join(over, every.label == over.old, "left").select("node", F.coalesce("new", "label").alias("label")), "labels")


def _listed(postings: DataFrame) -> DataFrame:
    """Postings of signatures that several nodes have, each with its list's hub.

    The hub is the member in which the signature comes first, as a common original has no
    rare tokens before it.  The lists are written before the postings are joined with
    them: a join of two plain exchanges is one that adaptive execution can split at a hot signature.
    """
    order = F.shiftleft((F.col("n") - F.col("rem")).cast("long"), 40).bitwiseOR(F.col("node").bitwiseAND(F.lit((1 << 40) - 1)))
    hub = [F.min_by(c, order).alias(name) for c, name in (("node", "hub"), ("n", "n_hub"), ("rem", "rem_hub"))]
    lists = saved(postings.groupBy("sig").agg(F.min("node").alias("low"), F.max("node").alias("high"), *hub).filter("low <> high").drop("low", "high"), "lists")
    return saved(postings.join(lists, "sig"), "postings")


def _with_hubs(postings: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of each member and its list's hub."""
    met = postings.filter("node <> hub").filter(_possible("n", "n_hub", "rem", "rem_hub", percent))
    return saved(met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "pairs")


def _possible(n: str, m: str, rem: str, other: str, percent: int) -> str:
    """Whether the sizes ``n`` and ``m`` are similar enough, and the ``rem`` and ``other`` tokens left can hold the overlap needed."""
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) and {100 + percent} * least({rem}, {other}) >= {percent} * ({n} + {m})"


def _across(postings: DataFrame, labels: DataFrame, percent: int, list_pairs: int | None) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) of lists whose members are in several components, less those that a bound rules out; and the nodes of long lists.

    Lists that would give more than ``list_pairs`` pairs before the bounds are left to the
    second table (none are, if it is None).  Sizes: 100 * smaller >= percent * larger.  Position:
    at the first token that two sets share, at most ``rem`` tokens are left in either, which must reach
    the overlap that the similarity needs; every similar pair passes there.
    """
    members = postings.drop("hub", "n_hub", "rem_hub").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = members.groupBy("sig", "label").agg(F.count("*").alias("many"))
    lists = sizes.groupBy("sig").agg(F.max_by("label", F.struct("many", "label")).alias("main"), F.count("*").alias("labels"), F.max("many").alias("most"), F.sum("many").alias("many")).filter("labels > 1")
    is_long = F.lit(False) if list_pairs is None else (F.col("many") - F.col("most")) * F.col("many") > list_pairs
    lists = saved(lists.select("sig", "main", is_long.alias("long")), "lists")
    members = saved(members.join(lists, "sig"), "members")
    left = members.filter("not long and label <> main").select("sig", *[F.col(c).alias(f"{c}_x") for c in ("node", "n", "rem", "label")])
    right = members.filter("not long").select("sig", F.col("main"), *[F.col(c).alias(f"{c}_y") for c in ("node", "n", "rem", "label")])
    met = left.join(right, "sig").filter("label_x <> label_y and (label_y = main or node_x < node_y)")
    met = met.filter(_possible("n_x", "n_y", "rem_x", "rem_y", percent))
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct(), members.filter("long").select("node").distinct()
