"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over source blocks.

Each source's documents are dealt by a hash of their ids and texts into blocks, as many as its
bytes ask for and MAX_BLOCKS or one a source altogether; only the blocks' word sums reach the driver.
A source with target T and size N is taken whole floor(T / N) times; of the last
part, permuted blocks are taken whole where they don't pass the target, and of one of
the others, the one whose longest document is shortest, permuted documents, long ones
last.  That block's order is found from its documents' sizes and hashes alone, without their
columns, and comes down to one bound a source.  So the hot source is never ordered as a whole.

The taken block copies of all sources, as exact counts, are then divided among
output shards: at each node of a binary tree over the shards the left half
draws its share of every source's blocks from the multivariate hypergeometric
distribution, so each shard gets a random mixture and no block copy is used twice.
A source's permuted blocks are handed out in that order, and rows are shuffled
within their shard.  Everything is drawn from ``seed`` and ids: reruns agree.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.scratch import local_table

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Names that the mixture uses for itself; columns of these names are left out.
RESERVED = ("mix_size", "mix_source_size", "mix_target", "mix_shards", "mix_shard", "mix_copy", "mix_block", "mix_blocks", "mix_order", "mix_cut", "mix_plan_source", "mix_plan_block")
#: Blocks of all sources, in proportion to their bytes; each source has LEAST_BLOCKS too, or its share of MAX_BLOCKS where there are many.
MAX_BLOCKS, LEAST_BLOCKS = 1 << 16, 512
#: The driver plans so many sources at most; a table of more raises.
MAX_SOURCES = 100_000
#: Output shards: one for SHARD_BYTES of text, within these bounds.
SHARD_BYTES, LEAST_SHARDS, MOST_SHARDS = 256 << 20, 16, 4096
SEED = 42


def targets(sizes: dict[str | None, int], weights: dict[str | None, Fraction], most: int = MOST_REPEATS) -> dict[str | None, Fraction]:
    """Shares of the total size by weight; what is above ``most`` times a source's size is shared anew among the others."""
    out: dict[str | None, Fraction] = {}
    left = Fraction(sum(sizes.values()))
    open_ = {s for s in sizes if weights[s] > 0}
    while open_:
        weight = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / weight > most * sizes[s]}
        if not over:
            return {s: Fraction(0) for s in sizes} | out | {s: left * weights[s] / weight for s in open_}
        for s in over:
            out[s] = Fraction(most * sizes[s])
        left -= sum(out[s] for s in over)
        open_ -= over
    return {s: Fraction(0) for s in sizes} | out


def split(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """shards x sources: how many of each source's ``counts`` blocks each shard gets; shard sizes differ by rounding alone."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    total = int(counts.sum())
    drawn = rng.multivariate_hypergeometric(counts, total * left // shards, method="marginals") if total else counts
    return np.concatenate([split(drawn, left, rng), split(counts - drawn, shards - left, rng)])


def default_weights(sources: list[str | None]) -> dict[str | None, Fraction]:
    """5, 2, 1 repeating over the sources by code point, null last."""
    order = sorted((s for s in sources if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [None] * (None in sources)
    return {s: Fraction(WEIGHTS[k % len(WEIGHTS)]) for k, s in enumerate(order)}


def placements(docs: DataFrame, weights: dict[str | None, float] | None = None, blocks: int | None = None, shards: int | None = None, seed: int = SEED, most: int = MOST_REPEATS) -> DataFrame:
    """``docs`` with what the mix does with each row: columns mix_size, mix_source_size, mix_target, mix_shards.

    Takes ``doc_id``, ``text`` and ``source``; all columns are kept but those
    of RESERVED names.  mix_size: words of the text (null: 0).  mix_target: the row's
    source's target in words.  mix_shards: the shard of each time that the row is
    taken, an empty array if it is left out.  A null source is a source of its own,
    sorted last.  Rows without words are taken as often as their block is, ``most`` times at most; a
    source without words has target 0.  Rows that repeat id and text fall into one block,
    and in a block that is cut are taken alike.  An empty table gives no rows; more than MAX_SOURCES sources
    raise.  ``blocks``: of each source; ``shards``: of the mixture; by size, if None.
    """
    spark = docs.sparkSession
    docs = docs.drop(*RESERVED)
    found = docs.groupBy("source").agg(F.sum(F.octet_length("text")).alias("bytes")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    size_of = {r.source: r.bytes or 0 for r in found}
    all_bytes = max(1, sum(size_of.values()))
    least = max(1, min(LEAST_BLOCKS, MAX_BLOCKS // max(1, len(size_of))))
    dealt = [(s, blocks or least + MAX_BLOCKS * b // all_bytes // 2) for s, b in size_of.items()]
    shards = shards or min(MOST_SHARDS, max(LEAST_SHARDS, all_bytes // SHARD_BYTES))
    same = F.col("source").eqNullSafe(F.col("mix_plan_source"))
    dealing = local_table(spark, dealt, "mix_plan_source string, mix_blocks int")  # a row a source
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), "text")
    size = F.coalesce(F.expr(r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')"), F.lit(0)).cast("long")
    in_blocks = docs.join(F.broadcast(dealing), same, "left").withColumn("mix_block", F.pmod(hashed, "mix_blocks").cast("int")).drop("mix_plan_source", "mix_blocks")
    sums = in_blocks.groupBy("source", "mix_block").agg(F.sum(size).alias("words"), F.max(size).alias("longest")).collect()  # a row a block
    by: dict[str | None, dict[int, int]] = {}
    longest: dict[tuple[str | None, int], int] = {}
    for s, b, words, most_words in sums:
        by.setdefault(s, {})[b] = words
        longest[s, b] = most_words
    sizes = {s: sum(x.values()) for s, x in by.items()}
    given = default_weights(list(by)) if weights is None else {s: Fraction(weights.get(s, 0)) for s in by}
    goal = targets(sizes, given, most)
    order = [*sorted((s for s in by if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")), *([None] if None in by else [])]

    taken: dict[str | None, list[int]] = {}  # block copies in the order in which they are handed out; the last one may be in part
    partial: dict[str | None, tuple[int, float]] = {}
    for s in order:
        if not sizes[s]:
            taken[s] = []
            continue
        rng = _generator(seed, "blocks", s)
        whole = int(goal[s] // sizes[s])
        copies = [b for _ in range(whole) for b in rng.permutation(sorted(by[s])).tolist()]
        left = goal[s] - whole * sizes[s]
        aside = []
        for b in rng.permutation(sorted(by[s])).tolist() if left else []:
            if by[s][b] > left:
                aside.append(b)
                continue
            left -= by[s][b]
            copies.append(b)
        if aside:
            b = min(aside, key=lambda b, s=s: longest[s, b])
            partial[s] = (b, float(left))
            copies.append(b)
        taken[s] = copies
    counts = np.array([len(taken[s]) for s in order], np.int64)
    shares = split(counts, shards, _generator(seed, "tree", "")) if len(order) else np.zeros((shards, 0), np.int64)
    # the one block of each source that is taken in part: its documents by size, as a power of two, then in hash order, while half of the next fits
    ordered = F.struct(F.length(F.bin("mix_size")).alias("magnitude"), F.xxhash64(F.lit(seed), F.lit(1), "doc_id", "text").alias("hash"))
    cuts = local_table(spark, [(s, b, left) for s, (b, left) in partial.items()], "mix_plan_source string, mix_plan_block int, mix_cut double")
    # words are counted after the join: of the cut blocks' documents alone
    once = in_blocks.join(F.broadcast(cuts), same & (F.col("mix_block") == F.col("mix_plan_block"))).withColumn("mix_size", F.when(F.col("mix_cut").isNotNull(), size)).withColumn("mix_order", ordered).groupBy("source", "mix_order", "mix_cut").agg(F.sum("mix_size").alias("words"))
    running = Window.partitionBy("source").orderBy("mix_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = F.sum("words").over(running) - F.col("words") / 2 <= F.col("mix_cut")
    bounds = {r.source: (r.last.magnitude, r.last.hash) for r in once.withColumn("fits", fits).filter("fits").groupBy("source").agg(F.max("mix_order").alias("last")).collect()}  # a row a source
    plan = []
    for k, s in enumerate(order):
        where = np.repeat(np.arange(shards), shares[:, k])
        spots: dict[int, list[int]] = {}
        for b, shard in zip(taken[s], where.tolist(), strict=True):
            spots.setdefault(b, []).append(shard)
        cut = partial.get(s, (None, 0.0))[0]
        for b in by[s]:
            plan.append((s, b, spots.get(b, []), bounds.get(s, (-1, 0)) if b == cut else None, sizes[s], float(goal[s])))
    plan_table = local_table(spark, plan, "mix_plan_source string, mix_plan_block int, mix_shards array<int>, mix_cut struct<magnitude:int,hash:bigint>, mix_source_size long, mix_target double")
    sized = in_blocks.withColumn("mix_size", size).withColumn("mix_order", ordered)
    planned = sized.join(F.broadcast(plan_table), same & (F.col("mix_block") == F.col("mix_plan_block")), "left")  # a row a block
    left_out = F.col("mix_cut").isNotNull() & (F.col("mix_order") > F.col("mix_cut"))
    shards_of = F.when(left_out, F.slice("mix_shards", 1, F.size("mix_shards") - 1)).otherwise(F.col("mix_shards"))
    return planned.withColumn("mix_shards", shards_of).drop("mix_plan_source", "mix_plan_block", "mix_order", "mix_cut", "mix_block")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture: ``docs``' rows, each as often as it is taken, with its mix_shard, shuffled within shards."""
    seed = options.get("seed", SEED)
    placed = placements(docs, **options).select(*[c for c in docs.columns if c not in RESERVED], F.posexplode("mix_shards").alias("mix_copy", "mix_shard"))
    # the text as well: rows that repeat an id, or have none, are dealt and shuffled too
    return placed.repartition("mix_shard", F.pmod(F.xxhash64("doc_id", "mix_copy", "text"), F.lit(1024))).sortWithinPartitions("mix_shard", F.xxhash64(F.lit(seed), F.lit(2), "doc_id", "mix_copy", "text"))


def _generator(seed: int, *parts: object) -> np.random.Generator:
    """A generator of its own for each use, the same in each run."""
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr((seed, *parts)).encode()).digest()[:8]))
