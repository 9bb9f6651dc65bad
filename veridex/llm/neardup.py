"""Near-duplicate records with small edits, over a whole collection (problem 4)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import checkpoint, materialize
from .text import with_once

TREES = 10
DEPTH = 5  # signature values per tree
BITS = 12  # of each value; a tree's signature is one integer, the tree's number and then its first value in the highest bits
LEAST_DEPTH = 2  # values that neighbours of an order share at least
SKETCH = 0.44  # share of sketched values in which a pair worth counting may differ
#: Followers in a tree's order that a text is compared with. Those with the longest common prefix come first, so the depth adapts to
#: how crowded the region is; in a family of more texts than this, neighbours link it to one group.
NEIGHBOURS = 12
_SIZE_BITS = 20  # of the second sketch word hold the number of words
#: Bits of the mark of wanted texts, as a power of two: 16 MB.
MARKS = 27
#: Texts of a group per block; each pair of blocks is compared on its own.
BLOCK = 200
#: Words in at least this share of the texts are weighted by their frequency, all others alike. At most
#: (mean number of different words) / FREQUENT words can be that frequent, whatever the size of the collection.
FREQUENT = 0.005
#: Weight of all other words. Words that an edit brings in are mostly rare: at the weight of their rarity they would hide the copies.
RARE = 1.0
_ALL = 0  # stands for a word that every text has
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer: independent hash values of ``x`` per seed."""
    with np.errstate(over="ignore"):
        x = x ^ (np.uint64(seed + 1) * _MIX)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def signatures(bags: list[np.ndarray], frequent: np.ndarray, weights: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted min-hash signatures (records x TREES, 64 bits) and sketches (two bits a value, in 2 words) of bags of word hashes.

    The word of least -ln(u) / weight stands for its bag, so two bags agree in a value with the probability of their weighted
    Jaccard similarity. ``frequent`` (sorted) and ``weights`` give the weights of frequent words; others weigh ``most``.
    """
    sizes = np.array([len(b) for b in bags])
    unique, at = np.unique(np.concatenate(bags).astype(np.int64), return_inverse=True)
    weight = np.full(len(unique), most, np.float32)
    if len(frequent):
        i = np.minimum(np.searchsorted(frequent, unique), len(frequent) - 1)
        weight = np.where(frequent[i] == unique, weights[i].astype(np.float32), weight)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    keys = unique.view(np.uint64)
    trees, bits = np.zeros((len(bags), TREES), np.int64), np.zeros((len(bags), 2), np.uint64)
    rank = np.empty(len(unique), np.int32)
    for k in range(TREES * DEPTH):
        h = _mixed(keys, k)
        u = ((h >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) / np.float32(2**24)
        # ranks hold priority and word in one integer, so that one reduction finds the least and whose it is
        order = np.argsort(-np.log(u) / weight, kind="stable")
        rank[order] = np.arange(len(unique), dtype=np.int32)
        value = h[order[np.minimum.reduceat(rank[at], starts)]]
        trees[:, k // DEPTH] = (trees[:, k // DEPTH] << BITS) | (value & np.uint64(2**BITS - 1)).astype(np.int64)
        for bit in (2 * k, 2 * k + 1):  # 2 * TREES * DEPTH + _SIZE_BITS fit two words
            bits[:, bit // 64] |= ((value >> np.uint64(20 + bit % 2)) & np.uint64(1)) << np.uint64(bit % 64)
    return trees, bits.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, weights: np.ndarray, most: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        lists = b.column("bag")
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        ends = ends - ends[0]
        trees, bits = signatures([flat[ends[i] : ends[i + 1]] for i in range(b.num_rows)], frequent, weights, most)
        size = np.minimum(b.column("n").to_numpy(), 2**_SIZE_BITS - 1).astype(np.uint64)  # texts beyond it agree in size and are counted
        bits[:, 1] = (bits[:, 1].view(np.uint64) | (size << np.uint64(64 - _SIZE_BITS))).view(np.int64)
        sigs = pa.ListArray.from_arrays(pa.array(np.arange(0, trees.size + 1, TREES, dtype=np.int32)), pa.array(trees.ravel()))
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("raw"), b.column("h1"), b.column("h2"), sigs, pa.array(bits[:, 0]), pa.array(bits[:, 1])], names=["key", "raw", "h1", "h2", "sig", "f1", "f2"])


def _weights(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashes of the frequent words and their inverse document frequencies, counted over all ``texts`` (text STRING); the weight of others.

    Words are cut at blanks alone here: what a weight needs is how common a word is, not every place it has.
    """
    cut = F.transform(F.array_distinct(F.split(F.lower("text"), " ")), lambda w: F.xxhash64(w))
    counted = texts.select(F.explode(F.concat(F.array(F.lit(_ALL).cast("bigint")), cut)).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    counted = checkpoint(counted.where((F.col("df") > 1) | (F.col("w") == _ALL)))
    total = sum(r["df"] for r in counted.where(F.col("w") == _ALL).collect())
    common = counted.where((F.col("df") >= max(2.0, FREQUENT * total)) & (F.col("w") != _ALL)).toPandas().sort_values("w")  # bounded, see FREQUENT
    most = -np.log(FREQUENT)
    return common["w"].to_numpy(np.int64), np.clip(np.log(max(total, 1) / np.maximum(common["df"].to_numpy(float), 1.0)), 0.02, most), RARE


def _neighbours(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """From rows (t, s, f1, f2) in order: (a, b) of texts near each other whose sizes and sketches agree, and the first and last rows of the
    task (kind 1), which have neighbours in other tasks."""
    most, mask, low = round(TREES * DEPTH * SKETCH), np.uint64(2 ** (64 - _SIZE_BITS) - 1), np.uint64(0x5555555555555555)
    held: list[np.ndarray] | None = None
    head: list[np.ndarray] | None = None

    def met(cols: list[np.ndarray], new: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a row with one of the NEIGHBOURS before it, where at least the last ``new`` rows come second."""
        t, s, f1, f2 = cols
        prefix, words_in, f1, f2 = s >> (BITS * (DEPTH - LEAST_DEPTH)), (f2.view(np.uint64) >> np.uint64(64 - _SIZE_BITS)).astype(float), f1.view(np.uint64), f2.view(np.uint64) & mask
        left, right = [], []
        for j in range(1, min(NEIGHBOURS, len(t) - 1) + 1):
            x, y = slice(max(0, len(t) - new - j), len(t) - j), slice(max(j, len(t) - new), len(t))
            at = np.flatnonzero(prefix[x] == prefix[y])
            n, m = words_in[x][at], words_in[y][at]
            at = at[np.minimum(n, m) >= least * np.maximum(n, m)]
            # two bits a value: it differs if either does
            d1, d2 = f1[x][at] ^ f1[y][at], f2[x][at] ^ f2[y][at]
            apart = np.bitwise_count((d1 | d1 >> np.uint64(1)) & low).astype(np.int64) + np.bitwise_count((d2 | d2 >> np.uint64(1)) & low)
            at = at[apart <= most]
            left.append(t[x][at])
            right.append(t[y][at])
        return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def out(kind: int, a: np.ndarray, b: np.ndarray, rest: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), *map(pa.array, rest)], names=["kind", "a", "b", "f1", "f2"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in ("t", "s", "f1", "f2")]
        if head is None or len(head[0]) < NEIGHBOURS:
            head = cols if head is None else [np.concatenate(x) for x in zip(head, cols, strict=True)]
            head = [x[:NEIGHBOURS] for x in head]
        joined = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        a, b = met(joined, len(cols[0]))
        none = np.zeros(len(a), np.int64)
        yield out(0, np.minimum(a, b), np.maximum(a, b), [none, none])
        held = [x[-NEIGHBOURS:] for x in joined]
    if head is not None:
        for t, s, f1, f2 in (head, held):
            yield out(1, t, s, [f1, f2])


def _candidates(texts: DataFrame, least: float) -> DataFrame:
    """(a, b): ids of ``texts`` (t, sig, f1, f2) that are neighbours in some tree's order and whose sketches agree.

    The orders of all trees are one sort, cut into ranges: a crowded region is split like any other. Texts of equal signatures follow a
    hash of their ids that differs by tree. What lies on both sides of a cut is compared afterwards, in one small sort.
    """
    entries = texts.select("t", "f1", "f2", F.posexplode("sig").alias("tree", "v")).select("t", F.expr(f"shiftleft(cast(tree as bigint), {BITS * DEPTH}) | v").alias("s"), "f1", "f2")
    order = [F.col("s"), F.xxhash64("t", "s")]
    near = "kind int, a long, b long, f1 long, f2 long"
    walked = materialize(entries.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda it: _neighbours(it, least), near).where("kind = 1 or a <> b"))
    # 2 * NEIGHBOURS rows a task
    cuts = walked.where("kind = 1").select(F.col("a").alias("t"), F.col("b").alias("s"), "f1", "f2").distinct()
    across = cuts.repartition(1).sortWithinPartitions(*order).mapInArrow(lambda it: _neighbours(it, least), near)
    return walked.where("kind = 0").select("a", "b").unionByName(across.where("kind = 0").select("a", "b")).distinct()


def _within_groups(links: DataFrame, counted: DataFrame, least: float) -> DataFrame:
    """(a, b): all pairs of texts of ``counted`` (t, w) that agree within the connected groups of ``links`` of three texts or more.

    A group is cut into blocks by a hash and every pair of blocks is a join key of its own, so a large one is spread.
    """
    groups = checkpoint(connected_components(links, "a", "b"))
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.count("*").alias("c")).where("c > 2").drop("c")
    placed = groups.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).join(counted.withColumnRenamed("t", "id"), "id")
    left = placed.select("component", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), F.col("id").alias("a"), F.col("w").alias("wa"))
    right = placed.select("component", F.explode(F.sequence(F.lit(0).cast("bigint"), "block")).alias("i"), F.col("block").alias("j"), F.col("id").alias("b"), F.col("w").alias("wb"))
    both = left.join(right, ["component", "i", "j"]).where("(i < j or a < b)" + f" and least(size(wa), size(wb)) >= {least} * greatest(size(wa), size(wb))")
    return both.where(_agree(least)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _marked(df: DataFrame, hashed: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose hash may be in ``wanted`` (one column): all that are, few others, and none is moved.

    A bitmap of 2^MARKS bits, the same size for any input, is built by a mergeable aggregate and broadcast; it lets more pass as it fills up.
    """
    at = lambda c: F.pmod(c, F.lit(2**MARKS))
    bits = wanted.select(at(F.col(wanted.columns[0])).alias("x")).groupBy(F.expr("x div 32768").alias("__page")).agg(F.bitmap_construct_agg(F.expr("x % 32768")).alias("__bits"))  # at most 2^MARKS / 32768 rows of 4 KB
    place = at(F.col(hashed))
    met = df.withColumn("__page", F.floor(place / 32768)).withColumn("__at", place % 32768).join(F.broadcast(bits), "__page")
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return met.withColumn("__byte", byte).where(F.expr("(shiftright(__byte, cast(__at % 8 as int)) & 1) = 1")).drop("__page", "__at", "__bits", "__byte")


def _agree(least: float) -> Column:
    return F.size(F.array_intersect("wa", "wb")) >= F.lit(least) * F.greatest(F.size("wa"), F.size("wb"))


def near_duplicate_records(df: DataFrame, key: Column, words: Column, short: Column, raw: Sequence[str], least_words: int = 30, least: float = 0.7) -> DataFrame:
    """Pairs of keys that have texts whose words agree for at least ``least`` of the longer one: (key_a < key_b STRING).

    LSH forest: every text (a bag of words; rows with equal bags are one text) gets TREES sorted orders of min-hash signatures,
    weighted by how common a word is in the whole collection. Candidates are a text's NEIGHBOURS next ones in each order that share
    LEAST_DEPTH signature values or more: those of the longest common prefix, so sparse regions compare generously and crowded ones
    strictly. They are compared by size and sketch; what passes is counted exactly, word for word with repetitions. What
    these comparisons leave out of a family of copies is made good by groups: texts linked by counted pairs, directly or through
    others, are one group, and every pair of a group is counted. Only texts that some pair needs are read again for the count.

    Two texts of equal length that agree in 70 % of their words (a Jaccard similarity of 0.54), and have no other copies, are neighbours in some
    order with a probability of about 0.97 where no region is crowded and pass the sketch with 0.94, together 0.91; at 75 % 0.98, at 80 % 0.99.

    Rows with a null key, without words, or with fewer than ``least_words`` words besides those of ``short`` (the title) are left out; repeated rows count once; copies of one text
    under different keys are pairs as well. ``raw`` names the columns that ``words`` is made of. Empty input gives an empty result.
    """
    source = df.select(key.alias("key"), F.xxhash64(*raw).alias("raw"), words.alias("words"), short.alias("other"))
    rows = with_once(source, "w", F.sort_array("words"))
    rows = rows.where(F.col("key").isNotNull() & (F.size("w") - F.size("other") >= least_words) & (F.size("w") > 0))
    named = rows.select("key", "raw", "w", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit("second"), "w").alias("h2"))
    bags = named.select("key", "raw", "h1", "h2", F.transform(F.array_distinct("w"), lambda w: F.xxhash64(w)).alias("bag"), F.size("w").alias("n"))
    written = df.select(F.concat_ws(" ", *raw).alias("text"))
    frequent, weights, most = _weights(written)
    schema = "key string, raw long, h1 long, h2 long, sig array<long>, f1 long, f2 long"
    signed = materialize(bags.mapInArrow(lambda it: _signed(it, frequent, weights, most), schema))
    texts = signed.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.when(F.min("key") == F.max("key"), F.xxhash64(F.min("key"))).alias("only"), *[F.first(c).alias(c) for c in ("raw", "sig", "f1", "f2")])
    texts = materialize(texts.withColumn("t", F.monotonically_increasing_id()))
    only = texts.select("t", "only")
    found = _candidates(texts.select("t", "sig", "f1", "f2"), least).join(only.withColumnsRenamed({"t": "a", "only": "ka"}), "a").join(only.withColumnsRenamed({"t": "b", "only": "kb"}), "b")
    pairs = checkpoint(found.where("ka is null or kb is null or ka <> kb").select("a", "b"))  # versions of one key's text are no pair

    wanted = checkpoint(pairs.select(F.col("a").alias("t")).union(pairs.select("b")).distinct().join(texts.select("t", "raw"), "t"))
    # few texts are wanted: hardly any other is moved or cut into words again
    kept = _marked(df.withColumn("__raw", F.xxhash64(*raw)), "__raw", wanted.select("raw"))
    again = kept.join(wanted.select(F.col("raw").alias("__raw"), F.col("t").alias("__t")), "__raw").select(F.col("__t").alias("t"), F.sort_array(words).alias("w"))
    numbered = again.select("t", F.transform("w", lambda x, i: F.hash(x, F.when(F.get("w", i - 1) == x, i - F.array_position("w", x)).otherwise(-1))).alias("w")).groupBy("t").agg(F.first("w").alias("w"))
    numbered = materialize(numbered)
    both = pairs.join(numbered.select(F.col("t").alias("a"), F.col("w").alias("wa")), "a").join(numbered.select(F.col("t").alias("b"), F.col("w").alias("wb")), "b")
    links = checkpoint(both.where(_agree(least)).select("a", "b"))
    links = checkpoint(links.unionByName(_within_groups(links, numbered, least)).distinct())
    named_by = links.select(F.col("a").alias("t")).union(links.select("b")).union(texts.where("copies > 1").select("t")).distinct().join(texts.select("t", "h1", "h2"), "t")
    members = checkpoint(signed.select("key", "h1", "h2").join(named_by, ["h1", "h2"]).select("t", "key").distinct())
    left, right = members.select(F.col("t").alias("a"), F.col("key").alias("ka")), members.select(F.col("t").alias("b"), F.col("key").alias("kb"))
    across = links.join(left, "a").join(right, "b").select("ka", "kb").where("ka <> kb")
    same = left.join(right, F.col("a") == F.col("b")).where("ka < kb").select("ka", "kb")
    return across.unionByName(same).select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()
