"""Evaluation texts that leaked into training texts (problem 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import bounded, checkpoint, materialize
from .text import with_once, words

GRAM = 4
PASSAGE = 20  # words of an item from which a shared passage counts
EDITS = 8  # one word in so many may be changed or left out
LOST = PASSAGE // EDITS
#: Runs of a passage's window, and how many of them are sure to be left beside the edits.
WINDOW = PASSAGE - GRAM + 1
HITS = WINDOW - GRAM * LOST - LOST
#: The rarest runs of every window that are its seeds, and how many of them are left beside the edits.
SEEDS = 11
LEFT = SEEDS - GRAM * LOST
BAND = 16
#: An alignment of a passage with its edited copy keeps at least this many words: an edit at the third word from an end costs the two beside it as well.
MATCHED = PASSAGE - 3 * LOST


def _grams(c: Column) -> Column:
    """Hash of every run of GRAM words, in order; empty for shorter texts."""
    n = F.size(c) - (GRAM - 1)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(*[F.element_at(c, (i + k).cast("int")) for k in range(GRAM)]))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<bigint>"))


def align(segments: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman over words, many pairs at once: rows of (matched words, item words spanned) of the best local alignment.

    A match scores 1, a changed, missing or added word -2. All pairs of a batch advance together, one anti-diagonal at a time.
    """
    B, m, n = len(items), max(map(len, segments)), max(map(len, items))
    a, b = np.full((B, m), -1, np.int64), np.full((B, n), -2, np.int64)
    for k, (x, y) in enumerate(zip(segments, items, strict=True)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    # state per cell, indexed by item position: score, matched words, item position where the alignment began
    shape = (B, n + 1)
    score = [np.zeros(shape, np.int16) for _ in range(3)]
    hits = [np.zeros(shape, np.int16) for _ in range(3)]
    begin = [np.tile(np.arange(n + 1, dtype=np.int16), (B, 1)) for _ in range(3)]
    best, result = np.zeros(B, np.int16), np.zeros((B, 2), np.int16)
    fresh = np.arange(n + 1, dtype=np.int16)
    for d in range(2, m + n + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        j = np.arange(lo, hi + 1)
        same = a[:, d - j - 1] == b[:, j - 1]
        prev, last = (d - 1) % 3, (d - 2) % 3
        diagonal = score[last][:, lo - 1 : hi] + np.where(same, 1, -2).astype(np.int16)
        up, left = score[prev][:, lo : hi + 1] - np.int16(2), score[prev][:, lo - 1 : hi] - np.int16(2)
        s, h, g = diagonal, hits[last][:, lo - 1 : hi] + same, begin[last][:, lo - 1 : hi]
        for other, oh, og in ((up, hits[prev][:, lo : hi + 1], begin[prev][:, lo : hi + 1]), (left, hits[prev][:, lo - 1 : hi], begin[prev][:, lo - 1 : hi])):
            more = other > s
            s, h, g = np.where(more, other, s), np.where(more, oh, h), np.where(more, og, g)
        none = s <= 0
        s, h, g = np.where(none, 0, s), np.where(none, 0, h), np.where(none, fresh[lo : hi + 1], g)
        now = d % 3
        score[now][:], hits[now][:], begin[now][:] = 0, 0, fresh
        score[now][:, lo : hi + 1], hits[now][:, lo : hi + 1], begin[now][:, lo : hi + 1] = s, h, g
        top = s.argmax(1)
        rows = np.flatnonzero(s[np.arange(B), top] > best)
        if len(rows):
            t = top[rows]
            best[rows] = s[rows, t]
            result[rows] = np.stack([h[rows, t], lo + t - g[rows, t]], 1)
    return result


def holds_passage(segment: np.ndarray, item: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """(words kept, words from first to last) of the longest run of at least PASSAGE item words of which no more than one in EDITS is lost in ``segment``; (0, 0) if there is none.

    The words are aligned within the diagonals ``low`` to ``high`` (place in the segment less place in the item), a lost word costing half of
    what a kept one adds, and the alignment goes on past its ends, so that a word beyond two edits at an end counts.
    """
    m, n, width = len(segment), len(item), high - low + 1
    score = np.zeros((n + 1, width + 2), np.int32)  # column k + 1: the diagonal low + k
    came = np.zeros((n + 1, width + 2), np.int8)  # 0 begins here, 1 diagonal, 2 item word left out, 3 word added
    best, at = 0, (0, 0)
    seg, it = segment.tolist(), item.tolist()
    for j in range(1, n + 1):
        above, own, way, word = score[j - 1].tolist(), [0] * (width + 2), [0] * (width + 2), it[j - 1]
        for k in range(1, width + 1):
            i = j + low + k - 1
            if i < 1 or i > m:
                continue
            top, move = above[k] + (2 if seg[i - 1] == word else -1), 1
            if above[k + 1] - 1 > top:
                top, move = above[k + 1] - 1, 2
            if own[k - 1] - 1 > top:
                top, move = own[k - 1] - 1, 3
            if top > 0:
                own[k], way[k] = top, move
                if top > best:
                    best, at = top, (j, k)
        score[j], came[j] = own, way
    kept = np.zeros(n, np.int32)
    j, k = at
    last = (j, j + low + k - 1)
    while j > 0 and came[j, k]:
        if came[j, k] == 1:
            kept[j - 1] = seg[j + low + k - 2] == it[j - 1]
            j -= 1
        elif came[j, k] == 2:
            j, k = j - 1, k + 1
        else:
            k -= 1
    first = (j, j + low + k - 1)
    for (j, i), step in ((first, -1), (last, 1)):
        # what lies beyond an end begins with edits; the words after them count where they follow on one diagonal
        tries = []
        for shift in range(-LOST, LOST + 1):
            own = []
            for d in range(LOST + 1):
                b, a = (j - 1 - d, i - 1 - d + shift) if step < 0 else (j + d, i + d + shift)
                if 0 <= b < n and 0 <= a < m and seg[a] == it[b]:
                    own.append(b)
            tries.append(own)
        kept[max(tries, key=len)] = 1
    total = np.concatenate([[0], np.cumsum(kept)])
    for size in range(n, PASSAGE - 1, -1):
        held = total[size:] - total[:-size]
        if held.max() >= size - size // EDITS:
            return int(held.max()), size
    return 0, 0


def _aligned(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            b = batch.slice(i, step)
            segments, items = ([np.asarray(x, np.int64) for x in b.column(c).to_pylist()] for c in ("segment", "item"))
            near = np.flatnonzero(align(segments, items)[:, 0] >= MATCHED)
            lows, highs = b.column("low").to_numpy(), b.column("high").to_numpy()
            found = np.array([holds_passage(segments[k], items[k], int(lows[k]), int(highs[k])) for k in near], np.int32).reshape(-1, 2)
            at = pa.array(near)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("item_id").take(at), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["doc_id", "item_id", "matched", "spanned"])


def seed_runs(item_grams: DataFrame, frequency: DataFrame) -> DataFrame:
    """(item_id, ipos, g): the SEEDS rarest runs of every window of PASSAGE item words, by the number of documents that hold them.

    ``item_grams`` has item_id, ipos, g, ``frequency`` g and df. Every window is covered whatever its runs are, and a stock phrase is a seed only of
    a window that holds little else. A window is one item's: these groups are bounded by PASSAGE.
    """
    rated = item_grams.join(frequency, "g", "left").select("item_id", "n", "ipos", "g", F.coalesce("df", F.lit(0)).alias("df"))
    starts = F.sequence(F.greatest(F.lit(1), F.col("ipos") - (WINDOW - 1)), F.greatest(F.lit(1), F.least(F.col("ipos"), F.col("n") - PASSAGE + 1)))
    inside = rated.select("item_id", "ipos", "g", "df", F.explode(starts).alias("window"))
    rank = F.row_number().over(W.partitionBy("item_id", "window").orderBy("df", "ipos"))
    return inside.withColumn("r", rank).where(F.col("r") <= SEEDS).select("item_id", "ipos", "g").distinct()


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item, whole or in part and possibly altered.

    Runs of four words are counted over all documents. The rarest runs of every window of 20 item words are its seeds: so many that some are left
    beside the edits allowed, wherever these lie. Documents meet items through seeds alone; a pair with enough of them on one band of
    diagonals is looked at again, all runs of the item on that part of the document are counted, and what keeps enough of them is scored by
    Smith-Waterman alignment; last, the run of item words it keeps is checked exactly.

    Result: doc_id, item_id, matched, spanned INT, one row per pair in which some 20 or more consecutive words of the item (``spanned``; ``matched`` of
    them in place) have lost at most one in eight. Items of fewer than 20 words cannot match. Items and documents with null ids or without
    words match nothing; repeated rows count once; a document longer than any other is one row of word hashes. The items' seeds are broadcast where
    their number is checked to be small, or joined by shuffle.
    """
    hashed = lambda c: F.transform(c, lambda w: F.hash(w))
    d = with_once(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id is not null"), "w", hashed(words(F.col("text"))))
    d = materialize(d.where(F.size("w") >= PASSAGE - LOST).select("doc_id", "w"))
    it = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), hashed(words(F.col(f"`{item_text}`"))).alias("item")).where("item_id is not null").dropDuplicates(["item_id"])
    it = checkpoint(it.where(F.size("item") >= PASSAGE))
    item_grams = checkpoint(it.select("item_id", F.size("item").alias("n"), F.posexplode(_grams(F.col("item"))).alias("p", "g")).select("item_id", "n", (F.col("p") + 1).alias("ipos"), "g"))
    small = lambda x: bounded(x, 200_000)
    # a document counts once per run, before anything is moved; what is counted are the items' runs alone
    once = d.select(F.explode(F.array_distinct(_grams(F.col("w")))).alias("g"))
    frequency = once.join(small(item_grams.select("g").distinct()), "g", "left_semi").groupBy("g").agg(F.count("*").alias("df"))
    seeds = checkpoint(seed_runs(item_grams, frequency))
    runs = d.select("doc_id", F.posexplode(_grams(F.col("w"))).alias("p", "g"))
    diagonal = runs.join(small(seeds), "g").select("doc_id", "item_id", (F.col("p") + 1 - F.col("ipos")).alias("diag"))
    half = BAND // 2
    banded = diagonal.select("doc_id", "item_id", "diag", F.explode(F.array(F.floor(F.col("diag") / half), F.floor(F.col("diag") / half) - 1)).alias("band"))
    # a document's runs lie in one task, so this is summed before the shuffle; a phrase repeated in a document only makes more candidates
    counted = banded.groupBy("doc_id", "item_id", "band").agg(F.count("*").alias("runs"), F.min("diag").alias("least"), F.max("diag").alias("most")).where(F.col("runs") >= LEFT)
    candidates = checkpoint(counted.groupBy("doc_id", "item_id", F.floor(F.col("band") / 2).alias("part")).agg(F.min("least").alias("least"), F.max("most").alias("most")))
    start = F.greatest(F.lit(1), F.col("least") + 1 - BAND)
    length = F.col("most") + F.size("item") + BAND - start + 1
    # the documents go first: their words are moved once, whatever the number of candidates
    met = d.join(candidates, "doc_id").join(small(it), "item_id")
    cut = with_once(met, "segment", F.slice("w", start, F.greatest(length, F.lit(1)))).select("doc_id", "item_id", "segment", "item", (F.col("least") - start - half + 1).cast("int").alias("low"), (F.col("most") - start + half + 1).cast("int").alias("high"))
    kept = cut.where(F.size(F.array_intersect(_grams(F.col("segment")), _grams(F.col("item")))) >= HITS)
    scored = kept.mapInArrow(_aligned, "doc_id long, item_id long, matched int, spanned int").where("matched > 0")
    return scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "spanned")).alias("x")).select("doc_id", "item_id", "x.matched", "x.spanned")
