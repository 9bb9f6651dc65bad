"""Filling containers of fixed capacity with items of varying length (problem 8)."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpoint

#: Items that one stream packs; it bounds a task's memory (about 16 bytes an item).
STREAM = 50_000
#: Containers filled to at least this share stay closed; the others are poured into a second, smaller set of streams.
CLOSED = 0.98
#: The ranks of a public byte-level BPE and its word pattern.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoding(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(vocabulary), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _counted(batches: Iterator[pa.RecordBatch], vocabulary: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encode = _encoding(vocabulary, pattern).encode_ordinary
    for b in batches:
        n = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])


def token_counts(df: DataFrame, doc_id: str, text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens) by a public tokenizer over whole texts; a null or empty text has 0. Rows with a null id are left out."""
    d = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).where("doc_id is not null")
    return d.mapInArrow(lambda it: _counted(it, vocabulary, pattern), "doc_id long, n_tokens long")


def pack_stream(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, placed one by one by the sum-of-squares rule.

    An array holds how many open containers there are at every fill level; an item goes to the level (0 is a new container) where the
    sum of the squares of these counts becomes least, ties to the fullest. Sizes lie in 1..capacity.
    """
    counts = np.zeros(capacity + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, made = np.empty(len(sizes), np.int64), 0
    far = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        # taking a container from level h changes the sum by 1 - 2 counts[h], adding one at h + s by 1 + 2 counts[h + s];
        # full containers (level capacity) and new ones (level 0) are not counted
        room = capacity - s
        change = 1 - 2 * counts[: room + 1]
        change[0] = 0
        change[:room] += 1 + 2 * counts[s:capacity]
        change[1:][counts[1 : room + 1] == 0] = far
        h = room - int(change[::-1].argmin())
        if h:
            box = open_[h].pop()
            counts[h] -= 1
        else:
            box, made = made, made + 1
        out[i] = box
        if h + s < capacity:
            open_[h + s].append(box)
            counts[h + s] += 1
    return out


def _packed(key: tuple, pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["o", "item", "part"])
    return pd.DataFrame({"item": pdf["item"].to_numpy(), "part": pdf["part"].to_numpy(), "size": pdf["size"].to_numpy(), "stream": key[0], "box": pack_stream(pdf["size"].to_numpy(np.int64), capacity)})


def pack(items: DataFrame, item_id: str, size: str, capacity: int = 2048) -> DataFrame:
    """Containers of ``capacity`` for all items, none split unless it is longer than a container.

    A longer item is cut into full containers and a rest, which is packed like any other item. Items are spread over streams of about
    STREAM items by a hash of their id, so a stream is bounded and the same on every run. Within a stream the sum-of-squares rule keeps
    few containers partly filled; those left under CLOSED at the end are items of a second set of streams, and are
    poured together there, contents and all.

    Result: item_id, part INT (0, or 1, 2, ... of a cut item), size BIGINT, container STRING. Sizes that are null or below 1 take no room and are
    left out, as are null ids; an id given more than once is packed as often. An empty table gives an empty result.
    """
    d = items.select(F.col(f"`{item_id}`").cast("long").alias("item"), F.col(f"`{size}`").cast("long").alias("size")).where("item is not null and size >= 1")
    full = F.when(F.col("size") > capacity, F.floor(F.col("size") / capacity)).otherwise(0).cast("int")
    cut = d.withColumn("full", full).withColumn("rest", F.when(F.col("size") > capacity, F.col("size") % capacity).otherwise(F.col("size")))
    whole = cut.where("full > 0").select("item", F.explode(F.expr("sequence(1, full)")).alias("part"), F.lit(capacity).cast("long").alias("size"))
    again = F.row_number().over(W.partitionBy("item", "part").orderBy("size"))  # of full containers alone; the same names on every run
    whole = whole.withColumn("again", again).select("item", "part", "size", F.concat_ws("-", F.lit("w"), "item", "part", "again").alias("container"))
    rest = checkpoint(cut.where("rest > 0").select("item", F.when(F.col("full") > 0, F.col("full") + 1).otherwise(0).alias("part"), F.col("rest").alias("size")))

    def streams(x: DataFrame, n: int) -> DataFrame:
        h = F.xxhash64("item", "part")
        keyed = x.select("item", "part", "size", F.pmod(h, F.lit(max(1, -(-n // STREAM)))).alias("stream"), F.xxhash64(h).alias("o"))
        return keyed.groupBy("stream").applyInPandas(lambda key, pdf: _packed(key, pdf, capacity), "item long, part int, size long, stream long, box long")

    first = checkpoint(streams(rest, rest.count()))
    boxes = first.groupBy("stream", "box").agg(F.sum("size").alias("fill"))
    left = checkpoint(boxes.where(F.col("fill") < CLOSED * capacity).select(F.col("stream").alias("item"), F.col("box").cast("int").alias("part"), F.col("fill").alias("size")))
    second = streams(left, left.count()).select(F.col("item").alias("stream"), F.col("part").cast("long").alias("box"), F.concat(F.lit("b-"), F.col("stream").cast("string"), F.lit("-"), F.col("box").cast("string")).alias("container"))
    placed = first.join(second, ["stream", "box"], "left")
    container = F.coalesce("container", F.concat(F.lit("a-"), F.col("stream").cast("string"), F.lit("-"), F.col("box").cast("string")))
    return placed.select("item", "part", "size", container.alias("container")).unionByName(whole).withColumnRenamed("item", item_id)
