"""Resampling documents towards a target distribution by hashed n-gram importance weights, in two Arrow passes.

The first pass counts the features of each partition with np.bincount into one vector a partition, which treeReduce
merges; the log ratio of the target's and the corpus's share is a bucket's gain. The second pass gathers the broadcast
gains of each document's features, sums them with bincount weights and adds Gumbel noise from a hash of doc_id, so that
taking the highest scores is sampling without replacement in proportion to the weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, in_batches, releasing, slices, table
from .partials import tree_sum

#: Bytes of texts that are split into words at once, and the longest word whose checksum is taken from tables.
PIECE, SHORT = 1 << 21, 64
OUT = "doc_id long, n_features long, weight long, score long"


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case byte, whether a byte belongs to a word, CRC-32 by byte, CRC-32 moved on by n zero bytes)."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, dtype=bool)
    word[48:58] = word[97:123] = word[128:] = True
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1).astype(np.uint32)
    moved = np.zeros((SHORT + 1, 4, 256), dtype=np.uint32)
    moved[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, SHORT + 1):
        moved[n] = crc[moved[n - 1] & 255] ^ (moved[n - 1] >> 8)
    return lower, word, crc, moved.ravel()


def _checksums(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of each word of data: a byte of all words at once; long words one by one."""
    crc = _tables()[2]
    out = np.full(len(begin), 0xFFFFFFFF, dtype=np.uint32)
    order = np.argsort(np.minimum(length, SHORT + 1).astype(np.uint8), kind="stable")
    sizes = length[order]
    state, at = out[order], begin[order]
    stop = int(np.searchsorted(sizes, SHORT, "right"))
    for k in range(int(sizes[stop - 1]) if stop else 0):
        lo = int(np.searchsorted(sizes[:stop], k, "right"))
        s = state[lo:stop]
        state[lo:stop] = crc[(s ^ data[at[lo:stop] + k]) & 255] ^ (s >> 8)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in order[stop:].tolist():
        out[i] = zlib.crc32(data[begin[i] : begin[i] + length[i]])
    return out


def _joined(data: np.ndarray, first: np.ndarray, begin: np.ndarray, length: np.ndarray, second: np.ndarray) -> np.ndarray:
    """CRC-32 of word, space, word, from the words' own: that of the front moved on by the second word's bytes, and the second's."""
    crc, moved = _tables()[2:]
    front = ~first
    front = ~(crc[(front ^ 32) & 255] ^ (front >> 8))
    long = np.flatnonzero(length > SHORT)
    row = np.where(length > SHORT, 0, length).astype(np.int64) * 1024
    out = second.copy()
    for k in range(4):
        out ^= moved[row + (256 * k) + ((front >> np.uint32(8 * k)) & 255)]
    for i in long.tolist():
        out[i] = zlib.crc32(data[begin[i] : begin[i] + length[i]], int(front[i]))
    return out


def features(texts: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bucket) of all features of the texts and (words) a row, for a piece of texts at a time.

    A null text has none. Long texts come in several pieces, cut between words; a pair across a cut is counted with the second word.
    """
    lower, is_word, _, _ = _tables()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset)
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if at[-1] else np.zeros(0, np.uint8)
    lo, held = int(at[0]), (-1, 0)  # the last word's row and checksum
    while lo < at[-1]:
        hi = min(lo + PIECE, int(at[-1]))
        while hi < at[-1] and is_word[lower[raw[hi]]] and is_word[lower[raw[hi - 1]]]:
            step = is_word[lower[raw[hi : hi + PIECE]]]
            hi += len(step) if step.all() else int(np.argmin(step))
        hi = min(hi, int(at[-1]))
        data = lower[raw[lo:hi]]
        own = is_word[data]
        bounds = np.unique(at[(at > lo) & (at < hi)]) - lo
        before = np.concatenate([[False], own[:-1]])
        before[bounds] = False
        begin = np.flatnonzero(own & ~before)
        after = np.concatenate([own[1:], [False]])
        after[bounds - 1] = False
        length = np.flatnonzero(own & ~after) + 1 - begin
        row = np.searchsorted(at, begin + lo, "right") - 1
        one = _checksums(data, begin, length)
        if len(begin):
            pair = np.flatnonzero(row[1:] == row[:-1]) + 1
            two = _joined(data, one[pair - 1], begin[pair], length[pair], one[pair])
            rows = [row, row[pair]]
            if held[0] == row[0]:
                two = np.concatenate([two, _joined(data, np.array([held[1]], np.uint32), begin[:1], length[:1], one[:1])])
                rows.append(row[:1])
            held = int(row[-1]), int(one[-1])
            yield np.concatenate(rows), np.concatenate([one, two]) % np.uint32(buckets), np.bincount(row, minlength=n)
        lo = hi


def counts(df: DataFrame, buckets: int = 10_000, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket. Null texts have none; no rows give zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in slices(batches):
            for _, bucket, _ in features(b.column(0), buckets):
                total += np.bincount(bucket, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["vector"])

    return tree_sum(in_batches(df.select(F.col(text).cast("string").alias("text"))).mapInArrow(releasing(run), "vector binary"), buckets)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the natural log of the target's share over the corpus's, both smoothed by one a bucket, rounded down."""
    n = len(corpus)
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_features, weight) of each row, repeated ones too: the mean gain of a document's features, rounded down; without any, 0."""
    sent, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value.astype(float)
        for b in slices(batches):
            n = b.num_rows
            total, words, alone = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for row, bucket, count in features(b.column(1), buckets):
                total += np.bincount(row, weights=gain[bucket], minlength=n)
                alone += np.bincount(row, minlength=n)
                words += count
            weight = np.where(alone > 0, total.astype(np.int64) // np.maximum(alone, 1), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(alone), pa.array(weight)], names=["doc_id", "n_features", "weight"])

    rows = in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return rows.mapInArrow(releasing(run), "doc_id long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """Each document's doc_id, n_features, weight, score and rank among those drawn (null: not drawn), towards the texts of target.

    `percent` of the documents of at least `least_words` words are drawn, rounded down: the highest scores, ties to the
    smaller doc_id (null last), repeated rows in any order. A null or empty text has no features, weight 0, and is not drawn.
    docs: doc_id, text and any other columns, which are left out; target: text. An empty target weighs all by rarity;
    an empty table gives no rows. All features of all texts count, and sums are of integers, so that no partitioning changes them.
    """
    scored = weigh(docs, gains(counts(docs, buckets), counts(target, buckets)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    drawable = F.col("n_features") >= max(2 * least_words - 1, 0)
    # `tie` is settled by the checkpoint; it lets equal rows fall into several ranges
    scored = cut(scored.select("doc_id", "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score"), drawable.alias("drawable"), F.monotonically_increasing_id().alias("tie")))
    order = [F.col("drawable").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tie")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(n, n + b.num_rows))], names=[*b.schema.names, "place"])
            n += b.num_rows

    ranged = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumn("part", F.spark_partition_id()).mapInArrow(number, "doc_id long, n_features long, weight long, score long, drawable boolean, tie long, part int, place long"))
    sizes = {r["part"]: (r["n"], r["d"] or 0) for r in placed.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.col("drawable").cast("long")).alias("d")).collect()}
    drawn, before, starts = sum(d for _, d in sizes.values()) * percent // 100, 0, []
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part][0]
    # a row a partition
    start = F.broadcast(docs.sparkSession.createDataFrame(starts, "part int, start long"))
    rank = F.col("start") + F.col("place") + 1
    return placed.join(start, "part", "left").select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))


def op11_target_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
