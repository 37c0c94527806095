"""Integer vectors that each partition sums for itself, merged in a tree over the executors."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame

#: At most about so many merged vectors reach the driver.
FAN_IN = 32
#: Numbers of a vector that are compressed as one piece, and unpacked at once.
BLOCK = 1 << 17


def pack(vector: np.ndarray) -> list[bytes]:
    """The vector as compressed blocks."""
    return [zlib.compress(np.ascontiguousarray(vector[at : at + BLOCK]), 1) for at in range(0, len(vector), BLOCK)]


def unpack(blocks: list[bytes], length: int, kind: type) -> np.ndarray:
    out = np.zeros(length, kind)
    for at, x in zip(range(0, length, BLOCK), blocks, strict=True):
        out[at : at + BLOCK] = np.frombuffer(zlib.decompress(x), kind)
    return out


def added(a: list[bytes], b: list[bytes], kind: type) -> list[bytes]:
    """The sum of two packed vectors, a block at a time: neither is unpacked as a whole."""
    return [zlib.compress(np.frombuffer(zlib.decompress(x), kind) + np.frombuffer(zlib.decompress(y), kind), 1) for x, y in zip(a, b, strict=True)]


def tree_sum(vectors: DataFrame, length: int, kind: type = np.int64) -> np.ndarray:
    """Sum of the vectors in the only column, `vector` (binary in machine order, or the blocks of `pack`), of which each partition gives any number.

    treeReduce merges them on the executors, as deep as it takes for no more than about FAN_IN to come to the driver.
    Integer sums don't depend on the order of merging. Vectors travel compressed, as most of theirs are zeros; large ones should come
    packed, so that no copy of theirs is whole in the JVM. No vectors give zeros.
    """
    packed = vectors.schema["vector"].dataType.typeName() == "array"
    rows = vectors.rdd
    n = rows.getNumPartitions()
    if not n:
        return np.zeros(length, kind)
    depth = 2
    while n ** (1 / depth) > FAN_IN:
        depth += 1

    def own(part):
        if packed:
            total = None
            for r in part:
                total = [*map(bytes, r[0])] if total is None else added(total, r[0], kind)
            yield pack(np.zeros(length, kind)) if total is None else total
        else:
            total = np.zeros(length, kind)
            for r in part:
                total += np.frombuffer(r[0], kind)
            yield pack(total)

    return unpack(rows.mapPartitions(own).treeReduce(lambda a, b: added(a, b, kind), depth), length, kind)
