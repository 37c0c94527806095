"""SimHash near-duplicates found by Golay-code keys.

The binary Golay code of length 23 is perfect: each 23-bit word lies within 3 bits of exactly one of
4096 codewords. The keys of a segment are the codewords of all words within one bit of it (1 to 7,
5 on average); two segments that differ in at most 2 bits share a key. Fingerprints that share a composed key
are compared in full, so keys decide what is compared and never what is linked.

Where a similarity is asked for, keys and distances (and MinHash keys, as Golay keys alone miss a part) only name
candidates, and the shingle sets themselves decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import components, cut, releasing, slices, table

_GENERATOR = 0xAE3  # x^11+x^9+x^7+x^6+x^5+x+1


def _syndromes() -> np.ndarray:
    words = np.arange(1 << 12, dtype=np.uint32) << 11
    for bit in range(22, 10, -1):
        words ^= np.where(words >> bit & 1, np.uint32(_GENERATOR << (bit - 11)), 0).astype(np.uint32)
    return words  # of the upper 12 bits; the lower 11 are a syndrome already


class Golay:
    """Decoding tables of the [23, 12, 7] code, built from its generator."""

    def __init__(self) -> None:
        self.upper = _syndromes()
        self.error = np.zeros(1 << 11, dtype=np.uint32)
        for n in range(4):
            for at in combinations(range(23), n):
                e = np.array([sum(1 << i for i in at)], dtype=np.uint32)
                self.error[self.syndrome(e)] = e

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.upper[words >> 11] ^ (words & 0x7FF)

    def decode(self, words: np.ndarray) -> np.ndarray:
        """Numbers (12 bits) of the nearest codewords."""
        return (words ^ self.error[self.syndrome(words)]) >> 11

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, codeword, whether it is the row's own) for all codewords nearest to a word within one bit."""
        near = words[:, None] ^ np.concatenate([[0], 1 << np.arange(23)]).astype(np.uint32)[None, :]
        own = self.decode(words)
        found = np.sort(self.decode(near), axis=1)
        new = np.ones(found.shape, dtype=bool)
        new[:, 1:] = found[:, 1:] != found[:, :-1]
        row, col = np.nonzero(new)
        return row, found[row, col], found[row, col] == own[row]


_GOLAY: list[Golay] = []


def golay() -> Golay:
    if not _GOLAY:
        _GOLAY.append(Golay())
    return _GOLAY[0]


def _shingles(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each run of `shingle` words, a shorter text being one, in parts."""
    tokens = text.lower().split()
    if not tokens:
        return
    joined, ends = b" ".join(tokens), list(accumulate(map(len, tokens), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[shingle - 1 :] or ends[-1:]
    for k in range(0, len(last), 50_000):
        yield np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[k : k + 50_000], last[k : k + 50_000])], dtype=np.uint64)  # noqa: B905


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct shingle hashes in order."""
    return np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *_shingles(text, shingle)]))


def _simhash(parts: Iterable[np.ndarray], words: int) -> np.ndarray:
    count, n = np.zeros((words, 64), dtype=np.int64), 0
    for h in parts:
        n += len(h)
        for i in range(words):
            if i:
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                h ^= h >> np.uint64(33)
            count[i] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * count > n, axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprint(text: bytes, shingle: int, words: int) -> np.ndarray:
    """`words` unsigned 64-bit words: the SimHash under XXH64 with seed 42, and under hashes mixed from it."""
    return _simhash(_shingles(text, shingle), words)


#: MinHash keys: a similarity of 0.8 shares one of 16 keys of 4 values with probability 0.9998, one of 0.9 always but for 1e-7.
BANDS, BAND_ROWS = 16, 4
_MIX = np.random.default_rng(29).integers(0, 1 << 63, (2, BANDS * BAND_ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhash_keys(found: np.ndarray) -> np.ndarray:
    """The keys (int64, below zero) of a set of hashes."""
    low = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(found), 4096):
        low = np.minimum(low, ((found[None, k : k + 4096] ^ _MIX[0]) * _MIX[1]).min(1))
    key = np.arange(BANDS, dtype=np.uint64)
    for part in low.reshape(BANDS, BAND_ROWS).T:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return (key | np.uint64(1 << 63)).view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1) -> DataFrame:
    """(doc_id, f0, f1, ...): SimHash of each whole text; null or blank text: zero."""
    names = [f"f{i}" for i in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = np.array([fingerprint(t or b"", shingle, words) for t in b.column("text").to_pylist()], dtype=np.uint64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(found[:, i].view(np.int64)) for i in range(words))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(releasing(run), "doc_id long, " + ", ".join(f"{n} long" for n in names))


def set_fingerprints(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """(doc_id, text_hash, digest, f0, ..., m0, ...): fingerprints and MinHash keys of each text's set of shingles; digest names the set."""
    names = [f"f{i}" for i in range(words)] + [f"m{i}" for i in range(BANDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t or b"", shingle) for t in b.column("text").to_pylist()]
            f = np.array([_simhash([x], words) for x in sets], dtype=np.uint64).reshape(-1, words).view(np.int64)
            m = np.array([minhash_keys(x) for x in sets], dtype=np.int64).reshape(-1, BANDS)
            digest = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(digest), *(pa.array(c) for c in (*f.T, *m.T))], names=["doc_id", "text_hash", "digest", *names])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text")).mapInArrow(releasing(run), "doc_id long, text_hash long, digest long, " + ", ".join(f"{n} long" for n in names))


def shingle_sets(ids: DataFrame, docs: DataFrame, shingle: int, broadcast_rows: int = 200_000) -> DataFrame:
    """(text_hash, s): the distinct shingle hashes of each text named by ids (text_hash, distinct), once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t, shingle).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("text_hash"), pa.array(sets, pa.list_(pa.int64()))], names=["text_hash", "s"])

    rows = docs.where("text IS NOT NULL").select(F.col("text").cast("string").alias("text")).select(F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    rows = rows.join(F.broadcast(ids) if ids.count() <= broadcast_rows else ids, "text_hash", "left_semi").dropDuplicates(["text_hash"])
    return cut(rows.mapInArrow(releasing(run), "text_hash long, s array<long>"))


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b: text hashes) whose sets (text_hash, s) have at least this Jaccard similarity."""
    both = pairs.join(sets.select(F.col("text_hash").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("text_hash").alias("b"), F.col("s").alias("y")), "b")
    both = both.select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("shared"))
    return both.where(F.col("shared") / (F.col("n") - F.col("shared")) >= similarity).select("a", "b")


#: Shingles are ordered by the counts of so many buckets of their hashes: a fixed 8 MB on the driver and in each worker, whatever the input.
ORDER_BUCKETS = 1 << 20


def _at_least(share: float, n: np.ndarray | int) -> np.ndarray:
    """The least whole number from share * n on."""
    return np.ceil(share * np.asarray(n) - 1e-9).astype(np.int64)


def prefix_pairs(sets: DataFrame, similarity: float, cell_rows: int = 2048) -> DataFrame:
    """Pairs (a, b) of sets (text_hash, root, s) of different `root` that hold all pairs of at least this Jaccard similarity.

    In an order of all shingles, rare ones first, two such sets share one of their first shingles (a fifth at 0.8), and
    the places of the first shared one bound what can be shared from there on, as sizes do. So texts with a common body
    and own parts of over the allowed difference never make a pair, however many they are. The order goes by counts of
    hash buckets; any order is right. A shingle of many sets is dealt in blocks of about `cell_rows` rows, whose pairs are tasks' cells.
    """
    spark, mask = sets.sparkSession, ORDER_BUCKETS - 1
    found = sets.select(F.explode("s").alias("w")).groupBy(F.col("w").bitwiseAND(mask).alias("bucket")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(ORDER_BUCKETS, dtype=np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    order = spark.sparkContext.broadcast(counts)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for node, root, s in zip(b.column("text_hash").to_pylist(), b.column("root").to_pylist(), b.column("s"), strict=True):
                s = s.values.to_numpy()
                n, c = len(s), order.value[s & mask]
                place = np.arange(n - _at_least(similarity, n) + 1 if n else 0)
                at = np.lexsort((s, c))[: len(place)]
                place, at = place[c[at] > 1], at[c[at] > 1]
                blocks = -(-c[at] // cell_rows)
                own, other = node % blocks, np.concatenate([np.arange(k) for k in blocks.tolist()] or [place])
                row = np.repeat(np.arange(len(at)), blocks)
                cell = np.minimum(own[row], other) << 31 | np.maximum(own[row], other)
                fixed = [np.full(len(row), x, dtype=np.int64) for x in (node, root, n)]
                out.append(np.stack([s[at][row], cell, own[row], place[row], *fixed]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, axis=1)], names=list(names))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, cell, block, place, node, root, size in _whole_keys(batches, names, 2):
            inside = cell >> 31 == cell & (1 << 31) - 1
            key = np.cumsum(np.concatenate([[0], (w[1:] != w[:-1]) | (cell[1:] != cell[:-1])]))
            indexed = place <= size - _at_least(2 * similarity / (1 + similarity), size)
            at, a, b, d = np.arange(len(key)), [], [], 0
            while len(at):
                d += 1
                at = at[at + d < len(key)]
                at = at[key[at] == key[at + d]]
                to = at + d
                may = indexed[at] & (root[at] != root[to]) & (inside[at] | (block[at] != block[to])) & (size[at] >= _at_least(similarity, size[to]))
                may &= np.minimum(size[at] - place[at], size[to] - place[to]) >= _at_least(similarity / (1 + similarity), size[at] + size[to])
                a.append(np.minimum(node[at[may]], node[to[may]]))
                b.append(np.maximum(node[at[may]], node[to[may]]))
            yield _pairs(a, b)

    names = ("w", "cell", "block", "place", "node", "root", "size")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = sets.mapInArrow(releasing(expand), ", ".join(f"{c} long" for c in names))
    return rows.repartition(n, "w", "cell").sortWithinPartitions("w", "cell", "size", "node").mapInArrow(releasing(compare), "a long, b long").distinct()


def exact_and_segment_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For links within 3 of 64 bits: one of four 16-bit blocks has no error, and one half of the other
    48 bits has at most one. A key is a block, its bits, a half and a codeword of 23 of its bits."""
    rows, keys, own = [], [], []
    f = fps[:, 0]
    for block in range(4):
        turned = (f >> np.uint64(16 * block)) | (f << np.uint64((64 - 16 * block) % 64)) if block else f
        exact = (turned & np.uint64(0xFFFF)).astype(np.int64)
        for half in range(2):
            row, code, is_own = golay().keys(((turned >> np.uint64(16 + 24 * half)) & np.uint64(0x7FFFFF)).astype(np.uint32))
            rows.append(row)
            keys.append(((block * 2 + half) << 28) | (exact[row] << 12) | code.astype(np.int64))
            own.append(is_own)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(own)


def segment_and_bits_keys(fps: np.ndarray, extra: int = 8, deals: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For wider links: each 23-bit segment's codewords with `extra` bits from elsewhere, in `deals` choices a segment.

    All rows that share a key are compared, so segments that differ in 2 bits, with a word between them, meet as well.
    Four times the documents with two more extra bits make as many comparisons a document, and find fewer wide links.
    """
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    rng, rows, keys = np.random.default_rng(23), [], []
    for segment in range(bits.shape[1] // 23):
        at = np.arange(23 * segment, 23 * segment + 23)
        row, code, _ = golay().keys((bits[:, at].astype(np.uint32) << np.arange(23, dtype=np.uint32)).sum(1, dtype=np.uint32))
        for deal in range(deals):
            chosen = rng.choice(np.setdiff1d(np.arange(bits.shape[1]), at), extra, replace=False)
            more = (bits[:, chosen].astype(np.int64) << np.arange(extra)).sum(1)
            rows.append(row)
            keys.append((((segment * deals + deal) << extra | more[row]) << 12) | code.astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys), np.ones(sum(map(len, rows)), dtype=bool)


def _distance(f: np.ndarray, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(f[a] ^ f[b]).sum(-1)


def _spanning(node: np.ndarray, f: np.ndarray, within: int) -> tuple[list, list]:
    """Edges of a forest with the same components as all links among these; each row is compared once with those still apart."""
    a, b, rest, todo = [], [], np.arange(1, len(node)), [0]
    while len(rest):
        if not todo:
            todo, rest = [int(rest[0])], rest[1:]
            continue
        at = todo.pop()
        near = _distance(f, at, rest) <= within
        got = rest[near]
        a += [int(node[at])] * len(got)
        b += node[got].tolist()
        todo += got.tolist()
        rest = rest[~near]
    return a, b


def _apart(node: np.ndarray, f: np.ndarray, root: np.ndarray, within: int) -> np.ndarray:
    """Those of these that have another of a different root within so many bits; rows of the commonest root need no comparing with each other."""
    found, n = np.unique(root, return_counts=True)
    is_open = np.zeros(len(node), dtype=bool)
    for i in np.flatnonzero(root != found[n.argmax()]).tolist() if len(found) > 1 else []:
        near = (root != root[i]) & (_distance(f, i, slice(None)) <= within)
        is_open |= near
        is_open[i] |= near.any()
    return node[is_open]


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    """Distinct pairs (a, b)."""
    pairs = np.unique(np.stack([np.concatenate([np.zeros(0, dtype=np.int64), *z]) for z in (a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _whole_keys(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], by: int = 1) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, in parts that end where the first `by` columns change."""
    held = None
    for b in batches:
        new = [b.column(n).to_numpy(zero_copy_only=False) for n in names]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        if not len(held[0]):
            continue
        same = np.logical_and.reduce([c == c[-1] for c in held[:by]])
        cut_at = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # the last key may go on
        if cut_at:
            yield [x[:cut_at] for x in held]
            held = [x[cut_at:] for x in held]
    if held is not None and len(held[0]):
        yield held


def links(classes: DataFrame, within: int, keys: Callable, words: int, more: tuple[str, ...] = (), apart: bool = False) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of classes (node, f0, ...) within so many bits.

    `more` names columns with further keys. With `apart`, rows that share a key with one of another `root` (a column)
    within so many bits are given instead, each as (a, a): as many rows as are read, not as many as there are pairs. Keys
    that differ in their codeword alone then go to one task, next to each other, which gives a row once for most of them.

    A key's rows come to one task in order and hold 8 (1 + words) bytes each; groups of over 8 give a spanning
    forest instead of their pairs, from the smallest node on, so that keys of one family give mostly the same edges. In a
    forest b is found from a, so b has one edge a key there, and otherwise a is the smaller: no b has many edges.
    Classes have distinct fingerprints, so copies never meet here.
    """
    names = [f"f{i}" for i in range(words)]
    labels = ["root"] if apart else []

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, f = b.column("node").to_numpy(), np.stack([b.column(n).to_numpy() for n in names], axis=1).view(np.uint64)
            for at in range(0, len(node), 2000):
                row, key, own = keys(f[at : at + 2000])
                if more:
                    n = len(f[at : at + 2000])
                    row, own = np.concatenate([row, np.tile(np.arange(n), len(more))]), np.concatenate([own, np.ones(n * len(more), dtype=bool)])
                    key = np.concatenate([key, *(b.column(c).to_numpy()[at : at + 2000] for c in more)])
                row = row + at
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own), pa.array(node[row]), *(pa.array(f[row, i].view(np.int64)) for i in range(words)), *(pa.array(b.column(c).to_numpy()[row]) for c in labels)], names=["key", "own", "node", *names, *labels])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole_keys(batches, ("key", "own", "node", *names, *labels)):
            yield from _compared(cols, within)

    def _compared(cols: list[np.ndarray], within: int) -> Iterator[pa.RecordBatch]:
        key, own, node = cols[:3]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        mixed = np.minimum.reduceat(cols[-1], first) < np.maximum.reduceat(cols[-1], first) if apart else True
        keep = np.repeat((size > 1) & mixed & (np.add.reduceat(own.astype(np.int64), first) > 0), size)
        key, own, node = key[keep], own[keep], node[keep]
        root = cols[-1][keep]
        f = np.stack([c[keep] for c in cols[3 : 3 + words]], axis=1).view(np.uint64)
        if not len(key):
            return
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        a, b = [], []
        for s, n in zip(first[size > 8].tolist(), size[size > 8].tolist(), strict=True):
            if apart:
                x = y = _apart(node[s : s + n], f[s : s + n], root[s : s + n], within)
            else:
                x, y = _spanning(node[s : s + n], f[s : s + n], within)
            a.append(np.array(x, dtype=np.int64))
            b.append(np.array(y, dtype=np.int64))
        at = np.flatnonzero(np.repeat(size <= 8, size))
        for d in range(1, 8):
            at = at[at + d < len(key)]
            at = at[key[at] == key[at + d]]
            if not len(at):
                break
            hit = at[(own[at] | own[at + d]) & (_distance(f, at, at + d) <= within)]
            if apart:
                hit = hit[root[hit] != root[hit + d]]
            a += [node[hit], node[hit + d]] if apart else [node[hit]]
            b += [node[hit], node[hit + d]] if apart else [node[hit + d]]
        yield _pairs(a, b)

    fields = ", ".join(f"{n} long" for n in [*names, *labels])
    rows = classes.where("node IS NOT NULL").mapInArrow(releasing(expand), f"key long, own boolean, node long, {fields}")
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, F.shiftright("key", 12) if apart else F.col("key")).sortWithinPartitions("key", "node").mapInArrow(releasing(compare), "a long, b long")


#: So many edges of a text are verified before texts meet by their rare shingles, which finds every link that these leave out.
HOOKS = 32


def _similar_components(classes: DataFrame, docs: DataFrame, shingle: int, words: int, similarity: float, within: int, loose: int, keys: Callable) -> DataFrame:
    """(node, root) over pairs of classes (f0, ..., m0, ..., node, text_hash) that share a key, lie within `loose` bits and have the similarity.

    Pairs within `within` bits, of large groups a forest of them, name HOOKS texts for each text, which are verified first. Texts that share a key with one still
    apart from them, within `loose` bits, then meet by their rare shingles (prefix_pairs), so that neither a forest's edge that
    fails nor a wide pair loses a link, and no group gives all its pairs.
    """
    names, more = [f"f{i}" for i in range(words)], tuple(f"m{i}" for i in range(BANDS))
    named = classes.where("node IS NOT NULL")
    ends = lambda pairs: pairs.join(named.select(F.col("text_hash").alias("a"), F.col("node").alias("p")), "a").join(named.select(F.col("text_hash").alias("b"), F.col("node").alias("q")), "b").select(F.col("p").alias("a"), F.col("q").alias("b"))
    first = links(named.select(F.col("text_hash").alias("node"), *names, *more), within, keys, words, more)
    first = cut(first.groupBy("b").agg(F.slice(F.array_sort(F.collect_set("a")), 1, HOOKS).alias("a")).select(F.explode("a").alias("a"), "b"))
    ids = cut(first.select(F.explode(F.array("a", "b")).alias("text_hash")).distinct())
    edges = cut(ends(similar(first, shingle_sets(ids, docs, shingle), similarity)))
    roots = components(edges)
    labelled = cut(named.join(roots, "node", "left").select(F.col("text_hash").alias("node"), *names, *more, F.coalesce("root", "node").alias("root")))
    ids = cut(links(labelled, loose, keys, words, more, True).select(F.col("a").alias("text_hash")).distinct())
    if not ids.limit(1).count():
        return roots
    sets = cut(shingle_sets(ids, docs, shingle).join(labelled.select(F.col("node").alias("text_hash"), "root"), "text_hash"))
    return components(edges.unionByName(ends(similar(cut(prefix_pairs(sets, similarity)), sets, similarity))))


def near_duplicates(docs: DataFrame, shingle: int = 5, words: int = 4, within: int = 42, keys: Callable = segment_and_bits_keys, similarity: float | None = 0.8, loose: int = 64) -> DataFrame:
    """(doc_id, f0, ..., component_id) for each row of docs (doc_id, text; more columns are ignored).

    component_id is the smallest doc_id reachable over pairs whose sets of `shingle`-word shingles have a Jaccard
    similarity of at least `similarity`; the fingerprints are then those of the sets. Keys and at most `loose` differing
    bits (of 256, 39 differ at 0.8 in the mean, with a deviation of 6) only name the pairs that are compared.
    Without `similarity`, pairs whose fingerprints differ in at most `within` bits link. Null and blank texts have the
    fingerprint zero and are copies of each other; rows without doc_id belong to their copies' component, and only to
    that; an empty table gives no rows.
    """
    names = [f"f{i}" for i in range(words)]
    if similarity is None:
        by = names
        fps = cut(fingerprints(docs, shingle, words))
        classes = cut(fps.groupBy(*names).agg(F.min("doc_id").alias("node")))
        roots = components(links(classes, within, keys, words))
    else:
        by = ["digest", *names]
        fps = cut(set_fingerprints(docs, shingle, words))
        classes = cut(fps.groupBy(*by).agg(F.min("doc_id").alias("node"), *[F.min(n).alias(n) for n in ("text_hash", *(f"m{i}" for i in range(BANDS)))]))
        roots = _similar_components(classes, docs, shingle, words, similarity, within, loose, keys)
    named = classes.join(roots, "node", "left").select(*by, F.coalesce("root", "node").alias("component_id"))
    return fps.join(named, by, "left").select("doc_id", *names, "component_id")


def op9_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, words=1, within=3, keys=exact_and_segment_keys, similarity=None)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
