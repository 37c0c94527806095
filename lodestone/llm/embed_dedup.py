"""Near-duplicate embeddings by randomised-rotation binary codes with stored correction factors.

A vector's code is the signs of its randomly rotated components. Bands of code bits deal the codes of vectors that may be
similar to common keys, where differing bits tell which of them may be; only those are joined with their vectors. There
<sign(R x), R y> / |R x|_1 is an unbiased estimate of the inner product of unit vectors
x and y over random rotations R; |R x|_1 is the stored factor, which also bounds the estimate's error. Pairs whose
upper bound reaches the threshold are computed again from the vectors in double precision, and only that links them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import components, cut, table

#: Groups up to this size are compared as pairs of all groups at once, larger ones as matrices.
FEW = 8
BLOCK = 1024


@cache
def rotations(dim: int, count: int, seed: int = 7) -> np.ndarray:
    """(count, dim, dim) random orthogonal matrices."""
    rng = np.random.default_rng((seed, dim))
    out = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.stack(out)


def plan(n: int, cosine: float, recall: float = 0.98, bucket: int = 8) -> tuple[int, int]:
    """(bits of a band, bands): bands as wide as leaves about `bucket` of n scattered vectors to a key, and as many
    as find a pair right at the threshold with probability `recall`; more similar pairs are found more often."""
    width = min(30, max(8, math.ceil(math.log2(max(2, n) / bucket))))
    same = (1 - math.acos(cosine) / math.pi) ** width
    return width, math.ceil(math.log(1 - recall) / math.log(1 - same))


def _codes(x: np.ndarray, width: int, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(band keys, correction factors, packed bits) of unit vectors; the factor belongs to the first rotation."""
    dim = x.shape[1]
    r = rotations(dim, -(-width * bands // dim))
    turned = np.concatenate([x @ q.T for q in r], axis=1)
    bits = (turned[:, : width * bands] > 0).reshape(len(x), bands, width)
    keys = (bits.astype(np.int64) << np.arange(width)).sum(2)
    flat = np.zeros((len(x), -(-width * bands // 64) * 64), dtype=bool)
    flat[:, : width * bands] = bits.reshape(len(x), -1)
    return keys, np.abs(turned[:, :dim]).sum(1), np.packbits(flat, axis=1, bitorder="little")


def most_differing(bits: int, cosine: float, sure: float) -> int:
    """Upper confidence bound of the code bits in which vectors of a cosine differ; a bit differs with probability angle / pi."""
    p = math.acos(cosine) / math.pi
    return math.floor(bits * p + (sure + 1) * math.sqrt(bits * p * (1 - p)))


def candidates(codes: np.ndarray, band: int, side: np.ndarray, bands: int, width: int, most: int) -> np.ndarray:
    """Which rows of one key differ in at most `most` bits from another that they share no earlier band with."""
    n = len(codes)
    hit = np.zeros(n, dtype=bool)
    for at in range(0, n, 256):
        part = slice(at, min(n, at + 256))
        apart = np.bitwise_count(codes[part, None, :] ^ codes[None, :, :]).sum(2, dtype=np.int32)
        near = (apart <= most) & np.where(side[part, None] == 0, side[None, :] == 0, side[part, None] != side[None, :])
        a, b = np.nonzero(near)
        a, b = a[(a + at) < b] + at, b[(a + at) < b]
        for k in range(0, len(a), 100_000):
            i, j = a[k : k + 100_000], b[k : k + 100_000]
            new = first_band(codes[i] ^ codes[j], bands, width) == band
            hit[i[new]] = hit[j[new]] = True
    return hit


def first_band(differing: np.ndarray, bands: int, width: int) -> np.ndarray:
    """The first band of which no bit is set."""
    bits = np.unpackbits(np.ascontiguousarray(differing).view(np.uint8).reshape(len(differing), 8 * differing.shape[1]), axis=1, bitorder="little")[:, : bands * width]
    return (~bits.reshape(len(differing), bands, width).any(2)).argmax(1)


def _upper(signs_x: np.ndarray, factor_x: np.ndarray, turned_y: np.ndarray, sure: float, pairwise: bool) -> np.ndarray:
    """Upper confidence bounds of the inner products: of rows with rows, or of all with all."""
    dim = turned_y.shape[1]
    est = np.einsum("ij,ij->i", signs_x, turned_y) if pairwise else signs_x @ turned_y.T
    f = factor_x if pairwise else factor_x[:, None]
    c2 = f * f / dim
    return est / f + sure * np.sqrt(np.maximum(0, 1 - c2) / c2 / max(1, dim - 1))


class _Bucket:
    """Rows of some keys with what comparing them needs."""

    def __init__(self, node, weight, side, band, keys, factor, x, cosine, sure):
        self.node, self.weight, self.side, self.band, self.keys, self.factor, self.x = node, weight, side, band, keys, factor, x
        self.cosine, self.sure = cosine, sure
        self.turned = x @ rotations(x.shape[1], 1)[0].T
        self.signs = np.where(self.turned > 0, 1.0, -1.0)

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of rows, those that link and have no common key in an earlier band."""
        up = np.minimum(_upper(self.signs[a], self.factor[a], self.turned[b], self.sure, True), _upper(self.signs[b], self.factor[b], self.turned[a], self.sure, True))
        ok = (up >= self.cosine) & ((self.side[a] == 0) & (self.side[b] == 0) | (self.side[a] != self.side[b]))
        at = np.flatnonzero(ok)
        ok[at] = np.einsum("ij,ij->i", self.x[a[at]], self.x[b[at]]) >= self.cosine
        at = np.flatnonzero(ok)
        before = (self.keys[a[at]] == self.keys[b[at]]) & (np.arange(self.keys.shape[1]) < self.band[a[at]][:, None])
        ok[at] = ~before.any(1)
        return ok

    def matrix(self, rows: slice) -> tuple[list, list, np.ndarray]:
        """(edges of a spanning forest, weights of links) of one large group."""
        x, side, n = self.x[rows], self.side[rows], rows.stop - rows.start
        up = _upper(self.signs[rows], self.factor[rows], self.turned[rows], self.sure, False)
        need = np.minimum(up, up.T) >= self.cosine
        need &= (side[:, None] == side[None, :]) & (side[:, None] == 0) | (side[:, None] != side[None, :])
        np.fill_diagonal(need, False)
        a, b = np.nonzero(np.triu(need))
        link = np.zeros((n, n), dtype=bool)
        for k in range(0, len(a), 200_000):
            i, j = a[k : k + 200_000], b[k : k + 200_000]
            link[i, j] = np.einsum("ij,ij->i", x[i], x[j]) >= self.cosine
        link |= link.T
        new, keys = link.copy(), self.keys[rows]
        for e in range(int(self.band[rows.start])):
            new &= keys[:, e][:, None] != keys[:, e][None, :]
        counts = new @ self.weight[rows]
        ea, eb, rest, todo = [], [], np.ones(n, dtype=bool), []
        for start in range(n):
            if rest[start]:
                rest[start], todo = False, [start]
                while todo:
                    at = todo.pop()
                    got = np.flatnonzero(link[at] & rest)
                    rest[got] = False
                    ea += [int(self.node[rows][at])] * len(got)
                    eb += self.node[rows][got].tolist()
                    todo += got.tolist()
        return ea, eb, counts


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def near_vectors(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.98, sure: float = 3.0, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors (vec_id, embedding; more columns are ignored).

    Equal vectors are one class. Classes that share a band's key are compared, a pair in the first band it shares, by their codes first
    and those that may link by their vectors,
    so links are counted once and never listed: large groups give counts and a spanning forest. A key of over 2 x BLOCK
    classes is dealt to tasks in pairs of blocks. Vectors that are null, empty or zero, or hold null or non-finite
    components link with nothing, and neither do vectors of different lengths or without vec_id. Repeated
    rows link with each other; an empty table gives no rows. Pairs at the threshold are found with
    probability `recall` and less `sure`'s tail (about 0.1 %), closer ones with more; none below it is linked.
    """
    e = F.col("embedding").cast("array<float>")
    bad = F.col("e").isNull() | (F.size("e") == 0) | F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists("e", lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"))
    good = F.col("vec_id").isNotNull() & ~F.coalesce(bad, F.lit(True))
    marked = rows.withColumn("h1", F.when(good, F.xxhash64("e"))).withColumn("h2", F.when(good, F.xxhash64(F.lit("second"), "e")))
    ids = cut(marked.select("vec_id", "h1", "h2"))
    classes = cut(marked.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.first("e").alias("e")))
    width, bands = plan(classes.count(), cosine, recall)

    def units(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, vectors as stored, unit vectors) of one length each."""
        lists = b.column("e")
        size = np.diff(lists.offsets.to_numpy())
        flat, first = lists.values.to_numpy(), lists.offsets.to_numpy()[:-1]
        for dim in np.unique(size):
            for own in np.array_split(which := np.flatnonzero(size == dim), max(1, len(which) // 500)):
                raw = flat[first[own][:, None] + np.arange(dim)].astype(np.float32)
                x = raw.astype(np.float64)
                x /= np.abs(x).max(1, keepdims=True)  # tiny components would vanish when squared
                yield own, raw, x / np.linalg.norm(x, axis=1, keepdims=True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.column("node").to_numpy()
            for own, raw, x in units(b):
                keys, _, bits = _codes(x, width, bands)
                at, band = np.repeat(np.arange(len(own)), bands), np.tile(np.arange(bands), len(own))
                key = (np.int64(raw.shape[1]) << 44) ^ (band.astype(np.int64) << 32) ^ keys.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[own][at]), pa.array([r.tobytes() for r in bits], pa.binary()).take(pa.array(at))], names=["key", "node", "bits"])

    dealt = classes.select("node", "e").mapInArrow(encode, "key long, node long, bits binary")
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    hot = cut(dealt.groupBy("key").count().where(F.col("count") > 2 * BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    dealt = dealt.join(small(hot), "key", "left")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j"), F.when(o == own, 0).when(own < o, 1).otherwise(2).alias("side")))
    )
    # in a task of two blocks the pairs within a block are left to that block's own task
    dealt = dealt.withColumn("to", F.explode(spread)).select("key", F.col("to.i").alias("i"), F.col("to.j").alias("j"), F.col("to.side").alias("side"), "node", "bits")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """Rows of whole groups (key, i, j), with their group."""
        held: pa.Table | None = None
        for b in _and_end(batches):
            if b is not None:
                held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if held is None or not held.num_rows:
                continue
            group = np.stack([held.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")], axis=1)
            cut_at = held.num_rows if b is None else int(np.flatnonzero((group == group[-1]).all(1))[0])
            if cut_at:
                yield held.slice(0, cut_at), group[:cut_at]
                held = held.slice(cut_at).combine_chunks()

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that may link in their group: their codes differ in few bits."""
        most = most_differing(width * bands, cosine, sure)
        for t, g in groups(batches):
            codes = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(g), -1)
            band, side = (g[:, 0] >> 32) & 0xFFF, t.column("side").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]).any(1)]))
            size = np.diff(np.append(first, len(g)))
            hit = np.zeros(len(g), dtype=bool)
            at = np.flatnonzero(np.repeat(size <= FEW, size) & (side == 0))  # all small groups at once
            for d in range(1, FEW):
                at = at[at + d < len(g)]
                at = at[(g[at] == g[at + d]).all(1)]
                differ = codes[at] ^ codes[at + d]
                near = np.flatnonzero(np.bitwise_count(differ).sum(1) <= most)
                near = near[first_band(differ[near], bands, width) == band[at[near]]]
                hit[at[near]] = hit[at[near] + d] = True
            for s, n in zip(first.tolist(), size.tolist(), strict=True):
                if n > FEW or side[s] and n > 1:
                    hit[s : s + n] = candidates(codes[s : s + n], int(band[s]), side[s : s + n], bands, width, most)
            yield from t.select(["key", "i", "j", "side", "node"]).filter(pa.array(hit)).to_batches()

    def with_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, raw, x in units(b):
                keys, factor, _ = _codes(x, width, bands)
                rest = [b.column(c).take(pa.array(own)) for c in ("key", "i", "j", "side", "node", "weight")]
                band = pa.array(((rest[0].to_numpy() >> 32) & 0xFFF).astype(np.int32))
                more = [band, pa.array(factor), pa.array([k.tobytes() for k in keys.astype(np.int32)], pa.binary()), pa.array([r.tobytes() for r in raw], pa.binary())]
                yield pa.RecordBatch.from_arrays([*rest, *more], names=["key", "i", "j", "side", "node", "weight", "band", "factor", "keys", "x"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in groups(batches):
            yield from compared(t, group)

    def compared(t: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.concatenate([[True], (group[1:] != group[:-1]).any(1)])
        size = np.diff(np.append(np.flatnonzero(new), len(group)))
        keep = np.repeat(size > 1, size)
        dims = np.array([len(v) for v in t.column("x").to_pylist()])
        for dim in np.unique(dims[keep]):
            mine = np.flatnonzero(keep & (dims == dim))
            part, g = t.take(pa.array(mine)), group[mine]
            raw = np.frombuffer(b"".join(part.column("x").to_pylist()), np.float32).reshape(len(mine), -1).astype(np.float64)
            raw /= np.abs(raw).max(1, keepdims=True)
            x = raw / np.linalg.norm(raw, axis=1, keepdims=True)
            keys = np.frombuffer(b"".join(part.column("keys").to_pylist()), np.int32).reshape(len(mine), -1)
            k = _Bucket(*(part.column(c).to_numpy() for c in ("node", "weight", "side", "band")), keys, part.column("factor").to_numpy(), x, cosine, sure)
            first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]).any(1)]))
            size = np.diff(np.append(first, len(g)))
            a, b, links = [], [], np.zeros(len(g), dtype=np.int64)
            few = np.repeat(size <= FEW, size)
            at = np.flatnonzero(few)
            for d in range(1, FEW):
                at = at[at + d < len(g)]
                at = at[(g[at] == g[at + d]).all(1)]
                if not len(at):
                    break
                hit = at[k.linked(at, at + d)]
                a.append(k.node[hit])
                b.append(k.node[hit + d])
                np.add.at(links, hit, k.weight[hit + d])
                np.add.at(links, hit + d, k.weight[hit])
            for s, n in zip(first[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
                ea, eb, counts = k.matrix(slice(s, s + n))
                a.append(np.array(ea, dtype=np.int64))
                b.append(np.array(eb, dtype=np.int64))
                links[s : s + n] = counts
            some = np.flatnonzero(links)
            ea, eb = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
            total = len(ea) + len(some)
            blank = np.zeros(total, dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ea, k.node[some]])), pa.array(np.concatenate([eb, np.zeros(len(some), np.int64)]), mask=np.append(blank[: len(ea)], ~blank[: len(some)])), pa.array(np.concatenate([np.zeros(len(ea), np.int64), links[some]]))],
                names=["a", "b", "links"],
            )

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["key", "i", "j"]
    near = cut(dealt.repartition(parts, *by).sortWithinPartitions(*by).mapInArrow(screen, "key long, i int, j int, side int, node long"))
    fields = "key long, i int, j int, side int, node long, weight long, band int, factor double, keys binary, x binary"
    vectors_of = small(near).join(classes.select("node", "weight", "e"), "node").select("key", "i", "j", "side", "node", "weight", "e").mapInArrow(with_codes, fields)
    found = cut(vectors_of.repartition(parts, *by).sortWithinPartitions(*by).mapInArrow(compare, "a long, b long, links long"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = classes.select("h1", "h2", "node", "weight").join(roots, "node", "left").join(links, "node", "left")
    named = named.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    out = ids.join(named, ["h1", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_rotation_code_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
