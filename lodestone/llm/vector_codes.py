"""Vectors compressed to a byte a part by codebooks that rounds of integer k-means refine.

Each round broadcasts a kd-tree of each part's codebook. Tasks search their vectors' nearest entries by branch and bound,
all vectors of a batch at a node at once; a box as far as the best entry so far is visited too, so that of equally near
entries the lower index wins. Sums are integers, merged over the executors, so that no partitioning changes the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import cut, in_batches, releasing, table
from .partials import tree_sum

#: Labels with sums of so few rows are broadcast; Spark shuffles both sides beyond it.
BROADCAST_ROWS = 200_000
LEAF = 16
#: Integer components are below this, so that no squared distance or sum leaves 64 bits.
TOP = 1 << 26


@dataclass
class Node:
    """A box of a kd-tree: `low` and `high` bound its entries; a leaf has the `entries` (index, coordinates)."""

    low: np.ndarray
    high: np.ndarray
    axis: int = 0
    middle: float = 0.0
    left: Node | None = None
    right: Node | None = None
    index: np.ndarray | None = None
    points: np.ndarray | None = None


def build(points: np.ndarray, index: np.ndarray | None = None) -> Node:
    """The kd-tree of integer points, halved along the widest side of each box; equal points may end in one leaf of any size."""
    index = np.arange(len(points)) if index is None else index
    own = points[index]
    low, high = own.min(0), own.max(0)
    if len(index) <= LEAF or not own.shape[1] or (low == high).all():
        return Node(low, high, index=index, points=own)
    axis = int(np.argmax(high - low))
    order = index[np.argsort(own[:, axis], kind="stable")]
    half = len(order) // 2
    middle = (float(points[order[half - 1], axis]) + float(points[order[half], axis])) / 2
    return Node(low, high, axis, middle, build(points, np.sort(order[:half])), build(points, np.sort(order[half:])))


def nearest(tree: Node, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each row of x; ties go to the lower index."""
    best = np.full(len(x), np.iinfo(np.int64).max)
    which = np.full(len(x), np.iinfo(np.int64).max)

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        q = x[rows]
        if node.points is not None:
            apart = np.zeros((len(rows), len(node.index)), np.int64)
            for k in range(q.shape[1]):
                d = q[:, k, None] - node.points[None, :, k]
                apart += d * d
            at = apart.argmin(1)  # the first of equals, and a leaf's entries ascend
            found, index = apart[np.arange(len(rows)), at], node.index[at]
            closer = (found < best[rows]) | (found == best[rows]) & (index < which[rows])
            best[rows[closer]], which[rows[closer]] = found[closer], index[closer]
            return
        first = q[:, node.axis] < node.middle
        for near, far, own in ((node.left, node.right, rows[first]), (node.right, node.left, rows[~first])):
            visit(near, own)
            out = np.maximum(0, np.maximum(far.low - x[own], x[own] - far.high))
            visit(far, own[(out * out).sum(1) <= best[own]])

    visit(tree, np.arange(len(x)))
    return which, best


def integers(vectors: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows can be coded, their components as integers floor(scale * x)): those of `dim` finite components in reach."""
    lists = vectors.cast(pa.large_list(pa.float64()))
    at = np.frombuffer(lists.buffers()[1], np.int64, len(lists) + 1, 8 * lists.offset)
    flat = lists.values
    values = flat.to_numpy(zero_copy_only=False)  # null components become NaN
    ok = (np.diff(at) == dim) & ~np.asarray(lists.is_null())
    rows = np.flatnonzero(ok)
    x = np.floor(values[at[rows][:, None] + np.arange(dim)[None, :]] * scale) if len(rows) else np.zeros((0, dim))
    fine = (np.abs(x) < TOP).all(1)  # false for NaN and infinities
    ok[rows[~fine]] = False
    return ok, x[fine].astype(np.int64)


def bounds(dim: int, parts: int) -> list[slice]:
    """Consecutive parts as equal as can be; where `dim` is not a multiple, the first ones are longer by one."""
    size, more = divmod(dim, parts)
    at = [0]
    for p in range(parts):
        at.append(at[-1] + size + (p < more))
    return [slice(a, b) for a, b in zip(at, at[1:], strict=False)]


def usable(vector: str) -> F.Column:
    """False for a vector that is null or holds null, NaN or infinite components."""
    c = F.col(vector).cast("array<double>")
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & ~F.coalesce(bad, F.lit(False))


def train(df: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> list[np.ndarray]:
    """The codebooks, an array (entries, components) of each part; [] where no row is usable.

    They start as the parts of the `entries` rows with the smallest keys (nulls last, ties by components), and their
    dimension is that of the first of them; rows of another one, or with components of 65,536 or more at the scale of
    1024, take no part. df is read once a round: hand over a table.
    """
    rows = df.where(usable(vector)).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    # bounded: `entries` rows, or the first row alone for the dimension
    order = [F.col("key").asc_nulls_last(), F.col("v")]
    reach = lambda c: F.forall(c, lambda x: F.abs(F.floor(x * scale)) < TOP)
    first = rows.where(reach(F.col("v"))).orderBy(*order).limit(1).collect()
    if not first:
        return []
    dim = len(first[0]["v"])
    fit = rows.where((F.size("v") == dim) & reach(F.col("v")))
    start = np.array([r["v"] for r in fit.orderBy(*order).limit(entries).collect()], float).reshape(-1, dim)
    cuts = bounds(dim, parts)
    books = [np.floor(start[:, c] * scale).astype(np.int64) for c in cuts]
    n, sc = len(start), df.sparkSession.sparkContext
    for _ in range(rounds):
        sent = sc.broadcast([build(b) for b in books])

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((n, dim), np.int64), np.zeros((parts, n), np.int64)
            for b in batches:
                _, x = integers(b.column(0), dim, scale)
                for p, c in enumerate(cuts):
                    which, _ = nearest(sent.value[p], x[:, c])
                    count[p] += np.bincount(which, minlength=n)
                    order = np.argsort(which, kind="stable")
                    own, at = np.unique(which[order], return_index=True)
                    if len(own) and c.stop > c.start:
                        total[own, c] += np.add.reduceat(x[order, c], at, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total.ravel(), count.ravel()]).tobytes()])], names=["vector"])

        found = tree_sum(in_batches(fit.select("v"), 10_000).mapInArrow(releasing(sums), "vector binary"), n * (dim + parts))
        total, count = found[: n * dim].reshape(n, dim), found[n * dim :].reshape(parts, n)
        for p, c in enumerate(cuts):
            used = count[p] > 0
            books[p][used] = total[used, c] // count[p][used][:, None]  # rounds down
        sent.destroy()
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of the entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode(df: DataFrame, books: list[np.ndarray], vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """df's usable rows with `code` (two hex digits a part) and `error` (squared distances to the entries, summed).

    Rows of another dimension than the codebooks' or out of their reach get nulls. Columns of df named code or error are
    replaced; all others pass through, the vector too.
    """
    kept = df.where(usable(vector)).drop("code", "error")
    schema = T.StructType(list(kept.schema)).add("code", "string").add("error", "long")
    if not books:
        return kept.select("*", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    cuts, dim = bounds(sum(b.shape[1] for b in books), len(books)), sum(b.shape[1] for b in books)
    sent = df.sparkSession.sparkContext.broadcast([build(b) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, x = integers(b.column(b.schema.names.index(vector)), dim, scale)
            code, error = np.full(b.num_rows, None, object), np.zeros(b.num_rows, np.int64)
            found = [nearest(tree, x[:, c]) for tree, c in zip(sent.value, cuts, strict=True)]
            error[ok] = np.sum([d for _, d in found], axis=0)
            code[ok] = np.stack([w for w, _ in found], axis=1).astype(np.uint8).tobytes().hex(" ", len(found)).split(" ") if ok.any() else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code, pa.string()), pa.array(error, pa.int64(), mask=~ok)], names=[*b.schema.names, "code", "error"])

    return in_batches(kept, 10_000).mapInArrow(releasing(run), schema)


def compress(df: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the rows of df (vec_id, embedding, label and any other columns).

    Rows whose vector is null or holds null or non-finite components are left out; repeated rows and null ids are rows of their
    own. label_error sums the errors of rows of equal label, nulls together. An empty table gives no rows. Vectors of another dimension than the
    one with the smallest vec_id, or with components of 65,536 or more, have a null code and error, and count as no error.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index is two hex digits")
    books = train(df, parts=parts, entries=entries, rounds=rounds, scale=scale)
    coded = cut(encode(df.select("vec_id", "label", "embedding"), books, scale=scale).select("vec_id", "label", "code", "error"))
    by_label = cut(coded.groupBy("label").agg(F.coalesce(F.sum("error"), F.lit(0)).alias("label_error")).withColumnRenamed("label", "_label"))
    small = F.broadcast(by_label) if by_label.count() <= BROADCAST_ROWS else by_label
    out = coded.join(small, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def oracle_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The same in SQL: every vector against every entry, for small tables."""
    near = lambda k: f"""
d{k} AS MATERIALIZED (SELECT id, x.part, x.v, c.entry, x.n + c.n - 2 * list_dot_product(x.f, c.f) AS d FROM x JOIN b{k} c ON c.part = x.part),
a{k} AS MATERIALIZED (SELECT id, part, arg_min(v, (d, entry)) AS v, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM d{k} GROUP BY id, part)"""  # noqa: E731
    step = lambda k: f"""
s{k} AS (SELECT part, entry, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM (SELECT part, entry, v, unnest(range(1, len(v) + 1)) AS i FROM a{k}) GROUP BY ALL),
m{k} AS (SELECT part, entry, list(floor(s::DOUBLE / n)::BIGINT ORDER BY i) AS v FROM s{k} GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, b.v) AS v, coalesce(m.v, b.v)::DOUBLE[] AS f, list_dot_product(coalesce(m.v, b.v)::DOUBLE[], coalesce(m.v, b.v)::DOUBLE[]) AS n FROM b{k} b LEFT JOIN m{k} m USING (part, entry))"""  # noqa: E731
    loop = ",".join(f"{near(k)},{step(k)}" for k in range(rounds)) + "," + near(rounds)
    return f"""
WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
i AS (SELECT id, list_transform(v, lambda y: floor({scale} * y)::BIGINT) AS v FROM e),
q AS (SELECT id, p AS part, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM i, range({parts}) r(p)),
x AS MATERIALIZED (SELECT id, part, v, v::DOUBLE[] AS f, list_dot_product(v::DOUBLE[], v::DOUBLE[]) AS n FROM q),
b0 AS MATERIALIZED (SELECT part, id AS entry, v, f, n FROM x WHERE id < {entries}),{loop},
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
o AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM o JOIN e USING (id), h
"""
