"""Removal of repeated byte strings across documents with sharded suffix arrays.

Every string of `length` bytes holds a smallest hash among its shorter grams, an anchor that equal strings share,
so a text falls into segments of start positions with one anchor each. Segments whose anchor occurs in one document
only can't repeat. The others' bytes are dealt to shards by anchor, where equal strings are sure to meet. Of a shard's
distinct segments, start positions whose string's hash no segment of another smallest document has can't change theirs;
the suffixes of the others are sorted by induced sorting, and common prefixes of neighbours give the groups of equal
strings and the smallest document of each. Hashes decide what is compared, bytes what repeats.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, releasing, slices, table
from .suffix_array import repeat_groups, suffix_array

NONE = np.iinfo(np.int64).max
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
ANCHOR = np.uint64(2**48 - 1)
CHUNK = 1 << 17
KINDS = [np.dtype(k) for k in ("u1", "u2", "i4", "i8")]
_squeeze, _unsqueeze = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _packed(*parts) -> bytes:
    return _squeeze.compress(pickle.dumps(parts, protocol=5))


def _unpacked(raw: bytes) -> tuple:
    return pickle.loads(_unsqueeze.decompress(raw))


def _laid(*arrays: np.ndarray) -> bytes:
    """As _packed, for arrays: there are buckets times shards of these, so each must cost little."""
    head = np.array([len(arrays), *(x for a in arrays for x in (KINDS.index(a.dtype), a.size))], np.int64)
    return _squeeze.compress(b"".join([head.tobytes(), *(a.tobytes() for a in arrays)]))


def _arrays(raw: bytes) -> list[np.ndarray]:
    raw = _unsqueeze.decompress(raw)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * count, 8).tolist(), 8 + 16 * count, []
    for kind, size in zip(head[::2], head[1::2], strict=True):
        out.append(np.frombuffer(raw, KINDS[kind], size, at))
        at += KINDS[kind].itemsize * size
    return out


def _short(anchors: np.ndarray) -> np.ndarray:
    """Anchors in the 48 bits that they have."""
    return np.ascontiguousarray(anchors.astype("<u8").view(np.uint16).reshape(-1, 4)[:, :3]).ravel()


def _long(short: np.ndarray) -> np.ndarray:
    out = np.zeros((len(short) // 3, 4), np.uint16)
    out[:, :3] = short.reshape(-1, 3)
    return out.view("<u8").ravel()


def window_hashes(a: np.ndarray, width: int) -> np.ndarray:
    """A hash of the `width` (8 or more) bytes from each position on."""
    n = max(0, len(a) - width + 1)
    out, a = np.empty(n, np.uint64), np.ascontiguousarray(a)
    for lo in range(0, n, CHUNK):  # what stays in a core's cache
        size = min(CHUNK, n - lo)
        u = np.ndarray((size + width - 8,), "<u8", a.data, lo, (1,)).copy()
        h, odd = np.zeros(size, np.uint64), 1
        for o in [*range(0, width - 8, 8), width - 8]:
            odd = odd * 0x9E3779B97F4A7C15 % 2**64
            h += u[o : o + size] * np.uint64(odd)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(32)
        out[lo : lo + size] = h
    return out


def segments(a: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of `size` bytes laid end to end, the segments: first start position, number of start positions, anchor, text."""
    gram = 24 if length >= 48 else 16  # of 16 bytes so many are shared by chance that ever more of a growing input would be compared
    window, total = length - gram + 1, len(a) - length + 1
    end = np.cumsum(size)
    begin = end - size
    edges = np.unique(np.concatenate([begin, np.maximum(begin, end - length + 1)]))
    edges = edges[edges < max(0, total)]
    starts, anchors = [], []
    for lo in range(0, total, CHUNK):  # bounded memory; overlapping by what a window reads
        count = min(CHUNK, total - lo)
        m, s = window_hashes(a[lo : lo + count + length - 1], gram), 1
        while 2 * s <= window:
            m = np.minimum(m[:-s], m[s:])
            s *= 2
        m = np.minimum(m[:count], m[window - s : window - s + count])
        new = np.ones(count, dtype=bool)
        new[1:] = m[1:] != m[:-1]
        new[edges[np.searchsorted(edges, lo) : np.searchsorted(edges, lo + count)] - lo] = True
        at = np.flatnonzero(new)
        starts.append(at + lo)
        anchors.append(m[at] & ANCHOR)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at, m = np.concatenate(starts), np.concatenate(anchors)
    n = np.diff(np.append(at, total))
    row = np.searchsorted(end, at, side="right")
    inside = at + length <= end[row]
    return at[inside], n[inside], m[inside], row[inside]


def _bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return np.mod(doc ^ (doc >> 17), buckets)


def _groups(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, size) of the runs of equal values."""
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(ordered)))


def _split(by: np.ndarray, *cols: np.ndarray) -> Iterator[tuple]:
    """(value, columns) for each value of `by`."""
    order = np.argsort(by, kind="stable")
    by, cols = by[order], [c[order] for c in cols]
    first, size = _groups(by)
    for s, e in zip(first.tolist(), (first + size).tolist(), strict=True):
        yield int(by[s]), [c[s:e] for c in cols]


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of a binary column without nulls laid end to end, their sizes)."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8))[at[0] : at[-1]], np.diff(at)


def _anchored(batches: Iterator[pa.RecordBatch], length: int, shards: int, buckets: int, common: int) -> Iterator[pa.RecordBatch]:
    """Rows (to, bucket, blob): anchors with their documents' buckets for shard `to`. An anchor that many documents of this
    batch share is told to its shard once, as of bucket -1, and its documents' rows (those with a bucket) only pass through."""
    for b in batches:
        _, _, m, row = segments(*_texts(b.column("text").cast(pa.binary())), length)
        if not len(m):
            continue
        at = _bucket(b.column("doc_id").to_numpy(), buckets).astype(np.int32)
        both = np.sort((m << np.uint64(16)) | row.astype(np.uint64))  # a slice has fewer than 2^16 rows
        both = both[_groups(both)[0]]
        m, own = both >> np.uint64(16), at[(both & np.uint64(2**16 - 1)).astype(np.int64)]
        first, size = _groups(m)
        many = size >= max(2, common)
        here = np.repeat(many, size)
        rows = []
        for bucket, (mm,) in _split(own[here], m[here]):
            rows.append((bucket % shards, bucket, _laid(_short(np.unique(mm)))))
        m, own = np.concatenate([m[~here], m[first[many]]]), np.concatenate([own[~here], np.full(int(many.sum()), -1, np.int32)])
        for to, (mm, oo) in _split((m % np.uint64(shards)).astype(np.int32), m, own):
            rows.append((to, None, _laid(_short(mm), oo)))
        yield pa.RecordBatch.from_pydict({"to": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([r[1] for r in rows], pa.int64()), "blob": pa.array([r[2] for r in rows], pa.binary())})


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, blob): the anchors of several documents, back to those documents' buckets."""
    own, found, out = [], [], []
    for b in batches:
        for bucket, raw in zip(b.column("bucket").to_pylist(), b.column("blob").to_pylist(), strict=True):
            if bucket is not None:
                out.append((bucket, raw))
            else:
                mm, oo = _arrays(raw)
                own.append(oo)
                found.append(_long(mm))
    if found:
        m, at = np.concatenate(found), np.concatenate(own)
        del found, own
        order = np.argsort(m)
        m, at = m[order], at[order]
        first, size = _groups(m)
        keep = np.repeat((size > 1) | (np.minimum.reduceat(at, first) < 0), size) & (at >= 0)
        for bucket, (mm,) in _split(at[keep], m[keep]):
            out.append((bucket, _laid(_short(np.unique(mm)))))
    for k in range(0, len(out), 500):
        part = out[k : k + 500]
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in part], pa.int64()), "blob": pa.array([r[1] for r in part], pa.binary())})


def _row(doc: int | None, text: bytes, spans: list[tuple[int, int]]) -> tuple:
    kept, last = hashlib.sha256(), 0
    for s, e in spans:
        kept.update(text[last:s])
        last = e
    kept.update(text[last:])
    return doc, len(text), sum(e - s for s, e in spans), len(spans), kept.hexdigest()


def _by_bucket(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, blob): documents, compressed together with those of their bucket in the batch."""
    for b in batches:
        ids, texts, rows = b.column("doc_id").to_pylist(), b.column("text").to_pylist(), []
        for bucket, (which,) in _split(_bucket(np.array(ids, np.int64), buckets), np.arange(len(ids))):
            rows.append((bucket, _packed([ids[i] for i in which.tolist()], [texts[i] for i in which.tolist()])))
        if rows:
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})


def _documents(docs: pa.Table) -> Iterator[tuple[int, bytes]]:
    for raw in docs.column("blob").to_pylist():
        yield from zip(*_unpacked(raw), strict=True)


def _name(doc: int, text: bytes) -> tuple:
    """Tells rows apart that share a doc_id."""
    return doc, len(text), zlib.crc32(text)


def _cut_out(docs: pa.Table, shared: pa.Table, length: int, shards: int) -> pa.Table:
    """Of one bucket: rows for shards (distinct segments with the smallest document of the bucket), and where they occur (kind `rest`)."""
    rows, marks = [], [_long(_arrays(raw)[0]) for raw in shared.column("blob").to_pylist()]
    if marks and docs.num_rows:
        marks = np.unique(np.concatenate(marks))
        ids, texts = zip(*_documents(docs), strict=True)
        text = b"".join(texts)
        start, n, anchor, row = segments(np.frombuffer(text, np.uint8), np.array([len(t) for t in texts], np.int64), length)
        hit = marks[np.minimum(np.searchsorted(marks, anchor), len(marks) - 1)] == anchor
        start, n, anchor, row = start[hit], n[hit], anchor[hit], row[hit]
        number: dict[bytes, int] = {}
        seg = np.array([number.setdefault(text[s:e], len(number)) for s, e in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)], np.int32)
        if len(seg):
            bucket = int(docs.column("bucket")[0].as_py())
            which, own = np.unique(row, return_inverse=True)
            begin = np.cumsum([0, *(len(t) for t in texts)])
            names = [_name(ids[i], texts[i]) for i in which.tolist()]
            rows.append(("rest", bucket, shards + bucket % shards, _packed(names, own.astype(np.int32), start - begin[row], seg)))
            keys, low, at = list(number), np.full(len(number), NONE), np.zeros(len(number), np.uint64)
            np.minimum.at(low, seg, np.array(ids, np.int64)[row])
            at[seg] = anchor
            for shard, (own,) in _split((at % np.uint64(shards)).astype(np.int32), np.arange(len(keys), dtype=np.int32)):
                mine = [keys[i] for i in own.tolist()]
                size = np.array([len(k) for k in mine], np.int32)
                rows.append(("segments", bucket, shard, _laid(own, low[own], size, np.frombuffer(b"".join(mine), np.uint8))))
    return pa.table({"kind": pa.array([r[0] for r in rows], pa.string()), "bucket": pa.array([r[1] for r in rows], pa.int64()), "to": pa.array([r[2] for r in rows], pa.int64()), "blob": pa.array([r[3] for r in rows], pa.binary())})


def smallest_documents(text: np.ndarray, size: np.ndarray, low: np.ndarray, length: int) -> np.ndarray:
    """For each start position of segments laid end to end, the smallest document with the same `length` bytes; else NONE."""
    laid = np.zeros(len(text) + len(size), dtype=np.int16)
    first = np.cumsum(size) - size
    laid[np.arange(len(text)) + np.repeat(np.arange(len(size)), size)] = text.astype(np.int16) + 2
    laid[np.cumsum(size + 1) - 1] = 1
    raw = np.zeros(len(laid) + 8, dtype=np.uint8)
    raw[: len(laid)] = np.maximum(laid - 2, 0)
    owner = np.repeat(np.arange(len(size)), size + 1)
    inside = np.arange(len(laid)) - np.repeat(first + np.arange(len(size)), size + 1)
    starts = inside <= size[owner] - length
    sa = suffix_array(laid, 258, length)
    sa = sa[starts[sa]]
    group = np.cumsum(~repeat_groups(raw, sa, length)) - 1
    best = np.full(group[-1] + 1 if len(group) else 0, NONE)
    np.minimum.at(best, group, low[owner[sa]])
    out = np.full(len(laid), NONE)
    out[sa] = best[group]
    return out[starts]


def _open(text: np.ndarray, size: np.ndarray, low: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start positions of segments laid end to end; of those, the ones whose string's hash segments of several smallest documents have)."""
    n = size - length + 1
    own = np.repeat(np.arange(len(size)), n)
    starts = np.arange(len(own)) + np.repeat(np.cumsum(size) - size - np.cumsum(n) + n, n)
    h = window_hashes(text, length)[starts]
    order = np.argsort(h)
    h = h[order]
    again = np.zeros(len(h) + 1, dtype=bool)
    again[1:-1] = h[1:] == h[:-1]
    order, h = order[again[1:] | again[:-1]], h[again[1:] | again[:-1]]
    out = np.zeros(len(own), dtype=bool)
    if len(h):
        first, count = _groups(h)
        lows = low[own[order]]
        out[order] = np.repeat(np.minimum.reduceat(lows, first) != np.maximum.reduceat(lows, first), count)
    return starts, out


def smallest_of_segments(text: np.ndarray, size: np.ndarray, low: np.ndarray, length: int) -> np.ndarray:
    """As smallest_documents, for distinct segments, most of which share no string with another."""
    starts, todo = _open(text, size, low, length)
    own = np.repeat(np.arange(len(size)), size - length + 1)
    out = low[own]
    if todo.any():
        new = todo.copy()  # runs of such starts within a segment
        new[1:] &= ~todo[:-1] | (own[1:] != own[:-1])
        first = np.flatnonzero(new)
        part = np.bincount(np.cumsum(new)[todo] - 1) + length - 1
        at = np.arange(part.sum()) + np.repeat(starts[first] - np.cumsum(part) + part, part)
        out[todo] = smallest_documents(text[at], part, low[own[first]], length)
    return out


def _sorted_shards(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (kind, bucket, blob): for each segment of a bucket, runs (first start, number, smallest document); other kinds pass."""

    def solve(parts: list[tuple]) -> Iterator[tuple]:
        number: dict[bytes, int] = {}
        owners, lows = [], []
        for bucket, (which, own, size, text) in parts:
            end, raw = np.cumsum(size), text.tobytes()
            mine = [number.setdefault(raw[s:e], len(number)) for s, e in zip((end - size).tolist(), end.tolist(), strict=True)]
            owners.append((bucket, which, np.array(mine, np.int64)))
            lows.append(own)
        low = np.full(len(number), NONE)
        np.minimum.at(low, np.concatenate([mine for _, _, mine in owners]), np.concatenate(lows))
        keys = list(number)
        size = np.array([len(k) for k in keys], np.int64)
        del number, parts
        found = smallest_of_segments(np.frombuffer(b"".join(keys), np.uint8), size, low, length)
        n = size - length + 1
        first = np.cumsum(n) - n
        new = np.ones(len(found), dtype=bool)
        new[1:] = found[1:] != found[:-1]
        new[first] = True
        run = np.flatnonzero(new)
        run_size, run_low = np.diff(np.append(run, len(found))), found[run]
        run_of = np.searchsorted(run, first)
        runs = np.diff(np.append(run_of, len(run)))
        inside = run - np.repeat(first, runs)
        for bucket, which, mine in owners:
            c = runs[mine]
            at = np.repeat(run_of[mine], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            yield bucket, _laid(np.repeat(which, c), inside[at].astype(np.int32), run_size[at].astype(np.int32), run_low[at])

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"kind": pa.array([r[0] for r in found], pa.string()), "bucket": pa.array([r[1] for r in found], pa.int64()), "blob": pa.array([r[2] for r in found], pa.binary())})

    held, now = [], None
    for b in _and_end(batches):
        for kind, bucket, to, raw in zip(*(b.column(c).to_pylist() for c in ("kind", "bucket", "to", "blob")), strict=True) if b is not None else [(None, None, None, None)]:
            if held and to != now:
                for k, r in solve(held):
                    yield rows([("found", k, r)])
                held = []
            now = to
            if kind == "segments":
                held.append((bucket, _arrays(raw)))
            elif kind:
                yield rows([(kind, bucket, raw)])


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _finish(docs: pa.Table, found: pa.Table, length: int) -> pa.Table:
    """The result's rows of one bucket."""
    got, cuts = [], {}
    kinds = list(zip(found.column("kind").to_pylist(), found.column("blob").to_pylist(), strict=True))
    got = [_arrays(raw) for kind, raw in kinds if kind == "found"]
    if got:
        seg, at, n, low = (np.concatenate(c) for c in zip(*got, strict=True))
        order = np.argsort(seg, kind="stable")
        seg, at, n, low = seg[order], at[order], n[order], low[order]
        for names, row, start, own in (_unpacked(raw) for kind, raw in kinds if kind == "rest"):
            first, last = np.searchsorted(seg, own), np.searchsorted(seg, own, side="right")
            c = last - first
            k = np.repeat(first, c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            r, s = np.repeat(row, c), np.repeat(start, c) + at[k]
            e = s + n[k] + length - 1
            later = low[k] < np.array([x[0] for x in names], np.int64)[r]
            r, s, e = r[later], s[later], e[later]
            bounds = np.searchsorted(r, np.arange(len(names) + 1))
            cuts |= {name: (s[bounds[i] : bounds[i + 1]], e[bounds[i] : bounds[i + 1]]) for i, name in enumerate(names) if bounds[i] < bounds[i + 1]}
    out = []
    for d, t in _documents(docs):
        spans = []
        if cuts and (mine := cuts.get(_name(d, t))):
            order = np.argsort(mine[0], kind="stable")
            a, b = mine[0][order], np.maximum.accumulate(mine[1][order])
            f = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))  # runs that touch are one
            spans = list(zip(a[f].tolist(), b[np.append(f[1:], len(a)) - 1].tolist(), strict=True))
        out.append(_row(d, t, spans))
    cols = list(zip(*out, strict=True)) if out else [[]] * 5
    return pa.table([pa.array(c, pa.string() if i == 4 else pa.int64()) for i, c in enumerate(cols)], names=[c.split()[0] for c in OUT.split(", ")])


def _numbers(docs: int, size: int, parts: int, bucket_docs: int) -> tuple[int, int, int]:
    """(tasks, shards, buckets) for documents of `size` bytes in all. A blob goes from each bucket to each shard, so both are
    as few as a worker's memory allows; they grow with the bytes, whatever the session's number of partitions."""
    tasks, shards = max(parts, -(-size // (32 << 20))), max(2 * parts, -(-size // (12 << 20)))
    return tasks, shards, max(1, -(-docs // bucket_docs), -(-size // (16 << 20)), min(parts, docs // 250))


def remove_repeats(docs: DataFrame, length: int = 50, bucket_docs: int = 4000, common: int = 32, broadcast_rows: int = 2_000_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of docs (doc_id, text; more columns are ignored).

    Removes each byte covered by a string of `length` bytes (24 or more) that also starts in a document with a smaller
    doc_id, judged on the input. Null text is empty. Documents equal to a smaller one are settled by their texts'
    hashes and only the smallest goes on; rows without doc_id are neither smaller nor larger than any and keep all;
    rows that share a doc_id remove nothing from each other; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    n = F.octet_length("text").cast("long")
    narrow = cut(rows.where("doc_id IS NOT NULL").select("doc_id", n.alias("n"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2")))
    # a table of its own, so that it is broadcast where it is small and Spark may split a hot group where it is not
    same = cut(narrow.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high").drop("high"))
    same = F.broadcast(same) if same.count() <= broadcast_rows else same
    copies = cut(narrow.join(same, ["n", "h1", "h2"]).where((F.col("doc_id") > F.col("low")) & (F.col("n") >= length)).select("doc_id", "n", "h1", "h2"))
    empty = hashlib.sha256().hexdigest()
    settled = copies.select("doc_id", F.col("n").alias("n_bytes"), F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(empty).alias("kept_sha256"))
    nameless = rows.where("doc_id IS NULL").select("doc_id", n.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    every, again = (d.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first() for d in (narrow, copies))
    tasks, shards, buckets = _numbers(every[0] - again[0], every[1] - again[1], int(spark.conf.get("spark.sql.shuffle.partitions")), bucket_docs)
    known = rows.where("doc_id IS NOT NULL").withColumns({"n": n, "h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit("second"), "text")})
    # texts meet the groups of equal ones, of which there are never more than copies
    mine = known.join(same, ["n", "h1", "h2"], "left").where((F.col("low").isNull()) | (F.col("doc_id") <= F.col("low")) | (F.col("n") < length)).select("doc_id", "text")
    sent = mine.mapInArrow(releasing(lambda it: _anchored(slices(it, 4000), length, shards, buckets, common)), "to long, bucket long, blob binary")
    shared = sent.repartition(tasks, "to").mapInArrow(releasing(_shared), "bucket long, blob binary")
    packed = mine.mapInArrow(releasing(lambda it: _by_bucket(it, buckets)), "bucket long, blob binary")
    kinds = "kind string, bucket long, to long, blob binary"
    parted = packed.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(lambda a, b: _cut_out(a, b, length, shards), kinds)
    found = parted.repartition(tasks, "to").sortWithinPartitions("to").mapInArrow(releasing(lambda it: _sorted_shards(it, length)), "kind string, bucket long, blob binary")
    # the packed documents' exchange is the same as above, so it is written once
    done = packed.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(lambda a, b: _finish(a, b, length), OUT)
    return done.unionByName(settled).unionByName(nameless)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
