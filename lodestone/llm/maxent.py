"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

Tokens are counted over the whole corpus. Frequent ones form classes; the others fall into rare classes by their last two
characters, in which they keep their share of the counts. A token's probability is that of its class given the
tokens before, times its share of the class given them too. Both factors are softmaxes over hashed features: the last token, the last
two, and skips over one and two tokens. The features start without effect, so the model starts from the counts.

Each round reads another share of the training documents: tasks count the features seen with each class and those the
model draws in their place, treeReduce adds these integers, and the driver moves each weight by the log of their ratio, a
gradient step scaled to the feature's count. Draws depend on document and place alone, so no partitioning changes the model.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import in_batches, releasing, shared_dir, slices, table
from .partials import pack, tree_sum

#: The key of the end of a text: no word holds white space.
END = "\n"
#: Words of at least so many bytes go by their SHA-256, so that keys have a size bound.
LONG = 64
#: Tokens that make up at least this share of all are broadcast: there can't be more of them than its inverse.
HEAD = 1 << 20
#: Bytes of texts that become tokens at once, and tokens whose softmaxes are computed at once.
PIECE, CHUNK = 1 << 20, 8192
#: Tokens whose weights are gathered at once, few enough to stay in a core's cache.
STEP = 512
#: Keys with counts that a task gathers before it adds those of equal keys and hands them on.
GATHERED = 1 << 18
#: Features that a task holds, of each kind, before it counts them.
HELD = 1 << 21
#: Logits within so much of zero need no shift: neither their exponentials nor sums of these leave float32.
SAFE = 80.0
#: Training tokens of a task.
TASK = 1 << 22


@dataclass(frozen=True)
class Shape:
    """Sizes of the model: classes of frequent words and their members, classes of rare words, rows of hashed features (powers of two)."""

    classes: int = 64
    members: int = 64
    rare: int = 16
    class_rows: int = 1 << 14
    member_rows: int = 1 << 15

    @property
    def words(self) -> int:
        return self.classes * self.members


def _rare_class(suffix: str, rare: int) -> int:
    return zlib.crc32(suffix.encode()) % rare


def _tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, pa.DictionaryArray]]:
    """(first row, words of each row, their keys in order) for a piece of rows at a time; a longer text is a piece of its own."""
    texts = texts.fill_null("").cast(pa.large_string())
    size = pc.binary_length(texts).to_numpy()
    lo = 0
    while lo < len(texts):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(size[lo:]), PIECE, "right")))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(lo, hi - lo)))
        flat = lists.flatten()
        full = pc.greater(pc.binary_length(flat), 0)
        owner = np.repeat(np.arange(hi - lo), lists.value_lengths().to_numpy())[full.to_numpy(zero_copy_only=False)]
        yield lo, np.bincount(owner, minlength=hi - lo), flat.filter(full).dictionary_encode()
        lo = hi


def _keys(words: pa.Array) -> pa.Array:
    """The keys of distinct words."""
    long = pc.greater_equal(pc.binary_length(words), LONG).to_numpy(zero_copy_only=False)
    if not long.any():
        return words
    out = words.to_numpy(zero_copy_only=False)
    out[long] = [hashlib.sha256(w.encode()).hexdigest() for w in out[long]]
    return pa.array(out, words.type)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder."""
    at = f"{shared_dir(df.sparkSession).rstrip('/')}/maxent-{uuid.uuid4().hex}-{name}"
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


@dataclass
class Vocabulary:
    """Counts of all training tokens; `counts` (key, c) is a table, the head's are in memory. `symbol`: the word, or words + rare class."""

    counts: DataFrame
    tokens: int
    types: int
    keys: pa.Array
    c: np.ndarray
    symbol: np.ndarray
    class_mass: np.ndarray
    member_mass: np.ndarray
    shape: Shape

    @property
    def least(self) -> int:
        """Tokens with fewer occurrences are not in the head."""
        return math.ceil(self.tokens / HEAD)


def vocabulary(docs: DataFrame, shape: Shape = Shape()) -> Vocabulary:
    """Counts the tokens of all texts of docs: words and an end each, the end of null and empty texts too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, ends = [], 0, 0

        def summed() -> Iterator[pa.RecordBatch]:
            of_ends = pa.table({"key": pa.array([END]), "n": pa.array([ends])})
            for b in pa.concat_tables([*held, of_ends]).group_by("key", use_threads=False).aggregate([("n", "sum")]).to_batches():
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n_sum")], names=["key", "n"])

        for b in slices(batches):
            ends += b.num_rows
            for _, _, words in _tokens(b.column(0)):
                n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                held.append(pa.table({"key": _keys(words.dictionary).cast(pa.string()), "n": pa.array(n)}))
                rows += len(n)
                if rows >= GATHERED:
                    yield from summed()
                    held, rows, ends = [], 0, 0
        if ends or held:
            yield from summed()

    each = in_batches(docs.select(F.col("text").cast("string").alias("text"))).mapInArrow(releasing(run), "key string, n long")
    suffix = F.crc32(F.substring("key", -2, 2).cast("binary")) % shape.rare
    counts = _stored(each.groupBy("key").agg(F.sum("n").alias("c")).withColumn("rare", suffix.cast("int")), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    least = math.ceil(total["n"] / HEAD)
    # at most HEAD rows of at most LONG bytes, and the end
    head = counts.where((F.col("c") >= least) | (F.col("key") == END)).toArrow().sort_by([("c", "descending"), ("key", "ascending")]) if total["n"] else None
    keys = head["key"].combine_chunks().cast(pa.large_string()) if head else pa.array([], pa.large_string())
    c = head["c"].to_numpy() if head else np.zeros(0, np.int64)
    symbol = np.arange(len(keys))
    if head:
        symbol[shape.words :] = shape.words + head["rare"].to_numpy()[shape.words :]
    # what the counts give each class and member, with one occurrence more a type and one for what no class has seen
    member = np.zeros(shape.words)
    n = min(len(keys), shape.words)
    member[:n] = c[:n] + 1
    mass = np.concatenate([member.reshape(shape.classes, shape.members).sum(1), np.ones(shape.rare)])
    for r in counts.groupBy("rare").agg(F.sum(F.col("c") + 1).alias("m")).collect():
        mass[shape.classes + r["rare"]] += r["m"]
    if head:
        np.subtract.at(mass, shape.classes + head["rare"].to_numpy()[:n], c[:n] + 1)
    return Vocabulary(counts, total["n"], total["v"], keys, c, symbol, mass, member, shape)


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """docs (text and the columns to keep) as symbols, stored: each row with `row`, n_tokens and

    ids (symbols, 16 bits each, the end last), head_n and head_log (known tokens of the head and their log10(c + 1)), rare_log (the same
    of those that the model has no member for), and tail, the words outside the head with their number. Columns of docs with these names are
    replaced. Repeated rows are rows of their own; null and empty texts are the end alone; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast((v.keys, v.c, v.symbol, v.shape))
    made = "n_tokens long, ids binary, head_n long, head_log double, rare_log double, tail array<struct<key:string,n:long>>"
    docs = docs.drop("row", *(x.split(" ")[0] for x in made.split(", ")))
    names = [x for x in docs.columns if x != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, c, symbol, shape = sent.value
        log = np.log10(c + 1.0)
        end = pc.index_in(pa.array([END], pa.large_string()), value_set=keys).to_pylist()[0] if len(keys) else None
        unknown = shape.words + _rare_class(END, shape.rare)
        for b in slices(batches):
            n_tokens, ids, sums, tails, tail_n, tail_of = [], [], [], [], [], []
            for lo, count, words in _tokens(b.column(b.schema.names.index("text"))):
                distinct = _keys(words.dictionary)
                at = (pc.index_in(distinct, value_set=keys) if len(keys) else pa.nulls(len(distinct), pa.int32())).fill_null(-1).to_numpy()
                out = at < 0
                own = np.where(out, 0, symbol[at] if len(keys) else 0)
                lookup = {}
                if out.any():
                    suffix = pc.utf8_slice_codeunits(distinct.filter(pa.array(out)), -2).dictionary_encode()
                    lookup = np.array([shape.words + _rare_class(s, shape.rare) for s in suffix.dictionary.to_pylist()])
                    own[out] = lookup[suffix.indices.to_numpy()]
                code, owner = words.indices.to_numpy(), np.repeat(np.arange(len(count)), count)
                where = at[code]
                known = where >= 0
                value = log[where[known]] if len(keys) else np.zeros(0)
                model = own[code][known] < shape.words
                ends = 0.0 if end is None else float(log[end])
                in_head = np.bincount(owner[known], minlength=len(count)) + (end is not None)
                head_log = np.bincount(owner[known], weights=value, minlength=len(count)) + ends
                rare_log = np.bincount(owner[known], weights=np.where(model, 0, value), minlength=len(count)) + (ends if end is not None and symbol[end] >= shape.words else 0)
                stop = np.cumsum(count)
                full = np.insert(own[code], stop, unknown if end is None else symbol[end]).astype(np.uint16)
                cuts = np.concatenate([[0], stop + np.arange(1, len(count) + 1)])
                ids += [full[a:z].tobytes() for a, z in zip(cuts, cuts[1:], strict=False)]
                n_tokens.append(count + 1)
                sums.append(np.stack([in_head, head_log, rare_log]))
                pair, times = np.unique(owner[~known].astype(np.int64) * len(distinct) + code[~known], return_counts=True)
                tails.append(distinct.take(pa.array(pair % max(1, len(distinct)))).cast(pa.string()))
                tail_n.append(times)
                tail_of.append(pair // max(1, len(distinct)) + lo)
            if not b.num_rows:
                continue
            sums, of = np.concatenate(sums, axis=1), np.concatenate(tail_of)
            entry = pa.StructArray.from_arrays([pa.concat_arrays(tails), pa.array(np.concatenate(tail_n).astype(np.int64))], names=["key", "n"])
            tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(b.num_rows + 1)), pa.int32()), entry)
            arrays = [pa.array(np.concatenate(n_tokens).astype(np.int64)), pa.array(ids, pa.binary()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), tail]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(x)) for x in names), *arrays], names=[*names, *(x.split(" ")[0] for x in made.split(", "))])

    schema = ", ".join(f"`{x}` {kind}" for x, kind in docs.dtypes if x != "text")
    coded = in_batches(docs.withColumn("text", F.col("text").cast("string"))).mapInArrow(releasing(run), f"{schema}, {made}" if schema else made)
    return _stored(coded.withColumn("row", F.monotonically_increasing_id()), "encoded")


def _mix(a: np.ndarray, salt: int) -> np.ndarray:
    """64 scattered bits of each number."""
    x = a.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Events:
    """Tokens of some rows with the tokens before them: row, place in the text, symbol, and the features' hashes."""

    row: np.ndarray
    place: np.ndarray
    symbol: np.ndarray
    before: list[np.ndarray]

    def context(self) -> list[np.ndarray]:
        """Keys of the features: the last token, the last two, the one before the last, and the one before that."""
        a, b, c = self.before
        return [a | 1 << 40, a | b << np.int64(20) | 2 << 40, b | 3 << 40, c | 4 << 40]


def events(ids: list[bytes]) -> Iterator[Events]:
    """All tokens of the rows, a chunk at a time."""
    sizes = np.array([len(x) // 2 for x in ids], np.int64)
    stop = np.cumsum(sizes)
    flat = np.frombuffer(b"".join(ids), np.uint16)
    for lo in range(0, len(flat), CHUNK):
        at = np.arange(lo, min(len(flat), lo + CHUNK))
        row = np.searchsorted(stop, at, "right")
        place = at - (stop[row] - sizes[row])
        # symbols from 1 on; 0 stands before a text
        before = [np.where(place >= k, flat[np.maximum(at - k, 0)].astype(np.int64) + 1, 0) for k in (1, 2, 3)]
        yield Events(row, place, flat[at].astype(np.int64), before)


def _add_rows(logits: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> None:
    """Adds to each row of logits the weights' rows that it names, one feature after the other."""
    held = np.empty((min(STEP, len(logits)), logits.shape[1]), weights.dtype)
    for lo in range(0, len(logits), STEP):
        part = logits[lo : lo + STEP]
        got = held[: len(part)]
        for r in rows[:, lo : lo + STEP]:
            np.take(weights, r, axis=0, out=got, mode="clip")  # rows are in range; `raise` would copy once more
            part += got


def _drawn(shares: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The column of each row's shares in which the running sum passes its u (0 to 1) of their sum; the last where rounding leaves none."""
    out = np.empty(len(shares), np.int64)
    for lo in range(0, len(shares), 4 * STEP):
        # a column is a stretch of memory, so a sum goes over many rows at once, in the order of the columns
        upto = np.ascontiguousarray(shares[lo : lo + 4 * STEP].T)
        for j in range(1, len(upto)):
            upto[j] += upto[j - 1]
        out[lo : lo + 4 * STEP] = (upto[:-1] <= u[lo : lo + 4 * STEP] * upto[-1]).sum(0, dtype=np.uint16)
    return out


@dataclass
class Model:
    """Weights of the features of both factors, by hashed feature, and the logs of what the counts give."""

    shape: Shape
    by_class: np.ndarray
    by_member: np.ndarray
    class_log: np.ndarray
    member_log: np.ndarray

    def shifts(self) -> dict[str, bool]:
        """For each factor, whether the logits of some context may leave SAFE, judged by the outermost weights; their top is taken off then."""
        out = {}
        for name, weights, base, n in (("class", self.by_class, self.class_log[None], 4), ("member", self.by_member, self.member_log, 3)):
            top = base.max(1)
            top = top[top > -1e8]  # a class without members is never asked
            out[name] = not len(top) or top.max() + n * max(0.0, weights.max()) > SAFE or top.min() + n * min(0.0, weights.min()) < -SAFE
        return out

    def factors(self, e: Events) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(factor, which tokens it holds for, features' rows, logits, outcome) of the two softmaxes."""
        s, keys = self.shape, e.context()
        rows = np.stack([(_mix(k, 1) & np.uint64(s.class_rows - 1)).astype(np.int64) for k in keys])
        head = e.symbol < s.words
        outcome = np.where(head, e.symbol // s.members, s.classes + e.symbol - s.words)
        logits = np.broadcast_to(self.class_log, (len(outcome), len(self.class_log))).copy()
        _add_rows(logits, self.by_class, rows)
        yield "class", np.arange(len(outcome)), rows, logits, outcome
        at = np.flatnonzero(head)
        own = outcome[at]
        rows = np.stack([(_mix(k[at] | own << np.int64(44), 2) & np.uint64(s.member_rows - 1)).astype(np.int64) for k in keys[:3]])
        logits = self.member_log[own]
        _add_rows(logits, self.by_member, rows)
        yield "member", at, rows, logits, e.symbol[at] % s.members

    def log10(self, e: Events, shifts: dict[str, bool] | None = None) -> np.ndarray:
        """log10 of each token's class, and of its share of the class if the model has it as a member."""
        out = np.zeros(len(e.symbol))
        shifts = self.shifts() if shifts is None else shifts
        for name, at, _, logits, outcome in self.factors(e):
            if shifts[name]:
                logits -= logits.max(1, keepdims=True, initial=-1e30)
            own = logits[np.arange(len(at)), outcome]
            out[at] += own - np.log(np.exp(logits, out=logits).sum(1))
        return out / math.log(10)

    def drawn(self, e: Events, seed: np.ndarray, shifts: dict[str, bool] | None = None) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """(factor, features' rows, outcome, outcome that the model draws); seed: a number for each row."""
        shifts = self.shifts() if shifts is None else shifts
        for salt, (name, at, rows, logits, outcome) in enumerate(self.factors(e)):
            if shifts[name]:
                logits -= logits.max(1, keepdims=True, initial=-1e30)
            np.exp(logits, out=logits)
            u = (_mix(seed[e.row[at]] ^ e.place[at], 3 + salt) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)
            yield name, rows, outcome, _drawn(logits, u)


def start(v: Vocabulary) -> Model:
    """The model that the counts give, with no weight on any feature."""
    s = v.shape
    with np.errstate(divide="ignore"):
        own = np.log(v.class_mass / v.class_mass.sum())
        inner = np.log(v.member_mass.reshape(s.classes, s.members)) - np.log(np.maximum(v.class_mass[: s.classes, None], 1))
    return Model(s, np.zeros((s.class_rows, s.classes + s.rare), np.float32), np.zeros((s.member_rows, s.members), np.float32), np.maximum(own, -1e9).astype(np.float32), np.maximum(inner, -1e9).astype(np.float32))


def fit(coded: DataFrame, v: Vocabulary, rounds: int = 5, smooth: float = 3.0, pace: float = 0.4) -> Model:
    """The weights, learned from the rows of `coded`, an encoded table: all of them, each in one of the rounds.

    A weight moves by `pace` times the log of (times seen + smooth) / (times drawn + smooth).
    """
    m, sc, s = start(v), coded.sparkSession.sparkContext, v.shape
    shares = [m.by_class.size, m.by_member.size]
    total = coded.agg(F.sum("n_tokens")).first()[0] or 0
    tasks = max(1, math.ceil(total / rounds / TASK), sc.defaultParallelism)
    for k in range(rounds if total else 0):
        sent = sc.broadcast(m)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            model = sent.value
            shifts = model.shifts()
            vector = np.zeros(2 * sum(shares), np.int32)
            cuts = np.cumsum([0, shares[0], shares[0], shares[1], shares[1]])
            got = {(name, i): vector[cuts[2 * k + i] : cuts[2 * k + i + 1]] for k, name in enumerate(("class", "member")) for i in (0, 1)}
            held = {of: [] for of in got}

            def settle(least: int) -> None:
                for of, x in held.items():
                    if sum(map(len, x)) > least:
                        part = np.concatenate(x)
                        x.clear()
                        np.add(got[of], np.bincount(part, minlength=len(got[of])), out=got[of], casting="unsafe")

            for b in batches:
                ids = b.column(0).to_pylist()
                seed = np.array([zlib.crc32(x) << 30 for x in ids], np.int64)
                for e in events(ids):
                    for name, rows, outcome, drawn in model.drawn(e, seed, shifts):
                        wide = s.members if name == "member" else s.classes + s.rare
                        for i, y in enumerate((outcome, drawn)):
                            held[name, i].append((rows * wide + y).ravel().astype(np.int32))
                    settle(HELD)
            settle(0)
            yield pa.RecordBatch.from_arrays([pa.array([pack(vector)], pa.list_(pa.binary()))], names=["vector"])

        part = coded.where(F.pmod(F.xxhash64("ids"), F.lit(rounds)) == k).select("ids").coalesce(tasks)
        found = tree_sum(in_batches(part).mapInArrow(releasing(run), "vector array<binary>"), 2 * sum(shares), np.int32)
        for weights, seen, drawn in zip((m.by_class, m.by_member), *(np.split(found, np.cumsum([shares[0], shares[0], shares[1]]))[k::2] for k in (0, 1)), strict=True):
            step = (seen + np.float32(smooth)).astype(np.float32)
            step /= (drawn + np.float32(smooth)).astype(np.float32)
            weights += pace * np.log(step, out=step).reshape(weights.shape)
        sent.destroy()
    return m


def score(coded: DataFrame, v: Vocabulary, m: Model, keep: list[str]) -> DataFrame:
    """Rows of an encoded table with the columns `keep`, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    sent = coded.sparkSession.sparkContext.broadcast((m, np.log10(v.class_mass[v.shape.classes :])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, mass = sent.value
        shifts = model.shifts()
        for b in slices(batches):
            ids, total = b.column(b.schema.names.index("ids")).to_pylist(), np.zeros(b.num_rows)
            for e in events(ids):
                p, at = model.log10(e, shifts), np.flatnonzero(e.symbol >= model.shape.words)
                p[at] -= mass[e.symbol[at] - model.shape.words]
                total += np.bincount(e.row, weights=p, minlength=b.num_rows)
            rest = [x for x in b.schema.names if x != "ids"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(x)) for x in rest), pa.array(total)], names=[*rest, "part"])

    # words outside the head are in fewer than one of HEAD tokens: no key is hot
    rare = v.counts.where((F.col("c") < v.least) & (F.col("key") != END)).select("key", "c")
    words = coded.select("row", F.explode("tail").alias("w")).select("row", "w.key", "w.n")
    tail = words.join(rare, "key").groupBy("row").agg(F.sum("n").alias("tail_n"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("tail_log"))
    plain = coded.select("row", *keep, "n_tokens", "head_n", "head_log", "rare_log", "ids")
    schema = ", ".join(f"`{x}` {kind}" for x, kind in plain.dtypes if x != "ids") + ", part double"
    scored = in_batches(plain).mapInArrow(releasing(run), schema).join(tail, "row", "left")
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    return scored.select(
        *keep, "n_tokens", (F.col("head_n") + F.coalesce("tail_n", F.lit(0))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("head_log") + tail_log - F.col("n_tokens") * math.log10(v.tokens + v.types + 1)).alias("base_score"), (F.col("part") + F.col("rare_log") + tail_log).alias("score"),
    )


def op12_maxent_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents` scored by what those outside the held-out fold teach."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", held.alias("held_out"), "text")
    v = vocabulary(docs.where(~F.col("held_out")))
    coded = encode(docs, v)
    return score(coded, v, fit(coded.where(~F.col("held_out")), v), ["doc_id", "held_out"])
