"""Importance resampling, maximum-entropy scoring and vector codes against brute force, with the awkward rows of each."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import importance, maxent, partials, vector_codes

from ..conftest import SF

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LONG = " ".join(f"word{i % 977} of the long text{i % 31}" for i in range(20_000))
TEXTS = [None, "", "  \t\n ", "a", "Ünïcödé ÑÑ 日本 x", "the same text here and there and again for all to see at once, with more words than twenty of them in it all", LONG, LONG + " End", "x" * 30_000, "%%% !!! 12", "é" * 90 + " b " + "w" * 200 + "-" + "w" * 70 + " c"]
ROWS = [(i, t, 1.5) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], 2.5), (5, TEXTS[5], 2.5), (None, TEXTS[5], 0.0), (None, None, 0.0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, weight double")


def bag(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return [zlib.crc32(x.encode()) % 10_000 for x in [*w, *map(" ".join, zip(w, w[1:], strict=False))]], len(w)


def plain_resample(rows, target, percent=25):
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(bag(x)[0])
    for x in target:
        t.update(bag(x)[0])
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + 10_000) / ((s[b] + 1) * (nt + 10_000)))) for b in range(10_000)]
    out = []
    for d, x in rows:
        f, words = bag(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: len(able) * percent // 100]
    return sorted([(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r[:4], None) for r in able[len(drawn) :]] + [(*r[:4], None) for r in out if r[4] < 20], key=repr)


def test_resample(spark, docs):
    target = [LONG[:5000], TEXTS[5], None, ""]
    bench = spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string")
    got = sorted(map(tuple, importance.resample(docs, bench, 60).collect()), key=repr)
    assert got == plain_resample([r[:2] for r in ROWS], target, 60) and sum(r[4] is not None for r in got) == 3
    assert importance.resample(docs.where("1 = 0"), bench).count() == 0
    assert sorted(map(tuple, importance.resample(docs, bench.where("1 = 0")).collect()), key=repr) == plain_resample([r[:2] for r in ROWS], [])


def test_resample_tables(spark):
    con = duckdb.connect()
    rows = con.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    target = [x for (x,) in con.execute(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    assert sorted(map(tuple, importance.op11_target_importance_resampling(spark, SF).collect()), key=repr) == plain_resample(rows, target)


def test_features_in_pieces(monkeypatch):
    """Pieces of any size, cut anywhere, give the same features."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é1Z-  ") for _ in range(rng.randrange(0, 400))) for _ in range(40)] + [None, "", TEXTS[-1]]
    want = [Counter(bag(t)[0]) for t in texts]
    for piece in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(importance, "PIECE", piece)
        got = [Counter() for _ in texts]
        for arr, lo in ((pa.array(texts), 0), (pa.array(["zz", *texts]).slice(1), 0)):
            got, words = [Counter() for _ in texts], np.zeros(len(texts), int)
            for row, bucket, n in importance.features(arr, 10_000):
                words += n
                for r, b in zip(row.tolist(), bucket.tolist(), strict=True):
                    got[r][b] += 1
            assert got == want and words.tolist() == [bag(t)[1] for t in texts]


def test_tree_sum(spark):
    df = spark.range(0, 2000, 1, 70).selectExpr("id").mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([np.array([1, i], np.int64).tobytes() for i in b.column(0).to_pylist()])], names=["vector"]) for b in it), "vector binary")
    assert partials.tree_sum(df, 2).tolist() == [2000, 1999 * 1000]
    assert partials.tree_sum(df.where("vector IS NULL"), 2).tolist() == [0, 0]


# 12
def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + ["\n"]


def check_base(got, train, n_rows):
    c = Counter(w for t in train for w in words(t))
    n, v = sum(c.values()), len(c)
    assert len(got) == n_rows
    for r in got:
        w = words(r["text"])
        assert r["n_tokens"] == len(w) and r["n_known"] == sum(c[x] > 0 for x in w) and r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert r["score"] <= 0 and math.isfinite(r["score"])


@pytest.mark.parametrize("head", [1 << 20, 50])
def test_maxent_counts(spark, docs, monkeypatch, head):
    """Counts, known words and base scores, with and without words outside the broadcast head."""
    monkeypatch.setattr(maxent, "HEAD", head)
    shape = maxent.Shape(4, 4, 2, 64, 64)
    rows = docs.withColumnRenamed("weight", "ids").selectExpr("*", "text AS t")
    v = maxent.vocabulary(rows.where("doc_id <> 8 OR doc_id IS NULL"), shape)
    coded = maxent.encode(rows, v)
    got = [dict(r.asDict(), text=r["t"]) for r in maxent.score(coded, v, maxent.fit(coded, v, 2), ["doc_id", "t"]).collect()]
    check_base(got, [t for d, t, _ in ROWS if d != 8], len(ROWS))
    none = maxent.vocabulary(rows.where("1 = 0"), shape)
    coded = maxent.encode(rows, none)
    got = [dict(r.asDict(), text=r["t"]) for r in maxent.score(coded, none, maxent.fit(coded.where("1 = 0"), none), ["doc_id", "t"]).collect()]
    check_base(got, [], len(ROWS))
    assert maxent.score(maxent.encode(rows.where("1 = 0"), v), v, maxent.start(v), ["doc_id"]).count() == 0


def test_maxent_learns(spark):
    """On held-out documents the model gives more than the counts alone; the same from any partitioning."""
    got = maxent.op12_maxent_scoring(spark, SF).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2}
    assert sum(r["score"] for r in held) > 0.98 * sum(r["base_score"] for r in held) > sum(r["base_score"] for r in held)


def test_maxent_probabilities(spark):
    """After any tokens, the probabilities of all words and the rare classes sum to one, and equal a plain reading of the weights."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["red", "green", "blue", "on", "off"]) + rng.choice(["", "", "x", "y"]) for _ in range(30)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    v = maxent.vocabulary(df, maxent.Shape(3, 2, 2, 64, 64))
    coded = maxent.encode(df, v)
    m = maxent.fit(coded.repartition(7), v, 3)
    other = maxent.fit(coded.coalesce(1), v, 3)
    assert (m.by_class == other.by_class).all() and (m.by_member == other.by_member).all() and m.by_class.any()
    for before in ([], [0], [1, 3], [2, 5, 7, 0]):
        ids = [np.array([*before, s], np.uint16).tobytes() for s in range(8)]
        total = 0.0
        for e in maxent.events(ids):
            p, last = m.log10(e), e.place == len(before)
            total += (10 ** p[last]).sum()
            for row, x in zip(e.row[last], p[last], strict=True):  # by plain loops
                h = [0, 0, 0, *(b + 1 for b in before)][-3:]
                keys = [h[2] | 1 << 40, h[2] | h[1] << 20 | 2 << 40, h[1] | 3 << 40, h[0] | 4 << 40]
                at = lambda k, salt, size: int(maxent._mix(np.array([k]), salt)[0]) & (size - 1)
                by = [float(m.class_log[c]) + sum(float(m.by_class[at(k, 1, 64), c]) for k in keys) for c in range(5)]
                c = int(row) // 2 if row < 6 else int(row) - 3
                want = by[c] - math.log(sum(map(math.exp, by)))
                if row < 6:
                    inner = [float(m.member_log[c, i]) + sum(float(m.by_member[at(k | c << 44, 2, 64), i]) for k in keys[:3]) for i in range(2)]
                    want += inner[row % 2] - math.log(sum(map(math.exp, inner)))
                assert x == pytest.approx(want / math.log(10), abs=1e-4)
        assert total == pytest.approx(1, abs=1e-4)
    # a rare class's words and one unseen word share it
    for k in range(2):
        own = [r["c"] + 1 for r in v.counts.where(f"rare = {k}").collect() if r["key"] not in v.keys.to_pylist()[:6]]
        assert v.class_mass[3 + k] == sum(own) + 1


# 13
def plain_codes(rows, entries=256, rounds=4):
    kept = sorted(((k is None, k or 0, v, label, k) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: r[:3])
    q = [[math.floor(1024 * x) for x in r[2]] for r in kept]
    size = len(q[0]) // 4
    parts = [[x[p * size : (p + 1) * size] for x in q] for p in range(4)]
    books = [[list(x) for x in parts[p][:entries]] for p in range(4)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p: [min((apart(x, b), i) for i, b in enumerate(books[p])) for x in parts[p]]
    for _ in range(rounds):
        for p in range(4):
            own = [i for _, i in near(p)]
            for i in set(own):
                mine = [x for x, k in zip(parts[p], own, strict=True) if k == i]
                books[p][i] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [near(p) for p in range(4)]
    error = [sum(found[p][k][0] for p in range(4)) for k in range(len(q))]
    by = Counter()
    for r, e in zip(kept, error, strict=True):
        by[r[3]] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(r[4], "".join(f"{found[p][k][1]:02x}" for p in range(4)), error[k], by[r[3]], sha) for k, r in enumerate(kept)], key=repr)


@pytest.mark.parametrize("count", [5, 90])
def test_vector_codes(spark, count):
    rng = random.Random(count)
    value = lambda: rng.choice([0.0, -0.001, 0.5, -0.5, rng.uniform(-1, 1)])  # noqa: E731  many equal components, so many ties
    rows = [(i, [value() for _ in range(8)], rng.choice([None, 1, 2])) for i in range(count)]
    rows += [(900, None, 1), (901, [1.0] * 7 + [None], 1), (902, [1.0] * 7 + [float("nan")], 1), (903, [1.0] * 7 + [float("inf")], None), (3, [0.25] * 8, 1), (3, [0.25] * 8, 1), (None, [0.75] * 8, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' AS code", "1 AS error").repartition(5)
    got = vector_codes.compress(df, entries=20, rounds=3)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_codes(rows, 20, 3)
    assert vector_codes.compress(df.where("1 = 0")).count() == 0


def test_vector_codes_out_of_reach(spark):
    df = spark.createDataFrame([(0, [1e30] * 4, 1), (1, [0.5] * 4, 1), (2, [0.5] * 3, 1), (3, [], 1), (4, [0.25] * 4, 1)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in vector_codes.compress(df).collect()}
    assert got == {0: (None, None, 0), 1: ("00000000", 0, 0), 2: (None, None, 0), 3: (None, None, 0), 4: ("01010101", 0, 0)}


def test_vector_codes_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = vector_codes.op13_vector_code_compression(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(vector_codes.oracle_sql()).fetchall())


def test_nearest_of_equals():
    rng = np.random.default_rng(1)
    points = rng.integers(-3, 4, (200, 3))
    x = rng.integers(-5, 6, (500, 3))
    apart = ((x[:, None, :] - points[None]) ** 2).sum(2)
    which, best = vector_codes.nearest(vector_codes.build(points), x)
    assert (which == apart.argmin(1)).all() and (best == apart.min(1)).all()


# 5
def test_language_sample_without_ids(spark):
    """Rows without doc_id are sampled like others, however many there are, and equal rows count once."""
    from lodestone.llm import langid

    words = {"en": ["the", "house", "with", "water"], "xx": ["zuq", "qaz", "wyx", "qoq"]}
    rng = random.Random(4)
    rows = [(None, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for lang in words for _ in range(1000)] + [(None, "the same house with the same water", "en")] * 1000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, per_lang=10, centroids=2)
    assert set(model["lang"]) == {"en", "xx"} and len(model) == 4
    got = langid.predict(df, model).groupBy("lang", "lang_pred").count().collect()
    assert {(r["lang"], r["lang_pred"]) for r in got} == {("en", "en"), ("xx", "xx")}
    assert len(langid.fit(df.where("text LIKE 'the same%'"), per_lang=10, centroids=2)) == 1


def test_weights_added_and_draws_in_steps_are_the_plain_ones():
    rng = np.random.default_rng(5)
    n = maxent.STEP * 4 + 7
    weights, rows = rng.normal(size=(50, 11)).astype(np.float32), rng.integers(0, 50, (3, n))
    logits = rng.normal(size=(n, 11)).astype(np.float32)
    plain = logits.copy()
    for r in rows:
        plain += weights[r]
    maxent._add_rows(logits, weights, rows)
    assert (logits == plain).all()
    shares, u = np.exp(logits), rng.random(n).astype(np.float32)
    u[:3] = 0, 1, np.nextafter(np.float32(1), np.float32(0))
    sums = shares.cumsum(1)
    assert (maxent._drawn(shares, u) == np.minimum((sums <= (u * sums[:, -1])[:, None]).sum(1), 10)).all()
    assert len(maxent._drawn(shares[:0], u[:0])) == 0
    # what is held beside the rows is bounded by the step
    tracemalloc.start()
    maxent._add_rows(logits, weights, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * maxent.STEP * 11 * 4


@pytest.mark.parametrize("gathered", [1, 700, 1 << 18])
def test_counts_of_a_task_meet_before_they_leave_it(spark, monkeypatch, gathered):
    """Counts of many batches, added in the task after any number of keys, are those of all tokens."""
    monkeypatch.setattr(maxent, "GATHERED", gathered)
    rows = [(f"the same words here w{i}",) for i in range(3000)]
    docs = spark.createDataFrame(rows, "text string").coalesce(1)
    v = maxent.vocabulary(docs)
    got = {r["key"]: r["c"] for r in v.counts.collect()}
    assert got == {maxent.END: 3000, **dict.fromkeys(("the", "same", "words", "here"), 3000), **{f"w{i}": 1 for i in range(3000)}}


def test_logits_are_shifted_only_where_they_may_leave_float32():
    """Within bounds the draws and logs are those of shifted logits; weights beyond them bring the shift back, so nothing overflows."""
    rng, s = np.random.default_rng(7), maxent.Shape(4, 4, 2, 64, 64)
    made = lambda scale: maxent.Model(s, *(rng.normal(0, scale, (64, n)).astype(np.float32) for n in (6, 4)), rng.normal(-2, 1, 6).astype(np.float32), rng.normal(-2, 1, (4, 4)).astype(np.float32))
    ids = [rng.integers(0, 18, 300).astype(np.uint16).tobytes() for _ in range(4)]
    for scale, shift in ((1.0, False), (40.0, True)):
        model, shifted = made(scale), {"class": True, "member": True}
        assert model.shifts() == {"class": shift, "member": shift}
        with np.errstate(over="raise", invalid="raise", divide="raise"):
            for e in maxent.events(ids):
                assert np.allclose(model.log10(e), model.log10(e, shifted), atol=1e-4) and np.isfinite(model.log10(e)).all()
                for a, b in zip(model.drawn(e, np.arange(4)), model.drawn(e, np.arange(4), shifted), strict=True):
                    assert a[0] == b[0] and (a[3] != b[3]).mean() < 0.01
    empty = made(1.0)
    empty.member_log[2] = -1e9  # a class without members
    assert empty.shifts() == {"class": False, "member": False}


def test_gradients_leave_a_task_packed(spark, monkeypatch):
    """What a task of a round hands to the JVM is compressed blocks, far smaller than its vector; merging holds no whole vector."""
    sizes, whole = [], maxent.tree_sum
    monkeypatch.setattr(maxent, "tree_sum", lambda vectors, *a: sizes.extend(sum(map(len, r[0])) if isinstance(r[0], list) else len(r[0]) for r in vectors.collect()) or whole(vectors, *a))
    docs = spark.createDataFrame([(LONG,), ("a b c",)], "text string").repartition(2)
    v = maxent.vocabulary(docs)
    maxent.fit(maxent.encode(docs, v), v, 1)
    assert sizes and max(sizes) < 1 << 20  # a vector has 27 MB
    x = np.zeros(1 << 22, np.int32)
    x[::1000] = 5
    a, b = partials.pack(x), partials.pack(x[::-1])
    tracemalloc.start()
    both = partials.added(a, b, np.int32)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes // 4 and (partials.unpack(both, len(x), np.int32) == x + x[::-1]).all()


def test_tree_sum_packed(spark):
    """Packed vectors of any length and number a partition, none too."""
    n = partials.BLOCK + 3
    vector = lambda i: np.arange(n, dtype=np.int64) * i
    df = spark.range(0, 30, 1, 7).mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([partials.pack(vector(i)) for i in b.column(0).to_pylist()], pa.list_(pa.binary()))], names=["vector"]) for b in it), "vector array<binary>")
    assert (partials.tree_sum(df, n) == vector(sum(range(30)))).all()
    assert not partials.tree_sum(df.where("vector IS NULL"), n).any()
