"""The training-data operators against brute force, round trips and held-out accuracy, with the awkward rows of each."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from lodestone.llm import common, decontam, embed_dedup, html_extract, langid, packing, pii, sharding, simhash, suffix_array, suffix_dedup, warc

from ..conftest import SF

P = pytest.importorskip("public_tokenizers")
VOCABULARY = P.path("word_bpe_49k.json")

LONG = " ".join(f"word{i % 977} of the long text{i % 31}" for i in range(20_000))
TEXTS = [None, "", "  \t\n ", "a", "Ünïcödé ñ 日本", "the same text here and there and again for all to see", "the same text here and there and again for all to see", LONG, LONG + " end", "x" * 30_000, "%%% !!! 12"]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with nulls, empty, blank, very long and repeated texts, a repeated and a null id, and a clashing extra column."""
    rows = [(i, t, "en" if t else None, "dup") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "en", "dup"), (None, TEXTS[5], "en", "dup"), (None, "only here without a number", "en", "dup")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


@pytest.fixture(scope="module")
def corpus(spark):
    return common.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def rows(corpus):
    return sorted((r["doc_id"], r["text"]) for r in corpus.collect())


def empty(df):
    return df.where("1 = 0")


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 430)] + [(500, i) for i in range(501, 540)]
    got = {x["node"]: x["root"] for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots(600, edges)
    assert got == {v: want[v] for e in edges for v in e if e[0] != e[1]}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1
PASSAGE = "At noon a train with Anna Brown left Paris and went 120 km in 3 hours. How fast did the train go on that day?"


def test_contaminated_questions(spark):
    bench = spark.createDataFrame([(0, PASSAGE, "x"), (1, "too short", "x"), (2, None, "x"), (3, "", "x")], "item_id long, text string, doc_id string")
    found = [
        (10, "bla bla. " + PASSAGE.replace("Anna Brown", "Carl Smith").replace("Paris", "Rome").replace("120 km", "90 miles").replace("3 hours", "2 hours")), (11, PASSAGE.upper()), (12, PASSAGE.replace("120", "3")),
        (13, None), (14, ""), (None, PASSAGE), (15, LONG + " " + PASSAGE), (16, PASSAGE), (16, PASSAGE), (17, LONG),
    ]
    df = spark.createDataFrame([(*f, 1) for f in found], "doc_id long, text string, item_id int")
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontam.contaminated(df, bench).collect()}
    assert got.pop((11, 0))  # names in capitals are words, so it is found by the rest
    assert got == {(10, 0): "reparameterised", (None, 0): "exact", (15, 0): "exact", (16, 0): "exact"}
    assert decontam.contaminated(empty(df), bench).count() == 0 and decontam.contaminated(df, empty(bench)).count() == 0


def test_contaminated_by_short_items(spark):
    """Items of one to seven template tokens are found at every offset, with other numbers too."""
    items = ["What is 7 times 8?", "Name the largest ocean of earth", "Who wrote the first of these books", "Photosynthesis", "42"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = [(10 * i + k, "So. " * k + t + " and then more") for i, t in enumerate(items) for k in range(4)] + [(90, "what is 3 times 4"), (91, "what is 7 times"), (92, "see 41 there"), (93, "what is 3 times 3")]
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontam.contaminated(spark.createDataFrame(found, "doc_id long, text string"), bench).collect()}
    assert got == {(10 * i + k, i): "exact" for i in range(5) for k in range(4)} | {(90, 0): "reparameterised"}


def test_contaminated_corpus(spark, corpus, rows):
    bench = common.table(spark, SF, "benchmark").collect()
    tokens = lambda t: re.findall(r"[^\W_]+", t.lower())
    want = set()
    for b in bench:
        key = " " + " ".join(tokens(b["text"])) + " "
        want |= {(d, b["item_id"]) for d, t in rows if key in " " + " ".join(tokens(t)) + " "}
    got = decontam.op1_template_decontamination(spark, SF)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and want


def plain_tokens(text):
    """Words and (type, value) slots, by patterns of their own: no names here."""
    out = []
    for m in re.finditer(r"[0-9]+(?:[.,:/][0-9]+)*|[^\W\d_]+", text):
        unit = out and isinstance(out[-1], tuple) and out[-1][0] == "n" and re.fullmatch(decontam.UNITS, m[0].lower()) and text[last : m.start()].strip(" ") == ""
        out.append(("n", m[0]) if m[0][0].isdigit() else ("u", m[0].lower()) if unit else m[0].lower())
        last = m.end()
    return out


def test_contaminated_against_brute_force(spark):
    """Every alignment of every pair: a run of six (or a whole shorter item) that holds a word or equal values, half the tokens, slots one to one."""
    rng, kind = random.Random(21), lambda x: x[0] if isinstance(x, tuple) else x + "."
    make = lambda n, k: " ".join(rng.choice([f"w{chr(97 + rng.randrange(k))}", str(rng.randrange(4)), f"{rng.randrange(3)} km", "the"]) for _ in range(n))
    items = [make(rng.randint(1, 14), 3) for _ in range(25)] + ["1 2 3 4 5 6 7 8", "9 9"]
    texts = [make(rng.randint(0, 40), 3) for _ in range(60)] + [make(rng.randrange(5), 3) + " " + items[i % 25] + " " + make(3, 3) for i in range(50)] + [" ".join(map(str, range(n))) for n in (9, 50)]
    want, all_items, all_docs = {}, [plain_tokens(t) for t in items], [plain_tokens(t) for t in texts]
    for i, a in enumerate(all_items):
        for d, b in enumerate(all_docs):
            for shift in range(-len(a) + 1, len(b)):
                own = [(x, b[k + shift] if 0 <= k + shift < len(b) else None) for k, x in enumerate(a)]
                same = [(x, y) for x, y in own if y is not None and kind(x) == kind(y)]
                w = min(6, len(a))
                runs = [own[k : k + w] for k in range(len(a) - w + 1)]
                seeded = any(all(y is not None and kind(x) == kind(y) for x, y in r) and (any(isinstance(x, str) for x, _ in r) or all(x == y for x, y in r)) for r in runs)
                slots = {p for p in same if isinstance(p[0], tuple)}
                if seeded and 2 * len(same) >= len(a) and len(slots) == len({x for x, _ in slots}) == len({y for _, y in slots}):
                    want[d, i] = max(want.get((d, i), (0, "")), (len(same), "exact" if all(x == y for x, y in slots) else "reparameterised"))
    got = decontam.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): (r["matched"], r["kind"]) for r in got.collect()} == want and len(want) > 100


def test_contaminated_by_long_lists(spark):
    """Texts of a hundred thousand names or a million numbers are read without recursion; a table of numbers meets no item of other numbers."""
    texts = ["the " + "Ab " * 100_000, "1," * 1_000_000, "see " + "1 " * 200_000, "la " * 100_000, "3 km " * 50_000, "\ue000\ue003 la"]
    items = [(0, "1 2 3 4 5 6 7 8"), (1, "la la la la la la la la la"), (2, "what is 1 2 3 4 5 6 7")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = decontam.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["matched"], r["kind"]) for r in got] == [(3, 1, 9, "exact")]


def test_templates_are_those_of_the_sql(spark, corpus):
    import duckdb

    odd = [(10**6 + i, t) for i, t in enumerate(["the Ab, Cd E Fg", "a AbC Ab", "x 1,2,3. 5 kmh 5 km", "im Öl Über, Ab", "1.", "ab Cd\n", "3  KM, 4 lbs"])]
    frame = spark.createDataFrame(odd, "doc_id long, text string").unionByName(corpus.select("doc_id", "text").where("text <> ''"))
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    want = dict(con.execute("WITH " + decontam._sql("documents", "doc_id", "d") + " SELECT doc_id, v FROM d").fetchall())
    assert {r["doc_id"]: r["v"] for r in frame.select("doc_id", decontam.tokens(F.col("text")).alias("v")).collect()} == want


def test_rows_without_contamination(spark):
    rows = [(None, PASSAGE, 1), (None, "clean words of its own", 2), (None, None, 3), (1, PASSAGE, 4), (1, "clean", 5), (2, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_hash int")
    bench = spark.createDataFrame([(0, PASSAGE)], "item_id long, text string")
    assert sorted(r["text_hash"] for r in decontam.without_contaminated(df, bench).collect()) == [2, 3, 5, 6]


def test_native_plan(spark):
    plan = decontam.op1_template_decontamination(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 2
def test_best_fit():
    r = random.Random(2)
    for _ in range(50):
        sizes = [r.randint(1, 100) for _ in range(r.randint(0, 80))]
        bins = packing.best_fit(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
        assert len(bins) <= 11 / 9 * -(-sum(sizes) // 100) + 1 or max(sizes) > 50


def test_encoder_is_the_tokenizer(rows):
    from tokenizers import Tokenizer

    r = random.Random(3)
    texts = [t for _, t in rows] + ["".join(r.choice("aB'sstrevm.,!%&# \n\t éÉßİΣσ́ñ0129²½<|endoftext|>日\x1c\x85-_\"()") for _ in range(r.randint(0, 80))) for _ in range(3000)]
    plain, encode = Tokenizer.from_file(VOCABULARY), packing.ChunkEncoder(VOCABULARY, most=500)
    for k in range(0, len(texts), 200):
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts[k : k + 200])] == [e.ids for e in plain.encode_batch(texts[k : k + 200], add_special_tokens=False)]


def check_pack(pieces, texts):
    from tokenizers import Tokenizer

    t, seqs, got = Tokenizer.from_file(VOCABULARY), {}, {}
    for r in pieces:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096
    want = {}
    for d, x in texts:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want.setdefault(d, []).extend((k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    return len(seqs), -(-sum(n for s in seqs.values() for _, n in s) // 4096)


def test_packing(spark, docs, rows):
    check_pack(packing.pack(docs, VOCABULARY).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert packing.pack(empty(docs), VOCABULARY).count() == 0
    n, least = check_pack(packing.op2_best_fit_packing(spark, SF).collect(), rows)
    assert n <= least + 1


def test_packing_by_tree(spark, corpus, rows):
    """Many small groups of bins, so that several rounds merge them."""
    pieces = packing.pack(corpus.repartition(16), VOCABULARY, group=2, fan_in=2).collect()
    check_pack(pieces, rows)


# 3
def test_warc_round_trip(spark, tmp_path):
    big, small = "<p>" + "é" * 800, "tiny"
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "", small), (5, "http://a b/\n5", small), (6, "u", None), (7, "u", ""), (8, "u", "y" * 300_000), (-9, "u", "neg")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    folder = f"file://{tmp_path}/w"
    (tmp_path / "w").mkdir()
    assert warc.archive_pages(df, folder) == len(rows)
    got = {r["page_id"]: r for r in warc.read_archives(spark, folder).collect()}
    assert len(got) == len(rows)
    for page_id, _, text in rows:
        raw, r = (text or "").encode(), got[page_id]
        assert r["payload_digest"] == hashlib.sha1(raw).hexdigest()
        if page_id in (1, 2):
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", 3, None)
        else:
            assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("response", None, raw)


def test_warc_rows_without_id_and_repeated(spark, tmp_path):
    big = "<p>" + "z" * 2000
    rows = [(1, "u", big)] * 3 + [(2, "u", big)] * 2 + [(None, "u", big), (None, None, None), (2, "u", big + "other")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.op3_warc_zstd(spark, str(tmp_path)).collect())
    assert got == Counter({(1, 2003, "revisit", 2): 3, (2, 2003, "response", None): 2, (None, 2003, "response", None): 1, (None, 0, "response", None): 1, (2, 2008, "response", None): 1})


def test_warc_of_an_empty_table_and_of_revisits_alone(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    none = spark.createDataFrame([], "page_id long, url string, html string")
    none.write.parquet(f"{tmp_path}/a/pages.parquet")
    assert warc.op3_warc_zstd(spark, f"{tmp_path}/a").count() == 0
    spark.createDataFrame([(i, "u", "same" * 300) for i in range(3000)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/b/pages.parquet")
    got = warc.op3_warc_zstd(spark, f"{tmp_path}/b", broadcast_rows=0).collect()
    assert Counter((r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got) == {("revisit", 2999, 1200): 2999, ("response", None, 1200): 1}


def test_warc_reads_a_compressed_dictionary_and_checks(spark):
    samples = [f"<html><body><p>page {i} with common words and more common words {i * 7}</p></body></html>".encode() for i in range(300)]
    raw = zstandard.train_dictionary(4096, samples).as_bytes()
    writer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    record = lambda i: warc.encode_record(i, "http://a", samples[i], warc._sha1(samples[i]), None, "2024-01-01T00:00:00Z")
    body = b"".join(writer.compress(record(i)) for i in range(50))
    for d in (raw, zstandard.ZstdCompressor().compress(raw)):
        assert [r["payload"] for r in warc.read_archive(warc.dictionary_frame(d) + body)] == samples[:50]
    with pytest.raises(zstandard.ZstdError):
        list(warc.read_archive(body))
    plain = zstandard.ZstdCompressor().compress(record(1))
    assert next(warc.read_archive(plain))["payload"] == samples[1]
    for broken in (plain[:-5], plain + b"junk", b"junk"):
        with pytest.raises((warc.WarcError, zstandard.ZstdError)):
            list(warc.read_archive(broken))
    for a, b in ((b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: ", b"Content-Length: 1"), (b"common", b"xommon"), (b"WARC-Type", b"WARC-Tipe")):
        with pytest.raises(warc.WarcError):
            warc.decode_record(record(1).replace(a, b, 1))


def test_warc_query(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in common.table(spark, SF, "pages").collect()}
    top = {}
    for i, h in pages.items():
        top[h] = max(top.get(h, i), i)
    for r in warc.op3_warc_zstd(spark, SF).collect():
        raw = pages[r["page_id"]]
        first = top[raw] if len(raw) >= 1000 else r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == r["page_id"] else ("revisit", first))


# 4
def plain_spans(t):
    luhn = lambda d: sum((lambda n: n - 9 * (n > 9))(int(x) * (1 + i % 2)) for i, x in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15])


def test_base_spans():
    r = random.Random(4)
    for _ in range(20_000):
        t = "".join(r.choice("a.@-+ 0123456789()é%") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(t) == plain_spans(t), t
    for t in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "@" * 100_000, "+1" * 100_000, "a@" * 100_000):
        pii.base_spans(t)  # linear in the text


def test_marginals_match_enumeration():
    r = np.random.default_rng(0)
    unary, pair = r.normal(size=(4, 5)), r.normal(size=(2, 5, 5))
    pair = (pair + pair.transpose(0, 2, 1)) / 2
    edges = np.array([(0, 1, 0), (1, 2, 1), (1, 3, 0)])  # a tree, where message passing is exact
    total = np.zeros((4, 5))
    for labels in np.ndindex(5, 5, 5, 5):
        w = np.exp(sum(unary[i, y] for i, y in enumerate(labels)) + sum(pair[k, labels[a], labels[b]] for a, b, k in edges))
        for i, y in enumerate(labels):
            total[i, y] += w
    assert np.allclose(pii.marginals(unary, edges, pair, rounds=100), total / total.sum(1, keepdims=True), atol=1e-4)


def test_field_spreads_labels(spark):
    """A number without its plus sign is a phone number where the document has the full one."""
    rows = [(i, f"call +1 ({100 + i}) 555-{1000 + i} or write a{i}@b.org; order {10000000 + i} of 4111 1111 1111 1112 text", "x") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    model = pii.fit_field(df)
    _, spans = pii.find_spans("call +1 (217) 555-1234 today. Later (217) 555-1234 again, not 20240101 though", model)
    assert [k for _, k, _ in spans] == [3, 3]
    got = pii.personal_data(df, model).collect()
    assert all(r["base_counts"][0] == 1 and r["base_counts"][3] == 1 for r in got)
    assert pii.redact(df, model).first()["text"].startswith("call <PHONE> or write <EMAIL>;")


def exact_added(text, model, sure=0.9):
    """Added spans by summing over all labellings of the nodes without a label."""
    nodes = pii.candidates(text, plain_spans(text))
    x, edges = pii.graph(text, nodes)
    unary, free = x @ model[0], [i for i, n in enumerate(nodes) if not n[1]]
    total, labels = np.zeros((len(nodes), 5)), [n[1] for n in nodes]
    scores = []
    for own in np.ndindex(*[5] * len(free)):
        for i, y in zip(free, own, strict=True):
            labels[i] = y
        scores.append((sum(unary[i, labels[i]] for i in free) + sum(model[1][k, labels[a], labels[b]] for a, b, k in edges), own))
    top = max(w for w, _ in scores)
    for w, own in scores:
        for i, y in zip(free, own, strict=True):
            total[i, y] += np.exp(w - top)
    p = total / np.maximum(total.sum(1, keepdims=True), 1e-300)
    return {(nodes[i][0], int(p[i].argmax()) - 1, nodes[i][2]): p[i].max() for i in free if p[i].argmax()}


def test_spans_of_disguised_documents(spark):
    """Fixture documents whose phones lost the plus and whose addresses say [at]: the spans are those of exact inference, and nearly all come back."""
    df = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "text")
    model = pii.fit_field(df.where("doc_id % 2 = 0"))
    hidden, back, wrong, sides = 0, 0, 0, 0
    for r in df.where("doc_id % 2 = 1").collect():
        t = (r["text"] or "").replace("+1 (", "1 (").replace("@", " [at] ")
        if not any(k in (0, 3) for _, k, _ in plain_spans(r["text"] or "")):
            assert not set(pii.find_spans(t, model)[1]) - set(plain_spans(t)) or t != r["text"]
            continue
        hidden += sum(k in (0, 3) for _, k, _ in plain_spans(r["text"]))
        base, spans = pii.find_spans(t, model)
        assert base == plain_spans(t) and set(base) <= set(spans)
        added = set(spans) - set(base)
        back += sum(k in (0, 3) for _, k, _ in added)
        wrong += sum(k not in (0, 3) for _, k, _ in added)
        if sum(not n[1] for n in pii.candidates(t, base)) <= 4:
            want = exact_added(t, model)
            assert {x for x, p in want.items() if p > 0.93} <= added <= {x for x, p in want.items() if p > 0.87}
            sides += len(added)
    assert hidden > 10 and back >= 0.9 * hidden and wrong == 0 and sides > 5


def test_hidden_labels_come_back(spark):
    """Half the base labels of held-out fixture documents hidden: the field gives back mails, addresses and phones, and nothing wrong."""
    df = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "text")
    model, rng, hidden, back = pii.fit_field(df.where("doc_id % 2 = 0")), random.Random(5), Counter(), Counter()
    for r in df.where("doc_id % 2 = 1").collect():
        nodes = pii.candidates(r["text"] or "", pii.base_spans(r["text"] or ""))
        hide = {n for n in nodes if n[1] and rng.random() < 0.5}
        truth = {(s, k - 1, e) for s, k, e in hide}
        added = set(pii.added_spans(r["text"], [(s, 0 if (s, k, e) in hide else k, e) for s, k, e in nodes], model, 0.9)) if nodes else set()
        assert added <= truth
        hidden.update(k for _, k, _ in truth)
        back.update(k for _, k, _ in added)
    assert sum(hidden[k] for k in (0, 1, 3)) > 5 and sum(back[k] for k in (0, 1, 3)) >= 0.9 * sum(hidden[k] for k in (0, 1, 3))


def test_a_repeated_number_takes_the_label_of_its_copy():
    """The skip edge decides: a 16-digit number alone stays, beside an observed card it is one."""
    w, pair = np.zeros((pii.FEATURES, 5)), np.zeros((2, 5, 5))
    pair[1] += 4 * np.eye(5)
    text = "a 4111111111111111 b 94111111111111111 c 7777666655554444"
    _, spans = pii.find_spans(text, (w, pair))
    assert spans == [(2, 2, 18), (21, 2, 38)]


def test_candidates_in_linear_time():
    for t in ("1 " * 500_000 + "a", "12 3.4 " * 150_000 + "a", "a@" + "b." * 400_000, "x" * 400_000 + " [at] y", "(at)" * 200_000, "1" * 1_000_000 + "a"):
        pii.candidates(t, [])
    assert pii.candidates("mail " + "n" * 100 + " [at] " + ".".join("abcdefghijkl"), [])[0] == (5, 0, 134)


def test_pii_rows(spark, docs, rows):
    model = pii.fit_field(docs)
    assert pii.personal_data(docs, model).count() == docs.count() and pii.redact(docs, model).columns == docs.columns
    assert pii.personal_data(empty(docs), pii.fit_field(empty(docs))).count() == 0
    for r in pii.op4_skip_chain_pii(spark, SF).collect():
        base = plain_spans(dict(rows)[r["doc_id"]])
        text = pii.joined(base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[1] == k for s in base) for k in range(4)]
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))


# 5
def test_language_held_out(spark, corpus):
    lang = {r["doc_id"]: r["lang"] for r in corpus.collect()}
    got = langid.op5_centroid_langid(spark, SF).collect()
    assert len(got) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_language_rows(spark, docs, corpus):
    model = langid.fit(corpus)
    got = langid.predict(docs, model).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["lang_pred"] == "und" and r["rejected"] and r["score"] == 0) == (not any(c.isalpha() for c in r["text"] or ""))
    assert langid.predict(empty(docs), model).count() == 0
    none = langid.fit(empty(docs))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}


def test_language_counts_do_not_depend_on_chunks(monkeypatch):
    texts = ["Straße und Käse über alles. " * 50, "", None, "ab", "x", "a b c d e f g " * 40, "ñ" * 300]
    whole = langid.counts(texts)
    for size in (3, 7, 64):
        monkeypatch.setattr(langid, "CHUNK", size)
        assert (langid.counts(texts) == whole).all()


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "local-cluster[1,1,1024]"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError):
        common.shared_dir(Session)


def test_language_counts_ignore_chunking():
    text = "Straße und Käse über alles. " * 12_000
    assert np.abs(langid.counts([text])[0] - np.sum([langid.counts(["Straße und Käse über alles. "])[0]] * 12_000, axis=0)).sum() < 50


# 6
def test_vectors(spark):
    r = np.random.default_rng(6)
    base = r.normal(size=(300, 24))
    x = [*base, *(base[:40] + r.normal(size=(40, 24)) * 0.05), *(base[0] + r.normal(size=(60, 24)) * 0.03), *base[5:10], *base[5:10] * 3]
    rows = [(i, [float(np.float32(c)) for c in v], i % 3) for i, v in enumerate(x)]
    n = len(rows)
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0] * 3, [1.0] * 3]
    rows += [(1000 + i, v, 0) for i, v in enumerate(odd)] + [(None, rows[0][1], 0)]
    got = {q["vec_id"]: q for q in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, keys int")).collect()}
    assert len(got) == len(rows)
    v = np.array([q[1] for q in rows[:n]])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    link = v @ v.T >= 0.95
    root = roots(n, np.argwhere(link).tolist())
    found = sum(got[i]["n_links"] for i in range(n)) / (link.sum() - n)
    assert 0.97 <= found <= 1 and all(got[i]["n_links"] <= link[i].sum() - 1 for i in range(n))
    assert sum(got[i]["component_id"] == root[i] for i in range(n)) >= 0.99 * n
    assert all(got[1000 + i]["n_links"] == 0 and got[1000 + i]["kept"] for i in range(5))
    assert got[1005]["n_links"] == got[1006]["n_links"] == 1 and got[1006]["component_id"] == 1005
    assert embed_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_in_blocks(spark, monkeypatch):
    """Hot keys dealt in pairs of blocks give the same counts."""
    r = np.random.default_rng(7)
    v = r.normal(size=16) + r.normal(size=(150, 16)) * 0.02
    df = spark.createDataFrame([(i, [float(np.float32(c)) for c in q]) for i, q in enumerate(v)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(embed_dedup, "BLOCK", 20)
    got = embed_dedup.near_vectors(df).collect()
    assert {q["n_links"] for q in got} == {149} and {q["component_id"] for q in got} == {0}


def test_estimate_is_unbiased_and_bounded():
    r = np.random.default_rng(8)
    x = r.normal(size=(2, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    est, over = [], 0
    for seed in range(400):
        q = np.linalg.qr(np.random.default_rng(seed).normal(size=(64, 64)))[0]
        tx, ty = q @ x[0], q @ x[1]
        factor = np.abs(tx).sum()
        est.append(np.where(tx > 0, 1, -1) @ ty / factor)
        over += embed_dedup._upper(np.where(tx > 0, 1.0, -1.0)[None], np.array([factor]), ty[None], 3.0, True)[0] >= x[0] @ x[1]
    assert abs(np.mean(est) - x[0] @ x[1]) < 0.02 and over >= 396


# 7
def test_suffix_array():
    r = np.random.default_rng(9)
    for n in [*range(1, 30), 200, 1000]:
        for k in (1, 2, 4, 26):
            x = r.integers(1, k + 1, n)
            b = bytes(x.astype(np.uint8))
            assert suffix_array.suffix_array(x, k + 1, 10**6).tolist() == sorted(range(n), key=lambda i: b[i:])


def plain_removal(rows, length=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for k in range(len(b) - length + 1):
                g = b[k : k + length]
                first[g] = min(first.get(g, d), d)
    out = Counter()
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1) if d is not None else ():
            if first[b[k : k + length]] < d:
                gone[k : k + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[d, len(b), sum(gone), sum(gone[k] > (gone[k - 1] if k else 0) for k in range(len(b))), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeats(spark, docs, rows):
    count = lambda df: Counter(tuple(r) for r in df.collect())
    assert count(suffix_dedup.op7_suffix_array_dedup(spark, SF)) == plain_removal(rows)
    small = docs.where("text IS NULL OR length(text) < 40000")
    assert count(suffix_dedup.remove_repeats(small, common=2)) == plain_removal([(r["doc_id"], r["text"]) for r in small.collect()])
    assert suffix_dedup.remove_repeats(docs).count() == docs.count() and suffix_dedup.remove_repeats(empty(docs)).count() == 0


def test_repeats_in_a_small_alphabet(spark):
    r = random.Random(10)
    pool = ["".join(r.choice("ab\x00\xff") for _ in range(70)) for _ in range(6)]
    rows = [(i % 25, "".join(r.choice(pool)[r.randrange(20) :] for _ in range(r.randint(0, 6)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(x) for x in suffix_dedup.remove_repeats(df, bucket_docs=5, common=3).collect()) == plain_removal(rows)


def test_few_suffixes_of_repeated_passages_are_sorted(monkeypatch):
    """A passage between the same neighbours, or strings that only one smallest document has, need no sorting; where only a part repeats, bytes decide."""
    r = random.Random(12)
    word = lambda n: bytes(r.choice(b"abcdefghij ") for _ in range(n))
    body = word(60)
    segs = [word(r.randint(60, 90)) for _ in range(3000)] + [word(20) + body[k : k + 55] for k in range(5) for _ in range(2)] + [b"ab" * 40, b"ab" * 45]
    size, low = np.array([len(s) for s in segs]), np.array([r.randrange(900) for _ in segs])
    first: dict[bytes, int] = {}
    for s, d in zip(segs, low.tolist(), strict=True):
        for k in range(len(s) - 49):
            first[s[k : k + 50]] = min(first.get(s[k : k + 50], d), d)
    want = [first[s[k : k + 50]] for s in segs for k in range(len(s) - 49)]
    seen, sort = [], suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda t, *a: seen.append(len(t)) or sort(t, *a))
    text = np.frombuffer(b"".join(segs), np.uint8)
    assert suffix_dedup.smallest_of_segments(text, size, low, 50).tolist() == want
    assert 0 < sum(seen) < len(text) / 50
    monkeypatch.setattr(suffix_dedup, "window_hashes", lambda a, width: np.zeros(len(a) - width + 1, np.uint64))  # hashes that tell nothing apart
    assert suffix_dedup.smallest_of_segments(text, size, low, 50).tolist() == want and sum(seen) > len(text)


def test_segments_share_anchors_by_repeats_not_by_chance():
    """Of prose from few words many 16-byte grams recur; the segments compared are those with a repeated string, at any place of a long text."""
    r = random.Random(13)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(60)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n)).encode()
    passage = prose(30)
    texts = [prose(400) for _ in range(60)] + [b"", b"short", prose(25_000) + passage + prose(40), prose(25_000) + passage + prose(3)]
    start, n, anchor, row = suffix_dedup.segments(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]), 50)
    begin = np.cumsum([0, *(len(t) for t in texts)])
    assert [int(n[row == k].sum()) for k in range(len(texts))] == [max(0, len(t) - 49) for t in texts]
    of: dict[bytes, set] = {}
    for s, c, a, k in zip(start.tolist(), n.tolist(), anchor.tolist(), row.tolist(), strict=True):
        for x in range(s - begin[k], s - begin[k] + c):
            of.setdefault(texts[k][x : x + 50], set()).add(a)
    assert all(len(a) == 1 for a in of.values())  # equal strings meet
    known: dict[int, set] = {}
    for a, k in zip(anchor.tolist(), row.tolist(), strict=True):
        known.setdefault(a, set()).add(k)
    assert sum(c for c, a in zip(n.tolist(), anchor.tolist(), strict=True) if len(known[a]) > 1) < n.sum() / 10


def test_blobs_of_repeats_grow_little_faster_than_the_input():
    """Buckets times shards, at 600 partitions for 6 GB of Parquet; and shards that fit a worker whatever the session's partitions."""
    docs, size = 3_000_000, 10 << 30
    tasks, shards, buckets = suffix_dedup._numbers(docs, size, 600, 4000)
    assert shards * buckets <= 1_000_000 and buckets >= tasks
    for parts in (1, 8, 200):
        tasks, shards, buckets = suffix_dedup._numbers(docs, size, parts, 4000)
        assert size / tasks <= 32 << 20 and size / shards <= 12 << 20 and size / buckets <= 16 << 20
    assert suffix_dedup._numbers(0, 0, 8, 4000)[2] == 1


def test_repeats_of_copies_beyond_a_broadcast(spark):
    """Copies of texts, joined and broadcast: rows that share a doc_id, null and short texts among them."""
    r = random.Random(14)
    pool = [None, "", "x" * 49, *("".join(r.choice("abc") for _ in range(120)) for _ in range(4))]
    rows = [(r.choice([None, *range(30)]), r.choice(pool)) for _ in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (0, 1000):
        assert Counter(tuple(x) for x in suffix_dedup.remove_repeats(df, bucket_docs=5, broadcast_rows=limit).collect()) == plain_removal(rows)


# 8
def check_shards(got, rows, shards=8):
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and max(sizes[s] for s in range(shards)) - min(sizes[s] for s in range(shards)) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)


def test_shards(spark, docs, rows):
    check_shards(sharding.shard_rows(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sharding.shard_rows(empty(docs)).count() == 0
    got = sharding.op8_label_propagation_sharding(spark, SF).collect()
    check_shards(got, rows)
    together = {}
    for r in got:
        together.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert sum(len(v) > 1 for v in together.values()) <= 2


def test_shards_with_a_hot_group(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 400}") for i in range(1200)]
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_shards(got, rows)
    text = dict(rows)
    cuts = Counter(t for t, _ in {(text[r["doc_id"]], r["shard"]) for r in got})
    assert cuts["hot"] >= 3 and sum(n > 1 for t, n in cuts.items() if t != "hot") <= 40


# 9
def plain_fingerprint(text, k=3):
    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay():
    g = simhash.golay()
    words = np.random.default_rng(11).integers(0, 1 << 23, 5000).astype(np.uint32)
    codes = words ^ g.error[g.syndrome(words)]
    assert (g.syndrome(codes) == 0).all() and (np.bitwise_count(words ^ codes) <= 3).all()
    row, key, own = g.keys(words)
    keys = [set() for _ in words]
    for r, k in zip(row.tolist(), key.tolist(), strict=True):
        keys[r].add(k)
    assert max(map(len, keys)) <= 7 and own.sum() == len(words)
    rng = random.Random(12)
    for i, w in enumerate(words.tolist()[:500]):
        near = np.array([w ^ 1 << rng.randrange(23) ^ 1 << rng.randrange(23)], np.uint32)
        assert keys[i] & set(g.keys(near)[1].tolist())


def test_simhash_links(spark, rows, docs):
    flipped = random.Random(13)
    base = [flipped.getrandbits(64) for _ in range(200)]
    fps = base + [b ^ sum(1 << x for x in flipped.sample(range(64), flipped.randint(1, 4))) for b in base for _ in range(3)]
    fps = list(dict.fromkeys(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame(list(enumerate(signed)), "node long, f0 long"), 3, simhash.exact_and_segment_keys, 1).collect()
    want = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert roots(len(fps), [tuple(e) for e in edges]) == roots(len(fps), want)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op9_golay_simhash(spark, SF).collect()}
    f = [plain_fingerprint(t) for _, t in rows]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 3])
    assert got == {d: (f"{f[i]:016x}", rows[root[i]][0]) for i, (d, _) in enumerate(rows)}


def test_simhash_rows(docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert by[0] == by[1] == by[2] == 0 and by[5] == by[6] == 5 and by[7] == by[8] == 7
    assert sorted((r["component_id"] or -1) for r in got if r["doc_id"] is None) == [-1, 5]
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_near_copies_are_those_of_the_similarity(spark):
    """Edited copies from 0.6 to 1: the components are those of all pairs with a true similarity of 0.8."""
    rng, texts = random.Random(17), []
    for k in range(120):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 400]))]
        texts.append(base)
        for _ in range(12 if k == 0 else 2):  # a group of over 8
            copy = list(base)
            for at in rng.sample(range(len(copy)), max(1, len(copy) * rng.randint(1, 5) // 100)):
                copy[at] = f"new{rng.randrange(10**9)}"
            texts.append(copy)
    texts += [["same"] * 300 + [f"u{i}x{j}" for j in range(40)] for i in range(3)]  # one shingle repeated, little else alike
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    want = [(i, j) for i in range(len(sets)) for j in range(max(0, i - 15), i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == roots(len(texts), want) and len(want) > 80


@pytest.mark.parametrize("cell_rows", [3, 2048])
def test_prefix_pairs_hold_all_similar_sets(spark, cell_rows):
    """Against all pairs: none of the similarity is missed whether shingles are dealt in cells or not; sets of one root and empty ones give none."""
    rng, sets = random.Random(5), [set(), {7}, {7, 8}]
    for n in (1, 4, 5, 9, 10, 60):
        body = [rng.randrange(-(2**63), 2**63) for _ in range(n)]
        for _ in range(25):
            kept = [x for x in body if rng.random() > 0.08]
            sets.append({*kept, *(rng.randrange(-(2**63), 2**63) for _ in range(rng.randrange(0, 1 + n // 6)))})
    rows = [(k - 40, k if k % 4 else 0, sorted(x)) for k, x in enumerate(sets)]
    got = {(r["a"], r["b"]) for r in simhash.prefix_pairs(spark.createDataFrame(rows, "text_hash long, root long, s array<long>"), 0.8, cell_rows).collect()}
    want = {(a[0], b[0]) for k, b in enumerate(rows) for a in rows[:k] if a[1] != b[1] and (x := set(a[2])) | (y := set(b[2])) and len(x & y) >= 0.8 * len(x | y)}
    apart = {(a[0], b[0]) for k, b in enumerate(rows) for a in rows[:k] if a[1] != b[1]}
    assert want and want <= got <= apart and len(got) < len(apart) / 4


def test_a_family_does_not_verify_its_pairs(spark, monkeypatch):
    """Texts with a common body, all below the similarity, and a few true copies: what is verified grows with the texts, not with their pairs."""
    verified, real = [], simhash.similar
    monkeypatch.setattr(simhash, "similar", lambda pairs, *rest: verified.append(pairs.count()) or real(pairs, *rest))
    body, sizes = " ".join(f"b{k}" for k in range(120)), (500, 2000)
    for n in sizes:
        rows = [(i, f"{body} " + " ".join(f"u{i}x{k}" for k in range(20))) for i in range(n)]
        rows += [(n + i, rows[i][1] + " z") for i in range(5)]
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert all(got[i] == i for i in range(n)) and all(got[n + i] == i for i in range(5))
        verified.append(None)
    first, second = (sum(part) for part in (verified[: verified.index(None)], verified[verified.index(None) + 1 : -1]))
    print(first, second)
    assert second <= 6 * first and second < 60 * sizes[1]


def test_texts_apart_are_named_once_for_most_keys(spark):
    """A family under many keys of many tasks: each text is given for its segments and MinHash keys, not for each codeword; the texts are those of all pairs."""
    rng, body = random.Random(19), random.Random(20).getrandbits(256)
    fps = [body ^ sum(1 << x for x in rng.sample(range(256), 6)) for _ in range(300)] + [rng.getrandbits(256) for _ in range(50)]
    words = [[(f >> 64 * i) % 2**64 for i in range(4)] for f in fps]
    rows = [(k, *(w - 2**64 if w >> 63 else w for w in ws), -1 - rng.randrange(2**62), k) for k, ws in enumerate(words)]
    classes = spark.createDataFrame(rows, "node long, f0 long, f1 long, f2 long, f3 long, m0 long, root long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = [r["a"] for r in simhash.links(classes, 64, simhash.segment_and_bits_keys, 4, ("m0",), True).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert set(got) == set(range(300)) and len(got) <= 300 * 23


# 10
HTML = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body><header>H</header><nav><ul><li>menu</li></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- c <article>no</article> --><article class="post"><header>by x</header><h1>Title &amp; more</h1><p>First <b>bold</b>er&nbsp;text<br>line</p><div class="ad"><p>Buy</p></div>
<aside>side</aside><form><input>f</form><p>a &lt; b &#x41; 1 < 2<section id="comments"><p>reader</p></section></article><footer>F</footer>"""


def test_html():
    assert html_extract.blocks(HTML)[:2] == (["Title & more", "First bolder text line", "a < b A 1 < 2"], True)
    assert {"H", "menu", "We use cookies", "by x", "Buy", "side", "f", "reader", "F"} == set(html_extract.blocks(HTML)[2])
    assert html_extract.blocks("") == ([], False, []) and html_extract.blocks("plain") == (["plain"], False, [])
    assert html_extract.blocks("<article><p>x</p><script>never ends <p>y</p>")[0] == ["x"]
    assert html_extract.blocks("<nav>open <p>text</p>")[0] == ["open", "text"]
    for page in ("<" * 20_000, "<a " * 20_000, "<div>" * 20_000 + "x", "<!--" * 5_000, '<p a="' * 3_000):
        html_extract.blocks(page)


def test_pages(spark):
    for r in html_extract.op10_host_html_extraction(spark, SF).collect():
        page = spark.read.parquet(f"{SF}/pages.parquet").where(F.col("page_id") == r["page_id"]).first()["html"] if r["page_id"] < 5 else None
        if page:
            import html

            body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
            assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split()) and r["n_chars"] == len(r["text"])


def test_pages_without_article(spark):
    """Runs that a host's pages share go, unique ones stay; other hosts don't matter."""
    shared = "<div>home about us contact and all our terms of use apply here</div>"
    rows = [(i, f"https://{h}.org/{i}", f"<body>{shared}<p>unique text number {i} of this very page with words w{i} x{i} y{i}</p></body>") for i, h in enumerate(["a", "a", "a", "b"])]
    rows += [(10, None, None), (11, "https://a.org", ""), (12, "nonsense", "<p>lone</p>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert all("home about" not in got[i] and f"w{i} x{i} y{i}" in got[i] for i in range(3)) and "home about" in got[3]
    assert (got[10], got[11], got[12]) == ("", "", "lone")
    assert html_extract.extract(empty(df)).count() == 0


def test_pages_keep_their_own_text(spark):
    """Copies of a page, class words on or around an article, and article tags in scripts take no text away."""
    words = "this is the one story that both of the pages tell in the same words"
    for page in (f'<article class="post has-sidebar"><p>{words}</p></article>', f'<main class="no-sidebar">{words}</main>', f'<div id="page-with-comments"><article>{words}</article><p>x</p></div>', f'<div class="sponsored"><div role="main">{words}</div></div>'):
        assert html_extract.blocks(page)[:2] == ([words], True)
    assert html_extract.blocks(f'<article>{words}<div class="comments">reader</div></article><div class="ad">Buy</div>') == ([words], True, ["reader", "Buy"])
    assert html_extract.blocks('<div hidden><article>no</article></div>')[0] == []
    menu = "<div>home about us contact and all our terms of use apply here</div>"
    rows = [(i, f"https://a.org/{i}", f"<body>{menu}<p>{words} and more words make it the longest</p></body>") for i in range(2)]
    rows += [(2, "https://a.org/2", f"<body><script>'<article>'</script>{menu}<p>another page that says something of its own and is longest here by far</p></body>")]
    second = "<p>its second part is the same at two addresses with other things around it</p>"
    rows += [(i, f"https://a.org/{i}", f"<body>{menu}<p>the first part of an article at two addresses is its longest part by a word</p>{second}<p>seen {i}</p></body>") for i in (3, 4)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("home about" not in t for t in got.values()) and all("first part of" in got[i] and "its second part" in got[i] for i in (3, 4))
    assert got[0] == got[1] == f"{words} and more words make it the longest" and "home about" not in got[2] and "another page" in got[2]


def plain_runs(hosts, texts, pages, run, least):
    """shared_runs() by counting every window."""
    seen = {}
    for h, t, p in zip(hosts, texts, pages, strict=True):
        for k in range(max(1, len(t) - run + 1)):
            seen.setdefault((h, tuple(t[k : k + run])), set()).update(p)
    return [[k for k in range(max(1, len(t) - run + 1)) if len(seen[h, tuple(t[k : k + run])]) >= least] for h, t in zip(hosts, texts, strict=True)]


def test_host_suffix_array():
    rng = random.Random(31)
    for run in (1, 3, 5, 8):
        hosts = [rng.randrange(3) for _ in range(60)]
        texts = [[rng.choice("ab" if i % 3 else "abcdef") for _ in range(rng.randint(1, 30))] for i in range(60)]
        pages = [sorted(rng.sample(range(8), rng.randint(1, 3))) for _ in range(60)]
        got = html_extract.shared_runs(np.array(hosts), texts, pages, run, 3)
        assert [g.tolist() for g in got] == plain_runs(hosts, texts, pages, run, 3)
        for text in texts:
            if len(text) >= run >= 5:
                at = [(s, e) for _, s, e in html_extract.segments(text, run)]
                assert [k for s, e in at for k in range(s, e - run + 1)] == list(range(len(text) - run + 1))


def test_pages_against_brute_force(spark):
    """Pages without articles, of hosts in one array and dealt to many: what is left is what counting every window leaves."""
    rng = random.Random(32)
    vocabulary = [f"w{k}" for k in range(400)]
    common = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 20]))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 25))) + (" " + rng.choice(common) if rng.random() < 0.6 else "") for _ in range(rng.randint(1, 5))]
        frame = [rng.choice(common) for _ in range(2)]
        rows.append((i, f"http://h{0 if i % 3 else i % 7}.org/{i}", parts, frame))
    rows += [(1000 + i, rows[0][1], rows[0][2], rows[0][3]) for i in range(5)]  # copies count as one page
    df = spark.createDataFrame([(i, u, "<nav>" + "</nav><nav>".join(f) + "</nav><p>" + "</p><p>".join(p) + "</p>") for i, u, p, f in rows], "page_id long, url string, html string").repartition(5)
    host = lambda u: u.split("/")[2]
    texts = [(host(u), b.split(" "), str(p)) for _, u, p, f in rows for b in p + f]
    shared = {}
    for h, t, page in texts:
        for k in range(max(1, len(t) - 7)):
            shared.setdefault((h, tuple(t[k : k + 8])), set()).add(page)
    want = {}
    for i, u, p, _ in rows:
        body, out = max(range(len(p)), key=lambda k: (len(p[k]), -k)), []
        for k, b in enumerate(p):
            t = b.split(" ")
            gone = {x for at in range(max(1, len(t) - 7)) if k != body and len(shared[host(u), tuple(t[at : at + 8])]) >= 3 for x in range(at, min(at + 8, len(t)))}
            if left := " ".join(w for x, w in enumerate(t) if x not in gone):
                out.append(left)
        want[i] = " ".join(out)
    assert sum(want[i] != " ".join(p) for i, _, p, _ in rows) > 20
    for tokens in (2_000_000, 60):
        assert {r["page_id"]: r["text"] for r in html_extract.extract(df, array_tokens=tokens).collect()} == want


def test_frames_of_articles_are_boilerplate_elsewhere(spark):
    """What the frames of a host's article pages repeat goes from its pages without an article, not from the articles."""
    box, quote = "sign up here to get the best of our stories by mail each day", "a famous passage that many of the articles on this host quote word for word"
    page = lambda i, inside: f"<aside>{box}</aside><article><p>story number {i} tells of many things that no other story on this host tells</p><p>{quote}</p>{inside}</article>"
    rows = [(i, f"http://a.org/{i}", page(i, f"<p>{box}</p>" if i == 0 else "")) for i in range(4)]
    rows += [(i, f"http://{h}.org/{i}", f"<div>{box}</div><p>{quote}</p><p>page number {i} has no article but it has this text of its own which is its longest</p>") for i, h in ((8, "a"), (9, "b"))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(quote in t for t in got.values()) and box in got[0] and box not in got[8] and box in got[9] and "page number 8" in got[8]


def test_runs_around_a_hot_anchor(spark, monkeypatch):
    """Texts that share one anchor are no single array; their runs, counted one by one, are those that one array finds."""
    rng = random.Random(34)
    menus = [" ".join(["la"] * 9 + [f"m{k}"] * 9) for k in range(3)]
    rows = [(i, "http://a.org/x", f"<p>{' '.join(['la'] * rng.randint(1, 40) + [f'u{i}'])}</p><p>{menus[i % 3]} t{i}</p><p>{f'body{i} ' * 90}</p><p>of {i % 20}</p>") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = lambda tokens: {r["page_id"]: r["text"] for r in html_extract.extract(df, array_tokens=tokens).collect()}
    want, counted = text(2_000_000), []
    assert all(f"t{i}" in t and "m1 m1" not in t for i, t in want.items())
    monkeypatch.setattr(html_extract, "cut", lambda d, cut=html_extract.cut: counted.append(d.columns == ["host", "part"]) or cut(d))
    for hot in (8, 0):
        monkeypatch.setattr(html_extract, "HOT", hot)
        assert text(20) == want
    assert sum(counted) == 2


def test_suffixes_and_common_prefixes():
    """The whole order and every common prefix, of texts with long repeats and equal ends, against plain comparison."""
    rng = random.Random(33)
    for _ in range(30):
        texts = [[rng.randint(1, 3) for _ in range(rng.randint(1, 25))] for _ in range(6)]
        texts += [texts[0][3:] + texts[1], texts[2], texts[1] * 4]
        flat = [x for t in texts for x in [*t, 0]]
        left = [k for t in texts for k in range(len(t), -1, -1)]
        order, common = html_extract._suffixes(np.array(flat), np.array(left))
        own = [flat[i : i + left[i]] for i in order]
        assert own == sorted(own) and sorted(order) == list(range(len(flat)))
        for a, b, n in zip(own, own[1:], common[1:], strict=False):
            assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


def test_names_only_propose_and_the_host_decides(spark):
    """A class word inside an article's own names takes no text; what three pages of the host repeat in such blocks goes, from articles too."""
    odd = ('<p class="share-price">the price of a share rose {}</p>', '<p class="ad-hoc">an ad hoc meeting took place {}</p>', '<h2 class="header">The second part of it {}</h2>', '<blockquote class="social">they said so themselves {}</blockquote>', '<div id="comment-policy-history"><p>how the policy came about {}</p></div>')
    for x in odd:
        assert html_extract.blocks(f"<article><p>a</p>{x}</article>")[0] == ["a", re.sub("<[^>]*>", "", x)]
    assert html_extract.blocks('<article>a<div class="comment-list">b</div><p class="ad">c</p><div id="userComments">d</div></article>')[0] == ["a"]
    box = '<div class="promo-of-today">all that you ever wanted to know about our great offers of this day</div>'
    rows = [(i, "http://a.org/x", f"<article><p>story number {i}</p>{''.join(odd).replace('{}', f'n{i}')}{box}</article>") for i in range(4)] + [(9, "http://b.org/", f"<article><p>story</p>{box}</article>")]
    rows += [(20 + i, "http://c.org/x", f"<p>page number {i} has a text</p><div class='promo-of-{i}'>an offer {i} that is longer than all of the text that the page has</div>") for i in range(2)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(4):
        assert got[i] == f"story number {i} " + " ".join(re.sub("<[^>]*>", "", x).format(f"n{i}") for x in odd)
    assert got[9].startswith("story all that you") and all(got[20 + i].startswith(f"page number {i} has a text an offer") for i in range(2))


def test_markup_of_any_length_in_linear_time():
    alt = "x > <article>" * 12_000
    assert html_extract.blocks(f'<p>a<img alt="{alt}">b</p>')[0] == ["a", "b"]
    assert html_extract.blocks(f"<p>a<!-- {alt} -->b</p>")[0] == ["ab"]
    assert html_extract.blocks("<p title='a>b' id=x>c<b title=\"d>e\">f</b></p><br/>g<!-->h<!doctype x>i")[0] == ["cf", "ghi"]
    for page in ("<b " * 200_000, '<p a="' * 100_000, "</script " * 100_000, "<script>" + "</script " * 100_000, "<!--" * 200_000, "<a b='" * 50_000 + ">", "<i>" * 100_000, "</" * 200_000, "<a =" * 100_000 + ">", "<p class='ad' " * 50_000 + ">x"):
        html_extract.blocks(page)


def test_long_pages(spark):
    words = " ".join(f"w{i}" for i in range(60_000))
    rows = [(i, "http://a.org/x", f"<p>{words} {i}</p><p>{words[: 100_000 * (i + 1)]}</p>") for i in range(3)] + [(None, None, "<article>" + "la " * 100_000 + "</article>")]
    got = {r["page_id"]: r["n_chars"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), array_tokens=20_000).collect()}
    assert got[None] == 299_999 and all(got[i] >= len(words) for i in range(3))


# pipeline
def test_pipeline(spark, rows):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = common.table(spark, SF, "documents")
    bench = [" ".join(r["text"].split()) for r in common.table(spark, SF, "benchmark").collect()]
    stages = dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "pii", "best_fit_packing"]
    a = common.cut(stages["language_id"](spark, docs, SF))
    assert a.columns == docs.columns and a.count() == sum(any(c.isalpha() for c in t) for _, t in rows)
    b = common.cut(stages["simhash_near_dedup"](spark, a, SF))
    kept = {r["doc_id"]: r["text"] for r in b.collect()}
    assert b.columns == docs.columns and len(set(kept.values())) == len(kept)
    least = {}
    for d, t in rows:
        least.setdefault(t, d)
    assert set(kept) <= set(least.values())
    c = common.cut(stages["benchmark_decontamination"](spark, b, SF))
    assert c.columns == docs.columns
    clean = {d for d, t in kept.items() if not any(x in " ".join(t.split()) for x in bench)}
    assert {r["doc_id"] for r in c.collect()} <= set(kept) and {r["doc_id"] for r in c.collect()} == clean
    d = common.cut(stages["pii"](spark, c, SF))
    assert d.columns == docs.columns and all(not plain_spans(r["text"]) and r["n_chars"] == len(r["text"]) for r in d.collect())
    check_pack(stages["best_fit_packing"](spark, d, SF).collect(), [(r["doc_id"], r["text"]) for r in d.collect()])


def test_near_dedup_stage_rows(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    got = pipeline.near_dedup(spark, docs, SF).collect()
    assert Counter(r["doc_id"] for r in got) == Counter([0, 3, 4, 5, 7, 9, 10, None])
    assert pipeline.near_dedup(spark, empty(docs), SF).count() == 0


@pytest.fixture(scope="module")
def awkward(docs):
    """docs with columns named like those that the stages add for themselves."""
    return docs.withColumns({"rejected": F.lit("own"), "_hit": F.lit(7), "_hash": F.lit(8), "_text_hash": F.lit(9)})


def test_language_stage_rows(spark, awkward, corpus):
    pipeline = pytest.importorskip("corpus_pipeline")
    got = pipeline.language(spark, awkward, SF)
    want = langid.predict(awkward.drop("score", "rejected"), langid.fit(awkward)).where("NOT rejected")
    assert got.columns == awkward.columns and got.dtypes == awkward.dtypes
    got = got.collect()
    assert got and Counter((r["doc_id"], r["text"]) for r in got) == Counter((r["doc_id"], r["text"]) for r in want.collect())
    assert {(r["score"], r["rejected"]) for r in got} == {("dup", "own")} and not {0, 1, 2, 10} & {r["doc_id"] for r in got}
    assert pipeline.language(spark, empty(awkward), SF).count() == 0


def test_decontamination_stage_rows(spark, awkward):
    pipeline = pytest.importorskip("corpus_pipeline")
    item = common.table(spark, SF, "benchmark").first()["text"]
    held = spark.createDataFrame([(None, item, "en", "x", "own", 7, 8, 9), (5, "before it " + item + " after it", "en", "x", "own", 7, 8, 9)], awkward.schema)
    got = pipeline.decontaminate(spark, awkward.unionByName(held), SF)
    assert got.columns == awkward.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, awkward.collect()))
    assert pipeline.decontaminate(spark, empty(awkward), SF).count() == 0


def test_personal_data_stage_rows(spark, awkward):
    pipeline = pytest.importorskip("corpus_pipeline")
    mail = spark.createDataFrame([(20, "write to a.b@c.org now", "en", "x", "own", 7, 8, 9)] * 2, awkward.schema)
    rows = awkward.unionByName(mail).withColumn("n_chars", F.lit(0).cast("long"))
    got = pipeline.personal_data(spark, rows, SF)
    assert got.columns == rows.columns
    got = got.collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in rows.collect())
    assert [r["text"] for r in got if r["doc_id"] == 20] == ["write to <EMAIL> now"] * 2
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got) and {r["text"] for r in got if r["doc_id"] == 0} == {None}
    assert pipeline.personal_data(spark, awkward, SF).columns == awkward.columns and pipeline.personal_data(spark, empty(awkward), SF).count() == 0


def test_packing_stage_rows(spark, awkward):
    pipeline = pytest.importorskip("corpus_pipeline")
    check_pack(pipeline.pack(spark, awkward, SF).collect(), [(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert pipeline.pack(spark, empty(awkward), SF).count() == 0


def test_near_dedup_stage_keeps_columns(spark, awkward):
    pipeline = pytest.importorskip("corpus_pipeline")
    got = pipeline.near_dedup(spark, awkward, SF)
    assert got.columns == awkward.columns and {(r["_hit"], r["_hash"], r["_text_hash"], r["score"]) for r in got.collect()} == {(7, 8, 9, "dup")}
