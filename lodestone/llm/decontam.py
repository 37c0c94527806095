"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, units and names become typed placeholders, each kept with the value it stands for. Windows of template
tokens are hash-joined with those of the benchmark; each alignment found is compared token by token, and the values
in its slots must map one to one, so that a question with other numbers is found and one that only looks alike is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, table

NUM, UNIT, NAME, END = "\ue000", "\ue001", "\ue002", "\ue003"
#: Units that may follow a number.
UNITS = "km|kg|cm|mm|mg|ml|lbs?|oz|ft|mph|kph|miles?|meters?|metres?|kilometers?|kilometres?|grams?|kilograms?|pounds?|ounces?|feet|inches|inch|yards?|liters?|litres?|gallons?|hours?|hrs?|minutes?|mins?|seconds?|secs?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|degrees?|m|g|l|h|s"
# the character after a unit or name is taken and put back, as not every engine can look ahead; a possessive group
# is matched in a loop, where Java would otherwise recurse once a number or name of a list
_NUMBER = r"([0-9]++(?:[.,:/][0-9]++)*+)"
_UNIT = rf"({END} +)((?i:{UNITS}))([^\p{{L}}\p{{M}}]|$)"
_NAME = r"\p{Lu}\p{Ll}++(?![\p{L}\p{M}])"
_NAMES = rf"([\p{{Ll}},;] )({_NAME}(?:,? {_NAME})*+)([^\p{{L}}\p{{M}}]|$)"
_TOP = (1 << 63) - 1
_TOKEN = rf"[{NUM}-{NAME}][^{END}]*+{END}|[\p{{L}}\p{{M}}]++"


def tokens(text: Column) -> Column:
    """Lower-case words and slots in order; a slot is its placeholder, the value it stands for and an end mark."""
    plain = F.translate(text, NUM + UNIT + NAME + END, "    ")
    numbers = F.regexp_replace(plain, _NUMBER, f" {NUM}$1{END} ")
    units = F.regexp_replace(numbers, _UNIT, f"$1{UNIT}$2{END} $3")
    names = F.regexp_replace(units, _NAMES, f"$1{NAME}$2{END} $3")
    return F.regexp_extract_all(F.lower(names), F.lit(f"({_TOKEN})"), 1)


def _is_slot(token: Column) -> Column:
    return token.between(NUM, NAME + END)


def _kind(token: Column) -> Column:
    """The template token: the word itself, or a slot's placeholder."""
    return F.when(_is_slot(token), F.substring(token, 1, 1)).otherwise(token)


def template(text: Column) -> Column:
    """Template tokens: lower-case words and placeholders."""
    return F.transform(tokens(text), _kind)


def _once(df: DataFrame, **made: Column) -> DataFrame:
    """df with columns that are computed once a row. Explode keeps Spark from merging them into each later use, such as a lambda's body."""
    names = list(made)
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))).alias("_made")
    return df.select("*", one).select(*df.columns, *[F.col(f"_made.{n}").alias(n) for n in names])


def _codes(values: Column) -> Column:
    """tokens() as numbers: a word's is negative; a slot's hashes its value and has its placeholder in the last two bits."""

    def code(x: Column) -> Column:
        h, kind = F.xxhash64(x), F.when(x < UNIT, 1).when(x < NAME, 2).otherwise(3).cast("long")
        return F.when(_is_slot(x), h.bitwiseAND(F.lit(_TOP - 3)).bitwiseOR(kind)).otherwise(h.bitwiseOR(F.lit(-_TOP - 1)))

    return F.transform(values, code)


def _windows(df: DataFrame, widths: list[int], *keep: str) -> DataFrame:
    """(*keep, n, at, h) of the windows of n tokens, n in widths, that start at each place `at` of column c (codes).

    h hashes the template, and the values too where the window holds no word. Shifted arrays are zipped and exploded, so that hashing is generated code.
    """
    zipped = F.arrays_zip(*[F.slice("c", k + 1, F.greatest(F.lit(0), F.size("c") - k)) for k in range(max(widths))])
    df = df.select(*keep, F.posexplode(zipped).alias("at", "w"))
    codes = [F.col("w").getField(f) for f in df.schema["w"].dataType.names]

    def key(n: int) -> Column:
        own = codes[:n]
        template_only = F.xxhash64(*[F.when(c < 0, c).otherwise(c.bitwiseAND(F.lit(3))) for c in own])
        bare = F.least(*own) if n > 1 else own[0]
        return F.when(own[-1].isNotNull(), F.when(bare >= 0, F.xxhash64(F.lit("slots"), *own)).otherwise(template_only))

    keys = F.array(*[F.struct(F.lit(n).alias("n"), key(n).alias("h")) for n in widths])
    return df.select(*keep, "at", F.explode(keys).alias("k")).select(*keep, "k.n", "at", "k.h").where("h IS NOT NULL")


def alignments(docs: DataFrame, benchmark: DataFrame, width: int = 6, share: float = 0.5, broadcast_rows: int = 200_000) -> DataFrame:
    """The rows of contaminated() for each document text: with column text_hash, the xxhash64 of the text."""
    small = lambda df, n: F.broadcast(df) if n <= broadcast_rows else df
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text <> ''").withColumn("text_hash", F.xxhash64("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = cut(items.select("item_id", tokens(F.col("text")).alias("v")).where(F.size("v") >= 1).distinct())
    short = sorted(r[0] for r in items.where(F.size("v") < width).select(F.size("v")).distinct().collect())
    coded = items.select("item_id", F.size("v").alias("size"), _codes(F.col("v")).alias("c"))
    heads = _windows(coded, [width, *short], "item_id", "size").where(F.col("n") == F.least("size", F.lit(width)))
    heads = cut(heads.select("item_id", "size", "n", F.col("at").alias("item_at"), "h").distinct())
    coded = _once(docs, v=tokens(F.col("text"))).select("doc_id", "text_hash", _codes(F.col("v")).alias("c"))
    rows = _windows(coded, [width, *short], "doc_id", "text_hash")
    found = rows.join(small(heads, heads.count()), ["n", "h"]).select("doc_id", "text_hash", "item_id", F.col("size").alias("n"), (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    # a document's alignments in up to 16 rows, each of which meets the document's tokens once
    found = cut(found.groupBy("doc_id", "text_hash", F.pmod(F.xxhash64("item_id", "n"), F.lit(16)).alias("part")).agg(F.collect_list(F.struct("item_id", "n", "shift")).alias("at")))
    ids = found.select(F.col("doc_id").alias("hit"), F.col("text_hash").alias("hash"), "at")
    hits = docs.join(small(ids, found.agg(F.sum(F.size("at"))).first()[0] or 0), F.col("doc_id").eqNullSafe(F.col("hit")) & (F.col("text_hash") == F.col("hash")))
    hits = _once(hits.select("doc_id", "text_hash", "text", "at"), d=tokens(F.col("text"))).drop("text")
    # 1-based places first..last of the item; the document's token there is i + shift
    first = lambda a: F.greatest(F.lit(1), 1 - a.shift)
    count = lambda a: F.least(a.n, F.size("d") - a.shift) - first(a) + 1
    parts = F.transform("at", lambda a: F.struct(a.item_id.alias("item_id"), a.n.alias("n"), first(a).alias("first"), F.slice("d", first(a) + a.shift, count(a)).alias("d")))
    hits = hits.select("doc_id", "text_hash", F.explode(parts).alias("p")).select("doc_id", "text_hash", "p.*").distinct()
    own = items.select("item_id", "v", F.size("v").alias("n"))
    pairs = hits.join(small(own, own.count()), ["item_id", "n"])
    zipped = F.zip_with(F.slice("v", F.col("first"), F.size("d")), "d", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = _once(pairs.select("doc_id", "text_hash", "item_id", "n", zipped.alias("zipped")), same=F.filter("zipped", lambda p: _kind(p.a) == _kind(p.b)))
    pairs = _once(pairs, slots=F.filter("same", lambda p: _is_slot(p.a)))
    values = F.size(F.array_distinct("slots"))
    one_to_one = (values == F.size(F.array_distinct("slots.a"))) & (values == F.size(F.array_distinct("slots.b")))
    good = pairs.where(one_to_one & (F.size("same") >= F.col("n") * share))
    kind = F.when(F.forall("slots", lambda p: p.a == p.b), "exact").otherwise("reparameterised")
    best = F.max(F.struct(F.size("same").cast("long").alias("matched"), F.col("n").cast("long").alias("item_tokens"), kind.alias("kind"))).alias("m")
    return good.groupBy("doc_id", "text_hash", "item_id").agg(best).select("doc_id", "text_hash", "item_id", "m.*")


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 6, share: float = 0.5, broadcast_rows: int = 200_000) -> DataFrame:
    """Pairs (doc_id, item_id, matched, item_tokens, share, kind) of docs (doc_id, text) and benchmark (item_id, text); more columns are ignored.

    Windows start at every token of both sides, so any run of `width` equal template tokens that holds a word is found, and a
    run of placeholders alone where its values are equal too (a table of numbers is no match for every row of numbers).
    A pair counts where one alignment so found matches at least `share` of the item's tokens and its slots map one to one; kind is
    `exact` where all slot values are equal, else `reparameterised`. An item of fewer than `width` tokens is one window, looked
    for at every token. Null and empty texts match nothing. Rows with equal doc_id (nulls included) are judged
    one by one and reported once; so are items with equal item_id. Empty tables give no rows. A side is broadcast
    only after it was counted as at most `broadcast_rows` narrow rows; beyond that Spark shuffles both.
    """
    found = alignments(docs, benchmark, width, share, broadcast_rows)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "item_tokens", "kind")).alias("m"))
    return best.select("doc_id", "item_id", "m.matched", "m.item_tokens", (F.col("m.matched") / F.col("m.item_tokens")).alias("share"), "m.kind")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs (doc_id, text and any other columns) without the rows whose own text holds a benchmark item, see contaminated(); rows without text stay."""
    found = cut(alignments(docs, benchmark).select(F.col("doc_id").alias("_hit"), F.col("text_hash").alias("_hash")).distinct())
    found = F.broadcast(found) if found.count() <= broadcast_rows else found
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(found["_hit"]) & (F.xxhash64(F.col("text").cast("string")) == found["_hash"]), "left_anti")


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# the same patterns without possessive groups and look-ahead, which RE2 has no need of
_SQL_NUMBER = r"([0-9]+(?:[.,:/][0-9]+)*)"
_SQL_NAMES = r"([\p{Ll},;] )(\p{Lu}\p{Ll}+(?:,? \p{Lu}\p{Ll}+)*)([^\p{L}\p{M}]|$)"


def _sql(table_name: str, key: str, name: str) -> str:
    """tokens() as v and template() as t of a table as SQL."""
    return f"""
{name}0 AS (SELECT {key}, regexp_replace(translate(text, '{NUM}{UNIT}{NAME}{END}', '    '), '{_SQL_NUMBER}', ' {NUM}\\1{END} ', 'g') AS x FROM {table_name} WHERE text <> ''),
{name}1 AS (SELECT {key}, regexp_replace(regexp_replace(x, '{_UNIT}', '\\1{UNIT}\\2{END} \\3', 'g'), '{_SQL_NAMES}', '\\1{NAME}\\2{END} \\3', 'g') AS x FROM {name}0),
{name}2 AS (SELECT {key}, regexp_extract_all(lower(x), '[{NUM}-{NAME}][^{END}]*{END}|[\\p{{L}}\\p{{M}}]+') AS v FROM {name}1),
{name} AS (SELECT {key}, v, list_transform(v, lambda x: CASE WHEN x BETWEEN '{NUM}' AND '{NAME}{END}' THEN x[1] ELSE x END) AS t FROM {name}2)"""


def oracle_sql(width: int = 6, share: float = 0.5) -> str:
    """contaminated() as SQL over documents and benchmark: every window as text, items of fewer than `width` tokens as one window each."""
    window = lambda n: f"CASE WHEN list_bool_and(list_transform(t[pos : pos + {n} - 1], lambda x: x BETWEEN '{NUM}' AND '{NAME}')) THEN '{END}' || array_to_string(v[pos : pos + {n} - 1], ' ') ELSE array_to_string(t[pos : pos + {n} - 1], ' ') END"
    return f"""
WITH {_sql("documents", "doc_id", "d")}, {_sql("benchmark", "item_id", "b")},
bw AS (SELECT item_id, t, v, least(len(t), {width}) AS n, unnest(range(1, len(t) - least(len(t), {width}) + 2)) AS pos FROM b WHERE len(t) > 0),
dw AS (SELECT doc_id, t, v, n, unnest(range(1, len(t) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM bw)),
bh AS (SELECT item_id, n, pos, {window("n")} AS h FROM bw), dh AS (SELECT doc_id, n, pos, {window("n")} AS h FROM dw),
f AS (SELECT DISTINCT doc_id, item_id, dh.pos - bh.pos AS shift FROM dh JOIN bh USING (n, h)),
j AS (SELECT f.doc_id, f.item_id, f.shift, d, b FROM f JOIN d ON d.doc_id = f.doc_id JOIN b ON b.item_id = f.item_id),
m AS (SELECT *, list_filter(range(greatest(1, 1 - shift), least(len(b.t), len(d.t) - shift) + 1), lambda i: b.t[i] = d.t[i + shift]) AS same FROM j),
s AS (SELECT *, list_filter(same, lambda i: b.t[i] BETWEEN '{NUM}' AND '{NAME}') AS slots FROM m),
p AS (SELECT doc_id, item_id, CAST(len(same) AS BIGINT) AS matched, CAST(len(b.t) AS BIGINT) AS item_tokens, list_transform(slots, lambda i: b.v[i]) AS av, list_transform(slots, lambda i: d.v[i + shift]) AS bv FROM s),
q AS (SELECT *, len(list_distinct(list_transform(range(1, len(av) + 1), lambda i: av[i] || bv[i]))) AS n FROM p),
r AS (SELECT doc_id, item_id, matched, item_tokens, CASE WHEN av = bv THEN 'exact' ELSE 'reparameterised' END AS kind FROM q WHERE matched >= item_tokens * {share} AND n = len(list_distinct(av)) AND n = len(list_distinct(bv)))
SELECT doc_id, item_id, matched, item_tokens, CAST(matched AS DOUBLE) / item_tokens AS share, kind
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, item_tokens DESC, kind DESC) AS k FROM r) WHERE k = 1
"""
