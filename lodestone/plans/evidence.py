"""Evidence, readiness and text queries: parts stand for products, line items for offers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..operators import evidence, profile, readiness, report
from ..sources.tables import table
from .registry import query

_OBS = """
obs AS (
  SELECT p_partkey AS part, 1 AS tier, 'catalog' AS source, 0 AS ord, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS v FROM part
  UNION ALL
  SELECT l_partkey, 1, 'offer', l_orderkey, CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT) FROM lineitem WHERE l_linenumber = 1)
"""


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    minor = lambda c: F.floor(c * 100 + 0.5).cast("long")
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.lit("catalog").alias("source"), F.lit(0).cast("long").alias("ord"), minor(F.col("p_retailprice")).alias("value"))
    b = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("part"), F.lit("offer").alias("source"), F.col("l_orderkey").alias("ord"), minor(F.col("l_extendedprice") / F.col("l_quantity")).alias("value"))
    return a.unionByName(b).withColumn("vkey", tx.comparison_key(F.col("value")))


@query(f"""
WITH {_OBS}, g AS (SELECT part, count(*) AS n_observations, count(DISTINCT source) AS n_sources, count(DISTINCT v) AS n_values, min(v) AS v FROM obs GROUP BY part)
SELECT part, CASE WHEN n_values > 1 THEN 'conflicted' WHEN n_sources >= 2 THEN 'verified' ELSE 'single_source' END AS state,
       CASE WHEN n_values = 1 THEN v END AS value, n_observations, n_sources, n_values FROM g
""")
def evidence_field_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"))
    return evidence.resolve_field(_observations(spark, sf_dir), entities, ["part"])


@query("""
WITH o AS (
  SELECT l_partkey AS part, CASE WHEN l_linenumber <= 2 THEN 1 ELSE 2 END AS tier, CASE WHEN l_linenumber % 2 = 1 THEN 'catalog' ELSE 'offer' END AS source, CAST(floor(l_quantity) AS BIGINT) % 2 AS v FROM lineitem WHERE l_returnflag = 'R'),
u AS (SELECT part, min(tier) AS tier FROM o GROUP BY part),
w AS (SELECT o.* FROM o JOIN u USING (part, tier)),
b AS (SELECT part, tier, v, count(DISTINCT source) AS s, max(CASE WHEN source = 'catalog' THEN 1 ELSE 0 END) AS c FROM w GROUP BY ALL),
n AS (SELECT part, tier, count(*) AS n_values, min(v) AS v, count(CASE WHEN c = 1 AND s >= 2 THEN 1 END) AS wins, max(CASE WHEN c = 1 AND s >= 2 THEN v END) AS win FROM b GROUP BY ALL),
k AS (SELECT part, count(DISTINCT source) AS n_sources FROM w GROUP BY part)
SELECT part, tier, CASE WHEN n_values > 1 AND wins > 0 THEN 'verified' WHEN n_values > 1 THEN 'conflicted' WHEN n_sources >= 2 THEN 'verified' ELSE 'single_source' END AS state,
       CASE WHEN n_values = 1 THEN v ELSE win END AS value, n_values, n_sources FROM n JOIN k USING (part)
""")
def evidence_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    value = (F.floor("l_quantity").cast("long") % 2).alias("value")
    # the order makes the larger value the first where two are supported
    obs = rows.select(F.col("l_partkey").alias("part"), F.when(F.col("l_linenumber") <= 2, 1).otherwise(2).alias("tier"), F.when(F.col("l_linenumber") % 2 == 1, "catalog").otherwise("offer").alias("source"), value, (-(F.floor("l_quantity").cast("long") % 2)).alias("ord"))
    return evidence.prefer_field(obs.withColumn("vkey", F.col("value").cast("string")), ["part"], "catalog")


@query("""
WITH o AS (
  SELECT p_partkey AS part, 0 AS ord, 'catalog' AS source, 'name' AS path, p_name AS text FROM part
  UNION ALL SELECT p_partkey, 1, 'catalog', 'brand', p_brand FROM part UNION ALL SELECT p_partkey, 2, 'catalog', 'type', p_type FROM part UNION ALL SELECT p_partkey, 3, 'feed', 'name', p_name FROM part),
d AS (SELECT part, source, path, text, min(ord) AS ord FROM o WHERE text <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY ord) AS rank FROM d)
SELECT part, source, path, rank, 'ev_' || substr(sha256(source || chr(10) || path || chr(10) || text), 1, 16) AS id FROM r WHERE rank <= 3
""")
def evidence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = lambda o, s, p, c: F.struct(F.lit(o).alias("ord"), F.lit(s).alias("source"), F.lit(p).alias("path"), F.col(c).alias("text"))
    each = F.array(item(0, "catalog", "name", "p_name"), item(1, "catalog", "brand", "p_brand"), item(2, "catalog", "type", "p_type"), item(3, "feed", "name", "p_name"))
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.inline(each))
    return evidence.evidence_pack(items, "part", 3).select("part", "source", "path", F.col("rank").cast("long").alias("rank"), "id")


_FLAT = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


@query(f"SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains({_FLAT.format('d.text')}, {_FLAT.format('b.text')})")
def citation_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.contained_texts(table(spark, sf_dir, "benchmark").select("item_id", "text"), table(spark, sf_dir, "documents").select("doc_id", "text"), "item_id", "doc_id")


@query(f"SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains({_FLAT.format('d.text')}, {_FLAT.format('b.text')}))")
def citation_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").join(citation_containment(spark, sf_dir), "item_id", "left_anti").select("item_id")


@query("""
SELECT conv_id, turn, CASE WHEN c.text IS NULL THEN 'UNKNOWN_ID' WHEN NOT contains(trim(regexp_replace(c.text, '\\s+', ' ', 'g')), trim(regexp_replace(substr(q.text, 1, 20), '\\s+', ' ', 'g'))) THEN 'NOT_IN_TEXT' END AS issue
FROM (SELECT conv_id, turn, text FROM conversations WHERE turn > 0) q LEFT JOIN (SELECT DISTINCT conv_id AS c_id, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS r FROM conversations WHERE turn = 0) WHERE r = 1) c ON c_id = conv_id
""")
def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    claims = turns.where("turn > 0").select(F.struct("conv_id", "turn").alias("claim_id"), F.col("conv_id").alias("evidence_id"), F.substring("text", 1, 20).alias("quote"))
    opening = turns.where("turn = 0").groupBy(F.col("conv_id").alias("evidence_id")).agg(F.min("text").alias("text"))
    return evidence.citations(claims, opening).select("claim_id.conv_id", "claim_id.turn", "issue")


@query("""
SELECT doc_id, regexp_matches(text, '(?i)(^|[^a-z0-9_])(the|der|les|que)($|[^a-z0-9_])') AS function_words, regexp_matches(text, '(?i)(^|[^a-z0-9_])(digital|download|software|version)($|[^a-z0-9_])') AS digital, regexp_matches(text, '(?i)(^|[^a-z0-9_])(apache|public) license($|[^a-z0-9_])') AS licensed FROM documents
""")
def relevance_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    # word ends are spelled out: \b stands at other places in RE2 than in Java where letters have accents
    word = lambda w: F.col("text").rlike(f"(?i)(^|[^a-z0-9_])({w})($|[^a-z0-9_])")
    return table(spark, sf_dir, "documents").select("doc_id", word("the|der|les|que").alias("function_words"), word("digital|download|software|version").alias("digital"), word("apache license|public license").alias("licensed"))


_TILES = """
t AS (SELECT d.doc_id, d.source, CASE WHEN l.doc_id IS NULL THEN 'unavailable' WHEN l.quality = 1 AND l.toxic = 1 THEN 'conflicting' WHEN l.quality = 1 THEN 'present' ELSE 'missing' END AS tile FROM documents d LEFT JOIN labels l USING (doc_id)),
s AS (SELECT *, CASE WHEN tile = 'present' THEN 'info' WHEN tile = 'missing' AND source = 'src1' THEN 'info' WHEN tile IN ('unavailable', 'conflicting') THEN 'warning' ELSE 'error' END AS severity FROM t)
"""


@query(f"WITH {_TILES} SELECT doc_id, tile, severity, CASE severity WHEN 'info' THEN 'pass' WHEN 'warning' THEN 'warn' ELSE 'fail' END AS outcome FROM s")
def presence_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    state = F.when((F.col("quality") == 1) & (F.col("toxic") == 1), "conflicted").when(F.col("quality") == 1, "single_source").otherwise("missing")
    out = docs.select("doc_id", "source", readiness.presence(state, F.col("quality").isNotNull()).alias("tile"))
    out = out.withColumn("severity", readiness.severity(F.col("tile"), F.lit("brand"), F.col("source") != "src1"))
    return out.select("doc_id", "tile", "severity", readiness.outcome(F.col("severity")).alias("outcome"))


_CHECKS = """
c AS (
  SELECT doc_id, 'brand' AS id, CASE WHEN n_chars >= 400 THEN 'pass' ELSE 'fail' END AS outcome FROM documents
  UNION ALL SELECT doc_id, 'image', CASE WHEN lang = 'en' THEN 'pass' WHEN lang = 'de' THEN 'warn' ELSE 'fail' END FROM documents
  UNION ALL SELECT doc_id, 'canonical', CASE WHEN n_chars >= 1500 THEN 'pass' ELSE 'warn' END FROM documents
  UNION ALL SELECT doc_id, 'sku', CASE WHEN contains(text, 'the') THEN 'pass' ELSE 'fail' END FROM documents
  UNION ALL SELECT doc_id, 'noindex', CASE WHEN contains(text, '%%%') THEN 'fail' ELSE 'pass' END FROM documents
  UNION ALL SELECT doc_id, 'warranty', CASE WHEN source = 'src1' THEN 'warn' ELSE 'pass' END FROM documents)
"""


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, text = F.col("n_chars"), F.col("text")
    outcomes = {
        "brand": F.when(n >= 400, "pass").otherwise("fail"),
        "image": F.when(F.col("lang") == "en", "pass").when(F.col("lang") == "de", "warn").otherwise("fail"),
        "canonical": F.when(n >= 1500, "pass").otherwise("warn"),
        "sku": F.when(text.contains("the"), "pass").otherwise("fail"),
        "noindex": F.when(text.contains("%%%"), "fail").otherwise("pass"),
        "warranty": F.when(F.col("source") == "src1", "warn").otherwise("pass"),
    }
    each = F.array(*[F.struct(F.lit(k).alias("id"), v.alias("outcome")) for k, v in outcomes.items()])
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(each))


@query(f"WITH {_CHECKS} SELECT doc_id, CAST(count(CASE WHEN outcome = 'pass' THEN 1 END) AS BIGINT) AS ready, count(*) AS total FROM (SELECT c.doc_id, id, CASE WHEN id = 'sku' AND l.toxic = 1 THEN 'fail' ELSE outcome END AS outcome FROM c LEFT JOIN labels l ON l.doc_id = c.doc_id) GROUP BY doc_id")
def readiness_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit("sku").alias("id"), F.lit("fail").alias("outcome"))
    left = left.join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi")
    return readiness.ready(readiness.checks_with_leftovers(_checks(spark, sf_dir), left, "doc_id"), "doc_id")


@query(f"""
WITH {_CHECKS}, p AS (SELECT unnest(['noindex', 'brand', 'sku', 'image', 'canonical', 'warranty']) AS id, unnest([30, 100, 110, 130, 140, 220]) AS priority)
SELECT doc_id, id AS fix, priority, rank FROM (SELECT doc_id, id, CAST(priority AS INTEGER) AS priority, row_number() OVER (PARTITION BY doc_id ORDER BY priority, id) AS rank FROM c JOIN p USING (id) WHERE outcome <> 'pass') WHERE rank <= 3
""")
def top_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _checks(spark, sf_dir).where("outcome <> 'pass'").select("doc_id", F.col("id").alias("fix"))
    return readiness.top_fixes(rows, "doc_id", 3).select("doc_id", "fix", "priority", F.col("rank").cast("long").alias("rank"))


@query("""
WITH cur AS (
  SELECT doc_id, 'length' AS id, 2 AS version, CASE WHEN n_chars >= 2000 THEN 'pass' WHEN n_chars >= 500 THEN 'warn' ELSE 'fail' END AS outcome FROM documents
  UNION ALL SELECT doc_id, 'language', 1, CASE WHEN lang = 'en' THEN 'pass' ELSE 'warn' END FROM documents),
prev AS (
  SELECT doc_id, 'length' AS id, CASE WHEN doc_id % 7 = 0 THEN 1 WHEN doc_id % 11 = 0 THEN NULL ELSE 2 END AS version, CASE WHEN quality = 1 THEN 'pass' WHEN toxic = 1 THEN 'fail' ELSE 'warn' END AS outcome FROM labels),
r AS (SELECT unnest(['fail', 'warn', 'pass']) AS outcome, unnest([0, 1, 2]) AS rank)
SELECT cur.doc_id, cur.id, CASE WHEN k.doc_id IS NULL THEN NULL WHEN prev.outcome IS NULL THEN CASE WHEN cur.outcome <> 'pass' THEN 'still_open' END
  WHEN prev.version IS NULL OR prev.version <> cur.version THEN 'skipped' WHEN a.rank > b.rank THEN 'improved' WHEN a.rank < b.rank THEN 'regressed' WHEN cur.outcome <> 'pass' THEN 'still_open' END AS bucket
FROM cur LEFT JOIN (SELECT DISTINCT doc_id FROM prev) k ON k.doc_id = cur.doc_id LEFT JOIN prev ON prev.doc_id = cur.doc_id AND prev.id = cur.id
LEFT JOIN r a ON a.outcome = cur.outcome LEFT JOIN r b ON b.outcome = prev.outcome
""")
def recheck_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    n = F.col("n_chars")
    checks = F.array(
        F.struct(F.lit("length").alias("id"), F.lit(2).alias("version"), F.when(n >= 2000, "pass").when(n >= 500, "warn").otherwise("fail").alias("outcome")),
        F.struct(F.lit("language").alias("id"), F.lit(1).alias("version"), F.when(F.col("lang") == "en", "pass").otherwise("warn").alias("outcome")),
    )
    version = F.when(F.col("doc_id") % 7 == 0, 1).when(F.col("doc_id") % 11 == 0, None).otherwise(2)
    previous = labels.select("doc_id", F.lit("length").alias("id"), version.alias("version"), F.when(F.col("quality") == 1, "pass").when(F.col("toxic") == 1, "fail").otherwise("warn").alias("outcome"))
    return readiness.recheck(docs.select("doc_id", F.inline(checks)), previous, "doc_id").select("doc_id", "id", "bucket")


@query("""
WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_type), ' ')) AS t, generate_subscripts(string_split(p_type, ' '), 1) AS i FROM part),
s AS (SELECT p_partkey, i, CASE WHEN t LIKE '%''s' THEN t WHEN t LIKE '%ies' AND length(t) > 4 THEN left(t, length(t) - 3) || 'y'
  WHEN regexp_matches(t, '(sses|ches|shes|xes|zes)$') AND length(t) > 4 THEN left(t, length(t) - 2) WHEN t LIKE '%s' AND t NOT LIKE '%ss' AND length(t) > 3 THEN left(t, length(t) - 1) ELSE t END AS t FROM w)
SELECT string_agg(t, ' ' ORDER BY i) AS category, p_partkey FROM s GROUP BY p_partkey
""")
def category_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(tx.category_key(F.col("p_type")).alias("category"), "p_partkey")


@query("""
SELECT l_partkey AS part, count(*) AS n_variants, count(CASE WHEN l_linestatus = 'O' THEN l_suppkey END) AS n_with_sku, CAST(count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS BIGINT) AS n_available, CAST(count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS BIGINT) AS n_unknown,
  bool_or(CASE l_returnflag WHEN 'N' THEN true WHEN 'A' THEN false END) AS available, min(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS price_min, max(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS price_max
FROM lineitem GROUP BY l_partkey
""")
def variant_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.when(F.col("l_linestatus") == "O", F.col("l_suppkey")).alias("sku"), F.when(F.col("l_returnflag") == "N", True).when(F.col("l_returnflag") == "A", False).alias("available"), F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long").alias("price"))
    return evidence.variant_summary(rows, "part")


@query("""
WITH v AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS variant_id FROM lineitem),
k AS (SELECT part, variant_id AS s, count(*) AS n FROM v GROUP BY ALL),
o AS (SELECT l_orderkey, l_linenumber, l_partkey AS part, l_suppkey AS s, CASE WHEN l_linenumber = 1 THEN l_suppkey WHEN l_linenumber = 2 THEN -1 END AS u FROM lineitem)
SELECT part, CAST(count(CASE WHEN u IS NOT NULL AND v.variant_id IS NOT NULL THEN 1 END) AS BIGINT) AS by_url, CAST(count(CASE WHEN u IS NULL THEN 1 END) AS BIGINT) AS by_sku, CAST(count(CASE WHEN u = -1 THEN 1 END) AS BIGINT) AS unmatched
FROM o LEFT JOIN v ON v.part = o.part AND v.variant_id = o.u GROUP BY part
""".replace("SELECT part, CAST", "SELECT o.part, CAST").replace("GROUP BY part\n", "GROUP BY o.part\n"))
def variant_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.lit("page").alias("page_key"), F.col("l_suppkey").alias("sku"), F.when(F.col("l_linenumber") == 1, F.col("l_suppkey")).when(F.col("l_linenumber") == 2, -1).cast("long").alias("url_variant"))
    variants = rows.select("part", "page_key", F.col("sku").alias("variant_id"), "sku").distinct()
    out = evidence.match_variants(rows, variants, "part")
    hit, url = F.col("variant_id").isNotNull(), F.col("url_variant").isNotNull()
    return out.groupBy("part").agg(F.count_if(hit & url).alias("by_url"), F.count_if(hit & ~url).alias("by_sku"), F.count_if(~hit).alias("unmatched"))


@query("""
WITH v AS (SELECT l_partkey AS part, l_suppkey AS variant_id, min(CAST(floor(l_quantity) AS BIGINT)) AS price FROM lineitem GROUP BY ALL),
p AS (SELECT p_partkey AS part, CASE WHEN p_size % 3 = 0 THEN 1 WHEN p_size % 3 = 1 THEN -5 END AS pick, CASE WHEN p_size % 5 > 0 THEN 'AUD' END AS page FROM part),
c AS (SELECT p.part, page, CASE WHEN pick = 1 THEN (SELECT min(variant_id) FROM v WHERE v.part = p.part) WHEN pick = -5 THEN -5 END AS chosen FROM p),
e AS (SELECT l_partkey AS part, l_suppkey AS variant_id, CASE WHEN l_returnflag = 'R' THEN 'USD' ELSE 'AUD' END AS cur, min(CAST(floor(l_quantity) AS BIGINT)) AS lo, max(CAST(floor(l_quantity) AS BIGINT)) AS hi FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL),
s AS (SELECT v.*, c.page FROM v JOIN c USING (part) WHERE chosen IS NULL OR variant_id = chosen),
x AS (SELECT s.part, s.variant_id, s.price, bool_or(coalesce(cur = page AND (lo <> price OR lo <> hi), false) OR coalesce(lo <> hi, false)) AS bad, bool_or(coalesce(cur = page AND lo = price AND hi = price, false)) AS good, bool_or(coalesce(cur <> page, false)) AS other
  FROM s LEFT JOIN e ON e.part = s.part AND e.variant_id = s.variant_id GROUP BY ALL),
g AS (SELECT part, min(price) AS low, max(price) AS high, bool_or(bad) AS bad, bool_and(good) AS good, bool_or(other) AS other FROM x GROUP BY part)
SELECT c.part, CASE WHEN chosen IS NOT NULL AND (g.part IS NULL) THEN 'unresolved' WHEN chosen IS NOT NULL THEN 'variant' ELSE 'product_minimum' END AS scope,
  CASE WHEN low IS NULL THEN 'incomplete' WHEN bad THEN 'conflicted' WHEN good THEN 'verified' ELSE 'single_source' END AS price_state, CASE WHEN NOT coalesce(bad, false) THEN low END AS price,
  CASE WHEN chosen IS NULL THEN low END AS range_low, CASE WHEN chosen IS NULL THEN high END AS range_high, CASE WHEN other THEN 'conflicted' END AS currency_note
FROM c LEFT JOIN g USING (part)
""")
def scoped_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("variant_id"), F.floor("l_quantity").cast("long").alias("price"), "l_linenumber", F.when(F.col("l_returnflag") == "R", "USD").otherwise("AUD").alias("currency"))
    variants = line.groupBy("part", "variant_id").agg(F.min("price").alias("price"))
    least = variants.groupBy("part").agg(F.min("variant_id").alias("least"))
    size = F.col("p_size")
    chosen = F.when(size % 3 == 0, F.col("least")).when(size % 3 == 1, F.lit(-5).cast("long"))
    products = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "part").join(least, "part", "left").select("part", chosen.alias("chosen"), F.when(size % 5 > 0, "AUD").alias("currency"))
    return evidence.scoped_price(products, variants, line.where("l_linenumber <= 3").select("part", "variant_id", "price", "currency"), "part")


@query("""
WITH k AS (SELECT p_partkey, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS brand, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS name, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS kind FROM part)
SELECT p_partkey, brand, contains(' ' || name || ' ', ' ' || kind || ' ') AS kind_in_name, contains(' ' || brand || ' ' || name || ' ', ' ' || brand || ' ') AS brand_found FROM k
""")
def brand_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "part").select("p_partkey", *[tx.token_key(F.col(c), ascii_only=True).alias(n) for c, n in (("p_brand", "brand"), ("p_name", "name"), ("p_type", "kind"))])
    return k.select("p_partkey", "brand", tx.contains_tokens(F.col("name"), F.col("kind")).alias("kind_in_name"), tx.contains_tokens(F.concat_ws(" ", "brand", "name"), F.col("brand")).alias("brand_found"))


@query("""
SELECT doc_id, CASE WHEN n = 0 THEN 'missing' WHEN n < 40 THEN 'brief' ELSE 'substantive' END AS state, n AS words FROM (
SELECT doc_id, CAST(len(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS INTEGER) AS n FROM documents)
""")
def description_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.description_state(F.col("text")).alias("state"), tx.word_count(F.col("text")).alias("words"))


@query("""
WITH e AS (SELECT c_custkey, lower(trim('  ' || replace(c_name, '#', '.') || '@Example.COM ')) AS e FROM customer), p AS (SELECT c_custkey, e, split_part(e, '@', 1) AS l FROM e)
SELECT c_custkey, left(l, 1) || repeat('•', least(6, greatest(2, length(l) - 2))) || right(l, 1) || '@example.com' AS masked FROM p
""")
def email_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@Example.COM "))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.email_mask(tx.email_normal(raw)).alias("masked"))


_CHOICE = "CASE label % 7 WHEN 0 THEN 'absent' WHEN 1 THEN 'mentioned' WHEN 2 THEN 'shortlisted' WHEN 3 THEN 'recommended' WHEN 4 THEN 'final_choice' WHEN 5 THEN 'not_observed' ELSE 'other' END"


@query(f"""
WITH x AS (SELECT vec_id, {_CHOICE} AS c, CAST(vec_id % 11 AS DOUBLE) / 10 AS conf, CAST(vec_id % 6 AS DOUBLE) / 5 AS named, CASE WHEN vec_id % 2 = 0 THEN 'comparison' ELSE 'list' END AS shape FROM embeddings),
r AS (SELECT *, CASE WHEN c = 'other' THEN 'unknown_option' WHEN conf < 0.7 THEN 'low_confidence' WHEN c = 'not_observed' THEN 'not_observed'
  WHEN c <> 'absent' AND named < 0.8 OR c = 'absent' AND NOT named < (CAST(1 AS DOUBLE) - CAST(0.8 AS DOUBLE)) THEN 'inconsistent_identity' END AS fallback_reason FROM x)
SELECT vec_id, fallback_reason, CASE WHEN fallback_reason IS NULL THEN CASE WHEN c = 'absent' THEN 'not_retrieved' ELSE 'retrieved' END END AS retrievability,
  CASE WHEN fallback_reason IS NULL THEN CASE WHEN c IN ('absent', 'mentioned') THEN 'absent' ELSE 'included' END END AS candidate_set,
  CASE WHEN fallback_reason IS NULL THEN CASE WHEN shape = 'comparison' THEN CASE WHEN c IN ('absent', 'mentioned') THEN 'not_compared' ELSE 'retained' END WHEN c IN ('absent', 'mentioned') THEN 'not_observed' ELSE 'not_compared' END END AS comparison,
  CASE WHEN fallback_reason IS NULL THEN CASE c WHEN 'recommended' THEN 'recommended' WHEN 'final_choice' THEN 'final_choice' ELSE 'not_recommended' END END AS recommendation FROM r
""")
def classifier_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["absent", "mentioned", "shortlisted", "recommended", "final_choice", "not_observed", "other"]
    v = table(spark, sf_dir, "embeddings")
    choice = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("label") % 7 + 1).cast("int"))
    out = report.classified(choice, (F.col("vec_id") % 11).cast("double") / 10, (F.col("vec_id") % 6).cast("double") / 5, F.when(F.col("vec_id") % 2 == 0, "comparison").otherwise("list"))
    return v.select("vec_id", out.alias("o")).select("vec_id", "o.*")


@query("""
WITH f AS (SELECT p_partkey, p_name, p_brand, p_type, CASE WHEN p_size % 4 = 0 THEN 'conflicted' ELSE 'verified' END AS s FROM part)
SELECT p_partkey, left(p_name, 12) AS name, CASE WHEN s <> 'conflicted' THEN left(p_brand, 12) END AS brand, left(p_type, 12) AS type, s AS brand_state FROM f
""")
def product_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.when(F.col("p_size") % 4 == 0, "conflicted").otherwise("verified")
    each = F.array(*[F.struct(F.lit(n).alias("field"), s.alias("state"), F.col(c).alias("value")) for n, s, c in (("name", F.lit("verified"), "p_name"), ("brand", brand, "p_brand"), ("type", F.lit("single_source"), "p_type"))])
    out = profile.profile(table(spark, sf_dir, "part").select("p_partkey", F.inline(each)), "p_partkey", ["name", "brand", "type"], most=12)
    return out.select("p_partkey", "name", "brand", "type", F.col("states")["brand"].alias("brand_state"))


@query("""
WITH c AS (SELECT l_partkey AS part, 'S' || l_suppkey AS c, min(0 * 1000000000 + l_orderkey) AS o FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY o, c) AS k FROM c)
SELECT p_partkey AS part, p_name AS name, CASE WHEN p_size > 25 THEN p_brand ELSE 'shop.example.com' END AS brand, coalesce(string_agg(c, ' ' ORDER BY k) FILTER (k <= 5), '') AS codes FROM part LEFT JOIN r ON part = p_partkey GROUP BY ALL
""")
def target_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("brand"), F.lit("https://www.shop.example.com/products/x").alias("url"), F.lit(None).cast("string").alias("final_url"))
    variants = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("ord"), F.concat(F.lit("S"), "l_suppkey").alias("sku"), F.lit("").alias("barcode"))
    return profile.target_identity(products, variants, "part", most=5).select("part", "name", "brand", F.array_join("codes", " ").alias("codes"))


@query("""
SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey WHEN o_orderkey % 4 <> 3 AND o_custkey % 3 > 0 THEN o_custkey WHEN o_orderkey % 4 <> 1 AND o_custkey % 3 > 0 THEN o_custkey WHEN o_orderkey % 4 <> 3 THEN o_custkey END AS account_id FROM orders
""")
def account_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders name a customer (every fourth), a checkout (not every fourth), an address (not every fourth); a third of the accounts have none."""
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey")
    name = lambda p: F.concat(F.lit(p), c.cast("string"))
    events = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.when(k == 0, name("c")).alias("customer_id"), F.when(k != 3, name("k")).alias("checkout_id"), F.when(k != 1, name("e")).alias("email"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    accounts = people.select(F.col("o_custkey").alias("account_id"), F.when(c % 3 > 0, name("e")).alias("email"))
    return profile.resolve_account(events, people.select(name("c").alias("customer_id"), c.alias("account_id")), people.select(name("k").alias("checkout_id"), c.alias("account_id")), accounts)
