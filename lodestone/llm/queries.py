"""The queries of this subpackage for the driver, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontam import op1_template_decontamination, oracle_sql as _decontamination_sql
from .embed_dedup import op6_rotation_code_dedup
from .html_extract import op10_host_html_extraction
from .importance import op11_target_importance_resampling
from .langid import op5_centroid_langid
from .maxent import op12_maxent_scoring
from .packing import op2_best_fit_packing
from .pii import op4_skip_chain_pii
from .sharding import op8_label_propagation_sharding
from .simhash import op9_golay_simhash
from .suffix_dedup import op7_suffix_array_dedup
from .vector_codes import op13_vector_code_compression, oracle_sql as _vector_codes_sql
from .warc import op3_warc_zstd

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_template_decontamination": op1_template_decontamination,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_warc_zstd": op3_warc_zstd,
    "op4_skip_chain_pii": op4_skip_chain_pii,
    "op5_centroid_langid": op5_centroid_langid,
    "op6_rotation_code_dedup": op6_rotation_code_dedup,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_label_propagation_sharding": op8_label_propagation_sharding,
    "op9_golay_simhash": op9_golay_simhash,
    "op10_host_html_extraction": op10_host_html_extraction,
    "op11_target_importance_resampling": op11_target_importance_resampling,
    "op12_maxent_scoring": op12_maxent_scoring,
    "op13_vector_code_compression": op13_vector_code_compression,
}

_ARTICLE = "regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g')"
_DECODED = f"replace(replace(replace(replace(replace(replace({_ARTICLE}, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"

#: The others learn, tokenise, hash or iterate in ways that SQL has not; tests/llm compares them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_template_decontamination": _decontamination_sql(),
    "op3_warc_zstd": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS top FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN top END AS refers_to
FROM d LEFT JOIN m USING (payload_digest)
""",
    "op6_rotation_code_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM v),
k AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.l > 0 AND b.l > 0 AND list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, k.b FROM r JOIN k ON k.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node), d AS (SELECT a, count(*) AS n_links FROM k GROUP BY a)
SELECT node AS vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, node = component_id AS kept FROM c LEFT JOIN d ON d.a = c.node
""",
    "op10_host_html_extraction": f"""
WITH t AS (SELECT page_id, url, coalesce(trim(regexp_replace({_DECODED}, '\\s+', ' ', 'g')), '') AS text FROM pages)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
""",
    "op13_vector_code_compression": _vector_codes_sql(),
}
