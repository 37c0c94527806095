"""Language identification by nearest centroid over hashed TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from .common import cut, in_batches, releasing, slices, table

DIM = 2048
CHUNK = 1 << 18


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _grams(codes: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(end position, bucket) of the 1- to 3-grams of letters; 0 stands for what is no letter and bounds words."""
    c = codes.astype(np.uint32)
    shift = np.uint32(32 - dim.bit_length() + 1)
    one, two = c * np.uint32(2654435761), c[:-1] * np.uint32(2246822519) + c[1:] * np.uint32(3266489917)
    three = two[:-1] * np.uint32(668265263) + c[2:] * np.uint32(374761393)
    at = [np.flatnonzero(c), np.flatnonzero(c[:-1] | c[1:]) + 1, np.flatnonzero(c[1:-1]) + 2]
    found = [one[at[0]], two[at[1] - 1] ^ np.uint32(0x5BD1E995), three[at[2] - 2] * np.uint32(2654435769)]
    return np.concatenate(at), np.concatenate([f >> shift for f in found])


def _part_counts(parts: list[tuple[str, int, bool]], owners: list[int], n: int, dim: int) -> np.ndarray:
    """Counts of n texts. parts: (text, leading characters that the part before had, whether it ends its text)."""
    text = " " + " ".join(p for p, _, _ in parts) + "  "
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(_is_letter()[codes], codes, 0)
    # an n-gram belongs to the text of its last character; row n takes those that another part counts
    runs = [(o, k) for (p, seen, ends), own in zip(parts, owners, strict=True) for o, k in ((n, seen), (own, len(p) - seen), (own if ends else n, 1))]
    owner = np.repeat(np.array([o for o, _ in runs]), [k for _, k in runs])
    owner = np.concatenate([owner[:1], owner, owner[-1:]])
    at, bucket = _grams(codes, dim)
    return np.bincount(owner[at] * dim + bucket, minlength=(n + 1) * dim).reshape(n + 1, dim)[:n]


def counts(texts: list[str | None], dim: int = DIM) -> np.ndarray:
    """n-gram counts of whole texts, a row each. Long texts are read in chunks, so that memory stays bounded,
    which overlap by the two characters that an n-gram may reach back."""
    out = np.zeros((len(texts), dim), dtype=np.float32)
    parts, owners, held = [], [], 0
    for i, t in enumerate(texts):
        t = (t or "").lower()
        for k in range(0, len(t), CHUNK):
            seen = min(k, 2)
            parts.append((t[k - seen : k + CHUNK], seen, k + CHUNK >= len(t)))
            owners.append(i)
            held += len(parts[-1][0])
            if held >= CHUNK or len(parts) >= 256:
                lo = owners[0]
                out[lo : i + 1] += _part_counts(parts, [o - lo for o in owners], i + 1 - lo, dim)
                parts, owners, held = [], [], 0
    if parts:
        lo = owners[0]
        hi = owners[-1] + 1
        out[lo:hi] += _part_counts(parts, [o - lo for o in owners], hi - lo, dim)
    return out


def weigh(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart rows; rows of x have length one."""
    mean = x.mean(0)
    picked = [int(np.argmax(x @ mean))]
    while len(picked) < min(k, len(x)):
        picked.append(int(np.argmin((x @ x[picked].T).max(1))))
    centres = x[picked].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        for j in range(len(centres)):
            if (own == j).any():
                m = x[own == j].mean(0)
                centres[j] = m / max(np.linalg.norm(m), 1e-12)
    return centres


def fit(docs: DataFrame, lang: str = "lang", per_lang: int = 1000, centroids: int = 4, dim: int = DIM, slack: float = 0.5) -> pd.DataFrame:
    """Centroids from docs (doc_id, text, lang): a row (lang, centroid, reject_below) each; `idf` is in attrs.

    Learns from a sample of about `per_lang` documents of each language, and never more than twice as many, dealt by a hash of
    doc_id and text: rows without doc_id count like others, and rows equal in both are one. Rows without lang or without letters are left out. A language rejects what is farther than any but 1 % of its own sample
    times `slack`. An empty table gives no rows.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text", F.lit("sample")))
    share = cut(rows.groupBy("lang").agg((F.lit(float(per_lang)) / F.approx_count_distinct("h", 0.02)).alias("share")))
    # languages are few as a rule; texts are shuffled by language only where they are not
    share = F.broadcast(share) if share.count() <= 100_000 else share
    some = rows.join(share, "lang").where(F.pmod("h", F.lit(1 << 40)) / float(1 << 40) < F.col("share")).select("lang", "h", "text")
    # equal rows become one before they meet; what is left of a language is about per_lang rows
    some = some.dropDuplicates(["lang", "h"]).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("h")))
    chosen = in_batches(some.where(F.col("rank") <= 2 * per_lang).select("lang", "text"))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                own = pdf.iloc[at : at + 256]
                tf = counts(own["text"].tolist(), dim)
                keep = tf.any(axis=1)
                yield pd.DataFrame({"lang": own["lang"][keep], "tf": [r.tobytes() for r in tf[keep]]})

    sample = cut(chosen.mapInPandas(releasing(vectors), "lang string, tf binary"))

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(dim), 0
        for pdf in batches:
            for raw in pdf["tf"]:
                df += np.frombuffer(raw, np.float32) > 0
                n += 1
        yield pd.DataFrame({"n": [n], "df": [df.tolist()]})

    found = sample.coalesce(16).mapInPandas(seen, "n long, df array<double>").toPandas()
    idf = np.log((1 + found["n"].sum()) / (1 + np.sum(found["df"].tolist(), axis=0))).astype(np.float32) + 1 if len(found) else np.ones(dim, np.float32)

    def centres(pdf: pd.DataFrame) -> pd.DataFrame:
        x = weigh(np.stack([np.frombuffer(raw, np.float32) for raw in pdf["tf"]]), idf)
        c = cluster(x, centroids)
        low = float(np.quantile((x @ c.T).max(1), 0.01)) * slack
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(c), "centroid": [r.astype(np.float32).tobytes() for r in c], "reject_below": [low] * len(c)})

    model = sample.groupBy("lang").applyInPandas(centres, "lang string, centroid binary, reject_below double").toPandas().sort_values(["lang", "centroid"]).reset_index(drop=True)
    model.attrs["idf"] = idf
    return model


def predict(docs: DataFrame, model: pd.DataFrame, dim: int = DIM) -> DataFrame:
    """docs (text and any other columns) with lang_pred, score (cosine with the nearest centroid) and rejected.

    A null text or one without a letter gets `und`, score 0, rejected; so does every text where the model is empty.
    """
    idf = model.attrs["idf"]
    langs = sorted(model["lang"].unique())
    c = np.stack([np.frombuffer(r, np.float32) for r in model["centroid"]]) if langs else np.zeros((0, dim), np.float32)
    which = np.array([langs.index(x) for x in model["lang"]], dtype=int)
    low = np.array([model["reject_below"][which == k].iloc[0] for k in range(len(langs))])
    sent = docs.sparkSession.sparkContext.broadcast((idf, c, which, low, langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, c, which, low, langs = sent.value
        for b in slices(batches):
            texts, names, scores, out = b.column("text").to_pylist(), [], [], []
            for at in range(0, len(texts), 256):
                tf = counts(texts[at : at + 256], dim)
                sim = np.clip(weigh(tf, idf) @ c.T, 0, 1)
                best = np.argmax(sim, axis=1) if len(langs) else np.zeros(len(tf), int)
                for i, any_letter in enumerate(tf.any(axis=1).tolist()):
                    if not any_letter or not langs:
                        names.append("und"), scores.append(0.0), out.append(True)
                    else:
                        k, s = which[best[i]], float(sim[i, best[i]])
                        names.append(langs[k]), scores.append(s), out.append(bool(s < low[k]))
            rest = [b.column(i) for i, n in enumerate(b.schema.names) if n not in added]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], names=[*(n for n in b.schema.names if n not in added), *added])

    added = ["lang_pred", "score", "rejected"]
    kept = docs.drop(*added)
    schema = T.StructType(list(kept.schema))
    for name, kind in zip(added, ("string", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return kept.mapInArrow(releasing(run), schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def op5_centroid_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
