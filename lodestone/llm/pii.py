"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The field adds to them: its nodes are the tokens of a document that may be
personal data; neighbours share chain potentials, and repeated or similar tokens, however distant, share skip
potentials. Base spans are observed; loopy message passing gives every other node its label, so that one
document labels the same number or address alike wherever it stands.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import in_batches, releasing, slices, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

# the contract's patterns, written so that each runs in linear time: a start within a digit run can't match
# where the run's own start does not, and quantifiers that can't give back are possessive
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[(\[]\s?at\s?[)\]]")
_DIGITS = re.compile(r"[0-9]")

_NUMBER = re.compile(r"(?<![0-9A-Za-z])[(+]{0,2}[0-9](?:[ ().-]{0,2}[0-9])++")
_LETTER_OR_DIGIT = re.compile(r"[0-9A-Za-z]")
_AT = re.compile(r"@|\s?[(\[]\s?at\s?[)\]]\s?")
_TAIL = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?| dot )[A-Za-z0-9-]++)*+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, start if start < at else done)
        at = text.find("@", max(at + 1, done if m else at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern matches, sorted; code points, end exclusive."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Nodes (start, label number, end): the base spans with their labels, and other tokens that may be personal data with label 0."""
    # a run of digits before a letter is no token from any start within it, so the search goes on behind it
    found = [(m.start(), m.end()) for m in _NUMBER.finditer(text) if not _LETTER_OR_DIGIT.match(text, m.end()) and 7 <= len(_DIGITS.findall(m[0])) <= 19]
    for m in _AT.finditer(text):
        start = m.start()
        while start > 0 and text[start - 1] in _LOCAL:
            start -= 1
        tail = _TAIL.match(text, m.end())
        if start < m.start() and tail:
            found.append((start, tail.end()))
    taken = sorted((s, e) for s, _, e in base)
    out, k, reach = [(s, kind + 1, e) for s, kind, e in base], 0, -1
    for s, e in sorted(found):
        while k < len(taken) and taken[k][0] < e:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= s:  # it overlaps no base span
            out.append((s, 0, e))
            reach = max(reach, e)
    return sorted(out)


FEATURES = 13


def features(text: str, start: int, end: int) -> list[float]:
    """What a token looks like and stands among. A leading +, the @ sign and check digits, which make base spans, are left out."""
    t = text[start:end].lstrip("+")
    digits = len(_DIGITS.findall(t))
    address = "@" in t or bool(_AT.search(t))
    dotted = address and ("." in t or "dot" in t)
    left = text[max(0, start - 2) : start]
    return [
        1.0, dotted, address and not dotted, t.count(".") == 3, "(" in t and digits > 0, "-" in t, " " in t,
        digits < 9, 9 <= digits <= 11, 12 <= digits <= 15, digits == 16, digits > 16, left[-1:] in "\"'=:#",
    ]


def similar(text: str, start: int, end: int) -> str:
    """Tokens with the same key are similar: the last nine digits of a number, the letters and digits of an address."""
    t = text[start:end]
    d = "".join(_DIGITS.findall(t))
    if len(d) >= 7 and "@" not in t:
        return d[-9:] if len(d) > 10 else d[-7:]
    return re.sub(r"[^a-z0-9]|(?<=[)\]\s])dot(?=[)\]\s])", "", re.sub(r"\s?[(\[]\s?(?:at|dot)\s?[)\]]\s?", "", t.lower()))


def graph(text: str, nodes: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j, kind): 0 between neighbours, 1 from each token to the next similar one. Their number is linear in the nodes."""
    edges, last = [(i, i + 1, 0) for i in range(len(nodes) - 1)], {}
    for i, (s, _, e) in enumerate(nodes):
        key = similar(text, s, e)
        # numbers of which one has more leading digits are similar as well
        for k in {key, key[-7:]}:
            if k in last:
                edges.append((last[k], i, 1))
            last[k] = i
    x = np.array([features(text, s, e) for s, _, e in nodes], dtype=float).reshape(-1, FEATURES)
    return x, np.array(sorted(set(edges)), dtype=int).reshape(-1, 3)


def marginals(unary: np.ndarray, edges: np.ndarray, potential: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Loopy sum-product: label probabilities of the nodes. unary: log potentials by node; potential: by edge kind, log, symmetric."""
    n, labels = unary.shape
    src = np.concatenate([edges[:, 0], edges[:, 1]])
    dst = np.concatenate([edges[:, 1], edges[:, 0]])
    kind = np.concatenate([edges[:, 2]] * 2)
    m = len(edges)
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    msg = np.zeros((2 * m, labels))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        out = (belief[src] - msg[back])[:, :, None] + potential[kind]
        top = out.max(1, keepdims=True)
        new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
        new -= new.max(1, keepdims=True)
        if np.abs(new - msg).max(initial=0) < 1e-6:
            break
        msg = 0.5 * msg + 0.5 * new
    belief = unary.copy()
    np.add.at(belief, dst, msg)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit_field(docs: DataFrame, sample: int = 20_000, most_nodes: int = 500, rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(unary weights, pair potentials by edge kind), by maximum pseudo-likelihood on about `sample` documents.

    Labels are those of the base spans, whose features leave out what makes them base spans: each node is learned as if its own label
    were hidden. The pair potentials are kept symmetric. A document of more than `most_nodes` nodes teaches by that many in a row,
    from a place dealt by its text's checksum. Without any token to learn from, all weights are zero and the field adds nothing.
    """
    share = min(1.0, sample / max(1, docs.count()))
    u = F.pmod(F.xxhash64(F.lit("pii"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.col("text").cast("string")), F.lit(1 << 40)) / float(1 << 40)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["text"]:
                if t and _ANY.search(t):
                    nodes = candidates(t, base_spans(t))
                    if len(nodes) > most_nodes:
                        at = zlib.crc32(t.encode("utf-8", "surrogatepass")) % (len(nodes) - most_nodes + 1)
                        nodes = nodes[at : at + most_nodes]
                    if nodes:
                        x, edges = graph(t, nodes)
                        rows.append((len(nodes), [n[1] for n in nodes], x.ravel().tolist(), edges.ravel().tolist()))
            yield pd.DataFrame(rows, columns=["n", "labels", "x", "edges"])

    got = in_batches(docs).where(u < share).select(F.col("text").cast("string").alias("text")).mapInPandas(run, "n int, labels array<int>, x array<double>, edges array<int>").toPandas()
    k = len(LABELS)
    w, pair = np.zeros((FEATURES, k)), np.zeros((2, k, k))
    if not len(got):
        return w, pair
    y, x = np.concatenate(got["labels"].tolist()), np.concatenate(got["x"].tolist()).reshape(-1, FEATURES)
    first = np.cumsum(got["n"].to_numpy()) - got["n"].to_numpy()
    e = np.concatenate([np.asarray(a, dtype=int).reshape(-1, 3) + [f, f, 0] for a, f in zip(got["edges"], first, strict=True)])
    src, dst, kind = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]]), np.concatenate([e[:, 2]] * 2)
    gold = np.eye(k)[y]
    for _ in range(rounds):
        score = x @ w
        np.add.at(score, dst, pair[kind, y[src]])
        p = np.exp(score - score.max(1, keepdims=True))
        diff = gold - p / p.sum(1, keepdims=True)
        w += rate * (x.T @ diff / len(y) - decay * w)
        g = np.zeros_like(pair)
        np.add.at(g, (kind, y[src]), diff[dst])
        g = (g + g.transpose(0, 2, 1)) / (2 * len(y))
        pair += rate * (g - decay * pair)
    return w, pair


def added_spans(text: str, nodes: list[tuple[int, int, int]], model: tuple[np.ndarray, np.ndarray], sure: float) -> list[tuple[int, int, int]]:
    """Of nodes (start, label number, end), those without a label to which the field gives one with probability `sure` at least, as spans."""
    if all(label for _, label, _ in nodes):
        return []
    x, edges = graph(text, nodes)
    unary = x @ model[0]
    for i, (_, label, _) in enumerate(nodes):
        if label:
            unary[i] = -50.0
            unary[i, label] = 50.0
    p = marginals(unary, edges, model[1])
    best = p.argmax(1)
    return [(s, int(best[i]) - 1, e) for i, (s, label, e) in enumerate(nodes) if not label and best[i] and p[i, best[i]] >= sure]


def find_spans(text: str | None, model: tuple[np.ndarray, np.ndarray], sure: float = 0.9) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text, each (start, kind number, end) in order."""
    if not text or not _ANY.search(text):
        return [], []
    base = base_spans(text)
    nodes = candidates(text, base)
    return base, sorted(base + added_spans(text, nodes, model, sure))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def personal_data(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """docs (text and any other columns) with base_counts (by KINDS), base_spans and spans (kind:start:end, joined).

    Null and empty texts have none. Repeated rows are read each for itself; columns of these names are replaced.
    """
    added = ["base_counts", "base_spans", "spans"]
    kept = in_batches(docs).drop(*added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, base, spans = [], [], []
            for t in b.column("text").to_pylist():
                own, all_of = find_spans(t, model)
                n.append([sum(s[1] == k for s in own) for k in range(len(KINDS))])
                base.append(joined(own))
                spans.append(joined(all_of))
            rest = [b.column(i) for i, c in enumerate(b.schema.names)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.list_(pa.int64())), pa.array(base, pa.string()), pa.array(spans, pa.string())], names=[*b.schema.names, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(releasing(run), f"{fields}, base_counts array<long>, base_spans string, spans string")


def redact(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """docs (text and any other columns) with each span replaced by its kind in angle brackets; overlapping spans become one, of the first's kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at, out = b.schema.names.index("text"), []
            for t in b.column("text").to_pylist():
                _, spans = find_spans(t, model)
                parts, last = [], 0
                for s, k, e in spans:
                    if s >= last:
                        parts += [t[last:s], f"<{KINDS[k].upper()}>"]
                    last = max(last, e)
                out.append("".join([*parts, t[last:]]) if spans else t)
            yield b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type))

    return in_batches(docs).mapInArrow(releasing(run), docs.schema)


def op4_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_data(docs, fit_field(docs))
    counts = [F.col("base_counts")[i].alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans")
