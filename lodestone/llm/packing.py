"""Best-fit packing of token sequences by hierarchical residual packing.

Each input partition tokenises its documents and packs their pieces best-fit decreasing. Bins that
are nearly full are final. Underfull bins become items of the next round: a tree of merges, each
of bounded size, repeats best-fit over them until one group is left or a round saves no bin.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, in_batches, releasing, slices, table

#: One piece of a document in the packed members of a bin.
PIECE = np.dtype([("doc_id", "<i8"), ("known", "?"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])
OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class ChunkEncoder:
    """Ids of texts, by the ids of their words.

    The tokenizer drops white space and never joins characters across it, so the ids of a text are those of its chunks
    in a row. Nor does it join a letter or digit with punctuation after it, or tell A-Z from a-z but in special tokens,
    so texts are lower-cased and a chunk's tail of punctuation is set apart by a space before they are split. Each word
    is encoded by the tokenizer itself, many new ones at a time with a separator between them.
    Arrow splits the texts and numbers the distinct words of a call; only those are looked up one by one. What was
    encoded is kept as ranges of one array of ids and forgotten beyond `most` words or `most_ids` ids.
    """

    #: A letter or digit and the punctuation that ends its chunk (not U+0130, whose lower case ends in a mark).
    _TAILED = r"([0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}])([.,;:!?%&*#$]+(?: |$))"
    _SEPARATOR = "|"

    def __init__(self, path: str, most: int = 400_000, most_ids: int = 4_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.most_ids = Tokenizer.from_file(path), most, most_ids
        self.separator = self.tokenizer.encode(self._SEPARATOR, add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.number, self.used = {"": 0}, 0
        self.ids, self.start, self.length = np.zeros(1 << 16, "<u4"), np.zeros(1, "i8"), np.zeros(1, "i8")

    def _add(self, found: np.ndarray, lengths: np.ndarray) -> None:
        """Stores ids, `lengths` of them under each of the next numbers."""
        ends = self.used + np.cumsum(lengths)
        self.start, self.length = np.concatenate([self.start, ends - lengths]), np.concatenate([self.length, lengths])
        stop = self.used + len(found)
        if stop > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), stop - len(self.ids)), "<u4")])
        self.ids[self.used : stop], self.used = found, stop

    def _row(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these numbers in a row, and where each number's end."""
        lengths = self.length[numbers]
        ends = np.cumsum(lengths)
        at = np.repeat(self.start[numbers] - ends + lengths, lengths)
        at += np.arange(len(at))
        return self.ids[at], ends

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words in a row, and how many are each one's."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(ids), "<u4"), np.array([len(x) for x in ids], "i8")

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _each, for words without the separator: they are encoded as one text."""
        ids = np.array(self.tokenizer.encode_batch_fast([f" {self._SEPARATOR} ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        between = ids == self.separator[0]
        at = np.flatnonzero(between)
        if len(at) != len(words) - 1:
            return self._each(words)
        return ids[~between], np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1

    def _learn(self, words: list[str]) -> None:
        """Gives every word a number."""
        new = [w for w in words if w not in self.number]
        alone = [w for w in new if self._SEPARATOR in w or len(w) > 1000] if len(self.separator) == 1 else new
        apart = set(alone)
        joined = [w for w in new if w not in apart] if apart else new
        for some, encode in ((joined, self._joined), (alone, self._each)):
            for i in range(0, len(some), 1_000):
                part = some[i : i + 1_000]
                self.number.update(zip(part, range(len(self.start), len(self.start) + len(part)), strict=True))
                self._add(*encode(part))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        ids, begins = self.encode(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:], strict=True)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids (little-endian unsigned, 32 bits) of all texts in a row, and where each text's begin, with the end of the last."""
        if len(self.number) > self.most or self.used > self.most_ids:
            self._forget()
        texts = texts.cast(pa.large_string()).fill_null("")
        spaced = pc.replace_substring(pc.replace_substring(texts, "\n", " "), "\t", " ")
        if not pc.any(pc.match_substring(spaced, "<|")).as_py():
            spaced = pc.ascii_lower(spaced)
        split = pc.split_pattern(pc.replace_substring_regex(spaced, self._TAILED, r"\1 \2"), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._learn(words)
        own = np.fromiter(map(self.number.__getitem__, words), "i8", len(words))[coded.indices.to_numpy()]
        ids, ends = self._row(own)
        of_text = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        for w in coded.dictionary.filter(pc.greater(pc.utf8_length(coded.dictionary), 64)).to_pylist():
            self.number.pop(w, None)
        return ids, of_text


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def best_fit(sizes: Iterable[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: lists of item numbers. A bit mask of the free spaces in use finds the tightest bin."""
    sizes = np.asarray(list(sizes), dtype=np.int64)
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        if fits := mask >> s:
            room = s + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > s:
            mask |= 1 << (room - s)
            free[room - s].append(b)
    return bins


def _pieces(ids: pd.DataFrame, texts: pa.Array, path: str, capacity: int, end_id: int) -> np.ndarray:
    end, found = np.array([end_id], "<u4").tobytes(), []
    doc_ids, (all_ids, begins) = ids["doc_id"], encoder(path).encode(texts)
    spans = zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)
    for d, known, (begin, stop) in zip(doc_ids.fillna(0).astype("int64").tolist(), doc_ids.notna().tolist(), spans, strict=True):
        raw = all_ids[begin:stop].tobytes() + end
        for k, at in enumerate(range(0, len(raw), 4 * capacity)):
            part = raw[at : at + 4 * capacity]
            found.append((d, known, k, at // 4, len(part) // 4, zlib.crc32(part)))
    return np.array(found, dtype=PIECE)


def _bins(sizes: np.ndarray, members: list[bytes], capacity: int, full: int) -> pd.DataFrame:
    rows = []
    for own in best_fit(sizes, capacity):
        n = int(sizes[own].sum())
        rows.append((n, b"".join(members[i] for i in own), n >= full))
    return pd.DataFrame(rows, columns=["size", "members", "done"])


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, full: float = 0.99, group: int = 4096, fan_in: int = 8) -> DataFrame:
    """Packs documents (doc_id, text; more columns are ignored) into sequences of at most `capacity` tokens.

    vocabulary: path of a tokenizers file. A null or empty text is the single token end_id; only documents
    longer than `capacity` are cut. Repeated rows are packed each for itself; a null doc_id stays null; an
    empty table gives no rows. A bin of at least `full` x capacity is final; others meet in groups of about
    `group` bins, `fan_in` times fewer groups each round. Returns a row for each piece, see OUT.
    """
    full_at = int(capacity * full)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for b in slices(batches, 2000):
            if b.num_rows:
                pa.default_memory_pool().release_unused()
                found.append(_pieces(b.select(["doc_id"]).to_pandas(), b.column("text"), vocabulary, capacity, end_id))
        if not found:
            return
        pieces = np.concatenate(found)
        for at in range(0, len(pieces), 200_000):  # bounded memory; partitions are far smaller as a rule
            own = pieces[at : at + 200_000]
            raw, w = own.tobytes(), PIECE.itemsize
            out = _bins(own["length"].astype(np.int64), [raw[i : i + w] for i in range(0, len(raw), w)], capacity, full_at)
            yield pa.RecordBatch.from_pandas(out.assign(size=out["size"].astype("int32")), preserve_index=False)

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        return _bins(pdf["size"].to_numpy(np.int64), pdf["members"].tolist(), capacity, full_at).astype({"size": "int32"})

    schema = "size int, members binary, done boolean"
    cur = cut(in_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(releasing(first), schema))
    parts, left = [cur.where("done")], cur.where("NOT done")
    n, groups, before = left.count(), None, None
    while n > 1 and before != 1 and (groups is None or n < last):
        groups = max(1, -(-n // group), (groups or 0) // fan_in)
        # sizes spread over all groups; the key is of the bin's content, so a lost task deals the same again
        dealt = left.withColumn("g", F.pmod(F.xxhash64("members"), F.lit(groups)))
        cur = cut(dealt.groupBy("g").applyInPandas(lambda pdf: again(pdf), schema))
        parts.append(cur.where("done"))
        left, last, before = cur.where("NOT done"), n, groups
        n = left.count()
    parts.append(left)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, members = b.column("sequence_id").to_numpy(zero_copy_only=False), b.column("members").to_pylist()
            own = [np.frombuffer(m, dtype=PIECE) for m in members]
            if not own:
                continue
            x, sizes = np.concatenate(own), [len(o) for o in own]
            offset = np.concatenate([np.cumsum(o["length"], dtype=np.int64) - o["length"] for o in own])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x["doc_id"], mask=~x["known"]), pa.array(x["piece"].astype("i4")), pa.array(x["start"].astype("i8")), pa.array(x["length"].astype("i8")), pa.array(x["crc"].astype("i8")), pa.array(np.repeat(seq, sizes)), pa.array(offset)],
                names=[c.split()[0] for c in OUT.split(", ")],
            )

    # the round in the top bits keeps the numbers of one round's partitions apart from another's
    numbered = [p.select("members", (F.monotonically_increasing_id() + F.lit(k << 57)).alias("sequence_id")) for k, p in enumerate(parts)]
    out = numbered[0]
    for p in numbered[1:]:
        out = out.unionByName(p)
    return out.mapInArrow(spread, OUT)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
