"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item leaks into a document if at least 0.8 of the item's distinct five-word shingles occur in it
(an item of fewer words is one shingle; words are runs of letters, digits and underscores, lower-cased).

Items are partitioned by size. An item of n shingles may miss m = n - ceil(0.8 n) of them, and the items of one m are a
partition with one signature length: each keeps its 2 m + 1 shingles of least hash (all, if it has fewer), a
bottom-k MinHash sketch. The share of a sketch that stands in a document estimates the item's containment there. A contained
item misses at most m hashes of its sketch, so the m + 1 (or k - m) others must be found: documents with fewer are refused by the
estimate, and none that contains the item is. Candidates are verified on the shingles themselves. Documents of any length are
searched whole.

Sketches of up to `limit` hashes in total, and texts of up to 64 `limit` characters (both counted), are sent to the tasks,
and search and verification run where the document is read. Beyond that, the sketches are joined by a shuffle, with hot
hashes left to the adaptive skew join."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import bounded, mapped, slices, without, written

SHINGLE = 5
SHARE = 0.8
LIMIT = 250_000

_word = re.compile(r"\w+")
_MULTIPLIERS = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


def words(text: str | None) -> list[str]:
    return _word.findall((text or "").lower())


def shingles(ws: list[str]) -> list[str]:
    """The five-word shingles in order; fewer words are one shingle, none are none."""
    if not ws:
        return []
    return [" ".join(ws[i : i + SHINGLE]) for i in range(max(1, len(ws) - SHINGLE + 1))]


class _Words(dict):
    """Word to hash, forgetting all when full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 50_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hash = _Words()


def hashes(ws: list[str]) -> np.ndarray:
    """A hash of each shingle, in the order of shingles()."""
    if not ws:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_hash.__getitem__, ws), np.uint64, len(ws))
    n = max(1, len(ws) - SHINGLE + 1)
    out = np.full(n, len(ws) if len(ws) < SHINGLE else 0, np.uint64)
    for i in range(min(SHINGLE, len(ws))):
        out += (h[i : i + n] ^ (h[i : i + n] >> np.uint64(29))) * _MULTIPLIERS[i]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def sketch_size(n: int, share: float = SHARE) -> tuple[int, int]:
    """Of an item of n distinct shingles: how many hashes its partition's sketch keeps, and how many of them a document that
    contains the item can't do without."""
    missed = n - math.ceil(share * n - 1e-9)
    k = min(n, 2 * missed + 1)
    return k, k - missed


def sketch(ws: list[str]) -> tuple[list[int], int]:
    """The item's least distinct hashes, and how many of them must be found."""
    distinct = np.unique(hashes(ws))
    if not len(distinct):
        return [], 0
    k, least = sketch_size(len(distinct))
    return distinct[:k].tolist(), least


def _contained(item: frozenset, ws: list[str]) -> int:
    """How many of the item's shingles occur among the shingles of ws."""
    return len(item.intersection(shingles(ws)))


def _signed(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, text, hashes, least) of the items that have words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [sketch(words(t)) for t in b.column(1).to_pylist()]
            cols = [pa.array([h for h, _ in made], pa.list_(pa.int64())), pa.array([n for _, n in made], pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["item_id", "text", "hashes", "least"])

    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return mapped(rows, sign, "item_id long, text string, hashes array<long>, least int").where("least > 0")


def _small(signed: DataFrame, limit: int) -> bool:
    size = signed.agg(F.sum(F.size("hashes")), F.sum(F.length("text"))).first()
    return (size[0] or 0) <= limit and (size[1] or 0) <= 64 * limit


class Index:
    """The sketches of items of checked size, by partition, inverted."""

    def __init__(self, rows: list):
        self.ids, self.texts = [r.item_id for r in rows], [r.text for r in rows]
        self.least = np.array([r.least for r in rows], np.int64)
        pairs = sorted((h, at) for at, r in enumerate(rows) for h in r.hashes)
        keys = np.array([h for h, _ in pairs], np.int64)
        self.owner = np.array([at for _, at in pairs], np.int64)
        self.keys, first = np.unique(keys, return_index=True)
        self.first = np.append(first, len(keys))
        self.slots = 1 << max(12, (16 * len(keys)).bit_length())
        self.mask = np.zeros(self.slots, bool)  # most hashes are refused by one look-up
        self.mask[keys & (self.slots - 1)] = True
        self.item = lru_cache(maxsize=1024)(lambda at: frozenset(shingles(words(self.texts[at]))))

    def found(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item's place, its shingles, those in the text) of every item contained in a text."""
        ws = words(text)
        h = hashes(ws)
        h = np.unique(h[self.mask[h & (self.slots - 1)]])
        if not len(h) or not len(self.keys):
            return []
        at = np.searchsorted(self.keys, h)
        at = at[(at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == h)]
        met = [self.owner[self.first[i] : self.first[i + 1]] for i in at.tolist()]
        if not met:
            return []
        items, times = np.unique(np.concatenate(met), return_counts=True)
        items = items[times >= self.least[items]]  # the estimate of containment is high enough
        have = set(shingles(ws)) if len(items) else set()
        out = []
        for i in items.tolist():
            item = self.item(i)
            n = len(item & have)
            if n >= SHARE * len(item) - 1e-9:
                out.append((i, len(item), n))
        return out


_PAIR = "id long, item_id long, item_shingles long, found long"


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in rows], pa.int64()) for k in range(4)], ["id", "item_id", "item_shingles", "found"])


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, item_id, item_shingles, found, containment) for every item contained in a row of docs.

    Null and empty texts contain nothing and items without words are contained in nothing. Repeated rows
    of docs or items give their pairs once; empty tables give none. Further columns are not read."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = written(_signed(items, item_col, item_text_col))
    found = _sent(d, signed) if _small(signed, limit) else _shuffled(d, signed)
    return found.select("id", "item_id", "item_shingles", "found", (F.col("found") / F.col("item_shingles")).alias("containment"))


def _sent(d: DataFrame, signed: DataFrame) -> DataFrame:
    """Search with the sketches, of checked size, in each task."""
    sent = d.sparkSession.sparkContext.broadcast(signed.collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sent.value)
        for b in slices(batches):
            rows = []
            for id_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += [(id_, index.ids[at], n, found) for at, n, found in index.found(text)]
            yield _pairs(rows)

    return mapped(d, run, _PAIR).distinct()


def _shuffled(d: DataFrame, signed: DataFrame) -> DataFrame:
    """Search by joins only; no side is held whole anywhere."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            each = [np.unique(hashes(words(t))) for t in b.column(1).to_pylist()]
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(each)), list(map(len, each)))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate([*each, np.zeros(0, np.int64)]))], ["id", "h"])

    heads = signed.select("item_id", "least", F.explode("hashes").alias("h")).distinct()
    met = mapped(d, spread, "id long, h long").join(heads, "h").groupBy("id", "item_id").agg(F.count_distinct("h").alias("met"), F.min("least").alias("least"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for id_, item_id, text, item in zip(*(c.to_pylist() for c in b.columns), strict=True):
                want = frozenset(shingles(words(item)))
                n = _contained(want, words(text))
                if want and n >= SHARE * len(want) - 1e-9:
                    rows.append((id_, item_id, len(want), n))
            yield _pairs(rows)

    met = met.where("met >= least").select("id", "item_id")
    texts = met.join(d, met.id.eqNullSafe(d.id)).select(met.id, "item_id", "text")
    items = signed.select(F.col("item_id").alias("__item"), F.col("text").alias("__text"))
    both = texts.join(items, texts.item_id.eqNullSafe(items["__item"])).select("id", "item_id", "text", "__text")
    return mapped(both, verify, _PAIR).distinct()


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """The rows of docs that contain no item, with the columns of docs; each row is judged by its own text, whatever its id.

    With sketches of checked size nothing is shuffled. Else rows are named by a hash of their text, and those that leak are
    written before they are taken away."""
    signed = written(_signed(items, "item_id", "text"))
    text = F.col(text_col).cast("string")
    if _small(signed, limit):
        bounded(docs.sparkSession)
        return docs.where(~_leaking(docs, signed, text))
    named = docs.select(F.xxhash64(text).alias("id"), text.alias("text")).where("text is not null").dropDuplicates(["id"])
    return without(docs, F.xxhash64(text), written(_shuffled(named, signed).select("id").distinct()))


def _leaking(docs: DataFrame, signed: DataFrame, text: Column) -> Column:
    """Whether a text contains an item; only texts go to Python."""
    sent = docs.sparkSession.sparkContext.broadcast(signed.collect())

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(sent.value)
        for t in texts:
            yield pa.array([bool(index.found(s)) for at in range(0, len(t), 256) for s in t.slice(at, 256).to_pylist()], pa.bool_())

    return F.arrow_udf(run, "boolean")(text)
