"""SimHash near-duplicates by anchor-point covering.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 1 bit in one of their 32-bit
halves. The first 31 bits of a half are covered by the code words of the perfect [31,26] Hamming code:
each word lies within covering radius 1 of exactly one anchor, its home. A fingerprint is replicated to
every anchor within radius plus threshold, 1 + 1 = 2 (one for a code word, else 16), so a pair that is
close in a half meets at the home anchor of either. There all 64 bits are compared. With 2**27 anchors
a fingerprint meets few strangers: N distinct fingerprints cost about 31 N small rows and N / 2**23
comparisons each.

An anchor emits links that span its components, never all pairs. An anchor with more entries than
`block` is cut into blocks whose pairs are compared by separate tasks. Exact copies share a fingerprint
and are one entry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import components, gathered, mapped, slices, tasks, without, written

SEED = 42
SHINGLE = 3
DISTANCE = 3
BLOCK = 16384


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text; 0 if it has no words or is null."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        a, b = starts[at : min(at + 65536, n)].tolist(), ends[at + shingle - 1 : at + shingle - 1 + 65536].tolist()
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(a, b, strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for each row of docs, fp as a signed long with the fingerprint's bits. A null text counts
    as empty; a null id is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, fp long")


def _syndrome_tables() -> list[np.ndarray]:
    """For each byte of a 31-bit word, the XOR of the positions (1 to 31) of its set bits."""
    out = []
    for byte in range(4):
        values = np.arange(256)
        s = np.zeros(256, np.int64)
        for bit in range(8):
            if byte * 8 + bit < 31:
                s ^= ((values >> bit) & 1) * (byte * 8 + bit + 1)
        out.append(s)
    return out


_TABLES = _syndrome_tables()


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) of every anchor of both halves within distance 2 of the fingerprints."""
    rows, keys, homes = [], [], []
    for half in (0, 1):
        x = ((fp.view(np.uint64) >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)).astype(np.int64)
        s = _TABLES[0][x & 255] ^ _TABLES[1][x >> 8 & 255] ^ _TABLES[2][x >> 16 & 255] ^ _TABLES[3][x >> 24]
        home = np.where(s > 0, x ^ np.where(s > 0, 1 << np.maximum(s - 1, 0), 0), x)
        base = np.int64(half) << 31
        rows.append(np.arange(len(fp)))
        keys.append(base | home)
        homes.append(np.ones(len(fp), bool))
        for i in range(1, 32):  # flipping positions i and i ^ s, each pair once, leads to a code word
            j = i ^ s
            at = np.flatnonzero((s > 0) & (j > i))
            rows.append(at)
            keys.append(base | (x[at] ^ (1 << (i - 1)) ^ (1 << (j[at] - 1))))
            homes.append(np.zeros(len(at), bool))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def _spanning(fp: np.ndarray, home: np.ndarray, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the components of the graph of pairs within DISTANCE of which one has its home here.
    left: if given, only pairs between its two sides count."""
    out = []
    bits = fp.view(np.uint64)  # bitwise_count of a signed number counts the bits of its absolute value
    free = np.arange(len(fp))
    while len(free):
        stack, free = [free[0]], free[1:]
        while stack and len(free):
            x = stack.pop()
            near = np.bitwise_count(bits[free] ^ bits[x]) <= DISTANCE
            if not home[x]:
                near &= home[free]
            if left is not None:
                near &= left[free] != left[x]
            if near.any():
                hit, free = free[near], free[~near]
                out += [(int(fp[x]), int(fp[y])) for y in hit]
                stack += hit.tolist()
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int, most: int | None = None) -> Iterator[tuple[tuple, int | None, list[np.ndarray]]]:
    """(key, part, columns) of runs of equal keys (the first columns) in sorted batches, across batch borders. A run of up to
    `most` rows is whole and its part null; a longer one comes in numbered parts of `most` rows, while it is read."""
    held: list[list[np.ndarray]] = []
    last, size, part = None, 0, None

    def out() -> tuple:
        return last, part, [np.concatenate(x) for x in zip(*held, strict=True)]

    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(cols[0]):
            continue
        cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:keys]])) + 1
        edges = [0, *cut.tolist(), len(cols[0])]
        for a, z in zip(edges, edges[1:], strict=False):
            key = tuple(int(c[a]) for c in cols[:keys])
            if key != last:
                if held:
                    yield out()
                held, last, size, part = [], key, 0, None
            while most and size + z - a > most:
                room = most - size
                held.append([c[a : a + room] for c in cols[keys:]])
                part = 0 if part is None else part
                yield out()
                held, size, a, part = [], 0, a + room, part + 1
            if z > a:
                held.append([c[a:z] for c in cols[keys:]])
                size += z - a
    if held:
        yield out()


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b) links between the distinct values of column fp that keep every component of 'differ in at
    most 3 bits' connected."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            fp = b.column(0).to_numpy(zero_copy_only=False)
            row, key, home = anchors(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(home)], ["anchor", "fp", "home"])

    def linked(found: list[tuple[int, int]]) -> pa.RecordBatch:
        n = len(found)
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64())], names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for (anchor,), part, (fp, home) in _groups(batches, 1, block):
            if part is not None:
                n = len(fp)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, anchor)), pa.array(fp), pa.array(home), pa.array(np.full(n, part))], names)
            elif len(fp) > 1 and home.any():
                found += _spanning(fp, home)
            if len(found) >= 50_000:
                yield linked(found)
                found = []
        yield linked(found)

    names = ["a", "b", "home", "block"]
    entries = mapped(fps.where("fp is not null").select("fp").distinct(), spread, "anchor long, fp long, home boolean")
    sorted_ = entries.repartition(F.col("anchor")).sortWithinPartitions("anchor")
    first = gathered(mapped(sorted_, compare, "a long, b long, home boolean, block long"))
    near = first.where("block is null").select("a", "b")
    large = first.where("block is not null").select(F.col("a").alias("anchor"), F.col("b").alias("fp"), "home", "block")
    last = large.groupBy("anchor").agg(F.max("block").alias("most"))
    pairs = (
        large.join(last, "anchor")
        .withColumn("other", F.explode(F.expr("sequence(0L, most)")))
        .select("anchor", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", "home", (F.col("block") <= F.col("other")).alias("first"))
    )

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), _part, (fp, home, left) in _groups(batches, 3):
            found = _spanning(fp, home, None if i == j else left)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"]
            )

    dealt = pairs.repartition(F.col("anchor"), F.col("i"), F.col("j")).sortWithinPartitions("anchor", "i", "j")
    return near.union(mapped(dealt, between, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): one row per row of docs; component is the least id reachable over fingerprints
    that differ in at most 3 bits.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows that share an id keep one
    row each; a null id is never a component's name unless all its members' ids are null. An empty table
    gives no rows, and further columns of docs are not read."""
    base = gathered(fingerprints(docs, id_col, text_col))
    classes = base.groupBy("fp").agg(F.min("id").alias("least"))
    root = components(links(base))
    joined = classes.join(root, classes.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = joined.join(joined.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component")
    return base.join(named, "fp").select("id", "fp", "component").coalesce(tasks(base.count()))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which one document of each near-duplicate group stays: the one with the least
    id. Of rows that repeat that id, the least by text stays. Rows whose id is null stay.

    The ids that go, and those that more than one row has, are written first. Texts are shuffled only if those ids are too many
    to be sent, apart from the rows of repeated ids."""
    found = near_duplicates(docs, id_col, text_col).where("id is not null")
    judged = found.groupBy("id").agg(F.max(F.col("id") == F.col("component")).alias("stays"), F.count("*").alias("n"))
    odd = written(judged.where("not stays or n > 1").coalesce(tasks(found.count())))
    key = F.col(id_col).cast("long")
    once = without(docs, key, odd.select("id"))
    repeated = odd.where("stays").select(F.col("id").alias("__keep"))
    if not repeated.limit(1).count():
        return once
    row = F.min_by(F.struct(*(F.col(c) for c in docs.columns)), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    several = docs.join(repeated, key == F.col("__keep"), "left_semi").groupBy(key.alias("__id")).agg(row.alias("__row"))
    return once.unionByName(several.select("__row.*"))
