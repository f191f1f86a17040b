"""Largest inner products by multiprobe p-stable hashing.

Vectors are scaled by the largest norm and given one more coordinate, so that the largest inner product is the least
distance. Each of `TABLES` tables hashes a vector by `k` projections on orthogonal Gaussian directions, cut into slots of width
`SLOT`. A query visits its own bucket and then perturbed buckets (each slot moved by -1, 0 or 1) in order
of estimated success: the sum of squared distances from the query to the moved slots' borders. Candidates
of all tables are ranked by their exact inner products in double precision.

How many buckets to visit is fitted on a bounded sample (at most `SAMPLE` vectors, by a hash): the fewest that
find the wanted share of neighbours there, where as many neighbours are asked for as the sample holds of
the true ones, so that they are as far away as in the whole table. Where all moves together don't find that share, as
with very unequal norms, every query is compared with all vectors; so is a query whose buckets hold too few. Every
vector is indexed.

Equal vectors are one entry with its least ids, as many as can ever be asked for. Buckets over `ROWS` entries are
split by a hash of the entry, and buckets are dealt into shards of about `ROWS` entries. An entry goes to its shard once for each
table, and a query only to the shards that hold a bucket it visits; a shard that more than `ASKING` queries visit is
copied for each further `ASKING` of them. There queries and vectors meet as matrix products, and a query's best few of each shard go on.
Vectors travel in the precision they came in."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.llm.common import least_hashed, mapped, written

TABLES = 2
SLOT = 2.0
SAMPLE = 4096
ASKED = 256
SHARE = 0.96
ROWS = 32768
ASKING = 32768
SEED = 5


class Hasher:
    """The tables' projections for vectors of `size` coordinates; visits=None: one bucket holds all."""

    def __init__(self, size: int, k: int, norm: float, visits: int | None):
        rng = np.random.default_rng(SEED)
        self.k, self.norm, self.visits = min(k, size + 1), norm, visits
        self.a = [np.linalg.qr(rng.normal(size=(size + 1, self.k)))[0] * np.sqrt(size) for _ in range(TABLES)]
        self.b = [rng.random(self.k) * SLOT for _ in range(TABLES)]
        self.moves = np.array(list(itertools.product((-1, 0, 1), repeat=self.k)), np.int64)
        self.place = 1009 ** np.arange(self.k, dtype=np.int64)

    def _slots(self, x: np.ndarray, table: int, query: bool) -> np.ndarray:
        if query:
            x = np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))])
        else:
            x = x / self.norm
            x = np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))])
        return (x @ self.a[table] + self.b[table]) / SLOT

    def _code(self, slots: np.ndarray, table: int) -> np.ndarray:
        return (slots + 500) @ self.place * TABLES + table

    def index(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table, as [vector, table]."""
        if self.visits is None:
            return np.zeros((len(x), 1), np.int64)
        return np.stack([self._code(np.floor(self._slots(x, t, False)).astype(np.int64), t) for t in range(TABLES)], 1)

    def probe(self, x: np.ndarray, visits: int | None = None) -> np.ndarray:
        """The buckets that each query visits in each table, the likeliest first, as [query, table, visit]."""
        if self.visits is None:
            return np.zeros((len(x), 1, 1), np.int64)
        out = []
        for t in range(TABLES):
            f = self._slots(x, t, True)
            own = np.floor(f).astype(np.int64)
            inside = f - own
            cost = np.zeros((len(x), len(self.moves)))
            for i in range(self.k):
                move = self.moves[:, i]
                far = np.where(move < 0, inside[:, i : i + 1], 1 - inside[:, i : i + 1])
                cost += np.where(move == 0, 0, far * far)
            first = np.argsort(cost, axis=1, kind="stable")[:, : visits or self.visits]
            out.append(self._code(own[:, None, :] + self.moves[first], t))
        return np.stack(out, 1)


def _fit(sample: np.ndarray, size: int, total: int, norm: float, near: int) -> Hasher:
    """A hasher that visits as few buckets as find SHARE of the neighbours within the sample; one bucket if no number does."""
    k = int(np.clip(round(np.log2(max(total, 2)) / 2.8), 6, 8))
    if total <= SAMPLE:
        return Hasher(size, k, norm, None)
    h = Hasher(size, k, norm, 1)
    queries = sample[: min(ASKED, len(sample))]
    score = queries @ sample.T
    score[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    wanted = max(1, round(near * len(sample) / total))
    best = np.argsort(-score, axis=1)[:, :wanted]
    index, probes = h.index(sample), h.probe(queries, len(h.moves))
    need = np.full(best.shape, len(h.moves))  # the visit that finds each neighbour
    for q in range(len(queries)):
        for t in range(TABLES):
            visit = {int(b): i for i, b in enumerate(probes[q, t])}
            need[q] = np.minimum(need[q], [visit.get(int(b), len(h.moves)) for b in index[best[q], t]])
    most = int(np.quantile(need, SHARE, method="higher"))
    h.visits = most + 1 if most < len(h.moves) else None
    return h


def _best(scores: np.ndarray, keys: np.ndarray, most: int) -> np.ndarray:
    """Where the `most` largest finite scores are, the least keys first among equals."""
    at = np.flatnonzero(scores > -np.inf)
    if len(at) > most:
        at = at[scores[at] >= np.partition(scores[at], len(at) - most)[len(at) - most]]
    return at[np.lexsort((keys[at], -scores[at]))][:most]


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) with an id and a vector that isn't null, empty or zero and has only finite components, as 32-bit numbers
    if it came so, else as doubles."""
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    v = F.transform(F.col(vector_col).cast(f"array<{kind}>"), lambda x: x + F.lit(0.0).cast(kind))  # no negative zeros
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def _length(rows: DataFrame) -> int:
    """The length that most vectors have, the greater of equally common ones; 1 if there are none."""
    found = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return found.size if found else 1


def _same(v: Column) -> Column:
    """128 bits of a vector, by which queries find the entry that is equal to theirs."""
    return F.struct(F.xxhash64(v).alias("a"), F.xxhash64(F.lit("second"), v).alias("b"))


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", near: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the `near` largest inner products found, its own row apart.

    is_query: a condition on the column vec_id. Inner products need vectors of one length, so that those of another
    length than most take no part; nor do those that are null, zero or not finite. Ties go to the smaller id. Rows that
    repeat an id and vector are one. An empty table gives no rows, and further columns aren't read."""
    rows = valid(vectors, id_col, vector_col)
    size = _length(rows)
    rows = rows.where(F.size("v") == size)
    place = Window.partitionBy("v").orderBy("vec_id")
    first = rows.withColumn("__at", F.dense_rank().over(place)).where(F.col("__at") <= near + 1)
    classes = written(
        first.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("key"), "ids", "v")
    )
    equal = classes.select(_same(F.col("v")).alias("same"), "key")
    asked = written(rows.where(is_query).select("vec_id", _same(F.col("v")).alias("same")).join(equal, "same").select(F.col("vec_id").alias("query_id"), "key").distinct())
    squares = F.aggregate(F.transform("v", lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x)
    total, longest = classes.agg(F.count("*"), F.max(squares)).first()
    taken = np.zeros((0, size))
    if total > SAMPLE:
        hashed = classes.select("key", "v", F.xxhash64("key").alias("hash"))
        sample = hashed.where(F.col("hash") <= F.lit(least_hashed(hashed, SAMPLE, total))).toArrow()
        order = np.argsort(sample.column("key").to_numpy())
        taken = np.array(sample.column("v").to_pylist(), float)[order]
    hasher = _fit(taken, size, total, float(np.sqrt(longest or 1)), near)
    queries = written(asked.select("key").distinct().join(classes.select("key", "v"), "key"))
    found = _searched(classes, queries, hasher, size, total, near + 1)
    if hasher.visits is not None:
        found = written(found)
        counts = found.groupBy("query").agg(F.count_distinct("key").alias("n")).where(F.col("n") >= min(near + 1, total))
        few = written(queries.join(counts, queries.key == counts.query, "left_anti"))
        if few.limit(1).count():
            found = found.union(_searched(classes, few, Hasher(size, hasher.k, hasher.norm, None), size, total, near + 1))
    most = near + 1
    best = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    merged = found.groupBy("query", "key").agg(F.max("score").alias("score")).withColumn("__at", F.row_number().over(best)).where(F.col("__at") <= most)
    every = merged.join(classes.select("key", "ids"), "key").select("query", "score", F.explode("ids").alias("vec_id")).distinct()
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    short = every.withColumn("__at", F.row_number().over(best)).where(F.col("__at") <= most).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("__at", "vec_id", "score"))).alias("list"))
    mine = asked.join(short, asked.key == short.query)
    kept = F.slice(F.filter("list", lambda r: r.vec_id != F.col("query_id")), 1, near)
    return mine.select("query_id", F.posexplode(kept).alias("p", "r")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("r.vec_id").alias("vec_id"), F.col("r.score").alias("score")
    )


def _searched(classes: DataFrame, queries: DataFrame, hasher: Hasher, size: int, total: int, most: int) -> DataFrame:
    """(query, key, score): the `most` largest inner products of the vectors of each shard with the queries (key, v) that
    visit it."""
    sent = queries.sparkSession.sparkContext.broadcast(hasher)
    kind = np.float32 if classes.schema["v"].dataType.simpleString() == "array<float>" else np.float64

    def vectors(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = vectors(b.column(1))
            buckets = sent.value.index(x.astype(float))
            rows = pa.array(np.repeat(np.arange(len(x)), buckets.shape[1]))
            raw = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array(buckets.ravel()), raw.take(rows)], ["key", "bucket", "raw"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                buckets = sent.value.probe(vectors(s.column(1)).astype(float))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(s.column(0).to_numpy(), buckets[0].size)), pa.array(buckets.ravel())], ["query", "bucket"])

    tables = 1 if hasher.visits is None else TABLES
    shards = max(1, tables * total // ROWS, min(16, total // 1024))
    shard = F.pmod(F.xxhash64("bucket", "sub"), F.lit(shards))
    entries = mapped(classes.select("key", "v"), index, "key long, bucket long, raw binary")
    sizes = written(entries.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.ceil(F.col("n") / ROWS).cast("long").alias("splits")))
    large = sizes.where("splits > 1")  # at most tables * total / ROWS buckets

    visits = mapped(queries.select("key", "v"), probe, "query long, bucket long").join(sizes, "bucket")
    visits = visits.withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1))).select("query", "bucket", shard.alias("shard"))
    visits = written(visits.groupBy("query", "shard").agg(F.collect_set("bucket").alias("buckets")))
    copies = visits.groupBy("shard").agg(F.ceil(F.count("*") / ASKING).cast("long").alias("copies"))  # a row a shard

    visits = visits.join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("query"), F.col("copies")))
    raw = queries.select(F.col("key").alias("query"), "v")
    visits = visits.join(raw, "query").select("shard", "copy", "query", "buckets", "v")
    entries = entries.join(large, "bucket", "left").withColumn("sub", F.pmod(F.xxhash64("key"), F.coalesce("splits", F.lit(1).cast("long"))))
    entries = entries.select("key", "bucket", "raw", shard.alias("shard")).join(copies, "shard")
    entries = entries.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), "key", "bucket", "raw")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            keys, buckets = left.column("key").to_numpy(), left.column("bucket").to_numpy()
            x = np.frombuffer(b"".join(left.column("raw").to_pylist()), kind).reshape(-1, size).astype(float)
            names, inverse = np.unique(buckets, return_inverse=True)
            for b in right.to_batches(64):
                q, asking = vectors(b.column(b.schema.names.index("v"))).astype(float), b.column(b.schema.names.index("query")).to_pylist()
                wanted = np.zeros((len(q), len(names)), bool)
                for i, mine in enumerate(b.column(b.schema.names.index("buckets")).to_pylist()):
                    at = np.minimum(np.searchsorted(names, mine), len(names) - 1)
                    wanted[i, at[names[at] == mine]] = True
                rough = q @ x.T
                slack = 1e-9 * (1 + np.abs(rough).max())
                rough[~wanted[:, inverse]] = -np.inf
                for i, r in enumerate(rough):  # exact, and the same in every shard
                    at = np.flatnonzero(r > -np.inf)
                    if len(at) > most:
                        at = at[r[at] >= np.partition(r[at], len(at) - most)[len(at) - most] - slack]
                    score = (x[at] * q[i]).sum(1)
                    best = _best(score, keys[at], most)
                    out += zip(itertools.repeat(asking[i]), keys[at[best]].tolist(), score[best].tolist(), strict=False)
        return pa.table({"query": pa.array([o[0] for o in out], pa.int64()), "key": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.float64())})

    met = entries.groupBy("shard", "copy").cogroup(visits.groupBy("shard", "copy"))
    return met.applyInArrow(search, "query long, key long, score double")
