import random
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quaestor import shared
from quaestor.llm import common, simhash


def brute(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    ids = [r[0] for r in rows]
    fps = [r[1] for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(rows))]


def test_fingerprint_matches_definition():
    rnd = random.Random(1)
    for t in [None, "", "  ", "A", "a b", "a B c", "a b c d", "é ü x\x0by z", " ".join(rnd.choice("abcdefg") for _ in range(500))]:
        assert simhash.fingerprint(t) == brute(t)


def test_anchor_cover_meets_every_close_pair():
    rnd = np.random.default_rng(2)
    x = rnd.integers(0, 2**63, 300, dtype=np.uint64) * 2 + 1
    for flips in (1, 2, 3):
        y = x.copy()
        for k in range(len(y)):
            for b in rnd.choice(64, flips, replace=False):
                y[k] ^= np.uint64(1) << np.uint64(b)
        fp = np.concatenate([x, y]).view(np.int64)
        row, key, home = simhash.anchors(fp)
        at = [set() for _ in fp]
        homes = [set() for _ in fp]
        for r, k, h in zip(row, key, home):
            at[r].add(int(k))
            if h:
                homes[r].add(int(k))
        assert all(len(h) == 2 for h in homes)
        for k in range(len(x)):
            assert homes[k] & at[k + len(x)]


def fixture(spark):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("alpha beta gamma delta eps zeta eta".split()) for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(90):
        words = base[i % 6].split()
        if i % 4 == 1:
            words[rnd.randrange(60)] = "changed"
        rows.append((i * 3 + 5, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "  "), (7, "ties"), (7, "ties"), (None, "alone here"), (2000, "long " * 30000)]
    return spark.createDataFrame([(a, b, "x", a) for a, b in rows], "doc_id long, text string, fp string, component long"), rows


def test_components_match_brute_force(spark):
    df, rows = fixture(spark)
    got = sorted(((r.id, r.fp % 2**64, r.component) for r in simhash.near_duplicates(df).collect()), key=str)
    fps = [(i, brute(t) if t is None or len(t) < 9000 else simhash.fingerprint(t)) for i, t in rows]
    want = sorted(((i, f, c) for (i, f), c in zip(fps, brute_components(fps))), key=str)
    assert got == want


def test_blocks_of_a_large_anchor_lose_no_link(spark):
    rnd = random.Random(4)
    fps = []
    for _ in range(400):  # a dense ball: many share one anchor
        f = 0x123456789ABCDEF0
        for b in rnd.sample(range(40, 64), 2):
            f ^= 1 << b
        fps.append(f)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    whole = {tuple(sorted(r)) for r in simhash.components(simhash.links(df)).collect()}
    cut = {tuple(sorted(r)) for r in simhash.components(simhash.links(df, block=37)).collect()}
    assert whole == cut and len({r for _, r in simhash.components(simhash.links(df, block=37)).collect()}) >= 1


def test_one_of_each_group_stays(spark):
    df, _ = fixture(spark)
    found = simhash.near_duplicates(df).where("id is not null")
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    assert kept.where("doc_id is not null").count() == found.select("component").distinct().count()
    assert kept.where("doc_id is null").count() == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.deduplicated(df).count() == 0


def test_components_of_a_path(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = simhash.components(edges).collect()
    assert len(got) == 200 and {r.root for r in got} == {1}


def test_links_over_bit_63(spark):
    rnd = random.Random(63)
    pairs = []
    for extra in (0, 1, 2, 3):
        for _ in range(20):
            a = rnd.getrandbits(64)
            pairs.append((a, a ^ sum(1 << b for b in [63, *rnd.sample(range(63), extra)])))
    pairs.append((0, 2**64 - 1))
    signed = np.array(pairs, np.uint64).view(np.int64).tolist()
    near = {frozenset(s) for (a, b), s in zip(pairs, signed) if bin(a ^ b).count("1") <= 3}
    assert len(near) == 60
    for s in signed:
        assert bool(simhash._spanning(np.array(s), np.ones(2, bool))) == (frozenset(s) in near)
    fps = spark.createDataFrame([(x,) for s in signed for x in s], "fp long")
    for block in (simhash.BLOCK, 1):
        assert {frozenset((r.a, r.b)) for r in simhash.links(fps, block).collect()} == near


def files(path):
    return len(list(Path(urlparse(path).path).glob("part-*")))


def test_many_partitions_are_written_as_few_files(spark):
    df, rows = fixture(spark)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    before = len(shared._written)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "30")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = simhash.near_duplicates(df.repartition(30))
        got = sorted(((r.id, r.fp % 2**64, r.component) for r in out.collect()), key=str)
        assert out.rdd.getNumPartitions() == 1
        many = spark.range(60_000).repartition(30).withColumn("task", F.spark_partition_id())
        again = common.gathered(many)
        assert again.select("task").distinct().count() == 30 and again.select("id").distinct().count() == again.count() == 60_000
        assert not many.is_cached
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert max(files(path) for _, path in shared._written[before:]) <= 8
    assert sum(files(path) for _, path in shared._written[before:-1]) <= 12
    fps = [(i, simhash.fingerprint(t)) for i, t in rows]
    assert got == sorted(((i, f, c) for (i, f), c in zip(fps, brute_components(fps))), key=str)
