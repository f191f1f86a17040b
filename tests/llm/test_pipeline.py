import random

import numpy as np
import pytest

from quaestor.llm import bpe, decontaminate, quality, simhash
from quaestor.llm.queries import QUERIES, TOKENIZER

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(rnd):
    vocabulary = ["".join(rnd.choice(["an", "er", "th", "in", "on", "re"]) for _ in range(rnd.randint(1, 4))) for _ in range(400)]

    def prose(n):
        return " ".join(" ".join(rnd.choice(vocabulary) for _ in range(9)).capitalize() + "." for _ in range(n))

    items = [(i, prose(3)) for i in range(5)]
    texts = [prose(rnd.randint(3, 12)) for _ in range(60)]
    texts += [texts[0], texts[0], texts[1].upper().replace(" ", "!! "), " | ".join(texts[2].split()), texts[3] + " " + items[2][1] + " " + prose(4)]
    texts += ["mail me at some.one@example.org or 4539578763621486. " + prose(5), None, ""]
    rows = [(i * 2, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return rows, items


def test_pipeline_matches_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows, items = corpus(random.Random(5))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "pii", "bpe"]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    w = quality.train(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    kept = [r for r in rows if r[1] and 1 / (1 + np.exp(-(quality.features(r[1]) @ w[:-1] + w[-1]))) >= 0.5]
    assert {r[0] for r in rows} - {r[0] for r in kept} == {124, 126, 132, 134}
    alone = {}
    for r in kept:  # the least id of each component
        f = simhash.fingerprint(r[1])
        hits = {k for k, v in alone.items() if any(bin(f ^ g).count("1") <= 3 for g in v)}
        merged = [f] + [g for k in hits for g in alone.pop(k)]
        alone[min([r[0], *hits])] = merged
    clean = []
    for r in kept:
        if r[0] in alone:
            have = set(decontaminate.shingles(decontaminate.words(r[1])))
            if not any(len(have & set(s)) >= 0.8 * len(set(s)) for s in (decontaminate.shingles(decontaminate.words(t)) for _, t in items)):
                clean.append(r)
    assert set(got) == {r[0] for r in clean}
    lib = Tokenizer.from_file(TOKENIZER)
    for i, text, *_ in clean:
        ids = list(got[i].ids)
        assert got[i].n_tokens == len(ids) and got[i].decoded == lib.decode(ids, skip_special_tokens=False)
        if "@" not in (text or ""):
            assert ids == lib.encode(text or "", add_special_tokens=False).ids
        else:
            assert "some" not in got[i].decoded.split("@")[0] and "4539578763621486" not in got[i].decoded.replace(" ", "")


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_and_take_empty_tables(spark, sf, stage):
    import corpus_pipeline

    empty = spark.createDataFrame([], COLUMNS)
    assert corpus_pipeline.STAGES[stage][1](spark, empty, sf).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[stage][1](spark, empty, sf).count() == 0


def test_bpe_round_trip(spark):
    from tokenizers import Tokenizer

    texts = [None, "", " \t\n", "Hello WORLD don't", "İΣς ﬁ é́ 12½ 😀👍🏽 日本", "a<|endoftext|>b", "x" * 30000, "the the\x00the", "\u200b\u0085\x1c"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "no id", "x"), (1, "", "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    lib = Tokenizer.from_file(TOKENIZER)
    for words in (1, 1 << 21):
        got = bpe.encode(df, TOKENIZER, words=words).collect()
        assert len(got) == len(rows)
        want = sorted((str(i), lib.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows)
        assert sorted((str(r.id), list(r.ids)) for r in got) == want
        assert all(r.decoded == lib.decode(list(r.ids), skip_special_tokens=False) for r in got)
    assert bpe.digests(df.limit(0), TOKENIZER).count() == 0


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5000):
        v = rng.integers(0, 1 << rng.integers(1, 28, n)) if n else np.zeros(0, np.int64)
        data, end = bpe.pack(v)
        back, at = bpe.unpack(data)
        assert (back == v).all() and (at == end).all()


def test_every_distinct_word_is_encoded_once(spark, monkeypatch):
    texts = [" ".join(f"word{(i * k) % 97}" for k in range(200)) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    config = bpe.read_config(TOKENIZER)
    chunks = bpe._split(df, config, "doc_id", "text", 500)
    assert chunks.select("chunk").distinct().count() > 8
    plan = bpe.encode(df, TOKENIZER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(word") >= 1 and "numbers" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    answers = bpe._encoded(chunks, config).collect()
    asked = chunks.where("words is not null").selectExpr("chunk", "explode(words) as w").count()
    assert sum(int(bpe.unpack(np.frombuffer(r.answers, np.uint8))[0][0]) for r in answers) == asked


def test_digests_of_the_table(spark, sf):
    import hashlib

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(TOKENIZER)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op5_bpe"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = lib.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
