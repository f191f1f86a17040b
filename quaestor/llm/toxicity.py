"""Toxicity by a weighted lexicon of words and stems.

A text is folded character by character: case, homoglyphs of other scripts, digits and signs that stand
for letters. An Aho-Corasick automaton finds the folded entries in the whole folded text. A match counts
if it begins a word, for a whole word also ends it, and no exception phrase covers it. The weights found, as a sum and
normalised by the number of words, give the score through a logistic function.

Entries are learned from a bounded sample (`sample` labelled rows, by a hash of the id) of the labels given
for learning: beginnings of words (and whole words) with enough toxic texts, log-odds and significance, and
with varied neighbours, so that words of one much copied text don't qualify. Of entries that begin alike the
most significant stays, the longest of equals. Words of the starting list have a prior and stay.

Nulls: a null or empty text has no matches and gets the score of none. Repeated rows are scored each; of
several labels of an id the toxic one counts, null labels don't. Without labels, the priors decide. An empty table gives
no rows, and further columns aren't read."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import least_hashed, mapped, slices, written

SAMPLE = 12_000
SUPPORT = 5
ODDS = 1.8
EVIDENCE = 20.0
SHORTEST, LONGEST = 3, 14
HELD = 100_000
THRESHOLD = 0.7
PRIOR = 3.0

# The starting lexicon.
START = (
    "idiot idiots moron morons stupid scum trash loser losers clown pathetic worthless disgusting imbecile "
    "dumb dumbass jerk bastard bitch crap shit shitty fuck fucking asshole retard freak vermin filth "
    "creep garbage pig dimwit halfwit nitwit cretin "
    "dummkopf trottel arschloch abschaum idiota estupido imbecil basura gilipollas connard salaud ordure"
).split()
# Phrases that excuse the words in them.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "take out the trash", "class clown", "clown fish", "circus clown",
    "idiot proof", "pond scum", "soap scum", "garbage collector", "garbage collection", "garbage can", "guinea pig",
    "not stupid", "not worthless", "pig iron",
)
# Characters that stand for a letter; l, 1, ! and | count as i.
ALIKE = {
    "a": "4@аα", "b": "8вβ", "c": "сϲ", "d": "ԁ", "e": "3еєε€",
    "g": "9ɡ", "h": "һн", "i": "1!|lіıιӏ", "j": "ј", "k": "кκ", "m": "м",
    "n": "η", "o": "0оο", "p": "рρ", "q": "ԛ", "s": "5$ѕ", "t": "7тτ",
    "u": "υ", "v": "ν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "2",
}

_alike = {c: k for k, cs in ALIKE.items() for c in cs}


class _Fold(dict):
    """Code point to the one character that it folds to."""

    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        c = c[0] if c else chr(code)
        self[code] = out = _alike.get(c, " " if c.isspace() else c)
        return out


_fold = _Fold()
_letters = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """The folded text; each character stays in its place."""
    return text.translate(_fold)


def automaton(weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS) -> ahocorasick.Automaton:
    """Matches folded entries (with weight; one that ends in a space is a whole word) and exception phrases (None)."""
    found: dict[str, list] = {}
    for entry, weight in weights.items():
        found.setdefault(entry.rstrip(" "), []).append((weight, entry.endswith(" ")))
    for phrase in exceptions:
        found.setdefault(fold(phrase), []).append((None, True))
    out = ahocorasick.Automaton()
    for w, kinds in found.items():
        out.add_word(w, (len(w), kinds))
    if len(out):
        out.make_automaton()
    return out


def matches(text: str | None, words: ahocorasick.Automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the lexicon's entries in a text, without excused ones; of those that begin at
    one place the heaviest."""
    if not text or not len(words):
        return []
    hits: dict[int, tuple[int, int, float]] = {}
    excused = []
    for last, (size, kinds) in words.iter(fold(text)):
        start, end = last + 1 - size, last + 1
        if start and text[start - 1].isalnum():
            continue
        inside = end < len(text) and text[end].isalnum()
        for weight, whole in kinds:
            if whole and inside:
                continue
            if weight is None:
                excused.append((start, end))
            elif start not in hits or weight > hits[start][2]:
                hits[start] = (start, end, weight)
    return [h for h in hits.values() if not any(a <= h[0] and h[1] <= z for a, z in excused)]


def measures(text: str | None, words: ahocorasick.Automaton) -> tuple[float, float]:
    """The sum of matched weights and that sum for 100 words, both as log(1 + x)."""
    total = sum(max(0.0, w) for _, _, w in matches(text, words))
    return (float(np.log1p(total)), float(np.log1p(100 * total / max(1, len(text.split()))))) if total else (0.0, 0.0)


def _odds(pos: float, neg: float, toxic: int, other: int) -> float:
    return float(np.log((pos + 0.5) / (toxic + 1)) - np.log((neg + 0.5) / (other + 1)))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of the rows of at most `sample` labelled ids, those of the least hashes, written; labels has (id, toxic).
    All rows that share an id count."""
    known = labels.where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = written(known.select("id", "toxic", F.xxhash64(F.col("id").cast("string")).alias("hash")))
    last = least_hashed(known, sample, known.count())
    bounded = known.where(F.col("hash") <= F.lit(last)).select("id", "toxic") if last is not None else known.limit(0).select("id", "toxic")
    return written(docs.join(F.broadcast(bounded), "id").select("text", F.col("toxic").cast("int").alias("toxic")))


def _beginnings(text: str | None) -> dict[str, int]:
    """The distinct beginnings of the words of a text, whole words with a space, each with a bit for every
    pair of neighbours (by a hash) that it has."""
    tokens = [fold(w) for w in _letters.findall(text or "")]
    around = ["", *tokens, ""]
    out: dict[str, int] = {}
    for k, w in enumerate(tokens):
        if len(w) >= SHORTEST:
            spot = 1 << (zlib.crc32(f"{around[k]} {around[k + 2]}".encode("utf-8", "surrogatepass")) & 63)
            for n in range(SHORTEST, min(len(w), LONGEST) + 1):
                out[w[:n]] = out.get(w[:n], 0) | spot
            if len(w) <= 2 * LONGEST:
                out[w + " "] = out.get(w + " ", 0) | spot
    return out


def _sums(rows: DataFrame, only: frozenset | None = None) -> DataFrame:
    """(entry, n, spots): in how many texts each beginning occurs, with how varied neighbours; only: those asked for."""
    sent = rows.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = sent.value, {}

        def out() -> pa.RecordBatch:
            signed = [m - (1 << 64) if m >> 63 else m for _, m in seen.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([n for n, _ in seen.values()], pa.int64()), pa.array(signed, pa.int64())], ["entry", "n", "mask"])

        for b in slices(batches):
            for text in b.column(0).to_pylist():
                mine = _beginnings(text)
                for e in mine.keys() & wanted if wanted is not None else mine:
                    n, mask = seen.get(e, (0, 0))
                    seen[e] = (n + 1, mask | mine[e])
            if len(seen) > HELD:
                yield out()
                seen = {}
        yield out()

    found = mapped(rows.select("text"), run, "entry string, n long, mask long")
    return found.groupBy("entry").agg(F.sum("n").alias("n"), F.bit_count(F.bit_or("mask")).alias("spots"))


def learn(rows: DataFrame, support: int = SUPPORT, odds: float = ODDS) -> tuple[dict[str, float], np.ndarray]:
    """The lexicon's weights (a whole word ends in a space) and the logistic coefficients (bias, sum,
    density) from (text, toxic)."""
    sizes = {bool(r.toxic): r["count"] for r in rows.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    toxic, other = sizes.get(True, 0), sizes.get(False, 0)
    start = sorted({fold(w) + " " for w in START})
    weights = dict.fromkeys(start, PRIOR)
    if toxic and other:
        least = max(support, toxic // 100)
        spread = F.col("spots") >= 0.4 * F.least("n", F.lit(40))
        common = _sums(rows.where("toxic > 0")).where(F.col("entry").isin(*start) | ((F.col("n") >= least) & spread))
        pos = {r.entry: r.n for r in common.collect()}  # of a bounded sample, in a hundredth of its toxic texts at least
        neg = {r.entry: r.n for r in _sums(rows.where("toxic = 0"), frozenset(pos)).collect()}
        ranked = []
        for entry, p in pos.items():
            n = neg.get(entry, 0)
            value = _odds(p, n, toxic, other)
            if entry in weights:  # the prior counts as much as two texts
                weights[entry] = (2 * PRIOR + (p + n) * value) / (2 + p + n)
            elif value >= odds:
                share, all_ = toxic / (toxic + other), p + n
                evidence = 2 * (p * np.log(p / (all_ * share)) + (n * np.log(n / (all_ * (1 - share))) if n else 0))
                if evidence >= EVIDENCE:
                    ranked.append((-evidence, -len(entry), entry, value))
        chosen: set[str] = set()
        begun: set[str] = set()  # the beginnings of the chosen
        for _, _, entry, value in sorted(ranked):
            beginnings = [entry[:n] for n in range(1, len(entry) + 1)]
            if entry not in begun and not chosen.intersection(beginnings):
                chosen.add(entry)
                begun.update(beginnings)
                weights[entry] = value
    weights = {w: round(float(v), 6) for w, v in weights.items() if v > 0}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton(weights)
        for b in slices(batches):
            x = np.array([measures(t, words) for t in b.column(0).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].round(2)), pa.array(x[:, 1].round(2)), b.column(1)], ["a", "b", "y"])

    cells = mapped(rows.select("text", "toxic"), measure, "a double, b double, y int").groupBy("a", "b", (F.col("y") > 0).cast("int").alias("y")).count()
    got = cells.orderBy("a", "b", "y").toArrow()  # a table of at most some hundred steps each way
    a, b, y, n = (got.column(c).to_numpy().astype(float) for c in ("a", "b", "y", "count"))
    return weights, _logistic(np.column_stack([a, b]), y, n)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 60, decay: float = 0.02) -> np.ndarray:
    """Newton's method from, and held by a prior at, coefficients for weights of a few units. n: how often a row stands."""
    prior = np.array([-4.0, 2.0, 1.0])
    w = prior.copy()
    if not len(y):
        return w
    x, total = np.column_stack([np.ones(len(x)), x]), n.sum()
    part = n * np.where(y > 0, 0.5 / max(1, (n * y).sum()), 0.5 / max(1, (n * (1 - y)).sum())) * total
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((p - y) * part) + decay * total * 0.01 * (w - prior)
        h = (x * (p * (1 - p) * part)[:, None]).T @ x + decay * total * 0.01 * np.eye(3)
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return w


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(id, score, matched, found) for each row of docs; labels holds the rows that may be learned from.
    matched: how many words were found; found: the distinct ones, as written, in order of code points."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic"))
    weights, w = learn(labelled(base, marks, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton(weights)
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            hits = [matches(t, words) for t in texts]
            x = np.array([measures(t, words) if h else (0.0, 0.0) for t, h in zip(texts, hits, strict=True)]).reshape(-1, 2)
            p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
            found = [sorted({t[a:z] for a, z, _ in h}) if h else [] for t, h in zip(texts, hits, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(p, pa.float64()), pa.array(list(map(len, hits)), pa.int32()), pa.array(found, pa.list_(pa.string()))],
                ["id", "score", "matched", "found"],
            )

    return mapped(base, run, "id long, score double, matched int, found array<string>")
