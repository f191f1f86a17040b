"""Quality classifier from weak labels.

Eight overlapping heuristics vote good, bad or abstain on every document. The votes of all documents are
counted by pattern (at most 3**8 patterns), and expectation-maximisation on these counts estimates each
heuristic's accuracy for good and for bad text. The posterior of its pattern labels a document. A linear
scorer on hashed word shapes learns these soft labels from a bounded sample (`sample` distinct texts, chosen
by a hash of the text) and then scores every document whole. No given label is used.

Nulls: a null text is empty; a text without words has no votes, scores 0 and is not kept. Repeated rows are scored each. An empty table gives no rows. Further columns are not read."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import bounded, least_hashed, mapped, slices

WIDTH = 512
SAMPLE = 8000
THRESHOLD = 0.5
WINDOW = 100

_MARKS = re.compile(r"[^\w\s]{2,}(?=\s|$)")
_LONE = re.compile(r"(?:^|\s)[^\w\s]+(?=\s|$)")
_STOP = re.compile(r"[.!?](?=\s|$)")
_SIGN = re.compile(r"[^\w\s.,;:!?'\"()@+-]")


def _vote(value: float, bad: float, good: float) -> str:
    """Bad at or beyond one bound, good at or before the other, else abstain; the bounds give the direction."""
    if bad > good:
        return "b" if value >= bad else "g" if value <= good else "-"
    return "b" if value <= bad else "g" if value >= good else "-"


def votes(text: str | None) -> str:
    """One character for each heuristic: g(ood), b(ad) or - (abstains)."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return "-" * 8
    lettered = [w for w in words if len(w) > 1 and w.lower() != w.upper()]
    caps = sum(map(str.isupper, lettered)) / len(lettered) if lettered else 0.5
    same = sum(map(eq, words, words[1:])) / n
    spans = [words[i : i + WINDOW] for i in range(0, n, WINDOW)]
    variety = sum(len(set(s)) for s in spans) / n
    stops = len(_STOP.findall(text))
    return "".join(
        (
            _vote(caps, 0.25, 0.08) if lettered else "-",
            _vote(len(_MARKS.findall(text)) / n, 0.15, 0.03),
            _vote(len(_SIGN.findall(text)) / (len(text) + 40), 0.05, 0.02),
            _vote(same, 0.15, 0.04) if n > 3 else "-",
            _vote(variety, 0.35, 0.5) if n >= 20 else "-",
            _vote(len(_LONE.findall(text)) / n, 0.12, 0.03),
            _vote(n / (stops + 1), 120, 60) if n >= 20 else "-",
            _vote(text.count("!") / n, 0.15, 0.03),
        )
    )


def estimate(counts: dict[str, int], rounds: int = 100, strength: float = 0.2) -> tuple[dict[str, float], np.ndarray]:
    """Posterior of 'good' for each pattern, and the estimated probabilities [class, heuristic, vote]
    (class 0 bad, 1 good; votes b, g, -), by expectation-maximisation.

    A kind of bad text is seen by some heuristics and passes the others, while hardly any finds fault with
    good text. A prior with `strength` times as much weight as the documents says so; it also names the classes."""
    if not counts:
        return {}, np.zeros((2, 0, 3))
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    v = np.array([["bg-".index(c) for c in p] for p in patterns])
    one = np.eye(3)[v]
    belief = np.array([[[0.4, 0.4, 0.2]] * v.shape[1], [[0.005, 0.8, 0.195]] * v.shape[1]])
    prior = start = np.array([0.15, 0.85])
    theta = belief
    for _ in range(rounds):
        log = np.log(prior) + np.einsum("pjk,cjk->pc", one, np.log(theta))
        post = np.exp(log - log.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        mass = post * n[:, None]
        weight = strength * n.sum() + 1
        prior = (mass.sum(0) + weight * start) / (n.sum() + weight)
        theta = np.einsum("pc,pjk->cjk", mass, one) + weight * belief
        theta /= theta.sum(2, keepdims=True)
    return dict(zip(patterns, post[:, 1].tolist(), strict=True)), theta


class _Shape(dict):
    """Maps a code point to a letter for its kind; marks stand for themselves."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isnumeric() else " " if c.isspace() else c
        return kind


_shape = _Shape()
_letters = [(re.compile(c + "{2,}"), c) for c in "aA9"]
_marks = re.compile(r"([^aA9\s])\1+")


def features(text: str | None) -> np.ndarray:
    """Shares of hashed word shapes, of words that repeat the one before, and of distinct words in a window."""
    x = np.zeros(WIDTH, np.float32)
    words = (text or "").split()
    if not words:
        return x
    shape = text.translate(_shape)
    for run, one in _letters:
        shape = run.sub(one, shape)
    shapes = _marks.sub(r"\1\1", shape).split()
    for shape, k in Counter(shapes).items():
        x[3 + zlib.crc32(shape.encode("utf-8", "surrogatepass")) % (WIDTH - 3)] += k / len(shapes)
    x[0] = sum(map(eq, words, words[1:])) / len(words)
    x[1] = 1 - sum(len(set(words[i : i + WINDOW])) for i in range(0, len(words), WINDOW)) / len(words)
    x[2] = min(1, 3 / len(words))
    return x


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 0.1, decay: float = 1e-5) -> np.ndarray:
    """Weights and bias of a logistic scorer on soft labels, by Adam on the whole sample."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w = np.zeros(x.shape[1])
    m, s = w.copy(), w.copy()
    good = max((y >= 0.5).sum(), 1)  # a good text lost weighs twice a bad one kept
    balance = np.where(y >= 0.5, 0.67 / good, 0.33 / max(len(y) - good, 1))
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ ((p - y) * balance) + decay * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= rate * m / (1 - 0.9**t) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
    return w


def vote_counts(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """How many documents have each pattern of votes; partitions send counts, not rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in slices(batches):
            seen.update(map(votes, b.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["p", "n"])

    found = mapped(docs.select(F.col(text_col).cast("string").alias("text")), run, "p string, n long")
    return {r.p: r.n for r in found.groupBy("p").agg(F.sum("n").alias("n")).collect()}


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """The scorer's weights: expectation-maximisation over all documents, then a fit on at most `sample` distinct texts,
    those of the least hashes. Any table with a word in it gives at least one."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = vote_counts(texts)
    posterior, _ = estimate(counts)
    hashed = texts.where(F.col("text").rlike(r"\S")).select("text", F.xxhash64("text").alias("hash"))
    last = least_hashed(hashed, sample, sum(counts.values()))
    if last is None:
        return np.zeros(WIDTH + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # of the sample's hashes
        for b in slices(batches):
            new = [(h, t) for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if h not in done and not done.add(h)]
            cols = [pa.array([h for h, _ in new], pa.int64()), pa.array([features(t).tobytes() for _, t in new], pa.binary()), pa.array([posterior.get(votes(t), 0.5) for _, t in new], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["hash", "x", "y"])

    each = mapped(hashed.where(F.col("hash") <= F.lit(last)), run, "hash long, x binary, y double")
    rows = each.groupBy("hash").agg(F.first("x").alias("x"), F.first("y").alias("y")).toArrow()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, WIDTH)
    order = np.argsort(rows.column("hash").to_numpy())  # the order of arrival must not matter
    return fit(x[order], rows.column("y").to_numpy()[order])


def scorer(w: np.ndarray, text: Column) -> Column:
    """The score of a text; only texts go to Python, other columns stay where they are."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            out = []
            for at in range(0, len(t), 256):
                x = np.array([features(s) for s in t.slice(at, 256).to_pylist()], np.float64).reshape(-1, WIDTH)
                out.append(np.where(x.any(1), 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -40, 40))), 0.0))
            yield pa.array(np.concatenate(out) if out else [], pa.float64())

    return F.arrow_udf(run, "double")(text.cast("string"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(id, score, keep) for every row; score near 1: good text; keep: score >= 0.5."""
    w = train(docs, id_col, text_col, sample)
    bounded(docs.sparkSession)
    scores = docs.select(F.col(id_col).cast("long").alias("id"), scorer(w, F.col(text_col)).alias("score"))
    return scores.select("id", "score", (F.col("score") >= THRESHOLD).alias("keep"))


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the scorer keeps, with the columns of docs."""
    w = train(docs, id_col, text_col, sample)
    bounded(docs.sparkSession)
    return docs.where(scorer(w, F.col(text_col)) >= THRESHOLD)
