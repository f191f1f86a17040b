"""Language-model scoring with a log-bilinear neural model of words.

Tokens are white-space words, A-Z lower-cased, and one end per text. All training texts are counted. The `vectors` most
frequent words have vectors of their own; any other word belongs to one of `TAILS` tail classes by its last bytes,
which has vectors, and takes its share of the class by its smoothed count.

The context of a token is the sum of its two preceding tokens' vectors, each weighted by its position, and of the weighted
mean of the eight before them. Its product with output vectors, plus biases, scores classes (the `ALONE` most frequent words, groups of
words that end alike, and the tails) and then the words of the class: this factorisation is there to normalise exactly.
Noise-contrastive estimation in numpy trains both levels on every token of every training text: in rounds, each on its own share
of the texts, the tasks make steps on all tokens of theirs, and the tasks' vectors are averaged in Spark, each weighted by how often
the task has met it. Nothing is learned from a sample. Batched matrix products over all contexts
give normalised log-probabilities: those of all words and one unknown word a tail sum to one.

The counts of the frequent words, at most `table`, are sent to every task. Other words are summed up per text and shuffled once by
word to meet their counts, and only sums come back to the texts; results don't depend on `table`.

Nulls: a null text is empty; an empty text is scored on its end alone. Repeated rows and null ids are
scored each; a null id is not held out and not learned from. Without training texts all counts are zero."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import mapped, slices, written

TABLE = 1 << 17
VECTORS = 8192
ALONE = 32
GROUP = 128
TAILS = 32
END = b"\n"  # no word holds white space
HELD = 100_000
WIDTH = 16
BACK = 10  # tokens of context
NOISE, INNER = 32, 16  # draws of classes for all tokens of a step, of words for CHUNK of them
CHUNK = 64
BATCH = 8192  # tokens of a step
STEPS = 400  # of small texts, which have smaller steps
TASK = 1 << 19  # tokens that a task should have to learn from
SEEN, TIMES = 8_000_000, 16  # the few tokens of small tables are gone through again, as long as they are no more and so often at most
ROUNDS = (0, 1, 3, 8)  # bounds of the rounds' eighths of the texts
RATE = 0.03
BLOCK = 1 << 14


def words(text: str | None) -> list[bytes]:
    """The words of a text and its end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def tail(word: bytes) -> int:
    """The tail class of a word: by its last two bytes."""
    return zlib.crc32(word[-2:]) % TAILS


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the texts of docs (column text); a task adds up its words before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                seen.update(words(t))
            if len(seen) > HELD:
                yield _counted(seen)
                seen = Counter()
        yield _counted(seen)

    return mapped(docs.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent rows of (word, n), at most `most`: those from the least step of log2(n) / 64 up that
    no more than `most` words reach."""
    step = F.floor(F.log2("n") * 64).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()
    least, total = 64 * 64, 0
    for at, n in sorted(((r.step, r.words) for r in steps), reverse=True):
        if total + n > most:
            break
        least, total = at, total + n
    return counts.where(step >= least)


class _Known(dict):
    """Word to number; -1 for others."""

    def __missing__(self, word: bytes) -> int:
        return -1


class _Units(dict):
    """Word to unit; those of tails are kept till there are too many."""

    _last: tuple = (None, None)

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.words + HELD:
            self.clear()
            self.update(self.unit)
        self[word] = u = self.words + tail(word)
        return u

    @classmethod
    def of(cls, model: Model) -> _Units:
        if cls._last[0] is not model:
            units = cls(model.unit)
            units.unit, units.words = model.unit, len(model.unit)
            cls._last = (model, units)
        return cls._last[1]


@dataclass
class Model:
    """Vectors and what normalises them. Units: words with vectors by number, then the tails; one more is the start.
    Classes: one for each of the first words, then groups, then tails."""

    unit: dict[bytes, int]
    mass: np.ndarray  # of each tail: smoothed counts of its words and of one unknown word
    r: np.ndarray = None  # context vector of each unit and of the start
    c: np.ndarray = None  # weight of the last token, of the one before it, of the mean
    p: np.ndarray = None  # output vector and bias of each class
    a: np.ndarray = None
    q: np.ndarray = None  # output vector and bias of each word within its group
    b: np.ndarray = None
    group: np.ndarray = None  # class of each unit
    members: list[np.ndarray] = field(default_factory=list)  # words of each group
    share: np.ndarray = None  # of each unit in the training tokens
    learned: int = 0  # tokens that steps have been made on, each time counted

    @classmethod
    def start(cls, top: list[tuple[bytes, int]], mass: np.ndarray, seed: int = 7) -> Model:
        """Untrained; the biases give the unigram probabilities. top: the words with vectors, the most frequent first."""
        n = len(top)
        m = cls({w: i for i, (w, _) in enumerate(top)}, mass)
        alone = min(ALONE, n)
        rest = sorted(range(alone, n), key=lambda i: top[i][0][::-1])  # words that end alike stand together
        m.members = [np.array(rest[at : at + GROUP]) for at in range(0, len(rest), GROUP)]
        classes = alone + len(m.members)
        m.group = np.concatenate([np.arange(alone), np.zeros(n - alone, np.int64), classes + np.arange(TAILS)]).astype(np.int64)
        for k, at in enumerate(m.members):
            m.group[at] = alone + k
        weight = np.concatenate([np.array([c for _, c in top], float) + 0.5, mass])
        m.share = weight / weight.sum()
        by_class = np.bincount(m.group, m.share)
        rng = np.random.default_rng(seed)
        m.r, m.c = rng.normal(0, 0.3, (n + TAILS + 1, WIDTH)), np.array([[1.0], [0.7], [1.0]]) * np.ones(WIDTH)
        m.p, m.a = rng.normal(0, 0.1, (len(by_class), WIDTH)), np.log(by_class)
        m.q, m.b = rng.normal(0, 0.1, (n, WIDTH)), np.log(m.share[:n] / by_class[m.group[:n]])
        return m

    @property
    def first_unit(self) -> int:
        """The start's unit."""
        return len(self.unit) + TAILS

    def units(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(_Units.of(self).__getitem__, found), np.int64, len(found))

    def windows(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The units of texts, one after the other with starts before each, and where the texts' tokens are."""
        pad = np.full(BACK, self.first_unit)
        line = np.concatenate([x for t in texts for x in (pad, t)]) if texts else np.zeros(0, np.int64)
        keep = np.concatenate([x for t in texts for x in (np.zeros(BACK, bool), np.ones(len(t), bool))]) if texts else np.zeros(0, bool)
        return line, np.flatnonzero(keep)

    def contexts(self, line: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The context vectors of the places `at` of a line of units, as 32-bit numbers."""
        low = int(at[0]) - BACK
        v = self.r.astype(np.float32)[line[low : int(at[-1])]]
        pairs = v[:-1] + v[1:]
        fours = pairs[:-2] + pairs[2:]
        eights = fours[:-4] + fours[4:]
        at = at - low
        c = self.c.astype(np.float32)
        return c[0] * v[at - 1] + c[1] * v[at - 2] + c[2] / (BACK - 2) * eights[at - BACK]

    def log_probabilities(self, line: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural log P(unit | context) at the places `at`, in order, by matrix products over blocks of contexts."""
        out = np.zeros(len(at))
        p, a, q, b = (x.astype(np.float32) for x in (self.p, self.a, self.q, self.b))
        for s in range(0, len(at), BLOCK):
            mine = at[s : s + BLOCK]
            h, unit = self.contexts(line, mine), line[mine]
            kind = self.group[unit]
            out[s : s + BLOCK] = _log_softmax(h, p, a, kind)
            order = np.argsort(kind, kind="stable")
            cuts = np.searchsorted(kind[order], np.arange(len(self.members) + 1) + min(ALONE, len(self.unit)))
            for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if i < j:
                    rows, within = order[i:j], self.members[k]
                    place = np.searchsorted(within, unit[rows], sorter=(s_ := np.argsort(within)))
                    out[s + rows] += _log_softmax(h[rows], q[within], b[within], s_[place])
        return out


def _log_softmax(h: np.ndarray, vectors: np.ndarray, bias: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The log-probability of the chosen one of all outputs, for each context."""
    score = h @ vectors.T
    score += bias
    mine = score[np.arange(len(h)), chosen].astype(np.float64)
    top = score.max() if len(h) else 0
    if top > 60:  # 32-bit exponentials end at 88
        high = score.max(1, keepdims=True)
        return mine - high[:, 0] - np.log(np.exp(score - high).sum(1, dtype=np.float64))
    np.exp(score, out=score)
    return mine - np.log(score.sum(1, dtype=np.float64))


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))


def _eights(v: np.ndarray) -> np.ndarray:
    """The sum of each eight consecutive rows."""
    pairs = v[:-1] + v[1:]
    fours = pairs[:-2] + pairs[2:]
    return fours[:-4] + fours[4:]


class Trainer:
    """Noise-contrastive steps (Adam) on a model, and how often each row has been met. All tokens of a step are contrasted with the
    same draws of classes, and CHUNK tokens of a group with the same draws of its words, so that matrix products do it."""

    NAMES = ("r", "c", "p", "a", "q", "b")

    def __init__(self, model: Model, seed: int):
        self.m, self.rng, self.t = model, np.random.default_rng(seed), 0
        for k in self.NAMES:
            setattr(model, k, getattr(model, k).astype(np.float32))
        self.mean = {k: np.zeros_like(getattr(model, k)) for k in self.NAMES}
        self.square = {k: np.zeros_like(getattr(model, k)) for k in self.NAMES}
        self.met = {k: np.zeros(len(getattr(model, k))) for k in self.NAMES}
        n = len(model.unit)
        by_class = np.bincount(model.group, model.share)
        self.heap = np.cumsum(by_class)
        inner = model.share[:n] / by_class[model.group[:n]]
        self.log_noise = {"p": np.log(NOISE * by_class).astype(np.float32), "q": np.log(INNER * inner).astype(np.float32)}
        none = [np.zeros(0)]
        self.grouped = np.concatenate([*model.members, *none]).astype(np.int64)
        # group by group, the group's number plus the cumulated shares in it: one search finds a word of a drawn group
        self.within = np.concatenate([model.group[m[0]] + np.cumsum(model.share[m]) / model.share[m].sum() * (1 - 1e-12) for m in model.members] + none)
        order = np.lexsort((np.arange(len(model.group)), model.group))
        self.place = np.empty(len(order) + 1, np.int64)  # of each unit in the order of classes; the start is last
        self.place[np.append(order, len(order))] = np.arange(len(order) + 1)
        if len(self.place) < 1 << 16:
            self.place = self.place.astype(np.uint16)  # sorted by digits

    def step(self, line: np.ndarray, at: np.ndarray) -> None:
        """One step on the tokens at the places `at` of a line of units, in order; BACK units stand before the first."""
        m, size = self.m, len(line)
        g = {k: np.zeros_like(getattr(m, k)) for k in self.NAMES}
        order = np.argsort(self.place[line], kind="stable")
        is_target = np.zeros(size, bool)
        is_target[at] = True
        targets = order[is_target[order]]
        c, eighth = m.c, np.float32(1 / (BACK - 2))
        v = np.take(m.r, line, axis=0)
        far = _eights(v[: size - 3]) * eighth  # of the places from BACK on
        h = np.take(c[0] * v[BACK - 1 : -1] + c[1] * v[BACK - 2 : -2] + c[2] * far, targets - BACK, axis=0)
        unit = line[targets]
        kind = m.group[unit]
        dh = self._told(g, "p", "a", h, kind, len(at))
        noise = np.minimum(np.searchsorted(self.heap, self.rng.random(NOISE)), len(self.heap) - 1)
        dh += self._noise(g, "p", "a", h[None], noise[None], len(at))[0]
        alone = min(ALONE, len(m.unit))
        i, j = np.searchsorted(kind, (alone, alone + len(m.members)))
        if i < j:
            dh[i:j] += self._told(g, "q", "b", h[i:j], unit[i:j], len(at))
            # each group's tokens, in chunks that are filled up with zeros
            starts = _runs(kind[i:j])
            sizes = np.diff(np.append(starts, j - i))
            chunks = -(-sizes // CHUNK)
            first = np.cumsum(chunks) - chunks
            to = np.arange(j - i) + np.repeat(first * CHUNK - starts, sizes)
            filled = np.zeros((chunks.sum() * CHUNK, h.shape[1]), np.float32)
            filled[to] = h[i:j]
            draws = np.repeat(kind[i:j][starts], chunks)[:, None] + self.rng.random((chunks.sum(), INNER))
            noise = self.grouped[np.minimum(np.searchsorted(self.within, draws), len(self.grouped) - 1)]
            back = self._noise(g, "q", "b", filled.reshape(-1, CHUNK, h.shape[1]), noise, len(at))
            dh[i:j] += np.take(back.reshape(filled.shape), to, axis=0)
        full = np.zeros((size + BACK, h.shape[1]), np.float32)
        full[targets] = dh
        mine = full[BACK:size]
        g["c"][0], g["c"][1], g["c"][2] = (np.einsum("ld,ld->d", mine, x) for x in (v[BACK - 1 : -1], v[BACK - 2 : -2], far))
        to_context = c[0] * full[1 : size + 1] + c[1] * full[2 : size + 2] + c[2] * eighth * _eights(full)[3 : size + 3]
        self._summed(g["r"], line[order], np.take(to_context, order, axis=0))
        self.met["r"] += np.bincount(line, minlength=len(m.r))
        self.met["c"] += len(at)
        self.t += 1
        rate = RATE / math.sqrt(1 + self.t / 100)
        for k in self.NAMES:
            mean_, square = self.mean[k], self.square[k]
            mean_ *= 0.9
            mean_ += 0.1 * g[k]
            np.square(g[k], out=g[k])
            square *= 0.99
            square += 0.01 * g[k]
            change = np.sqrt(square)
            change *= 1 / math.sqrt(1 - 0.99**self.t)
            change += 1e-6
            np.divide(mean_, change, out=change)
            change *= rate / (1 - 0.9**self.t)
            getattr(m, k).__isub__(change)

    def _summed(self, g: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Adds the rows to g by their keys, in runs of equal ones."""
        starts = _runs(keys)
        g[keys[starts]] += np.add.reduceat(rows, starts, axis=0)

    def _told(self, g: dict, vectors: str, bias: str, h: np.ndarray, chosen: np.ndarray, batch: int) -> np.ndarray:
        """Adds the gradients of telling the chosen outputs (in runs) from noise; returns that by context."""
        out = np.take(getattr(self.m, vectors), chosen, axis=0)
        score = np.einsum("bd,bd->b", h, out) + (getattr(self.m, bias) - self.log_noise[vectors])[chosen]
        d = np.float32(-1 / batch) / (1 + np.exp(score))
        self._summed(g[vectors], chosen, d[:, None] * h)
        self._summed(g[bias], chosen, d)
        times = np.bincount(chosen, minlength=len(g[bias]))
        self.met[vectors] += times
        self.met[bias] += times
        out *= d[:, None]
        return out

    def _noise(self, g: dict, vectors: str, bias: str, h: np.ndarray, noise: np.ndarray, batch: int) -> np.ndarray:
        """Adds the gradients of telling each chunk's noise from what was chosen; returns that by chunk and context."""
        out = getattr(self.m, vectors)[noise]
        d = h @ out.transpose(0, 2, 1)
        d += (getattr(self.m, bias) - self.log_noise[vectors])[noise][:, None, :]
        np.negative(d, out=d)
        np.exp(d, out=d)  # infinity is well
        d += 1
        np.divide(np.float32(1 / batch), d, out=d)
        if vectors == "q":  # contexts that only fill a chunk up count for nothing
            d *= h.any(2)[:, :, None]
        flat = noise.ravel()
        order = np.argsort(flat, kind="stable")
        self._summed(g[vectors], flat[order], (d.transpose(0, 2, 1) @ h).reshape(len(flat), -1)[order])
        self._summed(g[bias], flat[order], d.sum(1).ravel()[order])
        times = np.bincount(flat, minlength=len(g[bias]))
        self.met[vectors] += times
        self.met[bias] += times
        return d @ out


def _learned(trainer: Trainer, texts: list[np.ndarray], batch: int, times: int, rng: np.random.Generator) -> None:
    """Steps on all tokens of the texts (units), so many times over, in another order each time."""
    with np.errstate(over="ignore"):
        for _ in range(times):
            line, at = trainer.m.windows([texts[i] for i in rng.permutation(len(texts))])
            for mine in np.array_split(at, max(1, round(len(at) / batch))):
                trainer.step(line[mine[0] - BACK : mine[-1] + 1], mine - (mine[0] - BACK))


def _tuned(texts: DataFrame, model: Model, batch: int, times: int) -> Model:
    """The average of what the tasks' models become by steps on all tokens of their own texts."""
    sent = texts.sparkSession.sparkContext.broadcast(model)
    columns = [f"v{i}" for i in range(WIDTH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed = TaskContext.get().partitionId()
        trainer, rng = Trainer(_copied(sent.value), seed), np.random.default_rng((3, seed))
        held, size = [], 0
        for b in slices(batches):
            held += [trainer.m.units(words(t)) for t in b.column(0).to_pylist()]
            size += sum(map(len, held[-b.num_rows :]))
            if size >= 64 * BATCH:
                _learned(trainer, held, batch, times, rng)
                held, size = [], 0
        if size:
            _learned(trainer, held, batch, times, rng)
        for k, name in enumerate(Trainer.NAMES):
            at = np.flatnonzero(trainer.met[name])
            value = getattr(trainer.m, name)[at]
            value = value[:, None] if value.ndim == 1 else value
            weight = trainer.met[name][at]
            cols = [value[:, i] * weight if i < value.shape[1] else np.zeros(len(at)) for i in range(WIDTH)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(weight), *(pa.array(c.astype(np.float32)) for c in cols)], ["part", "row", "weight", *columns])

    schema = "part int, row int, weight double, " + ", ".join(f"{c} float" for c in columns)
    sums = mapped(texts, run, schema).groupBy("part", "row").agg(F.sum("weight").alias("weight"), *(F.sum(c).alias(c) for c in columns)).toArrow()
    out = _copied(model)
    part, row, weight = (sums.column(c).to_numpy() for c in ("part", "row", "weight"))
    values = np.column_stack([sums.column(c).to_numpy() for c in columns]) / weight[:, None]
    for k, name in enumerate(Trainer.NAMES):
        mine = part == k
        x = getattr(out, name)
        x[row[mine]] = np.round(values[mine] if x.ndim > 1 else values[mine, 0], 6)
    out.learned += int(weight[(part == Trainer.NAMES.index("c")) & (row == 0)].sum())
    return out


def _copied(m: Model) -> Model:
    return Model(m.unit, m.mass, *(getattr(m, k).astype(np.float32) for k in Trainer.NAMES), m.group, m.members, m.share, m.learned)


def fit(texts: DataFrame, counts: DataFrame, known: dict[bytes, int], vectors: int = VECTORS) -> Model:
    """The model of texts (column text). counts: (word, n) of all their words; known: the most frequent ones."""
    top = sorted(known.items(), key=lambda x: (-x[1], x[0]))[:vectors]
    ends = F.crc32(F.substring(F.col("word").cast("binary"), -2, 2)) % TAILS
    mass = np.full(TAILS, 0.5)
    for r in counts.groupBy(ends.alias("tail")).agg(F.sum(F.col("n") + 0.5).alias("mass")).collect():
        mass[r.tail] += r.mass
    for w, n in top:
        mass[tail(w)] -= n + 0.5
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return _trained(texts, Model.start(top, mass), total)


def _trained(texts: DataFrame, model: Model, total: int) -> Model:
    """The model after steps on all `total` tokens of the texts. Rounds share out the texts by hash, later ones get more; the
    tasks of a round begin with the average of the round before. Few tokens are gone through by one task, several times."""
    if not total:
        return model
    if total < ROUNDS[-1] * TASK:
        times = max(1, min(TIMES, SEEN // total))
        return _tuned(texts.coalesce(1), model, max(256, min(BATCH, total * times // STEPS)), times)
    share = F.pmod(F.xxhash64("text"), F.lit(ROUNDS[-1]))
    for low, high in zip(ROUNDS, ROUNDS[1:], strict=False):
        tasks = total * (high - low) // ROUNDS[-1] // TASK
        model = _tuned(texts.where((share >= low) & (share < high)).coalesce(tasks), model, BATCH, 1)
    return model


def scored(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", table: int = TABLE, vectors: int = VECTORS, model: Model | None = None) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs; learn says which rows are learned from.

    base_score: the sum of log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens. score: the model's log10
    probability of the text with its end. model: a fitted one, else it is fitted here."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    texts = base.where("learn").select("text")
    counts = written(token_counts(texts))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    rows = frequent(counts, table).toArrow()
    known = dict(zip((w.encode() for w in rows.column("word").to_pylist()), rows.column("n").to_pylist(), strict=True))
    least = min(known.values(), default=1 << 62)
    if model is None:
        if len(known) < vectors:
            known |= {r.word.encode(): r.n for r in counts.orderBy(F.desc("n"), "word").limit(vectors).collect()}
        model = fit(texts, counts, known, vectors)
    log_counts = np.log10(np.array(list(known.values()), float) + 0.5)
    sent = docs.sparkSession.sparkContext.broadcast((_Known(zip(known, range(len(known)), strict=True)), log_counts, model.units(list(known)), model))
    schema = "id long, n_tokens long, n_known long, seen double, model double, rare array<struct<word:string,k:int,tailed:boolean>>"
    rare_type = pa.list_(pa.struct([("word", pa.string()), ("k", pa.int32()), ("tailed", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, log_counts, unit, model = sent.value
        tails, log_mass, types = len(model.unit), np.log10(model.mass), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), rare_type)
        for b in slices(batches):
            found = [words(t) for t in b.column(1).to_pylist()]
            numbers = [np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for ws in found]
            rare = [[ws[i] for i in np.flatnonzero(n < 0).tolist()] for ws, n in zip(found, numbers, strict=True)]
            units = [np.where(n < 0, 0, unit[n]) for n in numbers]
            for n, u, ws in zip(numbers, units, rare, strict=True):
                if ws:
                    u[n < 0] = model.units(ws)
            line, at = model.windows(units)
            each = model.log_probabilities(line, at) / math.log(10)
            kind = line[at]
            in_tail = kind >= tails
            flat = np.concatenate([*numbers, np.zeros(0, np.int64)])
            seen = np.where(flat < 0, 0.0, log_counts[flat])
            each[in_tail] += seen[in_tail] - log_mass[kind[in_tail] - tails]
            starts = np.cumsum([0, *map(len, found)])[:-1]
            sums = (np.add.reduceat(x, starts) for x in (flat >= 0, seen, each))
            asked = [[{"word": w.decode(), "k": k, "tailed": w not in model.unit} for w, k in Counter(ws).items()] for ws in rare]
            cols = (list(map(len, found)), *sums, asked)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(cols, types, strict=True))], ["id", "n_tokens", "n_known", "seen", "model", "rare"])

    parts = written(mapped(base.select("id", "text"), run, schema).withColumn("row", F.monotonically_increasing_id()))
    asked = parts.select("row", F.explode("rare").alias("x")).select("row", "x.*")
    met = asked.join(counts.where(F.col("n") < least), "word")  # words without a count need no answer
    more = F.col("k") * (F.log10(F.col("n") + 0.5) - math.log10(0.5))
    sums = met.groupBy("row").agg(F.sum(more).alias("rest"), F.sum(F.when(F.col("tailed"), more)).alias("tailed"), F.sum("k").alias("more"))
    uncounted = F.aggregate("rare", F.lit(0).cast("long"), lambda a, x: a + x.k)
    tailed = F.aggregate(F.filter("rare", lambda x: x.tailed), F.lit(0).cast("long"), lambda a, x: a + x.k)
    whole = parts.select("*", uncounted.alias("asked"), tailed.alias("asked_tailed")).drop("rare").join(sums, "row", "left").na.fill({"rest": 0.0, "tailed": 0.0, "more": 0})
    every = math.log10(n + 0.5 * (v + 1))
    none = math.log10(0.5)
    return whole.select(
        "id", "n_tokens", (F.col("n_known") + F.col("more")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("seen") + F.col("rest") + F.col("asked") * none - F.col("n_tokens") * every).alias("base_score"),
        (F.col("model") + F.col("tailed") + F.col("asked_tailed") * none).alias("score"),
    )
