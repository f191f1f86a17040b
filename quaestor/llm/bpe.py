"""BPE encoding and decoding by a distinct-word table.

Texts are split into words by the tokenizer's own normaliser and splitter, once, in Spark tasks. A chunk is some texts of one
task, of bounded size; in it every text becomes the numbers of its words in the chunk's list of distinct words. Texts and
lists are written as one table, bucketed by chunk. The lists' words (one row for each word and chunk, however often it
occurs) are shuffled and sorted by word, and each distinct word of all texts is encoded once. Its ids go back to the chunks that
asked, packed into one row for each task and chunk, and are joined to the texts by chunk and, within the chunk, by the word's
number at each position. The texts' side of that join is read bucket by bucket and not shuffled. A word that stands in
every text is one row a chunk, so no word's rows are many. Decoding joins the ids with the vocabulary's id -> piece table
where the texts are; that table is as large as the tokenizer's vocabulary and is sent to every task.

Any tokenizer of the tokenizers library whose model works on split words will do: a model without
dropout, no decoder, no post-processing, no truncation or padding. Special tokens in a text are found first, as the library does."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import mapped, place, slices

WORDS = 1 << 21  # of a chunk, unless one text has more
DISTINCT = 1 << 18
TEXTS = 1 << 16
LISTED = 4096  # words in a row of a chunk's list
ANSWERS = 1 << 18  # held before they are packed
LOW = 0x250
_high = re.compile("[^\x00-\u024f]")


class Splitter:
    """Splits texts into special tokens and words, both as strings; a word is what the model encodes alone."""

    def __init__(self, config: str):
        from tokenizers import Tokenizer

        if json.loads(config).get("decoder"):
            raise ValueError("a tokenizer with a decoder: pieces wouldn't be joined by spaces")
        self.tokenizer = Tokenizer.from_str(config)
        self.model = self.tokenizer.model
        special = {t["content"]: t["id"] for t in json.loads(config)["added_tokens"]}
        self.special = special
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self._marks = {s[:2] for s in special}
        self._fast = self._fast_pattern(json.loads(config))

    @staticmethod
    def _fast_pattern(config: dict) -> re.Pattern | None:
        """The splitter's pattern for texts of code points under U+0250, whose classes no Unicode version
        changes, if the normaliser leaves such texts alone but for white space and case; else None."""
        steps = [(n["type"], n.get("pattern"), n.get("content")) for n in (config.get("normalizer") or {}).get("normalizers", [])]
        if steps != [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]:
            return None
        parts = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if [p["type"] for p in parts] != ["Split", "ByteLevel"] or parts[1]["use_regex"] or parts[1]["add_prefix_space"]:
            return None
        if (parts[0]["behavior"], parts[0]["invert"]) != ("Removed", True) or "Regex" not in parts[0]["pattern"]:
            return None
        pattern = parts[0]["pattern"]["Regex"]
        for kind, first in (("\\p{L}", "L"), ("\\p{N}", "N")):
            pattern = pattern.replace(kind, "".join(re.escape(chr(c)) for c in range(LOW) if unicodedata.category(chr(c))[0] == first))
        pattern = pattern.replace("\\s", "\t-\r \x85\xa0")
        return None if "\\p" in pattern else re.compile(pattern)

    def words(self, text: str) -> list[str]:
        """The words in order; a special token stands as itself after a zero character."""
        if self._cut and any(m in text for m in self._marks):
            out = []
            for k, part in enumerate(self._cut.split(text)):
                out += ["\0" + part] if k % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if self._fast and (text.isascii() or not _high.search(text)):
            return self._fast.findall(text.lower())
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        if not normal:
            return []
        return [normal[a:z] for _, (a, z) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def encode(self, word: str) -> list[int]:
        """The ids of one word."""
        if word[0] == "\0" and word[1:] in self.special:
            return [self.special[word[1:]]]
        return [t.id for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(word) for t in self.model.tokenize(w)]

    def pieces(self) -> list[str]:
        """The id -> piece table."""
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        return [self.tokenizer.id_to_token(i) or "" for i in range(size)]


_made: dict[int, Splitter] = {}


def _splitter(config: str) -> Splitter:
    """One splitter for each worker process and tokenizer."""
    if hash(config) not in _made:
        _made.clear()
        _made[hash(config)] = Splitter(config)
    return _made[hash(config)]


def read_config(path: str) -> str:
    """The tokenizer file's JSON; the driver reads it and tasks get it by broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def pack(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers under 2**28 as bytes, seven bits each and the lowest first, the last byte under 128; and where each ends."""
    size = 1 + (v >= 1 << 7).astype(np.int64) + (v >= 1 << 14) + (v >= 1 << 21)
    end = np.cumsum(size)
    start = end - size
    out = np.empty(int(end[-1]) if len(v) else 0, np.uint8)
    for k in range(4):
        at = np.flatnonzero(size > k)
        out[start[at] + k] = (v[at] >> 7 * k & 127) | (size[at] > k + 1).astype(np.int64) << 7
    return out, end


def unpack(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of packed bytes and where each ends."""
    end = np.flatnonzero(data < 128) + 1
    start = np.concatenate([np.zeros(min(1, len(end)), np.int64), end[:-1]])
    v = (data[start] & 127).astype(np.int64)
    for k in range(1, 4):
        at = np.flatnonzero(end - start > k)
        v[at] |= (data[start[at] + k] & 127).astype(np.int64) << 7 * k
    return v, end


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indexes starts[i], starts[i] + 1, ... of every run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Numbers(dict):
    """Word to number, in the order of first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


_SPLIT = "chunk long, id long, numbers binary, first int, words array<string>"
_SPLIT_TYPES = pa.schema([("chunk", pa.int64()), ("id", pa.int64()), ("numbers", pa.binary()), ("first", pa.int32()), ("words", pa.list_(pa.string()))])


class _Chunk:
    """Texts as numbers of their words, and the words."""

    def __init__(self) -> None:
        self.number, self.ids, self.texts, self.size = _Numbers(), [], [], 0

    def add(self, id_: int | None, words: list[str]) -> None:
        self.ids.append(id_)
        self.texts.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def full(self, words: int) -> bool:
        return self.size >= words or len(self.number) >= DISTINCT or len(self.ids) >= TEXTS

    def rows(self, chunk: int) -> Iterator[pa.RecordBatch]:
        """A row for each text, then rows of the list; frequent words have small numbers, which pack well."""
        v = np.concatenate(self.texts)
        order = np.argsort(-np.bincount(v, minlength=len(self.number)), kind="stable")
        place_ = np.empty(len(order), np.int64)
        place_[order] = np.arange(len(order))
        data, end = pack(place_[v])
        last = np.cumsum([len(t) for t in self.texts])
        offsets = np.concatenate([[0], np.concatenate([[0], end])[last]]).astype(np.int32)
        n = len(self.ids)
        packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        yield self._batch(chunk, n, pa.array(self.ids, pa.int64()), packed, None, None)
        names = list(self.number)
        for at in range(0, len(order), 16 * LISTED):
            mine = order[at : at + 16 * LISTED]
            cuts = np.append(np.arange(0, len(mine), LISTED), len(mine)).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(cuts), pa.array([names[i] for i in mine.tolist()], pa.string()))
            yield self._batch(chunk, len(words), None, None, pa.array(cuts[:-1] + at, pa.int32()), words)

    @staticmethod
    def _batch(chunk: int, n: int, *columns) -> pa.RecordBatch:
        cols = [pa.nulls(n, f.type) if c is None else c for c, f in zip(columns, list(_SPLIT_TYPES)[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk, np.int64)), *cols], schema=_SPLIT_TYPES)


def _split(docs: DataFrame, config: str, id_col: str, text_col: str, words: int) -> DataFrame:
    """The chunks of all texts, written once: what comes after must find the same chunks."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _splitter(sent.value).words
        chunk = TaskContext.get().partitionId() << 32
        held = _Chunk()
        for b in slices(batches):
            for id_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.add(id_, split(text) if text else [])
                if held.full(words):
                    yield from held.rows(chunk)
                    held, chunk = _Chunk(), chunk + 1
        if held.ids:
            yield from held.rows(chunk)

    rows = mapped(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, _SPLIT)
    name, buckets = f"quaestor_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.format("parquet").option("compression", "zstd").option("path", place(spark)).bucketBy(buckets, "chunk").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"drop table {name}")  # the name only: the files are in the shared folder, and the frame has found them
    return table


def _encoded(chunks: DataFrame, config: str) -> DataFrame:
    """(chunk, answers): the ids of each chunk's words, every distinct word of all chunks encoded once."""
    sent = chunks.sparkSession.sparkContext.broadcast(config)
    listed = chunks.where("words is not null").select("chunk", "first", F.posexplode("words").alias("at", "word"))
    asked = listed.select("word", "chunk", (F.col("first") + F.col("at")).alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _splitter(sent.value).encode
        last: tuple[str | None, list[int]] = (None, [])  # words are sorted, so only the last one can come again
        held: list[tuple] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column(0).dictionary_encode()
            words = coded.dictionary.to_pylist()
            ids = [last[1] if w == last[0] else encode(w) for w in words]
            last = (words[-1], ids[-1])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))
            at = coded.indices.to_numpy()
            starts = np.cumsum(sizes) - sizes
            held.append((b.column(1).to_numpy(), b.column(2).to_numpy().astype(np.int64), sizes[at], flat[_runs(starts[at], sizes[at])]))
            size += b.num_rows
            if size >= ANSWERS:
                yield _answers(held)
                held, size = [], 0
        yield _answers(held)

    return mapped(asked.repartition("word").sortWithinPartitions("word"), run, "chunk long, answers binary")


def _answers(held: list[tuple]) -> pa.RecordBatch:
    """A row for each chunk: how many words, the steps between their numbers, how many ids each has, the ids."""
    chunks, rows = [], []
    if held:
        chunk, number, sizes, flat = (np.concatenate(x) for x in zip(*held, strict=True))
        starts = np.cumsum(sizes) - sizes
        order = np.lexsort((number, chunk))
        cuts = np.flatnonzero(np.diff(chunk[order])) + 1
        for mine in np.split(order, cuts):
            numbers = [[len(mine)], np.diff(number[mine], prepend=0), sizes[mine], flat[_runs(starts[mine], sizes[mine])]]
            chunks.append(int(chunk[mine[0]]))
            rows.append(pack(np.concatenate(numbers))[0].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(rows, pa.binary())], ["chunk", "answers"])


def _known(answers: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's words by number: where their ids start and how many there are; and the ids."""
    parts = []
    for a in answers:
        v, _ = unpack(np.frombuffer(a, np.uint8))
        n = int(v[0])
        parts.append((np.cumsum(v[1 : n + 1]), v[n + 1 : 2 * n + 1], v[2 * n + 1 :]))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    number, sizes, flat = (np.concatenate(x) for x in zip(*parts, strict=True))
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(number)
    return starts[order], sizes[order], flat


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, ids array<int>, decoded string) for each row; see _coded for the cases."""
    return _coded(docs, path, id_col, text_col, words, digest=False)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of encode()'s rows, made where the ids are."""
    return _coded(docs, path, id_col, text_col, words, digest=True)


def _coded(docs: DataFrame, path: str, id_col: str, text_col: str, words: int, digest: bool) -> DataFrame:
    """Encodes and decodes each whole text. A null text is empty; an empty text has no ids and decodes to
    the empty string. Repeated rows and ids give a row each, null ids too. An empty table gives no rows.
    Further columns are not read."""
    config = read_config(path)
    chunks = _split(docs, config, id_col, text_col, words)
    sent = docs.sparkSession.sparkContext.broadcast(Splitter(config).pieces())
    if digest:
        types = [pa.int64(), pa.string(), pa.string()]
        schema, names = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string", ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
    else:
        types = [pa.list_(pa.int32()), pa.string()]
        schema, names = "id long, ids array<int>, decoded string", ["id", "ids", "decoded"]

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        piece = np.array(sent.value, object)
        starts, sizes, flat = _known(answers.column("answers").to_pylist())
        out: list[list] = [[] for _ in types]
        for b in slices(texts.select(["numbers"]).to_batches()):
            packed = b.column(0).to_pylist()
            v, end = unpack(np.frombuffer(b"".join(packed), np.uint8))
            places = np.searchsorted(end, np.cumsum([0, *map(len, packed)]), side="right")  # words before each text
            ids = flat[_runs(starts[v], sizes[v])]
            cuts = np.concatenate([[0], np.cumsum(sizes[v])])[places].tolist()
            pieces = piece[ids].tolist()
            coded = ids.astype("<u4" if digest else np.int32)
            for a, z in zip(cuts, cuts[1:], strict=False):
                decoded = " ".join(pieces[a:z])
                row = (z - a, hashlib.sha256(coded[a:z].tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()) if digest else (coded[a:z], decoded)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
        return pa.Table.from_arrays([texts.column("id"), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names=names)

    texts = chunks.where("numbers is not null").select("chunk", "id", "numbers")
    return texts.groupBy("chunk").cogroup(_encoded(chunks, config).groupBy("chunk")).applyInArrow(run, schema)
