"""Token ids of a corpus by a public byte-level BPE vocabulary.

The words of the whole corpus are counted, the most frequent ones compiled into a minimal acyclic transducer whose arcs
add up to a word's number, and that into one file which every task maps into memory. A batch's distinct words walk the
transducer together, a byte at a time; words it doesn't hold are merged exactly by the vocabulary's ranks.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.session import cut, shared_dir

#: Frequent words that are compiled; all others are merged. The bound keeps what the driver holds and ships small.
LEXICON_WORDS = 100_000
#: Bytes of the longest word that is compiled, and steps of a doubling by which counts are told apart when words are chosen.
LEXICON_BYTES, COUNT_STEPS = 256, 8
#: Characters tokenized together, and words of one text held at once.
CHUNK_CHARS, CHUNK_WORDS = 1_000_000, 200_000
_MAGIC = b"QLEX0001"

# Fixed value: how byte_bpe_50k divides text into words before merging.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """The place of a public vocabulary: in the given folder, else where the installed package keeps it."""
    if folder is None:
        try:
            import public_tokenizers

            return str(public_tokenizers.path(name))
        except ImportError:
            folder = "/opt/tokenizers"
    return os.path.join(folder, name)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by id."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * (max(int(rank) for _, rank in pairs) + 1)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Exact BPE of one word: the pair of the lowest rank, the leftmost of equals, is merged until no pair has a rank."""
    if word in ranks:
        return [ranks[word]]
    ends = list(range(1, len(word) + 1))  # where the part that starts here ends; -1 once it is merged away
    before = list(range(-1, len(word) - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(start: int) -> None:
        second = ends[start]
        if second < len(word):
            rank = ranks.get(word[start : ends[second]])
            if rank is not None:
                heapq.heappush(heap, (rank, start, ends[second]))

    for start in range(len(word) - 1):
        offer(start)
    while heap:
        _, start, end = heapq.heappop(heap)
        second = ends[start]
        if second == -1 or second >= len(word) or ends[second] != end:
            continue  # one of the parts has changed since
        ends[start], ends[second] = end, -1
        if end < len(word):
            before[end] = start
        offer(start)
        if before[start] >= 0:
            offer(before[start])
    ids, at = [], 0
    while at < len(word):
        ids.append(ranks[word[at : ends[at]]])
        at = ends[at]
    return ids


def compile_words(words: Sequence[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted distinct words, as arrays.

    Equal tails share their states. The arcs of state s are the entries with key s * 256 + byte; their `add` sums up, along
    a word, to its place in the sorted list.
    """
    known: dict[tuple, int] = {}
    arcs: list[tuple[tuple[int, int], ...]] = []
    finals: list[bool] = []
    reach: list[int] = []

    def freeze(node: list) -> int:
        signature = (node[0], tuple(node[1]))
        state = known.get(signature)
        if state is None:
            state = known[signature] = len(arcs)
            arcs.append(signature[1])
            finals.append(node[0])
            reach.append(node[0] + sum(reach[target] for _, target in signature[1]))
        return state

    path: list[list] = [[False, []]]
    last = b""
    for word in words:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        while len(path) > shared + 1:
            state = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], state))
        path.extend([False, []] for _ in range(len(word) - shared))
        path[-1][0] = True
        last = word
    while len(path) > 1:
        state = freeze(path.pop())
        path[-1][1].append((last[len(path) - 1], state))
    root = freeze(path[0])
    key, following, add = [], [], []
    for state, out in enumerate(arcs):
        before = int(finals[state])
        for byte, target in out:
            key.append(state * 256 + byte)
            following.append(target)
            add.append(before)
            before += reach[target]
    return {
        "key": np.array(key, dtype=np.int64),
        "next": np.array(following, dtype=np.int32),
        "add": np.array(add, dtype=np.int32),
        "final": np.array(finals, dtype=np.uint8),
        "root": np.array([root], dtype=np.int64),
    }


def _ragged(parts: Iterable[Sequence[int] | bytes], dtype: type) -> tuple[np.ndarray, np.ndarray]:
    parts = list(parts)
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int64)
    flat = np.frombuffer(b"".join(parts), dtype=np.uint8) if dtype is np.uint8 else np.array([x for p in parts for x in p], dtype=dtype)
    return flat, ends


def pack_lexicon(words: Iterable[str], tokens: Sequence[bytes]) -> bytes:
    """The file of a lexicon: the transducer of words, their ids, and the vocabulary."""
    ranks = {t: i for i, t in enumerate(tokens) if t}
    ordered = sorted({w.encode() for w in words if w})
    arrays = compile_words(ordered)
    arrays["ids"], arrays["id_ends"] = _ragged((merge(w, ranks) for w in ordered), np.int32)
    arrays["tokens"], arrays["token_ends"] = _ragged(tokens, np.uint8)
    head, body, at = [], [], 0
    for name, array in arrays.items():
        at += -at % 8
        head.append(f"{name} {array.dtype.str} {len(array)} {at}")
        body.append((at, array.tobytes()))
        at += array.nbytes
    text = "\n".join(head).encode()
    text += b"\n" * (-(len(text) + 16) % 8)
    out = bytearray(_MAGIC + len(text).to_bytes(8, "little") + text)
    base = len(out)
    for place, data in body:
        out += b"\0" * (base + place - len(out)) + data
    return bytes(out)


@dataclass
class Lexicon:
    """A lexicon file mapped into memory."""

    arrays: dict[str, np.ndarray]
    merged: dict[bytes, list[int]] = field(default_factory=dict)

    @classmethod
    def open(cls, path: str) -> Lexicon:
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        if raw[:8].tobytes() != _MAGIC:
            raise ValueError(f"{path} is no lexicon")
        size = int.from_bytes(raw[8:16].tobytes(), "little")
        arrays = {}
        for line in raw[16 : 16 + size].tobytes().decode().split("\n"):
            if line:
                name, kind, length, at = line.split()
                start = 16 + size + int(at)
                arrays[name] = raw[start : start + int(length) * np.dtype(kind).itemsize].view(kind)
        return cls(arrays)

    @property
    def ranks(self) -> dict[bytes, int]:
        if not hasattr(self, "_ranks"):
            data, ends = self.arrays["tokens"].tobytes(), self.arrays["token_ends"].tolist()
            self._ranks = {data[a:b]: i for i, (a, b) in enumerate(zip(ends, ends[1:])) if b > a}
        return self._ranks

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word data[start:end], -1 where the lexicon doesn't hold it."""
        a = self.arrays
        state = np.full(len(starts), a["root"][0], dtype=np.int64)
        number = np.zeros(len(starts), dtype=np.int64)
        alive, at = np.flatnonzero(ends > starts), starts.astype(np.int64).copy()
        number[ends <= starts] = -1
        keys = a["key"]
        while len(alive) and len(keys):
            want = state[alive] * 256 + data[at[alive]]
            arc = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            held = keys[arc] == want
            number[alive[~held]] = -1
            alive, arc = alive[held], arc[held]
            state[alive] = a["next"][arc]
            number[alive] += a["add"][arc]
            at[alive] += 1
            ended = at[alive] >= ends[alive]
            over = alive[ended]
            number[over[a["final"][state[over]] == 0]] = -1
            alive = alive[~ended]
        number[alive] = -1
        return number

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words of an array one after another, and how many each word has."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_string())
        _, offsets, content = distinct.buffers()
        ends = np.frombuffer(offsets, dtype=np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
        data = np.frombuffer(content, dtype=np.uint8) if content is not None else np.zeros(0, np.uint8)
        number = self.numbers(data, ends[:-1], ends[1:])
        held, a = number >= 0, self.arrays
        first = np.zeros(len(number), dtype=np.int64)
        count = np.zeros(len(number), dtype=np.int64)
        first[held] = a["id_ends"][number[held]]
        count[held] = a["id_ends"][number[held] + 1] - first[held]
        extra: list[int] = []
        for i in np.flatnonzero(~held):
            word = data[ends[i] : ends[i + 1]].tobytes()
            ids = self.merged.get(word)
            if ids is None:
                if len(self.merged) > 200_000:
                    self.merged.clear()
                ids = merge(word, self.ranks)
                if len(word) < 1000:
                    self.merged[word] = ids
            first[i], count[i] = len(a["ids"]) + len(extra), len(ids)
            extra += ids
        values = np.concatenate([a["ids"], np.array(extra, dtype=np.int32)]) if extra else a["ids"]
        which = coded.indices.to_numpy()
        counts = count[which]
        total = np.cumsum(counts)
        places = np.repeat(first[which] - total + counts, counts) + np.arange(total[-1] if len(total) else 0)
        return np.asarray(values[places], dtype=np.int32), counts


@lru_cache(maxsize=8)
def _opened(name: str) -> Lexicon:
    return Lexicon.open(SparkFiles.get(name))


@lru_cache(maxsize=8)
def _pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def word_chunks(texts: Iterable[str | None], pattern: str) -> Iterator[tuple[pa.Array, list[tuple[int, int]]]]:
    """Words of texts in bounded chunks, each with the (text, number of words) it holds."""
    split = _pattern(pattern)
    words: list[str] = []
    parts: list[tuple[int, int]] = []
    chars = 0
    for i, text in enumerate(texts):
        if not text:
            continue
        if len(text) <= CHUNK_CHARS:
            found = split.findall(text)
            words += found
            parts.append((i, len(found)))
            chars += len(text)
        else:
            if words:  # those of the texts before come first
                yield pa.array(words, type=pa.string()), parts
                words, parts, chars = [], [], 0
            matches = split.finditer(text)
            while found := [m[0] for m in islice(matches, CHUNK_WORDS)]:
                yield pa.array(found, type=pa.string()), [(i, len(found))]
        if chars >= CHUNK_CHARS:
            yield pa.array(words, type=pa.string()), parts
            words, parts, chars = [], [], 0
    if words:
        yield pa.array(words, type=pa.string()), parts


def word_counts(df: DataFrame, column: str, pattern: str = WORD_PATTERN) -> DataFrame:
    """word, n: how often each word occurs in df[column]; counted per chunk before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, _ in word_chunks(batch.column(0).to_pylist(), pattern):
                counted = words.value_counts()
                yield pa.RecordBatch.from_arrays([counted.field(0), counted.field(1)], names=["word", "n"])

    texts = df.select(F.col(f"`{column}`").cast("string").alias("text"))
    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def write_shared(spark: SparkSession, name: str, content: bytes) -> str:
    """A file in the shared folder, by whatever file system the folder is in; the name tells the content."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return path
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(content))
    out.close()
    return path


def build_lexicon(
    df: DataFrame, column: str = "text", vocabulary: str | None = None, pattern: str = WORD_PATTERN, max_words: int = LEXICON_WORDS
) -> str:
    """Compiles the most frequent words of df[column] and gives every executor the file; returns its name.

    All texts are counted. A histogram of the counts tells from which count on there are max_words words at most; only these
    are sent to the driver. A corpus with the same frequent words has the same file, which is written once.
    """
    spark = df.sparkSession
    counted = word_counts(df, column, pattern).where(F.octet_length("word") <= LEXICON_BYTES)
    step = F.floor(F.log2(F.col("n").cast("double")) * COUNT_STEPS)
    counted = cut(counted.select("word", step.alias("step")))
    least, held = None, 0
    for r in sorted(counted.groupBy("step").count().collect(), reverse=True):  # a step for each count up to 2**63 at most
        held += r["count"]
        if held > max_words:
            break
        least = r["step"]
    top = counted.where(F.col("step") >= least).select("word").collect() if least is not None else []
    content = pack_lexicon((r[0] for r in top), read_ranks(vocabulary or vocabulary_path()))
    name = f"lexicon-{hashlib.sha256(content).hexdigest()[:32]}.bin"
    spark.sparkContext.addFile(write_shared(spark, name, content))
    return name


def encode_texts(texts: Sequence[str | None], lexicon: Lexicon, pattern: str = WORD_PATTERN) -> tuple[np.ndarray, np.ndarray]:
    """All ids of texts one after another, and the number of ids of each text."""
    lengths = np.zeros(len(texts), dtype=np.int64)
    flat = [np.zeros(0, dtype=np.int32)]
    for words, parts in word_chunks(texts, pattern):
        ids, counts = lexicon.encode_words(words)
        flat.append(ids)
        of_text = np.repeat([i for i, _ in parts], [n for _, n in parts])
        lengths += np.bincount(of_text, weights=counts, minlength=len(texts)).astype(np.int64)
    return np.concatenate(flat), lengths


def encode(df: DataFrame, key: str = "doc_id", column: str = "text", vocabulary: str | None = None, pattern: str = WORD_PATTERN) -> DataFrame:
    """key, ids ARRAY<INT>: each text as token ids, without special tokens.

    A null or empty text has an empty list. Strings that look like special tokens are ordinary text. Repeated rows are
    encoded each for itself; other columns, whatever their names, aren't read. One shuffle of distinct words for the
    counts, none for the encoding.
    """
    name = build_lexicon(df, column, vocabulary, pattern)
    kept = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                ids, lengths = encode_texts(part.column(1).to_pylist(), _opened(name), pattern)
                ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(ids))], names=[key, "ids"])

    return kept.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(df: DataFrame, key: str = "doc_id", column: str = "text", vocabulary: str | None = None, pattern: str = WORD_PATTERN) -> DataFrame:
    """key, n_tokens: the number of ids encode() gives each text; 0 for null and empty ones."""
    name = build_lexicon(df, column, vocabulary, pattern)
    kept = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                _, lengths = encode_texts(part.column(1).to_pylist(), _opened(name), pattern)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths)], names=[key, "n_tokens"])

    return kept.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens bigint")


def slices(batch: pa.RecordBatch, text_column: int, most_bytes: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of bounded text, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if batch.num_rows > start:
        yield batch.slice(start)
