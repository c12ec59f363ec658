"""Byte-pair encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words of the corpus are encoded once. They are compiled into an acyclic automaton over bytes that shares equal
suffixes; along the path of a word the numbers on the edges add up to its place in the lexicon, and the ids at that place
are its output. The automaton is one block of bytes, which every Python worker maps into memory. Words outside it are
merged pair by pair, lowest rank first, so the result never depends on the lexicon.

Defined cases: a null text counts as empty and gives no ids; the string of the special token in a text becomes its id,
as the library does; repeated rows are encoded one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import mmap
import re
import struct
import tempfile
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .shipping import ship

#: Words in the lexicon. It is a size, not a limit of what can be encoded: other words are merged.
LEXICON_WORDS = 40_000
#: Different words that a task counts before it hands its counts on.
COUNTED_AT_ONCE = 200_000
#: Classes of word counts for each doubling of the count.
CLASSES_TO_DOUBLE = 16
#: Words that a worker remembers in each of two generations; when the younger is full, the older is dropped.
REMEMBERED = 300_000

# Fixed value: the pattern of words of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
NO_MERGE = 1 << 62
WORD = regex.compile(PATTERN)
#: Characters whose class may differ between Unicode versions: not assigned, or assigned lately.
UNSURE = regex.compile(r"[\p{Cn}\p{Co}]")
#: Most texts have Latin characters only, whose classes are settled; they are split by the same pattern over plain sets.
LATIN_END = 0x250
NOT_LATIN = re.compile(rf"[^\x00-{chr(LATIN_END - 1)}]")


def latin_word() -> re.Pattern[str]:
    """The pattern of words for texts without characters from `LATIN_END` on."""
    known = [chr(c) for c in range(LATIN_END)]
    letters, numbers = ("".join(c for c in known if unicodedata.category(c)[0] == kind) for kind in "LN")
    blanks = r"\t-\r \x85\xa0"
    some = rf" ?[{letters}]+| ?[{numbers}]+| ?[^{blanks}{letters}{numbers}]+"
    return re.compile(rf"'(?:s|t|re|ve|m|ll|d)|{some}|[{blanks}]+(?![^{blanks}])|[{blanks}]+")


LATIN_WORD = latin_word()


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in the vocabulary: printable Latin-1 for itself, the others from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Vocabulary:
    """Tokens and merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        model = spec["model"]
        self.token = {i: as_bytes(t) for t, i in model["vocab"].items()}
        ids = {t: i for i, t in self.token.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: s.encode() for s, i in self.special.items()}
        self.of_byte = [ids[bytes([b])] for b in range(256)]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (as_bytes(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merge[ids[a], ids[b]] = rank, ids[a + b]
        # all tokens in one row of bytes, to spell ids at once
        tokens = [self.token.get(i, b"") for i in range(max(self.token) + 1)]
        self._long = np.array([len(t) for t in tokens], np.int64)
        self._first = np.cumsum(self._long) - self._long
        self._spelled = np.frombuffer(b"".join(tokens), np.uint8)
        self.packed = {a << 20 | b: rank << 20 | new for (a, b), (rank, new) in self.merge.items()}
        self._special = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self._path, self._splitter = path, None

    def spell(self, ids: np.ndarray) -> bytes:
        long = self._long[ids]
        ends = np.cumsum(long)
        places = np.repeat(self._first[ids] - (ends - long), long) + np.arange(ends[-1] if len(ends) else 0)
        return self._spelled[places].tobytes()

    def words(self, text: str) -> list[str]:
        if not NOT_LATIN.search(text):
            return LATIN_WORD.findall(text)
        if UNSURE.search(text):
            if self._splitter is None:
                from tokenizers import Tokenizer

                self._splitter = Tokenizer.from_file(self._path).pre_tokenizer
            return [text[a:b] for _, (a, b) in self._splitter.pre_tokenize_str(text)]
        return WORD.findall(text)

    def parts(self, text: str) -> list[str]:
        """Text and special tokens in turn, text first."""
        return self._special.split(text) if self._special else [text]

    def merged(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of lowest rank is merged first, the leftmost of equal ones."""
        ids = [self.of_byte[b] for b in word]
        return self._merged_long(ids) if len(ids) > 48 else self._merged_short(ids)

    def _merged_short(self, ids: list[int]) -> list[int]:
        get = self.packed.get
        # for each pair its rank and, below it, the merged id: the least number is the pair to merge
        ranks = [get(a << 20 | b, NO_MERGE) for a, b in itertools.pairwise(ids)]
        while ranks and (least := min(ranks)) != NO_MERGE:
            k = ranks.index(least)
            ids[k : k + 2] = [least & 0xFFFFF]
            del ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] << 20 | ids[k], NO_MERGE)
            if k < len(ranks):
                ranks[k] = get(ids[k] << 20 | ids[k + 1], NO_MERGE)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list."""
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(k: int) -> None:
            if 0 <= k and (j := after[k]) < n and (m := self.merge.get((ids[k], ids[j]))):
                heapq.heappush(heap, (m[0], k, ids[k], ids[j], m[1]))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            if not alive[k] or ids[k] != a or (j := after[k]) >= n or ids[j] != b:
                continue
            ids[k], alive[j], after[k] = new, False, after[j]
            if after[k] < n:
                before[after[k]] = k
            offer(k)
            offer(before[k])
        return [x for x, ok in zip(ids, alive) if ok]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The automaton of words with their ids as one block of bytes."""
    states: list[tuple[bool, tuple]] = []
    reach: list[int] = []  # words from a state on
    known: dict[tuple, int] = {}

    def settled(final: bool, edges: list) -> int:
        state = final, tuple(edges)
        if state not in known:
            known[state] = len(states)
            states.append(state)
            reach.append(final + sum(reach[t] for _, t in edges))
        return known[state]

    ordered = sorted(words)
    path: list[list] = [[False, []]]  # states of the last word that may still get edges
    last = b""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            final, edges = path.pop()
            path[-1][1].append((last[len(path) - 1], settled(final, edges)))

    for word in ordered:
        same = next((k for k, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
        settle(same)
        path += [[False, []] for _ in word[same:]]
        path[-1][0], last = True, word
    settle(0)
    root = settled(*path[0])

    first, labels, targets, skips = [0], bytearray(), [], []
    for final, edges in states:
        passed = int(final)
        for label, target in edges:
            labels.append(label)
            targets.append(target)
            skips.append(passed)
            passed += reach[target]
        first.append(len(labels))
    ids, offsets = [], [0]
    for word in ordered:
        ids += words[word]
        offsets.append(len(ids))
    finals = bytes(final for final, _ in states)
    blocks = [first, targets, skips, offsets, ids]
    head = struct.pack("<9I", root, *map(len, blocks), len(labels), len(finals), 0)
    return head + b"".join(struct.pack(f"<{len(b)}I", *b) for b in blocks) + bytes(labels) + finals


class Lexicon:
    """A compiled lexicon, mapped from an unnamed file of this process."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = struct.unpack_from("<9I", self._map)
        self.root, at = head[0], struct.calcsize("<9I")
        whole = memoryview(self._map)
        arrays = []
        for n in head[1:6]:
            arrays.append(whole[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.targets, self.skips, self.offsets, self.ids = arrays
        self._labels, self._finals = at, at + head[6]
        self.n_states, self.n_words = head[7], head[4] - 1

    def find(self, word: bytes) -> bytes | None:
        """The ids of a word, four bytes each; None for words outside."""
        state, place, find, base = self.root, 0, self._map.find, self._labels
        first, skips, targets = self.first, self.skips, self.targets
        for k in range(len(word)):
            edge = find(word[k : k + 1], base + first[state], base + first[state + 1]) - base
            if edge < 0:
                return None
            place += skips[edge]
            state = targets[edge]
        if not self._map[self._finals + state]:
            return None
        return self.ids[self.offsets[place] : self.offsets[place + 1]].tobytes()


class Encoder:
    """Words are remembered with their ids, as bytes and written in decimals."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon, remembered: int = REMEMBERED):
        self.vocabulary, self.lexicon, self.remembered = vocabulary, lexicon, remembered
        self._memory: dict[str, tuple[bytes, str]] = {}
        self._older: dict[str, tuple[bytes, str]] = {}

    def _word(self, word: str) -> tuple[bytes, str]:
        out = self._older.get(word)
        if out is None:
            spelled = word.encode()
            packed = self.lexicon.find(spelled)
            ids = array("i", self.vocabulary.merged(spelled) if packed is None else packed)
            out = ids.tobytes(), ",".join(map(str, ids))
        if len(word) <= 64:
            if len(self._memory) >= self.remembered:
                self._memory, self._older = {}, self._memory
            self._memory[word] = out
        return out

    def pieces(self, text: str) -> list[tuple[bytes, str]]:
        out, fresh = [], self._word
        for k, part in enumerate(self.vocabulary.parts(text)):
            if k % 2:
                i = self.vocabulary.special[part]
                out.append((array("i", [i]).tobytes(), str(i)))
            else:
                get = self._memory.get
                out += [get(w) or fresh(w) for w in self.vocabulary.words(part)]
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join([p[0] for p in self.pieces(text)]), np.int32).tolist()

    def decode(self, ids: list[int] | np.ndarray) -> str:
        return self.vocabulary.spell(np.asarray(ids, np.int32)).decode("utf-8", "replace")


# What a Python worker keeps from task to task.
_VOCABULARIES: dict[str, Vocabulary] = {}
_ENCODERS: dict[tuple[str, str], Encoder] = {}


def vocabulary_at(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def encoder_for(path: str, key: str, block) -> Encoder:
    if (path, key) not in _ENCODERS:
        _ENCODERS.clear()  # the lexicon of an earlier job
        _ENCODERS[path, key] = Encoder(vocabulary_at(path), Lexicon(block()))
    return _ENCODERS[path, key]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def out() -> pa.RecordBatch:
        good = [(" " + w, n) for w, n in counts.items() if w.isalpha() and len(w) < 40]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in good], pa.string()), pa.array([n for _, n in good], pa.int64())], schema=schema)

    for batch in batches:
        for text in batch.column(0):
            counts.update((text.as_py() or "").split(" ")[1:])
            if len(counts) >= COUNTED_AT_ONCE:
                yield out()
    yield out()


def frequent_words(docs: DataFrame, n: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words (letters after a blank) of all texts; ties by the word. At most n, on the driver.

    A histogram of the counts, a few hundred classes, tells which classes hold the first n words; only words of these are
    sorted. The n chosen are written first, so no task sends a list of its own to the driver.
    """
    ship(docs.sparkSession)
    counted = docs.select("text").mapInArrow(_count_words, "word string, n bigint")
    totals = cut_lineage(counted.groupBy("word").agg(F.sum("n").alias("n")).withColumn("class", F.floor(F.log2("n") * CLASSES_TO_DOUBLE)))
    least, enough = 0, 0
    for row in totals.groupBy("class").count().orderBy(F.desc("class")).collect():
        least, enough = row["class"], enough + row["count"]
        if enough >= n:
            break
    chosen = cut_lineage(totals.where(F.col("class") >= least).orderBy(F.desc("n"), "word").limit(n))
    return [r["word"] for r in chosen.orderBy(F.desc("n"), "word").collect()]


def build_lexicon(docs: DataFrame, path: str, n: int = LEXICON_WORDS) -> bytes:
    vocabulary = vocabulary_at(path)
    return compile_lexicon({w.encode(): vocabulary.merged(w.encode()) for w in frequent_words(docs, n)})


def encode(docs: DataFrame, path: str, n: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): whole texts encoded, and decoded again from their ids."""
    spark = docs.sparkSession
    ship(spark)
    block = build_lexicon(docs, path, n)
    shared, key = spark.sparkContext.broadcast(block), hashlib.sha256(block).hexdigest()
    names = ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path, key, lambda: shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                packed, counts, digests, decoded = [], [], [], []
                for text in part.column(1).to_pylist():
                    pieces = encoder.pieces(text or "")
                    packed.append(b"".join([p[0] for p in pieces]))
                    ids = np.frombuffer(packed[-1], np.int32)
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(",".join([p[1] for p in pieces]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
                flat = pa.array(np.frombuffer(b"".join(packed), np.int32))
                columns = [
                    part.column(0),
                    pa.array(counts, pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(counts)], pa.int32()), flat),
                    pa.array(digests),
                    pa.array(decoded),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens bigint, ids array<int>, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
