"""Token ids of a whole corpus by a byte-level BPE tokenizer, from a lexicon automaton and exact merging.

All texts are cut into words once to count them. The ids of the most frequent words are compiled into a minimal
acyclic transducer: words share prefixes and suffixes, and the numbers on the arcs add up to a word's place in the
table of ids. The transducer is written to the shared folder, sent to every executor and memory-mapped there. A second
pass looks the distinct words of each batch up in it, all words one byte at a time, and merges unseen words exactly.
"""

import base64
import heapq
import json
import os
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.plans.storage import new_path

TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"

#: How the tokenizer cuts a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words in the lexicon and their greatest length in bytes; words beyond either are merged, with the same result.
LEXICON_WORDS = 32_768
LEXICON_BYTES = 48
#: Distinct words that a counting task holds before it passes its counts on.
COUNTED_WORDS = 200_000
#: Characters encoded at once within a batch.
SLICE_CHARS = 1 << 21


# -- merging ------------------------------------------------------------------------------------------------------


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The word's ids: of all neighbours that form a known token the one of lowest rank is joined, leftmost first.

    A heap of neighbours makes long words cost n log n.
    """
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts here
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n:
            r = ranks.get(word[i : end[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, j, end[j]))

    for i in range(n - 1):
        offer(i)
    alive = bytearray(b"\1") * n
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if not (alive[i] and end[i] == j and j < n and alive[j] and end[j] == k):
            continue
        end[i], alive[j] = k, 0
        if k < n:
            before[k] = i
            offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


# -- lexicon ------------------------------------------------------------------------------------------------------


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic transducer of the entries as bytes: a line of JSON with the arrays' lengths, then the arrays.

    Words are added in order; once a word leaves a branch, the branch is final and merged with an equal one seen before.
    """
    words = sorted(entries)
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    branch: list[tuple[int, int, int]] = []  # (state, byte, next state) along the last word
    last = b""

    def close(down_to: int) -> None:
        while len(branch) > down_to:
            state, byte, child = branch.pop()
            arcs[state][byte] = register.setdefault((final[child], *arcs[child].items()), child)

    for w in words:
        shared = len(os.path.commonprefix([w, last]))
        close(shared)
        state = branch[-1][2] if branch else 0
        for byte in w[shared:]:
            arcs.append({})
            final.append(False)
            branch.append((state, byte, len(arcs) - 1))
            arcs[state][byte] = state = len(arcs) - 1
        final[state] = True
        last = w
    close(0)

    # words reachable from each state; children are numbered after parents only before merging, so walk depth first
    reach: dict[int, int] = {}
    stack = [0]
    while stack:
        s = stack[-1]
        todo = [t for t in arcs[s].values() if t not in reach]
        if todo:
            stack += todo
            continue
        stack.pop()
        reach[s] = final[s] + sum(reach[t] for t in arcs[s].values())
    number = {s: i for i, s in enumerate(sorted(reach))}
    key, target, add = [], [], []
    for s in sorted(reach):
        skipped = int(final[s])
        for byte, t in sorted(arcs[s].items()):
            key.append(number[s] * 256 + byte)
            target.append(number[t])
            add.append(skipped)
            skipped += reach[t]
    ends = np.cumsum([0] + [len(entries[w]) for w in words])
    arrays = [
        np.array(key, np.int64),
        np.array(target, np.int64),
        np.array(add, np.int64),
        np.array([final[s] for s in sorted(reach)], np.int64),
        ends.astype(np.int64),
        np.array([i for w in words for i in entries[w]], np.int64),
    ]
    head = json.dumps({"lengths": [len(a) for a in arrays], "bytes": max(map(len, words), default=0)}).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    return head + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled lexicon, memory-mapped from a file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            head = f.readline()
        said, at, parts = json.loads(head), len(head), []
        for n in said["lengths"]:
            parts.append(np.memmap(path, np.int64, "r", at, (n,)) if n else np.zeros(0, np.int64))
            at += 8 * n
        self.longest = said["bytes"]
        self.key, self.target, self.add, self.final, self.ends, self.ids = parts

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's number in the lexicon, or -1. All words go through the transducer together, a byte at a time."""
        found = np.full(len(words), -1, np.int64)
        length = np.fromiter(map(len, words), np.int64, len(words))
        start = np.concatenate(([0], np.cumsum(length)))[:-1]
        text = np.frombuffer(b"".join(words), np.uint8)
        live = np.flatnonzero((length <= self.longest) & (length > 0)) if len(self.key) else np.zeros(0, np.int64)
        state, rank = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        at = 0
        while len(live):
            want = state * 256 + text[start[live] + at]
            i = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            ok = self.key[i] == want
            live, i = live[ok], i[ok]
            rank, state = rank[ok] + self.add[i], self.target[i]
            at += 1
            done = length[live] == at
            hit = done & (self.final[state] == 1)
            found[live[hit]] = rank[hit]
            live, state, rank = live[~done], state[~done], rank[~done]
        return found


@lru_cache(maxsize=4)
def _opened(lexicon: str, ranks: str) -> tuple[Lexicon, dict[bytes, int], dict[bytes, list[int]]]:
    return Lexicon(SparkFiles.get(lexicon)), read_ranks(SparkFiles.get(ranks)), {}


def share_bytes(spark: SparkSession, data: bytes, name: str) -> str:
    """Write data to the shared folder and have every executor fetch it; returns the name for SparkFiles.get."""
    name = f"{name}-{uuid.uuid4().hex[:12]}"
    path = new_path(spark, name)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path)
    return name


# -- counting and encoding ----------------------------------------------------------------------------------------


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(word, n) over all texts. Tasks combine before the exchange."""
    cut_words = regex.compile(PATTERN)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                n.update(cut_words.findall(t))
                if len(n) > COUNTED_WORDS:
                    yield pa.RecordBatch.from_pydict({"word": list(n.keys()), "n": list(n.values())})
                    n = Counter()
        if n:
            yield pa.RecordBatch.from_pydict({"word": list(n.keys()), "n": list(n.values())})

    # string ids are what Arrow makes of a Python list of texts, so the schema fits without a cast
    some = texts.select(column).where(F.col(column).isNotNull() & (F.col(column) != ""))
    return some.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(texts: DataFrame, column: str, tokenizers: str = TOKENIZERS, words: int = LEXICON_WORDS) -> tuple[str, str]:
    """Compile the corpus's most frequent words and send them out; returns the names of the lexicon and of the ranks.

    At most `words` words of at most LEXICON_BYTES bytes come to the driver. The counts are over all texts.
    """
    spark = texts.sparkSession
    ranks_path = os.path.join(tokenizers, RANKS)
    ranks = read_ranks(ranks_path)
    top = word_counts(texts, column).where(F.octet_length("word") <= LEXICON_BYTES).orderBy(F.desc("n"), "word").limit(words).select("word").collect()
    entries = {w: merge(w, ranks) for w in (r[0].encode() for r in top)}
    with open(ranks_path, "rb") as f:
        return share_bytes(spark, compile_lexicon(entries), "lexicon"), share_bytes(spark, f.read(), "ranks")


def encode_texts(texts: list[str | None], lexicon: Lexicon, ranks: dict[bytes, int], merged: dict[bytes, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and where each text's ids end. merged keeps the ids of unseen words between calls."""
    cut_words = _pattern()
    pieces = [cut_words.findall(t) if t else [] for t in texts]
    per_text = np.fromiter(map(len, pieces), np.int64, len(pieces))
    coded = pa.array([w for p in pieces for w in p], pa.large_string()).dictionary_encode()
    words = [w.encode() for w in coded.dictionary.to_pylist()]
    rank = lexicon.find(words)
    known, new = np.flatnonzero(rank >= 0), np.flatnonzero(rank < 0)
    size = np.zeros(len(words), np.int64)
    size[known] = lexicon.ends[rank[known] + 1] - lexicon.ends[rank[known]]
    if len(merged) > COUNTED_WORDS:
        merged.clear()
    unseen = []
    for i in new:
        w = words[i]
        ids = merged.get(w)
        if ids is None:
            ids = merge(w, ranks)
            if len(w) <= LEXICON_BYTES:
                merged[w] = ids
        unseen.append(ids)
        size[i] = len(ids)
    # a table of all distinct words' ids: first the lexicon's, then the unseen ones
    extra = np.array([i for ids in unseen for i in ids], np.int64)
    pool = np.concatenate([np.asarray(lexicon.ids), extra])
    start = np.zeros(len(words), np.int64)
    start[known] = lexicon.ends[rank[known]]
    start[new] = len(lexicon.ids) + np.concatenate(([0], np.cumsum(size[new])))[:-1] if len(new) else 0
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = size[code]
    ends = np.concatenate(([0], np.cumsum(n)))
    ids = pool[np.repeat(start[code] - ends[:-1], n) + np.arange(ends[-1])]
    return ids, ends[np.cumsum(per_text)]


@lru_cache(maxsize=1)
def _pattern() -> regex.Pattern:
    return regex.compile(PATTERN)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= SLICE_CHARS:
            yield at, i + 1
            at, chars = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encode(df: DataFrame, column: str, tokenizers: str = TOKENIZERS, counts_only: bool = False) -> DataFrame:
    """df with `ids` ARRAY<INT> in place of the text column, or with `tokens` BIGINT if counts_only.

    A column of that name that was there before is replaced. Null and empty texts have an empty list (0 tokens). No special tokens are added, and their names in a text are
    ordinary text. Other columns pass through. A text is encoded whole, however long.
    """
    lexicon, ranks = build_lexicon(df, column, tokenizers)
    out = "tokens" if counts_only else "ids"
    df = df.select([F.col(f"`{c}`") for c in df.columns if c != out])
    kept = [c for c in df.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, known, merged = _opened(lexicon, ranks)
        for b in batches:
            texts = b.column(b.schema.get_field_index(column)).to_pylist()
            for a, z in _slices(texts):
                ids, ends = encode_texts(texts[a:z], lex, known, merged)
                if counts_only:
                    made = pa.array(np.diff(ends, prepend=0))
                else:
                    made = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids, pa.int32()))
                part = b.slice(a, z - a)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), made], names=[*kept, out])

    passing = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != column)
    made_type = "tokens bigint" if counts_only else "ids array<int>"
    return df.mapInArrow(run, f"{passing}, {made_type}" if passing else made_type)
