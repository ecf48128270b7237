"""Finding and repairing text that was read in the wrong character encoding.

Each word has a latent chain: it is as written, or it was written in one encoding and read in another, perhaps more
than once. A chain can be undone, which gives a candidate for the original. The likelihood of a word under a chain is
that of its original under a character model of clean text; expectation-maximization learns the weights of the chains'
steps in every source together with the character model, so that rare evidence is pooled over all records. Each record
is then repaired by posterior: the passage of words that gains most under a chain is weighed against the chain's weight.

Everything that reaches the driver or is sent to tasks has a fixed size: the character model is a count-min sketch of
MODEL_ROWS times 2**MODEL_BITS counts, step weights are kept for SOURCE_POOLS sources, and a bitmap of 2**FLAG_BITS
tells words that some chain may explain from those that none can.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.plans.storage import cut

MODEL_BITS = 18
MODEL_ROWS = 3
#: The sources with the most documents have weights of their own, up to one pool less than this; all others share the last pool.
SOURCE_POOLS = 64
ROUNDS = 4
#: The most frequent of the words that some chain makes likelier are worked out once for all tasks, if they have no more characters than this; a
#: task works out all others itself, with the same result.
KNOWN_WORDS = 8192
KNOWN_CHARS = 64
#: Bits of the word hash that the bitmap resolves; words that share a bit are looked at once more than needed.
FLAG_BITS = 22
#: A word inside a garbled passage is repaired with it unless that makes it less likely by more than this.
INSIDE = 3.0
#: A word beside one is repaired with it if it is likelier as it stands by less than this.
BESIDE = 0.5
#: Candidates below this posterior take no part in later rounds.
NEGLIGIBLE = 1e-12
#: Weight of the backed-off probability in the character model, in counts.
BACKOFF = 0.05
#: Characters of originals that are scored at once.
SCORED_CHARS = 1_000_000
#: Distinct words that a task holds before it passes its counts on.
HELD_WORDS = 200_000

#: Encodings of one byte a character, and of several.
SINGLE = (
    "cp1252", "cp1251", "cp1250", "iso8859-2", "koi8-r", "mac-roman", "cp437", "cp850", "cp866", "koi8-u", "iso8859-5", "mac-cyrillic", "cp855",
    "cp852", "cp1253", "cp1254", "cp1257", "iso8859-7", "iso8859-9", "iso8859-15",
)
MULTIBYTE = ("gb18030", "cp932", "euc-jp", "big5", "euc-kr")
#: (encoding in which the text was written, encoding in which it was read): all pairs. Text read as UTF-8 is lost, not garbled.
UTF8_CHAINS = tuple(("utf-8", r) for r in (*SINGLE, *MULTIBYTE))
CHAINS = (*UTF8_CHAINS, *((w, r) for r in (*SINGLE, *MULTIBYTE) for w in (*MULTIBYTE, *SINGLE) if w != r))
#: Steps of a chain. After a step that read UTF-8 wrongly is undone, every step is tried again on what it gives.
DEPTH = 3
#: A UTF-8 step that explains a smaller part of a word's characters shows UTF-8 by chance.
TELLING_SHARE = 0.75
CLEAN, LOST = "clean", "lost"
LOST_CHAR = "\ufffd"

BLANK = re.compile(r"[ \t\r\n]+")
WIDE = re.compile(r"[^\x00-\x7f]")
WIDE_STOP = re.compile(r"(?<=[。，、；：！？])")
#: A character beyond ASCII as UTF-8 bytes, each byte shown as the character of the same number.
UTF8_CHARS = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
#: Characters that text seldom has: controls and private use.
ODD = re.compile("[\x7f-\x9f\ue000-\uf8ff]")


# -- chains -------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=None)
def _bytes_of(charset: str) -> dict[str, int]:
    """Character -> byte of a single-byte charset. C1 controls stand for their own byte, as careless readers have it."""
    out = {chr(b): b for b in range(0x80, 0xA0)}
    for b in range(256):
        try:
            out[bytes([b]).decode(charset)] = b
        except UnicodeDecodeError:
            pass
    return out


@lru_cache(maxsize=None)
def _chars_of(charset: str) -> list[str]:
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(charset))
        except UnicodeDecodeError:
            out.append("")
    return out


@lru_cache(maxsize=None)
def _swaps(written: str, read: str) -> dict[int, str]:
    """Of two single-byte charsets: character as read -> character as written, U+FFFF where there is none."""
    chars = _chars_of(written)
    return {ord(c): chars[b] or "\uffff" for c, b in _bytes_of(read).items() if b >= 128}


def _runs(word: str, table: dict[str, int]) -> Iterator[tuple[str, bool]]:
    """The word in pieces, each wholly within the charset or wholly outside."""
    at = 0
    while at < len(word):
        inside, z = word[at] in table, at
        while z < len(word) and (word[z] in table) == inside:
            z += 1
        yield word[at:z], inside
        at = z


def _from_utf8(shown: str) -> str:
    """Each valid UTF-8 character among bytes shown as characters, decoded; other bytes stay as private characters."""

    def one(m: re.Match) -> str:
        try:
            return m.group().encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    return UTF8_CHARS.sub(one, shown)


def undo(word: str, written: str, read: str) -> str | None:
    """What the word was before it was read wrongly, or None if this chain can't have made it."""
    if read in MULTIBYTE:
        try:
            made = word.encode(read).decode(written)
        except (UnicodeEncodeError, UnicodeDecodeError):
            return None
        return _plausible(made, word)
    if written in SINGLE:
        made = word.translate(_swaps(written, read))
        return None if "\uffff" in made and "\uffff" not in word else _plausible(made, word)
    table, out = _bytes_of(read), []
    for piece, inside in _runs(word, table):
        if not inside or piece.isascii():
            out.append(piece)
        elif written == "utf-8":
            shown = "".join(chr(table[c]) for c in piece)
            was, at = [], 0
            for m in UTF8_CHARS.finditer(shown):
                was += [piece[at : m.start()], _from_utf8(m.group())]
                at = m.end()
            out += [*was, piece[at:]]
        else:
            try:
                out.append(bytes(table[c] for c in piece).decode(written))
            except UnicodeDecodeError:
                return None
    return _plausible("".join(out), word)


def _plausible(made: str, word: str) -> str | None:
    if made == word or (ODD.search(made) and any(c not in word for c in ODD.findall(made))):
        return None
    return made


WIDTH = 1 + len(CHAINS)
IS_UTF8 = np.array([False, *(w == "utf-8" for w, _ in CHAINS)])
NUMBER = {c: i for i, c in enumerate(CHAINS, 1)}


def steps(code: int) -> list[int]:
    """A chain's steps, the one to undo first in front. Chains are numbers with the steps, from 1, as digits of base WIDTH; 0 is clean."""
    out = []
    while code:
        code, digit = divmod(code, WIDTH)
        out.append(digit)
    return out


def name_of(code: int) -> str:
    return "+".join(f"{w}>{r}" for w, r in (CHAINS[i - 1] for i in steps(code))) or CLEAN


#: Steps between two charsets of one byte a character, and those that read UTF-8 in one.
SWAPS = tuple((NUMBER[w, r], w, r) for r in SINGLE for w in SINGLE if w != r)


@lru_cache(maxsize=None)
def _swapped(char: str) -> tuple[tuple[str, ...], int, int]:
    """What each of SWAPS makes of a character beyond ASCII, and as bits which swaps can take it and which change it."""
    made, able, changes = [], 0, 0
    for k, (_, w, r) in enumerate(SWAPS):
        c = _swaps(w, r).get(ord(char), char)
        made.append(c)
        if c == char or (c != "\uffff" and not ODD.match(c)):
            able |= 1 << k
        if c != char:
            changes |= 1 << k
    return tuple(made), able, changes


@lru_cache(maxsize=None)
def _utf8_roles(char: str) -> tuple[int, int]:
    """As bits, in which of SINGLE the character shows the first byte of a UTF-8 character, and in which a later one."""
    first = later = 0
    for k, r in enumerate(SINGLE):
        byte = _bytes_of(r).get(char, 0)
        first |= (0xC2 <= byte <= 0xF4) << k
        later |= (0x80 <= byte <= 0xBF) << k
    return first, later


@lru_cache(maxsize=20_000)
def _swaps_of(wide: str) -> list[tuple[list[int], dict[int, str]]]:
    """The steps of SWAPS that some text with these characters beyond ASCII can have gone through, those that change them alike together."""
    able, changes = -1, 0
    each = [_swapped(c) for c in wide]
    for _, a, c in each:
        able, changes = able & a, changes | c
    todo, columns = able & changes, list(zip(*(made for made, _, _ in each), strict=True))
    out: dict[tuple[str, ...], list[int]] = {}
    while todo:
        k = (todo & -todo).bit_length() - 1
        todo &= todo - 1
        out.setdefault(columns[k], []).append(SWAPS[k][0])
    return [(steps, {ord(c): x for c, x in zip(wide, made, strict=True)}) for made, steps in out.items()]


def _decoded(pieces: tuple, written: str, word: str) -> str | None:
    try:
        return _plausible("".join(p if isinstance(p, str) else p.decode(written) for p in pieces), word)
    except UnicodeDecodeError:
        return None


def _undone(word: str) -> Iterator[tuple[int, str]]:
    """Every single step that can have made the word, with what the word was before."""
    wide = sorted({c for c in word if c > "\x7f"})
    # UTF-8 shows wherever the first byte of a character stands before a later one
    shown, before = 0, 0
    for c in word:
        first, later = _utf8_roles(c) if c > "\x7f" else (0, 0)
        shown |= before & later
        before = first
    for k, r in enumerate(SINGLE):
        if shown >> k & 1:
            made = undo(word, "utf-8", r)
            if made is not None:
                yield NUMBER["utf-8", r], made
    # swaps that treat the word's characters alike give one original
    if ODD.search(word) or "\uffff" in word:
        for i, w, r in SWAPS:
            made = undo(word, w, r)
            if made is not None:
                yield i, made
    else:
        for alike, table in _swaps_of("".join(wide)):
            made = word.translate(table)
            for i in alike:
                yield i, made
    # charsets that hold the same of the word's characters at the same bytes give one original
    known: dict[tuple, list[tuple[str, str]]] = {}
    for r in SINGLE:
        table = _bytes_of(r)
        if not any(c in table for c in wide):
            continue
        pieces = tuple(bytes(map(table.__getitem__, p)) if inside and not p.isascii() else p for p, inside in _runs(word, table))
        if pieces not in known:
            known[pieces] = [(w, made) for w in MULTIBYTE if (made := _decoded(pieces, w, word)) is not None]
        for w, made in known[pieces]:
            yield NUMBER[w, r], made
    for r in MULTIBYTE:
        try:
            raw = word.encode(r)
        except UnicodeEncodeError:
            continue
        for w in ("utf-8", *MULTIBYTE, *SINGLE):
            if w != r:
                try:
                    made = _plausible(raw.decode(w), word)
                except UnicodeDecodeError:
                    continue
                if made is not None:
                    yield NUMBER[w, r], made


def candidates(word: str) -> tuple[list[int], list[int], list[str]]:
    """Chains, the place of each one's original in the last list, and the distinct originals.

    The word itself, clean, comes first, then all single steps. What a UTF-8 step gives that explains most characters
    beyond ASCII is looked at in the same way, up to DEPTH steps. Chains of equally few steps that lead to the same original all have their entry.
    """
    chains, which, seen = [0], [0], {word: 0}
    level = [(0, 1, word)]
    for _ in range(DEPTH):
        known, further = len(seen), []
        for code, place, text in level:
            for i, made in _undone(text):
                at = seen.setdefault(made, len(seen))
                if at < known:
                    continue  # fewer steps lead there
                chains.append(code + i * place)
                which.append(at)
                if IS_UTF8[i] and not made.isascii() and _utf8_share(text, CHAINS[i - 1][1]) >= TELLING_SHARE:
                    further.append((code + i * place, place * WIDTH, made))
        level = list({made: x for x in reversed(further) for made in (x[2],)}.values())
        if not level:
            break
    return chains, which, list(seen)


def _utf8_share(word: str, read: str) -> float:
    """The part of the characters beyond ASCII of this charset in the word that belong to UTF-8 sequences."""
    if read in MULTIBYTE:
        return 1.0  # else the step would have failed
    table = _bytes_of(read)
    shown = "".join(chr(table[c]) if c in table else " " for c in word)
    wide = sum(not c.isascii() for c in shown)
    return 1 - sum(not c.isascii() for c in UTF8_CHARS.sub("", shown)) / wide if wide else 0.0


def _once(chains: list[int], which: list[int], originals: list[str]) -> tuple[list[int], list[int], list[str]]:
    """Of chains with equal originals only the first, so that its weight isn't split among look-alikes."""
    first: dict[int, int] = {}
    for c, o in zip(chains, which, strict=True):
        first.setdefault(o, c)
    return list(first.values()), list(first), originals


def words_of(text: str) -> Iterator[tuple[int, int]]:
    """Places of the text's words beyond ASCII, however long: cut at blanks and after wide punctuation, which are whole characters in any chain."""
    if text.isascii():
        return
    at = 0
    while wide := WIDE.search(text, at):
        start = 1 + max(at - 1, *(text.rfind(b, at, wide.start()) for b in " \t\r\n"))
        blank = BLANK.search(text, wide.end())
        at = blank.start() if blank else len(text)
        for part in WIDE_STOP.split(text[start:at]):
            if not part.isascii():
                yield start, start + len(part)
            start += len(part)


# -- character model ----------------------------------------------------------------------------------------------


def _pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, character before, character) of all words; 0 stands before the first and after the last character."""
    length = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    codes = np.frombuffer("".join(w + "\0" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    before = np.concatenate(([0], codes[:-1])) if len(codes) else codes
    return np.repeat(np.arange(len(words)), length), before, codes


def _slots(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """The counters of a pair, one in each row of the sketch."""
    x = (a.astype(np.uint64) << np.uint64(21)) | np.asarray(b).astype(np.uint64)
    rows = []
    for r, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[:MODEL_ROWS]):
        y = (x ^ (x >> np.uint64(23))) * np.uint64(odd)
        rows.append((y >> np.uint64(64 - MODEL_BITS)).astype(np.int64) + (r << MODEL_BITS))
    return np.stack(rows)


#: Stand-ins for "any character" after one, and for a character by itself; beyond Unicode.
ANY, ALONE = 0x1FFFFE, 0x1FFFFF


class Model:
    """Step weights by source pool, the sources that have one, the sketch of character pairs, leading characters and characters, the bitmap of
    words, and what gains() says of frequent ones."""

    def __init__(self, weights: np.ndarray, sketch: np.ndarray, sources: list[str], flags: np.ndarray | None = None) -> None:
        self.weights, self.sketch, self.sources, self.flags = weights, sketch, sources, flags
        self.known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.logs = np.log(weights)

    def pool(self) -> Column:
        """The pool of a row's source."""
        at = F.array_position(F.array(*[F.lit(x) for x in self.sources]).cast("array<string>"), F.coalesce("source", F.lit("")))
        return F.when(at > 0, at - 1).otherwise(SOURCE_POOLS - 1).cast("int")

    def count(self, a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
        return self.sketch[_slots(a, b)].min(axis=0)

    def score(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word."""
        out, at, size = [], 0, 0
        for i, w in enumerate(words):
            size += len(w) + 1
            if size >= SCORED_CHARS:
                out.append(self._score(words[at : i + 1]))
                at, size = i + 1, 0
        return np.concatenate([*out, self._score(words[at:])])

    def _score(self, words: list[str]) -> np.ndarray:
        row, a, b = _pairs(words)
        total = max(1.0, float(self.count(np.zeros(1, np.int64), ALONE)[0]))  # every word has one end
        alone = np.minimum(1.0, (self.count(b, ALONE) + 1e-3) / (8 * total))
        lead = self.count(a, ANY)
        p = (np.minimum(self.count(a, b), lead) + BACKOFF * alone) / (lead + BACKOFF)
        return np.bincount(row, np.log(p), len(words))

    def log_weight(self, pool: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Of each chain: the steps of a chain happen apart from each other."""
        out, codes = self.logs[pool, codes % WIDTH], codes // WIDTH
        while codes.any():
            out = out + np.where(codes > 0, self.logs[pool, codes % WIDTH], 0.0)
            codes = codes // WIDTH
        return out


def word_bit(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << FLAG_BITS) - 1)


def expected(words: list[str], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, amounts) that weighted words add to the model's counts."""
    row, a, b = _pairs(words)
    slots = np.concatenate([_slots(a, b), _slots(b, ALONE), _slots(a, ANY)], axis=1).ravel()
    used, at = np.unique(slots, return_inverse=True)
    return used, np.bincount(at, np.tile(weight[row], 3 * MODEL_ROWS), len(used))


def gains(scores: np.ndarray, chains: Sequence[int], which: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """The chains that make a word likelier, and by how much; scores are those of its originals, the word itself in front."""
    gain = scores[np.asarray(which, np.int64)] - scores[0]
    up = np.flatnonzero(gain > 0)
    return np.asarray(chains, np.int64)[up], gain[up]


def posterior(model: Model, pools: Sequence[Sequence[int]], chains: list[list[int]], which: list[list[int]], originals: list[list[str]]) -> list[np.ndarray]:
    """Of each word the probabilities of its chains, a row for each of its pools."""
    sizes = [len(c) for c in chains]
    first = np.repeat(np.cumsum([0, *(len(o) for o in originals)])[:-1], sizes)
    flat = np.array([i for c in chains for i in c], np.int64)
    score = model.score([o for os in originals for o in os])[first + np.array([i for c in which for i in c], np.int64)]
    out, at = [], 0
    for p, n in zip(pools, sizes, strict=True):
        s = score[at : at + n] + model.log_weight(np.asarray(p, np.int64)[:, None], flat[None, at : at + n])
        e = np.exp(s - s.max(axis=1, keepdims=True))
        out.append(e / e.sum(axis=1, keepdims=True))
        at += n
    return out


# -- Spark --------------------------------------------------------------------------------------------------------


def top_sources(documents: DataFrame) -> list[str]:
    """The sources with the most documents, null as the empty one; at most SOURCE_POOLS - 1 names come back."""
    n = documents.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return [r["source"] for r in n.orderBy(F.desc("n"), "source").limit(SOURCE_POOLS - 1).collect()]


def word_table(documents: DataFrame, pool: Column) -> DataFrame:
    """(word, pools, ns, chains, which, originals) of the distinct words beyond ASCII, counted over all texts; ns has the count in each pool."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[tuple[int, str]] = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(n)
            return pa.RecordBatch.from_pydict(
                {"pool": pa.array([k[0] for k in keys], pa.int32()), "word": [k[1] for k in keys], "n": pa.array(list(n.values()), pa.int64())}
            )

        for b in batches:
            for pool, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n.update((pool, text[a:z]) for a, z in words_of(text) if LOST_CHAR not in text[a:z])
                if len(n) > HELD_WORDS:
                    yield flush()
                    n.clear()
        if n:
            yield flush()

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [candidates(w) for w in b.column(0).to_pylist()]
            kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *(pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), kinds, strict=True))] if found else [*b.columns, *(pa.array([], k) for k in kinds)],
                names=["word", "pools", "ns", "chains", "which", "originals"],
            )

    texts = documents.select(pool.alias("pool"), "text").where("text is not null").where(F.length("text") < F.octet_length("text"))
    words = texts.mapInArrow(count, "pool int, word string, n bigint").groupBy("pool", "word").agg(F.sum("n").alias("n"))
    # a word costs far more than its bytes, so tasks aren't joined by size; a word is in SOURCE_POOLS pools at most
    spark = documents.sparkSession
    words = words.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "word")
    words = words.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("pool", "n"))).alias("in")).select("word", F.col("in.pool").alias("pools"), F.col("in.n").alias("ns"))
    return words.mapInArrow(explain, WORDS)


#: In the charsets left out, ordinary words (such as those of [р-я][а-п][а-п] in cp866) are valid UTF-8 by chance.
TELLING_READS = tuple(r for _, r in UTF8_CHAINS if r not in ("cp866", "cp855", "koi8-u"))


def _first_guess(chains: list[list[int]], words: list[str]) -> list[np.ndarray]:
    """Before anything is known: words all of whose wide characters read as UTF-8 say nothing, all others are clean."""
    out = []
    for c, w in zip(chains, words, strict=True):
        p = np.zeros(len(c))
        p[0] = not (IS_UTF8[np.array(c) % WIDTH].any() and _all_utf8(w, TELLING_READS))
        out.append(p)
    return out


def _all_utf8(word: str, reads: Sequence[str]) -> bool:
    """Whether every character beyond ASCII belongs to a UTF-8 sequence in one of the readings."""
    for read in reads:
        if read in MULTIBYTE:
            if undo(word, "utf-8", read) is not None:
                return True
            continue
        table = _bytes_of(read)
        if all(c in table for c in word):
            shown = "".join(chr(table[c]) for c in word)
            if UTF8_CHARS.search(shown) and UTF8_CHARS.sub("", shown).isascii():
                return True
    return False


def _parts(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch of the word table in parts of about SCORED_CHARS characters of originals."""
    if len(b):
        size = np.array([sum(map(len, os)) + len(os) for os in b["originals"]])
        yield from (part for _, part in b.groupby(np.cumsum(size) // SCORED_CHARS, sort=False))


def _lists(b: pd.DataFrame) -> tuple[list[list[int]], list[list[int]], list[list[str]]]:
    chains, which, originals = ([list(x) for x in b[c]] for c in ("chains", "which", "originals"))
    return chains, which, originals


WORDS = "word string, pools array<int>, ns array<bigint>, chains array<int>, which array<int>, originals array<string>"


def _without_negligible(words: DataFrame, model: Model) -> DataFrame:
    """The word table without candidates whose posterior is as good as none in all pools; the clean reading stays."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in _parts(b):
                looked = [_once(*x) for x in zip(*_lists(part), strict=True)]
                chains, which, originals = zip(*looked, strict=True)
                kept = []
                for c, w, o, p in zip(chains, which, originals, posterior(shared.value, list(part["pools"]), chains, which, originals), strict=True):
                    some = [0, *(i for i in range(1, len(c)) if p[:, i].max() > NEGLIGIBLE)]
                    kept.append(([c[i] for i in some], list(range(len(some))), [o[w[i]] for i in some]))  # after _once() every chain has its own original
                yield part.assign(chains=[k[0] for k in kept], which=[k[1] for k in kept], originals=[k[2] for k in kept])

    return words.mapInPandas(prune, WORDS)


def _flag(words: DataFrame, model: Model) -> None:
    """Give the model its bitmap of words that some chain makes likelier, or less likely by no more than INSIDE, and the gains of the most frequent.

    At most 2**FLAG_BITS numbers come back, and the gains of KNOWN_WORDS words of KNOWN_CHARS characters.
    """
    shared = words.sparkSession.sparkContext.broadcast(model)

    def flag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in _parts(b):
                score, at, rows = shared.value.score([o for os in part["originals"] for o in os]), 0, []
                for w, n, chains, which, os in zip(part["word"], part["ns"], part["chains"], part["which"], part["originals"], strict=True):
                    own = score[at : at + len(os)]
                    if len(os) > 1 and own[1:].max() > own[0] - INSIDE:
                        rows.append((w, n.sum(), word_bit(w), *gains(own, chains, which)))
                    at += len(os)
                yield pd.DataFrame(rows, columns=["word", "n", "bit", "chains", "gains"])

    flagged = cut(words.mapInPandas(flag, "word string, n bigint, bit int, chains array<int>, gains array<double>"), "flagged")
    out = np.zeros(1 << FLAG_BITS, bool)
    out[flagged.select("bit").distinct().toPandas()["bit"].to_numpy(np.int64)] = True
    model.flags = np.packbits(out)
    top = flagged.where(F.length("word") <= KNOWN_CHARS).orderBy(F.desc("n"), "word").limit(KNOWN_WORDS).toArrow()
    model.known = {w: (np.array(c, np.int64), np.array(g)) for w, c, g in zip(*(top[k].to_pylist() for k in ("word", "chains", "gains")), strict=True)}


def fit(documents: DataFrame, rounds: int = ROUNDS) -> Model:
    """Learn step weights and character model from all words of all texts.

    Each round is one pass over the table of distinct words, which is written once, and once more without negligible
    candidates; what comes back is at most MODEL_ROWS * 2**MODEL_BITS + SOURCE_POOLS * WIDTH numbers. Without words the
    model knows nothing and repairs nothing.
    """
    sources = top_sources(documents)
    model = Model(np.full((SOURCE_POOLS, WIDTH), 1 / WIDTH), np.zeros(MODEL_ROWS << MODEL_BITS), sources)
    every = cut(word_table(documents, model.pool()), "words")
    words, cells = every, MODEL_ROWS << MODEL_BITS
    for done in range(rounds):
        shared = documents.sparkSession.sparkContext.broadcast(model if done else None)

        def step(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            counts, weights = np.zeros(cells), np.zeros(SOURCE_POOLS * WIDTH)
            for part in (p for b in batches for p in _parts(b)):
                chains, which, originals = zip(*(_once(*x) for x in zip(*_lists(part), strict=True)), strict=True)
                pools, ns = list(part["pools"]), [x.astype(np.float64) for x in part["ns"]]
                post = _first_guess(chains, list(part["word"])) if shared.value is None else posterior(shared.value, pools, chains, which, originals)
                each = [n[:, None] * p for n, p in zip(ns, post, strict=True)]  # a row for each pool
                w = np.concatenate([x.sum(axis=0) for x in each])
                some = np.flatnonzero(w > 1e-9)
                flat = [o[i] for o, at in zip(originals, which, strict=True) for i in at]
                slots, add = expected([flat[i] for i in some], w[some])
                counts[slots] += add
                codes = np.concatenate([np.tile(np.array(c, np.int64), len(p)) for c, p in zip(chains, pools, strict=True)])
                pool = np.concatenate([np.repeat(p, len(c)) for c, p in zip(chains, pools, strict=True)])
                w = np.concatenate([x.ravel() for x in each])
                at = np.arange(len(codes))
                while len(at):  # every step of a chain counts
                    weights += np.bincount(pool[at] * WIDTH + codes[at] % WIDTH, w[at], len(weights))
                    codes = codes // WIDTH
                    at = np.flatnonzero(codes)
            c, p = np.flatnonzero(counts), np.flatnonzero(weights)
            yield pd.DataFrame({"slot": np.concatenate([c, p + cells]), "amount": np.concatenate([counts[c], weights[p]])})

        got = words.mapInPandas(step, "slot bigint, amount double").groupBy("slot").agg(F.sum("amount").alias("amount")).toPandas()
        all_ = np.zeros(cells + SOURCE_POOLS * WIDTH)
        all_[got["slot"].to_numpy(np.int64)] = got["amount"].to_numpy()
        weights = all_[cells:].reshape(SOURCE_POOLS, WIDTH)
        # a pool's weights lean on those of all pools, so that small sources aren't left to chance
        overall = (weights.sum(axis=0) + 0.5) / (weights.sum() + 0.5 * WIDTH)
        weights = (weights + 50 * overall) / (weights.sum(axis=1, keepdims=True) + 50)
        model = Model(weights, all_[:cells], sources)
        if not done:
            words = cut(_without_negligible(every, model), "words")
    _flag(every, model)
    return model


#: How much likelier garbled must be than clean.
MARGIN = 3.0
#: A chain's weight is per word; passages that it hit have about so many words.
PASSAGE_WORDS = 20


class Repairer:
    """Repairs one text after another; keeps what it knows of words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[str, list[tuple[int, float]]] = {}  # chains that make a word likelier, and by how much
        self.own: dict[str, float] = {}
        self.one: dict[tuple[str, int], tuple[float, str] | None] = {}
        self.hurdles: dict[tuple[int, int], float] = {}
        self.costs = -np.log(np.minimum(0.5, PASSAGE_WORDS * model.weights))

    def hurdle(self, pool: int, chain: int) -> float:
        if (pool, chain) not in self.hurdles:
            self.hurdles[pool, chain] = float(np.log(MARGIN) + sum(self.costs[pool, i] for i in steps(chain)))
        return self.hurdles[pool, chain]

    def may_gain(self, word: str) -> bool:
        """Whether some chain may make the word likelier; words with lost characters aren't in the bitmap."""
        bit = word_bit(word)
        return self.model.flags is None or LOST_CHAR in word or bool(self.model.flags[bit >> 3] >> (7 - (bit & 7)) & 1)

    def gains(self, words: list[str]) -> list[list[tuple[int, float]]]:
        """Of each word the chains that make it likelier, and by how much."""
        if len(self.known) > HELD_WORDS:
            self.known.clear()
        new = []
        for w in dict.fromkeys(words):
            if w not in self.known:
                if w in self.model.known:
                    c, g = self.model.known[w]
                    self.known[w] = list(zip(c.tolist(), g.tolist(), strict=True))
                else:
                    new.append(w)
        made = [candidates(w) for w in new]
        scores, at = self.model.score([o for _, _, os in made for o in os]) if made else np.zeros(0), 0
        for w, (chains, which, originals) in zip(new, made, strict=True):
            c, g = gains(scores[at : at + len(originals)], chains, which)
            self.known[w] = list(zip(c.tolist(), g.tolist(), strict=True))
            at += len(originals)
        return [self.known[w] for w in words]

    def under(self, words: Iterable[str], chain: int) -> list[tuple[float, str] | None]:
        """Of each word how much likelier (or less likely) its original under the chain is, and that original; None if the chain can't have made it."""
        if len(self.one) > HELD_WORDS:
            self.one.clear()
            self.own.clear()
        words, asked = list(words), []
        for w in words:
            if (w, chain) not in self.one:
                made: str | None = w
                for i in steps(chain):
                    made = undo(made, *CHAINS[i - 1]) if made is not None else None
                self.one[w, chain] = None
                if made is not None:
                    asked.append((w, made))
        if asked:
            new = [w for w, _ in asked if w not in self.own]
            score = self.model.score([*new, *(made for _, made in asked)]).tolist()
            self.own.update(zip(new, score))
            for (w, made), x in zip(asked, score[len(new) :], strict=True):
                self.one[w, chain] = (x - self.own[w], made)
        return [self.one[w, chain] for w in words]

    @staticmethod
    def passages(gain: Sequence[float], hurdle: float, places: Sequence[int] | None = None) -> list[tuple[float, int, int]]:
        """Stretches of words whose total gain is over the hurdle: (by how much, first, end), apart from each other.

        places has the place of each gain's word, if others, which gain nothing, are left out.
        """
        out: list[tuple[float, int, int]] = []
        best, total, start = (0.0, 0, 0), 0.0, 0
        for i, g in zip([*(range(len(gain)) if places is None else places), -1], [*gain, -np.inf], strict=True):
            if total <= 0:
                best, total, start = (0.0, 0, 0), 0.0, i
            total += g
            if total > best[0]:
                best = (total, start, i + 1)
            if total <= 0 and best[0] > hurdle:
                out.append((best[0] - hurdle, *best[1:]))
        return out

    def repair(self, text: str, pool: int) -> tuple[list[str], str]:
        """(chains found, text as it was before).

        For every chain the passages that gain most are weighed against the chain's weight in the source. The chain
        with the clearest ones is undone there and in repeats of their words, then the other chains have their turn. A
        word that recurs is evidence once. A chain's passages gain no more than all words do that it makes likelier, so
        those that can't be the clearest aren't looked at.
        """
        places = list(words_of(text))
        words = [text[a:z] for a, z in places]
        first: dict[str, int] = {}
        for i, w in enumerate(words):
            first.setdefault(w, i)
        most: dict[int, float] = {}
        for gained in self.gains([w for w in first if self.may_gain(w)]):
            for c, g in gained:
                most[c] = most.get(c, 0.0) + g
        open_ = {c: h for c, g in most.items() if g > (h := self.hurdle(pool, c))}
        fixed: dict[int, str] = {}
        found: list[int] = []
        while open_:
            best: tuple[float, int, list] = (0.0, 0, [])
            for chain in sorted(open_, key=lambda c: (open_[c] - most[c], c)):
                if most[chain] - open_[chain] < best[0] - 1e-9:
                    break
                looked = {i: x[0] for i, x in zip(first.values(), self.under(first, chain), strict=True) if x is not None and i not in fixed}
                over = self.passages(list(looked.values()), open_[chain], list(looked))
                if over:
                    best = max(best, (sum(o for o, _, _ in over), chain, over))
                else:
                    del open_[chain]  # others only take evidence away
            if not best[2]:
                break
            _, chain, over = best
            found.append(chain)
            del open_[chain]
            known = dict(zip(first, self.under(first, chain), strict=True))
            gain = [(known[w] or (-np.inf, ""))[0] for w in words]
            before, undone = set(fixed), set()
            goes_with = lambda i: i not in fixed and -BESIDE < gain[i] <= 0  # noqa: B023, E731
            for _, start, end in over:
                while start > 0 and goes_with(start - 1):
                    start -= 1
                while end < len(words) and goes_with(end):
                    end += 1
                for i in range(start, end):
                    if i not in fixed and gain[i] > -INSIDE:
                        fixed[i] = known[words[i]][1]
                        if gain[i] > 0:
                            undone.add(words[i])
            for i, w in enumerate(words):
                if i not in fixed and w in undone:
                    fixed[i] = known[w][1]
            for i in fixed.keys() - before:
                if first[words[i]] == i and self.may_gain(words[i]):
                    for c, g in self.known[words[i]]:
                        most[c] -= g
            open_ = {c: h for c, h in open_.items() if most[c] > h}
        out, at = [], 0
        for i in sorted(fixed):
            a, z = places[i]
            out += [text[at:a], fixed[i]]
            at = z
        return sorted(map(name_of, found)), "".join([*out, text[at:]])


def repair(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, garbled, chains, original, lost), one row per document row.

    chains names what was undone somewhere in the text; `lost` is true where characters are gone (U+FFFD), which stay
    as they are. Null texts give garbled false and a null original; empty and ASCII
    texts are as written. A text is looked at whole, however long.
    """
    model = model or fit(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work = Repairer(shared.value)
        for b in batches:
            rows = [
                ([], t, False) if t is None or t.isascii() else (*at_work.repair(t, p), LOST_CHAR in t)
                for p, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([bool(c) or lost for c, _, lost in rows]),
                    pa.array([c for c, _, _ in rows], pa.list_(pa.string())),
                    pa.array([o for _, o, _ in rows], pa.string()),
                    pa.array([lost for _, _, lost in rows]),
                ],
                names=["doc_id", "garbled", "chains", "original", "lost"],
            )

    rows = documents.select("doc_id", model.pool().alias("pool"), "text")
    return rows.mapInArrow(run, "doc_id bigint, garbled boolean, chains array<string>, original string, lost boolean")
