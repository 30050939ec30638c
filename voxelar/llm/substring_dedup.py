"""Substring deduplication by recompression.

Words become symbols; rounds then name maximal runs of one symbol and left-right pairs
of adjacent symbols. A name is a hash of what it stands for, so all partitions name
globally alike without exchanging a dictionary, and whether two symbols merge depends
on these symbols alone. Each symbol knows the words that determine it; two equal
windows therefore hold the same symbols wherever those words lie inside the window.

A window is represented by the least-named symbol it determines. Consecutive windows
with the same representative travel as one row, keyed by that symbol and ten words
beside it that the windows share. Keys that occur once are unique text. Rows equal in key
and content are repeats; the few rows whose key repeats but whose content differs (ends of
a passage, edits) are verified window by window.

Key and content are names of two independent families over 63-bit word hashes, so two
different windows pass for equal only if 128 bits collide: with 1.5e13 windows (100 TB) the
expected number is below 1e-12. Two different words share a hash in a handful of cases at
that size, which matters only where the 19 other words of a window agree.

Repeats inside a block of a million words are settled there and send one row for each
passage, so the hottest key has one row a block among some 190,000: no key can hold more
than about 1 / 190,000 of the shuffled rows, far below a partition's share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxelar.plans.cut import materialize

from ._common import id_back, id_of, text_of

WINDOW = 20
HALF = WINDOW // 2
#: Rounds of runs and pairs. Higher symbols span more words, so a 20-word window determines fewer
#: of them: 0.19, 0.28 and 0.75 rows a word were measured for one, two and three.
LEVELS = 1
#: Distinct words that a task remembers the symbols of.
MEMO = 1 << 20
#: Words handled at once; a longer text is handled alone, whole.
BLOCK_WORDS = 1 << 20

_U = np.uint64
_K = [_U(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def name(a, b, seed: int = 0):
    """A 64-bit name for the ordered pair of two arrays of names."""
    h = a * _K[0] + (b ^ (b >> _U(29))) * _K[1] + _U((seed * 2 + 1) * int(_K[2]) % (1 << 64))
    h ^= h >> _U(32)
    h *= _K[3]
    h ^= h >> _U(29)
    h *= _K[0]
    return h ^ (h >> _U(32))


class Symbols:
    """The symbols of a block: names, first words and the words that determine each.

    Texts are separated by a zero symbol, which never merges and, lying in no window,
    leaves its neighbours undetermined.
    """

    def __init__(self, words: np.ndarray):
        self.names = words
        self.start = np.arange(len(words))
        self.low, self.high = self.start, self.start + 1

    def _merge(self, first: np.ndarray, names: np.ndarray) -> None:
        """Symbols at ``first`` take in those up to the next; both neighbours decide the cut."""
        last = np.append(first[1:], len(self.names)) - 1
        self.low = self.low[np.maximum(first - 1, 0)]
        self.high = self.high[np.minimum(last + 1, len(self.high) - 1)]
        self.start, self.names = self.start[first], names

    def runs(self) -> None:
        new = np.ones(len(self.names), bool)
        new[1:] = (self.names[1:] != self.names[:-1]) | (self.names[1:] == 0)
        first = np.nonzero(new)[0]
        length = np.diff(np.append(first, len(self.names)))
        names = self.names[first]
        self._merge(first, np.where(length > 1, name(names, length.astype(_U), 7), names))

    def pairs(self, level: int) -> None:
        left = (name(self.names, self.names, 11 + level) & _U(1)).astype(bool) | (self.names == 0)
        joined = ~left[:-1] & left[1:] & (self.names[:-1] != 0) & (self.names[1:] != 0)
        first = np.nonzero(~np.append(False, joined))[0]
        names = self.names[first].copy()
        two = np.append(joined, False)[first]
        names[two] = name(names[two], self.names[first[two] + 1], 13)
        self._merge(first, names)


def parse(words: np.ndarray, levels: int = LEVELS) -> Symbols:
    symbols = Symbols(words)
    for level in range(levels):
        symbols.runs()
        symbols.pairs(level)
    return symbols


def window_names(words: np.ndarray, seed: int = 0) -> dict[int, np.ndarray]:
    """Names of all 8, 10 and 20 word windows by doubling; index: first word."""

    def join(a, b, by):
        n = len(words)
        out = np.zeros(n, _U)
        out[: n - by] = name(a[: n - by], b[by:], seed)
        return out

    one = words
    two = join(one, one, 1)
    four = join(two, two, 2)
    eight = join(four, four, 4)
    sixteen = join(eight, eight, 8)
    return {HALF: join(eight, two, 8), WINDOW: join(sixteen, four, 16)}


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index of the first least value in each range a..b (inclusive, never empty)."""
    size = b - a + 1
    out = np.empty(len(a), np.int64)
    table, width = np.arange(len(values)), 1
    while True:
        part = (size >= width) & (size < 2 * width)
        x, y = table[a[part]], table[b[part] - width + 1]
        out[part] = np.where(values[x] <= values[y], x, y)
        if 2 * width > size.max(initial=0):
            return out
        x, y = table[:-width], table[width:]
        table = np.where(values[x] <= values[y], x, y)
        width *= 2


def super_windows(words: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of consecutive windows with one representative: first start, count, key, content."""
    symbols, names, whole = parse(words), window_names(words), window_names(words, 37)[WINDOW]
    n = len(words)
    starts = np.nonzero(valid)[0]
    # The determined symbols of a window are those with low >= start and high <= end.
    a = np.searchsorted(symbols.low, starts, "left")
    b = np.searchsorted(symbols.high, starts + WINDOW, "right") - 1
    some = a <= b
    chosen = np.full(len(starts), -1, np.int64)
    if some.any():
        chosen[some] = _least(name(symbols.names, symbols.names, 3), a[some], b[some])
    at = np.where(some, symbols.start[chosen], starts)
    left = some & (at - starts >= HALF)
    # Without a determined symbol a window stands for itself.
    key = np.where(
        some,
        name(names[HALF][np.where(left, at - HALF, np.minimum(at, n - 1))], symbols.names[chosen], 17) + left.astype(_U),
        names[WINDOW][starts],
    )
    new = np.ones(len(starts), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (left[1:] != left[:-1]) | (starts[1:] != starts[:-1] + 1) | ~some[1:]
    first = np.nonzero(new)[0]
    count = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    content = name(name(whole[begin], whole[begin + count - 1], 19), count.astype(_U), 23)
    return begin, count, key[first], content


class _Block:
    """Texts of one task, word by word, until there are enough to handle at once."""

    def __init__(self, memo: dict[bytes, int]):
        self.memo, self.parts, self.sizes, self.tags, self.words = memo, [], [], [], 0

    def add(self, tag, words: list[bytes]) -> None:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in words:
            if w not in memo:
                memo[w] = xxhash.xxh64_intdigest(w) | 1 << 63
        self.parts.append(np.fromiter(map(memo.__getitem__, words), _U, len(words)))
        self.sizes.append(len(words))
        self.tags.append(tag)
        self.words += len(words)

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All words with zeros between texts, window validity, each text's first word, its number by word."""
        sizes = np.array(self.sizes, np.int64)
        offset = np.cumsum(np.append(1, sizes + 1))[:-1]
        words = np.zeros(int(sizes.sum()) + len(sizes) + 1, _U)
        valid = np.zeros(len(words), bool)
        owner = np.zeros(len(words), np.int64)
        for i, part in enumerate(self.parts):
            words[offset[i] : offset[i] + len(part)] = part
            valid[offset[i] : offset[i] + max(0, len(part) - WINDOW + 1)] = True
            owner[offset[i] : offset[i] + len(part)] = i
        return words, valid, offset, owner


# A row's place packs its first word, some bits of the text's hash, the number of windows and a flag.
_START, _HASH, _COUNT = 28, 8, 2
_DUP = 1


def _pack(start, check, count, flag):
    return (start << _START) | (check << _HASH) | (count << _COUNT) | flag


def _first_of(groups: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """True where a row is no later than any other row of its group in this block."""
    order = np.lexsort((start, doc, groups))
    g = groups[order]
    head = np.append(True, g[1:] != g[:-1])
    lead = order[np.nonzero(head)[0]][np.cumsum(head) - 1]
    first = np.empty(len(groups), bool)
    first[order] = (doc[order] == doc[lead]) & (start[order] == start[lead])
    return first


def _emit(block: _Block, mask: int) -> pa.RecordBatch | None:
    words, valid, offset, owner = block.joined()
    if not valid.any():
        return None
    begin, count, key, content = super_windows(words, valid)
    doc = np.array([t[0] for t in block.tags], np.int64)[owner[begin]]
    check = np.array([t[1] for t in block.tags], np.int64)[owner[begin]]
    start = begin - offset[owner[begin]]
    first = _first_of(name(key, content, 29), doc, start)
    # Repeats inside the block are settled here, so a hot passage sends one row per block.
    key = np.where(first, key & _U(mask), name(content, start.astype(_U), 31))
    place = _pack(start, check, count, np.where(first, 0, _DUP))
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (key.view(np.int64), content.view(np.int64), doc, place)], ["key", "content", "doc", "place"]
    )


def _blocks(batches):
    memo: dict[bytes, int] = {}
    block = _Block(memo)
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("doc", "check", "text")]
        for doc, check, text in zip(*cols, strict=True):
            block.add((doc, check), text.split())
            if block.words >= BLOCK_WORDS:
                yield block
                block = _Block(memo)
    if block.tags:
        yield block


def _super_rows(mask: int):
    def run(batches):
        for block in _blocks(batches):
            if (out := _emit(block, mask)) is not None:
                yield out

    return run


def _window_rows(batches):
    """The windows of candidate rows, each with a 128-bit name."""
    memo: dict[bytes, int] = {}
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("doc", "check", "text", "places")]
        held = _Block(memo)
        wanted = []
        for doc, check, text, places in zip(*cols, strict=True):
            held.add((doc, check), text.split())
            wanted.append(np.array(places, np.int64))
            if held.words >= BLOCK_WORDS:
                yield _windows(held, wanted)
                held, wanted = _Block(memo), []
        if held.tags:
            yield _windows(held, wanted)


def _windows(block: _Block, wanted: list[np.ndarray]) -> pa.RecordBatch:
    words, _, offset, _ = block.joined()
    one, other = window_names(words)[WINDOW], window_names(words, 37)[WINDOW]
    count = np.concatenate(wanted) >> _COUNT & (1 << _HASH - _COUNT) - 1
    who = np.repeat(np.arange(len(wanted)), [len(x) for x in wanted])
    first = np.concatenate(wanted) >> _START
    which = np.repeat(np.arange(len(count)), count)
    start = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    who = who[which]
    at = offset[who] + start
    doc = np.array([t[0] for t in block.tags], np.int64)[who]
    check = np.array([t[1] for t in block.tags], np.int64)[who]
    one, other = one[at], other[at]
    lead = _first_of(name(one, other, 41), doc, start)
    one = np.where(lead, one, name(other, start.astype(_U), 43))
    place = _pack(start, check, 1, np.where(lead, 0, _DUP))
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (one.view(np.int64), other.view(np.int64), doc, place)], ["key", "content", "doc", "place"]
    )


def _cut(batches):
    """Texts without the words that repeated windows cover."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            sizes, removed, kept = [], [], []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                words = text.split()
                if places:
                    place = np.array(places, np.int64)
                    start, count = place >> _START, place >> _COUNT & (1 << _HASH - _COUNT) - 1
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + count + WINDOW - 1, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    left = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                else:
                    left = words
                sizes.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                ["doc", "n_words", "n_removed", "kept"],
            )


_ROW = "key long, content long, doc long, place long"


def _later(by: list[str]):
    """True for rows that start after the first row of their group."""
    order = W.partitionBy(*by).orderBy("doc", "place")
    here = F.struct("doc", F.shiftright("place", _START).alias("start"))
    return here > F.first(here).over(order)


def repeated_windows(docs: DataFrame, dealt: DataFrame, key_bits: int = 64) -> DataFrame:
    """``(doc, check, place)`` of all windows of ``docs(doc, check, text)`` that occur earlier.

    ``place`` packs the first word and the number of consecutive windows. ``dealt`` has
    the same rows, partitioned by document for joins; the first pass reads ``docs`` as
    they are stored. Fewer ``key_bits`` make keys collide, which costs time and changes nothing.
    """
    rows = docs.mapInArrow(_super_rows((1 << key_bits) - 1), _ROW)
    settled = F.col("place").bitwiseAND(_DUP) == _DUP
    per_key = W.partitionBy("key")
    marked = rows.select(
        "*",
        (settled | _later(["key", "content"])).alias("repeat"),
        (F.min("content").over(per_key) != F.max("content").over(per_key)).alias("mixed"),
    )
    marked = materialize(marked.where("repeat or mixed").select("doc", "place", "repeat"), "repeats")
    check = F.shiftright("place", _HASH).bitwiseAND((1 << _START - _HASH) - 1).alias("check")
    found = marked.where("repeat").select("doc", check, "place")
    unsure = marked.where("not repeat").groupBy("doc", check).agg(F.collect_list("place").alias("places"))
    windows = dealt.join(unsure, ["doc", "check"]).select("doc", "check", "text", "places").mapInArrow(_window_rows, _ROW)
    windows = windows.select("*", (settled | _later(["key", "content"])).alias("repeat"))
    return found.unionByName(windows.where("repeat").select("doc", check, "place"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept`` (bytes of the kept text).

    Every word covered by a 20-word window whose words also start at a smaller
    (id, word) place goes; windows are judged on the input. Kept words are joined by
    one space. A null text has no words; a null id is the smallest. Rows that share an
    id share its place in the order: a window at the same word of both removes neither.
    An empty table gives an empty result; other columns are ignored. Texts may have up to
    2**35 words; each is held whole by one task.
    """
    text = text_of(text_col).cast("binary")
    check = F.xxhash64(text).bitwiseAND((1 << _START - _HASH) - 1)
    rows = docs.select(id_of(id_col).alias("doc"), check.alias("check"), text.alias("text"))
    dealt = rows.repartition("doc", "check")
    found = repeated_windows(rows, dealt, key_bits).groupBy("doc", "check").agg(F.collect_list("place").alias("places"))
    out = dealt.join(found, ["doc", "check"], "left").select("doc", "text", "places")
    cut = out.mapInArrow(_cut, "doc long, n_words long, n_removed long, kept binary")
    return cut.select(id_back("doc").alias("doc_id"), "n_words", "n_removed", "kept")
