"""Phrase collocations by HAT-trie counting.

A task counts in a trie over its own word ids. Its first level are hash containers for
blocks of first words; a container that grows bursts into one for each first word, and that
into one for each second word. A path is entered once for each position of a text, so the
count of a phrase is the sum of its subtree. Beyond a limit of entries the largest
subtrees are spilled whole, as runs sorted by word id, with an entry for each pair of first
words; a row holds a run's entries of one bucket, a hash of the pair. Spark brings the
rows of a bucket together and merges its prefixes; what stands below a rare pair of words is
rare and never unpacked.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxelar.plans.cut import materialize

from ._common import text_of
from .packing import stretches

#: Containers burst beyond this many entries; a task's tries spill beyond so many.
BURST, ENTRIES = 4096, 350_000
#: Positions that are sorted before they enter a trie, and paths of a run that are written at once.
BATCH, CHUNK = 300_000, 100_000
#: Bits of a word id, of its place in a block, and words beyond which a task spills all tries and starts a new vocabulary.
BITS, BLOCK, WORDS = 21, 6, 1 << 18
LEAST, TOP, COVERED = 10, 2000, 50
#: Buckets a shuffle partition, and parts of a language's phrases, which are ranked before the parts are ranked together.
BUCKETS, SALTS = 8, 64
ROWS = 512

_MASK = (1 << BITS) - 1
_TAIL = (1 << 2 * BITS) - 1
# Fixed by the data contract: what ends a piece. ASCII white space that is left separates words.
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"." * 10)


class HatTrie:
    """Counts of word-id paths of one to three words, packed as ``first << 42 | second << 21 | third`` (0: none).

    A container is a dict of the low bits of its paths. Its name is the prefix of these paths
    shifted by its number of free bits, and both together find it.
    """

    LEVELS = (2 * BITS + BLOCK, 2 * BITS, BITS)  # free bits: a block of first words, a first word, a pair of words

    def __init__(self) -> None:
        self.levels: tuple[dict[int, dict[int, int]], ...] = ({}, {}, {})
        self.burst: tuple[set[int], ...] = (set(), set())
        self.entries = 0

    def add(self, paths: np.ndarray, counts: np.ndarray, level: int = 0) -> None:
        """Enter distinct sorted paths."""
        free = self.LEVELS[level]
        at = np.flatnonzero(np.diff(paths >> free, prepend=-1, append=-1)).tolist()
        names, tails, numbers = (paths >> free).tolist(), (paths & (1 << free) - 1).tolist(), counts.tolist()
        containers = self.levels[level]
        for start, stop in zip(at[:-1], at[1:], strict=True):
            name = names[start]
            if level < 2 and name in self.burst[level]:
                self.add(paths[start:stop], counts[start:stop], level + 1)
                continue
            box = containers.get(name)
            if box is None:
                box = containers[name] = dict(zip(tails[start:stop], numbers[start:stop], strict=True))
                self.entries += len(box)
            else:
                before, get = len(box), box.get
                for tail, n in zip(tails[start:stop], numbers[start:stop], strict=True):
                    box[tail] = get(tail, 0) + n
                self.entries += len(box) - before
            if level < 2 and len(box) > BURST:
                self.burst[level].add(name)
                whole, n = self.take([(level, name)])
                order = np.argsort(whole)
                self.add(whole[order], n[order], level + 1)

    def take(self, subtrees: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Cut off containers; their paths, unsorted, and counts."""
        boxes = [self.levels[level].pop(name) for level, name in subtrees]
        sizes = [len(box) for box in boxes]
        size = sum(sizes)
        self.entries -= size
        names = np.repeat(np.array([name << self.LEVELS[level] for level, name in subtrees], np.int64), sizes)
        tails = np.fromiter(chain.from_iterable(boxes), np.int64, size)
        return names | tails, np.fromiter(chain.from_iterable(box.values() for box in boxes), np.int64, size)

    def sizes(self) -> list[tuple[int, int, int]]:
        """``size, level, name`` of all containers."""
        return [(len(box), level, name) for level, boxes in enumerate(self.levels) for name, box in boxes.items()]


class Counter:
    """Tries of all languages of a task, their common vocabulary, and the positions not yet entered."""

    def __init__(self, buckets: int, entries: int = ENTRIES, batch: int = BATCH, words: int = WORDS) -> None:
        self.buckets, self.limit, self.batch, self.words = buckets, entries, batch, words
        self.tries: dict[str, HatTrie] = {}
        self.waiting: dict[str, list[np.ndarray]] = defaultdict(list)
        self.sizes: dict[str, int] = defaultdict(int)
        self._new_vocabulary()

    def _new_vocabulary(self) -> None:
        self.ids: dict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.hashes = array("Q")
        self.ids[b"."]  # 0 ends a piece: it is no word, as pieces are split there

    def read(self, lang: str, text: str) -> Iterator[pa.RecordBatch]:
        """Enter a whole text; runs that this spills."""
        for part in stretches(text.encode()):
            words = part.lower().translate(_ENDS).replace(b".", b" . ").split()
            ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
            self.waiting[lang].append(ids)
            self.sizes[lang] += len(ids)
            if self.sizes[lang] >= self.batch or len(self.ids) > self.words:
                yield from self._enter(lang, whole=False)
                if len(self.ids) > self.words:
                    yield from self._renew(lang)
        self.waiting[lang].append(np.zeros(1, np.int64))

    def _enter(self, lang: str, whole: bool) -> Iterator[pa.RecordBatch]:
        """Paths of all waiting positions; unless the text is whole the last two wait on."""
        ids = np.concatenate([*self.waiting[lang], np.zeros(2 * whole, np.int64)])
        first, second, third = ids[:-2], ids[1:-1].copy(), ids[2:].copy()
        self.waiting[lang], self.sizes[lang] = [ids[max(0, len(ids) - 2) :]] if not whole else [], 0
        third[second == 0] = 0
        paths = first << 2 * BITS | second << BITS | third
        paths, counts = np.unique(paths[first != 0], return_counts=True)
        self.tries.setdefault(lang, HatTrie()).add(paths, counts)
        if sum(t.entries for t in self.tries.values()) > self.limit:
            yield from self._spill(self.limit // 2)

    def _renew(self, lang: str) -> Iterator[pa.RecordBatch]:
        """A new vocabulary: all is spilled, and the positions that wait get new ids."""
        for other in [x for x in self.waiting if x != lang]:
            yield from self._enter(other, whole=True)
        yield from self._spill(0)
        words = list(self.ids)
        left = [words[i] for i in np.concatenate(self.waiting[lang]).tolist()]
        self._new_vocabulary()
        self.waiting[lang] = [np.array([self.ids[w] for w in left], np.int64)]

    def _spill(self, keep: int) -> Iterator[pa.RecordBatch]:
        """Cut off the largest subtrees until at most ``keep`` entries are left; sorted runs."""
        sizes = [(*x, lang) for lang, trie in self.tries.items() for x in trie.sizes()]
        total, cut = sum(x[0] for x in sizes), defaultdict(list)
        for size, level, name, lang in sorted(sizes, reverse=True):
            if total <= keep:
                break
            cut[lang].append((level, name, size))
            total -= size
        if not cut:
            return
        words = pa.array(list(self.ids), pa.binary()).cast(pa.string())
        self.hashes.extend(map(zlib.crc32, islice(self.ids, len(self.hashes), None)))
        hashes = np.array(self.hashes, np.uint64)
        for lang, subtrees in cut.items():
            parts, size = [], 0
            for n, (level, name, own) in enumerate(subtrees, 1):
                parts.append((level, name))
                size += own
                if size >= CHUNK or n == len(subtrees):
                    yield self._run(lang, words, hashes, *self.tries[lang].take(parts))
                    parts, size = [], 0

    def _run(self, lang: str, words: pa.Array, hashes: np.ndarray, paths: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        """Rows ``bucket, lang, entries`` of one run.

        An entry is ``first second n third n third n ...``, its first number the sum of the
        subtree; second is ``.`` for the first word alone. Entries are parted by line feeds.
        """
        order = np.argsort(paths)
        paths, counts = paths[order], counts[order]
        pair, third = paths >> BITS, paths & _MASK
        first = pair >> BITS
        alone, at = (np.flatnonzero(np.diff(x, prepend=-1)) for x in (first, pair))
        inner = np.flatnonzero(third)
        sizes = np.diff(np.append(np.searchsorted(inner, at), len(inner)))
        sums = np.add.reduceat(counts, at)
        kept = (pair[at] & _MASK) != 0  # a word with none after it counts for itself only
        at, sums, sizes = at[kept], sums[kept], sizes[kept]
        # Tokens: first words, seconds, sums, then thirds and counts in order of the pairs; all words alone before.
        ones, twos = np.append(first[alone], pair[at] >> BITS), np.append(np.zeros(len(alone), np.int64), pair[at] & _MASK)
        numbers = np.append(np.add.reduceat(counts, alone), sums)
        tokens = pa.concat_arrays([words.take(pa.array(np.concatenate([ones, twos, third[inner]]))), pa.array(np.append(numbers, counts[inner])).cast(pa.string())])
        sizes = np.append(np.zeros(len(alone), np.int64), sizes)
        n, m = len(ones), len(inner)
        starts = np.append(0, np.cumsum(2 * sizes + 3))
        taken = np.empty(starts[-1], np.int64)
        rest = np.ones(starts[-1], bool)
        for i, base in enumerate((0, n, 2 * n + m)):
            taken[starts[:-1] + i] = base + np.arange(n)
            rest[starts[:-1] + i] = False
        taken[rest] = (np.arange(m)[:, None] + [2 * n, 3 * n + m]).ravel()
        entries = pc.binary_join(pa.ListArray.from_arrays(starts.astype(np.int32), tokens.take(pa.array(taken))), " ")
        mixed = (hashes[ones] * np.uint64(0x9E3779B97F4A7C15) + hashes[twos] + np.uint64(zlib.crc32(lang.encode()))) * np.uint64(0xD6E8FEB86659FD93)
        bucket = ((mixed >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        joined = pc.binary_join(pa.ListArray.from_arrays(np.append(at, n).astype(np.int32), entries.take(pa.array(order))), "\n")
        langs = pa.array([lang]).take(pa.array(np.zeros(len(at), np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(bucket[order][at]), langs, joined], ["bucket", "lang", "entries"])

    def rest(self) -> Iterator[pa.RecordBatch]:
        for lang in list(self.waiting):
            yield from self._enter(lang, whole=True)
        yield from self._spill(0)


def runs(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Sorted runs of all tasks' tries: ``bucket, lang, entries``."""
    source = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches):
        counter = Counter(buckets)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield from counter.read(lang, text)
        yield from counter.rest()

    return source.mapInArrow(count, "bucket int, lang string, entries string")


def phrase_counts(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, first, second, third, a``: all words, and the phrases of two and three words found ``least`` times or more.

    Missing words are null. Runs are moved once, by bucket; pairs and triples are merged
    under that partitioning, so a frequent first word is spread over many tasks.
    """
    entries = runs(docs, text_col, lang_col).repartition("bucket").select("bucket", "lang", F.explode(F.split("entries", "\n")).alias("entry"))
    prefix = F.substring_index("entry", " ", 2)
    entries = entries.select("bucket", "lang", prefix.alias("prefix"), F.substr("entry", F.length(prefix) + 2).alias("tail"))
    # The name comes first: rows are sorted by it, and numbers sort faster than texts.
    key = [F.xxhash64("lang", "prefix"), "bucket", "lang", "prefix"]
    totals = entries.withColumn("total", F.sum(F.substring_index("tail", " ", 1).cast("long")).over(W.partitionBy(*key)))
    alone = F.endswith("prefix", F.lit(" ."))
    often = totals.where(alone | (F.col("total") >= least)).withColumn("t", F.split("tail", " "))
    # The first number is the sum of the pair itself, which has no third word.
    one = lambda i: F.struct(F.when(i > 0, F.get("t", i - 1)).alias("third"), F.get("t", i).cast("long").alias("n"))
    every = often.select("bucket", "lang", "prefix", F.explode(F.transform(F.sequence(F.lit(0), F.size("t") - 1, F.lit(2)), one)).alias("x"))
    rows = every.select("bucket", "lang", "prefix", "x.third", "x.n").groupBy("bucket", "lang", "prefix", "third").agg(F.sum("n").alias("a"))
    found = rows.where(alone | (F.col("a") >= least))
    first, second = (F.substring_index("prefix", " ", i) for i in (1, -1))
    return found.select("lang", first.alias("first"), F.when(~alone, second).alias("second"), "third", "a")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts of up to 15 digits."""
    a, left, right = (c.cast("decimal(19,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a * a), left * right)


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the ``top`` strongest phrases of each language.

    Phrases have two or three words of one piece (texts are split at ``.,;:!?`` and line ends)
    and occur ``a`` times, ``least`` or more. ``score`` is floor(10^6 a^2 / (l r)) at the cut
    into parts of ``l`` and ``r`` occurrences where it is lowest, the earliest of equal ones.
    A phrase inside a longer one that has ``covered`` percent of its occurrences or more is
    left out. Ties go by more occurrences, then by the bytes of the phrase.

    A null language is ``und``; null, empty and wordless texts count nothing; repeated rows
    count as often as they are there; texts may be of any length. Other columns are
    ignored. An empty table gives an empty result.
    """
    counts = materialize(phrase_counts(docs, least, text_col, lang_col), "phrases")
    words = counts.where("second is null").select("lang", "first", "a")
    pairs = counts.where("second is not null and third is null").select("lang", "first", "second", "a")
    triples = counts.where("third is not null")
    of_word, of_pair = words.where(F.col("a") >= least), pairs

    def count_of(table: DataFrame, out: str, *names: str) -> DataFrame:
        return table.select("lang", *[F.col(x).alias(y) for x, y in zip(("first", "second"), names, strict=False)], F.col("a").alias(out))

    longer = triples.select("lang", "first", "second", "a").unionByName(count_of(triples.drop("first").withColumnsRenamed({"second": "first", "third": "second"}), "a", "first", "second"))
    longest = longer.groupBy("lang", "first", "second").agg(F.max("a").alias("longer"))
    alone = pairs.join(longest, ["lang", "first", "second"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    two = alone.join(count_of(of_word, "l", "first"), ["lang", "first"]).join(count_of(of_word, "r", "second"), ["lang", "second"])
    two = two.select("lang", F.concat_ws(" ", "first", "second").alias("phrase"), "a", _cut(1, "l", "r").alias("cut"))
    three = (
        triples.join(count_of(of_pair, "l2", "first", "second"), ["lang", "first", "second"])
        .join(count_of(of_pair, "r1", "second", "third"), ["lang", "second", "third"])
        .join(count_of(of_word, "l1", "first"), ["lang", "first"])
        .join(count_of(of_word, "r2", "third"), ["lang", "third"])
    )
    weakest = F.array_min(F.array(_cut(1, "l1", "r1"), _cut(2, "l2", "r2")))
    three = three.select("lang", F.concat_ws(" ", "first", "second", "third").alias("phrase"), "a", weakest.alias("cut"))
    scored = two.unionByName(three).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    strongest = [F.desc("score"), F.desc("a"), "phrase"]
    some = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*strongest)
    scored = scored.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    scored = scored.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*strongest))).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    return scored.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _cut(k: int, left: str, right: str) -> Column:
    score = _score(F.col("a"), F.col(left), F.col(right))
    return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
