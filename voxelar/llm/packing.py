"""Best-fit decreasing packing of token sequences.

Best-fit decreasing treats pieces of equal length alike, so it runs on the histogram of
lengths, which has as many entries as a sequence has tokens whatever the corpus: a segment
tree over remaining capacities finds the tightest open sequence, and a run of equal pieces
fills all sequences of that capacity at once. The result is that of the algorithm over every
single piece. What it decides are ranges of ranks within a length; Spark ranks the pieces
and each finds its range by a binary search.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from tokenizers import Tokenizer

from voxelar.plans.cut import materialize

from ._common import text_of, vocabulary

VOCABULARY = "word_bpe_49k.json"
CAPACITY, END = 4096, 1
ROWS = 512
#: Words whose ids a Python worker remembers, twice; longer words are never remembered.
REMEMBERED, WORD_BYTES = 300_000, 48
#: Pieces of one length that a task ranks, about, were all of equal length.
LOT = 100_000
STRETCH = 1 << 20

#: How the vocabulary splits normalized text (a fixed value; a vocabulary without it gets whole words).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Characters beyond ASCII and the letters of Latin-1; without them a text is plain.
_OTHER = re.compile("[^\\x00-\\x7FÀ-ÖØ-öø-ÿ]")
#: ``PATTERN`` on words of plain text in lower case, where bytes beyond ASCII are those of letters.
_MATCH = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xFF]+|[0-9]|[^\x20\x09-\x0Da-z0-9\x80-\xFF]+")


def stretches(text: bytes, size: int = STRETCH) -> Iterator[bytes]:
    """``text`` in parts of about ``size`` bytes, cut before ASCII white space, so that no list of words grows with a text."""
    at = 0
    while len(text) - at > size and (space := _SPACE.search(text, at + size)):
        yield text[at : space.start()]
        at = space.start()
    yield text[at:]


class Ids(dict):
    """The ids of a word (bytes without ASCII white space) as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never joins what it separates, so a text's ids are
    those of its words one after another. A plain text, which the normalizer only lower-cases,
    is lower-cased here and its new words are taken apart into the matches of the vocabulary's
    pattern, so that what differs in case or marks is encoded once. Recent words are kept in two
    generations; what is new in a text is encoded together.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.old: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            self.splits = json.dumps(PATTERN) in f.read()

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of every word; in the joined text an id belongs to the word in which its characters start."""
        texts = [word.decode() for word in words]
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        after = np.cumsum([len(text) + 1 for text in texts])
        ends = (4 * np.searchsorted([start for start, _ in found.offsets], after)).tolist()
        raw = np.array(found.ids, "<u4").tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, words: set[bytes], plain: bool) -> dict[bytes, bytes]:
        """The ids of ``words``, which are remembered from now on, and of their matches."""
        found, parts = {}, {}
        for word in words:
            if ids := self.old.get(word):
                found[word] = ids
            else:
                parts[word] = _MATCH.findall(word) if plain else [word]
        new = []
        for part in set(itertools.chain.from_iterable(parts.values())).difference(found):
            if ids := self.get(part) or self.old.get(part):
                found[part] = ids
            else:
                new.append(part)
        if new:
            found.update(zip(new, self.encode(new), strict=True))
        found.update([(word, b"".join([found[part] for part in own])) for word, own in parts.items() if len(own) > 1])
        if len(self) + len(found) > REMEMBERED:
            self.old = dict(self)
            self.clear()
        self.update([(word, ids) for word, ids in itertools.islice(found.items(), REMEMBERED) if len(word) <= WORD_BYTES])
        return found

    def of(self, text: str) -> bytes:
        plain = self.splits and not _OTHER.search(text)
        out = []
        for part in stretches((text.lower() if plain else text).encode()):
            words = part.split()
            ids = list(map(self.get, words))
            if unknown := {word for word, x in zip(words, ids, strict=True) if x is None}:
                found = self.learn(unknown, plain)
                ids = [found[word] if x is None else x for word, x in zip(words, ids, strict=True)]
            out.append(b"".join(ids))
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    """Loaded once per Python worker."""
    return Ids(path)


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, path: str | None = None, ids: bool = True
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, lot`` and ``ids`` (array of int) of every document's pieces.

    A document is the ids of its whole text, a null one as the empty one, and ``end``.
    Those with more than ``capacity`` ids are cut into pieces of that length, the last may be
    shorter. ``lot`` is a number that spreads pieces whatever their ids. Null and repeated
    ids stay as they are; an empty table has no pieces; other columns are ignored.
    """
    path = path or vocabulary(VOCABULARY)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, lot long" + (", ids array<int>" if ids else "")

    def cut(batch: pa.RecordBatch, known: Ids, first: int) -> pa.RecordBatch:
        rows: list[tuple] = []
        parts: list[bytes] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            whole = known.of(text) + end.to_bytes(4, "little")
            for n, at in enumerate(range(0, len(whole), 4 * capacity)):
                part = whole[at : at + 4 * capacity]
                rows.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part), first + len(rows)))
                parts.append(part)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "lot"]
        columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        if ids:
            ends = np.cumsum([0, *[len(x) // 4 for x in parts]], dtype=np.int32)
            columns.append(pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(parts), "<i4")))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        known, first = ids_of(path), 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                out = cut(whole.slice(at, ROWS), known, first)
                first += out.num_rows
                yield out

    return source.mapInArrow(run, schema)


class Tree:
    """How many open sequences have each remaining capacity; the smallest one that is enough in logarithmic time."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, remaining: int, count: int) -> None:
        at = remaining + self.leaves
        while at:
            self.open[at] += count
            at //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of ``least`` or more that an open sequence has."""
        at = least + self.leaves
        while not self.open[at]:
            while at & 1:  # a right child: its parent has nothing further right
                at //= 2
                if at <= 1:
                    return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.leaves


class Range(NamedTuple):
    """Pieces ``first`` and on of a length go to sequences ``sequence`` and on, ``each`` to a sequence, from ``offset``."""

    length: int
    first: int
    sequence: int
    each: int
    offset: int


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[Range]:
    """Where best-fit decreasing puts the pieces of every length (1 to ``capacity``), given how many there are.

    A sequence that has room for several pieces of a length becomes the tightest one with
    the first of them, so it takes them all. Equal sequences have consecutive numbers.
    """
    tree, at_hand, ranges, opened = Tree(capacity), {}, [], 0
    for length in sorted(histogram, reverse=True):
        done, count = 0, histogram[length]

        def fill(sequence: int, sequences: int, each: int, remaining: int) -> None:
            nonlocal done
            ranges.append(Range(length, done, sequence, each, capacity - remaining))
            done += sequences * each
            if left := remaining - each * length:
                tree.add(left, sequences)
                at_hand.setdefault(left, []).append((sequence, sequences))

        while done < count:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, sequence, sequences = capacity, opened, -(-(count - done) // (capacity // length))
                opened += sequences
            else:
                sequence, sequences = at_hand[remaining].pop()
                tree.add(remaining, -sequences)
            each = remaining // length
            full = min(sequences, (count - done) // each)
            if full:
                fill(sequence, full, each, remaining)
            if full < sequences and done < count:
                fill(sequence + full, 1, count - done, remaining)
                full += 1
            if full < sequences:
                tree.add(remaining, sequences - full)
                at_hand.setdefault(remaining, []).append((sequence + full, sequences - full))
    return ranges


def pack(parts: DataFrame, capacity: int = CAPACITY, lot: int = LOT) -> DataFrame:
    """``parts`` without ``lot``, with ``sequence_id`` and ``offset`` (long): every piece's place, without gaps.

    ``parts`` has ``length`` (1 to ``capacity``) and ``lot`` and should be stored, as it is
    read three times. Pieces are ranked within their length and lot, so neither equal
    lengths nor repeated rows meet in one task. The driver gets one count for each length. An
    empty table gives an empty result.
    """
    lots = max(64, -(-parts.count() // lot))
    dealt = parts.withColumn("lot", F.pmod(F.xxhash64("lot", "ids_crc32"), F.lit(lots)))
    counts = materialize(dealt.groupBy("length", "lot").agg(F.count("*").alias("n")), "lengths")
    before = W.partitionBy("length").orderBy("lot").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("length", "lot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    ranges = best_fit_decreasing(histogram, capacity)
    if not ranges:
        ranges = [Range(capacity, 0, 0, 1, 0)]
    table = np.array(sorted(ranges), np.int64)
    stride = max(histogram.values(), default=0) + 1
    starts = table[:, 0] * stride + table[:, 1]
    kept = [c for c in parts.columns if c != "lot"]
    order = W.partitionBy("length", "lot").orderBy(*[c for c in ("doc_id", "piece", "ids_crc32") if c in kept])
    ranked = dealt.withColumn("rank", F.row_number().over(order)).join(bases, ["length", "lot"]).select(*kept, (F.col("base") + F.col("rank") - 1).alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank") + ", sequence_id long, offset long"

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.names.index(c)).to_numpy() for c in ("length", "rank"))
            own = table[np.searchsorted(starts, length * stride + rank, side="right") - 1]
            nth = rank - own[:, 1]
            places = [own[:, 2] + nth // own[:, 3], own[:, 4] + length * (nth % own[:, 3])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, places)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids, offsets``: the training sequences of packed pieces that carry their ids.

    A sequence has at most as many tokens as its capacity, so a group is small whatever the corpus.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, path: str | None = None, ids: bool = False) -> DataFrame:
    """All pieces of ``docs`` with their places, as few sequences of at most ``capacity`` tokens as best-fit decreasing needs."""
    return pack(materialize(pieces(docs, id_col, text_col, capacity, end, path, ids), "pieces"), capacity)
