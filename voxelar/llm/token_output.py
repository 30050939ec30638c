"""Training-order materialisation of token ids in binary shards.

Every document's ids, ended by a separator, fill sequences of a fixed length. One pass
counts the sequences of every file split; running sums give each split the rank of its
first sequence and the exact total. A second pass encodes, ranks its sequences on from
there, and a keyed Feistel network with cycle-walking over the exact total gives each its
global slot. Equal ranges of slots are shards, written in order: every file but the last
has the same number of records of the same size, so a slot's file and offset are a
division, and a reader may start, stop and resume at any slot.

The order is a function of the key, the files and their rows. Ranks follow the stored
row index, which is checked, so they do not depend on how rows reach a task, on split
sizes or on retries. Texts are encoded twice, as kept ids would take more disk than that
saves; they are not shuffled.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxelar.plans.cut import broadcast_if_small, materialize, new_path
from voxelar.plans.session import small_batches

from ._common import id_back, id_of, text_of, vocabulary
from .bpe import RANKS, encode_text, encoding

LENGTH = 256
SEPARATOR = 50256
#: Records of a shard: at least so many, and so many more that there are no more than so many shards.
SHARD_RECORDS = 1 << 16
MAX_SHARDS = 100_000
#: Splits whose ranks are broadcast, 16 bytes each; beyond it rows are joined by shuffle and sorted.
SPLIT_ROWS = 4_000_000
ROUNDS = 6
KEY = 2024
#: Texts encoded at once, records read at once.
BATCH, READ = 256, 4096


def feistel(ranks: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of 0 .. total - 1: a balanced Feistel network walked until inside."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = ranks.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for r in range(ROUNDS):
            f = right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64))
            f ^= f >> np.uint64(30)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(27)
            f *= np.uint64(0x94D049BB133111EB)
            f ^= f >> np.uint64(31)
            left, right = right, left ^ (f & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(total)]
    return out.astype(np.int64)


def _count(path: str, length: int):
    """Sequences of texts, summed over each batch by split."""

    def run(batches):
        enc = encoding(path)
        for whole in batches:
            found: dict[int, int] = {}
            for at in range(0, whole.num_rows, BATCH):
                part = whole.slice(at, BATCH)
                for split, text in zip(part.column("split").to_pylist(), part.column("text").to_pylist(), strict=True):
                    found[split] = found.get(split, 0) + len(encode_text(enc, text)) // length + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["split", "n"])

    return run


def _sequences(path: str, length: int, total: int, key: int):
    """The sequences of texts with their slots. The rows of a split must come together, in order of row."""

    def run(batches):
        enc = encoding(path)
        now, last, rank = None, -1, 0
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                ids = [encode_text(enc, t) for t in batch.column("text").to_pylist()]
                n = np.array([len(x) + 1 for x in ids], np.int64)
                count = (n + length - 1) // length
                first = np.empty(len(ids), np.int64)
                keys = [batch.column(c).to_pylist() for c in ("split", "base", "row")]
                for i, (split, base, row) in enumerate(zip(*keys, strict=True)):
                    if split != now:
                        now, last, rank = split, -1, base
                    if row <= last:
                        raise ValueError("rows of a split are out of order")
                    first[i], last = rank, row
                    rank += int(count[i])
                begin = np.cumsum(count) - count
                flat = np.full(int(count.sum()) * length, SEPARATOR, "<u2")
                for x, b in zip(ids, begin * length, strict=True):
                    flat[b : b + len(x)] = x
                owner = np.repeat(np.arange(len(ids)), count)
                part = np.arange(len(owner)) - begin[owner]
                offsets = np.arange(0, 2 * len(flat) + 1, 2 * length, dtype=np.int32)
                blobs = pa.BinaryArray.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
                columns = [
                    pa.array(feistel(first[owner] + part, total, key)),
                    batch.column("doc").take(pa.array(owner)),
                    pa.array(part.astype(np.int32)),
                    pa.array(np.minimum(length, n[owner] - part * length).astype(np.int32)),
                    blobs,
                ]
                yield pa.RecordBatch.from_arrays(columns, ["slot", "doc", "part", "n_ids", "ids"])

    return run


# A record's place in the index file beside its shard: document, part and ids that are not padding.
_ENTRY = np.dtype([("doc", "<i8"), ("part", "<i4"), ("n_ids", "<i4")])


def _name(shard: int) -> str:
    return f"{shard:08d}"


def _writer(folder: str, records: int):
    """Write shards from records in order of slot; finished files appear under their names at once."""

    def run(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        shard, outs, temporary, done = None, [], [], 0

        def finish():
            for out, name, end in zip(outs, temporary, ("idx", "bin"), strict=True):
                out.close()
                fs.move(name, f"{root}/{_name(shard)}.{end}")
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([done], pa.int64())], ["shard", "records"])

        for batch in batches:
            slots = batch.column("slot").to_numpy()
            cuts = np.append(np.nonzero(np.append(True, slots[1:] // records != slots[:-1] // records))[0], len(slots))
            entries = np.empty(len(slots), _ENTRY)
            for c in _ENTRY.names:
                entries[c] = batch.column(c).to_numpy()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if slots[a] // records != shard:
                    if outs:
                        yield finish()
                    shard, done = int(slots[a] // records), 0
                    fs.create_dir(root, recursive=True)
                    temporary = [f"{root}/.{_name(shard)}-{uuid.uuid4().hex}" for _ in range(2)]
                    outs = [fs.open_output_stream(t) for t in temporary]
                if not np.array_equal(slots[a:b] - shard * records, np.arange(done, done + b - a)):
                    raise ValueError(f"shard {shard} has missing or repeated slots")
                outs[0].write(entries[a:b].tobytes())
                outs[1].write(b"".join(batch.column("ids").slice(a, b - a).to_pylist()))
                done += b - a
        if outs:
            yield finish()

    return run


def _bases(counts: DataFrame) -> DataFrame:
    """``(split, base)``: sequences before each split in file order; a row per file is sorted in one task."""
    files = counts.groupBy("file").agg(F.sum("n").alias("n"))
    before = W.partitionBy(F.lit(0)).orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    base = F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return counts.join(files, "file").select("split", base.cast("long").alias("base"))


def _layout(folder: str, layout: dict | None = None) -> dict | None:
    """Write the folder's layout, or read it."""
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    if layout is None:
        with fs.open_input_stream(f"{root}/layout.json") as f:
            return json.loads(f.read())
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/layout.json") as f:
        f.write(json.dumps(layout).encode())
    return None


def write_shards(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    records: int | None = None,
    key: int = KEY,
    path: str | None = None,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Write all sequences to ``folder`` (a URI) and return ``(shard, records)``.

    ``docs`` is best a plain Parquet scan, whose files and rows give the ranks; anything
    else is written to shared storage first. A null or empty text is one sequence of
    separators; a null id is kept as the least long; repeated rows are sequences of their
    own; other columns are ignored; an empty table writes no shard.
    """
    path = path or vocabulary(RANKS)
    spark = small_batches(docs.sparkSession)
    meta = [F.col(f"_metadata.{c}").alias(f"_{c}") for c in ("file_path", "file_block_start", "row_index")]
    try:
        rows = docs.select(id_of(id_col).alias("doc"), text_of(text_col).alias("text"), *meta)
    except Exception as e:  # not a Parquet scan
        if "_metadata" not in str(e) and "row_index" not in str(e):
            raise
        docs = materialize(docs.select(id_of(id_col).alias("doc"), text_of(text_col).alias("text")), "documents")
        rows = docs.select("doc", "text", *meta)
    split = F.xxhash64("_file_path", "_file_block_start").alias("split")
    splits = materialize(rows.select(split, F.col("_file_path").alias("file"), F.col("_file_block_start").alias("start")).distinct(), "splits")
    counted = rows.select(split, "text").mapInArrow(_count(path, length), "split long, n long")
    counts = materialize(splits.join(counted.groupBy("split").agg(F.sum("n").alias("n")), "split"), "counts")
    total, names, hashes = counts.agg(F.sum("n"), F.count("*"), F.count_distinct("split")).first()
    if names != hashes:
        raise ValueError("two splits share a name")
    records = records or max(SHARD_RECORDS, -(-(total or 0) // MAX_SHARDS))
    _layout(folder, {"length": length, "records": records, "total": total or 0, "key": key})
    if not total:
        return spark.createDataFrame([], "shard int, records long")
    bases = materialize(_bases(counts), "bases")
    few = bases.limit(split_rows + 1).count() <= split_rows
    placed = rows.select(split, "doc", "text", F.col("_row_index").alias("row")).join(F.broadcast(bases) if few else bases.hint("merge"), "split")
    if not few:
        placed = placed.sortWithinPartitions("split", "row")
    found = placed.mapInArrow(_sequences(path, length, total, key), "slot long, doc long, part int, n_ids int, ids binary")
    found = found.withColumn("shard", F.floor(F.col("slot") / records).cast("int"))
    dealt = found.repartitionById(-(-total // records), "shard").sortWithinPartitions("slot").drop("shard")
    return materialize(dealt.mapInArrow(_writer(folder, records), "shard int, records long"), "shards")


def read_shards(spark: SparkSession, folder: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """``(slot, doc, part, n_ids, ids)`` of the slots from ``start`` up to ``stop``, in order within a task.

    Tasks seek to their slots, so only wanted records are read.
    """
    layout = _layout(folder)
    length, records, total = (layout[k] for k in ("length", "records", "total"))
    stop = total if stop is None else min(stop, total)
    stride = 2 * length

    def run(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for chunk in batch.column("id").to_pylist():
                at, end = max(start, chunk * READ), min(stop, (chunk + 1) * READ)
                while at < end:
                    shard, skip = divmod(at, records)
                    n = min(end - at, records - skip)
                    raw = []
                    for kind, size in (("bin", stride), ("idx", _ENTRY.itemsize)):
                        with fs.open_input_file(f"{root}/{_name(shard)}.{kind}") as f:
                            raw.append(f.read_at(n * size, skip * size))
                    entries = np.frombuffer(raw[1], _ENTRY, n)
                    offsets = np.arange(0, n * stride + 1, stride, dtype=np.int32)
                    ids = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw[0])])
                    columns = [pa.array(np.arange(at, at + n)), *[pa.array(np.ascontiguousarray(entries[c])) for c in _ENTRY.names], ids]
                    yield pa.RecordBatch.from_arrays(columns, ["slot", *_ENTRY.names, "ids"])
                    at += n

    low, high = start // READ, max(start // READ, -(-stop // READ))
    chunks = spark.range(low, high, 1, max(1, min(100_000, (high - low + 7) // 8)))
    return chunks.mapInArrow(run, "slot long, doc long, part int, n_ids int, ids binary")


def materialised_order(docs: DataFrame) -> DataFrame:
    """Write the shards, read them back and give one row per sequence with its place and digest.

    ``slot, shard, offset, doc_id, part, n_ids, ids_sha256``; rows as in ``write_shards``,
    where a null id comes back as null. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "shards")
    write_shards(docs, folder)
    records = _layout(folder)["records"]
    return read_shards(spark, folder).select(
        "slot",
        F.floor(F.col("slot") / records).cast("int").alias("shard"),
        (F.col("slot") % records * 2 * LENGTH).alias("offset"),
        id_back("doc").alias("doc_id"),
        F.col("part").cast("long").alias("part"),
        F.col("n_ids").cast("long").alias("n_ids"),
        F.sha2("ids", 256).alias("ids_sha256"),
    )
