"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut at safe boundaries of the split pattern. A match always starts at white
space that follows another character. A run of white space before a character is two
matches, all but its last character and that last one (with what follows); one at the end
of a text is a single match. Long runs are cut there and encoded without the pattern, whose
engine walks back over such a run on its stack. So the ids are those of the whole text while
the library never matches more than one piece.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import fresh, text_of, vocabulary

#: The split pattern of the rank files (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = "byte_bpe_50k.tiktoken"
PIECE_CHARS = 1 << 16
ROWS = 512

# What the pattern's engine takes for white space (not Python's set, which has four controls more).
_SPACE = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
#: Runs of white space beyond this are matched by hand.
RUN_CHARS = 4096

_SAFE = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")
_RUN = re.compile(f"[{_SPACE}]{{{RUN_CHARS},}}")


@functools.lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    """The encoding of a rank file, loaded once per Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut only where a new match must start."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def spans(text: str) -> Iterator[tuple[str, bool]]:
    """``text`` in parts; True for a part that is one match of the pattern, a long run of white space."""
    at = 0
    for run in _RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        if at < run.start():
            yield text[at : run.start()], False
        yield text[run.start() : end], True
        at = end
    if at < len(text):
        yield text[at:], False


def encode_text(enc: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of a whole text of any length."""
    if len(text) < RUN_CHARS:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part, single in spans(text):
        if single:
            ids += enc._encode_single_piece(part)  # the library's byte pair merge without its pattern
            continue
        for piece in pieces(part):
            ids += enc.encode_ordinary(piece)
    return ids


def encode(df: DataFrame, text_col: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` without the text, with its token ids as ``out`` (array of int).

    A null text encodes as the empty text, to an empty array. A column already called
    ``out`` is replaced. Rows keep their order and number, repeated rows included.
    """
    path = path or vocabulary(RANKS)
    text = fresh(df, "_text")
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (text_col, out)]
    source = df.select(*rest, text_of(text_col).alias(text))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(out, T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        enc = encoding(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids = pa.array([encode_text(enc, t) for t in batch.column(text).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*batch.schema.names[:-1], out])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the raw bytes of its ids as ``out``; null ids give null.

    Bytes are returned as they are: a slice of ids may end inside a UTF-8 sequence.
    """
    path = path or vocabulary(RANKS)
    source = df.select(*[F.col(f"`{c}`") for c in df.columns if c != out])
    schema = T.StructType([*source.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches):
        enc = encoding(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids = batch.column(batch.schema.names.index(ids_col)).to_pylist()
                raw = pa.array([None if x is None else enc.decode_bytes(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, raw], [*batch.schema.names, out])

    return source.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's digests: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    One row per row of ``docs``, repeated rows included. A null or empty text has no ids
    and the digests of nothing; a null id stays null; texts may be of any length and
    shape. Other columns are ignored. An empty table gives an empty result.
    """
    coded = decode(encode(docs.select("doc_id", "text"), path=path), path=path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
