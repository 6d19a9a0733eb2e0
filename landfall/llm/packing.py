"""Packing by power-of-two decomposition.

A document of n tokens (its ids, then the end id) is cut into pieces whose lengths are
the powers of two of n in binary, whole sequences of ``limit`` tokens first. Each piece
is a sequence of its own, so no sequence crosses documents and none is padded. Pieces of
equal length form a bucket: :func:`bucketed` brings them together, so that a batch is
filled from one bucket, and :func:`write_buckets` stores a folder for each.

Documents are tokenized where they are read. Sequence numbers are the read task's number
and the piece's place in it, so a lost task that runs again numbers alike. There are few
buckets (log2 of ``limit``, and one) and some hold most pieces: the shuffle by bucket is a
rebalance, whose large partitions adaptive execution splits, so a bucket is many tasks.

Defined cases: null or empty text is the end id alone, one piece of length 1; repeated
rows are packed like any others; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = ("doc_id long, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long")

# Fixed value: the splitting pattern of the byte-level vocabulary.
PATTERN = (r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the others for letters from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encoder(path: str):
    """Text to ids of the byte-level vocabulary in the tokenizers file at ``path``.

    The same merges run about four times faster in tiktoken, whose ranks are the ids of
    that file; texts that hold one of its special tokens go to tokenizers itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec["added_tokens"]]
    byte = byte_letters()
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(path)

    def encode(text: str) -> list[int]:
        if any(t in text for t in special):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)
    return encode


def pieces(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the power-of-two pieces of ``n`` tokens, longest first."""
    out, start = [], 0
    while n - start >= limit:
        out.append((start, limit))
        start += limit
    bit = limit >> 1
    while bit:
        if (n - start) & bit:
            out.append((start, bit))
            start += bit
        bit >>= 1
    return out


def decompose(docs: DataFrame, tokenizer_path: str, limit: int = 1024, end_id: int = 0,
              with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (null unless ``with_ids``),
    ids_crc32 (of the ids as little-endian 32-bit numbers), doc_tokens, sequence_id,
    offset (0: a piece is a sequence) and bucket. ``limit`` must be a power of two."""
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids", "crc", "n")}
            size = 0
            for at in range(len(ids)):
                text = texts[at].as_py() or ""
                got = np.asarray(encode(text) + [end_id], dtype="<u4")
                for start, length in pieces(len(got), limit):
                    piece = got[start:start + length]
                    rows["doc_id"].append(ids[at])
                    rows["start"].append(start)
                    rows["length"].append(length)
                    rows["ids"].append(piece.astype(np.int32) if with_ids else None)
                    rows["crc"].append(zlib.crc32(piece.tobytes()))
                    rows["n"].append(len(got))
                size += len(got)
                if size > 2_000_000 or at == len(ids) - 1:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(rows["doc_id"], pa.int64()), pa.array(rows["start"], pa.int64()),
                        pa.array(rows["length"], pa.int64()), pa.array(rows["ids"], pa.list_(pa.int32())),
                        pa.array(rows["crc"], pa.int64()), pa.array(rows["n"], pa.int64())],
                        names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens"])
                    rows, size = {k: [] for k in rows}, 0

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
    return cut.withColumn("sequence_id", F.monotonically_increasing_id()).withColumns(
        {"offset": F.lit(0).cast("long"), "bucket": F.log2("length").cast("int")})


def bucketed(pieces: DataFrame) -> DataFrame:
    """The pieces with those of one bucket (the logarithm of their length) together; large
    buckets are split over several partitions."""
    return pieces.hint("rebalance", "bucket").sortWithinPartitions("bucket")


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Store pieces in a folder per bucket, from which batches of one length are read."""
    bucketed(pieces).write.partitionBy("bucket").parquet(path)
