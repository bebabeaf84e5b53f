"""Operator 1, token-id output: canonical length-limited Huffman coding.

`write_ids` encodes each text, counts every id of the corpus, and writes the ids
in ascending doc_id order as Parquet rows that each hold one independent block:

    part, seq      place of the block in the file
    part_start     ids of the same part before the block
    n_ids          ids in the block
    doc_ids        int64, little-endian, one a document (null_docs: those that are null)
    doc_lens       uint32, little-endian, ids of each document
    checkpoints    uint64, little-endian, bit offset of every `STEP`-th id
    bits           code words, high bit first, padded with 4 zero bytes

The code table (id, length) is a second Parquet folder; canonical codes follow
from the lengths. `read_ids` decodes with one table look-up an id, all
checkpoints of a block side by side.

Defined cases: null text is the empty text, which still gets the end id; an empty
table gives an empty file; equal doc_ids are kept as separate documents, ordered by
length and ids; null doc_ids come first; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, saved, text_or_empty
from .encoding import encoder

#: Longest code word in bits; 2**16 is more than the ids of the vocabulary.
MAX_BITS = 16
#: Ids between two checkpoints.
STEP = 256
#: Ids after which a block is closed.
BLOCK_IDS = 1_000_000

_ENCODED = "doc_id long, n_tokens long, ids binary, counts binary"
_BLOCKS = "part int, seq int, part_start long, n_ids long, null_docs binary, doc_ids binary, doc_lens binary, checkpoints binary, bits binary"


# --- the code ---------------------------------------------------------------


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most max_bits for the symbols with a count, by
    package-merge; 0 for the others."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols have no code of {max_bits} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    packages, leaf_masks = np.empty(0), []
    for _ in range(max_bits):
        merged = np.concatenate([weights, packages])
        order = np.argsort(merged, kind="stable")
        leaf_masks.append(order < n)
        merged = merged[order]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    take, of_leaf = 2 * n - 2, np.zeros(n, np.int64)
    for mask in reversed(leaf_masks):
        leaves = int(mask[:take].sum())
        of_leaf[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[used] = of_leaf
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code words by (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    code, last = 0, 0
    steps = lengths[order].tolist()
    for symbol, length in zip(order.tolist(), steps, strict=True):
        code <<= length - last
        codes[symbol] = code
        code, last = code + 1, length
    return codes


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The code words of ids one after another, and each id's bit offset."""
    size = lengths[ids]
    ends = np.cumsum(size)
    at = ends - size
    total = int(ends[-1]) if len(ids) else 0
    words = np.zeros((total >> 5) + 2, np.uint32)
    if len(ids):
        shifted = codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
        word = at >> 5
        firsts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        merged = np.bitwise_or.reduceat(shifted, firsts)
        words[word[firsts]] |= (merged >> np.uint64(32)).astype(np.uint32)
        words[word[firsts] + 1] |= (merged & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return words.astype(">u4").tobytes()[: (total + 7) // 8] + b"\0\0\0\0", at


def decode_table(lengths: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, length) for each value of the next max_bits bits."""
    codes = canonical_codes(lengths).astype(np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    room = 1 << (max_bits - lengths[order])
    symbols = np.zeros(1 << max_bits, np.uint32)
    sizes = np.full(1 << max_bits, max_bits, np.int64)
    filled = int(room.sum())
    symbols[:filled] = np.repeat(order, room)
    sizes[:filled] = np.repeat(lengths[order], room)
    assert len(order) == 0 or codes[order[0]] == 0
    return symbols, sizes


def unpack_bits(bits: bytes, n_ids: int, checkpoints: np.ndarray, table: tuple, step: int = STEP, max_bits: int = MAX_BITS) -> np.ndarray:
    """The ids of a block: one lane a checkpoint, one look-up a lane and step."""
    symbols, sizes = table
    raw = np.frombuffer(bits, np.uint8).astype(np.int64)
    lanes = len(checkpoints)
    out = np.zeros((step, lanes), np.uint32)
    at = checkpoints.astype(np.int64)
    last = n_ids - (lanes - 1) * step if lanes else 0
    wide = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    for k in range(step):
        if k == last and lanes:  # the last lane may be shorter
            at = at[:-1]
        value = (wide[at >> 3] >> (24 - max_bits - (at & 7))) & ((1 << max_bits) - 1)
        out[k, : len(at)] = symbols[value]
        at = at + sizes[value]
    return out.T.reshape(-1)[:n_ids]


# --- Spark jobs -------------------------------------------------------------


def encode_ids(docs: DataFrame, vocab_file: str, end_id: int) -> DataFrame:
    """A row (doc_id, n_tokens, ids) a document, and a row a task with the counts of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab_file)
        kind = "<u2" if enc.vocab_size <= 1 << 16 else "<u4"
        end = np.array([end_id], "<u4").tobytes()
        counts = np.zeros(max(enc.vocab_size, end_id + 1), np.int64)
        held, n_held = [], 0
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            ids, sizes = [], []
            for _, raw in enc.encode(texts):
                got = np.frombuffer(raw + end, "<u4").astype(kind)
                ids.append(got.tobytes())
                sizes.append(len(got))
                held.append(got)
                n_held += len(got)
                if n_held >= 1 << 18:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts))
                    held, n_held = [], 0
            yield pa.record_batch([keys, pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names=["doc_id", "n_tokens", "ids", "counts"])
        if held:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=["doc_id", "n_tokens", "ids", "counts"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, _ENCODED)


def global_counts(encoded: DataFrame) -> np.ndarray:
    """Counts of every id over all documents; as many numbers as the vocabulary has ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                got = np.frombuffer(raw, np.int64)
                total = got.copy() if total is None else total + got
        if total is not None:
            used = np.flatnonzero(total)
            yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    got = encoded.where("counts is not null").select("counts").mapInArrow(rows, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(got.id.max()) + 1 if len(got) else 1, np.int64)
    out[got.id.to_numpy()] = got.n.to_numpy()
    return out


def write_ids(docs: DataFrame, path: str, vocab_file: str, end_id: int = 0, n_files: int | None = None) -> None:
    """Write the file: `path`/blocks and `path`/code."""
    spark = docs.sparkSession
    encoded = saved(encode_ids(docs, vocab_file, end_id), "op1-encoded")
    lengths = code_lengths(global_counts(encoded))
    used = np.flatnonzero(lengths)
    import pandas as pd

    spark.createDataFrame(pd.DataFrame({"id": used.astype(np.int64), "length": lengths[used]}), "id long, length long").coalesce(1).write.parquet(f"{path}/code")
    shared_lengths = spark.sparkContext.broadcast(lengths)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        size = shared_lengths.value
        codes = canonical_codes(size)
        kind = None
        part, seq, done = TaskContext.get().partitionId(), 0, 0
        held, docs_in, n = [], [], 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate(held).astype(np.int64)
            bits, at = pack_bits(ids, size, codes)
            values = (
                part, seq, done, len(ids),
                np.array([d is None for d, _ in docs_in]).tobytes(),
                np.array([d or 0 for d, _ in docs_in], "<i8").tobytes(),
                np.array([m for _, m in docs_in], "<u4").tobytes(),
                at[::STEP].astype("<u8").tobytes(), bits,
            )
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            names = ["part", "seq", "part_start", "n_ids", "null_docs", "doc_ids", "doc_lens", "checkpoints", "bits"]
            return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            for doc_id, m, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kind = "<u2" if len(raw) == 2 * m else "<u4"
                held.append(np.frombuffer(raw, kind))
                docs_in.append((doc_id, m))
                n += m
                if n >= BLOCK_IDS:
                    yield block()
                    held, docs_in, n, seq, done = [], [], 0, seq + 1, done + n
        if held:
            yield block()

    n_files = n_files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        encoded.where("ids is not null").select("doc_id", "n_tokens", "ids")
        .repartitionByRange(n_files, "doc_id").sortWithinPartitions("doc_id", "n_tokens", "ids")
        .mapInArrow(blocks, _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    )


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode the file: (doc_id, start, n_tokens, ids_crc32) a document, and with
    `with_ids` its ids as array<int>. start counts the ids of all documents before."""
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    code = spark.read.schema("id long, length long").parquet(f"{path}/code").toPandas()  # at most the vocabulary
    lengths = np.zeros(int(code.id.max()) + 1 if len(code) else 1, np.int64)
    lengths[code.id.to_numpy()] = code.length.to_numpy()
    shared_lengths = spark.sparkContext.broadcast(lengths)

    # Ids before each part: as many rows as the file has parts, which write_ids bounds.
    per_part = blocks.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).orderBy("part").toPandas()
    before = dict(zip(per_part.part.tolist(), (per_part.n_ids.cumsum() - per_part.n_ids).tolist(), strict=True))

    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 5 if with_ids else 4]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(shared_lengths.value)
        for batch in batches:
            for row in batch.to_pylist():
                marks = np.frombuffer(row["checkpoints"], "<u8")
                ids = unpack_bits(row["bits"], row["n_ids"], marks, table).astype("<u4")
                doc_ids = np.frombuffer(row["doc_ids"], "<i8")
                sizes = np.frombuffer(row["doc_lens"], "<u4").astype(np.int64)
                ends = np.cumsum(sizes)
                raw = memoryview(ids.tobytes())
                crcs = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                out = [
                    pa.array(doc_ids, pa.int64(), mask=np.frombuffer(row["null_docs"], bool)),
                    pa.array(ends - sizes + (before[row["part"]] + row["part_start"]), pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()),
                ]
                if with_ids:
                    out.append(pa.array([ids[e - s : e].astype(np.int32) for e, s in zip(ends, sizes, strict=True)], pa.list_(pa.int32())))
                yield pa.record_batch(out, names=names)

    return blocks.mapInArrow(decode, schema)


def token_output(docs: DataFrame, vocab_file: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write the ids of all documents, and read them back."""
    spark = docs.sparkSession
    path = path or new_path(spark, "op1-ids")
    write_ids(docs, path, vocab_file, end_id)
    return read_ids(spark, path)
