"""Canonical length-limited Huffman coding of token ids.

Code lengths come from the corpus's global id counts by package-merge. A file is a Parquet
table of independent blocks; every block holds whole documents in ascending id order, one bit
string, and the bit offset of every ``STEP``-th id, so that reading can start at any of them.
Decoding looks codes up in one table of 2^``LIMIT`` entries, at all checkpoints of a batch of
blocks at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.llm.pieces import encoder
from terrasift.llm.tables import by_bytes, forget, keep, texts_of

LIMIT = 18
STEP = 256
BLOCK_IDS = 1 << 19


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code length of every symbol with a count, at most ``limit`` bits (package-merge)."""
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(symbols)
    if n <= 1:
        lengths[symbols] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit codes of {limit} bits")
    order = np.argsort(counts[symbols], kind="stable")
    weights = counts[symbols][order].astype(np.float64)
    # level by level: which entries of the merged list are symbols, and how many packages precede
    merged, marks = weights, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        rank = np.argsort(both, kind="stable")
        merged, mark = both[rank], rank < n
        marks.append(mark)
    take, each = 2 * n - 2, np.zeros(n, np.int64)
    for mark in reversed(marks):
        own = int(mark[:take].sum())
        each[:own] += 1
        take = 2 * (take - own)
    lengths[symbols[order]] = each
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by ascending length, then symbol."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code = last = 0
    for length in np.unique(lengths[order]).tolist():
        own = order[lengths[order] == length]
        code <<= length - last
        codes[own] = np.arange(code, code + len(own), dtype=np.uint64)
        code, last = code + len(own), length
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for every value of the next ``limit`` bits."""
    codes, symbols, sizes = canonical_codes(lengths), np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.uint8)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    width = np.int64(1) << (limit - lengths[order].astype(np.int64))
    end = int(width.sum())
    assert not len(order) or int(codes[order[0]]) == 0
    symbols[:end] = np.repeat(order, width)
    sizes[:end] = np.repeat(lengths[order], width)
    return symbols, sizes


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bit string of the ids, and the bit offset of every ``STEP``-th one."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    word = starts >> 6
    room = 64 - (starts & 63) - size  # bits left in the word after this code; negative: it goes on in the next
    code = codes[ids]
    head = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    out = np.zeros((int(ends[-1]) + 63 >> 6) + 1 if len(ids) else 1, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(head, first)
        over = np.flatnonzero(room < 0)
        out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    bits = int(ends[-1]) if len(ids) else 0
    return out.astype(">u8").tobytes()[: bits + 7 >> 3], starts[::STEP].copy()


def decode_blocks(payload: bytes, starts: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray], limit: int = LIMIT) -> np.ndarray:
    """Ids from all checkpoints of a payload at once; ``counts``: ids after each checkpoint, ``STEP`` at most."""
    raw = np.frombuffer(payload + b"\0" * 4, np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    symbols, sizes = table
    order = np.argsort(-counts, kind="stable")
    at, lanes = starts[order].copy(), -counts[order]
    out = np.zeros((STEP, len(order)), np.uint32)
    shift, mask = 32 - limit, (1 << limit) - 1
    for k in range(int(counts.max(initial=0))):
        live = int(np.searchsorted(lanes, -k, side="left"))  # lanes with more than k ids
        pos = at[:live]
        code = window[pos >> 3] >> (shift - (pos & 7)).astype(np.uint32) & mask
        out[k, :live] = symbols[code]
        at[:live] += sizes[code]
    by_lane = np.empty((len(order), STEP), np.uint32)
    by_lane[order] = out.T
    return by_lane[np.arange(STEP) < counts[:, None]]


def encode_documents(
    docs: DataFrame, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``(doc_id, n_tokens, ids)``; ids are packed little-endian unsigned 16 or 32-bit integers."""
    own = docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("string").alias("text"))
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer, "bytes")
        for batch in batches:
            for part in by_bytes(batch, "text"):
                ids, counts = tokens.encode(texts_of(part, "text"))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                cuts = ends + np.arange(1, len(ends) + 1)
                kind = "<u2" if len(ids) == 0 or ids.max() < 1 << 16 else "<u4"
                packed = [x.astype(kind).tobytes() for x in np.split(ids, cuts[:-1])] if len(counts) else []
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts + 1), pa.array(packed, pa.binary())], ["doc_id", "n_tokens", "ids"]
                )

    return own.mapInArrow(run, f"doc_id {id_type}, n_tokens bigint, ids binary")


def _ids(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if len(packed) == 2 * n else "<u4")


def id_counts(encoded: DataFrame) -> np.ndarray:
    """Global count of every id; as many rows reach the driver as the vocabulary has ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for packed, n in zip(batch.column("ids").to_pylist(), batch.column("n_tokens").to_pylist()):
                own = np.bincount(_ids(packed, n), minlength=len(total))
                own[: len(total)] += total
                total = own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    rows = encoded.mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    out[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


BLOCKS = "part bigint, block bigint, first bigint, n_ids bigint, doc_ids array<{}>, sizes array<bigint>, checkpoints array<bigint>, payload binary"


def write_file(encoded: DataFrame, path: str, limit: int = LIMIT, part_ids: int = 1 << 24) -> None:
    """Writes ``path/codebook`` (id, length) and ``path/blocks``.

    Documents are dealt by ranges of ``doc_id``, each range of about ``part_ids`` ids, and
    sorted within it; (part, block) is the ascending order of all documents.
    """
    spark = encoded.sparkSession
    counts = id_counts(encoded)
    lengths = code_lengths(counts, limit)
    used = np.flatnonzero(lengths)
    book = spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id bigint, length int")
    book.coalesce(1).write.parquet(f"{path}/codebook")
    codes = canonical_codes(lengths)
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, first, held, n = TaskContext.get().partitionId(), 0, 0, [], 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in held])
            payload, starts = encode_block(ids, lengths, codes)
            values = [part, block, first, len(ids), [d for d, _ in held], [len(x) for _, x in held], starts.tolist(), payload]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names)

        names = ["part", "block", "first", "n_ids", "doc_ids", "sizes", "checkpoints", "payload"]
        for batch in batches:
            kinds = [pa.int64()] * 4 + [pa.list_(batch.schema.field("doc_id").type), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            for doc, size, packed in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids")]):
                held.append((doc, _ids(packed, size)))
                n += size
                if n >= BLOCK_IDS:
                    yield row()
                    block, first, held, n = block + 1, first + n, [], 0
        if held:
            yield row()

    parts = max(1, -(-int(counts.sum()) // part_ids))
    ordered = encoded.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    blocks = ordered.mapInArrow(run, BLOCKS.format(id_type))
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_file(spark: SparkSession, path: str, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document of a written file, ids packed in 32 bits."""
    return spark.read.parquet(f"{path}/blocks").transform(lambda b: _decoded(b, path, limit, True))


def read_digests(spark: SparkSession, path: str, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the decoded ids."""
    return spark.read.parquet(f"{path}/blocks").transform(lambda b: _decoded(b, path, limit, False))


def _decoded(blocks: DataFrame, path: str, limit: int, with_ids: bool) -> DataFrame:
    spark = blocks.sparkSession
    book = spark.read.parquet(f"{path}/codebook").toPandas()  # a row for each id of the vocabulary
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.uint8)
    lengths[book["id"].to_numpy(np.int64)] = book["length"].to_numpy(np.uint8)
    # ids before each part; parts are as many as the writer's tasks
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    ahead, total = {}, 0
    for row in sorted(sums):
        ahead[row["part"]], total = total, total + row["n"]
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    last = "ids binary" if with_ids else "ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths, limit)
        for batch in batches:
            for row in batch.to_pylist():
                n, starts = row["n_ids"], np.array(row["checkpoints"], np.int64)
                counts = np.minimum(STEP, n - STEP * np.arange(len(starts)))
                ids = decode_blocks(row["payload"], starts, counts, table, limit).astype("<u4")
                ends = np.cumsum(row["sizes"])
                begins = ends - row["sizes"]
                view = memoryview(ids.tobytes())
                each = [view[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist())]
                values = pa.array([bytes(x) for x in each], pa.binary()) if with_ids else pa.array([zlib.crc32(x) for x in each], pa.int64())
                first = ahead[row["part"]] + row["first"]
                docs = pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type)
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(first + begins), pa.array(row["sizes"], pa.int64()), values],
                    ["doc_id", "start", "n_tokens", last.split()[0]],
                )

    return blocks.mapInArrow(run, f"doc_id {id_type}, start bigint, n_tokens bigint, {last}")


def write_documents(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text"
) -> None:
    """Encodes whole texts, counts ids over all of them and writes the coded file.

    A null text is empty (its end id alone), null ids come first, repeated rows are written
    each, an empty table gives a file without blocks, other columns are ignored.
    """
    encoded, kept = keep(encode_documents(docs, tokenizer, end_id, id_column, text_column))
    write_file(encoded, path)
    forget(docs.sparkSession, kept)
