"""Language-model scores by deleted interpolation.

n-gram maximum-likelihood estimates of orders 1 to ``order`` and a uniform share are mixed
with weights that depend on how often the longest context was seen. The weights are learned by
expectation-maximisation on a deleted part of the training documents with counts from the
rest; the scores then use the counts of all training documents.

Words and n-grams are 64-bit hashes. Tasks hold chunks of documents as columns of numbers. A
chunk sends each of its distinct n-grams once to the bucket of its hash, where the counts of
all chunks are added up and sent back, so what moves follows the number of distinct n-grams
and a frequent one weighs no more than a rare one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.tables import by_bytes, keep
from terrasift.llm.words import word_blocks

TRAIN, DELETED, HELD_OUT = 0, 1, 2
END = np.uint64(0x5BD1E9955BD1E995)
OPEN = np.uint64(0x2545F4914F6CDD1D)
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
STEPS = 8  # of the EM histogram in one doubling of a probability
NONE = -(1 << 20)
CONTEXTS = 24  # context-frequency buckets: unseen, then one for each doubling


def pack(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def token_hashes(data: bytes, memory: dict[bytes, int]) -> np.ndarray:
    """Hash of every lower-cased word, and of the end."""
    out = []
    for words in word_blocks(data.lower()):
        for w in words:
            if w not in memory:
                memory[w] = xxhash.xxh64_intdigest(w)
        out.append(np.fromiter(map(memory.__getitem__, words), np.uint64, len(words)))
    return np.concatenate([*out, [END]])


def gram_keys(tokens: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the 1- to ``order``-grams that end at each token; documents are padded in front."""
    keys = [tokens]
    for m in range(2, order + 1):
        before = np.empty_like(tokens)
        before[1:] = keys[-1][:-1]
        before[starts] = OPEN + np.uint64(m)
        key = (before ^ (before >> np.uint64(29))) * ODD + tokens
        key = (key ^ (key >> np.uint64(32))) * MIX
        keys.append(key ^ (key >> np.uint64(31)))
    return keys


@dataclass
class Chunk:
    """Documents of one chunk: tokens in a row, and each document's token count and part."""

    tokens: np.ndarray
    sizes: np.ndarray
    parts: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


CHUNK = "chunk bigint, parts binary, sizes binary, words binary, places binary, deleted boolean"


def chunks(docs: DataFrame, id_column: str, text_column: str, chunk_tokens: int) -> DataFrame:
    """Chunk rows. Documents of the deleted part are in chunks of their own."""
    remainder = F.crc32(docs[id_column].cast("string").cast("binary")) % 5
    part = F.when(remainder == 1, HELD_OUT).when(remainder == 4, DELETED).otherwise(TRAIN)
    own = docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("string").alias("text"), part.alias("part"))
    id_type = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        memory: dict[bytes, int] = {}
        held: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}

        def row(deleted: bool) -> pa.RecordBatch:
            rows = held[deleted]
            words, places = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)
            sizes = np.fromiter((len(r[2]) for r in rows), np.int64, len(rows))
            parts = np.fromiter((r[1] for r in rows), np.uint8, len(rows))
            values = [task << 32 | number, pack(parts), pack(sizes), pack_sorted(words), pack(places.astype(np.uint32)), deleted]
            ids = pa.array([[r[0] for r in rows]], pa.list_(id_kind))
            return pa.RecordBatch.from_arrays([*[pa.array([v]) for v in values], ids], [*[c.split()[0] for c in CHUNK.split(", ")], "doc_ids"])

        for batch in batches:
            id_kind = batch.schema.field("doc_id").type
            for slice_ in by_bytes(batch, "text"):
                for doc, text, kind in zip(*[slice_.column(c).to_pylist() for c in ("doc_id", "text", "part")]):
                    tokens = token_hashes((text or "").encode(), memory)
                    side = kind == DELETED
                    held[side].append((doc, kind, tokens))
                    size[side] += len(tokens)
                    if size[side] >= chunk_tokens:
                        yield row(side)
                        number, held[side], size[side] = number + 1, [], 0
                if len(memory) > 500_000:
                    memory.clear()
        for side in (False, True):
            if held[side]:
                yield row(side)
                number += 1

    return own.mapInArrow(run, f"{CHUNK}, doc_ids array<{id_type}>")


def read_chunk(row: dict) -> tuple[Chunk, np.ndarray, np.ndarray]:
    words, places = unpack_sorted(row["words"]), unpack(row["places"], np.uint32).astype(np.int64)
    return Chunk(words[places], unpack(row["sizes"], np.int64), unpack(row["parts"], np.uint8)), words, places


def distinct_grams(chunk: Chunk, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the sorted distinct keys and each token's place among them."""
    return [np.unique(k, return_inverse=True) for k in gram_keys(chunk.tokens, chunk.starts, order)]


def _send(order: int, shift: int):
    """Chunk rows to (bucket, chunk, order, keys, counts of the undeleted and of all training tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["chunk", "parts", "sizes", "words", "places"]).to_pylist():
                chunk, _, _ = read_chunk(row)
                part = np.repeat(chunk.parts, chunk.sizes)
                for m, (keys, places) in enumerate(distinct_grams(chunk, order), 1):
                    kept = np.bincount(places[part == TRAIN], minlength=len(keys)).astype(np.uint32)
                    every = np.bincount(places[part != HELD_OUT], minlength=len(keys)).astype(np.uint32)
                    bucket = (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
                    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                    ends = np.append(cuts[1:], len(keys))
                    out = [
                        (int(bucket[a]), row["chunk"], m, pack_sorted(keys[a:b]), pack(kept[a:b]), pack(every[a:b]))
                        for a, b in zip(cuts.tolist(), ends.tolist())
                    ]
                    yield pa.RecordBatch.from_pylist(
                        [dict(zip(("bucket", "chunk", "m", "keys", "kept", "every"), x)) for x in out], SENT
                    )

    return run


SENT = pa.schema(
    [("bucket", pa.int64()), ("chunk", pa.int64()), ("m", pa.int32()), ("keys", pa.binary()), ("kept", pa.binary()), ("every", pa.binary())]
)
BACK = pa.schema(
    [("chunk", pa.int64()), ("m", pa.int32()), ("bucket", pa.int64()), ("kept", pa.binary()), ("every", pa.binary()), ("v_kept", pa.int64()), ("v_every", pa.int64())]
)
BACK_SQL = "chunk bigint, m int, bucket bigint, kept binary, every binary, v_kept bigint, v_every bigint"


def _add_up(table: pa.Table) -> pa.Table:
    """One order of one bucket: every chunk's counts become the sums over all chunks."""
    rows = table.to_pylist()
    keys = [unpack_sorted(r["keys"]) for r in rows]
    whole, places = np.unique(np.concatenate(keys), return_inverse=True)
    sums = {}
    for c in ("kept", "every"):
        own = np.concatenate([unpack(r[c], np.uint32) for r in rows])
        sums[c] = np.bincount(places, weights=own, minlength=len(whole)).astype(np.int64)
    cuts = np.cumsum([0, *map(len, keys)])
    seen = {c: int((sums[c] > 0).sum()) for c in sums}
    out = []
    for k, r in enumerate(rows):
        own = places[cuts[k] : cuts[k + 1]]
        first = k == 0
        out.append(
            {"chunk": r["chunk"], "m": r["m"], "bucket": r["bucket"], "kept": pack(sums["kept"][own].astype(np.uint32)), "every": pack(sums["every"][own].astype(np.uint32)), "v_kept": seen["kept"] * first, "v_every": seen["every"] * first}
        )
    return pa.Table.from_pylist(out, BACK)


def token_counts(row: dict, back: list[dict], order: int, which: str) -> tuple[Chunk, list[np.ndarray]]:
    """A chunk, and for each order the corpus count of the n-gram that ends at each token."""
    chunk, _, _ = read_chunk(row)
    out = []
    for m, (keys, places) in enumerate(distinct_grams(chunk, order), 1):
        parts = sorted((r for r in back if r["m"] == m), key=lambda r: r["bucket"])
        counts = np.concatenate([unpack(r[which], np.uint32) for r in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        assert len(counts) == len(keys)
        out.append(counts[places])
    return chunk, out


def estimates(chunk: Chunk, counts: list[np.ndarray], total: int, docs: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Context bucket of each token, and its probability by each component, the uniform one first."""
    starts = chunk.starts
    rows = [np.full(len(chunk.tokens), 1.0 / (vocabulary + 1)), counts[0] / max(1, total)]
    context = np.full(len(chunk.tokens), total)
    for m in range(1, len(counts)):
        context = np.empty_like(counts[m - 1])
        context[1:] = counts[m - 1][:-1]
        context[starts] = docs
        rows.append(np.where(context > 0, counts[m] / np.maximum(1, context), 0.0))
    bucket = np.where(context > 0, np.minimum(CONTEXTS - 1, 1 + np.log2(np.maximum(1, context)).astype(np.int64)), 0)
    return bucket, np.array(rows)


def learn(events: np.ndarray, order: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights by context bucket from rows (bucket, log ratios of the orders, count)."""
    weights = np.zeros((CONTEXTS, order + 1))
    weights[:, 0] = 1.0
    known = False
    for b in range(CONTEXTS):
        own = events[events[:, 0] == b]
        if not len(own):
            if known:
                weights[b] = weights[b - 1]
            continue
        ratio = np.concatenate([np.ones((len(own), 1)), np.where(own[:, 1:-1] == NONE, 0.0, 2.0 ** (own[:, 1:-1] / STEPS))], axis=1)
        n, w = own[:, -1].astype(float), np.full(order + 1, 1.0 / (order + 1))
        for _ in range(rounds):
            share = ratio * w
            w = (share / share.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
        floor = 1e-6  # an unseen word keeps a probability
        w[0] = max(w[0], floor)
        weights[b], known = w / w.sum(), True
    return weights


def score(
    docs: DataFrame,
    order: int = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
    chunk_tokens: int = 1 << 21,
    bucket_keys: int = 1 << 21,
) -> DataFrame:
    """One row for each document: ``held_out``, tokens, known tokens, training tokens, and both scores.

    Training documents are those whose crc32(id as text) mod 5 is not 1; remainder 4 is the
    deleted part. A null id counts as training; a null text is empty (its end alone); repeated
    rows count each; without training documents every estimate is the uniform one; an empty
    table gives no rows; other columns are ignored. ``chunk_tokens`` and ``bucket_keys`` bound
    a task's memory and don't change the result.
    """
    parts, _ = keep(chunks(docs, id_column, text_column, chunk_tokens))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, 2), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                kinds, sizes = unpack(row["parts"], np.uint8), unpack(row["sizes"], np.int64)
                sums[:, 0] += np.bincount(kinds, minlength=3)
                sums[:, 1] += np.bincount(kinds, weights=sizes, minlength=3).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"part": [0, 1, 2], "docs": sums[:, 0].tolist(), "tokens": sums[:, 1].tolist()})

    sums = {r[0]: r[1:] for r in parts.select("parts", "sizes").mapInArrow(tally, "part bigint, docs bigint, tokens bigint").groupBy("part").agg(F.sum("docs"), F.sum("tokens")).collect()}
    n_docs, n_tokens = ({k: (sums.get(k) or (0, 0))[i] for k in (TRAIN, DELETED, HELD_OUT)} for i in (0, 1))
    buckets = max(0, (sum(n_tokens.values()) // bucket_keys).bit_length())
    sent = parts.mapInArrow(_send(order, 64 - buckets), "bucket bigint, chunk bigint, m int, keys binary, kept binary, every binary")
    back, _ = keep(sent.groupBy("bucket", "m").applyInArrow(_add_up, BACK_SQL))
    sizes = back.where("m = 1").agg(F.sum("v_kept"), F.sum("v_every")).first()
    v_kept, v_every = (x or 0 for x in sizes)
    answers = back.select("chunk", "m", "bucket", "kept", "every")

    def ratios(row: pa.Table, answer: pa.Table) -> pa.Table:
        names = ["b", *[f"q{m}" for m in range(1, order + 1)], "n"]
        for one in row.to_pylist():
            chunk, counts = token_counts(one, answer.to_pylist(), order, "kept")
            bucket, each = estimates(chunk, counts, n_tokens[TRAIN], n_docs[TRAIN], v_kept)
            with np.errstate(divide="ignore"):
                logs = np.where(each[1:] > 0, np.round(STEPS * np.log2(each[1:] / each[0])), NONE).astype(np.int64)
            rows, n = np.unique(np.vstack([bucket[None], logs]), axis=1, return_counts=True)
            return pa.table([*[pa.array(c) for c in rows], pa.array(n)], names)
        return pa.table([pa.array([], pa.int64()) for _ in names], names)

    columns = ", ".join(["b bigint", *[f"q{m} bigint" for m in range(1, order + 1)], "n bigint"])
    deleted = parts.where("deleted").drop("doc_ids", "deleted")
    theirs = answers.drop("every").join(deleted.select("chunk"), "chunk", "left_semi")
    events = deleted.groupBy("chunk").cogroup(theirs.groupBy("chunk")).applyInArrow(ratios, columns)
    # a bounded grid: buckets times steps of the ratios, whatever the corpus holds
    table = events.groupBy("b", *[f"q{m}" for m in range(1, order + 1)]).agg(F.sum("n").alias("n")).toPandas()
    grid = table.sort_values(list(table.columns)).to_numpy(np.int64).reshape(-1, order + 2)
    weights = learn(grid, order)
    total, train_docs = n_tokens[TRAIN] + n_tokens[DELETED], n_docs[TRAIN] + n_docs[DELETED]
    id_type = docs.schema[id_column].dataType.simpleString()
    result = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def rate(row: pa.Table, answer: pa.Table) -> pa.Table:
        for one in row.to_pylist():
            chunk, counts = token_counts(one, answer.to_pylist(), order, "every")
            bucket, each = estimates(chunk, counts, total, train_docs, v_every)
            base = np.log10((counts[0] + 0.5) / (total + 0.5 * (v_every + 1)))
            mixed = np.log10((weights[bucket].T * each).sum(axis=0))
            add = lambda x: np.add.reduceat(x, chunk.starts)
            kind = row.schema.field("doc_ids").type.value_type
            cols = [
                pa.array(one["doc_ids"], kind), pa.array(chunk.parts == HELD_OUT), pa.array(chunk.sizes), pa.array(add((counts[0] > 0).astype(np.int64))),
                pa.array(np.full(len(chunk.sizes), total)), pa.array(add(base)), pa.array(add(mixed)),
            ]
            return pa.table(cols, result)
        raise ValueError("a chunk without a row")

    schema = f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return parts.drop("deleted").groupBy("chunk").cogroup(answers.drop("kept").groupBy("chunk")).applyInArrow(rate, schema)
