"""Best-fit packing by minimum bin slack.

Only lengths decide how pieces combine, and there are at most ``capacity`` of them. The
histogram of lengths is planned on the driver: for one bin the longest available piece is
placed, a subset-sum over bitsets finds the fullest filling of the rest, and the combination
is repeated as often as the counts allow. Pieces then take the planned places by their rank
among pieces of their length, so the plan's size doesn't depend on the number of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasift.llm.pieces import encoder
from terrasift.llm.tables import by_bytes, keep, released, texts_of

RANKS = 1 << 48


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to ``room``.

    Bit s of a bitset is set if sum s can be reached. A length with several pieces enters in
    powers of two. Longer pieces are tried first, so short ones stay for later bins.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left = min(counts[length], room // length)
        k = 1
        while left > 0:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + k
            total -= length * k
    return chosen


@dataclass(frozen=True)
class Plan:
    """Places by length and rank: segment i starts at ``keys[i]`` = length * RANKS + rank."""

    keys: np.ndarray
    sequence: np.ndarray  # of the segment's first rank
    times: np.ndarray  # pieces of this length in one sequence
    offset: np.ndarray  # of the first of them
    sequences: int

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces."""
        key = lengths * RANKS + ranks
        s = np.searchsorted(self.keys, key, side="right") - 1
        nth = key - self.keys[s]
        return self.sequence[s] + nth // self.times[s], self.offset[s] + nth % self.times[s] * lengths


def plan_bins(counts: dict[int, int], capacity: int) -> Plan:
    """Minimum-bin-slack plan for a histogram of lengths from 1 to ``capacity``."""
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    rows, sequences = [], 0
    while left:
        seed = max(left)
        rest = {n: c - (n == seed) for n, c in left.items() if c > (n == seed)}
        bin_ = fullest(rest, capacity - seed)
        bin_[seed] = bin_.get(seed, 0) + 1
        repeat = min(left[n] // k for n, k in bin_.items())
        at = 0
        for n in sorted(bin_, reverse=True):
            rows.append((n * RANKS + used[n], sequences, bin_[n], at))
            at += n * bin_[n]
            used[n] += repeat * bin_[n]
            left[n] -= repeat * bin_[n]
            if not left[n]:
                del left[n]
        sequences += repeat
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Plan(*table.T.copy(), sequences)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; what doesn't fill a sequence comes first."""
    first = n % capacity or min(n, capacity)
    starts = [0, *range(first, n, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n])]


PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint"


def piece_rows(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """All pieces with their task and their rank among the task's pieces of that length."""
    own = docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("string").alias("text"))
    id_type = docs.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task, seen = encoder(tokenizer, "bytes"), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in by_bytes(batch, "text"):
                ids, counts = tokens.encode(texts_of(part, "text"))
                rows: list[tuple] = []
                at = 0
                for i, n in enumerate(counts.tolist()):
                    whole = np.append(ids[at : at + n], end_id).astype("<u4")
                    at += n
                    for k, (start, length) in enumerate(cut(n + 1, capacity)):
                        rows.append((i, k, start, length, zlib.crc32(whole[start : start + length]), seen[length]))
                        seen[length] += 1
                table = np.array(rows, np.int64).reshape(-1, 6).T.copy()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(table[0])),
                        pa.array(table[1].astype(np.int32)),
                        *[pa.array(c) for c in table[2:5]],
                        pa.array(np.full(len(rows), task)),
                        pa.array(table[5]),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
                )

    return own.mapInArrow(released(run), f"doc_id {id_type.simpleString()}, {PIECE}, task bigint, nth bigint")


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row for each piece of each document with its sequence and the offset in it.

    A document is its ids and ``end_id``; one longer than ``capacity`` is cut. A null text is
    empty (one piece of one id), null ids stay null, repeated rows are packed each, an empty
    table gives no rows, other columns are ignored. Sequences are numbered from 0, their pieces
    lie without gaps from offset 0.
    """
    pieces, _ = keep(piece_rows(docs, tokenizer, capacity, end_id, id_column, text_column))
    # one row for each task and length: the ranks its pieces get begin after those of the tasks before it
    each, _ = keep(pieces.groupBy("length", "task").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = each.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = plan_bins(counts, capacity)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = plan.place(length, rank) if len(length) else (length, rank)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    ranked = pieces.join(bases, ["length", "task"]).select(*names, (F.col("base") + F.col("nth")).alias("rank"))
    id_type = docs.schema[id_column].dataType.simpleString()
    return ranked.mapInArrow(released(run), f"doc_id {id_type}, {PIECE}, sequence_id bigint, offset bigint")
