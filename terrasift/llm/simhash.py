"""SimHash near-duplicates by segment popcounts.

A fingerprint's 64 bits form 32 segments of two bits; a segment's popcount is 0, 1 or 2. The
Manhattan distance of two popcount vectors never exceeds the Hamming distance of the
fingerprints. Written in thermometer code (0: 00, 1: 01, 2: 11) the vector is a 64-bit number
itself and the Manhattan distance is the popcount of an XOR.

The grid is laid over groups of segments. A vector distance of at most ``bits`` over
``bits + 2`` groups leaves at least two groups without any difference, so two linked
fingerprints share the cell of some pair of groups. Inside a cell the Manhattan bound is
tested first and the Hamming distance of what is left decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.llm.components import components
from terrasift.llm.tables import keep, released, unused
from terrasift.llm.words import word_blocks

SEGMENTS = 32
EVEN = 0x5555555555555555


def shingle_hashes(data: bytes, words: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of lower-cased words, repeats included, in blocks."""
    short, whole = b"", False
    for block in word_blocks(data.lower(), words - 1):
        n = len(block)
        joined = b" ".join(block)
        if n < words:
            short = joined
            continue
        whole = True
        ends = np.cumsum(np.fromiter(map(len, block), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[: n - words] + 1]).tolist()
        digest = xxhash.xxh64_intdigest
        found = [digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())]
        yield np.array(found, np.uint64)
    if short and not whole:  # the whole text has fewer words than a shingle
        yield np.array([xxhash.xxh64_intdigest(short, seed)], np.uint64)


def fingerprint(data: bytes, words: int = 4, seed: int = 42) -> int:
    """Bit i is set if it is set in more than half of the shingle hashes; no words: zero."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(data, words, seed):
        for i in range(0, len(hashes), 1 << 16):
            part = hashes[i : i + (1 << 16)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprints(
    docs: DataFrame, words: int = 4, seed: int = 42, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``(doc_id, bits)`` of every row; a null or empty text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [fingerprint(t or b"", words, seed) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            signed = pa.array(np.array(bits, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), signed], ["doc_id", "bits"])

    id_type = docs.schema[id_column].dataType.simpleString()
    columns = docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return columns.mapInArrow(released(run), f"doc_id {id_type}, bits bigint")


def thermometer(bits: Column) -> Column:
    """The popcounts of all two-bit segments in thermometer code."""
    low, high = bits.bitwiseAND(F.lit(EVEN)), F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(EVEN))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def grid_masks(bits: int) -> list[int]:
    """Bit masks (signed) of the pairs of segment groups that make up the grids."""
    groups = np.array_split(np.arange(SEGMENTS), bits + 2)
    masks = [sum(3 << (2 * int(s)) for g in pair for s in g) for pair in combinations(groups, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(bits: np.ndarray, codes: np.ndarray, left: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked within runs of rows; ``left``: rows after each one in its run."""
    n = len(bits)
    root = np.arange(n)
    order = np.argsort(-left, kind="stable")
    falling = -left[order]
    us, vs = [], []
    for d in range(1, int(left.max(initial=0)) + 1):
        i = order[: np.searchsorted(falling, -d, side="right")]
        i = i[np.bitwise_count(codes[i] ^ codes[i + d]) <= most]
        i = i[np.bitwise_count(bits[i] ^ bits[i + d]) <= most]
        i = i[root[i] != root[i + d]]
        if not len(i):
            continue
        for a, b in zip(i.tolist(), (i + d).tolist()):
            u, v = a, b
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                us.append(u)
                vs.append(v)
        while (root[root] != root).any():
            root = root[root]
    return bits[us], bits[vs]


def _links(most: int):
    """Arrow function over rows sorted by cell: a spanning forest of each cell's links."""

    def of(rows: list[np.ndarray]) -> pa.RecordBatch:
        keys, bits, codes = rows[:4], rows[4].view(np.uint64), rows[5].view(np.uint64)
        new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        ends = np.concatenate([np.flatnonzero(new), [len(bits) - 1]])
        left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(bits))
        u, v = forest(bits, codes, left, most)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            last = np.all([k == k[-1] for k in rows[:4]], axis=0)
            cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            if cut:
                yield of([x[:cut] for x in rows])
            held = [x[cut:] for x in rows]
        if held is not None:
            yield of(held)

    return run


def linked(nodes: DataFrame, bits: int = 4, crowd: int = 8192) -> DataFrame:
    """Links ``(u, v)`` that connect all fingerprints of ``nodes(bits)`` at Hamming distance ``bits`` or less.

    ``nodes`` holds distinct fingerprints. A cell of more than ``crowd`` rows is dealt out in
    k parts, and every pair of parts becomes a task of its own, so no task holds more than
    about two parts and no pair of rows is left out.
    """
    code = thermometer(F.col("bits"))
    cells = nodes.select("bits", code.alias("code")).select(
        "bits",
        "code",
        F.posexplode(F.array(*[F.col("code").bitwiseAND(F.lit(m)) for m in grid_masks(bits)])).alias("grid", "cell"),
    )
    crowded = cells.groupBy("grid", "cell").count().where(F.col("count") > crowd)
    parts = F.coalesce(F.ceil(F.col("count") / crowd), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("bits"), F.col("parts")).cast("int")
    dealt = (
        cells.join(crowded, ["grid", "cell"], "left")
        .withColumn("parts", parts)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("grid", "cell", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "bits", "code")
    )
    ready = dealt.repartition("grid", "cell", "a", "b").sortWithinPartitions("grid", "cell", "a", "b", "bits")
    return ready.mapInArrow(released(_links(bits)), "u bigint, v bigint")


def near_copies(
    docs: DataFrame,
    bits: int = 4,
    words: int = 4,
    seed: int = 42,
    id_column: str = "doc_id",
    text_column: str = "text",
    crowd: int = 8192,
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every input row.

    Copies collapse to one fingerprint before any search. ``component_id`` is the smallest id
    reachable over links of at most ``bits`` differing bits. Null and empty texts have the zero
    fingerprint and link like any other; null ids are kept and never become a component's id
    unless it has no other; repeated rows stay repeated; an empty table gives no rows; other
    columns are ignored.
    """
    prints, _ = keep(fingerprints(docs, words, seed, id_column, text_column))
    nodes, _ = keep(prints.groupBy("bits").agg(F.min("doc_id").alias("first")))
    members, _ = keep(components(linked(nodes.select("bits"), bits, crowd)).withColumnsRenamed({"node": "bits"}))
    firsts = members.join(nodes, "bits").groupBy("root").agg(F.min("first").alias("smallest"))
    moved = members.join(firsts, "root").select("bits", "smallest")
    named = nodes.join(moved, "bits", "left").select("bits", F.coalesce("smallest", "first").alias("component_id"))
    hexed = F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint")
    return prints.join(named, "bits").select("doc_id", hexed, "component_id")


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One row of every component, the one with its smallest id; all columns stay.

    Rows with a null id are kept only if their component has no other id. Rows are told apart by
    id and text, so different texts with one id, or without any, count as different rows.
    """
    missing, key, text = (unused(docs, c) for c in ("id_missing", "id_key", "text_key"))
    zero = F.lit("0").cast(docs.schema[id_column].dataType)
    hashed = F.xxhash64(F.coalesce(docs[text_column].cast("string"), F.lit("")))
    keyed = docs.withColumns({missing: docs[id_column].isNull(), key: F.coalesce(docs[id_column], zero), text: hashed})
    own = keyed.select(F.struct(F.col(missing).alias("m"), F.col(key).alias("k"), F.col(text).alias("t")).alias("doc_id"), docs[text_column].alias("text"))
    found, _ = keep(near_copies(own, **options))
    first = found.where("doc_id = component_id").select("doc_id.*").distinct().toDF(missing, key, text)
    # the join's partitioning serves the deduplication, too
    return keyed.join(first, [missing, key, text], "left_semi").dropDuplicates([missing, key, text]).drop(missing, key, text)
