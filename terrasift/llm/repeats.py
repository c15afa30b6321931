"""Suffix-array dedup: bytes covered by strings that occur more than once in a corpus.

Texts fall into named stretches (``superstrings``). Only stretches whose name comes again can
hold a repeat. Equal stretches collapse first; different ones of a name are put into one block
and searched with the Burrows-Wheeler transform (``bwt``). Names never share a window, so
blocks are independent and their size is bounded whatever the corpus holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.llm.bwt import repeated_windows, runs
from terrasift.llm.superstrings import superstrings
from terrasift.llm.tables import by_bytes, forget, join_dealt, keep, released, unused

CONTENT = ["name", "c1", "c2"]
TEXT = ["k1", "k2"]
SLICE = 1 << 16  # windows hashed at a time


def text_keys(text: Column) -> list[Column]:
    """128 bits that stand for a text (null: empty)."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit(1), whole).alias("k2")]


def stretches(docs: DataFrame, window: int, text_column: str) -> DataFrame:
    """All named stretches: text, place, name, 128-bit content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", 2 << 20):
                texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column("text").cast(pa.binary())]
                raw = b"".join(texts)
                bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
                text, start, length, name, twice = superstrings(np.frombuffer(raw, np.uint8), bounds, window)
                digest = b"".join(xxhash.xxh3_128_digest(raw[a : a + n]) for a, n in zip(start.tolist(), length.tolist()))
                content = np.frombuffer(digest, np.int64).reshape(-1, 2)
                owner = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("k1").take(owner), part.column("k2").take(owner), pa.array(start - bounds[text]), pa.array(length),
                        pa.array(name.view(np.int64)), pa.array(content[:, 0].copy()), pa.array(content[:, 1].copy()), pa.array(twice),
                    ],
                    ["k1", "k2", "start", "length", "name", "c1", "c2", "twice"],
                )

    own = docs.select(*text_keys(docs[text_column]), docs[text_column].cast("string").alias("text"))
    return own.where("text IS NOT NULL").mapInArrow(
        released(run), "k1 bigint, k2 bigint, start bigint, length bigint, name bigint, c1 bigint, c2 bigint, twice boolean"
    )


REPEAT = "name bigint, c1 bigint, c2 bigint, low bigint, high bigint"


def _search(window: int, block: int):
    """Arrow function over strings sorted by name: repeated windows of blocks of whole names."""

    def found(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for (name, c1, c2, _), flags in zip(rows, repeated_windows([r[3] for r in rows], window)):
            out += [(name, c1, c2, a, b) for a, b in runs(flags)]
        table = np.array(out, np.int64).reshape(-1, 5).T.copy()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in table], ["name", "c1", "c2", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if size > block and row[0] != held[-1][0]:
                    yield found(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield found(held)

    return run


def _window_hashes(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, c1, c2, text in zip(*[c.to_pylist() for c in batch.columns]):
                for at in range(0, len(text) - window + 1, SLICE):
                    low = np.arange(at, min(at + SLICE, len(text) - window + 1))
                    digest = b"".join(xxhash.xxh3_128_digest(text[i : i + window]) for i in low.tolist())
                    h = np.frombuffer(digest, np.int64).reshape(-1, 2)
                    cols = [*(np.full(len(low), v) for v in (name, c1, c2)), low, h[:, 0].copy(), h[:, 1].copy()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["name", "c1", "c2", "low", "h1", "h2"])

    return run


def repeated_spans(docs: DataFrame, window: int = 400, text_column: str = "text", block: int = 1 << 19, crowd: int = 1 << 20) -> DataFrame:
    """``(k1, k2, spans)``: the byte spans (start, end) to remove from each text that has any.

    ``k1, k2`` are ``text_keys``. Spans may overlap. A name whose different stretches exceed
    ``crowd`` bytes is not put in one task: its windows are counted one by one instead.
    """
    spark = docs.sparkSession
    every, every_path = keep(stretches(docs, window, text_column))
    names = every.groupBy("name").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).where("n > 1 OR twice").select("name")
    places, _ = keep(
        every.join(names, "name", "left_semi").groupBy(*TEXT, "start", "length", *CONTENT).agg(F.count("*").alias("n"), F.max("twice").alias("twice"))
    )
    forget(spark, every_path)
    rep = F.min(F.struct(*TEXT, "start")).alias("rep")
    contents, _ = keep(places.groupBy(*CONTENT, "length").agg(F.sum("n").alias("n"), F.max("twice").alias("twice"), rep))
    alone = contents.groupBy("name").agg(F.count("*").alias("kinds"), F.sum("length").alias("bytes"), F.max("twice").alias("again"))
    mixed = contents.join(alone.where("kinds > 1 OR again"), "name")
    wanted = mixed.select("rep.*", "length", *CONTENT, (F.col("bytes") > crowd).alias("crowded"))
    wanted = wanted.groupBy(*TEXT).agg(F.collect_list(F.struct("start", "length", *CONTENT, "crowded")).alias("w"))
    text = docs[text_column].cast("string")
    texts = docs.where(text.isNotNull()).select(*text_keys(docs[text_column]), text.alias("text")).dropDuplicates(TEXT)
    cut = texts.join(wanted, TEXT).select(F.col("text").cast("binary").alias("text"), F.explode("w").alias("w"))
    strings = cut.select("w.name", "w.c1", "w.c2", F.expr("substring(text, cast(w.start + 1 as int), cast(w.length as int))").alias("bytes"), "w.crowded")
    strings, strings_path = keep(strings)
    usual = strings.where("NOT crowded").drop("crowded").repartition("name").sortWithinPartitions("name")
    single = strings.where("crowded").drop("crowded").mapInArrow(released(_window_hashes(window)), "name bigint, c1 bigint, c2 bigint, low bigint, h1 bigint, h2 bigint")
    counts, _ = keep(single.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"))
    shared = join_dealt(single, counts, ["h1", "h2"], "n", CONTENT)
    # neighbouring windows of a content are one run
    run = F.col("low") - F.row_number().over(Window.partitionBy(*CONTENT).orderBy("low"))
    shared = shared.withColumn("run", run).groupBy(*CONTENT, "run").agg(F.min("low").alias("low"), F.max("low").alias("high")).drop("run")
    whole = contents.where("n > 1").select(*CONTENT, F.lit(0).cast("bigint").alias("low"), (F.col("length") - window).alias("high"))
    found = usual.mapInArrow(released(_search(window, block)), REPEAT).unionByName(shared).unionByName(whole)
    found, _ = keep(found.groupBy(*CONTENT).agg(F.collect_list(F.struct("low", "high")).alias("found")))
    forget(spark, strings_path)
    # a place meets the one row of its content, whatever that holds
    span = lambda f: F.struct((F.col("start") + f["low"]).alias("a"), (F.col("start") + f["high"] + window).alias("b"))
    hit = places.join(found, CONTENT).select(*TEXT, F.transform("found", span).alias("spans"))
    spans, _ = keep(hit.groupBy(*TEXT).agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans")))
    return spans


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs; spans that touch are one run."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in ([] if spans is None else spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for s in spans for x in s], len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def with_spans(docs: DataFrame, spans: DataFrame, text_column: str, name: str) -> DataFrame:
    """Input rows with their text's spans beside them, as column ``name`` (null: none)."""
    k1, k2 = (unused(docs, f"text_{k}") for k in TEXT)
    keyed = docs.withColumns(dict(zip((k1, k2), text_keys(docs[text_column]))))
    return keyed.join(spans.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("spans").alias(name)), [k1, k2], "left").drop(k1, k2)


def removal_digests(
    docs: DataFrame, window: int = 400, id_column: str = "doc_id", text_column: str = "text", **options
) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every input row.

    A byte goes if a ``window``-byte string that also begins at another place covers it, in the
    same document or another. Null texts are empty; texts under ``window`` bytes lose nothing;
    null ids and repeated rows stay (equal texts repeat each other); an empty table gives no
    rows; other columns are ignored.
    """
    own = docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("string").alias("text"))
    rows = with_spans(own, repeated_spans(docs, window, text_column, **options), "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data, spans = (text or "").encode(), merged(found)
                out.append((len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept_bytes(data, spans)).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            cols = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    id_type = own.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(released(run), f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def drop_repeats(docs: DataFrame, window: int = 400, text_column: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text_column``; all columns and other rows stay.

    Spans shrink to whole characters, and a text that loses all of its characters leaves with
    its row.
    """
    name = unused(docs, "spans")
    rows = with_spans(docs, repeated_spans(docs, window, text_column, **options), text_column, name)

    @F.pandas_udf("string")
    def cut(texts, spans):
        out = []
        for text, found in zip(texts, spans):
            if text is None or found is None or not len(found):
                out.append(text)
                continue
            data = text.encode()
            whole = []
            for a, b in merged(found):
                while a < len(data) and data[a] & 0xC0 == 0x80:
                    a += 1
                while b < len(data) and data[b] & 0xC0 == 0x80:
                    b -= 1
                if b > a:
                    whole.append((a, b))
            out.append(kept_bytes(data, whole).decode())
        return type(texts)(out, dtype=object)

    text = F.when(F.col(name).isNull(), F.col(text_column)).otherwise(cut(F.col(text_column), F.col(name)))
    left = rows.withColumn(text_column, text).where(F.col(name).isNull() | (F.length(text_column) > 0))
    return left.select(*docs.columns)
