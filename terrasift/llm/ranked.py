"""Ranked lexical search: a hybrid of term-at-a-time and document-at-a-time evaluation.

Every task indexes its documents block by block, for the terms of the queries alone. A query's
short lists are summed term by term into accumulators. Sorted by document, these are one more
iterator with a bound, its largest sum, beside the long lists with theirs. The iterators are
then read document by document, a stride at a time: those whose bounds together cannot reach
the floor, the k-th best score so far, are only looked into for documents that the others
yield and that may still reach it; a stride or block whose bounds stay below is skipped. The
floor is carried through all blocks of a task, and tasks hand on k documents a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrasift.llm.tables import by_bytes, keep
from terrasift.llm.words import text_pieces

BLOCK = 16 << 20  # bytes of text indexed at a time
STRIDE = 4096  # documents read at a time
PAIRS = 1 << 20  # (query, term) pairs in one pass over the documents, about
SHARDS = 64

# letters and digits of ASCII and all other characters form terms, A-Z lower-cased
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of string texts (null: none), and their number in each text."""
    texts = pc.fill_null(texts, "").take(pa.array(np.arange(len(texts))))
    _, offsets, data = texts.buffers()
    clean = pa.py_buffer(data.to_pybytes().translate(_TABLE) if data else b"")
    lists = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), offsets, clean))
    words = lists.flatten()
    filled = pc.greater(pc.binary_length(words), 0)
    n = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    return words.filter(filled), np.diff(n[bounds])


def block_counts(part: pa.RecordBatch, terms: pa.Array) -> tuple[np.ndarray, ...]:
    """(n, code, doc, tf): terms in each text; how often each of ``terms`` occurs, by code and document."""
    size = part.num_rows
    if size == 1 and part.column("text")[0].is_valid:
        counts, n = np.zeros(len(terms), np.int64), 0
        for piece in text_pieces(part.column("text")[0].as_buffer().to_pybytes()):
            words, own = split_terms(pa.array([piece], pa.binary()).view(pa.string()))
            codes = pc.index_in(words, value_set=terms).drop_null().to_numpy()
            counts += np.bincount(codes, minlength=len(terms))
            n += int(own[0])
        code = np.flatnonzero(counts)
        return np.array([n]), code, np.zeros(len(code), np.int64), counts[code]
    words, n = split_terms(part.column("text"))
    codes = pc.fill_null(pc.index_in(words, value_set=terms), -1).to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(size), n)
    known = codes >= 0
    pairs, tf = np.unique(codes[known] * size + doc[known], return_counts=True)
    return n, pairs // size, pairs % size, tf


def _stats(terms):
    """Arrow function: documents that hold each term; code -1: with any term, -2: terms in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders, documents, total = np.zeros(len(terms.value), np.int64), 0, 0
        for batch in batches:
            for part in by_bytes(batch, "text", BLOCK):
                n, code, _, _ = block_counts(part, terms.value)
                holders += np.bincount(code, minlength=len(holders))
                documents += int((n > 0).sum())
                total += int(n.sum())
        codes = np.flatnonzero(holders)
        columns = [np.concatenate([[-1, -2], codes]), np.concatenate([[documents, total], holders[codes]])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["code", "n"])

    return run


def length_mass(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """50 + (50 * n * N) div L for every document's number of terms; exact at any size."""
    each = 50 * documents
    if len(n) and int(n.max()) * each >= 1 << 63:
        return np.array([50 + int(x) * each // total for x in n], np.int64)
    return 50 + n.astype(np.int64) * each // total


class Best:
    """The k best documents of one query so far; equal scores by ascending id, null ids last."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1
        self.score, self.id, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        self.score, self.id, self.none = np.append(self.score, score), np.append(self.id, ids), np.append(self.none, none)
        if len(self.score) >= self.k:
            best = np.lexsort((self.id, self.none, -self.score))[: self.k]
            self.score, self.id, self.none = self.score[best], self.id[best], self.none[best]
            self.floor = max(1, int(self.score[-1]))


def summed(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Documents of all lists in order, and their sums."""
    if len(lists) == 1:
        return lists[0]
    docs, values = np.concatenate([x[0] for x in lists]), np.concatenate([x[1] for x in lists])
    order = np.argsort(docs, kind="stable")
    docs, values = docs[order], values[order]
    first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])) if len(docs) else np.zeros(0, np.int64)
    return docs[first], np.add.reduceat(values, first) if len(first) else values


def evaluate(lists: list[tuple[np.ndarray, np.ndarray, int]], size: int, best: Best, ids: np.ndarray, none: np.ndarray, stride: int = STRIDE) -> None:
    """Adds a block's documents to ``best``. A list has documents in order, scores and their largest."""
    lists = sorted(lists, key=lambda x: len(x[0]))
    if sum(x[2] for x in lists) < best.floor:
        return
    room, short = size // 4, 0
    while short < len(lists) and (room := room - len(lists[short][0])) >= 0:
        short += 1
    turn = lists[short:]
    if short:
        docs, sums = summed([x[:2] for x in lists[:short]])
        turn = [(docs, sums, int(sums.max(initial=0))), *turn]
    turn.sort(key=lambda x: x[2])
    reach = np.cumsum([x[2] for x in turn])
    for low in range(0, size, stride):
        if reach[-1] < best.floor:
            return
        must = int(np.searchsorted(reach, best.floor))  # the lists before it cannot reach the floor
        spans = [slice(*np.searchsorted(x[0], (low, low + stride))) for x in turn[must:]] if size > stride else [slice(None)] * (len(turn) - must)
        docs, sums = summed([(x[0][s], x[1][s]) for x, s in zip(turn[must:], spans)])
        for i in range(must - 1, -1, -1):
            open_ = sums + reach[i] >= best.floor
            docs, sums = docs[open_], sums[open_]
            if not len(docs):
                break
            at = np.minimum(np.searchsorted(turn[i][0], docs), len(turn[i][0]) - 1)
            sums = sums + np.where(turn[i][0][at] == docs, turn[i][1][at], 0)
        high = sums >= best.floor
        if high.any():
            best.add(sums[high], ids[docs[high]], none[docs[high]])


def _search(terms, weights, queries, documents: int, total: int, k: int):
    """Arrow function: the k best documents of a task for every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries.value]
        weight = weights.value
        for batch in batches:
            for part in by_bytes(batch, "text", BLOCK):
                n, code, doc, tf = block_counts(part, terms.value)
                mass = length_mass(n, documents, total)
                score = weight[code] * (1_000_000_000 * tf // (1000 * tf + 20 * mass[doc]))
                edges = np.searchsorted(code, np.arange(len(weight) + 1))
                full = np.flatnonzero(edges[1:] > edges[:-1])
                bound = np.zeros(len(weight), np.int64)
                if len(full):
                    bound[full] = np.maximum.reduceat(score, edges[full])
                ids = part.column("id")
                none = ids.is_null().to_numpy(zero_copy_only=False)
                ids = pc.fill_null(ids, 0).to_numpy()
                lows, highs, bounds = edges[:-1].tolist(), edges[1:].tolist(), bound.tolist()
                for own, found in zip(queries.value, best):
                    lists = [(doc[lows[t] : highs[t]], score[lows[t] : highs[t]], bounds[t]) for t in own if bounds[t]]
                    if lists:
                        evaluate(lists, part.num_rows, found, ids, none)
        rows = [np.repeat(np.arange(len(best)), [len(b.score) for b in best])]
        rows += [np.concatenate([getattr(b, c) for b in best]) if best else np.zeros(0, np.int64) for c in ("id", "none", "score")]
        ids = pa.array(rows[1], pa.int64(), mask=rows[2].astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), ids, pa.array(rows[3], pa.int64())], ["query", "doc_id", "score"])

    return run


def query_terms(queries: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(item_id, term)``: the distinct terms of every query; rows of one id are one query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                words, n = split_terms(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(np.repeat(np.arange(len(n)), n))), words], ["item_id", "term"])

    own = queries.select(queries[id_column].alias("item_id"), queries[text_column].cast("string").alias("text"))
    return own.mapInArrow(run, f"item_id {own.schema['item_id'].dataType.simpleString()}, term string").distinct()


def _one_pass(spark: SparkSession, docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The k best documents for the queries of ``pairs``, whose number is bounded."""
    rows = pairs.toArrow()
    terms = pc.unique(rows.column("term").combine_chunks())
    names = rows.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
    codes = pc.index_in(rows.column("term").combine_chunks(), value_set=terms).to_numpy()
    order = np.argsort(names.indices.to_numpy(), kind="stable")
    cuts = np.searchsorted(names.indices.to_numpy()[order], np.arange(1, len(names.dictionary)))
    queries = [x.tolist() for x in np.split(codes[order], cuts)] if len(codes) else []
    shared = spark.sparkContext.broadcast
    terms = shared(terms)
    stats = {r["code"]: r["n"] for r in docs.mapInArrow(_stats(terms), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()}
    documents, total = stats.get(-1, 0), stats.get(-2, 0)
    holders = [stats.get(i, 0) for i in range(len(terms.value))]
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) if n else 0 for n in holders], np.int64)
    found = docs.mapInArrow(
        _search(terms, shared(weights), shared(queries), documents, max(total, 1), k), "query int, doc_id bigint, score bigint"
    ).withColumn("shard", F.spark_partition_id() % SHARDS)
    by_score = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for cell in (["query", "shard"], ["query"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy(*by_score))).where(F.col("rank") <= k)
    item = spark.createDataFrame(pa.table({"query": pa.array(range(len(names.dictionary)), pa.int32()), "item_id": names.dictionary}))
    kind = pairs.schema["item_id"].dataType
    return found.join(item, "query").select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")


def search(
    docs: DataFrame, queries: DataFrame, k: int = 50, id_column: str = "doc_id", text_column: str = "text",
    query_id: str = "item_id", query_text: str = "text", pairs: int = PAIRS,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents with a score above 0 for each query.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z
    lower-cased. A term weighs floor(1000 ln((2N + 2) / (2 df + 1))), a document scores the sum
    of weight * (10^9 tf div (1000 tf + 20 m)), m = 50 + 50 n N div L. Equal scores rank by
    ascending id, null ids last; ids are integers. Repeated rows rank each; a null or empty text
    has no terms; a query without matches has no rows; rows of one query id (null: likewise) are
    one query; either table may be empty; other columns are ignored. Queries of more than
    ``pairs`` (query, term) pairs are searched in several passes, each within a broadcast.
    """
    spark = docs.sparkSession
    own = docs.select(docs[id_column].cast("bigint").alias("id"), docs[text_column].cast("string").alias("text"))
    wanted, _ = keep(query_terms(queries, query_id, query_text))
    passes = -(-wanted.count() // pairs) or 1
    turn = F.pmod(F.xxhash64("item_id"), F.lit(passes))
    out = _one_pass(spark, own, wanted.where(turn == 0), k)
    for i in range(1, passes):
        out = out.unionByName(_one_pass(spark, own, wanted.where(turn == i), k))
    return out


def search_sql(k: int = 50) -> str:
    """DuckDB twin of ``search`` over ``documents`` and ``benchmark``."""
    upper = "".join(map(chr, range(65, 91)))
    terms = f"regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
WITH d AS (SELECT doc_id, {terms} AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(t))::BIGINT AS total FROM d WHERE len(t) > 0),
m AS (SELECT doc_id, 50 + ((50 * len(t)::HUGEINT * docs) // total)::BIGINT AS m FROM d, s WHERE len(t) > 0),
p AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term), s),
q AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
f AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY 1, 2
), r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM f WHERE score > 0)
SELECT * FROM r WHERE rank <= {k}
"""
