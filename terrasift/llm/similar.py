"""Near copies by fingerprints and the exact Jaccard similarity of word shingles.

The segment-popcount search of ``simhash`` comes first: it links fingerprints at few differing
bits, so copies and lightly edited texts are connected by one test a text. A similarity of t
may lie at more bits than that search can take; a prefix filter completes it, so that no pair
at t or more is left out.

Prefix filter: with the shingles of every text in one common order, two texts at Jaccard t or
more share a shingle among the first n - ceil(t n) + 1 of both. The order puts shingles that
are common in a sample last; it changes the work, never the result. Texts that share a prefix
shingle form a cell. Pairs of a cell are tested in rounds: neighbours in size first, and only
pairs that are not connected yet afterwards, so that a large group of copies is not compared
pair by pair. Every link is confirmed on the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.llm.components import components
from terrasift.llm.simhash import fingerprints, linked, shingle_hashes
from terrasift.llm.tables import by_bytes, forget, keep, released, tidy, unused

ROUNDS = (2, 16, None)  # how far apart in a cell, by size, the pairs of each round lie at most
BITS = 4  # differing bits at which the fingerprint search links
SAMPLE, COMMON = 16, 1 << 18
BITMAP = 1 << 24
PART = 1 << 20  # bytes of text in hand at a time
CROWD = 8192  # a cell of more texts is dealt out in parts


def shingles(text: str, words: int, seed: int) -> np.ndarray:
    """The text's distinct shingle hashes, sorted."""
    found = list(shingle_hashes(text.encode(), words, seed))
    return np.unique(np.concatenate(found)).view(np.int64) if found else np.zeros(0, np.int64)


def text_key(text: Column) -> Column:
    """Hash of the text; all texts without words count as empty."""
    return F.xxhash64(F.when(text.rlike(r"[^ \t-\r]"), text).otherwise(""))


def _sampled(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", PART):
                found = [shingles(t, words, seed) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["h"])

    return run


def common_shingles(texts: DataFrame, words: int, seed: int) -> np.ndarray:
    """Shingles that several texts of a sample hold, rarest first; at most ``COMMON``."""
    some = texts.where(F.pmod("node", F.lit(SAMPLE)) == 0).dropDuplicates(["node"]).select("text")
    counts = some.mapInArrow(released(_sampled(words, seed)), "h bigint").groupBy("h").count().where("count > 2")
    rows = counts.orderBy(F.desc("count"), "h").limit(COMMON).select("h").toPandas()
    return rows["h"].to_numpy(np.int64)[::-1].copy()


def _prefixes(words: int, seed: int, fifths: int, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = common.value
        order = np.argsort(last)
        known = last[order]
        seen: set[int] = set()
        for batch in batches:
            for part in by_bytes(batch, "text", PART):
                out = []
                for node, text in zip(part.column("node").to_pylist(), part.column("text").to_pylist()):
                    if node in seen:
                        continue
                    if len(seen) >= 1 << 17:  # copies that come later are found in the cells
                        seen.clear()
                    seen.add(node)
                    hashes = shingles(text, words, seed)
                    n = len(hashes)
                    if not n:
                        continue
                    if len(known):
                        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                        rank = np.where(known[at] == hashes, order[at] + 1, 0)
                        hashes = hashes[np.argsort(rank, kind="stable")]
                    p = n - -(-fifths * n // 5) + 1
                    out.append((hashes[:p], np.full(p, n, np.int32), np.arange(p, dtype=np.int32), np.full(p, node, np.int64)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["h", "n", "pos", "node"])

    return run


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole runs of the first column, about a batch at a time."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        if cut:
            yield [x[:cut] for x in rows]
        held = [x[cut:] for x in rows]
    if held is not None:
        yield held


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, n, node): without copies, and only those of cells with several texts."""
    for h, n, pos, node in runs(batches):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        h, n, pos, node = (x[new] for x in (h, n, pos, node))
        same = h[1:] == h[:-1]
        several = np.append(same, False) | np.append(False, same)
        yield pa.RecordBatch.from_arrays([pa.array(x[several]) for x in (h, n, pos, node)], ["h", "n", "pos", "node"])


def _pairs(low: int, high: int | None, fifths: int):
    """Pairs of a cell up to ``high`` places apart that may be similar and aren't connected.

    An earlier turn saw those up to ``low`` places apart, but in cells that are dealt anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, n, pos, node, comp, anew in runs(batches):
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            i, d = np.arange(len(h)), 0
            while len(i) and (high is None or d < high):
                d += 1
                i = i[i + d < len(h)]
                # sorted by size: what is too large at one distance is so at every larger one
                i = i[(h[i] == h[i + d]) & (5 * n[i] >= fifths * n[i + d])]
                a = i[anew[i]] if d <= low else i
                a = a[comp[a] != comp[a + d]]
                b = a + d
                # the first shared shingle leaves enough places behind it in both texts
                left = np.minimum(n[a] - pos[a], n[b] - pos[b])
                fits = (5 + fifths) * left >= fifths * (n[a] + n[b])
                u, v = node[a[fits]], node[b[fits]]
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    return run


def _confirmed(words: int, seed: int, fifths: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            us, vs = [], []
            for u, v, a, b in zip(*(batch.column(c) for c in ("u", "v", "a", "b"))):
                if last != (u := u.as_py()):
                    last, own = u, shingles(a.as_py(), words, seed)
                other = shingles(b.as_py(), words, seed)
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 5 * both >= fifths * (len(own) + len(other) - both):
                    us.append(u)
                    vs.append(v.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def _may_hold(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose key's bit is set in a bitmap of fixed size, before any text moves."""
    found = nodes.select(F.pmod("node", F.lit(BITMAP)).cast("int").alias("bit")).distinct().toPandas()["bit"].to_numpy(np.int64)
    flags = np.zeros(BITMAP, bool)
    flags[found] = True
    bits = texts.sparkSession.sparkContext.broadcast(np.packbits(flags))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.mod(batch.column("node").to_numpy(zero_copy_only=False), BITMAP)
            yield batch.filter(pa.array((bits.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))

    return texts.mapInArrow(released(run), "node bigint, text string")


def fingerprint_pairs(texts: DataFrame, words: int, seed: int, bits: int = BITS) -> tuple[DataFrame, str]:
    """Pairs ``(u, v)`` of nodes that connect what the segment-popcount search of ``simhash`` links, and their path.

    A fingerprint's smallest node stands for it: pairs of linked fingerprints are pairs of these,
    and every other node of a fingerprint is paired with it. So there are fewer pairs than nodes
    and links, however large a group of copies is.
    """
    spark = texts.sparkSession
    prints, prints_path = keep(fingerprints(texts, words, seed, "node").select(F.col("doc_id").alias("node"), "bits").distinct())
    firsts, firsts_path = keep(prints.groupBy("bits").agg(F.min("node").alias("first")))
    first_of = lambda side: firsts.select(F.col("bits").alias(side), F.col("first").alias(f"{side}_first"))
    near = linked(firsts.select("bits"), bits).distinct().join(first_of("u"), "u").join(first_of("v"), "v")
    same = prints.join(firsts, "bits").where("node <> first")
    pairs = keep(
        near.select(F.least("u_first", "v_first").alias("u"), F.greatest("u_first", "v_first").alias("v"))
        .unionByName(same.select(F.col("first").alias("u"), F.col("node").alias("v")))
        .distinct()
    )
    for path in (prints_path, firsts_path):
        forget(spark, path)
    return pairs


def _linked_texts(texts: DataFrame, pairs: DataFrame, words: int, seed: int, fifths: int) -> tuple[DataFrame, str]:
    """The pairs whose texts are similar enough, and the path of that table."""
    spark = texts.sparkSession
    nodes, nodes_path = keep(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct())
    held, held_path = keep(_may_hold(texts, nodes).join(nodes, "node", "left_semi").dropDuplicates(["node"]))
    tested = pairs.join(held.select(F.col("node").alias("v"), F.col("text").alias("b")), "v").join(
        held.select(F.col("node").alias("u"), F.col("text").alias("a")), "u"
    )
    links = keep(tested.mapInArrow(released(_confirmed(words, seed, fifths)), "u bigint, v bigint"))
    for path in (nodes_path, held_path):
        forget(spark, path)
    return links


def similar_links(texts: DataFrame, words: int = 5, fifths: int = 4, seed: int = 42) -> DataFrame:
    """``(node, root)`` of the texts of ``texts(node, text)`` linked at a Jaccard of ``fifths`` / 5 or more."""
    spark = texts.sparkSession
    pairs, pairs_path = fingerprint_pairs(texts, words, seed)
    links, links_path = _linked_texts(texts, pairs, words, seed, fifths)
    forget(spark, pairs_path)
    link_paths, low = [links_path], 0
    members, _ = keep(components(links))
    tidy(spark)
    common = spark.sparkContext.broadcast(common_shingles(texts, words, seed))
    rows = texts.mapInArrow(released(_prefixes(words, seed, fifths, common)), "h bigint, n int, pos int, node bigint")
    ready = rows.repartition("h").sortWithinPartitions("h", "n", "node")
    cells, cells_path = keep(ready.mapInArrow(released(_shared), "h bigint, n int, pos int, node bigint"))
    crowded, crowded_path = keep(cells.groupBy("h").count().where(F.col("count") > CROWD))
    for turn, high in enumerate(ROUNDS):
        named = cells.join(members, "node", "left").withColumn("comp", F.coalesce("root", "node"))
        dealt = _dealt(named, crowded, turn, high is None).repartition("h").sortWithinPartitions("h", "n", "node")
        pairs, pairs_path = keep(dealt.mapInArrow(released(_pairs(low, high, fifths)), "u bigint, v bigint").distinct())
        new, new_path = _linked_texts(texts, pairs, words, seed, fifths)
        forget(spark, pairs_path)
        link_paths.append(new_path)
        links = links.unionByName(new)
        members, _ = keep(components(links))
        low = high
        tidy(spark)
    for path in (cells_path, crowded_path, *link_paths):
        forget(spark, path)
    return members


def _dealt(cells: DataFrame, crowded: DataFrame, turn: int, every: bool) -> DataFrame:
    """Cells with those of more than ``CROWD`` texts in parts, dealt anew in every turn.

    With ``every`` each pair of parts makes a cell, so that no pair of texts is left out.
    """
    parts = F.coalesce(F.ceil(F.col("count") / CROWD), F.lit(1)).cast("int")
    dealt = cells.join(crowded, "h", "left").withColumn("parts", parts)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", F.lit(turn)), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)) if every else F.col("own")
    dealt = dealt.withColumn("other", other)
    part = F.xxhash64("h", F.least("own", "other"), F.greatest("own", "other"))
    return dealt.select(F.when(F.col("parts") == 1, F.col("h")).otherwise(part).alias("h"), "n", "pos", "node", "comp", (F.col("parts") > 1).alias("anew"))


def drop_similar(
    docs: DataFrame, words: int = 5, fifths: int = 4, seed: int = 42, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row of every group of texts linked at a Jaccard of ``fifths`` / 5 or more; all columns stay.

    Shingles are ``words`` lower-cased words; a shorter text is one shingle, texts without
    words are alike. A group keeps its smallest id, a null id only if it has no other; different
    texts with one id, or without any, count as different rows.
    """
    node, missing, key = (unused(docs, c) for c in ("text_key", "id_missing", "id_key"))
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    zero = F.lit("0").cast(docs.schema[id_column].dataType)
    keyed = docs.withColumns({node: text_key(text), missing: docs[id_column].isNull(), key: F.coalesce(docs[id_column], zero)})
    own = keyed.select(F.col(node).alias("node"), F.struct(F.col(missing).alias("missing"), F.col(key).alias("id")).alias("first"))
    nodes, _ = keep(own.groupBy("node").agg(F.min("first").alias("first")))
    members = similar_links(docs.select(text_key(text).alias("node"), text.alias("text")), words, fifths, seed)
    named = nodes.join(members, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = named.groupBy("root").agg(F.min(F.struct("first.missing", "first.id", "node")).alias("b"))
    first = best.select(F.col("b.node").alias(node), F.col("b.missing").alias(missing), F.col("b.id").alias(key))
    return keyed.join(first, [node, missing, key], "left_semi").dropDuplicates([node, missing, key]).drop(node, missing, key)
