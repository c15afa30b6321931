"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

A window is a number of consecutive words of one document. Its hash is a polynomial over the
hashes of its words, taken modulo two primes of 61 and 24 bits. All windows of a text are
hashed at once by doubling: a window of 2k words is the window of its first k words, shifted,
plus the one k words on.

A task drops a window that came before among its own and passes the rest on in packets, one for
each part of the hash space, so a passage that half of the documents share costs a row a task.
Where the parts meet, the windows are sorted by hash and place, and all but the first of a hash
are marked. Marked windows of a document merge into maximal intervals of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.tables import by_bytes, keep, tidy, unused
from terrasift.llm.words import text_pieces

P, Q = (1 << 61) - 1, 16_777_213  # primes
BASE_P, BASE_Q = 0x1B873593CC9E2D51 % P, 7_368_787
ROOM = 1 << 18  # windows that a task holds before it passes them on
PART = 1 << 20  # bytes of text hashed at a time
PACKET_WINDOWS = 1024  # at most, so that a batch of packets stays small
LOW31, LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)


def times_p(a: np.ndarray, b: int) -> np.ndarray:
    """``a * b`` modulo 2^61 - 1 without leaving 64 bits."""
    high, low = a >> np.uint64(31), a & LOW31
    b_high, b_low = np.uint64(b >> 31), np.uint64(b & 0x7FFFFFFF)
    middle = high * b_low + low * b_high
    x = (high * b_high << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & LOW30) << np.uint64(31)) + low * b_low
    x = (x & np.uint64(P)) + (x >> np.uint64(61))
    return np.where(x >= P, x - np.uint64(P), x)


def times_q(a: np.ndarray, b: int) -> np.ndarray:
    return a * np.uint64(b) % np.uint64(Q)


def window_hashes(x: np.ndarray, width: int, base: int, prime: int, times) -> np.ndarray:
    """Polynomial hash of every ``width`` neighbours of ``x``: sum of x[i + j] * base^(width - 1 - j)."""
    add = lambda a, b: np.where((s := a + b) >= prime, s - np.uint64(prime), s)
    if len(x) < width:
        return x[:0]
    h, k = x, 1
    for bit in bin(width)[3:]:
        h, k = add(times(h[: len(h) - k], pow(base, k, prime)), h[k:]), 2 * k
        if bit == "1":
            h, k = add(times(h[:-1], base), x[k:]), k + 1
    return h


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every word of string texts that lie one after another, and words per text."""
    lists = pc.ascii_split_whitespace(texts)
    words, bounds = lists.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy())])
    filled = pc.greater(pc.binary_length(words), 0)
    n = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    coded = words.filter(filled).dictionary_encode()
    digests = b"".join(xxhash.xxh3_128_digest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist())
    table = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    codes = coded.indices.to_numpy()
    return (table[:, 0] % np.uint64(P))[codes], (table[:, 1] % np.uint64(Q))[codes], np.diff(n[bounds])


def _hashed(x: np.ndarray, y: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return window_hashes(x, window, BASE_P, P, times_p), window_hashes(y, window, BASE_Q, Q, times_q)


def windows(part: pa.RecordBatch, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(h, g, row, start) of every window of the batch's texts; a very long text comes in blocks."""
    if part.num_rows > 1:
        x, y, n = word_hashes(part.column("text"))
        h, g = _hashed(x, y, window)
        first = np.cumsum(n) - n
        row = np.repeat(np.arange(len(n)), n)[: len(h)]
        start = np.arange(len(h)) - first[row]
        inside = start + window <= n[row]
        yield h[inside], g[inside], row[inside], start[inside]
        return
    text = part.column("text")[0]
    x = y = np.zeros(0, np.uint64)
    seen = 0
    for piece in text_pieces(text.as_buffer().to_pybytes() if text.is_valid else b""):
        new_x, new_y, _ = word_hashes(pa.array([piece], pa.binary()).view(pa.string()))
        first = seen - len(x)
        x, y = np.concatenate([x, new_x]), np.concatenate([y, new_y])
        seen += len(new_x)
        h, g = _hashed(x, y, window)
        yield h, g, np.zeros(len(h), np.int64), first + np.arange(len(h))
        x, y = x[max(0, len(x) - window + 1) :], y[max(0, len(y) - window + 1) :]


def _bytes(values: np.ndarray, width: int, bounds: np.ndarray) -> pa.Array:
    """The low ``width`` bytes of unsigned values as one binary value for each stretch between bounds."""
    bounds = bounds if len(values) else np.zeros_like(bounds)
    raw = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize)[:, :width])
    offsets = (bounds * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _lists(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


PACKET = "part int, ids array<{id}>, keys array<bigint>, runs array<int>, h binary, g binary, low binary, high binary, stops array<int>"


def _cuts(part: np.ndarray) -> np.ndarray:
    """Where packets begin among windows sorted by part, and the end."""
    change = np.append(True, part[1:] != part[:-1])
    first = np.maximum.accumulate(np.where(change, np.arange(len(part)), 0))
    return np.append(np.flatnonzero(change | ((np.arange(len(part)) - first) % PACKET_WINDOWS == 0)), len(part))


def hash_bytes(parts: int) -> int:
    """Bytes that the quotient of a hash by the number of parts needs."""
    return -(-(P // parts).bit_length() // 8)


def _packet(part, ids, keys, owner, start, bounds, h, width, g, stops) -> pa.RecordBatch:
    """Rows of neighbouring windows; a document's id stands once for its run, starts as differences."""
    new = np.ones(len(owner), bool)
    new[1:] = owner[1:] != owner[:-1]
    new[bounds[:-1]] = True
    first = np.flatnonzero(new)
    step = np.diff(start, prepend=0)
    step[first] = start[first]
    run_bounds = np.searchsorted(first, bounds)
    runs = np.diff(np.append(first, len(owner)))
    columns = [
        pa.array(part, pa.int32()), _lists(ids.take(pa.array(owner[first])), run_bounds), _lists(pa.array(keys[owner[first]]), run_bounds),
        _lists(pa.array(runs, pa.int32()), run_bounds), _bytes(h, width, bounds), _bytes(g, 3, bounds),
        _bytes(step.astype(np.uint32), 1, bounds), _bytes((step >> 8).astype(np.uint32), 3, bounds),
        _lists(pa.array(stops, pa.int32()), bounds if len(stops) else np.zeros(len(bounds), np.int32)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["part", "ids", "keys", "runs", "h", "g", "low", "high", "stops"])


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals of intervals sorted by (doc, start); those that touch are one."""
    reach = np.maximum.accumulate((doc << 32) + stop)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] << 32) + start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    return doc[first], start[first], reach[last] - (doc[first] << 32)


def _packets(window: int, parts: int, room: int):
    """Arrow function: every window's hashes and place in packets; later ones of a task as intervals."""
    width = hash_bytes(parts)

    def passed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays([x[0] for x in held])
        keys = np.concatenate([x[1] for x in held])
        sizes = np.cumsum([0] + [len(x[1]) for x in held])
        h, g, start = (np.concatenate([x[k] for x in held]) for k in (2, 3, 5))
        owner = np.concatenate([x[4] + at for x, at in zip(held, sizes)])
        # documents in order; rows that agree in id and text are one
        rank = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
        order = np.lexsort((keys, rank))
        new = np.ones(len(order), np.int64)
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (keys[order][1:] != keys[order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        stand = order[np.flatnonzero(new)]  # a row for each number
        place = (number[owner] << 32) + start

        by_hash = np.argsort(h, kind="stable")
        sorted_h = h[by_hash]
        same = sorted_h[1:] == sorted_h[:-1]
        again = by_hash[np.append(same, False) | np.append(False, same)]
        again = again[np.lexsort((place[again], g[again], h[again]))]
        new = np.ones(len(again), bool)
        new[1:] = (h[again][1:] != h[again][:-1]) | (g[again][1:] != g[again][:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(again)), 0))
        later = again[~new & (place[again] > place[again[first]])]
        stays = np.ones(len(h), bool)
        stays[again[~new]] = False

        if len(later):
            at = np.sort(place[later])
            doc, a, b = merged(at >> 32, at & 0xFFFFFFFF, (at & 0xFFFFFFFF) + window)
            part = doc % parts
            by_part = np.argsort(part, kind="stable")
            cuts, none = _cuts(part[by_part]), np.zeros(0, np.uint64)
            yield _packet(part[by_part][cuts[:-1]], ids, keys, stand[doc[by_part]], a[by_part], cuts, none, width, none, b[by_part])
        h, g, owner, start = h[stays], g[stays], owner[stays], start[stays]
        part = (h % np.uint64(parts)).astype(np.int64)
        by_part = np.argsort(part, kind="stable")
        cuts, short = _cuts(part[by_part]), h[by_part] // np.uint64(parts)
        yield _packet(part[by_part][cuts[:-1]], ids, keys, owner[by_part], start[by_part], cuts, short, width, g[by_part], np.zeros(0, np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for part in by_bytes(batch, "text", PART):
                for h, g, row, start in windows(part, window):
                    if len(h):
                        held.append((part.column("id"), part.column("key").to_numpy(), h, g, row, start))
                        size += len(h)
                    if size >= room:
                        yield from passed(held)
                        held, size = [], 0
        if held:
            yield from passed(held)

    return run


def _number(raw: np.ndarray, width: int) -> np.ndarray:
    """Unsigned numbers of ``width`` bytes."""
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    wide[:, :width] = raw.reshape(-1, width)
    return wide.view(np.uint64).ravel()


def _unpacked(parts: int):
    """Arrow function: packets back into rows (h, g, id, key, start, stop); intervals have a stop and no hash."""
    width = hash_bytes(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                yield rows(batch.slice(at, 64))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8)
        ids, keys, sizes = (batch.column(c).flatten() for c in ("ids", "keys", "runs"))
        sizes = sizes.to_numpy()
        step = raw("low") + (_number(raw("high"), 3).astype(np.int64) << 8)
        first = np.cumsum(sizes) - sizes
        total = np.cumsum(step)
        start = total - np.repeat((total - step)[first], sizes)
        owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        n = pc.binary_length(batch.column("low")).to_numpy()
        bare = np.repeat(pc.list_value_length(batch.column("stops")).to_numpy() > 0, n)
        h, g, stop = np.zeros(len(step), np.uint64), np.zeros(len(step), np.int32), np.zeros(len(step), np.int32)
        h[~bare] = _number(raw("h"), width) * np.uint64(parts) + np.repeat(batch.column("part").to_numpy(), n)[~bare].astype(np.uint64)
        g[~bare] = _number(raw("g"), 3)
        stop[bare] = batch.column("stops").flatten().to_numpy()
        columns = [pa.array(h.view(np.int64), mask=bare), pa.array(g, mask=bare), ids.take(owner), keys.take(owner), pa.array(start.astype(np.int32)), pa.array(stop, mask=~bare)]
        return pa.RecordBatch.from_arrays(columns, ["h", "g", "id", "key", "start", "stop"])

    return run


def _equal(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two arrays agree; nulls are equal to each other."""
    both = pc.and_(a.is_null(), b.is_null())
    return pc.or_(both, pc.fill_null(pc.equal(a, b), False)).to_numpy(zero_copy_only=False)


def _later(window: int):
    """Arrow function over rows sorted by hash and place: all windows but the first of each hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for batch in batches:
            bare = batch.column("h").is_null()
            if pc.any(bare).as_py():
                yield batch.filter(bare).select(["id", "key", "start", "stop"])
                batch = batch.filter(pc.invert(bare))
            if not batch.num_rows:
                continue
            held = batch if first is None else pa.concat_batches([first, batch])
            h, g, start = (held.column(c).to_numpy() for c in ("h", "g", "start"))
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            rows = np.flatnonzero(~new)
            if len(rows):
                a, b = held.take(pa.array(rows)), held.take(pa.array(lead[rows]))
                own = _equal(a.column("id"), b.column("id")) & _equal(a.column("key"), b.column("key")) & (start[rows] == start[lead[rows]])
                a = a.filter(pa.array(~own))
                stop = pc.add(a.column("start"), pa.scalar(window, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(a.column(c) for c in ("id", "key", "start")), stop], ["id", "key", "start", "stop"])
            first = held.slice(int(lead[-1]), 1)

    return run


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (id, key, start) to one row a document with its maximal intervals."""

    def document(rows: pa.RecordBatch) -> pa.RecordBatch:
        doc = np.zeros(rows.num_rows, np.int64)
        doc[1:] = ~same(rows)
        doc = np.cumsum(doc)
        own, a, b = merged(doc, rows.column("start").to_numpy().astype(np.int64), rows.column("stop").to_numpy().astype(np.int64))
        bounds = np.searchsorted(own, np.arange(doc[-1] + 2))
        at = pa.array(np.searchsorted(doc, np.arange(doc[-1] + 1)))
        columns = [rows.column("id").take(at), rows.column("key").take(at), _lists(pa.array(a, pa.int32()), bounds), _lists(pa.array(b, pa.int32()), bounds)]
        return pa.RecordBatch.from_arrays(columns, ["id", "key", "starts", "stops"])

    def same(rows: pa.RecordBatch) -> np.ndarray:
        a, b = rows.slice(1), rows.slice(0, rows.num_rows - 1)
        return _equal(a.column("id"), b.column("id")) & _equal(a.column("key"), b.column("key"))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changes = np.flatnonzero(~same(batch))
        if held:
            ends = pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)])
            if not same(ends)[0]:
                yield document(pa.concat_batches(held))
                held = []
        if len(changes):
            cut = int(changes[-1]) + 1
            yield document(pa.concat_batches([*held, batch.slice(0, cut)]))
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield document(pa.concat_batches(held))


def repeated_intervals(docs: DataFrame, window: int, id_column: str, text_column: str, room: int = ROOM) -> DataFrame:
    """``(id, key, starts, stops)``: the word intervals to remove of each document that has any.

    ``key`` is a hash of the text, which with the id names a document.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_column].dataType.simpleString()
    text = docs[text_column].cast("string")
    own = docs.where(text.isNotNull()).select(docs[id_column].alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packets = own.mapInArrow(_packets(window, parts, room), PACKET.format(id=id_type)).repartitionById(parts, "part")
    rows = packets.mapInArrow(_unpacked(parts), f"h bigint, g int, id {id_type}, key bigint, start int, stop int")
    order = ["h", "g", F.col("id").asc_nulls_last(), "key", "start"]
    later = rows.sortWithinPartitions(*order).mapInArrow(_later(window), f"id {id_type}, key bigint, start int, stop int")
    dealt = later.repartition("id", "key").sortWithinPartitions("id", "key", "start")
    return dealt.mapInArrow(_intervals, f"id {id_type}, key bigint, starts array<int>, stops array<int>")


def kept_words(words: list[bytes], starts, stops) -> list[bytes]:
    """The words outside all intervals."""
    if starts is None:
        return words
    edges = [0, *[x for s in zip(starts, stops) for x in s], len(words)]
    return [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]


def _with_intervals(rows: DataFrame, found: DataFrame, id_column: str, text_column: str, names: list[str]) -> DataFrame:
    """``rows`` with the intervals of their document beside them."""
    spans = found.select(*(F.col(c).alias(n) for c, n in zip(("id", "key", "starts", "stops"), names)))
    same = rows[id_column].eqNullSafe(spans[names[0]]) & (F.xxhash64(rows[text_column].cast("string")) == spans[names[1]])
    return rows.join(spans, same, "left").drop(*names[:2])


def removal_digests(docs: DataFrame, window: int = 20, id_column: str = "doc_id", text_column: str = "text", room: int = ROOM) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every input row.

    A word goes if a window of ``window`` words covers it whose words also begin earlier: in a
    document of smaller id, or earlier in the same one. Windows are judged on the input. Null
    ids come last; different texts of one id are ordered by a hash of the text; rows that agree
    in id and text are one document and fare alike. A null text has no words, a text of fewer
    than ``window`` words loses none, an empty table gives no rows, other columns are ignored.
    """
    own = docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("string").alias("text"))
    found, _ = keep(repeated_intervals(docs, window, id_column, text_column, room))
    tidy(docs.sparkSession)
    rows = _with_intervals(own, found, "doc_id", "text", ["span_id", "span_key", "starts", "stops"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts, stops in zip(batch.column("text").cast(pa.binary()), batch.column("starts").to_pylist(), batch.column("stops").to_pylist()):
                words = (text.as_py() or b"").split()
                kept = kept_words(words, starts, stops)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    id_type = own.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, n_words bigint, n_removed bigint, kept_sha256 string")


def drop_repeated_windows(docs: DataFrame, window: int = 20, id_column: str = "doc_id", text_column: str = "text", room: int = ROOM) -> DataFrame:
    """``docs`` without the words of ``removal_digests``; all columns and the other rows stay as they are.

    A text that loses words keeps the rest joined by single spaces; one that loses all of them
    leaves with its row.
    """
    names = [unused(docs, c) for c in ("span_id", "span_key", "starts", "stops")]
    found, _ = keep(repeated_intervals(docs, window, id_column, text_column, room))
    tidy(docs.sparkSession)
    rows = _with_intervals(docs, found, id_column, text_column, names)

    @F.pandas_udf("string")
    def cut(texts, starts, stops):
        return type(texts)([b" ".join(kept_words(t.encode().split(), a, b)).decode() for t, a, b in zip(texts, starts, stops)], dtype=object)

    whole = F.col(names[2]).isNull()
    text = F.when(whole, F.col(text_column)).otherwise(cut(F.when(~whole, F.col(text_column).cast("string")).otherwise(""), *names[2:]))
    left = rows.withColumn(text_column, text).where(F.col(names[2]).isNull() | (F.length(text_column) > 0))
    return left.select(*docs.columns)


def removal_sql(window: int = 20) -> str:
    """DuckDB twin of ``removal_digests`` over ``documents`` with unique ids."""
    return f"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda v: v <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, s, array_to_string(list_slice(w, s + 1, s + {window}), ' ') AS t
  FROM words, unnest(range(greatest(len(w) - {window - 1}, 0))) AS r(s)
), later AS (
  SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, s) > 1
), gone AS (
  SELECT doc_id, list(DISTINCT s + o) AS spots FROM later, unnest(range({window})) AS r(o) GROUP BY doc_id
), kept AS (
  SELECT doc_id, len(w) AS n, CASE WHEN spots IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(spots, i - 1)) END AS k
  FROM words LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n::BIGINT AS n_words, (n - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
