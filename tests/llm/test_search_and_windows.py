"""Repeated windows, ranked search and whitening against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from terrasift.llm import ranked, substrings, whitening


def brute_windows(rows, width):
    """Kept words of (id, text) rows; distinct (id, text) are the documents, null ids last."""
    order = sorted({(i is None, i or 0, substrings_key(t), t or "") for i, t in rows})
    seen, kept = set(), {}
    for none, i, _, t in order:
        w = t.encode().split()
        gone = set()
        for s in range(len(w) - width + 1):
            window = tuple(w[s : s + width])
            if window in seen:
                gone.update(range(s, s + width))
            seen.add(window)
        kept[None if none else i, t] = len(w), [x for k, x in enumerate(w) if k not in gone]
    return kept


KEYS: dict = {}


def substrings_key(text):
    return KEYS.get(text, 0)


@pytest.fixture(scope="module")
def copied(documents, odd_rows):
    rng = random.Random(3)
    rows = [(i, t) for i, t in documents.items()] + [(r[0] if r[0] is None else 10_000 + r[0], r[1]) for r in odd_rows]
    passage = " ".join(f"p{rng.randrange(999)}" for _ in range(70))
    for k in range(60):  # a third share one passage, some start in its middle
        own = " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40)))
        rows.append((20_000 - k, f"{own} {passage[rng.randrange(80):]}\n {own}"))
    rows += [(30_000, "one id " * 30), (30_000, "one id " * 31 + "end"), (30_000, "one id " * 30)]
    return rows


@pytest.mark.parametrize("width, room, piece", [(20, 1 << 21, 4 << 20), (20, 500, 2000), (3, 900, 100), (1, 1 << 21, 4 << 20)])
def test_repeated_windows(spark, copied, monkeypatch, width, room, piece):
    from pyspark.sql import functions as F

    monkeypatch.setattr(substrings, "by_bytes", lambda b, c, most, f=substrings.by_bytes: f(b, c, piece))
    docs = spark.createDataFrame(copied, "doc_id bigint, text string").repartition(5)
    KEYS.update({r["text"]: r["k"] for r in docs.select("text", F.xxhash64("text").alias("k")).collect()})
    want = brute_windows(copied, width)
    got = substrings.removal_digests(docs, window=width, room=room).collect()
    assert len(got) == len(copied)
    mine = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got)
    facts = [(i, *want[i, t or ""]) for i, t in copied]
    assert mine == sorted((str(i), n, n - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for i, n, k in facts)
    if room == 500:
        left = substrings.drop_repeated_windows(docs.withColumn("starts", F.lit(1)), window=width, room=room)
        assert left.columns == ["doc_id", "text", "starts"]
        kept = sorted(str((r["doc_id"], (r["text"] or "").encode().split())) for r in left.collect())
        assert kept == sorted(str((i, k)) for i, n, k in facts if not n or k)


def test_one_long_text_in_pieces(monkeypatch):
    text = " ".join(f"t{i % 7} u{i}" for i in range(300))
    whole = list(substrings.windows(pa.RecordBatch.from_pydict({"text": [text]}), 20))
    monkeypatch.setattr(substrings, "text_pieces", lambda data, f=substrings.text_pieces: f(data, 50))
    parts = list(substrings.windows(pa.RecordBatch.from_pydict({"text": [text]}), 20))
    both = list(substrings.windows(pa.RecordBatch.from_pydict({"text": [text, "x"]}), 20))
    assert len(whole) == 1 < len(parts) and len(whole[0][0]) == 581
    for k in range(4):
        assert np.concatenate([p[k] for p in parts]).tolist() == whole[0][k].tolist() == both[0][k].tolist()


def test_windows_of_odd_tables(spark, odd, odd_rows, empty):
    assert substrings.removal_digests(odd).count() == len(odd_rows)
    assert substrings.removal_digests(empty).count() == 0 == substrings.drop_repeated_windows(empty).count()


def test_rolling_hashes_are_polynomials():
    rng = np.random.default_rng(1)
    x = rng.integers(0, substrings.P, 60, dtype=np.uint64)
    for width in (1, 2, 3, 7, 20, 60, 61):
        got = substrings.window_hashes(x, width, substrings.BASE_P, substrings.P, substrings.times_p)
        want = [sum(int(v) * pow(substrings.BASE_P, width - 1 - j, substrings.P) for j, v in enumerate(x[i : i + width])) % substrings.P for i in range(61 - width)]
        assert got.tolist() == want


def brute_search(docs, queries, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    rows = [(i, terms(t)) for i, t in docs]
    n, total = sum(1 for _, t in rows if t), sum(len(t) for _, t in rows)
    df = {}
    for _, t in rows:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    wanted = {}
    for i, t in queries:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in wanted.items():
        found = []
        for i, t in rows:
            m = 50 + 50 * len(t) * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 20 * m)) for x in words if x in t)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(map(str, out))


@pytest.mark.parametrize("k, block, pairs", [(50, 16 << 20, 1 << 20), (5, 3000, 1 << 20), (3, 20_000, 60)])
def test_ranked_search(spark, documents, odd_rows, monkeypatch, k, block, pairs):
    docs = [(i, t) for i, t in documents.items()] + [(r[0], r[1]) for r in odd_rows if len(r[1] or "") < 50_000]
    rng = random.Random(9)
    words = " ".join(documents.values()).split()
    queries = [(q, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25)))) for q in range(25)]
    queries += [(100, None), (101, " ?! "), (102, "nosuchterm"), (None, "the of"), (103, docs[3][1]), (103, docs[4][1]), (104, "ÄRGER Straße é 22")]
    monkeypatch.setattr(ranked, "BLOCK", block)
    found = ranked.search(
        spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(queries, "item_id bigint, text string"), k=k, pairs=pairs
    )
    got = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()]
    assert sorted(map(str, got)) == brute_search(docs, queries, k)


@pytest.mark.parametrize("stride", [1, 7, 64, 1000])
def test_skipping_loses_nothing(stride):
    rng = np.random.default_rng(stride)
    for _ in range(60):
        size, k = int(rng.integers(1, 300)), int(rng.integers(1, 12))
        best, total = ranked.Best(k), []
        for block in range(3):
            sums, lists = np.zeros(size, np.int64), []
            for _ in range(rng.integers(1, 9)):
                docs = np.flatnonzero(rng.random(size) < rng.random() ** 3)
                values = rng.integers(0, int(10 ** rng.integers(1, 4)), len(docs))
                if len(docs):
                    lists.append((docs, values, int(values.max())))
                    np.add.at(sums, docs, values)
            ids, none = rng.permutation(size) + 1000 * block, rng.random(size) < 0.1
            if lists:
                ranked.evaluate(lists, size, best, ids, none, stride)
            total += [(-s, n, i) for s, n, i in zip(sums.tolist(), none.tolist(), ids.tolist()) if s]
        best.add(*(np.zeros(0, t) for t in (np.int64, np.int64, bool)))
        got = sorted(zip((-best.score).tolist(), best.none.tolist(), best.id.tolist()))
        assert got == sorted(total)[:k]


def test_search_of_odd_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "word tail", 5)], "item_id bigint, text string, score int")
    assert {r["doc_id"] for r in ranked.search(odd, items).collect()} == {3, 9}
    assert ranked.search(empty, items).count() == 0 == ranked.search(odd, items.limit(0)).count()


def test_one_long_text(monkeypatch):
    text = " ".join(f"t{i % 7}" for i in range(1000))
    monkeypatch.setattr(ranked, "text_pieces", lambda data, f=ranked.text_pieces: f(data, 64))
    n, code, doc, tf = ranked.block_counts(pa.RecordBatch.from_pydict({"text": [text]}), pa.array(["t0", "t6", "x"]))
    assert n.tolist() == [1000] and code.tolist() == [0, 1] and doc.tolist() == [0, 0] and tf.tolist() == [143, 142]
    assert ranked.length_mass(np.array([10**8, 7]), 10**11, 10**14).tolist() == [50 + 50 * 10**8 * 10**11 // 10**14, 50]


def brute_whitening(rows, components, by_count=False):
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    kinds = {}
    for _, x in good:
        kinds[tuple(x)] = kinds.get(tuple(x), 0) + 1
    x = np.array([k for k, c in kinds.items() for _ in range(c if by_count else 1)])
    n, s = len(x), x.sum(axis=0)
    z = x - s / n
    values, axes = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-values)[:components]
    out = {}
    for i, own in good:
        v = np.array(own)
        out.setdefault(i, []).append((int(((n * v - s) ** 2).sum()), ((v - s / n) @ axes[:, order] / np.sqrt(values[order]))))
    return n, values[order] / values.sum(), out


@pytest.mark.parametrize("by_count", [False, True])
def test_whitening(spark, by_count):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20))
    rows = [(k, [float(c) for c in np.float32(base[k % 300])]) for k in range(400)]
    rows += [(1000 + k, rows[7][1]) for k in range(200)] + [(None, rows[8][1]), (5, rows[9][1])]
    bad = [(2000, None), (2001, [None] * 20), (2002, [float("nan")] * 20), (2003, [*rows[0][1][:-1], float("inf")]), (2004, []), (2005, [1.0, 2.0]), (2006, [3e38] * 20)]
    table = spark.createDataFrame([(i, v, 3) for i, v in rows + bad], "vec_id bigint, embedding array<float>, n int").repartition(4)
    got = whitening.whiten(table, 16, by_count).collect()
    n, explained, want = brute_whitening(rows, 16, by_count)
    assert len(got) == 16 * len(rows) and {r["n"] for r in got} == {n}
    assert {r["identity_error"] for r in got if r["identity_error"] > 1e-6} == set()
    mine = {}
    for r in got:
        mine.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r["whitened"]
        assert math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-9)
    sign = {}
    for i, found in want.items():
        for deviation, values in found:
            for c in range(16):
                value = mine[i, deviation][c + 1]
                sign.setdefault(c, 1 if value * values[c] > 0 else -1)
                assert math.isclose(value, sign[c] * values[c], rel_tol=1e-6, abs_tol=1e-6)


def test_whitening_of_odd_tables(spark):
    kind = "vec_id bigint, embedding array<float>, copies int, x string"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 1, ""), (2, [], 1, "")], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1, ""), (2, [1.0, 2.0], 1, "")], kind)).count() == 0  # no variance
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1, ""), (2, [3.0, 2.0], 1, ""), (3, [3.0, 2.0], 1, "")], kind)).collect()
    assert [(r["vec_id"], r["component"], abs(r["whitened"]), r["explained"]) for r in sorted(flat)] == [(i, 1, 1.0, 1.0) for i in (1, 2, 3)]
    assert {r["deviation"] for r in flat} == {64**2 * 4}
    x = np.array([[2**55, 0], [0, 1]])
    assert whitening.deviation(x, 10**4, [5, 5]).to_pylist() == [None, 5**2 + (10**4 - 5) ** 2]
