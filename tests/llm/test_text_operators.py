"""Fingerprints, repeats, divergence, templates and scores against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from terrasift.llm.bwt import repeated_windows
from terrasift.llm.components import components
from terrasift.llm.divergence import judge, keep_good, measures
from terrasift.llm.interpolation import NONE, learn, score
from terrasift.llm.repeats import drop_repeats, removal_digests
from terrasift.llm.simhash import drop_near_copies, fingerprint, grid_masks, linked, near_copies
from terrasift.llm.superstrings import superstrings
from terrasift.llm.templates import drop_leaks, find_leaks
from terrasift.llm.words import word_blocks


def brute_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, most):
    keys = sorted(prints)
    label = {k: k for k in keys}
    again = True
    while again:
        again = False
        for a in keys:
            low = min(label[b] for b in keys if (prints[a] ^ prints[b]).bit_count() <= most)
            if low < label[a]:
                label[a], again = low, True
    return label


def test_word_blocks():
    data = b" a bb\tccc  d\n" * 50
    assert sum(word_blocks(data, most=20), []) == data.split()
    windows = [tuple(b[i : i + 3]) for b in word_blocks(data, 2, most=20) for i in range(len(b) - 2)]
    words = data.split()
    assert windows == [tuple(words[i : i + 3]) for i in range(len(words) - 2)]


def test_fingerprints_and_components(spark, documents, odd, odd_rows, empty):
    texts = list(documents.items())[:150] + [(1000 + k, t or "") for k, (_, t, *_) in enumerate(odd_rows) if t is None or len(t) < 10_000]
    prints = {i: brute_fingerprint(t) for i, t in texts}
    assert all(fingerprint(t.encode()) == prints[i] for i, t in texts)
    label = brute_components(prints, 4)
    got = near_copies(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {i: (f"{prints[i]:016x}", label[i]) for i, _ in texts}
    rows = near_copies(odd).collect()
    assert len(rows) == len(odd_rows) and {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 4)} == {1}
    assert near_copies(empty).count() == 0
    kept = drop_near_copies(odd)
    assert kept.columns == odd.columns and Counter(r["doc_id"] for r in kept.collect())[6] == 1


@pytest.mark.parametrize("crowd", [8192, 7])
def test_links_by_grid(spark, crowd):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) & (1 << 64) - 1 for b in base for _ in range(8)} | {0, (1 << 64) - 1}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = linked(spark.createDataFrame(signed, "bits bigint"), crowd=crowd).collect()
    unsigned = lambda x: x % (1 << 64)
    assert all((unsigned(u) ^ unsigned(v)).bit_count() <= 4 for u, v in edges)
    label = brute_components({p: p for p in prints}, 4)
    found = {p: p for p in prints}
    for u, v in edges:
        a, b = found[unsigned(u)], found[unsigned(v)]
        found = {p: min(a, b) if r in (a, b) else r for p, r in found.items()}
    assert found == label
    assert len(grid_masks(4)) == 15


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 120), (120, 110), (7, 7)] + [(200, 200 + k) for k in range(1, 30)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()))
    assert got == {i: 0 for i in range(41)} | dict.fromkeys((100, 110, 120), 100) | dict.fromkeys(range(200, 230), 200)
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_repeated_windows_by_brute_force():
    rng = random.Random(4)
    for case in range(150):
        letters, w = (b"ab", b"abc\x00\xff")[case % 2], rng.choice([1, 2, 3, 5, 8, 15])
        strings = [bytes(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 5))]
        seen = Counter(s[i : i + w] for s in strings for i in range(len(s) - w + 1))
        assert [f.tolist() for f in repeated_windows(strings, w)] == [[seen[s[i : i + w]] > 1 for i in range(len(s) - w + 1)] for s in strings]


def test_superstrings_cover_windows():
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 100, n, np.uint8).tobytes() for n in (500, 10, 0, 100, 900, 99)]
    texts.append(texts[0][50:400] + b"x" * 300)
    bounds = np.cumsum([0, *map(len, texts)])
    text, start, length, name, twice = superstrings(np.frombuffer(b"".join(texts), np.uint8), bounds, 100)
    names = {}
    for t, s, n, k in zip(text, start, length, name):
        for p in range(s, s + n - 99):
            assert bounds[t] <= p and p + 100 <= bounds[t + 1] and p not in names
            names[p] = k
    assert len(names) == sum(max(0, len(t) - 99) for t in texts)
    raw, by_window = b"".join(texts), {}
    for p, k in names.items():
        assert by_window.setdefault(raw[p : p + 100], k) == k
    assert twice[-1]  # a run of one letter repeats its own windows


def brute_removal(texts, w):
    seen = Counter(t[i : i + w] for t in texts for i in range(len(t) - w + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - w + 1):
            if seen[t[i : i + w]] > 1:
                gone[i] += 1
                gone[i + w] -= 1
        flags = np.cumsum(gone)[:-1] > 0
        starts = int((np.diff(flags.astype(int), prepend=0) == 1).sum())
        left = np.frombuffer(t, np.uint8)[~flags].tobytes()
        out.append((len(t), int(flags.sum()), starts, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"block": 2000, "crowd": 1200}])
def test_removal(spark, documents, options):
    texts = {i: t for i, t in documents.items() if len(t) < 5000}
    texts |= {1000: "é" * 700, 1001: "ab" * 600, 1002: None, 1003: "", 1004: texts[0][40:], 1005: "ü" + texts[0][60:] + "x"}
    got = removal_digests(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), **options).collect()
    want = brute_removal([(t or "").encode() for t in texts.values()], 400)
    assert {r[0]: tuple(r)[1:] for r in got} == dict(zip(texts, want))


def test_removal_of_odd_rows(odd, odd_rows, empty):
    rows = removal_digests(odd, window=64).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in odd_rows)
    left = drop_repeats(odd, window=64)
    assert left.columns == odd.columns
    kept = {r["doc_id"]: r["text"] for r in left.collect()}
    assert 6 not in kept and 13 not in kept and kept[9].endswith("own") and kept[1] is None and kept[5] == odd_rows[4][1]
    assert removal_digests(empty).count() == 0 and drop_repeats(empty).count() == 0


def test_divergence(spark, odd, odd_rows, empty):
    text = "The cat sat\non the mat, THE cat sat\non the mat, # & é"
    base, classes, common = measures(text.encode())
    assert base == [15, 39, 2, 0, 10] and int(classes.sum()) == len(text) and int(common.sum()) == 15
    assert measures(b"a\n\na\na b\n a\n")[0][3] == 1
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    common = "the of and a to in is was that for it with as on be".split()
    clean = [(i, " ".join(rng.choice([rng.choice(common), word()]) for _ in range(150)) + ".", "en") for i in range(60)]
    junk = [(100, " ".join(word() + "%%%" for _ in range(150)), "en"), (101, " ".join(word().upper() + "!!" for _ in range(150)), "en")]
    docs = spark.createDataFrame([*clean, *junk, (102, junk[0][1], "xx"), (103, None, None)], "doc_id bigint, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in judge(docs).collect()}
    assert all(kept[i] for i in range(60)) and not kept[100] and not kept[101]
    assert kept[102] and not kept[103]  # no reference for its language; no words
    assert {r["doc_id"] for r in keep_good(docs).collect()} == {i for i, ok in kept.items() if ok}
    assert Counter(r["doc_id"] for r in judge(odd).collect()) == Counter(i for i, *_ in odd_rows)
    assert keep_good(odd).columns == odd.columns
    assert judge(empty).count() == 0 and keep_good(empty).count() == 0


def test_rows_are_judged_by_their_own_text(spark, documents):
    good = [t for t in documents.values() if len(t.split()) > 100][:40]
    rows = [(None, good[0]), (None, "too short"), (5, good[1]), (5, "junk " * 200), (5, "too short"), (5, "too short"), *enumerate(good, 10)]
    kept = keep_good(spark.createDataFrame([(i, t, "en", 1) for i, t in rows], "doc_id bigint, text string, lang string, row_key int"))
    assert kept.columns == ["doc_id", "text", "lang", "row_key"]
    found = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert not any(t == "too short" or t.startswith("junk ") for _, t in found)
    assert found[None, good[0]] == 1 and found[5, good[1]] == 1


def test_templates(spark, odd, odd_rows, empty):
    item = "A train leaves Rome with 120 people and travels to Milan for 3 hours; how many of the 120 people does Anna count in Milan"
    items = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (None, item), (1, item)], "item_id bigint, text string")
    body = "so says the book. {} And then it went on with other words that nobody needs"
    texts = {
        10: body.format(item),
        11: body.format(item.replace("120", "75").replace("Milan", "Turin").replace("Anna", "Maria").replace("3 hours", "4 hours")),
        12: body.format(item.replace("of the 120", "of the 80").replace("in Milan", "in Genoa")),
        13: body.format(item.lower().upper()),
        14: "A train leaves Rome with 120 people and some other words follow here that are not the item's",
        15: None, 16: "",
    }
    got = {r["doc_id"]: r for r in find_leaks(spark.createDataFrame([*texts.items(), (10, texts[10])], "doc_id bigint, text string"), items).collect()}
    assert got[10]["contaminated"] and not got[10]["other_values"] and got[10]["share"] == 1.0
    assert got[11]["contaminated"] and got[11]["other_values"] and got[11]["share"] == 1.0
    assert got[12]["share"] < 1.0  # one item value would stand for two document values
    assert not got[14]["contaminated"] and got[15]["matched"] == 0 and got[16]["item_id"] is None
    assert Counter(r["doc_id"] for r in find_leaks(odd, items).collect()) == Counter(i for i, *_ in odd_rows)
    nothing = items.where("item_id = 99")
    assert find_leaks(odd, nothing).where("contaminated").count() == 0 and find_leaks(empty, items).count() == 0
    left = drop_leaks(odd, items)
    assert left.columns == odd.columns and left.count() == len(odd_rows)


def brute_scores(texts, order=2):
    tokens = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    part = {i: {1: 2, 4: 1}.get(zlib.crc32(str(i).encode()) % 5, 0) for i in tokens}

    def counted(parts):
        one, two = Counter(), Counter()
        for i, t in tokens.items():
            if part[i] in parts:
                one.update(t)
                two.update(zip(["begin", *t[:-1]], t))
        return one, two, sum(part[i] in parts for i in tokens)

    def shares(t, one, two, docs):
        before, n, v = "begin", sum(one.values()), len(one)
        for w in t:
            c = docs if before == "begin" else one[before]
            bucket = min(23, 1 + int(math.log2(c))) if c else 0
            yield bucket, 1 / (v + 1), one[w] / n if n else 0.0, two[before, w] / c if c else 0.0
            before = w

    events = Counter()
    for i, t in tokens.items():
        if part[i] == 1:
            for b, p0, *ps in shares(t, *counted({0})):
                events[(b, *[round(8 * math.log2(p / p0)) if p else NONE for p in ps])] += 1
    weights = learn(np.array(sorted((*k, n) for k, n in events.items()), np.int64).reshape(-1, 4), order)
    one, two, docs = counted({0, 1})
    n, v = sum(one.values()), len(one)
    out = {}
    for i, t in tokens.items():
        base = sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        own = sum(math.log10(weights[b] @ np.array(p)) for b, *p in shares(t, one, two, docs))
        out[i] = (part[i] == 2, len(t), sum(one[w] > 0 for w in t), n, base, own)
    return out


@pytest.mark.parametrize("options", [{}, {"chunk_tokens": 700, "bucket_keys": 500}])
def test_scores(spark, documents, options):
    texts = dict(list(documents.items())[:60])
    want = brute_scores(texts)
    got = score(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), **options).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:5] == want[r[0]][:4]
        assert tuple(r)[5:] == pytest.approx(want[r[0]][4:], rel=1e-9)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_of_odd_rows(odd, odd_rows, empty):
    rows = score(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in odd_rows)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert score(odd, order=3).count() == len(odd_rows)
    assert score(odd.where("doc_id = 3")).count() == 1
    assert score(empty).count() == 0
