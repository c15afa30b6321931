"""Exact near copies against brute force."""

import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from terrasift.llm import similar
from terrasift.llm.simhash import drop_near_copies, fingerprint, shingle_hashes


def brute_groups(texts, words=5):
    def shingles(t):
        w = (t or "").lower().encode().split()
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


@pytest.fixture(scope="module")
def edited(documents):
    """Texts, edited copies of them at all similarities, and odd texts."""
    rng = random.Random(11)
    texts = [t for t in documents.values() if len(t.split()) < 400][:60]
    for t in [t for t in texts if len(t.split()) > 40][:25]:
        for edits in (1, 1, 2, 3, 5, 8):
            w = t.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    return [*texts, "", None, " \n", "one two", "ONE  two", "one two three", "a b c d e f g h", "x a b c d e f g h"]


@pytest.mark.parametrize("rounds, crowd", [(similar.ROUNDS, similar.CROWD), ((1, None), similar.CROWD), (similar.ROUNDS, 3)])
def test_similar_texts(spark, edited, monkeypatch, rounds, crowd):
    monkeypatch.setattr(similar, "ROUNDS", rounds)
    monkeypatch.setattr(similar, "CROWD", crowd)
    monkeypatch.setattr(similar, "SAMPLE", 2)
    docs = spark.createDataFrame(list(enumerate(edited)), "doc_id bigint, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    assert kept == sorted(set(brute_groups(edited)))
    assert corpus_pipeline.near_copies(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("drop", [drop_near_copies, similar.drop_similar])
def test_null_and_repeated_ids(spark, drop):
    rng = random.Random(12)
    text = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(7)]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (5, text[2]), (5, text[3]), (5, text[3]), (None, text[4]), (8, text[4]), (1, text[5]), (5, text[5]), (5, text[6]), (7, text[6])]
    got = sorted(map(tuple, drop(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    kept = [(None, text[0]), (None, text[1]), (5, text[2]), (5, text[3]), (8, text[4]), (1, text[5]), (5, text[6])]
    assert got == sorted(kept, key=str)


def test_no_fragments_of_long_texts():
    huge = "x" * (1 << 20)
    for text in (f"a b c d {huge} ", f"{huge} {huge} a b c d e", f"{huge} a {huge}", "a b", " "):
        w = text.encode().split()
        want = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
        got = np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text.encode(), 4, 42)])
        assert got.tolist() == [xxhash.xxh64_intdigest(x, 42) for x in want]


def test_fingerprint_search_links_texts(spark, monkeypatch):
    """The segment-popcount search alone connects what lies within its bits and is similar."""
    monkeypatch.setattr(similar, "ROUNDS", ())
    rng = random.Random(13)
    texts = []
    for _ in range(12):
        w = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        texts += [" ".join(w), " ".join(w[:-1]), " ".join([*w[:-1], "tail"]), " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))]
    prints = [fingerprint(t.encode(), 5, 42) for t in texts]
    near = [[(a ^ b).bit_count() <= 4 for b in prints] for a in prints]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if near[i][j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert len(set(label)) <= 30  # unrelated texts are far apart, edited ones mostly near
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = sorted(r["doc_id"] for r in similar.drop_similar(docs).collect())
    assert kept == sorted(set(label))
