"""Token counts, coded files and packing against the tokenizer itself."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from terrasift.llm.huffman import STEP, canonical_codes, code_lengths, decode_blocks, decode_table, encode_block, read_digests, read_file, write_documents
from terrasift.llm.packing import cut, fullest, pack, plan_bins
from terrasift.llm.pieces import PieceEncoder, byte_level_pieces, byte_level_text, encoder, stretches
from terrasift.llm.token_counts import token_lengths

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a  b", " x", "x ", "a\n b \n c", "a<|endoftext|> b <|endoftext|>  c", "é é ́x", "x\x1cy z", "don't I'll 'S x's", "1 22 333,4.5 你 好", "A\u3000B C  D", "\n x", " \n", "ǅ ɐb Ωμ"]


@pytest.mark.parametrize(("path", "kind"), [(BYTES, "bytes"), (WORDS, "words")])
def test_pieces_encode_as_whole_texts(path, kind, documents):
    own, whole = encoder(path, kind), Tokenizer.from_file(path)
    texts = ODD + list(documents.values())[:60]
    ids, counts = own.encode(texts)
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(x) for x in want]
    assert ids.tolist() == sum(want, [])
    assert own.count(texts).tolist() == counts.tolist()


def test_memory_stays_bounded(documents):
    own = PieceEncoder(BYTES, byte_level_pieces, byte_level_text, limit=500)
    whole = Tokenizer.from_file(BYTES)
    for t in list(documents.values())[:40]:
        assert own.encode([t])[0].tolist() == whole.encode(t, add_special_tokens=False).ids
        assert own.n <= 500 + len(set(byte_level_pieces(t)))


def test_stretches_join_again():
    rng = random.Random(1)
    text = "".join(rng.choice("ab  \n") for _ in range(5000))
    assert "".join(stretches(text, 100)) == text
    assert list(stretches("x" * 500, 100)) == ["x" * 500]


def test_token_lengths(spark, odd, odd_rows, empty):
    whole = Tokenizer.from_file(WORDS)
    got = Counter(map(tuple, token_lengths(odd, WORDS).collect()))
    want = Counter()
    for i, t, *_ in odd_rows:
        n = len(whole.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 2048)] += 1
    assert got == want
    assert token_lengths(empty, WORDS).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 50, 3000])
def test_codes_are_optimal_and_round_trip(n):
    import heapq

    rng = np.random.default_rng(n)
    counts = rng.zipf(1.5, n).clip(1, 100_000)
    lengths = code_lengths(counts)
    heap, cost = sorted(counts.tolist()), 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    assert lengths.max() <= 18 and (2.0 ** -lengths.astype(float)).sum() <= 1
    if n > 1 and max(counts) < 200 * n:
        assert (lengths * counts).sum() <= cost * 1.001
    ids = rng.integers(0, n, 1000)
    bits, starts = encode_block(ids, lengths, canonical_codes(lengths))
    left = np.minimum(STEP, len(ids) - STEP * np.arange(len(starts)))
    table = decode_table(lengths)
    assert (decode_blocks(bits, starts, left, table) == ids).all()
    assert (decode_blocks(bits, starts[2:], left[2:], table) == ids[2 * STEP :]).all()  # from a checkpoint


def _ids(tokenizer, text, end):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def test_coded_file(spark, odd, odd_rows, empty, tmp_path):
    path = f"file://{tmp_path}/file"
    write_documents(odd, path, BYTES, end_id=2)
    whole = Tokenizer.from_file(BYTES)
    rows = read_digests(spark, path).orderBy("start").collect()
    order = [r["doc_id"] for r in rows]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4"))) for i, x in ((i, _ids(whole, t, 2)) for i, t, *_ in odd_rows))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    back = read_file(spark, path).where("doc_id = 5").first()
    assert np.frombuffer(back["ids"], "<u4").tolist() == _ids(whole, next(t for i, t, *_ in odd_rows if i == 5), 2)
    write_documents(empty, path + "-empty", BYTES, end_id=2)
    assert read_digests(spark, path + "-empty").count() == 0


def test_fullest_by_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        counts = Counter(rng.randrange(1, 12) for _ in range(rng.randrange(1, 8)))
        room = rng.randrange(0, 30)
        sums = {0}
        for n in counts.elements():
            sums |= {s + n for s in sums if s + n <= room}
        found = fullest(dict(counts), room)
        assert sum(n * k for n, k in found.items()) == max(sums)
        assert all(counts[n] >= k for n, k in found.items())


def test_plan_uses_every_piece_once():
    counts = {7: 5, 5: 9, 3: 1, 2: 4, 10: 2}
    plan = plan_bins(counts, 10)
    filled = Counter()
    for n, c in counts.items():
        seq, off = plan.place(np.full(c, n), np.arange(c))
        for s, o in zip(seq.tolist(), off.tolist()):
            filled.update((s, o + k) for k in range(n))
    assert set(filled.values()) == {1} and all(o < 10 for _, o in filled)
    assert len({s for s, _ in filled}) == plan.sequences == -(-sum(n * c for n, c in counts.items()) // 10)


def test_cut():
    assert cut(5, 4) == [(0, 1), (1, 4)] and cut(4, 4) == [(0, 4)] and cut(9, 4) == [(0, 1), (1, 4), (5, 4)] and cut(1, 4) == [(0, 1)]


def test_packing(spark, odd, odd_rows, empty):
    whole = Tokenizer.from_file(BYTES)
    got = pack(odd, BYTES, capacity=64).collect()
    want = Counter()
    for i, t, *_ in odd_rows:
        ids = _ids(whole, t, 0)
        for k, (a, n) in enumerate(cut(len(ids), 64)):
            want[(i, k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4")))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    at = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 64
    assert len(at) <= 1.02 * -(-sum(at.values()) // 64)
    assert pack(empty, BYTES).count() == 0
