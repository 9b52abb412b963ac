"""Packing, SentencePiece and token shards against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from contest_panel.llm import packing, queries, sentencepieces, tokens, wavelet

ALPHABET = "  ▁▁aabtheIN.,!?\n\t\r\"'s<s>0129éß中日本語🙂́\x00​</unk>\x1c"


def noise(n, seed=1, longest=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("counts", [{}, {5: 3}, {10: 1}, {4: 5, 6: 5}, {3: 7, 7: 2, 2: 9, 1: 3}, {9: 4, 8: 2}, {10: 2, 1: 25}, {6: 3}])
def test_plan_places_every_piece_once(counts):
    table = np.zeros(11, np.int64)
    for length, n in counts.items():
        table[length] = n
    patterns = packing.plan(table.copy(), 10)
    used = np.zeros(11, np.int64)
    for pattern, times in patterns:
        assert sum(n * c for n, c in pattern.items()) <= 10
        for n, c in pattern.items():
            used[n] += c * times
    assert (used == table).all()
    places = packing.Places(patterns)
    taken = set()
    for length, n in counts.items():
        sequence, offset = places.find(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            cells = {(s, o + i) for i in range(length)}
            assert not cells & taken
            taken |= cells
    full = {}
    for s, _ in taken:
        full[s] = full.get(s, 0) + 1
    assert all((s, i) in taken for s, n in full.items() for i in range(n))


def fewest(pieces, capacity):
    """Least number of sequences, by trying every way."""
    best = len(pieces)

    def go(rest, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        for gap in set(bins):
            if gap >= rest[0]:
                other = bins.copy()
                other.remove(gap)
                go(rest[1:], [*other, gap - rest[0]])
        go(rest[1:], [*bins, capacity - rest[0]])

    go(sorted(pieces, reverse=True), [])
    return best


def test_plan_is_near_the_fewest():
    rng = random.Random(2)
    extra = 0
    for _ in range(40):
        pieces = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        table = np.bincount(pieces, minlength=21)
        extra += sum(t for _, t in packing.plan(table, 20)) - fewest(pieces, 20)
    assert extra <= 2


def check_packing(found, texts, capacity=2048):
    reference = tokens.tokenizer(tokens.token_file("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for key, text in texts.items():
        ids = np.array([*reference.encode(text, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for n, r in enumerate(sorted(by_doc[key], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (n, at) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert n == 0 or r["length"] == capacity
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), -(-sum(r["length"] for r in found) // capacity)


def test_packing_of_all_documents(spark, folder, texts):
    n, least = check_packing(queries.QUERIES["op3_best_fit_packing"](spark, folder).collect(), texts)
    assert n <= least + 1


def test_packing_odd_input(odd, none, odd_rows):
    found = packing.pack(odd).collect()
    assert sum(r["piece"] == 0 for r in found) == len(odd_rows)
    assert {r["length"] for r in found if r["doc_id"] in (0, 1)} == {1}
    assert packing.pack(none).count() == 0


def test_byte_ids_are_the_tokenizers(texts):
    path, ranks = tokens.token_file("byte_bpe_50k.json"), tokens.token_file("byte_bpe_50k.tiktoken")
    every = [*texts.values(), *noise(3000), "<|endoftext|> x", "  ", ""]
    reference = tokens.tokenizer(path)
    assert [list(i) for i in tokens.byte_ids(every, path, ranks)] == [e.ids for e in reference.encode_batch(every, add_special_tokens=False)]


def test_word_encoder_is_the_tokenizers(texts):
    encoder = tokens.WordEncoder(tokens.token_file("word_bpe_49k.json"))
    every = [*texts.values(), *noise(3000), "<|endoftext|> 1 x1", "  ", ""]
    ids, bounds = encoder.encode(every)
    for e, a, b in zip(encoder.tokenizer.encode_batch(every, add_special_tokens=False), bounds, bounds[1:]):
        assert e.ids == ids[a:b].tolist()
    ids, bounds = encoder.encode([])
    assert len(ids) == 0


def test_sentencepiece_round_trip(spark, folder, texts):
    import sentencepiece

    path = tokens.token_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in queries.QUERIES["op5_sentencepiece"](spark, folder).collect():
        ids = library.encode(texts[r["doc_id"]])
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    own = sentencepieces.pieces(path)
    for text in noise(4000, 3):
        ids = library.encode(text)
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids), repr(text)


def test_sentencepiece_odd_input(odd, none, odd_rows):
    found = sentencepieces.digests(odd).collect()
    ids = sentencepieces.encode(odd).collect()
    assert len(found) == len(ids) == len(odd_rows)
    assert {r["n_tokens"] for r in found if r["doc_id"] in (0, 1)} == {0}
    assert sorted((r["doc_id"] or -1, len(r["ids"])) for r in ids) == sorted((r["doc_id"] or -1, r["n_tokens"]) for r in found)
    assert sentencepieces.digests(none).count() == 0


@pytest.mark.parametrize("planes,n", [(16, 5000), (5, 64), (16, 0), (17, 999), (3, 1)])
def test_wavelet_matrix(planes, n):
    ids = np.random.default_rng(n).integers(0, min(1 << planes, 97), n)
    shard = wavelet.Shard(wavelet.pack_shard(pa.array([1]), np.array([n]), ids, planes))
    assert (shard.ids() == ids).all() and (shard.access(np.arange(n)) == ids).all()
    for token in [*range(0, 100, 7), 1 << 20, -1]:
        assert (shard.locate(token) == np.flatnonzero(ids == token)).all() and shard.count(token) == (ids == token).sum()
        if n > 50:
            assert shard.count(token, 13, 40) == (ids[13:40] == token).sum()


def test_shards_of_all_documents(spark, folder, docs, texts):
    reference = tokens.tokenizer(tokens.token_file("word_bpe_49k.json"))
    found = {r["doc_id"]: r for r in queries.QUERIES["op6_token_shards"](spark, folder).collect()}
    at, every = 0, []
    for key in sorted(texts):
        ids = np.array([*reference.encode(texts[key], add_special_tokens=False).ids, 1], "<u4")
        assert (found[key]["start"], found[key]["n_tokens"], found[key]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
        every += ids.tolist()
    shards = wavelet.write_shards(docs, shard_tokens=10_000)
    assert shards.count() > 4
    for token in (1, every[0], 49_000):
        assert sum(r["n"] for r in wavelet.occurrences(shards, token).collect()) == every.count(token)


def test_shards_odd_input(odd, none, odd_rows):
    found = wavelet.read_documents(wavelet.write_shards(odd, shard_tokens=500), "doc_id", "bigint").collect()
    assert len(found) == len(odd_rows)
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])] == sorted((r[0] for r in odd_rows), key=lambda i: -1 if i is None else i)
    assert wavelet.read_documents(wavelet.write_shards(none), "doc_id", "bigint").count() == 0
