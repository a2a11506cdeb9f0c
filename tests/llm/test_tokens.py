"""Encoding, packing and bit-packed files against plain versions."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from medley.llm import bitpack, packing
from medley.llm.tokens import Encoder, Memory, vocabulary_file
from tokenizers import Tokenizer

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def plain_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("name", FILES)
def test_encoder_equals_the_tokenizer(name, awkward, small):
    encoder, tokenizer = Encoder(vocabulary_file(name)), Tokenizer.from_file(vocabulary_file(name))
    rng = random.Random(1)
    letters = ["a", "B", "é", "ß", "Œ", "'s", "'LL", " ", " ", "  ", "\n", "\t", "\r\n", "1", "²", "ª", "×", "_", ".", "!?", "<|endoftext|>", "\x1c", "\xa0", " ", "漢", "é", "İ", "ΑΣ", "\x00", "the", "\U0001f600"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(4000)]
    texts += [r.text or "" for r in awkward.collect()] + [r.text for r in small.collect()]
    for text in texts:
        assert list(np.frombuffer(encoder.encode(text), "<u4")) == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_memory_is_bounded_and_keeps_what_is_used():
    made = []
    memory = Memory(lambda k: made.append(k) or k.encode(), 10)
    for i in range(200):
        assert memory[str(i)] == str(i).encode()
        assert memory["often"] == b"often"
        assert len(memory) <= 10
    assert made.count("often") == 1


def check_packing(docs, pieces, length=2048):
    tokenizer = Tokenizer.from_file(vocabulary_file("byte_bpe_50k.json"))
    want = Counter()
    ids_of = {}
    for r in docs.collect():
        ids = plain_ids(tokenizer, r.text)
        ids_of.setdefault((r.doc_id, len(ids)), []).append(ids)
        want[(r.doc_id, len(ids))] += 1
    spans, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        options = ids_of[(p.doc_id, p.doc_tokens)]
        crcs = {zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for ids in options}
        assert p.ids_crc32 in crcs and p.length > 0
        spans[(p.doc_id, p.doc_tokens)].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert spans.keys() == want.keys()
    for key, copies in want.items():
        covered = Counter(i for start, size in spans[key] for i in range(start, start + size))
        assert covered == {i: copies for i in range(key[1])}
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return sequences


def test_packing(awkward, small, nothing):
    for docs in (awkward, small.repartition(5)):
        pieces = packing.pack(docs).collect()
        sequences = check_packing(docs, pieces)
        used = sum(p.length for p in pieces)
        groups = -(-docs.rdd.getNumPartitions() // packing.PARTS)
        tails = docs.rdd.getNumPartitions() * docs.select("source").distinct().count()
        assert len(sequences) * 2048 - used < 2048 * (2 + groups) + tails * packing.TURN
    assert packing.pack(nothing).count() == 0


def test_windows_follow_the_target_shares(small):
    pieces = packing.pack(small.coalesce(1)).collect()
    total, by_window, tokens = 0, defaultdict(Counter), Counter()
    for p in pieces:
        tokens[p.source] += p.length
        by_window[p.sequence_id][p.source] += p.length
        total += p.length
    served = Counter()
    windows = sum(t // packing.TURN for t in tokens.values()) * packing.TURN // 2048
    for window in range(windows):
        served.update(by_window[window])
        for source in tokens:
            due = (window + 1) * 2048 * tokens[source] / total
            assert abs(served[source] - due) <= 2.5 * packing.TURN


def test_given_shares_decide_the_first_windows(small):
    sources = sorted(r.source for r in small.select("source").distinct().collect())
    pieces = packing.pack(small, shares={sources[0]: 3.0, sources[1]: 1.0}).collect()
    first = Counter()
    for p in pieces:
        if p.sequence_id < 2:
            first[p.source] += p.length
    assert set(first) == set(sources[:2])
    assert abs(first[sources[0]] - 3 * first[sources[1]]) <= 4 * packing.TURN
    check_packing(small, pieces)


def test_bits_round_trip():
    rng = np.random.default_rng(0)
    for bits in (1, 3, 7, 8, 11, 16, 17, 31, 32):
        ids = rng.integers(0, 2**bits, 1003, dtype=np.uint64).astype("<u4")
        data = bitpack.pack_ids(ids, bits)
        assert len(data) == -(-1003 * bits // 8)
        assert np.array_equal(bitpack.unpack_ids(data, bits, 1003), ids)


def test_file_gives_random_access():
    rng = np.random.default_rng(1)
    docs = [(i if i else None, rng.integers(0, 5000, n).astype("<u4").tobytes()) for i, n in enumerate((0, 5, 700, 0, 1))]
    everything = np.frombuffer(b"".join(d for _, d in docs), "<u4")
    file = bitpack.TokenFile(bitpack.dump(docs, 13, block=64))
    assert [(d, ids.astype("<u4").tobytes()) for d, _, ids in file.documents()] == docs
    for start, count in ((0, 706), (63, 2), (64, 64), (705, 1), (100, 0)):
        assert np.array_equal(file.ids(start, count), everything[start : start + count])
    with pytest.raises(IndexError):
        file.ids(700, 7)
    with pytest.raises(ValueError):
        bitpack.dump([(1, np.array([8192], "<u4").tobytes())], 13)


@pytest.mark.parametrize("file_bytes", [bitpack.FILE_BYTES, 2000])
def test_token_files(spark, awkward, small, nothing, file_bytes):
    tokenizer = Tokenizer.from_file(vocabulary_file("word_bpe_49k.json"))
    for docs in (awkward, small.repartition(3), nothing):
        folder = bitpack.token_folder(spark)
        manifest = bitpack.write_token_files(docs, folder, vocabulary_file("word_bpe_49k.json"), 3, file_bytes)
        if manifest.isEmpty():
            assert docs.isEmpty()
            continue
        found = bitpack.read_token_files(spark, folder, manifest).collect()
        want = Counter()
        for r in docs.collect():
            ids = plain_ids(tokenizer, r.text)
            want[(r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        assert Counter((f.doc_id, f.n_tokens, f.ids_crc32) for f in found) == want
        at = 0
        for f in sorted(found, key=lambda f: f.start):
            assert f.start == at
            at += f.n_tokens
        ids = [f.doc_id for f in sorted(found, key=lambda f: f.start)]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
