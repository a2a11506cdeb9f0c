"""Token counts against the libraries' own encoding of each whole text."""

import random

import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from medley.llm import queries, token_counts

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]


def plain_counts(name, texts):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(model.encode(t)) for t in texts]
    model = Tokenizer.from_file(path)
    return [len(model.encode(t, add_special_tokens=False)) for t in texts]


def odd_texts(count):
    """Texts of blanks of every kind, marks, combining letters and special strings."""
    rng = random.Random(11)
    letters = list("ab. \n\t\r\x0b'1é \x1c\x85 ́漢😀Σ_-") + ["<|endoftext|>", " the", "  ", "'s", "\n\n", "▁", "<s>", "x" * 50]
    return ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(count)]


@pytest.mark.parametrize("name", FILES)
def test_counts_equal_the_library(name):
    texts = odd_texts(4000)
    want = plain_counts(name, texts)
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        counters = [token_counts.SentencePieceCounter(path), token_counts.SentencePieceCounter(path, portion=7)]
    else:
        # small portions, inputs and memories: every text is cut and lengths are forgotten
        counters = [token_counts.TokenizersCounter(path), token_counts.TokenizersCounter(path, 7, 20, 50)]
    for counter in counters:
        assert counter.safe
        assert counter.count(texts).tolist() == want
        assert counter.count(texts[::-1]).tolist() == want[::-1]


def test_memory_is_bounded():
    counter = token_counts.TokenizersCounter(public_tokenizers.path(FILES[0]), portion=2000, kept=100)
    text = " ".join(f"word{i}" for i in range(20_000))
    assert counter.count([text]).tolist() == plain_counts(FILES[0], [text])
    assert len(counter.young) + len(counter.old) < 2000


def test_blocks_end_at_safe_boundaries_and_keep_the_text():
    text = "one two\n three  four" + "x" * 100 + " five"
    for size in (1, 5, 30, 1000):
        cut = token_counts.blocks(text, token_counts.BEFORE_SAFE, size)
        assert "".join(cut) == text
        assert all(not a[-1].isspace() and b[0].isspace() for a, b in zip(cut, cut[1:]))
    assert max(map(len, token_counts.blocks("word " * 1000, token_counts.BEFORE_SAFE, 50))) <= 55


def test_vocabularies_without_boundaries_get_whole_texts(tmp_path):
    """An added token that takes in blanks makes no boundary safe."""
    model = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    model.add_tokens(["odd token"])
    model.save(f"{tmp_path}/odd.json")
    counter = token_counts.TokenizersCounter(f"{tmp_path}/odd.json", portion=4)
    text = "an odd token, an odd token"
    assert not counter.safe
    assert counter.count([text, ""]).tolist() == [len(model.encode(text)), 0]


@pytest.mark.parametrize("name", FILES)
def test_rows(awkward, nothing, name):
    path = public_tokenizers.path(name)
    rows = awkward.collect()
    want = plain_counts(name, [r.text or "" for r in rows])
    expected = [(r.doc_id, len((r.text or "").encode()), n, n > 512) for r, n in zip(rows, want)]
    got = [tuple(r) for r in token_counts.count_tokens(awkward, path).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert token_counts.count_tokens(nothing, path).count() == 0


def test_query_over_the_test_table(spark, small):
    rows = small.collect()
    want = plain_counts(FILES[0], [r.text or "" for r in rows])
    got = queries.QUERIES["op12_batch_token_counts"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    expected = [(r.doc_id, len((r.text or "").encode()), n, n > 512) for r, n in zip(rows, want)]
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    assert any(over for *_, over in expected)
