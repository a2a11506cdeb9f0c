"""Language ID, license scans, personal data and document scores."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from medley.llm import langid, licenses, pii, pseudo_lm
from pyspark.sql import functions as F


# language ID


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([4, 1, 3])
    scores, moves = rng.normal(size=(3, 4, 3)), rng.normal(size=(3, 3))
    scores[np.arange(4) >= lengths[:, None]] = 0
    gamma, expected, partition = langid.posteriors(scores, moves, lengths)
    want = np.zeros((3, 3))
    for n, length in enumerate(lengths):
        weights = {
            path: math.exp(
                sum(scores[n, t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))
            )
            for path in itertools.product(range(3), repeat=int(length))
        }
        total = sum(weights.values())
        assert math.isclose(partition[n], math.log(total))
        for t in range(length):
            for y in range(3):
                assert math.isclose(gamma[n, t, y], sum(w for p, w in weights.items() if p[t] == y) / total)
        for path, w in weights.items():
            for a, b in zip(path, path[1:]):
                want[a, b] += w / total
    assert np.allclose(expected, want)


def test_held_out_accuracy(small):
    rows = langid.identify(small, langid.train(small)).withColumn("held", langid.held_out(F.col("doc_id"))).collect()
    known = [r for r in rows if r.held and r.lang is not None]
    assert len(known) > 20
    assert sum(r.lang == r.lang_pred for r in known) / len(known) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_is_the_remainder_of_the_id(spark):
    rows = spark.range(-5, 60).select("id", langid.held_out(F.col("id")).alias("held")).collect()
    assert all(r.held == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_awkward_texts(spark, awkward, nothing, small):
    field = langid.train(small)
    rows = langid.identify(awkward, field).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters)
        assert letters or r.score == 0
    assert langid.identify(nothing, field).count() == 0
    empty = langid.train(nothing)
    assert {r.lang_pred for r in langid.identify(awkward, empty).collect()} == {"und"}
    one = langid.train(small.withColumn("lang", F.lit("en")))
    assert {r.lang_pred for r in langid.identify(small, one).collect()} <= {"en", "und"}


def test_words_of_a_switched_text_get_their_own_language(small):
    field = langid.train(small)
    rows = {r.lang: r.text for r in small.filter("not (lang is null)").collect() if len(r.text) > 800}
    first, second = [" ".join(langid.words(rows[lang])[:40]) for lang in ("en", "fr")]
    expected = langid.Tagger(field).expected_words([first + " " + second])[0]
    share = dict(zip(field.labels, expected / expected.sum()))
    assert abs(share["en"] - 0.5) < 0.1 and abs(share["fr"] - 0.5) < 0.1


# licenses


def longest(values):
    best = []
    for i, v in enumerate(values):
        best.append(1 + max([best[j] for j in range(i) if values[j] < v], default=0))
    return max(best, default=0)


def test_increasing_run_is_longest():
    rng = random.Random(0)
    for _ in range(300):
        values = [rng.randrange(12) for _ in range(rng.randrange(12))]
        chosen = [values[i] for i in licenses.increasing(values)]
        assert chosen == sorted(set(chosen)) and len(chosen) == longest(values)


def test_alignment_is_increasing_and_finds_copies():
    rng = random.Random(1)
    for _ in range(200):
        template = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))]
        text = [rng.choice("abcdefgh") for _ in range(rng.randrange(12))]
        pairs = licenses.align(text, template)
        assert all(text[i] == template[j] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
        assert len(licenses.align(template, template)) == len(template)


def test_planted_licenses_are_found():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    filler = "the version of a license that was under and to general work is in public"
    for name, template in licenses.TEMPLATES.items():
        text = f"{filler}. zebra {template} quagga. {filler} zebra {template.upper()} end"
        found = scanner.scan(text)
        assert [(f[0], f[3]) for f in found] == [(name, 1.0)] * 2, name
        for _, start, end, _ in found:
            assert [w.lower() for w in licenses.WORD.findall(text[start:end])] == scanner.templates[name]
        words = template.split()
        if len(words) > 40:
            changed = [w for i, w in enumerate(words) if i % 12 != 5]
            changed.insert(20, "inserted words here")
            assert [f[0] for f in scanner.scan(" ".join(changed))] == [name]
        assert not [f for f in scanner.scan(" ".join(words[: int(len(words) * 0.7)])) if f[0] == name]
    assert scanner.scan(filler * 50) == [] and scanner.scan(None) == [] and scanner.scan("") == []


def test_sibling_licenses_are_told_apart():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name in licenses.NAMING:
        assert [f[0] for f in scanner.scan(licenses.TEMPLATES[name])] == [name], name
    for text in (
        "Released under the Foo License.",
        "Licensed under CC BY-SA 3.0.",
        "Licensed under the Apache License, Version 1.0.",
        "This work is licensed under the GNU General Public License, version 1.",
    ):
        assert scanner.scan(text) == [], text
    found = scanner.scan("x Licensed under CC BY-SA 4.0. y Released under the BSD License. z. All rights reserved.")
    assert [f[0] for f in found] == ["CC-BY-SA-4.0", "BSD", "All-rights-reserved"]
    both = scanner.scan("Released under the BSD License. Released under the MIT License.")
    assert [f[0] for f in both] == ["BSD", "MIT"]


def test_license_query_rows(awkward, small, nothing):
    rows = {r.doc_id: r for r in licenses.summary(licenses.scan(small)).collect()}
    texts = {r.doc_id: r.text for r in small.collect()}
    short = {n: t for n, t in licenses.TEMPLATES.items() if not n.endswith("full")}
    for doc, text in texts.items():
        planted = [n for n, t in short.items() if t in text]
        assert not planted or rows[doc].license in planted
        assert (rows[doc].license is None) == (rows[doc].n_found == 0)
        assert planted or rows[doc].coverage < 1
    assert licenses.scan(awkward).count() == awkward.count()
    assert licenses.scan(nothing).count() == 0


# personal data


def plain_spans(text):
    text = text or ""
    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    card = []
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c in "0123456789"]
        doubled = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        if 16 <= len(digits) <= 19 and doubled % 10 == 0:
            card.append(m.span())
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return [email, ip, card, phone]


def check_pii(docs):
    rows = pii.summary(pii.find(docs)).collect()
    want = Counter()
    for r in docs.collect():
        spans = plain_spans(r.text)
        base = ",".join(f"{k}:{a}:{b}" for k, found in zip(pii.BASE, spans) for a, b in found)
        want[(r.doc_id, *map(len, spans), hashlib.sha256(base.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == want
    return rows


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    bits = ["a", "b.c", "@", "@", ".", "-", "+", "1", "4", "255", "256", "007", " ", "(", ")", "é", "\n", "4111 1111 1111 1111", "+1", "x@y.zz", "10.0.0.1", "_", "%"]
    for _ in range(20_000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 18)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_pii_rows(awkward, small, nothing):
    check_pii(awkward)
    check_pii(small)
    assert pii.find(nothing).count() == 0


def test_added_spans_need_checksums_and_context(spark):
    texts = [
        "bank account DE89 3704 0044 0532 0130 00 please",
        "bank account DE88 3704 0044 0532 0130 00 please",
        "social security 078-05-1120 of the taxpayer",
        "order 078-05-1120",
        "\U0001f600 mail a.b@c.de now",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in check_pii(docs)}
    assert rows == {0: "iban:13:40", 1: "", 2: "national_id:16:27", 3: "", 4: "email:7:15"}
    assert pii.redact(texts[4]) == "\U0001f600 mail [email] now"


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "a." * 150_000 + "@", "1" * 300_000, "1." * 150_000, "+1" * 150_000, "1 " * 150_000, "0" * 6000 + ".1.1.1"):
        pii.base_spans(text)


# document scores


def test_gradient_step_lowers_the_loss():
    rng = np.random.default_rng(3)
    words = rng.integers(1, 40, 3000)
    words[1::2] = words[::2] + 1
    places = np.arange(len(words))
    network = pseudo_lm.Network.fresh()
    window = pseudo_lm.windows(words, places)
    before = network.log_probabilities(window, words).mean()
    for _ in range(60):
        network.step(window, words, pseudo_lm.RATE)
    assert network.log_probabilities(window, words).mean() > before + 0.5


def test_gradient_equals_differences():
    rng = np.random.default_rng(5)
    words = rng.integers(1, 30, 40)
    window = pseudo_lm.windows(words, np.arange(40))
    start = pseudo_lm.Network.fresh().flat().astype(np.float64) + rng.normal(0, 0.1, pseudo_lm.Network.fresh().flat().size)

    def loss(flat):
        network = pseudo_lm.Network.from_flat(flat)
        for name in ("vectors", "inner", "inner_bias", "outer", "outer_bias"):
            setattr(network, name, getattr(network, name).astype(np.float64))
        return -network.log_probabilities(window, words).mean()

    moved = pseudo_lm.Network.from_flat(start)
    moved.step(window, words, 1.0)
    slope = (start - moved.flat()) / 8
    for i in rng.integers(0, len(start), 60):
        shift = np.zeros(len(start))
        shift[i] = 1e-2
        assert abs((loss(start + shift) - loss(start - shift)) / 2e-2 - slope[i]) < 2e-3


def test_windows_see_both_sides():
    window = pseudo_lm.windows(np.array([5, 6, 7]), np.arange(3))
    assert window.tolist() == [[0, 0, 6, 7], [0, 5, 7, 0], [5, 6, 0, 0]]


def test_document_scores(spark, awkward, small, nothing):
    rows = pseudo_lm.score_documents(small, stride=2).collect()
    texts = {r.doc_id: r.text for r in small.collect()}
    assert {r.doc_id: r.n_words for r in rows} == {d: len(t.split()) for d, t in texts.items()}
    assert all(r.log_likelihood < 0 for r in rows if r.n_words)
    words = [w for t in texts.values() for w in t.lower().split()]
    coder = pseudo_lm.Coder(pseudo_lm.frequent_words(small))
    counts = np.bincount([coder[w] for w in words], minlength=pseudo_lm.SIZE)
    one_sided = sum(n * math.log(n / len(words)) for n in counts if n)
    assert sum(r.log_likelihood for r in rows) > one_sided  # the context helps
    for r in pseudo_lm.score_documents(awkward).collect():
        assert (r.per_word is None) == (r.n_words == 0) and math.isfinite(r.log_likelihood)
    assert pseudo_lm.score_documents(nothing).count() == 0


def test_scores_equal_a_plain_sum(small):
    frequent = pseudo_lm.frequent_words(small)
    counts = Counter(w for r in small.collect() for w in r.text.lower().split())
    assert frequent == [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: pseudo_lm.FREQUENT]]
    coded = pseudo_lm.coded(small, frequent)
    weights = pseudo_lm.Network.fresh(4).flat()
    network = pseudo_lm.Network.from_flat(weights)
    words = {r.doc_id: np.frombuffer(bytes(r.words), np.uint8).astype(np.int64) for r in coded.collect()}
    for r in pseudo_lm.score(coded, weights).collect():
        own = words[r.doc_id]
        want = network.log_probabilities(pseudo_lm.windows(own, np.arange(len(own))), own).sum(dtype=np.float64) if len(own) else 0.0
        assert r.n_words == len(own) and math.isclose(r.log_likelihood, want, rel_tol=1e-4, abs_tol=1e-6)


@pytest.mark.parametrize("stride", [1, 12])
def test_training_improves_the_scores(small, stride):
    coded = pseudo_lm.coded(small, pseudo_lm.frequent_words(small)).cache()
    start = pseudo_lm.Network.fresh().flat()
    trained = pseudo_lm.train_round(coded, start, stride)
    total = [pseudo_lm.score(coded, w).agg(F.sum("log_likelihood")).first()[0] for w in (start, trained)]
    coded.unpersist()
    assert total[1] > total[0]


def test_every_word_has_its_own_probability(spark):
    """Words of one class are told apart by their counts, and each word is a training target."""
    frequent = " ".join(f"f{i:03d}" for i in range(pseudo_lm.FREQUENT))
    rows = [(i, frequent + " aaxyz" * (3 if i == 2 else 0)) for i in range(5)]
    rows += [(10, "f000 aaxyz f001"), (11, "f000 bbxyz f001"), (12, None), (None, "f000 bbxyz f001")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = {r.doc_id: r for r in pseudo_lm.score_words(docs).collect()}
    assert len(found) == len(rows) and found[12].n_words == 0 and found[12].log_likelihood == 0
    assert math.isclose(found[10].log_likelihood - found[11].log_likelihood, math.log(4 / 2), abs_tol=1e-4)
    assert math.isclose(found[None].log_likelihood, found[11].log_likelihood, abs_tol=1e-4)


def test_every_word_is_a_training_target(small):
    coded = pseudo_lm.coded(small.limit(20), pseudo_lm.frequent_words(small))
    start = pseudo_lm.Network.fresh().flat()
    assert np.array_equal(pseudo_lm.train_round(coded.coalesce(1), start), pseudo_lm.train_round(coded.coalesce(1), start, 1))


def test_known_counts_need_no_join(spark):
    """Counts that go to the tasks and counts that are joined add the same, and known words do not travel."""
    frequent = " ".join(f"f{i:03d}" for i in range(pseudo_lm.FREQUENT))
    rows = [(i, f"{frequent} aaxyz bbxyz ccxyz" + " aaxyz" * i) for i in range(4)] + [(9, "once aaxyz ccxyz"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    words = [f"f{i:03d}" for i in range(pseudo_lm.FREQUENT)]
    coded = {r.doc_id: r for r in pseudo_lm.coded_with_rare(docs, words, {"f000": 5, "aaxyz": 11, "ccxyz": 5}).collect()}
    plain = {r.doc_id: bytes(r.words) for r in pseudo_lm.coded(docs, words).collect()}
    assert {k: bytes(r.words) for k, r in coded.items()} == plain
    assert coded[9].rare == ["once"] and math.isclose(coded[9].own, math.log(11) + math.log(5))
    assert coded[0].rare == ["bbxyz"] and coded[None].rare == [] and coded[None].own == 0
    found = [{r.doc_id: r for r in pseudo_lm.score_words(docs, known=k).collect()} for k in (0, pseudo_lm.FREQUENT + 1, pseudo_lm.KNOWN)]
    for doc_id, want in found[0].items():
        for other in found[1:]:
            assert other[doc_id].n_words == want.n_words
            assert math.isclose(other[doc_id].log_likelihood, want.log_likelihood, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("scale", [0.1, 30.0])  # the second one's odds are beyond single precision
def test_step_equals_plain_formulas(scale):
    rng = np.random.default_rng(8)
    start = pseudo_lm.Network.fresh()
    start.outer[:] = rng.normal(0, scale, start.outer.shape)
    words = rng.integers(1, pseudo_lm.SIZE, 100).astype(np.uint8)
    window = pseudo_lm.windows(words, np.arange(100))
    vectors, inner, inner_bias, outer, outer_bias = (p.astype(np.float64) for p in start.parts())
    seen = vectors[window].reshape(100, -1)
    hidden = np.tanh(seen @ inner + inner_bias)
    logits = hidden @ outer + outer_bias
    logits -= logits.max(axis=1, keepdims=True)
    odds = np.exp(logits)
    total = odds.sum(axis=1, keepdims=True)
    plain = (logits - np.log(total))[np.arange(100), words]
    assert np.allclose(start.log_probabilities(window, words), plain, rtol=1e-4, atol=1e-3)
    error = odds / total
    error[np.arange(100), words] -= 1
    error /= 100
    back = (error @ outer.T) * (1 - hidden * hidden)
    np.subtract.at(vectors, window.ravel(), 0.8 * (back @ inner.T).reshape(-1, pseudo_lm.WIDTH))
    want = [vectors, inner - 0.8 * seen.T @ back, inner_bias - 0.8 * back.sum(axis=0), outer - 0.8 * hidden.T @ error, outer_bias - 0.8 * error.sum(axis=0)]
    start.step(window, words, 0.1)
    assert all(np.allclose(a, b, rtol=1e-3, atol=1e-4) for a, b in zip(start.parts(), want))


def test_long_texts_and_edges_score_alike(spark):
    """Texts beyond one slice of words, empty texts between, and columns that ride along."""
    ids = bytes(1 + i * 7 % 255 for i in range(pseudo_lm.WORDS_AT_ONCE + 9))
    rows = [(1, ids, "a"), (2, b"", "b"), (3, None, None), (4, ids[:1], "d"), (5, ids[:700], "e")]
    coded = spark.createDataFrame(rows, "doc_id long, words binary, tag string").coalesce(1)
    network = pseudo_lm.Network.fresh(4)
    network.outer[:] = np.random.default_rng(2).normal(0, 0.2, network.outer.shape)
    found = {r.doc_id: r for r in pseudo_lm.score(coded, network.flat()).collect()}
    for doc_id, data, tag in rows:
        own = np.frombuffer(data or b"", np.uint8)
        want = network.log_probabilities(pseudo_lm.windows(own, np.arange(len(own))), own).sum(dtype=np.float64)
        assert found[doc_id].tag == tag and found[doc_id].n_words == len(own)
        assert math.isclose(found[doc_id].log_likelihood, want, rel_tol=1e-5, abs_tol=1e-6)


def test_account_numbers_end_before_capitals():
    for number, rest in (("GB29 NWBK 6016 1331 9268 19", " VAT 5"), ("DE89370400440532013000", " BIC COBADEFF")):
        text = f"iban {number}{rest}"
        assert pii.added_spans(text)[0] == [(5, 5 + len(number))]
        assert len(pii.added_spans(f"{text} {text}")[0]) == 2
