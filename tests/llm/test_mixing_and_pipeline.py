"""Mixing against its plain rule, and the pipeline against a brute-force version."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
from medley.llm import langid, mixing, packing
from medley.llm.tokens import END_ID
from test_dedup import plain_components, plain_exact, plain_fingerprint
from test_tokens import check_packing

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Deal out by weight; what is above a source's limit goes to the others, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, full = share * sum(sizes.values()), {}
    while True:
        left = [s for s in order if s not in full]
        if not left:
            return full
        rest, total = budget - sum(full.values()), sum(weight[s] for s in left)
        goal = {s: rest * weight[s] / total for s in left}
        above = [s for s in left if goal[s] > most * sizes[s]]
        if not above:
            return full | goal
        full |= {s: most * sizes[s] for s in above}


def plain_mix(rows, most=2):
    """(doc_id, size, source, copies): whole copies, then one more in hash order while it comes nearer."""
    measured = []
    for r in rows:
        h = int(hashlib.md5(str(r.doc_id).encode() if r.doc_id is not None else b"").hexdigest()[:15], 16)
        measured.append((r.doc_id, r.source, len(WORD.findall(r.text or "")), h))
    sizes = Counter()
    for _, source, size, _ in measured:
        sizes[source] += size
    goal = plain_targets(dict(sizes))
    out = []
    for source in sizes:
        own = [m for m in measured if m[1] == source]
        whole = int(goal[source] // sizes[source]) if sizes[source] else 0
        budget = goal[source] - whole * sizes[source]
        by_hash = defaultdict(int)
        for _, _, size, h in own:
            by_hash[h] += size
        before, chosen = 0, set()
        for h in sorted(by_hash):
            if 2 * before + by_hash[h] <= 2 * budget:
                chosen.add(h)
            before += by_hash[h]
        out += [(d, size, source, sizes[source], round(goal[source], 6), min(most, whole + (h in chosen))) for d, _, size, h in own]
    return Counter(out)


def test_mixing(awkward, small, nothing):
    for docs in (awkward, small):
        rows = mixing.mix(docs).collect()
        got = Counter((r.doc_id, r["size"], r.source, r.source_size, round(r.target, 6), r.copies) for r in rows)
        assert got == plain_mix(docs.collect())
        taken, goals, largest = Counter(), {}, Counter()
        for r in rows:
            taken[r.source] += r["size"] * r.copies
            goals[r.source] = r.target
            largest[r.source] = max(largest[r.source], r["size"])
        assert all(abs(taken[s] - goals[s]) <= 2 * largest[s] for s in goals)
    assert mixing.mix(nothing).count() == 0


def test_mixing_refines_only_what_it_must(spark):
    """Hashes that share their first bits are told apart by the later passes."""
    rows = [(f"s{i % 2}", 1 + i % 3, (i % 5) * 7 + (3 << 40)) for i in range(400)]
    frame = spark.createDataFrame(rows, "source string, size long, h long")
    sizes = Counter()
    for s, size, _ in rows:
        sizes[s] += size
    goals = spark.createDataFrame([(s, n, 0.4 * n) for s, n in sizes.items()], "source string, source_size long, target double")
    for r in mixing.thresholds(frame, goals).collect():
        taken = sum(size for s, size, h in rows if s == r.source and h < r.below)
        unit = max(Counter({h: sum(z for s, z, g in rows if s == r.source and g == h) for _, _, h in rows}).values())
        assert abs(taken - r.target) <= unit / 2


def test_take_mix_repeats_rows(awkward):
    want = Counter()
    for (doc, *_, copies), n in plain_mix(awkward.collect()).items():
        want[doc] += copies * n
    kept = mixing.take_mix(awkward)
    assert kept.columns == awkward.columns
    assert Counter(r.doc_id for r in kept.collect()) == +want


def plain_pipeline(spark, docs):
    """Rows that reach the last stage, as (row, copies)."""
    field = langid.train(docs)
    rows = docs.collect()
    names, scores = langid.Tagger(field).languages([r.text for r in rows])
    rows = [r for r, name, score in zip(rows, names, scores) if name != "und" and score >= langid.SURE]
    winners = {(r[0], r[4]) for r in plain_exact(rows) if r[3]}
    digest = lambda r: hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", r.text or "").encode()).hexdigest()
    exact = []
    for r in rows:
        if (r.doc_id, digest(r)) in winners:
            winners.discard((r.doc_id, digest(r)))
            exact.append(r)
    component = plain_components([r.doc_id for r in exact], [plain_fingerprint(r.text) for r in exact])
    near = [r for r, c in zip(exact, component) if r.doc_id is None or r.doc_id == c]
    copies = defaultdict(int)
    for (doc, *_, n), times in plain_mix(near).items():
        copies[doc] += n * times
    return [r for r in near for _ in range(copies[r.doc_id])]


def test_pipeline(spark, tmp_path):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    want = plain_pipeline(spark, documents)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(p.doc_id for p in pieces if p.start == 0) == Counter(r.doc_id for r in want)
    assert len(want) > 20
    check_packing(spark.createDataFrame(want, documents.schema), pieces)
    assert END_ID == 1 and packing.LENGTH == 2048


def test_stages_keep_the_columns(spark, awkward, nothing):
    for docs in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            if docs is nothing:
                assert out.count() == 0
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= 0


def test_language_stage_drops_what_it_rejects(spark, awkward):
    kept = corpus_pipeline.language_id(spark, awkward, "").collect()
    assert all(any(c.isalpha() for c in r.text) for r in kept)
    assert {r.lang_pred for r in kept} <= {"x"} and {r.score for r in kept} <= {"y"}
