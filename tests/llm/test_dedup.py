"""SimHash classes, exact dedup and connected components against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from medley.llm import digest_index, simhash
from medley.llm.components import connected

WHITE = re.compile("[\x20\x09-\x0d]")


def plain_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, threshold=2):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold:
                parent[find(i)] = find(j)
    named = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            named[find(i)] = min(named.get(find(i), doc), doc)
    return [named.get(find(i)) for i in range(len(ids))]


def check_near(docs, **how):
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    expected = sorted(
        zip([r.doc_id for r in rows], prints, plain_components([r.doc_id for r in rows], prints)), key=repr
    )
    found = simhash.near_duplicates(docs, **how).collect()
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in found), key=repr) == expected


def test_near_duplicates_awkward(awkward):
    check_near(awkward)


def test_near_duplicates_of_the_test_table(small):
    check_near(small)
    check_near(small, crowd=1)


def test_near_duplicates_of_nothing(nothing):
    assert simhash.near_duplicates(nothing).count() == 0


def test_each_code_is_perfect():
    for bits, generator, radius in simhash.CODES:
        _, (nearest, beyond) = simhash._code(bits, generator, radius)
        assert nearest.shape[1] == 1 and (nearest >= 0).all()  # one code word within the covering radius
        assert beyond.shape[0] == len(nearest)
    assert sum(bits for bits, _, _ in simhash.CODES) == 64


def test_pairs_within_two_bits_share_an_anchor():
    rng = random.Random(3)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), rng.randint(0, 2)):
            y ^= 1 << bit
        rows, found = simhash.anchors(np.array([x, y], np.uint64))
        assert set(found[rows == 0]) & set(found[rows == 1])


@pytest.mark.parametrize("crowd", [1, 4, 10_000])
def test_links_keep_every_class(spark, crowd):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for start in list(prints)[:10]:  # chains and dense balls
        at = start
        for _ in range(30):
            at ^= 1 << rng.randrange(64)
            prints.add(at)
            prints.add(start ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    links = simhash.linked_prints(spark.createDataFrame([(p,) for p in signed], "fp long"), 2, crowd).collect()
    assert all(((a.src ^ a.dst) % 2**64).bit_count() <= 2 or crowd > 1 for a in links)
    parent = {p: p for p in signed}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for link in links:
        parent[find(link.src)] = find(link.dst)
    got = {}
    for p in signed:
        got.setdefault(find(p), set()).add(p)
    ids = list(range(len(signed)))
    comp = plain_components(ids, [p % 2**64 for p in signed])
    want = {}
    for p, c in zip(signed, comp):
        want.setdefault(c, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_dedup_keeps_one_of_each_group(awkward):
    kept = simhash.keep_first_of_groups(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    found = simhash.near_duplicates(awkward).collect()
    assert ids.count(None) == 1
    assert sorted(i for i in ids if i is not None) == sorted({r.component_id for r in found} - {None})


def test_near_dedup_with_ids_that_groups_share(spark):
    """An id carried by several rows names one row of each of its groups, no more and no fewer."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(20):
        text = rng.choices(words, k=rng.randrange(60, 200))
        rows.append((1000 + len(rows), " ".join(text)))
        rows += [(1000 + len(rows), " ".join(text).upper()) for _ in range(rng.choice([0, 1, 6]))]
    rows += [(5, None), (6, ""), (7, "a b c"), (8, "A  b C"), (None, "without an id")]
    rows += [(9, rows[0][1]), (9, "another text that has the same id but no copy of it at all")]
    rows += [(9, rows[0][1].upper()), (2, "z y x"), (2, "z y x"), (2, "Z y x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    component = plain_components([i for i, _ in rows], [plain_fingerprint(t) for _, t in rows])
    assert component[-4] == 9 and component[-5] == 9 and rows[0][0] == 1000
    for kept in (simhash.keep_first_of_groups(frame), corpus_pipeline.near_dedup(spark, frame, "")):
        found = Counter(map(tuple, kept.collect()))
        assert found[(9, rows[-5][1])] == 1 and found[(9, min(rows[0][1], rows[0][1].upper()))] == 1
        assert found[(2, "Z y x")] == 1 and found[(None, "without an id")] == 1 and found[(5, None)] == 1
        groups = {c for c in component if c not in (None, 9)}
        assert sum(found.values()) == len(groups) + 3 and set(found.values()) == {1}
        assert {i for i, _ in found} == groups | {9, None}


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    found = {r.node: r.root for r in connected(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert found == {i: 1 for i in range(2, 41)} | {i: 100 for i in range(101, 140)}
    assert connected(spark.createDataFrame([], "src long, dst long")).count() == 0


def plain_exact(rows):
    groups = {}
    for n, r in enumerate(rows):
        groups.setdefault(WHITE.sub("", r.text or ""), []).append((-len(r.text or ""), r.doc_id is None, r.doc_id, n))
    out = []
    for text, group in groups.items():
        best = min(group, key=lambda g: (g[0], g[1], g[2] or 0))
        digest = hashlib.sha256(text.encode()).hexdigest()
        once = True
        for g in sorted(group, key=lambda g: (g[0], g[1], g[2] or 0)):
            out.append((g[2], best[2], len(group), once, digest))
            once = False
    return sorted(out, key=repr)


def exact_rows(frame):
    return sorted(
        ((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in frame.collect()), key=repr
    )


def test_exact_dedup(spark, awkward, small, nothing):
    for docs in (awkward, small):
        assert exact_rows(digest_index.fresh_index(spark).ingest(docs)) == plain_exact(docs.collect())
    assert digest_index.fresh_index(spark).ingest(nothing).count() == 0


def test_the_index_remembers(spark, small):
    index = digest_index.fresh_index(spark)
    first = index.ingest(small.filter("doc_id < 120")).collect()
    second = index.ingest(small).collect()
    known = {bytes(r.digest): r.keep_id for r in first}
    for r in second:
        if bytes(r.digest) in known:
            assert not r.kept and r.keep_id == known[bytes(r.digest)]
    assert index.rows().count() == len({bytes(r.digest) for r in second})
    again = digest_index.DigestIndex(spark, index.name)
    assert not [r for r in again.ingest(small).collect() if r.kept]
    index.drop()


def test_the_index_is_not_shuffled(spark, small):
    index = digest_index.fresh_index(spark)
    index.ingest(small)
    plan = index.rows().hint("merge").join(index.rows().select("digest"), "digest", "left_anti")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_exact_dedup_keeps_rows_as_they_came(spark, awkward):
    kept = digest_index.keep_first_copies(awkward, digest_index.fresh_index(spark))
    assert kept.columns == awkward.columns
    want = {(r[0], r[4]) for r in plain_exact(awkward.collect()) if r[3]}
    got = [(r.doc_id, hashlib.sha256(WHITE.sub("", r.text or "").encode()).hexdigest()) for r in kept.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
