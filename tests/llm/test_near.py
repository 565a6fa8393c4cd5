"""Near duplicates, shared passages and fingerprints against brute force."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from paysheaf.llm import imatch, near, passages, simhash


def words(rng, n, of=4000):
    return [f"w{rng.randrange(of)}" for _ in range(n)]


def frame(spark, texts, parts=5):
    return spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(parts)


def grouped(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_covering_masks_hide_every_pair_of_bits():
    masks = simhash.covering_masks()
    assert all(any(not (m >> i & 1 or m >> j & 1) for m in masks) for i in range(64) for j in range(64))


@pytest.mark.parametrize("text", ["", "um", "um dois", "um dois três", "A b  A b\tA b \n c", "x " * 500])
def test_fingerprint_definition(text):
    found = text.encode().lower().split()
    shingles = [b" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))] if found else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == want


def test_components_equal_all_pairs(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {}
    for i in range(600):
        value = base[rng.randrange(40)] if i % 3 else rng.getrandbits(64)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            value ^= 1 << rng.randrange(64)
        prints[i] = value
    signed = {i: v - (1 << 64) if v >> 63 else v for i, v in prints.items()}
    df = spark.createDataFrame(list(signed.items()), "doc_id bigint, fingerprint bigint")
    linked = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = grouped(prints, linked)
    pairs = [(r["a"], r["b"]) for r in simhash.links(df).collect()]
    same = grouped(signed.values(), pairs)
    assert all((want[a] == want[b]) == (same[signed[a]] == same[signed[b]]) for a, b in combinations(prints, 2))


def test_near_duplicates_of_texts(spark):
    rng = random.Random(5)
    texts = {i: " ".join(words(rng, 200)) for i in range(1, 40)}
    texts |= {100 + i: texts[i] for i in range(1, 20)} | {200: None, 201: "", 202: " \n"}
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    prints = {i: simhash.fingerprint(t or "") for i, t in texts.items()}
    assert got == grouped(prints, [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert got[105] == 5 and got[201] == got[202] == got[200]
    kept = {r["doc_id"] for r in simhash.first_of_groups(frame(spark, texts)).collect()}
    assert kept == set(got.values())


@pytest.mark.parametrize("high", [5, 1000, 2**31])
def test_compact_windows_definition(high):
    rng = np.random.default_rng(high)
    for n in (0, 3, 60, 400):
        h = rng.integers(1, high, n).astype(np.uint32)
        h[rng.random(n) < 0.01] = 0
        for least in (4, 7, 46):
            want = set()
            for c in np.flatnonzero(h).tolist():
                left = right = c
                while left > 0 and h[left - 1] > h[c]:
                    left -= 1
                while right + 1 < n and h[right + 1] >= h[c]:
                    right += 1
                if right - left + 1 >= least:
                    want.add((left, c, right))
            assert set(zip(*[x.tolist() for x in passages.compact_windows(h, least)])) == want


def test_passages_against_brute_force(spark):
    rng = random.Random(11)
    shared, hot, short = words(rng, 60), words(rng, 55), words(rng, 40)
    texts = {}
    for i in range(120):
        body = words(rng, rng.randrange(30, 200))
        at = rng.randrange(len(body))
        extra = hot if i % 2 else shared if i % 10 == 0 else short if i % 7 == 0 else []
        if i % 10 == 4:  # a near copy: one word in sixty differs
            extra = shared[:30] + ["outro"] + shared[31:]
        texts[i] = " ".join(body[:at] + extra + body[at:])
    texts[200] = texts[3].upper()
    split = {i: t.lower().split() for i, t in texts.items()}
    runs = {}
    for i, w in split.items():
        for k in range(len(w) - 49):
            runs.setdefault(tuple(w[k : k + 50]), set()).add(i)
    exact = set().union(*(d for d in runs.values() if len(d) > 1))
    rows = passages.shared_passages(frame(spark, texts)).collect()
    found = {r["doc_id"] for r in rows}
    near = {i for i in range(120) if i % 10 == 4 and i % 2 == 0}
    assert exact <= found <= exact | near and len(near & found) >= 0.9 * len(near)
    for r in rows:
        a = split[r["doc_id"]][r["first_word"] : r["last_word"] + 1]
        b = split[r["match_doc_id"]][r["match_first_word"] : r["match_last_word"] + 1]
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
        assert len(x & y) / len(x | y) == pytest.approx(r["similarity"]) and r["similarity"] >= 0.8
        assert r["class_id"] <= r["doc_id"]
    # one link for each document of the frequent passage, not one for every two
    assert len(rows) < 4 * len(found)


def test_passages_that_the_first_document_has_in_parts_only(spark):
    rng = random.Random(23)
    texts, sharing = {}, []
    for i in range(40):
        passage = words(rng, 60)
        # the first document has every shingle but the four over the cut, in two halves that are too short
        first = words(rng, 30) + passage[:30] + words(rng, 90) + passage[30:] + words(rng, 30)
        others = [words(rng, 40) + passage + words(rng, 40) for _ in range(2 if i % 2 else 30)]
        ids = [i, *range(1000 + 100 * i, 1000 + 100 * i + len(others))]
        texts |= {d: " ".join(t) for d, t in zip(ids, [first, *others])}
        sharing.append(ids[1:])
    rows = passages.shared_passages(frame(spark, texts)).collect()
    for ids in sharing:
        assert {r["doc_id"] for r in rows if r["class_id"] == ids[0]} == set(ids)
    pairs = {}
    for r in rows:
        pairs.setdefault((r["doc_id"], r["match_doc_id"]), []).append((r["first_word"], r["last_word"]))
    assert all(a[1] < b[0] for spans in pairs.values() for a, b in zip(sorted(spans), sorted(spans)[1:]))
    # one link and its back for each document, not one for every two
    assert len(rows) <= 4 * sum(len(ids) for ids in sharing)


def test_similar_passages_of_a_large_key_that_are_nowhere_equal(spark):
    rng = random.Random(31)
    texts, sharing = {}, []
    for i in range(16):
        passage = words(rng, 90)
        # the first document has the shingles in parts that are too short; the others differ in one word near the middle each, so no 50 words are equal
        first = sum((words(rng, 40) + passage[k : k + 30] for k in (0, 30, 60)), words(rng, 20))
        others = [words(rng, 30) + passage[: 42 + j % 5] + words(rng, 1) + passage[43 + j % 5 :] + words(rng, 30) for j in range(24)]
        ids = [i, *range(1000 + 100 * i, 1000 + 100 * i + len(others))]
        texts |= {d: " ".join(t) for d, t in zip(ids, [first, *others])}
        sharing.append(ids[1:])
    rows = passages.shared_passages(frame(spark, texts)).collect()
    for ids in sharing:
        assert {r["doc_id"] for r in rows if r["class_id"] == ids[0]} == set(ids)
    assert all(r["similarity"] >= 0.8 for r in rows)


def test_rarest_shingles_and_reach():
    rng = np.random.default_rng(3)
    for _ in range(40):
        counts = rng.integers(0, 9, 120) * (rng.random(120) < 0.9)
        starts, places = passages.rarest(counts, 20, 4)
        assert starts.tolist() == [a for a in range(101) if (counts[a : a + 20] == 0).sum() <= 4]
        for a, some in zip(starts.tolist(), places.tolist()):
            assert sorted(counts[some].tolist()) == sorted(counts[a : a + 20].tolist())[:5] and all(a <= x < a + 20 for x in some)
        known, at = counts > 0, int(rng.integers(0, 110))
        upto = at + int(rng.integers(0, 10))
        good = [(p, q) for p in range(upto + 1) for q in range(max(p, at), 120) if 9 * known[p : q + 1].sum() >= 8 * (q + 1 - p)]
        want = (min(p for p, _ in good), max(q for _, q in good)) if good else (at, at - 1)
        assert passages.reach(known, at, upto) == want


def test_passage_inside_a_longer_dissimilar_stretch():
    own = np.arange(1000, 1200).astype(np.uint64)
    other = own.copy()
    other[::9] = np.arange(len(other[::9])).astype(np.uint64)
    other[60:110] = own[60:110]
    stretches = passages.shared_stretches(own, other)
    assert any(s <= 60 and e >= 108 for s, e, *_ in stretches)


def test_imatch_follows_the_next_document(spark):
    rng = random.Random(2)
    texts = {i * 3: " ".join(words(rng, rng.randrange(0, 60), 300)) for i in range(50)}
    texts[9] = None
    got = {r["doc_id"]: r for r in imatch.compared(frame(spark, texts), rows_per_run=7).collect()}
    ids = sorted(texts, reverse=True)
    assert sorted(got) == sorted(texts)
    for i, j in zip(ids, ids[1:] + ids[:1]):
        a, b = texts[i] or "", texts[j] or ""
        half = len(a) // 2
        changed = a[: len(a) - half] + b[:half]
        assert got[i]["n_chars"] == len(a) and got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert got[i]["near_next"] == imatch.likeness(got[i]["fingerprint"], got[j]["fingerprint"])
        assert got[i]["near_edited"] == imatch.likeness(got[i]["fingerprint"], got[i]["edited_fingerprint"])


def test_imatch_fingerprints_depend_on_the_set_of_band_terms(spark):
    rng = random.Random(4)
    texts = {i: " ".join(words(rng, 80, 3000)) for i in range(200)}
    parts = texts[0].split()
    texts |= {900: " ".join(reversed(parts)), 901: texts[0].upper(), 902: " ".join(parts[:-1] + ["unico"])}
    got = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(frame(spark, texts)).collect()}
    assert got[0] == got[900] == got[901] and imatch.likeness(got[0], got[902]) > 0.7
    assert np.mean([imatch.likeness(got[i], got[i + 1]) for i in range(100)]) < 0.1


def jaccard(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_near_duplicate_stage_equals_all_pairs(spark):
    rng = random.Random(8)
    texts = {}
    for i in range(0, 240, 8):
        base = words(rng, 200)
        for j in range(8):  # edits of 0 to 7 words: similarities around 0.8 and chains of them
            copy = list(base)
            for at in rng.sample(range(200), j):
                copy[at] = f"x{rng.randrange(10**6)}"
            texts[i + j] = " ".join(copy)
    # many texts with a common half share bands without being similar
    half = words(rng, 150)
    texts |= {1000 + i: " ".join(half + words(rng, 60)) for i in range(40)}
    linked = [(a, b) for a, b in combinations(texts, 2) if jaccard(texts[a], texts[b]) >= 0.8]
    want = grouped(texts, linked)
    assert any((simhash.fingerprint(texts[a]) ^ simhash.fingerprint(texts[b])).bit_count() > 2 for a, b in linked)
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(frame(spark, texts)).collect()}
    assert got == want
    docs = frame(spark, texts).selectExpr("doc_id", "text", "'pt' AS lang", "'a' AS source", "length(text) AS n_chars")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == set(want.values())


def test_texts_with_a_common_part_are_not_all_compared(spark, monkeypatch):
    """Texts that share 200 of 260 words share bands without being similar; the pairs made grow with the texts, not with their square."""
    made = []
    compare = near._Groups.compare

    def counted(self, pairs):
        pairs = pairs.distinct()
        made[-1] += pairs.count()
        compare(self, pairs)

    monkeypatch.setattr(near._Groups, "compare", counted)
    common = " ".join(f"comum{i}" for i in range(200))
    for n in (100, 200):
        made.append(0)
        texts = [(i, common + " " + " ".join(f"proprio{i}x{j}" for j in range(60))) for i in range(n)]
        # and a few pairs that are similar
        texts += [(1000 + i, f"{common[7:]} " + " ".join(f"proprio{i}x{j}" for j in range(60))) for i in range(0, n, 20)]
        got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
        assert all(got[1000 + i] == i for i in range(0, n, 20)) and len(set(got.values())) == n
    assert made[1] < 2.5 * made[0] and made[1] < 200 * 15


def test_near_duplicate_stage_takes_simhash_neighbours_and_compares_them(spark):
    """Fingerprints within two bits make candidates of their own, whatever the bands say; the exact comparison decides."""
    rng = random.Random(12)
    base = words(rng, 400)
    texts = {1: " ".join(base), 2: " ".join([*base, "fim"]), 3: " ".join(words(rng, 300))}
    prints = {i: simhash.fingerprint(t) for i, t in texts.items()}
    assert (prints[1] ^ prints[2]).bit_count() <= 2
    signed = {i: p - (1 << 64) if p >> 63 else p for i, p in prints.items()}
    # 4 has the fingerprint of 3 and nothing else of it
    texts[4], signed[4] = " ".join(words(rng, 300)), signed[3]
    sets = near.shingle_sets(near.bytetext.parse(pa.array(list(texts.values()))))
    node = {i: int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64)) for i, s in zip(texts, sets)}
    # bands that nobody shares: only the fingerprints can bring texts together
    signatures = spark.createDataFrame([(i, node[i], signed[i], [i]) for i in texts], "doc_id bigint, node bigint, fingerprint bigint, bands array<bigint>")
    group = {r["node"]: r["component"] for r in near.links(frame(spark, texts), signatures).collect()}
    assert group[node[1]] == group[node[2]] and node[3] not in group and node[4] not in group


def test_places_part_sets_that_cannot_be_similar(spark):
    rows = [(a, pa_, b, pb) for a in (10, 50) for b in (10, 13, 50) for pa_ in range(1, 11) for pb in range(1, 11)]
    got = spark.createDataFrame(rows, "a int, x int, b int, y int").withColumn("can", near._can_be_similar(F.col("a"), F.col("x"), F.col("b"), F.col("y"))).collect()
    for r in got:
        both = 1 + min(r.a - r.x, r.b - r.y)
        assert r.can == (10 * both >= 8 * (r.a + r.b - both))
