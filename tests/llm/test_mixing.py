"""Mixtures and the pipeline against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from paysheaf.llm import mixing, quality
from paysheaf.llm.shared import stored


def shares(sizes, weights, cap=3):
    """Targets by sharing again and again what full companies leave."""
    left, open_ = float(sum(sizes.values())), set(sizes)
    out = {}
    while True:
        level = {c: left * weights[c] / sum(weights[x] for x in open_) for c in open_}
        full = {c for c in open_ if level[c] >= cap * sizes[c]}
        if not full:
            return out | level
        for c in full:
            out[c] = float(cap * sizes[c])
            left -= out[c]
        open_ -= full
        if not open_:
            return out


@pytest.mark.parametrize("seed", [1, 2])
def test_mixture(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(1500):
        company = rng.choice(["a", "a", "a", "a", "b", "c", "d", "é", None] + (["tiny"] if i % 40 == 0 else []))
        rows.append((i, " ".join(["p"] * int(rng.expovariate(1 / 40))), company))
    rows.append((9999, " ".join(["p"] * 900), "b"))
    got = mixing.mixture(spark.createDataFrame(rows, "doc_id bigint, text string, company string").repartition(6)).collect()
    again = mixing.mixture(spark.createDataFrame(rows[::-1], "doc_id bigint, text string, company string").repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["company"]] += r["size"]
        taken[r["company"]] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 3 and (r["copies"] in (int(r["rate"]), -int(-r["rate"] // 1)))
    order = sorted(sizes, key=lambda c: (c is None, c or ""))
    want = shares(sizes, {c: (5, 2, 1)[k % 3] for k, c in enumerate(order)})
    for r in got:
        assert r["target"] == pytest.approx(want[r["company"]]) and r["company_size"] == sizes[r["company"]]
    for c in sizes:
        assert abs(taken[c] - want[c]) <= max(3, 0.01 * want[c]), (c, taken[c], want[c])


def test_rates_are_tilted_exponentially(spark):
    rows = [(i, " ".join(["p"] * (1 + i % 50)), "a" if i % 3 else "b") for i in range(600)]
    got = mixing.mixture(spark.createDataFrame(rows, "doc_id bigint, text string, company string")).collect()
    for company in ("a", "b"):
        own = [r for r in got if r["company"] == company and r["rate"] < 3]
        tilts = np.array([np.log(r["rate"]) / r["size"] for r in own])
        assert np.ptp(tilts) < 1e-9
        total = sum(r["size"] * r["rate"] for r in got if r["company"] == company)
        assert total == pytest.approx(own[0]["target"], rel=1e-6)


def shingles(text):
    """Five-word shingles of the near-duplicate stage; a shorter text is one, a text without words has none."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_pipeline_stages_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    source = {r["doc_id"]: r for r in docs.collect()}
    steps, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, sf_dir), name)
        steps[name] = now.collect()
    judged = {r["doc_id"]: r["kept"] for r in quality.judged(docs.withColumnRenamed("source", "company")).collect()}
    kept = {r["doc_id"]: r for r in steps["quality_rules"]}
    assert {i for i, k in judged.items() if k} == set(kept) and all(kept[i] == source[i] for i in kept)
    sets = {i: shingles(r["text"] or "") for i, r in kept.items()}
    root = {i: i for i in sets}
    alike = {i: [j for j in sets if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])] for i in sets}
    while True:
        new = {i: min(root[j] for j in [i, *alike[i]]) for i in sets}
        if new == root:
            break
        root = new
    first = {r["doc_id"]: r for r in steps["near_duplicates"]}
    assert set(first) == set(root.values()) and len(steps["near_duplicates"]) == len(first)
    clean = {r["doc_id"]: r for r in steps["secret_scan"]}
    assert set(clean) == set(first) and all((clean[i]["text"] == first[i]["text"]) or "[removed]" in clean[i]["text"] for i in clean)
    assert all(r["n_chars"] == len(r["text"]) or r["text"] == first[i]["text"] for i, r in clean.items())
    copies = defaultdict(int)
    for r in steps["source_mixture"]:
        assert r == clean[r["doc_id"]]
        copies[r["doc_id"]] += 1
    assert max(copies.values()) <= 3
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(steps["encoding"]) == len(steps["source_mixture"])
    for r in steps["encoding"]:
        want = library.encode(clean[r["doc_id"]]["text"], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want)
