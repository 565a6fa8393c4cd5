"""Spelling variants of words in payslip texts against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paysheaf.llm import queries, records, spelling

LABELS = ["salário", "vencimento", "gratificação", "adicional", "noturno", "desconto", "contribuição", "previdência", "transporte", "alimentação"]


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(n):
    out = {}
    close = {w: [v for v in n if near(w, v)] for w in n}
    for w in n:
        best = min(close[w], key=lambda v: (-n[v], v), default=None)
        out[w] = best if best is not None and n[best] >= 10 * n[w] else None
    rows = set()
    for w in n:
        root = w
        while out[root]:
            root = out[root]
        rows.add((w, n[w], out[w], root, len(close[w]), n[out[w]] if out[w] else None))
    return rows


def misprint(rng, word):
    i = rng.randrange(len(word))
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice("aeéçx") + word[i:], word[:i] + rng.choice("aoãz") + word[i + 1 :], word[:i] + word[i] + word[i:]])


def result(frame):
    return {(r["word"], r["n"], r["form"], r["root"], r["n_near"], r["form_n"]) for r in frame.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_against_brute_force(spark, monkeypatch, seed):
    """Many small indexes; the words of one beginning fill several of them."""
    for name, value in (("SEGMENT_WORDS", 40), ("BATCH_WORDS", 16), ("TASK_WORDS", 30)):
        monkeypatch.setattr(spelling, name, value)
    rng = random.Random(seed)
    n = Counter()
    for _ in range(60):
        base = rng.choice(LABELS) + rng.choice(["", "", "s", "mensal"])
        n[base] += rng.randrange(500, 5000)
        once = misprint(rng, base)
        n[once] += rng.randrange(1, 60)
        n[misprint(rng, once)] += rng.randrange(1, 6)
    for i in range(150):
        n["gratificação" + rng.choice("abc") + rng.choice("abcdé") + rng.choice("ab")] += 1
    for w in ("a", "b", "ab", "aa", "aaa", "aaaa", "ÿÿ", "ÿ"):
        n[w] += rng.randrange(1, 30)
    rows = [(w, c) for w, c in n.items()] + [(None, 4), ("", 9), ("vazio", None)]
    words = spark.createDataFrame(rows, "word string, n bigint").withColumns({"key": F.lit(1), "segment": F.lit("s"), "root": F.lit(0)}).repartition(3)
    assert result(spelling.variants(words)) == grouped(n)
    pairs = [(r["word"], r["near"]) for r in spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n bigint")).collect()]
    assert sorted(pairs) == sorted((a, b) for a in n for b in n if near(a, b))


def test_words_of_pages(spark):
    pages = [("a", 1, "SALÁRIO Salário-Base 220,00 contribuição"), ("a", 2, "Contribuição contribuição ÀÉsalario"), ("b", 1, None), ("c", 1, "")] * 2
    docs = records.document_text(spark.createDataFrame(pages, "doc_id string, page int, text string"))
    got = {r["word"]: r["n"] for r in spelling.word_counts(spelling.runs(docs, 7)).collect()}
    # only A-Z is put in lower case
    assert got == {"salÁrio": 2, "salário": 2, "contribuição": 6, "ÀÉsalario": 2}


def test_repeated_and_no_words(spark):
    words = spark.createDataFrame([("desconto", 30), ("desconto", 30), ("desconte", 3)], "word string, n bigint")
    assert result(spelling.variants(words)) == {("desconto", 60, None, "desconto", 1, None), ("desconte", 3, "desconto", "desconto", 1, 60)}
    assert spelling.variants(words.limit(0)).collect() == []
    assert result(spelling.variants(words.limit(1))) == {("desconto", 30, None, "desconto", 0, None)}


def test_intervals_of_halves():
    words = sorted({"banana", "bananas", "band", "bandana", "cabana", "ananas"})
    index = spelling.WordIndex.unpack(spelling.WordIndex.pack(words))
    q, w = index.one_error(["banana", "bandana"], np.array([3, 3]))
    assert [(int(i), words[j]) for i, j in zip(q, w)] == [(0, "bananas"), (0, "bandana"), (1, "banana")]


def test_query_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    n = Counter()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{r['doc_id']}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    got = queries.op13_spelling(spark, sf_dir).collect()
    assert {(r["word"], r["n"]) for r in got} == set(n.items()) and len(got) == len(n)
    near_of = Counter()
    shapes = {}
    for w in n:
        for i in range(len(w)):
            shapes.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    close = {w: {v for i in range(len(w)) for v in shapes[w[:i] + w[i + 1 :]]} | shapes.get(w, set()) | {w[:i] + w[i + 1 :] for i in range(len(w))} for w in n}
    for w in n:
        near_of[w] = sum(1 for v in close[w] if v in n and v != w and near(w, v))
    assert {r["word"]: r["n_near"] for r in got} == {w: near_of[w] for w in n}
