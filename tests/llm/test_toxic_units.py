"""Toxicity by sentences: marks that end them, insults of several words, and insults that clean documents quote."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity
from tessera.llm import words as W


def cut(text):
    (_, _, raw, at), = W.chunks(toxicity.read_both_ways(pa.array([text.lower()])))
    raw, _, start, stop, first = toxicity.unhidden(raw, at)
    last = toxicity.sentence_ends(raw, start, stop, first)
    out = {}
    for a, z, k in zip(start, stop, last, strict=True):
        out.setdefault(int(k), []).append(raw[a:z].tobytes().decode())
    return [" ".join(x) for x in out.values()]


def test_sentences():
    assert cut("One two. Three?! Four") == ["one two", "three", "four"]
    assert cut("you loser.You see") == ["you loser", "loseryou", "you see"]
    assert cut("an Id-i.ot, said i. d. i. o. t now") == ["an idiot said idiot now"]


def test_unit_scores_are_word_scores():
    table = np.random.default_rng(1).normal(size=1 << toxicity.BITS).astype(np.float32)
    words = [b"you", b"are", b"a", b"bad", b"one", b"go", b"home"]
    flat, at = toxicity._flat(words)
    seen = set()
    for first, behind, value in toxicity.unit_scores(flat, at, np.array([5] * 5 + [7] * 2), table):
        for i, k, v in zip(first, behind, value, strict=True):
            assert v == pytest.approx(toxicity.word_scores(*toxicity._flat([b"\2\1".join(words[i:k])]), table)[0], abs=1e-5)
            seen.add((int(i), int(k)))
    assert {(0, 4), (0, 5), (5, 7), (3, 5), (2, 3)} <= seen and (4, 6) not in seen


def accuracy(spark, rows, train):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels, "toxic", F.col("doc_id") < train)
    found = {r["doc_id"]: r["score"] >= 0.7 for r in toxicity.score(docs, machine).collect()}
    return [np.mean([found[i] == bool(t) for i, _, t in rows if i >= train and t == y]) for y in (0, 1)]


def documents(seed, n, insult, other):
    """``other``: what some of the clean documents hold instead of the insult."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("ba", "to", "ri", "sel", "mun", "ka", "pel", "do")) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        said = [[word() for _ in range(rng.randrange(4, 12))] for _ in range(3)]
        toxic = rng.random() < 0.4
        held = [insult] if toxic else other(rng)
        for x, mine in zip(held, rng.sample(said, len(held)), strict=True):
            mine.insert(rng.randrange(len(mine) + 1), x)
        rows.append((i, " ".join(" ".join(s).capitalize() + "." for s in said), int(toxic)))
    return rows


def test_insult_of_ordinary_words(spark):
    rows = documents(1, 900, "jump lake", lambda rng: ["jump", "lake"])
    assert min(accuracy(spark, rows, 600)) >= 0.9


def test_insult_that_clean_documents_quote(spark):
    rows = documents(2, 900, "zgrubnok", lambda rng: ["zgrubnok"] if rng.random() < 0.02 else [])
    assert min(accuracy(spark, rows, 600)) >= 0.9


def test_mislabelled_clean_documents(spark):
    """Clean documents that hold the insult by mistake of the label don't bar it."""
    rows = documents(4, 900, "zgrubnok", lambda rng: [])
    wrong = [(10_000 + k, text, 0) for k, (_, text, toxic) in enumerate(documents(5, 40, "zgrubnok", lambda rng: [])) if toxic][:3]
    assert min(accuracy(spark, rows, 600)) >= 0.9
    docs = [*wrong, *rows]
    assert min(accuracy(spark, [(k, t, y) for k, (_, t, y) in enumerate(docs)], 600)) >= 0.9


def test_copies_of_a_toxic_document(spark):
    """Words that only copies of one toxic document hold don't become insults."""
    rows = documents(6, 900, "zgrubnok", lambda rng: [])
    copy = next(t for _, t, y in rows if y)
    rows = [(k, t, y) for k, (t, y) in enumerate([(copy, 1)] * 30 + [(t, y) for _, t, y in rows])]
    assert min(accuracy(spark, rows, 630)) >= 0.9


def test_held_out_labels(spark):
    """Rows of ``labels.toxic`` that the machine doesn't learn from. Some toxic ones hold no insult (about 4 % at sf0.1)."""
    from tessera.llm import queries

    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    found = queries.op6_toxicity(spark, folder).where("held_out").join(labels, "doc_id").toPandas()
    toxic = found["toxic"] == 1
    assert found["predicted"][toxic].mean() >= 0.9 and found["predicted"][~toxic].mean() <= 0.02
