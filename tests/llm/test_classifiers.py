"""Held-out accuracy of the trained models, and odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import language, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n"), (None, "some words here"), (4, "some words here"), (4, "some words here"), (5, "1234 !!! ²"), (6, "wörter " * 30_000)]


def held_out(spark, name, columns):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", *columns)
    return queries.queries()[name](spark, SF).where("held_out").join(labels, "doc_id").toPandas()


def test_quality_on_held_out(spark):
    found = held_out(spark, "op8_quality_classifier", ["quality"])
    assert (found["predicted"] == found["quality"]).mean() >= 0.95 and found["score"].between(0, 1).all()


def test_language_on_held_out(spark):
    langs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = queries.op4_language_id(spark, SF).where("held_out").join(langs, "doc_id").toPandas()
    assert (found["lang_pred"] == found["lang"]).mean() >= 0.97 and found["score"].between(0, 1).all()


def sentences(seed, n):
    """Sentences of invented words, some with a word of three insults, hidden in half of the cases."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("ba", "to", "ri", "sel", "mun", "ka", "pel", "do")) for _ in range(rng.randrange(1, 4)))
    bad = ("zgrubnok", "vlixhart", "qworpsy")
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(5, 40))]
        toxic = rng.random() < 0.3
        if toxic:
            b = rng.choice(bad)
            at = rng.randrange(2, len(b) - 1)
            words.insert(rng.randrange(len(words)), rng.choice([b, b.upper(), b[:at] + "-" + b[at:], " ".join(b), b[:at] + "e" + b[at:]]))
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return rows


def test_toxicity_finds_hidden_words(spark):
    rows = sentences(1, 900)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels, "toxic", F.col("doc_id") < 600)
    found = {r["doc_id"]: r["score"] >= 0.7 for r in toxicity.score(docs, machine).collect()}
    right = [found[i] == bool(t) for i, _, t in rows if i >= 600]
    assert sum(right) / len(right) >= 0.97


def test_toxicity_kernel_is_its_table():
    """The weights of subsequences give what the expansion over landmarks gives."""
    landmarks, words = [b"idiot", b"hello", b"worth"], [b"idiot", b"idliot", b"hold", b"x", b"idioten"]
    kernel, beta = toxicity.Kernel(landmarks), np.array([0.5, -0.2, 0.1])
    direct = kernel(words) @ beta
    assert toxicity.word_scores(*toxicity._flat(words), kernel.table(beta)) == pytest.approx(direct, abs=1e-5)
    square = kernel(landmarks)
    assert (np.diag(square) >= 0.999).all() and square == pytest.approx(square.T, abs=1e-6) and kernel([b"idliot"])[0, 0] > 0.4 > kernel([b"hold"])[0, 0]


def test_hidden_words_are_put_together():
    assert toxicity.bag(pa.array(["An Id-i.ot, said", None, "ÄÖ"])) == [[b"an", b"idiot", b"said"], [], ["äö".encode()]]
    assert b"idiot" in toxicity.bag(pa.array(["i d i o t"]))[0] and b"idiot" in toxicity.bag(pa.array(["an id_io.t"]))[0]


def test_odd_rows(spark, docs_of):
    docs = docs_of(ODD)
    for out in (quality.score(docs, np.zeros(1 << 18, np.float32), 0.5), toxicity.score(docs, toxicity.UNTRAINED), language.predict(docs, language.Model([], np.zeros(0), {}, {}))):
        found = out.collect()
        assert sorted((r["doc_id"] for r in found), key=repr) == sorted((i for i, _ in ODD), key=repr) and all(0 <= r["score"] <= 1 for r in found)


def test_nothing_to_learn(spark, docs_of):
    docs, labels = docs_of(ODD), spark.createDataFrame([(1, None, 1), (None, 1, 0), (4, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    weights, bias = quality.fit(docs, labels, "quality", F.lit(True))
    assert not weights.any() and bias == 0
    assert toxicity.fit(docs, labels, "toxic", F.lit(True)) is toxicity.UNTRAINED
    assert language.fit(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).langs == []


def test_language_without_letters_is_undefined(spark, docs_of):
    docs = docs_of([(1, "der hund und die katze " * 5), (2, "the dog and the cat " * 5), (3, "1 ² _"), (4, None), (5, "katzen"), (6, "dogs")]).withColumn("lang", F.when(F.col("doc_id") == 1, "de").when(F.col("doc_id") == 2, "en"))
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, language.fit(docs, F.lit(True))).collect()}
    assert found == {1: "de", 2: "en", 3: "und", 4: "und", 5: "de", 6: "en"}


def test_quality_scores_are_plain_products():
    texts, s = ["One two two, three!", "", "x x x x"], quality.Settings(bits=10)
    w = np.random.default_rng(0).normal(size=1 << s.bits).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    plain = [1 / (1 + np.exp(-(0.3 + float(value @ w[spots])))) for spots, value in quality._features(batch, s)]
    assert quality.scores(batch.column(0), w, 0.3, s) == pytest.approx(plain, rel=1e-4)


def test_keep_good_keeps_columns(spark, docs_of):
    docs = docs_of(ODD)
    assert quality.keep_good(docs, np.zeros(1 << 18, np.float32), 1.0).count() == len(ODD)
    none = quality.keep_good(docs, np.zeros(1 << 18, np.float32), -1.0)
    assert none.count() == 0 and none.columns == docs.columns
