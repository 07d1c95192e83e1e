"""Language identification against a plain version, and languages that few documents have."""

import math
import unicodedata
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import language, queries

SF = "/root/testdata/sf0.001"


def words_of(text):
    out, word = [], ""
    for c in [*(text or "").lower(), " "]:
        if unicodedata.category(c).startswith("L"):
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def grams(word, n):
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def plain_model(rows):
    langs = sorted({x for _, x in rows})
    counts = {n: {x: Counter() for x in langs} for n in (0, *language.ORDERS)}
    for text, lang in rows:
        if len(text.encode()) > language.TRAINING_BYTES:
            continue
        for w in words_of(text):
            counts[0][lang][w] += 1
            for n in language.ORDERS:
                counts[n][lang].update(grams(w, n))
    prior = Counter(x for _, x in rows)
    entries = {n: set().union(*c.values()) for n, c in counts.items()}

    def logs(n, e):
        return [math.log((c[e] + 0.1) / (sum(c.values()) + 0.1 * (len(entries[n]) + 1))) for c in (counts[n][x] for x in langs)]

    def word_logs(w):
        if w in entries[0]:
            return logs(0, w)
        for n in language.ORDERS:
            if found := [logs(n, g) for g in grams(w, n) if g in entries[n]]:
                return [sum(x) / len(found) for x in zip(*found, strict=True)]
        return [0.0] * len(langs)

    def predict(text):
        words = words_of(text)
        if not words:
            return "und", 0.0
        sums = [sum(x) for x in zip(*map(word_logs, words), strict=True)]
        value = [s / len(words) * min(len(words), 20) + math.log(prior[x] / len(rows)) for s, x in zip(sums, langs, strict=True)]
        best = value.index(max(value))
        return langs[best], 1 / math.fsum(math.exp(v - value[best]) for v in value)

    return predict


def test_query_matches_plain_version(spark):
    docs = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'").fetchall()
    predict = plain_model([(t, x) for i, t, x in docs if t is not None and x is not None and zlib.crc32(str(i).encode()) % 5])
    found = {r["doc_id"]: r for r in queries.op4_language_id(spark, SF).collect()}
    assert len(found) == len(docs)
    for i, text, _ in docs[::5]:
        name, score = predict(text if text is None or len(text) < 20_000 else text)
        assert (found[i]["lang_pred"], found[i]["held_out"]) == (name, zlib.crc32(str(i).encode()) % 5 == 0)
        assert found[i]["score"] == pytest.approx(score, abs=1e-4)


def test_rare_language_is_learned(spark, docs_of):
    rows = [(i, f"the dog and the cat number {'abcdefgh'[i % 8]}") for i in range(6_000)] + [(9_000 + i, "hunden och katten") for i in range(3)]
    docs = docs_of(rows).withColumn("lang", F.when(F.col("doc_id") < 9_000, "en").otherwise("sv"))
    model = language.fit(docs, F.lit(True), each=50)
    assert model.langs == ["en", "sv"]
    asked = docs_of([(1, "katten hunden"), (2, "cats"), (3, "hundens kattens hundens kattens"), (4, "Ünï 東京"), (5, "катя"), (6, "katten " * 100_000), (7, None), (7, None), (None, "the dog")])
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(asked, model).collect()}
    assert [found[k][0] for k in (1, 2, 3, 6, 7, None)] == ["sv", "en", "sv", "sv", "und", "en"] and found[7][1] == 0


def test_thresholds_bound_the_sample():
    assert language._thresholds([("a", 5, 3), ("a", 9, 4), ("a", 1, 90), ("b", 2, 500), ("b", 1, 1)], 10) == {"a": 5, "b": 2}


def test_language_of_long_texts_only_is_learned(spark, docs_of):
    long = "tak jest dobrze mamy czas " * 800
    docs = docs_of([(1, "the dog and the cat " * 5), (2, long), (3, long + " jeszcze"), (4, "mamy czas"), (5, "the cat")]).withColumn("lang", F.when(F.col("doc_id") == 1, "en").when(F.col("doc_id") < 4, "pl"))
    assert len(long) > language.TRAINING_BYTES
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, language.fit(docs, F.lit(True))).collect()}
    assert found == {1: "en", 2: "pl", 3: "pl", 4: "pl", 5: "en"}


def test_ties_go_to_the_first_language(spark, docs_of):
    docs = docs_of([(1, "same words here"), (2, "same words here"), (3, "same words")]).withColumn("lang", F.when(F.col("doc_id") == 1, "xx").when(F.col("doc_id") == 2, "aa"))
    assert {r["lang_pred"] for r in language.predict(docs, language.fit(docs, F.lit(True))).collect()} == {"aa"}
