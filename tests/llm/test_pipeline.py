"""The registered queries of this subpackage, and the pipeline against a brute-force version."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from oracle import connection, rows
from pyspark.sql import functions as F
from test_jaccard import brute as brute_groups
from test_substrings import brute as brute_repeats
from test_texts import brute_leaks

import corpus_pipeline
from tessera.llm import bpe, quality, queries

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "licence": "doc_id n_words n_base first_word last_word base_labels",
    "op1": "query_id rank vec_id score", "op2": "doc_id n_words n_removed kept_sha256", "op3": "doc_id n_shingles component_id", "op4": "doc_id held_out lang_pred score", "op5": "doc_id item_id first_word similarity", "op6": "doc_id held_out score predicted",
    "op7": "doc_id n_tokens ids_sha256 decoded_sha256", "op8": "doc_id held_out score predicted", "op9": "page_id payload_bytes payload_digest record_type refers_to", "op10": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op11": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op12": "word form root n n_near form_n",
    "op13": "vendor_id segment_no first_day n_days total spread cost n_segments best_cost",
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_return_their_columns(spark, name):
    out = queries.queries()[name](spark, SF)
    assert out.columns[: len(COLUMNS[name.split("_")[0]].split())] == COLUMNS[name.split("_")[0]].split()
    n = {"op1": None, "op5": None, "op9": "pages", "op12": None, "op13": None}.get(name.split("_")[0], "documents")
    assert n is None or out.count() == spark.read.parquet(f"{SF}/{n}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(connection(SF).execute(queries.oracle_sql()[name]).fetch_df())


def test_substrings_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    wanted = brute_repeats(docs, 20)
    for r in queries.op2_substring_dedup(spark, SF).collect():
        n, gone, kept = wanted[False, r["doc_id"], next(t for i, t in docs if i == r["doc_id"])]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_jaccard_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op3_jaccard_join(spark, SF).collect()), key=repr) == brute_groups(docs, 3, 90)


def test_byte_pairs_query(spark):
    import public_tokenizers

    encoder = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    for r in queries.op7_byte_bpe(spark, SF).collect():
        ids = encoder.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_licences_query(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    found = {r["doc_id"]: r["base_labels"] for r in queries.op10_licence_scan(spark, SF).collect()}
    assert {i for i, x in found.items() if "apache" in x} == {i for i, t in docs.items() if re.search(r"apache\W+license(?![a-z0-9])", t.lower())}


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    weights, bias = quality.fit(docs, labels, "quality", queries.fold(3) != 1)
    good = {r["doc_id"] for r in quality.score(docs, weights, bias).where("score >= 0.5").collect()}
    left = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good]
    one = {i for i, n, c in brute_groups(left, 5, 80) if i == c or n == 0}
    left = [(i, t) for i, t in left if i in one]
    repeats = brute_repeats(left, 20)
    left = [(i, t if not repeats[False, i, t][1] else repeats[False, i, t][2]) for i, t in left]
    leaks = {d for d, _ in brute_leaks(left, bench)}
    wanted = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in left if i not in leaks}
    found = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert found == wanted and 0 < len(found) < docs.count()


def test_stages_keep_columns_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), SF).columns == docs.columns
        assert stage(spark, docs.where(F.lit(False)), SF).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "repeats", "benchmark", "encoding"]


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, a very long text and a column with an inner name."""
    draw = random.Random(6)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    long, plain = prose(40_000), prose(60)
    odd = [(None, prose(50)), (None, None), (900_001, None), (900_002, ""), (900_003, plain), (900_003, plain), (900_004, long), (900_005, "x"), (900_006, plain + " and more")]
    kinds = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in odd], kinds).withColumn("root", F.lit("r"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("root", F.lit("r")).unionByName(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in found]
    digest = {r["doc_id"]: r["decoded_sha256"] for r in found}
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})  # repeated rows are one document
    assert all(digest[i] == hashlib.sha256(b"").hexdigest() for i in (900_001, 900_002) if i in digest)
    judged = {r["doc_id"] for r in quality_of(spark, docs).where("score >= 0.5").collect()}
    assert (900_004 in judged) == (900_004 in digest) and (900_003 in judged) <= (900_003 in digest)
    if 900_004 in digest:
        assert next(r["n_tokens"] for r in found if r["doc_id"] == 900_004) > 10_000


def quality_of(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    weights, bias = quality.fit(docs, labels, "quality", queries.fold(3) != 1)
    return quality.score(docs, weights, bias)
