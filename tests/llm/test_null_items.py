"""Benchmark items whose id is null are found like others."""

import pytest

from tessera.llm import decontamination


@pytest.mark.parametrize("words", [1 << 15, 1])
def test_null_item_id(spark, docs_of, monkeypatch, words):
    monkeypatch.setattr(decontamination, "BLOOM_WORDS", words)
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    docs, bench = docs_of([(1, a), (2, b), (3, "c " * 30)]), spark.createDataFrame([(None, a), (7, b)], "item_id long, text string")
    found = decontamination.contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["similarity"]) for r in found} == {(1, None, 1.0), (2, 7, 1.0)} and len(found) == 2
    assert [r["doc_id"] for r in decontamination.keep_clean(docs, bench).collect()] == [3]
