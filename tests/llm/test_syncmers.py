"""Fingerprints against plain Python, and the query against it on whole texts."""

import hashlib
import random
import re
import struct

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.llm import queries, syncmers


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def _hash(*parts):
    seed = 42
    for p in parts:
        seed = xxh64_intdigest(p.encode() if isinstance(p, str) else struct.pack("<q", p), seed)
    return _signed(seed)


def plain(text, most=64):
    tokens = re.findall(r"[^ \t\n\x0b\f\r]{1,4}", text or "")
    inner = [-(1 << 63)] * 4 + [_hash(*tokens[max(0, i - 1) : i + 1]) for i in range(len(tokens))]
    first = {}
    for i in range(len(tokens)):
        window = inner[i : i + 5]
        if min(window) in (window[0], window[-1]):
            key = (_hash(inner[i], inner[i + 2], inner[i + 4]) & ((1 << 64) - 1)) >> 29
            first.setdefault(key, i)
    return [(k << 28) | first[k] for k in sorted(first)[:most]]


def alike(a, b, most=64):
    if not a and not b:
        return 1.0
    p, q = ({x >> 28: x & ((1 << 28) - 1) for x in y} for y in (a, b))
    moved = {h: p[h] - q[h] for h in p if h in q}
    by = list(moved.values())
    shared = {h for h, m in moved.items() if m == 0 or by.count(m) > 1}
    least = sorted(set(p) | set(q))[:most]
    j = sum(h in shared for h in least) / len(least)
    return 2 * j / (1 + j)


def whole(rows):
    """Rows of the query for (doc_id, text), by descending doc_id, null ids last; ids are distinct."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [t or "" for _, t in order]
    out = {}
    for i, (doc_id, _) in enumerate(order):
        text, after = texts[i], texts[(i + 1) % len(texts)]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        a, b, c = plain(text), plain(edited), plain(after)
        hexed = lambda x: "".join(f"{y:016x}" for y in x)
        out[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), pytest.approx(alike(a, b)), pytest.approx(alike(a, c)))
    return out


def _rows(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.collect()}


def test_query_matches_plain_python(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert _rows(queries.op11_document_fingerprints(spark, folder)) == whole(docs)


def test_any_text(docs_of):
    draw = random.Random(2)
    texts = ["", None, "a", "ab", "abcd", "abcde", "   ", "ab ab", "x" * 3_000, "ab " * 5_000, "日本語のテキスト です", "\U0001d400\U0001d401 é ÿ", "one two three four five six seven", "one two three four five six eight"]
    texts += [" ".join(draw.choice(["alpha", "be", "gamma", "delta", "é"]) for _ in range(draw.randint(1, 400))) for _ in range(30)]
    rows = [*enumerate(texts, -5), (None, "no id"), (1 << 62, "alpha be gamma"), (-(1 << 63), "least id")]
    assert _rows(syncmers.edited_fingerprints(docs_of(rows).repartition(3))) == whole(rows)


def test_many_buckets_and_repeated_rows(docs_of, monkeypatch):
    monkeypatch.setattr(syncmers, "MOST_BUCKETS", 7)
    rows = [(k // 2, f"text {k // 3} of some words {k}") for k in range(60)]
    found = [tuple(r) for r in syncmers.with_next(docs_of(rows), ["text"]).select("doc_id", "text", "next_text").collect()]
    assert sorted(r[:2] for r in found) == sorted(rows)
    after = {t: (i, n) for i, t, n in found}
    at, seen = rows[-1][1], []
    for _ in rows:  # one ring through all documents, by descending id
        seen.append(after[at][0])
        at = after[at][1]
    assert at == rows[-1][1] and sorted(seen) == [r[0] for r in rows] and sum(a < b for a, b in zip(seen, seen[1:], strict=False)) <= 1


def test_one_document_and_none(docs_of):
    assert _rows(syncmers.edited_fingerprints(docs_of([(4, "abc abd abe")]))) == whole([(4, "abc abd abe")])
    assert syncmers.edited_fingerprints(docs_of([])).collect() == []


def test_shifted_text_stays_alike(docs_of):
    draw = random.Random(8)
    text = " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 9))) for _ in range(500))
    pairs = docs_of([(1, text)]).select(syncmers.likeness(syncmers.fingerprint(F.col("text")), syncmers.fingerprint(F.concat(F.lit("a few words before it "), "text"))).alias("x"))
    assert pairs.first()["x"] > 0.9


def test_no_python_in_the_plan(spark, folder):
    plan = queries.op11_document_fingerprints(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
