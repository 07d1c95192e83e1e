"""Substring dedup against a plain search of windows."""

import random

import numpy as np
import pytest

from tessera.llm import substrings
from tessera.llm import words as W


def brute(rows, width):
    docs = sorted({(i is None, i or 0, t) for i, t in rows}, key=lambda d: (d[0], d[1]))
    first, found = {}, {}
    for d in docs:
        words, covered = (d[2] or "").encode().split(), set()
        for i in range(len(words) - width + 1):
            if first.setdefault(tuple(words[i : i + width]), (d, i)) != (d, i):
                covered |= set(range(i, i + width))
        kept = b" ".join(w for i, w in enumerate(words) if i not in covered)
        found[d] = (len(words), len(covered), kept.decode())
    return found


def check(spark, docs_of, rows, width):
    out = substrings.remove_repeats(docs_of(rows), width, rejoin=True).select("doc_id", "n_words", "n_removed", "text").collect()
    wanted = brute(rows, width)
    assert sorted(map(tuple, out), key=repr) == sorted(((i, *wanted[i is None, i or 0, t]) for i, t in rows), key=repr)
    return out


def corpus(seed, n=60, vocabulary=30):
    rng = random.Random(seed)
    line = lambda k: [rng.choice("abcdefghijklmnopqrstuvwxyzäöü0123") * rng.randrange(1, 3) for _ in range(k)]
    shared = [line(rng.randrange(6, 30)) for _ in range(6)]
    rows = []
    for i in rng.sample(range(1000), n):
        words = line(rng.randrange(0, 25))
        for _ in range(rng.randrange(3)):
            words += rng.choice(shared) + line(rng.randrange(0, 6))
        rows.append((i, rng.choice([" ", "\n", "  ", "\t \r"]).join(words)))
    return rows


@pytest.mark.parametrize("width", [3, 8, 20])
def test_matches_brute_force(spark, docs_of, width):
    check(spark, docs_of, corpus(width), width)


@pytest.mark.parametrize("share", [0.0, 0.2])
def test_hot_minimisers_change_nothing(spark, docs_of, monkeypatch, share):
    rows, empty = corpus(3), np.empty(0, np.uint64)
    import pyarrow as pa

    plain = np.unique(np.concatenate([substrings.super_kmers(raw, at, 8, empty)[-1] for _, _, raw, at in W.chunks(pa.array([t for _, t in rows]))]))
    monkeypatch.setattr(substrings, "hot_minimisers", lambda docs, width: plain[:: 1 if share else 3])
    check(spark, docs_of, rows, 8)


def test_odd_rows(spark, docs_of):
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(5, passage), (5, passage), (3, None), (4, ""), (None, passage), (1, "few words"), (2, "x " + passage + " y"), (7, " \n "), (9, "a " * 200), (10, "a " * 50)]
    out = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in check(spark, docs_of, rows, 20)}
    assert out[5, 30] == 30 and out[2, 32] == 0 and out[None, 30] == 30 and out[9, 200] == 199


def test_one_id_with_two_texts(spark, docs_of):
    passage = " ".join(f"w{i}" for i in range(25))
    out = substrings.remove_repeats(docs_of([(1, passage), (1, passage + " more"), (2, "other")]), 20).collect()
    assert sorted(r["n_removed"] for r in out) == [0, 0, 25]


def test_columns_stay_and_text_is_left_alone(spark, docs_of):
    df = docs_of([(1, "a\nb  c"), (2, None)])
    out = substrings.remove_repeats(df, 2, n_words=None, n_removed=None)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))


def test_long_text_and_empty_table(spark, docs_of):
    text = " ".join(f"{i * 7919 % 5000:x}" for i in range(60_000))
    out = check(spark, docs_of, [(1, text), (2, text[:200_000])], 20)
    assert sum(r["n_removed"] for r in out) > 0
    assert substrings.remove_repeats(docs_of([]), 20).count() == 0


def test_unequal_windows_with_equal_hashes(monkeypatch):
    monkeypatch.setattr(W, "ngram_hashes", lambda words, n: np.zeros(max(0, len(words) - n + 1), np.uint64))
    sender = substrings._Sender(1)
    import pyarrow as pa

    texts = ["a b c d", "x b c d", "q a b c d"]
    for a, z, raw, at in W.chunks(pa.array(texts)):
        sender.add(list(range(a, z)), [0] * (z - a), raw, at, 3, np.empty(0, np.uint64))
    blobs = [b for batch in sender.send() for b in batch.column(1).to_pylist()]
    found = {(int(r["doc_id"]), int(r["start"]), int(r["end"])) for part in substrings.repeats_in_bucket(blobs, 3) for r in part}
    assert found == {(1, 1, 4), (2, 1, 4), (2, 2, 5)}


