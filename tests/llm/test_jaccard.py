"""Jaccard join against all pairs."""

import random

import pytest

from tessera.llm import jaccard


def shingle_set(text, n):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute(rows, n, percent):
    sets = [shingle_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for k in range(i):
            both = len(sets[i] & sets[k])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[k]) - both):
                parent[root(i)] = root(k)
    found = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if root(k) == root(i) and rows[k][0] is not None]
        found.append((d, len(sets[i]), min(ids) if sets[i] and ids else d))
    return sorted(found, key=repr)


def near_copies(seed, groups=8, each=7, length=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    rows, ids = [], rng.sample(range(10_000), groups * each + 20)
    hot = [word() for _ in range(12)]
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(4, length))]
        for _ in range(each):
            mine = [w if rng.random() > rng.choice([0, 0.01, 0.03]) else word() for w in base]
            rows.append((ids.pop(), " ".join(w.upper() if rng.random() < 0.1 else w for w in mine + (hot if rng.random() < 0.3 else []))))
    return rows + [(ids.pop(), " ".join(hot[: rng.randrange(1, 12)])) for _ in range(20)]


@pytest.mark.parametrize(("n", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (1, 50, 3), (2, 100, 4)])
def test_matches_brute_force(spark, docs_of, n, percent, seed):
    rows = near_copies(seed)
    assert sorted(map(tuple, jaccard.jaccard_join(docs_of(rows), n, percent).collect()), key=repr) == brute(rows, n, percent)


def test_chains_are_followed(spark, docs_of):
    words = [f"w{i}" for i in range(100)]
    rows = [(100 - k, " ".join(words[: 100 - 2 * k] if k < 8 else words[:84])) for k in range(9)]
    found = jaccard.jaccard_join(docs_of(rows), 3, 90).collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows, 3, 90)


def test_odd_rows(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "One two"), (9, "one TWO"), (5, "one"), (6, "one two three"), (7, "one two three"), (7, "one two three"), (None, "one two three"), (None, "alone " * 9), (8, "other text altogether")]
    assert sorted(map(tuple, jaccard.jaccard_join(docs_of(rows), 3, 90).collect()), key=repr) == brute(rows, 3, 90)


def test_one_id_with_two_texts(spark, docs_of):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "a b c d e f"), (3, "u v w x y z"), (4, "k l m n")]
    found = sorted(map(tuple, jaccard.jaccard_join(docs_of(rows), 3, 90).collect()))
    assert found == [(1, 4, 1), (1, 4, 1), (2, 4, 1), (3, 4, 1), (4, 2, 4)]


def test_empty_table_and_long_text(spark, docs_of):
    assert jaccard.jaccard_join(docs_of([]), 3, 90).count() == 0
    text = " ".join(str(i * 7919 % 30_011) for i in range(30_000))
    assert [r["component_id"] for r in jaccard.jaccard_join(docs_of([(5, text), (2, text + " x")]), 3, 90).collect()] == [2, 2]


def test_keep_one(spark, docs_of):
    rows = [(3, "a b c d e f g"), (1, "A b c d e f g"), (1, "A b c d e f g"), (4, None), (5, ""), (None, "n u l l s here too"), (None, "N u l l s here too"), (6, "q r s t u v")]
    df = docs_of(rows)
    kept = jaccard.keep_one(df, 3, 90)
    assert kept.columns == df.columns
    found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert [x[0] for x in found] == [1, 4, 5, 6, None] and found[-1][1].lower() == "n u l l s here too"


def test_salted_frequent_ngrams_change_nothing(spark, docs_of, monkeypatch):
    monkeypatch.setattr(jaccard, "SALT", 2)
    monkeypatch.setattr(jaccard, "SALTED_FROM", 1)
    monkeypatch.setattr(jaccard, "FREQUENT_IN_TASK", 2)
    rows = near_copies(9, groups=2, each=25, length=30)
    assert sorted(map(tuple, jaccard.jaccard_join(docs_of(rows), 3, 90).collect()), key=repr) == brute(rows, 3, 90)
