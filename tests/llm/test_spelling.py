"""Spelling variants against comparing all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, lead=2):
    out = {}
    for word, n in counts.items():
        near = [(-m, w) for w, m in counts.items() if one_edit(word, w)]
        top = min(near, default=(0, None))
        out[word] = (top[1] if top[1] and -top[0] >= lead * n else None, len(near))
    roots = {}
    for word in counts:
        at = word
        while out[at][0]:
            at = out[at][0]
        roots[word] = at
    return sorted((w, out[w][0] or "", roots[w], n, out[w][1], counts[out[w][0]] if out[w][0] else -1) for w, n in counts.items())


def found(spark, counts, **how):
    df = spark.createDataFrame([(w, n, 1, "k") for w, n in counts.items()], "word string, n long, longer int, key string")
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in spelling.variants(df, **how).collect())


@pytest.mark.parametrize(("letters", "shared"), [("ab", 2), ("ab", 1_000), ("abcé", 4), ("abcdefghÿ", 64)])
def test_against_all_pairs(spark, letters, shared):
    draw = random.Random(len(letters) + shared)
    counts = {"".join(draw.choice(letters) for _ in range(draw.randint(5, 8))): draw.choice([3, 4, 6, 6, 12, 50]) for _ in range(400)}
    assert found(spark, counts, shared=shared) == brute(counts)


def test_runs_of_one_letter_and_long_words(spark):
    counts = {"a" * k: 3 * 2**k for k in range(5, 12)} | {"x" * 5_000: 3, "x" * 5_001: 9, "x" * 2_500 + "y" + "x" * 2_499: 5}
    assert found(spark, counts, shared=1) == brute(counts)


def test_no_words(spark):
    assert found(spark, {}) == [] and found(spark, {"single": 3}) == [("single", "", "single", 3, 0, -1)]


def counted(rows, slips, least_length=5, least_count=3):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if slips and i is not None and h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least_length and n >= least_count}


@pytest.mark.parametrize("slips", [None, 3, 97])
def test_word_counts(docs_of, slips, monkeypatch):
    draw = random.Random(5)
    words = ["Straße", "ÀÉÎÕÜ", "naïveté", "plain", "Plain", "日本語のテキスト", "x×÷yz", "a bcdef", "zebra-crossing", "\U0001d400five", "ŒuvresĀbcde"]
    rows = [(k, " ".join(draw.choice(words) for _ in range(40))) for k in range(30)] + [(3, "plain plain"), (3, "plain plain"), (None, "plain Plain PLAIN"), (7, None), (8, ""), (9, "plain " * 50_000), (10, "abcdef" * 60_000)]
    monkeypatch.setattr(spelling, "GATHERED", 5)
    got = spelling.word_counts(docs_of(rows), slips)
    assert {r["word"]: r["n"] for r in got.collect()} == counted(rows, slips)


def test_pieces_cut_no_word(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 7)
    text = "alpha betagamma éÉdelta, 12 epsilonzetaeta x"
    assert b"".join(spelling._pieces(text)).split() == [w.encode("latin-1") for w in ["alpha", "betagamma", "éÉdelta", "epsilonzetaeta", "x"]]
