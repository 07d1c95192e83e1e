"""The toxicity and quality queries against plain Python: units, subsequences and updates one by one."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality, queries, toxicity
from tessera.llm import words as W
from tessera.llm.common import table

WORD = re.compile(rb"[^" + re.escape(toxicity.PARTS) + rb"\x1e]+")


def plain_key(parts):
    key = (parts[0] * 0x9E3779B1 + len(parts) - 1) & 0xFFFFFFFF
    for byte, factor in zip(parts[1:], (0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F), strict=False):
        key = ((key ^ (key >> 15)) + byte * factor) & 0xFFFFFFFF
    return (((key ^ (key >> 13)) * 0x5BD1E995) & 0xFFFFFFFF) >> (32 - toxicity.BITS)


def plain_value(words, machine):
    flat = b"".join(b"\x01" + w + b"\x02" for w in words)
    total = norm = 0.0
    for offsets in toxicity.OFFSETS:
        weight = toxicity.GAP ** (offsets[-1] - len(offsets))
        total += sum(weight * float(machine.table[plain_key([flat[i], *(flat[i + o] for o in offsets)])]) for i in range(len(flat) - offsets[-1]))
        norm += max(min(len(flat), 24) - offsets[-1], 0) * weight**2
    return total / (math.sqrt(max(norm, 1e-9)) * max(len(flat) / 24, 1)) + machine.bias


def plain_score(text, machine):
    (_, _, raw, at), = W.chunks(toxicity.read_both_ways(pa.array([text.lower()])))
    data = toxicity.unhidden(raw, at)[0].tobytes()
    sentences, n = [], 0
    for part in data.split(b"\x1e"):
        found = WORD.findall(part)
        if found:
            sentences.append((n, found))
            n += len(found)
    units = []
    for begin, found in sentences:
        runs = [(i, i + k) for k in (1, 2, 4) for i in range(len(found) - k + 1)] + ([] if len(found) in (1, 2, 4) else [(0, len(found))])
        units += [(-plain_value(found[a:z], machine), begin + a, begin + z, b"\x02\x01".join(found[a:z])) for a, z in runs]
    if not units:
        return 0.0
    chosen, seen, taken = [], set(), set()
    for minus, a, z, unit in sorted((u for u in units if u[0] <= 0), key=lambda u: u[:2]):
        if unit not in seen and taken.isdisjoint(range(a, z)):
            taken.update(range(a, z))
            chosen.append(-minus)
        seen.add(unit)
    values = chosen or [-min(units)[0]]
    return 1 - math.prod(1 - 1 / (1 + math.exp(-machine.slope * v - machine.offset)) for v in values)


def test_toxicity_query_matches_plain_python(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    machine = toxicity.fit(docs, labels, "toxic", queries.fold(3) != 1)
    found = {r["doc_id"]: r for r in queries.op6_toxicity(spark, folder).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert found.keys() == texts.keys() and machine is not toxicity.UNTRAINED
    short = {i: t for i, t in texts.items() if len(t) <= 1_500}
    assert len(short) > 50
    for i, t in short.items():
        assert found[i]["score"] == pytest.approx(plain_score(t, machine), abs=1e-4), i
        assert found[i]["predicted"] == int(found[i]["score"] >= 0.7)


def test_one_letter_more_in_words_of_new_forms(spark):
    """Insults are found with an inserted letter that training never saw, and alone."""
    draw = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    filler = ["".join(draw.choice(letters) for _ in range(draw.randint(3, 9))) for _ in range(300)]
    insults = ["clown", "moron", "worthless", "pathetic"]
    rows = []
    for i in range(400):
        words = [draw.choice(filler) for _ in range(draw.randint(5, 30))]
        if toxic := i % 4 == 0:
            words.insert(draw.randrange(len(words)), draw.choice(insults))
        rows.append((i, " ".join(words) + ".", int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels, "toxic", F.lit(True))
    of = lambda texts: toxicity.probabilities(pa.array(texts), machine)
    assert (of(insults) >= 0.7).all()
    known = {f for w in insults for f in toxicity.misspelled(w.encode())}
    forms = [w[:k] + c + w[k:] for w in insults for k in range(1, len(w)) for c in letters]
    forms = [f for f in forms if f.encode() not in known]
    assert len(forms) > 400 and (of(forms) >= 0.7).mean() >= 0.8
    assert (of([f"{a} {b} {c}" for a, b, c in itertools.batched(filler, 3)]) >= 0.7).mean() <= 0.02


def plain_tokens(text):
    kind = lambda c: 0 if c <= 32 or c == 127 else 2 if c < 127 and not chr(c).isalnum() else 1
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    return [bytes(c for _, c in run) for k, run in itertools.groupby(((kind(c), c) for c in data), key=lambda x: x[0]) if k]


def plain_features(text, s):
    tokens = plain_tokens(text)
    hashed = [W.word_hashes(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0] for t in tokens]
    out = {}
    for n in range(1, s.order + 1):
        grams = [quality.AGAIN if n > 1 and hashed[i] == hashed[i + n - 1] else W.ngram_hashes(np.array(hashed[i : i + n], np.uint64), n)[0] for i in range(len(hashed) - n + 1)]
        for g in grams:
            spot = ((int(g) + n) & ((1 << 64) - 1)) >> (64 - s.bits)
            out[spot] = out.get(spot, 0.0) + s.scale / len(grams)
    return out


def plain_leader(rows, s):
    """Follow-the-regularised-leader, proximal, a coordinate at a time; "bias" has no penalty."""
    z, n = {}, {}

    def weight(k):
        l1, l2 = (0.0, 0.0) if k == "bias" else (s.l1, s.l2)
        if abs(z.get(k, 0.0)) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((s.beta + math.sqrt(n[k])) / s.alpha + l2)

    for _ in range(s.epochs):
        for features, y in rows:
            x = features | {"bias": 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(w[k] * v for k, v in x.items())))))
            for k, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / s.alpha
                z[k] = z.get(k, 0.0) + g - sigma * w[k]
                n[k] = n.get(k, 0.0) + g * g
    return {k: weight(k) for k in z}


def test_quality_query_matches_plain_python(spark, folder):
    s = quality.Settings()
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, folder, "documents").collect()}
    labels = table(spark, folder, "labels").where(queries.fold(3) != 1).where("quality IS NOT NULL AND doc_id IS NOT NULL").collect()
    taught = [(i, texts[i], y) for i, y in {r["doc_id"]: r["quality"] for r in labels}.items() if i in texts and len(texts[i].encode()) <= quality.TRAINING_BYTES]
    taught.sort(key=lambda r: int(W.mix(np.array([r[0]], np.int64).view(np.uint64))[0]))
    weights = plain_leader([(plain_features(t, s), y) for _, t, y in taught], s)
    found = {r["doc_id"]: r for r in queries.op8_quality_classifier(spark, folder).collect()}
    assert found.keys() == texts.keys() and len(taught) > 30
    for i, t in texts.items():
        total = weights.get("bias", 0.0) + sum(weights.get(k, 0.0) * v for k, v in plain_features(t, s).items())
        assert found[i]["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, total)))), abs=2e-3), i
