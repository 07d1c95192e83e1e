"""Byte pairs, licences, archives and decontamination against plain versions."""

import hashlib
import io
import random
import re
import zipfile

import public_tokenizers
import duckdb
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from tessera.llm import bpe, decontamination, licences, warc

# ---- byte pairs ----

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(RANKS, public_tokenizers.PATTERN)


@pytest.mark.parametrize("text", ["", "a", "Hello  world's\n\n end ", " " * 1500 + "x", " " * 1499 + "\n", "a" + "\n" * 2000 + "b c", "x" + " " * 1023 + " y", " " * 1100 + "'s" + "\t" * 1030, "é" * 3000, "a " * 2000, "\x1c" * 1100 + "b", "日本 " * 9000, "a" * 20_000])
def test_segments_do_not_change_ids(encoder, text):
    assert bpe.encode(encoder, text) == encoder.encode_ordinary(text)
    small = [i for part, run in bpe.segments(text, 40) for i in (encoder._encode_single_piece(part) if run else encoder.encode_ordinary(part))]
    assert small == encoder.encode_ordinary(text) and "".join(p for p, _ in bpe.segments(text, 40)) == text


def test_runs_too_long_for_the_library(encoder):
    text = "a" + " " * 1_000_000 + "b"
    assert encoder.decode_bytes(bpe.encode(encoder, text)) == text.encode()


def test_round_trip(spark, docs_of):
    rows = [(1, "Some text.\n"), (1, "Some text.\n"), (2, None), (3, ""), (None, "émoji 🙂"), (4, "<|endoftext|>"), (5, "long text " * 20_000)]
    for r in bpe.round_trip(docs_of(rows), RANKS, public_tokenizers.PATTERN).collect():
        text = next(t for i, t in rows if i == r["doc_id"]) or ""
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and (r["n_tokens"] > 0) == bool(text)
    assert bpe.round_trip(docs_of([]), RANKS, public_tokenizers.PATTERN).count() == 0
    ids = {r["doc_id"]: r["ids"] for r in bpe.token_ids(docs_of(rows), RANKS, public_tokenizers.PATTERN).collect()}
    assert ids[2] == [] and len(ids[4]) > 1


# ---- licences ----


def brute_licences(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for phrase, label in licences.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def licence_texts(seed, n=150):
    rng = random.Random(seed)
    pool = [w for t in [*licences.PHRASES, *(x for ts in licences.TEMPLATES.values() for x in ts)] for w in t.split()]
    whole = [*licences.PHRASES, *(x for ts in licences.TEMPLATES.values() for x in ts)]
    return [rng.choice([" ", "\n", "-", " (c) "]).join(rng.choice([rng.choice(pool), rng.choice(pool).upper(), rng.choice(whole), "Übung", "x1"]) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def test_base_places_match_brute_force(spark, docs_of):
    rows = [*enumerate(licence_texts(1)), (900, None), (901, ""), (None, "MIT License"), (902, "cc by cc by CC-BY"), (903, "mit " * 50_000 + "license"), (904, "GNU General Public Licence")]
    found = {r["doc_id"]: r for r in licences.scan(docs_of(rows)).collect()}
    for i, text in rows:
        r = found[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_licences(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licences.scan(docs_of([])).count() == 0


def test_matching_statistics():
    scanner = licences.Scanner()
    rng = random.Random(2)
    tokens = [rng.randrange(len(scanner.vocabulary)) for _ in range(300)] + scanner.sequences[5]
    inside = lambda part: any(part == s[i : i + len(part)] for s in scanner.sequences for i in range(len(s)))
    for end, (_, length) in enumerate(scanner.automaton.statistics(tokens), 1):
        assert inside(tokens[end - length : end]) and (length == end or not inside(tokens[end - length - 1 : end]))


def test_template_with_a_gap_is_one_span():
    words = licences.TEMPLATES["mit"][0].split()
    text = "Intro here. " + " ".join(words[:14]) + " (the) 2024 NEW " + " ".join(words[14:])
    _, places, spans = licences.Scanner().scan(text)
    assert not places and [(s[1], s[2]) for s in spans] == [(2, 2 + len(words) + 2)] and spans[0][3] > 0.95


def test_one_word_phrase():
    scanner = licences.Scanner({"mit": "mit"}, {})
    assert scanner.scan("mit x mit") == (3, [(0, 0), (0, 2)], [])


def test_repeats_and_reversed_pieces_cover_nothing():
    bsd = licences.TEMPLATES["bsd"][0].split()
    blocks = [bsd[i : i + 4] for i in range(0, len(bsd), 4)]
    for text in ("x ".join(["licensed under the apache license "] * 6), "x ".join(["you may obtain a copy of the license "] * 3), " ".join(w for b in reversed(blocks) for w in b)):
        assert licences.Scanner().scan(text)[2] == [], text


def brute_spans(scanner, text):
    """Maximal common runs by comparing all places, chains by comparing all pairs of pieces."""
    words = licences.words_of(text)
    templates = [(o, t) for o, (t, base) in enumerate(zip(scanner.sequences, scanner.is_phrase, strict=True)) if not base]
    known = [scanner.vocabulary.get(w) for w in words]
    occurs = lambda part: any(part == s[i : i + len(part)] for s in scanner.sequences for i in range(len(s) - len(part) + 1))
    runs = []
    for i in range(len(known)):
        k = i
        while k < len(known) and known[k] is not None and occurs(known[i : k + 1]):
            k += 1
        if k - i >= licences.MIN_MATCH and not (i and known[i - 1] is not None and occurs(known[i - 1 : k])):
            runs.append((i, k))
    spans = []
    for owner, t in templates:
        pieces = [(i, k, p) for i, k in runs for p in range(len(t) - (k - i) + 1) if known[i:k] == t[p : p + k - i]]
        chains = []
        for i, k, p in pieces:
            options = [(k - i, i)]
            for (a, z, q), (n, begin) in zip(pieces, chains, strict=False):
                shared = max(0, z - i, q + z - a - p)
                if z < k and q + z - a < p + k - i and i - z <= licences.MAX_GAP and k - i > shared:
                    options.append((n + k - i - shared, begin))
            chains.append(max(options, key=lambda c: (c[0], -c[1])))
        mine = []
        for n, begin, end in sorted([(n, begin, k - 1) for (n, begin), (_, k, _) in zip(chains, pieces, strict=True)], key=lambda c: (-c[0], c[1], c[2])):
            if all(begin > z or end < a for _, a, z in mine):
                mine.append((n, begin, end))
        spans += [(n, n / len(t), a, z, owner) for n, a, z in mine if n >= licences.MIN_COVER * len(t)]
    better = lambda s: any(s[2] <= t[3] and t[2] <= s[3] and (t[0], t[1]) > (s[0], s[1]) and not better(t) for t in spans)
    return sorted(((o, a, z, c) for _, c, a, z, o in (s for s in spans if not better(s))), key=lambda s: (s[1], s[0]))


def test_spans_labels_and_score_match_brute_force(spark, docs_of):
    rng, scanner = random.Random(3), licences.Scanner()
    whole = [t.split() for ts in licences.TEMPLATES.values() for t in ts]

    def piece():
        t = rng.choice(whole)
        a = rng.randrange(len(t))
        cut = rng.choice([t, t[a : a + rng.randrange(3, 30)], t[a:] + t[:a], ["x1"] * rng.randrange(1, 12), rng.choice(list(licences.PHRASES)).split()])
        return [w for w in cut if rng.random() > 0.03]

    rows = [(i, " ".join(w for _ in range(rng.randrange(1, 7)) for w in piece())) for i in range(120)]
    rows += [(500, rows[0][1]), (500, rows[0][1]), (None, rows[1][1]), (501, None), (502, "")]
    found = licences.scan(docs_of(rows)).collect()
    named = 0
    for r, (i, text) in zip(sorted(found, key=repr), sorted(rows, key=lambda x: repr(next(r for r in found if r["doc_id"] == x[0]))), strict=True):
        assert r["doc_id"] == i
        spans = brute_spans(scanner, text)
        places = scanner.scan(text)[1]
        assert [(s["label"], s["first_word"], s["last_word"], s["cover"]) for s in r["spans"]] == [(scanner.labels[o], a, z, c) for o, a, z, c in spans]
        assert r["labels"] == ",".join(sorted({scanner.labels[o] for o, _ in places} | {scanner.labels[o] for o, *_ in spans}))
        assert r["score"] == (1.0 if places else max((c for *_, c in spans), default=0.0))
        named += bool(spans)
    assert named > 60


# ---- archives ----


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("x"), "payload": F.lit(1)})


def test_archives_round_trip(spark, tmp_path):
    long, other = "<p>" + "x" * 200, "é" * 60
    rows = [(7, "http://a/b c?d=é\n", long), (3, None, long), (3, None, long), (9, "u", long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (5, "u", ""), (None, "u", long), (6, "u", other), (8, "u", other), (10, "u", "z" * 99), (11, "u", "z" * 99), (12, "u", "big " * 300_000)]
    found = warc.round_trip(spark, pages_of(spark, rows), f"file://{tmp_path}/w", payloads=True).collect()
    assert len(found) == len(rows)
    for r in found:
        html = next((h or "").encode() for i, _, h in rows if i == r["page_id"])
        same = [i for i, _, h in rows if (h or "").encode() == html and i is not None]
        response = len(html) < 100 or r["page_id"] == min(same)
        assert r["record_type"] == ("response" if response else "revisit") and r["refers_to"] == (None if response else min(same))
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html), hashlib.sha256(html).hexdigest()) and r["payload"] == (html if response else None)


def test_empty_table(spark, tmp_path):
    assert warc.round_trip(spark, pages_of(spark, []), f"file://{tmp_path}/w").count() == 0


def test_archives_are_zip_files_and_split(tmp_path):
    writer = warc.ArchiveWriter(f"file://{tmp_path}", limit=2_000)
    for i in range(40):
        data = random.Random(i).randbytes(300)
        writer.add(i, f"u{i}", data, hashlib.sha256(data).hexdigest(), None)
    writer.close()
    assert len(writer.paths) > 3 and sum(n for _, n in writer.paths) == 40
    seen = []
    for path, n in writer.paths:
        with zipfile.ZipFile(path.removeprefix("file://")) as z:
            assert z.testzip() is None and z.namelist() == [warc.DATA, warc.INDEX] and len(z.read(warc.INDEX).splitlines()) == n
        seen += [r["page_id"] for r in warc.read_archive(path, range_bytes=700)]
    assert seen == list(range(40))


def test_zip64_directories(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        z.writestr("a", b"x" * 150)
        z.writestr("b", b"y" * 120)
        z.comment = b"PK\5\6 not the end"[:3] * 9
    assert b"PK\6\6" in out.getvalue() and b"PK\6\7" in out.getvalue()
    (tmp_path / "z.zip").write_bytes(out.getvalue())
    store, at = fs.FileSystem.from_uri(f"file://{tmp_path}/z.zip")
    with store.open_input_file(at) as source:
        members = warc.directory(source, source.size())
        assert [(m.name, source.read_at(m.size, warc.data_begin(source, m))) for m in members] == [("a", b"x" * 150), ("b", b"y" * 120)]


def test_broken_archives_are_refused(tmp_path):
    (tmp_path / "a.zip").write_bytes(b"nothing")
    with pytest.raises(ValueError, match="no ZIP"):
        list(warc.read_archive(f"file://{tmp_path}/a.zip"))
    good = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc.parsed(good)["payload"] == b"payload"
    with pytest.raises(ValueError, match="disagree"):
        warc.parsed(good.replace(b"payload\r\n", b"PAYLOAD\r\n"))


# ---- decontamination ----


def words(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def counts(w):
    out = {}
    for i in range(len(w) - 4):
        out[tuple(w[i : i + 5])] = out.get(tuple(w[i : i + 5]), 0) + 1
    return out


def similarity(a, b):
    both = sum(min(n, b.get(k, 0)) for k, n in a.items())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute_leaks(rows, items):
    """Best similarity over all windows of an item's length."""
    out = {}
    for d, text in rows:
        w = words(text)
        for i, item in items:
            t = words(item)
            if len(t) >= 5 and len(w) >= 5:
                best = max(similarity(counts(w[s : s + len(t)]), counts(t)) for s in range(max(1, len(w) - len(t) + 1)))
                if best >= 0.8:
                    out[d, i] = max(best, out.get((d, i), 0))
    return out


def leaked(seed, n=40):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(300))
    items = [(i, " ".join(word() for _ in range(rng.randrange(14, 60)))) for i in range(8)] + [(100, None), (101, "too few words")]
    items.append((50, " ".join(items[0][1].split()[5:])))  # part of another item
    rows = []
    for d in range(n):
        text = [word() for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.7:
            passage = rng.choice(items[:8])[1].split()
            if rng.random() < 0.5:
                passage[rng.choice([0, len(passage) // 2, -1])] = word()
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.upper() if rng.random() < 0.2 else w + rng.choice(["", ",", "."]) for w in passage]
        rows.append((d, " ".join(text)))
    return rows, items


@pytest.mark.parametrize(("seed", "words"), [(1, 1 << 15), (2, 1 << 15), (3, 1)])
def test_leaks_match_brute_force(spark, docs_of, monkeypatch, seed, words):  # a Bloom filter of one word lets all through
    monkeypatch.setattr(decontamination, "BLOOM_WORDS", words)
    rows, items = leaked(seed)
    found = decontamination.contaminated(docs_of(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    wanted = brute_leaks(rows, items)
    assert {(r["doc_id"], r["item_id"]) for r in found} == set(wanted) and len(found) == len(wanted)
    assert all(r["similarity"] == pytest.approx(wanted[r["doc_id"], r["item_id"]], abs=0.03) for r in found)


def test_odd_rows_and_clean_documents(spark, docs_of):
    item = " ".join(f"w{i}" for i in range(30))
    rows = [(1, item), (1, item), (2, None), (3, ""), (4, "a few words"), (None, "x " + item), (5, "clean text of some length " * 50_000), (6, " ".join(f"v{i}" for i in range(40)))]
    docs, bench = docs_of(rows), spark.createDataFrame([(9, item), (9, item)], "item_id long, text string")
    found = decontamination.contaminated(docs, bench).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["similarity"]) for r in found), key=repr) == sorted([(1, 9, 1.0), (None, 9, 1.0)], key=repr)
    kept = decontamination.keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5, 6]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(docs, none).count() == 0 and decontamination.keep_clean(docs_of([]), bench).count() == 0


def test_short_items_are_found_whole(spark, docs_of):
    items = [(1, "One"), (2, "two words"), (3, "now FOUR words here"), (4, " ".join(f"w{i}" for i in range(20))), (5, "..."), (2, "one more three")]
    rows = [(1, "there is one."), (2, "words two"), (3, "x two words y"), (4, "says now four, words here!"), (5, " ".join(f"w{i}" for i in range(20)) + " one"), (6, "..."), (7, None), (8, "one more three")]
    found = decontamination.contaminated(docs_of(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["first_word"], r["similarity"]) for r in found) == [(1, 1, 2, 1.0), (3, 2, 1, 1.0), (4, 3, 1, 1.0), (5, 1, 20, 1.0), (5, 4, 0, 1.0), (8, 1, 0, 1.0), (8, 2, 0, 1.0)]


def test_query_against_all_windows(spark):
    """The query at sf0.01 against the best of all windows; only pairs that share no shingle, whose similarity is 0, are left out."""
    docs, items = (duckdb.sql(f"SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'").fetchall() for t in ("documents", "benchmark"))
    held = {i: counts(words(t)) for i, t in items}
    wanted = {}
    for d, text, *_ in docs:
        w = words(text)
        mine = counts(w)
        for i, item in items:
            if mine.keys() & held[i].keys():
                size = len(words(item))
                best = max(similarity(counts(w[s : s + size]), held[i]) for s in range(max(1, len(w) - size + 1)))
                if best >= 0.8:
                    wanted[d, i] = best
    from tessera.llm import queries

    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in queries.op5_decontamination(spark, "/root/testdata/sf0.01").collect()}
    assert found.keys() <= wanted.keys() and len(found) >= 0.99 * len(wanted) > 10
    assert all(x == pytest.approx(wanted[k], abs=0.03) for k, x in found.items())


def test_native_plan(spark, docs_of):
    plan = decontamination.contaminated(docs_of([(1, "a b c d e f")]), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
