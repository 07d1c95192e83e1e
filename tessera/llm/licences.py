"""Licence scans: a generalised suffix automaton of licence tokens gives matching statistics of streamed
texts; long matches are chained into covered spans of the templates.

Words that occur in no template can neither extend nor begin a match, so a text is cut
into stretches of known tokens first; the automaton reads only those. A template is one
passage of a licence notice. A match stands at places of the text and of a template; a
chain goes up in both, so that repeated or reordered pieces add nothing, and its cover is
the number of places of the template that it matches.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import bounded_batches

#: Fixed values of the contract: phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Passages of well-known public licence notices, by label.
TEMPLATES = {
    "apache": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "released under the mit license",
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "you should have received a copy of the gnu general public license along with this program if not see",
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details",
        "you should have received a copy of the gnu lesser general public license along with this library if not see",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license", "licensed under cc by 4 0"),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    ),
}

#: A match of at least this many words takes part in a chain ...
MIN_MATCH = 4
#: ... a chain may skip this many words of text between two matches ...
MAX_GAP = 8
#: ... and must cover this share of a template (or a whole phrase) to give a label.
MIN_COVER = 0.5

RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,cover:double>>"

#: Every ASCII byte that is no digit or letter separates words; capitals become small.
_TRANSLATE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TRANSLATE).split()


@dataclass
class SuffixAutomaton:
    """Of several token sequences. A state stands for a set of substrings with the same end places; ``ends`` has these as (sequence, place)."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.step) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.step[p].get(token) == q:
            self.step[p][token] = copy
            p = self.link[p]
        return copy

    def add(self, tokens: Sequence[int]) -> None:
        last = 0
        for token in tokens:
            q = self.step[last].get(token)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
            else:
                new = self._state(self.length[last] + 1, {}, 0)
                p = last
                while p >= 0 and token not in self.step[p]:
                    self.step[p][token] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.step[p][token]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
                last = new

    def finish(self, sequences: Sequence[Sequence[int]], shortest: int) -> SuffixAutomaton:
        """Notes the end places of all states that hold a substring of ``shortest`` tokens."""
        for owner, tokens in enumerate(sequences):
            state = 0
            for at, token in enumerate(tokens):
                state = self.step[state][token]
                up = state
                while up > 0 and self.length[up] >= shortest:
                    self.ends[up].append((owner, at))
                    up = self.link[up]
        return self

    def statistics(self, tokens: Sequence[int]) -> Iterator[tuple[int, int]]:
        """For each place the state and length of the longest match that ends there."""
        state = length = 0
        for token in tokens:
            while state and token not in self.step[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.step[state]:
                state = self.step[state][token]
                length += 1
            yield state, length


class Scanner:
    """Automaton of phrases and templates with the vocabulary that their words make."""

    def __init__(self, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, Sequence[str]] = TEMPLATES):
        named = [(p, label, True) for p, label in phrases.items()] + [(t, label, False) for label, ts in templates.items() for t in ts]
        self.vocabulary: dict[bytes, int] = {}
        self.sequences = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(t)] for t, _, _ in named]
        self.labels = [label for _, label, _ in named]
        self.is_phrase = [base for _, _, base in named]
        self.automaton = SuffixAutomaton()
        for tokens in self.sequences:
            self.automaton.add(tokens)
        self.automaton.finish([() if base else tokens for tokens, base in zip(self.sequences, self.is_phrase, strict=True)], MIN_MATCH)
        #: State at which a phrase has been read whole -> the phrases, longest first.
        self.phrase_end: dict[int, list[int]] = {}
        for owner, tokens in enumerate(self.sequences):
            if self.is_phrase[owner]:
                state = 0
                for token in tokens:
                    state = self.automaton.step[state][token]
                self.phrase_end.setdefault(state, []).append(owner)
        #: Phrases that end where a match of this state ends: those of the state and of its suffix links.
        self.phrases_at: list[list[int]] = []
        for state in range(len(self.automaton.step)):
            found, up = [], state
            while up > 0:
                found += self.phrase_end.get(up, [])
                up = self.automaton.link[up]
            self.phrases_at.append(found)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """Number of words; places (owner, first word) of whole phrases; spans (owner, first, last, cover) of templates."""
        words = words_of(text)
        known = list(map(self.vocabulary.get, words))
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []
        at, n = 0, len(known)
        numbered = [i for i, x in enumerate(known) if x is not None]
        k = 0
        while k < len(numbered):
            at = numbered[k]
            end = k
            while end + 1 < len(numbered) and numbered[end + 1] == numbered[end] + 1:
                end += 1
            stretch = known[at : numbered[end] + 1]
            k = end + 1
            self._stretch(at, stretch, places, matches)
        return n, places, self._chains(matches)

    def _stretch(self, at: int, stretch: list[int], places: list, matches: list) -> None:
        before = (0, 0, 0)
        for i, (state, length) in enumerate(self.automaton.statistics(stretch), at):
            for owner in self.phrases_at[state]:
                size = len(self.sequences[owner])
                if length >= size:
                    places.append((owner, i - size + 1))
            if length <= before[1] and before[1] >= MIN_MATCH:
                matches.append(before)
            before = (state, length, i)
        if before[1] >= MIN_MATCH:
            matches.append(before)

    def _chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Spans (owner, first, last, cover) of the best chains. Matches come in the order of their ends, and so of their begins.

        A span that overlaps one of more matched places, or of as many and a larger cover, is left out.
        """
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for state, length, end in matches:
            for owner, place in self.automaton.ends[state]:
                pieces.setdefault(owner, []).append((end, place, length))
        spans = []
        for owner, mine in pieces.items():
            size = len(self.sequences[owner])
            spans += [(covered, first, last, covered / size, owner) for covered, first, last in best_chains(mine) if covered >= MIN_COVER * size]
        out = []
        for run in _apart(spans):
            taken: list[tuple] = []
            for span in sorted(run, key=lambda s: (-s[0], -s[3], s[1], s[4])):
                if not any(span[1] <= t[2] and t[1] <= span[2] and (t[0], t[3]) > (span[0], span[3]) for t in taken):
                    taken.append(span)
            out += [(owner, first, last, cover) for _, first, last, cover, owner in taken]
        return sorted(out, key=lambda s: (s[1], s[0]))


def best_chains(pieces: list[tuple[int, int, int]], gap: int = MAX_GAP) -> list[tuple[int, int, int]]:
    """(matched places, first word, last word) of chains of pieces (last word in the text, last place in the template, length).

    Pieces come in the order of their last words. A chain goes up in the text and in the template and skips ``gap`` words of
    the text at most between two pieces; what a piece shares with the one before it counts once. Of chains that overlap in
    the text the one of most places is taken, the first of equal ones.
    """
    found: list[tuple[int, int, int]] = []
    low = 0
    for k, (end, place, length) in enumerate(pieces):
        first = end - length + 1
        while pieces[low][0] < first - gap - 1:
            low += 1
        best = (length, -first)
        for i in range(low, k):
            other_end, other_place, _ = pieces[i]
            gain = length - max(0, other_end - first + 1, other_place - (place - length))
            if other_end < end and other_place < place and gain > 0:
                best = max(best, (found[i][0] + gain, -found[i][1]))
        found.append((best[0], -best[1], end))
    out: list[tuple[int, int, int]] = []
    for run in _apart(found):
        taken: list[tuple[int, int, int]] = []
        for chain in sorted(run, key=lambda c: (-c[0], c[1], c[2])):
            if all(chain[1] > t[2] or t[1] > chain[2] for t in taken):
                taken.append(chain)
        out += taken
    return out


def _apart(chains: list[tuple]) -> Iterator[list[tuple]]:
    """Tuples of anything, first and last word, in runs of such as reach each other in the text."""
    run: list[tuple] = []
    reach = -1
    for chain in sorted(chains, key=lambda c: c[1]):
        if run and chain[1] > reach:
            yield run
            run = []
        run.append(chain)
        reach = max(reach, chain[2])
    if run:
        yield run


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, Sequence[str]] = TEMPLATES) -> DataFrame:
    """One row for each row of ``docs``: places of whole phrases, labels, and covered template spans.

    ``score`` is the largest cover of a phrase (1) or template span, 0 without any. Null
    texts count as empty, rows with a null doc_id and repeated rows stay, other columns
    are ignored, an empty table gives an empty result. Labels are distinct, sorted and
    joined by commas; without labels they are empty strings. Whole texts are read; each
    row is scanned where it is read, without a shuffle. Of spans that overlap, those of most
    matched places are given; equal ones all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        types = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("cover", pa.float64())])))])
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                n, places, spans = scanner.scan(text.as_py())
                base = {scanner.labels[o] for o, _ in places}
                named = base | {scanner.labels[o] for o, *_ in spans}
                starts = [at for _, at in places]
                rows.append({
                    "doc_id": doc_id.as_py(), "n_words": n, "n_base": len(places), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                    "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(named)), "score": 1.0 if places else max((c for *_, c in spans), default=0.0),
                    "spans": [{"label": scanner.labels[o], "first_word": a, "last_word": z, "cover": c} for o, a, z, c in spans],
                })
            yield pa.RecordBatch.from_pylist(rows, schema=types)

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, RESULT)
