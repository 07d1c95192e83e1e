"""Toxicity: a support vector machine on a gapped subsequence string kernel with Nyström landmarks.

A text is cut into sentences of words: at ``.``, ``!`` or ``?`` behind a word of two bytes or
more and before a space. A mark inside a word may hide the word (``id-i.ot``) or end a
sentence without a space (``loser.You``); such a word is read both ways. A word is
lower-cased, characters that serve to hide it are taken out, and runs of single letters
are put together (``i d i o t``). Units are runs of 1, 2 and 4 words of one sentence from any
place, and the whole sentence. The kernel of two units is the inner product of their gapped
subsequences of three and four bytes, which also run over the marks between words, each
weighted by ``GAP`` for every byte it skips, over the product of the units' norms; skips are
bounded, so a unit has a short explicit list of subsequences. A letter put in or left out
breaks those that span more than it allows and leaves the others with lower weight; words of sure evidence are
therefore learned with such forms too (``misspelled``), which teaches the machine forms it never saw. The norm is that of distinct subsequences up to ``NORM_BYTES``
bytes and grows with the length beyond, so that repeated words don't add up.

Labels belong to documents, so each labelled document is a bag of the units of its
sentences: in a document that isn't toxic none is toxic; in a toxic one some unit is.
Units may be positive that stand in ``LIFT`` times as large a share of the toxic documents
as of the others, so a clean document that quotes an insult doesn't bar it; near copies count as one document, and
evidence counts beyond what the best of so many units has by chance. The machine is
trained in rounds; each takes the best units of each toxic document as positive and adds
the worst errors among the units of a part of the others; all parts have their turn. The landmarks' weights give one weight for
each subsequence, by which the units of any text are scored exactly as by the kernel
expansion. A document's score is the probability that some unit of it is toxic, over its
distinct units of high value that don't overlap (a noisy or, fitted to the documents' labels).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

from tessera.llm import words as W
from tessera.llm.common import bounded_batches
from tessera.llm.quality import labelled

#: The machine learns from this many labelled documents at most, those with the smallest hash of their id,
#: and only from texts of at most so many bytes, which bounds what the driver gets. All texts are scored whole.
TRAINING_DOCUMENTS = 4_096
TRAINING_BYTES = 8_192
LANDMARKS = 384
BITS = 20
GAP = 0.65
#: Offsets of the bytes of a subsequence from its first byte.
OFFSETS = [o for k, most in ((2, 4), (3, 4)) for o in itertools.combinations(range(1, most + 1), k)]
#: Bytes that part words, and bytes that are taken out of words.
PARTS = bytes(range(33)) + b'|/,;:()[]{}<>"\x7f'
HIDES = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in PARTS)

_CLASSES = W.word_table(PARTS)
_KEPT = np.ones(256, bool)
_KEPT[list(HIDES)] = False
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_BEGIN, _END = 1, 2
#: Byte that parts two sentences (one of PARTS).
_STOP = 0x1E
#: Bytes of text that are taken apart at a time: the arrays stay in the processor's cache.
PART_BYTES = 1 << 16
#: Words of the runs that are units, beside whole sentences.
RUNS = (1, 2, 4)
#: Up to this length a unit's norm is that of distinct subsequences.
NORM_BYTES = 24
#: A unit may be positive if its share of the toxic documents is this many times its share of the others.
LIFT = 4
#: Log-likelihood ratio, beyond the one that the best of so many units reaches by chance (2 ln of their number), from which
#: a unit of such a share and of positive value is positive beside its document's best.
SURE = 6.0
#: The same from which the unit of most evidence of a toxic document is positive.
LIKELY = -6.0
#: Units of a toxic document that are positive at first.
FIRST_UNITS = 3
#: Units of this value and more, in which -1 and 1 are the machine's margins, count in a document's probability.
COUNTS_FROM = 0.0
#: Units of clean documents that are negative from the start, and those that each round adds.
NEGATIVES, ERRORS = 6_000, 2_000

#: Single words of so many bytes and more are learned with an inserted or a missing letter too: so many forms of each, which weigh together as much as VIRTUAL_WEIGHT of the word.
VIRTUAL_BYTES, VIRTUAL_FORMS, VIRTUAL_WEIGHT = 5, 24, 0.5
#: Log-odds that a unit on the machine's positive margin has at least: it alone makes a text toxic.
MARGIN_ODDS = 0.9

RESULT = "doc_id long, score double"


def _without(raw: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if keep.all():
        return raw, at
    return raw[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def unhidden(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, row offsets, and word places of texts without hiding characters and with spelled-out words put together.
    The byte that parts words behind the end of a sentence becomes _STOP."""
    keep = _KEPT[raw]
    marks = np.flatnonzero((raw == 0x2E) | (raw == 0x21) | (raw == 0x3F))
    row = np.searchsorted(at, marks, "right") - 1
    behind = np.cumsum(keep)[marks]  # place of the next kept byte
    raw, at = _without(raw, at, keep)
    good = (behind < at[row + 1]) & (behind >= at[row] + 2)
    behind = behind[good]
    behind = behind[(_CLASSES[raw[behind]] == 0) & (_CLASSES[raw[behind - 1]] != 0) & (_CLASSES[raw[behind - 2]] != 0)]
    raw = raw.copy()
    raw[behind] = _STOP
    start, end, first = W.places(raw, at, _CLASSES)
    if len(start) > 2:
        pair = (end[:-1] - start[:-1] == 1) & (end[1:] - start[1:] == 1) & (start[1:] - end[:-1] == 1)
        cut = first[(first > 0) & (first < len(start))] - 1
        pair[cut] = False
        beside = np.zeros(len(pair), bool)
        beside[1:] |= pair[:-1]
        beside[:-1] |= pair[1:]
        pair &= beside
        if pair.any():
            keep = np.ones(len(raw), bool)
            keep[end[:-1][pair]] = False
            raw, at = _without(raw, at, keep)
            start, end, first = W.places(raw, at, _CLASSES)
    return raw, at, start, end, first


def flat_words(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes one after the other, each between marks of its begin and end; and their offsets."""
    size = end - start + 2
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], np.uint8)
    out[at[:-1]] = _BEGIN
    out[at[1:] - 1] = _END
    inner = np.ones(len(out), bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    out[inner] = raw[np.repeat(start - np.cumsum(size - 2) + size - 2, size - 2) + np.arange(int((size - 2).sum()))]
    return out, at


def subsequences(flat: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each offset list: the places in ``flat`` where it stays inside a word, the keys there and their weight."""
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(flat))  # bytes of the word from here
    wide = flat.astype(np.uint32)
    for offsets in OFFSETS:
        where = np.flatnonzero(left > offsets[-1])
        key = wide[where] * _FACTORS[0] + np.uint32(len(offsets))
        for o, factor in zip(offsets, _FACTORS[1:], strict=False):
            key = (key ^ (key >> np.uint32(15))) + wide[where + o] * factor
        key = (key ^ (key >> np.uint32(13))) * np.uint32(0x5BD1E995)
        yield where, (key >> np.uint32(32 - BITS)).astype(np.int32), GAP ** (offsets[-1] - len(offsets))


def _norms(sizes: np.ndarray) -> np.ndarray:
    """Norm of a unit, which depends on its length alone."""
    short = np.minimum(sizes, NORM_BYTES)
    return np.sqrt(np.maximum(sum(np.maximum(short - o[-1], 0) * GAP ** (2 * (o[-1] - len(o))) for o in OFFSETS), 1e-9)) * np.maximum(sizes / NORM_BYTES, 1.0)


def word_scores(flat: np.ndarray, at: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Decision value of each word, without the bias: its normalised subsequences times the table's weights."""
    total = np.zeros(len(flat) + 1)
    for where, keys, weight in subsequences(flat, at):
        total[where] += weight * table[keys]
    total = np.concatenate([[0.0], np.cumsum(total[:-1])])
    return (total[at[1:]] - total[at[:-1]]) / _norms(np.diff(at))


def sentence_ends(raw: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word the index of the word behind its sentence."""
    cut = np.zeros(len(start) + 1, bool)
    cut[0] = cut[-1] = True
    cut[first] = True
    stops = np.concatenate([[0], np.cumsum(raw == _STOP)])
    cut[1:-1] |= stops[start[1:]] != stops[end[:-1]]
    edges = np.flatnonzero(cut)
    return np.repeat(edges[1:], np.diff(edges))


def unit_places(last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """First word, and the word behind the last, of all units: by their number of words, then whole sentences of other sizes."""
    every = np.arange(len(last))
    for n in RUNS:
        first = every[every + n <= last]
        yield first, first + n
    begins = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]])) if len(last) else every
    begins = begins[~np.isin(last[begins] - begins, RUNS)]
    yield begins, last[begins]


def unit_scores(flat: np.ndarray, at: np.ndarray, last: np.ndarray, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """First word, word behind the last, and decision value without the bias of all units, as word_scores gives it."""
    edges = np.concatenate([[0], np.flatnonzero(np.concatenate([last[1:] != last[:-1], [True]])) + 1])
    totals = {o[-1]: np.zeros(len(flat) + 1) for o in OFFSETS}
    for offsets, (where, keys, weight) in zip(OFFSETS, subsequences(flat, at[edges]), strict=True):
        totals[offsets[-1]][where + 1] += weight * table[keys]
    for total in totals.values():
        np.cumsum(total, out=total)
    norms = _norms(np.arange(int(np.diff(at[edges]).max()) + 1))
    begins = sum(total[at[:-1]] for total in totals.values())
    ends = np.concatenate([[0.0], sum(total[at[1:] - reach] for reach, total in totals.items())])
    for first, behind in unit_places(last):
        value = ends[behind] - begins[first]
        tiny = np.flatnonzero(at[behind] - at[first] <= max(totals))  # no place for all subsequences
        a, z = at[first[tiny]], at[behind[tiny]]
        value[tiny] = sum(total[np.maximum(z - reach, a)] - total[a] for reach, total in totals.items())
        yield first, behind, value / norms[at[behind] - at[first]]


@dataclass(frozen=True)
class Machine:
    """``table``: a weight for each subsequence; a unit's value is its score plus ``bias``, its probability sigmoid(slope * value + offset)."""

    table: np.ndarray
    bias: float
    slope: float
    offset: float


#: What nothing was learned for: every text scores next to 0.
UNTRAINED = Machine(np.zeros(1 << BITS, np.float32), 0.0, 0.0, -30.0)


#: A word with a mark inside: it is kept as a sentence of its own, and its parts end and begin sentences.
_INNER = r"(\S*\pL{2})([.!?]+)(\pL{2}\S*)"


def read_both_ways(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, _INNER, "\\1\x1e\\1\\2\\3\x1e\\3")


@dataclass(frozen=True)
class Part:
    """Some documents: words' bytes and offsets, the word behind each word's sentence, and the row of each word."""

    flat: np.ndarray
    at: np.ndarray
    last: np.ndarray
    row: np.ndarray

    @staticmethod
    def of(raw: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, row: int) -> Part:
        return Part(*flat_words(raw, start, end), sentence_ends(raw, start, end, first), row + np.repeat(np.arange(len(first) - 1), np.diff(first)))

    def hashes(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """First word, word behind the last, and hash of all units."""
        words = W.word_hashes(self.flat, self.at[:-1] + 1, self.at[1:] - 1)
        for first, behind in unit_places(self.last):
            yield first, behind, unit_hashes(words, first, behind)

    def units(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, first word, word behind the last, and hash of the distinct units of each row."""
        first, behind, h = (np.concatenate(x) for x in zip(*self.hashes(), strict=True))
        order = np.lexsort((first, h, self.row[first]))
        first, behind, h = first[order], behind[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (self.row[first[1:]] != self.row[first[:-1]])
        return self.row[first[new]], first[new], behind[new], h[new]

    def values(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, word behind the last, and value without the bias of all units."""
        return tuple(np.concatenate(x) for x in zip(*unit_scores(self.flat, self.at, self.last, table), strict=True))

    def strings(self, first: np.ndarray, behind: np.ndarray) -> list[bytes]:
        data = self.flat.tobytes()
        return [data[a:z] for a, z in zip((self.at[first] + 1).tolist(), (self.at[behind] - 1).tolist(), strict=True)]


def unit_hashes(words: np.ndarray, first: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Hashes of units from their words' hashes: a polynomial by prefix sums modulo 2**64, moved to its first word, then mixed."""
    n, base = len(words) + 1, 0x9E3779B97F4A7C15
    power, back = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])) for x in (base, pow(base, -1, 1 << 64)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:-1])])
    found = (total[behind] - total[first]) * back[first]
    return (found ^ (found >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def apart(part: Part, first: np.ndarray, behind: np.ndarray, value: np.ndarray) -> Iterator[tuple[int, list[float]]]:
    """Row and values, the largest first, of units that neither overlap nor repeat and that count, or else of its best unit."""
    order = np.argsort(part.row[first], kind="stable")
    row = part.row[first][order]
    begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    best = np.maximum.reduceat(value[order], begins)
    out = {int(r): [float(v)] for r, v in zip(row[begins], best, strict=True)}
    keep = np.flatnonzero(value >= COUNTS_FROM)
    keep = keep[np.lexsort((first[keep], -value[keep], part.row[first[keep]]))]
    units = zip(part.row[first[keep]].tolist(), first[keep].tolist(), behind[keep].tolist(), value[keep].tolist(), part.strings(first[keep], behind[keep]), strict=True)
    for r, mine in itertools.groupby(units, lambda u: u[0]):
        seen, taken, out[r] = set(), set(), []
        for _, a, z, v, unit in mine:
            if unit not in seen and taken.isdisjoint(range(a, z)):
                taken.update(range(a, z))
                out[r].append(v)
            seen.add(unit)
    yield from out.items()


def log_clean(values: np.ndarray, slope: float, offset: float) -> np.ndarray:
    """Logarithm of the probability that a unit of the value isn't toxic."""
    return -np.logaddexp(0.0, slope * values + offset)


def probabilities(texts: pa.Array, m: Machine) -> np.ndarray:
    out = np.zeros(len(texts))
    for begin, _, raw, at in W.chunks(read_both_ways(pc.utf8_lower(texts)), PART_BYTES):
        raw, at, start, stop, words = unhidden(raw, at)
        if len(start):
            part = Part.of(raw, start, stop, words, begin)
            first, behind, value = part.values(m.table)
            for row, found in apart(part, first, behind, value + m.bias):
                out[row] = -np.expm1(log_clean(np.array(found), m.slope, m.offset).sum())
    return out


def bag(texts: pa.Array) -> list[list[bytes]]:
    """Distinct words of each row."""
    out: list[list[bytes]] = []
    for _, _, raw, at in W.chunks(pc.utf8_lower(texts)):
        raw, at, start, stop, words = unhidden(raw, at)
        data = raw.tobytes()
        out += [sorted({data[a:z] for a, z in zip(start[i:k], stop[i:k], strict=True)}) for i, k in itertools.pairwise(words)]
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str, learns: Column, limit: int = TRAINING_DOCUMENTS) -> Machine:
    """Trains on the driver from the sentences of at most ``limit`` labelled documents, of TRAINING_BYTES at most each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = []
            for _, _, raw, at in W.chunks(read_both_ways(pc.utf8_lower(b.column("text"))), PART_BYTES):
                raw, at, *_ = unhidden(raw, at)
                data = raw.tobytes()
                out += [data[i:k] for i, k in itertools.pairwise(at)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(out, pa.binary())], ["doc_id", "label", "bytes"])

    rows = labelled(docs, labels, label, learns, limit, TRAINING_BYTES).mapInArrow(W.lean(run), "doc_id long, label int, bytes binary").toArrow()
    order = np.lexsort((rows["label"].to_numpy(), rows["doc_id"].to_numpy()))
    read = rows["bytes"].to_pylist()
    found = train([read[i] for i in order], rows["label"].to_numpy()[order])
    del rows, read
    W.give_back()
    return found


def parts_of(docs: list[bytes], chosen: np.ndarray) -> Iterator[Part]:
    """The chosen documents in parts; a part's rows are their places in ``docs``."""
    k = 0
    while k < len(chosen):
        begin, n = k, 0
        while k < len(chosen) and (k == begin or n + len(docs[chosen[k]]) <= PART_BYTES * 4):
            n += len(docs[chosen[k]])
            k += 1
        mine = chosen[begin:k]
        raw, at = np.frombuffer(b"".join(docs[i] for i in mine), np.uint8), np.concatenate([[0], np.cumsum([len(docs[i]) for i in mine])])
        start, end, first = W.places(raw, at, _CLASSES)
        if len(start):
            part = Part.of(raw, start, end, first, 0)
            yield Part(part.flat, part.at, part.last, mine[part.row])


def _flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    return flat_words(raw, end - [len(w) for w in words], end)


class Kernel:
    """Kernel values against landmarks, by the landmarks' explicit subsequences."""

    def __init__(self, landmarks: list[bytes]):
        flat, at = _flat(landmarks)
        owner, norm = np.repeat(np.arange(len(landmarks)), np.diff(at)), _norms(np.diff(at))
        parts = [(keys, owner[where], np.full(len(keys), weight)) for where, keys, weight in subsequences(flat, at)]
        keys, owners, weights = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.keys, spot = np.unique(keys, return_inverse=True)
        self.spot = np.full(1 << BITS, len(self.keys), np.int32)
        self.spot[self.keys] = np.arange(len(self.keys))
        self.phi = np.zeros((len(self.keys) + 1, len(landmarks)), np.float32)
        np.add.at(self.phi, (spot, owners), weights / norm[owners])

    def __call__(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), self.phi.shape[1]), np.float32)
        k = 0
        while k < len(words):
            begin, n = k, 0
            while k < len(words) and k < begin + 256 and (k == begin or n + len(words[k]) <= 4_096):
                n += len(words[k])
                k += 1
            flat, at = _flat(words[begin:k])
            if n > 4_096:  # one long unit: its keys are counted first
                count = np.zeros(len(self.keys) + 1, np.float32)
                for _, keys, weight in subsequences(flat, at):
                    count += np.float32(weight) * np.bincount(self.spot[keys], minlength=len(count)).astype(np.float32)
                out[begin] = count @ self.phi / _norms(np.diff(at))
                continue
            total = np.zeros((len(flat), self.phi.shape[1]), np.float32)
            for where, keys, weight in subsequences(flat, at):
                spot = self.spot[keys]
                known = spot < len(self.keys)
                total[where[known]] += np.float32(weight) * self.phi[spot[known]]
            out[begin:k] = np.add.reduceat(total, at[:-1], 0) / _norms(np.diff(at))[:, None]
        return out

    def table(self, beta: np.ndarray) -> np.ndarray:
        """The expansion's weight for each subsequence."""
        out = np.zeros(1 << BITS, np.float32)
        out[self.keys] = self.phi[:-1] @ beta
        return out


def _squared_hinge(z: np.ndarray, y: np.ndarray, c: np.ndarray, ridge: float) -> np.ndarray:
    """Newton's method for a linear machine with squared hinge loss; the last column of z is the bias."""
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(20):
        active = y * (z @ w) < 1
        a, ca = z[active], c[active]
        new = np.linalg.solve(a.T @ (a * ca[:, None]) + np.diag(penalty), a.T @ (ca * y[active]))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


@dataclass(frozen=True)
class Evidence:
    """Hashes of the units of toxic documents in order; whether each may be positive, and by how much it tells (log-likelihood ratio beyond chance)."""

    known: np.ndarray
    may: np.ndarray
    ratio: np.ndarray

    def at(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """May be positive, and ratio, of units by their hashes."""
        spot = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        same = self.known[spot] == h
        return same & self.may[spot], np.where(same, self.ratio[spot], 0.0)

    def sure(self, word: bytes) -> bool:
        """A single word of sure evidence."""
        h = unit_hashes(W.word_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)])), np.array([0]), np.array([1]))
        may, ratio = self.at(h)
        return bool(may[0]) and ratio[0] >= SURE


def _units_of_texts(docs: list[bytes], chosen: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """Hashes of the units of the chosen documents (of the ``known`` ones), once for each text that isn't a near copy of another, and the number of such texts.

    Near copies mostly agree in the smallest hash of their units of several words, which stands for the text; chance words of one copied
    document would else look like evidence.
    """
    pairs, texts = [np.zeros((0, 2), np.uint64)], [np.zeros(0, np.uint64)]
    for part in parts_of(docs, chosen):
        row, first, behind, h = part.units()
        if not len(row):
            continue
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        text = np.minimum.reduceat(np.where(behind - first > 1, h, np.uint64((1 << 64) - 1)), begin)
        text = np.where(text == np.uint64((1 << 64) - 1), np.minimum.reduceat(h, begin), text)
        texts.append(text)
        mine = np.repeat(text, np.diff(np.append(begin, len(row))))
        if known is not None:
            keep = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
            h, mine = h[keep], mine[keep]
        pairs.append(np.stack([h, mine], 1))
    return np.unique(np.concatenate(pairs), axis=0)[:, 0], len(np.unique(np.concatenate(texts)))


def evidence(docs: list[bytes], toxic: np.ndarray, clean: np.ndarray) -> Evidence:
    units, all1 = _units_of_texts(docs, toxic)
    known, n1 = np.unique(units, return_counts=True)
    n0, all0 = np.zeros(len(known), np.int64), 0
    if len(known):
        units, all0 = _units_of_texts(docs, clean, known)
        n0 = np.bincount(np.searchsorted(known, units), minlength=len(known))
    expected = (n1 + n0) / max(all1 + all0, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * sum(np.where(n > 0, n * np.log(n / e), 0.0) for n, e in ((n1, expected * all1), (n0, expected * all0), (all1 - n1, (1 - expected) * all1), (all0 - n0, (1 - expected) * all0)))
    return Evidence(known, n1 * all0 > LIFT * n0 * all1, ratio - 2 * np.log(max(len(known), 1)))


def _positives(docs: list[bytes], toxic: np.ndarray, e: Evidence, table: np.ndarray | None = None, bias: float = 0.0, any_best: bool = False) -> dict[bytes, int]:
    """Units and the number of toxic documents that hold each. Of each document: the best that may be positive, by evidence at
    first and by value later, if it is likely or with ``any_best``; at first the next ones too, later all of sure evidence near it.
    Evidence alone doesn't make all units positive, as copies of a toxic document share theirs."""
    found: dict[bytes, int] = {}
    for part in parts_of(docs, toxic):
        row, first, behind, h = part.units()
        may, ratio = e.at(h)
        row, first, behind, ratio = row[may], first[may], behind[may], ratio[may]
        if not len(row):
            continue
        if table is None:
            value = ratio - 1e-3 * (behind - first)  # the shortest of equal ones
        else:
            i, k, v = part.values(table)
            spot = {(a, z): x for a, z, x in zip(i.tolist(), k.tolist(), v.tolist(), strict=True)}
            value = np.array([spot[a, z] for a, z in zip(first.tolist(), behind.tolist(), strict=True)]) + bias
        new = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        top = np.repeat(np.maximum.reduceat(value, new), np.diff(np.append(new, len(row))))
        likely = ratio >= LIKELY if table is None else value > 0
        take = (likely | any_best) & (value == top)
        if table is None:
            order = np.lexsort((first, -value, row))
            place = np.empty(len(row), np.int64)
            place[order] = np.arange(len(row)) - np.repeat(new, np.diff(np.append(new, len(row))))
            take |= likely & (place < FIRST_UNITS)
        else:
            take |= (ratio >= SURE) & (value > 0.25 + 0.5 * np.maximum(top, 0.0))
        for u in part.strings(first[take], behind[take]):
            found[u] = found.get(u, 0) + 1
    return found


def _worst(docs: list[bytes], clean: np.ndarray, e: Evidence, table: np.ndarray, most: int) -> list[bytes]:
    """Units of clean documents of the largest values, the largest first; those that may be positive aren't errors."""
    found: dict[bytes, float] = {}
    for part in parts_of(docs, clean):
        first, behind, value = part.values(table)
        h, one = np.unique(np.concatenate([x for *_, x in part.hashes()]), return_index=True)
        top = one[~e.at(h)[0]]
        top = top[np.argsort(-value[top], kind="stable")[: most // 4]]
        found.update(zip(part.strings(first[top], behind[top]), value[top].tolist(), strict=True))
        if len(found) > 4 * most:
            found = {u: found[u] for u in sorted(found, key=lambda u: (-found[u], u))[:most]}
    return sorted(found, key=lambda u: (-found[u], u))[:most]


def _sample(docs: list[bytes], clean: np.ndarray, e: Evidence, most: int) -> list[bytes]:
    """Units of clean documents: those of the smallest hashes among words, and among longer units."""
    kinds: tuple[dict[int, bytes], ...] = ({}, {})
    for part in parts_of(docs, clean):
        _, first, behind, h = part.units()
        free = ~e.at(h)[0]
        for kind, mine in zip(kinds, (free & (behind - first == 1), free & (behind - first > 1)), strict=True):
            where = np.flatnonzero(mine)
            where = where[np.argsort(h[where])[: most // 2]]
            kind.update(zip(h[where].tolist(), part.strings(first[where], behind[where]), strict=True))
            if len(kind) > 4 * most:
                for key in sorted(kind)[most // 2 :]:
                    del kind[key]
    return [kind[key] for kind in kinds for key in sorted(kind)[: most // 2]]


def misspelled(word: bytes) -> list[bytes]:
    """VIRTUAL_FORMS forms of a single word with one letter put in or left out behind its first letter, at places and with letters that a
    hash of the word begins; no form for short words and for units of several words."""
    if len(word) < VIRTUAL_BYTES or _END in word:
        return []
    letters = bytes(range(0x61, 0x7B))
    step, out = int(W.word_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0]) % 26, []
    for k in range(VIRTUAL_FORMS):
        place = 1 + k % (len(word) - 1)
        if k % 4 == 3:
            out.append(word[:place] + word[place + 1 :])
        else:
            letter = (step + 7 * k + place) % 26
            out.append(word[:place] + letters[letter : letter + 1] + word[place:])
    return sorted(set(out) - {word})


def train(docs: list[bytes], labels: np.ndarray, rounds: int = 4, ridge: float = 0.3) -> Machine:
    """``docs``: documents' bytes as ``unhidden`` leaves them."""
    labels = np.asarray(labels)
    toxic, clean = np.flatnonzero(labels != 0), np.flatnonzero(labels == 0)
    e = evidence(docs, toxic, clean)
    if not e.may.any() or not any(True for _ in parts_of(docs, clean)):
        return UNTRAINED
    positive = _positives(docs, toxic, e) or _positives(docs, toxic, e, any_best=True)
    negative = dict.fromkeys(_sample(docs, clean, e, NEGATIVES))
    errors = list(negative)[: NEGATIVES // 2 : 16] + list(negative)[NEGATIVES // 2 :: 16]
    table, bias = UNTRAINED.table, 0.0
    for turn in range(rounds):
        by_rank = sorted(positive, key=lambda u: (-positive[u], u))
        short = [u for u in by_rank if len(u) <= 2 * NORM_BYTES] or by_rank
        others = [u for u in errors if len(u) <= 2 * NORM_BYTES]
        virtual = {u: forms for u in by_rank if (forms := misspelled(u)) and e.sure(u)}
        spelt = [f for forms in itertools.zip_longest(*virtual.values()) for f in forms if f]
        landmarks = list(dict.fromkeys(short[: LANDMARKS // 4] + spelt[: LANDMARKS // 4] + others[: LANDMARKS // 2]))
        kernel = Kernel(landmarks)
        values, vectors = np.linalg.eigh(kernel(landmarks).astype(float))
        good = values > 1e-4 * values[-1]
        root = vectors[:, good] / np.sqrt(values[good])
        weights = {f: VIRTUAL_WEIGHT * positive[u] / len(forms) for u, forms in virtual.items() for f in forms} | positive
        pos, neg = sorted(weights), sorted(negative.keys() - weights.keys())
        z = np.hstack([kernel(pos + neg) @ root, np.ones((len(pos) + len(neg), 1))])
        weight = np.array([weights[u] for u in pos], float)
        c = np.concatenate([weight / weight.sum() * len(neg), np.ones(len(neg))]) * 0.5
        w = _squared_hinge(z, np.repeat([1.0, -1.0], [len(pos), len(neg)]), c, ridge)
        table, bias = kernel.table(root @ w[:-1]), float(w[-1])
        if turn + 1 < rounds:
            errors = _worst(docs, clean[turn :: rounds - 1], e, table, ERRORS)
            negative.update(dict.fromkeys(errors))
            positive = _positives(docs, toxic, e, table, bias) or positive
    found: list[list[float]] = [[] for _ in docs]
    for part in parts_of(docs, np.arange(len(docs))):
        first, behind, value = part.values(table)
        for row, mine in apart(part, first, behind, value + bias):
            found[row] = mine
    return Machine(table, bias, *_noisy_or(found, labels != 0))


def _noisy_or(values: list[list[float]], toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of units' probabilities that fit the documents' labels best, both classes with the root of their weights."""
    rows = np.repeat(np.arange(len(values)), [len(v) for v in values])
    flat = np.array([x for v in values for x in v])
    n = np.array([toxic.sum(), (~toxic).sum()], float)
    weight = np.where(toxic, np.sqrt(n.sum() / max(n[0], 1)), np.sqrt(n.sum() / max(n[1], 1)))
    eps = 1 / (len(values) + 2)

    def loss(slope: float, offset: float) -> float:
        clean = np.exp(np.bincount(rows, log_clean(flat, slope, offset), len(values)))
        p = eps + (1 - 2 * eps) * (1 - clean)
        return float(-(weight * np.where(toxic, np.log(p), np.log(1 - p))).sum())

    best = min((loss(a, b), a, b) for a in np.arange(1.0, 9.0) for b in np.arange(-9.0, 3.0) if a + b >= MARGIN_ODDS)
    for step in (0.5, 0.25, 0.12):
        near = [(best[1] + i * step, best[2] + k * step) for i in (-1, 0, 1) for k in (-1, 0, 1)]
        best = min((loss(a, b), a, b) for a, b in near if a + b >= MARGIN_ODDS)
    return float(best[1]), float(best[2])


def score(docs: DataFrame, m: Machine) -> DataFrame:
    """doc_id and score (0 to 1) of every row by its whole text; texts without words score 0.

    Rows with a null doc_id and repeated rows stay; a null text counts as empty; other
    columns are ignored. No shuffle; the broadcast table has 2**BITS weights whatever the input.
    """
    shared = bounded_batches(docs.sparkSession).sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(probabilities(b.column(1), shared.value), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(W.lean(run), RESULT)
