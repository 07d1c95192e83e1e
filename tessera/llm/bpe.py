"""Byte-level BPE: encoding by a local rank file with the tiktoken library, and decoding to bytes.

Long texts are cut at safe boundaries before the library's regular expression sees
them. A boundary is safe where no match of the split pattern can cross it:

* before a run of white space that follows other characters (no alternative of the
  pattern takes white space after something else), and
* before the last character of such a run, if something follows the run (the
  pattern leaves that character to the next match).

The second kind isolates long runs of white space, on which the library's look-ahead
otherwise overflows its stack.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from tessera.llm.common import bounded_batches

#: Texts up to this many characters without a long run of white space are encoded at once.
DIRECT_CHARS = 16_384
LONG_RUN = 1_024
#: Rust's \s is the Unicode property, Python's has four control characters more.
_CUTS = regex.compile(r"(?<=[\p{L}\p{N}])(?=[ \n])")
_LONG_RUNS = regex.compile(r"\p{White_Space}{%d,}+" % LONG_RUN)

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@functools.lru_cache(maxsize=4)
def encoder(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(rank_file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def segments(text: str, size: int = DIRECT_CHARS) -> Iterator[tuple[str, bool]]:
    """Pieces of ``text`` in order, cut at safe boundaries only, of about ``size`` characters, and whether
    a piece is a long run of white space: one match of the pattern, so it needs no regular expression."""
    at = 0
    for run in _LONG_RUNS.finditer(text) if len(text) >= LONG_RUN else ():
        yield from ((x, False) for x in _short(text[at : run.start()], size))
        last = run.end() if run.end() == len(text) else run.end() - 1
        yield text[run.start() : last], True
        at = last
    yield from ((x, False) for x in _short(text[at:], size))


def _short(text: str, size: int) -> Iterator[str]:
    at = 0
    while len(text) - at > size:
        cut = _CUTS.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    if at < len(text):
        yield text[at:]


def encode(enc: tiktoken.Encoding, text: str) -> list[int]:
    """The library's ``encode_ordinary`` for texts of any length."""
    if len(text) < LONG_RUN:
        return enc.encode_ordinary(text)
    return [i for part, run in segments(text) for i in (enc._encode_single_piece(part) if run else enc.encode_ordinary(part))]


def token_ids(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every row; a null text has no ids. Repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file, pattern)
        for b in batches:
            ids = [encode(enc, t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Encodes every text, decodes the ids to bytes and returns digests of both.

    Null texts count as empty; rows with a null id and repeated rows are kept as they
    are; columns other than doc_id and text are ignored. An empty table gives an empty
    result. No shuffle: each row is encoded where it is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file, pattern)
        for b in batches:
            counts, coded, decoded = [], [], []
            for text in b.column(1):
                ids = encode(enc, text.as_py() or "")
                counts.append(len(ids))
                coded.append(hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, RESULT)
