"""Secret scan: assignments, access keys, hex strings, and random strings by token efficiency.

Three kinds follow fixed patterns. A fourth, ``random``, is found without one: natural words
need few tokens of a public vocabulary, random strings need one for every character or two. Runs
of key characters with letters and digits whose characters per token fall below a limit are
reported, unless they are known digests, identifiers, or overlap a span of the fixed kinds.

Positions are code points, end exclusive. Null text counts as empty and has no spans; repeated rows
are scanned each; an empty table gives no rows; other columns are ignored. Long rows are scanned
whole, in time linear in their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm import bpe
from holdfast.llm.common import Piece, byte_set, code_points_before, column, pieces, runs

# The patterns of the base kinds and their least lengths.
ASSIGN = re.compile(
    rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I
)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
KINDS = ("assign", "access", "hex", "random")

MAX_RATIO = 2.0
RANDOM_LEAST = 20

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HEX = byte_set(_DIGITS + "abcdef")
_KEY = byte_set(_DIGITS + _LOWER + _UPPER + "+/_=-")
# What is not a secret although it looks random: digests of the usual widths, UUIDs, ids made of words.
_DIGEST = re.compile(rb"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
_UUID = re.compile(rb"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_WORDY = re.compile(rb"(?:[A-Za-z]{3,}|[0-9]+)(?:[_/=-]+(?:[A-Za-z]{3,}|[0-9]+))*")
_LETTER, _DIGIT = re.compile(rb"[A-Za-z]"), re.compile(rb"[0-9]")

Span = tuple[int, int, int]  # row, start, end: bytes of a piece


def _find_all(raw: bytes, word: bytes) -> Iterator[int]:
    at = raw.find(word)
    while at >= 0:
        yield at
        at = raw.find(word, at + 1)


def _row_of(piece: Piece, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(piece.offsets, at, side="right") - 1


def base_spans(piece: Piece) -> dict[str, list[Span]]:
    """Spans of the fixed kinds, leftmost and without overlap within a kind."""
    raw = piece.data.tobytes()
    lowered = raw.lower()
    out: dict[str, list[Span]] = {k: [] for k in KINDS[:3]}

    hits = np.array([at for word in ASSIGN_WORDS for at in _find_all(lowered, word)], np.int64)
    for row in np.unique(_row_of(piece, hits)).tolist():
        base, end = int(piece.offsets[row]), int(piece.offsets[row + 1])
        for m in ASSIGN.finditer(raw, base, end):
            if m.end(1) - m.start(1) >= ASSIGN_LEAST:
                out["assign"].append((row, m.start(), m.end()))
    hits = np.fromiter(_find_all(raw, b"AKIA"), np.int64)
    for row in np.unique(_row_of(piece, hits)).tolist():
        for m in ACCESS.finditer(raw, int(piece.offsets[row]), int(piece.offsets[row + 1])):
            if m.end() - m.start() >= ACCESS_LEAST:
                out["access"].append((row, m.start(), m.end()))
    starts, ends = runs(_HEX[piece.data], piece.offsets)
    wide = ends - starts >= HEX_LEAST
    starts, ends = starts[wide], ends[wide]
    out["hex"] = list(zip(_row_of(piece, starts).tolist(), starts.tolist(), ends.tolist()))
    return out


def is_identifier(text: bytes) -> bool:
    """Digests, UUIDs, plain numbers and names joined from words or numbers."""
    return bool(
        _DIGEST.fullmatch(text) or _UUID.fullmatch(text) or _WORDY.fullmatch(text)
        or not _DIGIT.search(text) or not _LETTER.search(text)
    )


def random_spans(
    piece: Piece, base: dict[str, list[Span]], words: bpe.Vocabulary, max_ratio: float = MAX_RATIO
) -> list[Span]:
    """Runs of key characters that need many tokens."""
    starts, ends = runs(_KEY[piece.data], piece.offsets)
    wide = ends - starts >= RANDOM_LEAST
    starts, ends = starts[wide], ends[wide]
    if len(starts) == 0:
        return []
    taken = np.zeros(len(piece.data) + 1, np.int64)
    for spans in base.values():
        for _, a, b in spans:
            taken[a] += 1
            taken[b] -= 1
    covered = np.concatenate([[0], np.cumsum(np.cumsum(taken[:-1]) > 0)])
    free = covered[ends] == covered[starts]
    raw = piece.data.tobytes()
    found = [
        (a, b) for a, b in zip(starts[free].tolist(), ends[free].tolist()) if not is_identifier(raw[a:b])
    ]
    if not found:
        return []
    texts = [raw[a:b] for a, b in found]
    sizes = np.array([len(t) for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    _, at = words.encode(Piece(0, np.frombuffer(b"".join(texts), np.uint8), bounds))
    low = sizes < max_ratio * np.diff(at)
    a = np.array([x for x, _ in found], np.int64)[low]
    b = np.array([y for _, y in found], np.int64)[low]
    return list(zip(_row_of(piece, a).tolist(), a.tolist(), b.tolist()))


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
        ("n_random", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()),
    ]
)


def _scanner(path: str, max_ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bpe.vocabulary(path)
        for batch in batches:
            for piece in pieces(column(batch, "text")):
                spans = base_spans(piece)
                spans["random"] = random_spans(piece, spans, words, max_ratio)
                before = code_points_before(piece)
                rows: list[list[tuple[int, int, int]]] = [[] for _ in range(piece.rows)]
                for order, kind in enumerate(KINDS):
                    for row, a, b in spans[kind]:
                        zero = before[piece.offsets[row]]
                        rows[row].append((int(before[a] - zero), order, int(before[b] - zero)))
                out = []
                for found in rows:
                    found.sort()
                    text = [f"{KINDS[k]}:{a}:{b}" for a, k, b in found]
                    base = ",".join(t for t, (_, k, _) in zip(text, found) if k < 3)
                    n = [sum(k == kind for _, k, _ in found) for kind in range(4)]
                    out.append((*n, hashlib.sha256(base.encode()).hexdigest(), ",".join(text)))
                ids = column(batch, "doc_id").slice(piece.first, piece.rows).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, *[pa.array(c, f.type) for c, f in zip(zip(*out), list(_OUT)[1:])]], schema=_OUT
                )

    return run


def scan(docs: DataFrame, path: str, max_ratio: float = MAX_RATIO) -> DataFrame:
    """doc_id, a count per kind, the digest of the base spans, and all spans, for every document."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(
        _scanner(path, max_ratio),
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, "
        "base_sha256 string, spans string",
    )
