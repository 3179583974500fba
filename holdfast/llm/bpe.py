"""Byte-level BPE: encoding with the ranks of a tiktoken file, and decoding.

Pre-tokenisation is vectorised. A table gives the class of every code point; together with a look
at the next characters (end of a white space run, letters of a contraction) each character becomes
one of a few symbols, and a symbol is a function on the states of a small automaton. Functions
compose associatively: blocks of characters are composed side by side, the block functions
chained, and the states replayed inside the blocks; a match starts wherever the transition says
so. No regular expression runs over the text. Equal slices are found by hash, verified by the
round trip, and go through pair merging once; merged slices stay in a bounded cache. Ids keep
the byte offsets where they begin; decoding gathers the bytes of the ids.

The pattern is the one of the public byte-level vocabularies: contractions, then letters,
digits or other characters with one space before, then white space. Special tokens are text.

Null text counts as empty and gives no ids. Bytes that are not UTF-8 count as U+FFFD. An empty table
gives no rows; repeated rows are encoded each; clashing columns of the table are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import Piece, RangeHash, column, pieces, plus, ragged

CACHE_SLICES = 100_000
BLOCK = 96

# Symbols: letter, digit, other, apostrophe of a contraction of one or two letters, last white space
# before other text (a space, or not a space), white space before white space or the end.
L, N, O, A1, A2, S, V, R = range(8)
FIRST = 8  # added for the first character of a row
IDENTITY = 16
# States: what the running match is.
START, LETTERS, DIGITS, OTHERS, SPACE, WHITE, ONE_LEFT, TWO_LEFT, CLOSED = range(9)
STATES = 9

# The code points with the property White_Space.
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and start flag by symbol * STATES + state."""
    runs = {L: LETTERS, N: DIGITS, O: OTHERS}
    step = np.zeros((IDENTITY + 1, STATES), np.uint8)
    begins = np.zeros((IDENTITY + 1, STATES), bool)
    for symbol in range(8):
        for state in range(STATES):
            if symbol in runs:
                to, opens = runs[symbol], state not in (runs[symbol], SPACE)
                if symbol == L and state in (ONE_LEFT, TWO_LEFT):
                    to, opens = (CLOSED if state == ONE_LEFT else ONE_LEFT), False
            elif symbol in (A1, A2):
                inside = state in (OTHERS, SPACE)
                to, opens = (OTHERS if inside else ONE_LEFT if symbol == A1 else TWO_LEFT), not inside
            elif symbol == R:
                to, opens = WHITE, state != WHITE
            else:
                to, opens = (SPACE if symbol == S else CLOSED), True
            step[symbol, state], begins[symbol, state] = to, opens
    for symbol in range(8):
        step[symbol + FIRST, :] = step[symbol, START]
        begins[symbol + FIRST, :] = True
    step[IDENTITY] = np.arange(STATES)
    return step, begins


STEP, BEGINS = _automaton()
_STEP, _BEGINS = STEP.ravel(), BEGINS.ravel()
_SYMBOLS = IDENTITY + 1
# Three symbols at a time: their composed function, by the number (a * 17 + b) * 17 + c.
_TRIPLE = np.zeros((_SYMBOLS**3, STATES), np.uint8)
for _a in range(_SYMBOLS):
    for _b in range(_SYMBOLS):
        _ab = STEP[_b][STEP[_a]]
        _TRIPLE[(_a * _SYMBOLS + _b) * _SYMBOLS : (_a * _SYMBOLS + _b + 1) * _SYMBOLS] = STEP[:, _ab]
_TRIPLE = _TRIPLE.ravel()

_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """L, N, O or S (white space) for every code point."""
    if not _classes:
        kinds = {"L": L, "N": N}
        table = np.fromiter(
            (kinds.get(unicodedata.category(chr(c))[0], O) for c in range(0x110000)), np.uint8, 0x110000
        )
        table[list(WHITE_SPACE)] = S
        _classes.append(table)
    return _classes[0]


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbol of each code point; ``first`` holds the positions where rows begin."""
    kind = _class_table()[points]
    n = len(points)
    last = np.zeros(n, bool)  # last character of its row
    last[first[1:] - 1] = True
    last[-1:] = True
    after = np.zeros(n, np.uint32)
    after[:-1] = points[1:]
    after[last] = 0
    after2 = np.zeros(n, np.uint32)
    after2[:-1] = after[1:]
    after2[last] = 0

    white = kind == S
    before_white = np.ones(n, bool)
    before_white[:-1] = white[1:]
    before_white |= last
    out = kind.copy()
    out[white] = np.where(before_white[white], R, np.where(points[white] == 0x20, S, V))

    mark = np.flatnonzero(points == ord("'"))
    if len(mark):
        x, y = after[mark], after2[mark]
        one = np.isin(x, [ord(c) for c in "stmd"])
        two = ((np.isin(x, [ord("r"), ord("v")])) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
        out[mark[one]] = A1
        out[mark[two]] = A2
    out[first] += FIRST
    return out


def match_starts(symbol: np.ndarray) -> np.ndarray:
    """Positions where a match begins: an associative scan over transition functions."""
    n = len(symbol)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, IDENTITY, np.uint8)
    padded[:n] = symbol
    grid = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)  # position in block x block
    wide = grid.astype(np.int32)
    triples = ((wide[0::3] * _SYMBOLS + wide[1::3]) * _SYMBOLS + wide[2::3]) * STATES
    functions = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], blocks, axis=1)
    for row in triples:
        functions = _TRIPLE[row[None, :] + functions]
    # Chain the block functions.
    by_block = functions.T.tolist()
    enter, state = np.empty(blocks, np.uint8), START
    for b, f in enumerate(by_block):
        enter[b] = state
        state = f[state]
    # Replay inside the blocks.
    begins = np.empty((BLOCK, blocks), bool)
    states = enter
    for k in range(BLOCK):
        at = wide[k] * STATES + states
        begins[k] = _BEGINS[at]
        states = _STEP[at]
    return np.flatnonzero(np.ascontiguousarray(begins.T).ravel()[:n])


def pretokens(piece: Piece) -> np.ndarray:
    """Byte offsets where the matches of all rows of a piece begin."""
    data = piece.data
    if len(data) == 0:
        return np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    filled = piece.offsets[:-1][piece.lengths > 0]
    first = np.searchsorted(at, filled)
    return at[match_starts(symbols(points, first))]


class Vocabulary:
    """Ranks of a tiktoken file with pair merging, a cache of merged slices, and decoding tables."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        size = max(self.ranks.values()) + 1
        known = [b""] * size
        for token, rank in self.ranks.items():
            known[rank] = token
        self.bytes_len = np.array([len(t) for t in known], np.int64)
        self.bytes_at = np.cumsum(self.bytes_len) - self.bytes_len
        self.bytes_flat = np.frombuffer(b"".join(known), np.uint8)
        digits = [b" %d" % i for i in range(size)]
        self.digits_len = np.array([len(d) for d in digits], np.int64)
        self.digits_at = np.cumsum(self.digits_len) - self.digits_len
        self.digits_flat = np.frombuffer(b"".join(digits), np.uint8)
        self.cache: dict[bytes, bytes] = {}  # slice -> its ids as 32-bit integers

    def merge(self, slice_: bytes) -> list[int]:
        """Merges adjacent parts, lowest rank first, leftmost first among equals."""
        ranks = self.ranks
        whole = ranks.get(slice_)
        if whole is not None:
            return [whole]
        parts = [slice_[i : i + 1] for i in range(len(slice_))]
        none = len(ranks) + 1
        pair = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while pair:
            best = min(pair)
            if best == none:
                break
            i = pair.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def merged(self, slices: list[bytes]) -> list[bytes]:
        """Packed ids of every slice; what is not in the cache is merged and put there."""
        found = list(map(self.cache.get, slices))
        for i in [i for i, ids in enumerate(found) if ids is None]:
            slice_ = slices[i]
            ids = self.merge(slice_) if len(slice_) < 1024 else self.merge_long(slice_)
            found[i] = array("i", ids).tobytes()
            if len(slice_) < 256:
                if len(self.cache) >= CACHE_SLICES:
                    self.cache.clear()
                self.cache[slice_] = found[i]
        return found

    def merge_long(self, slice_: bytes) -> list[int]:
        """As ``merge``, with a heap and links, for slices where the plain form would be quadratic."""
        import heapq

        ranks = self.ranks
        end = len(slice_)
        right = list(range(1, end + 1))  # end of the part that starts here, 0 if none does
        left = list(range(-1, end - 1))  # start of the part before
        heap = [(r, i, i + 2) for i in range(end - 1) if (r := ranks.get(slice_[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = right[i]
            if not middle or middle >= end or right[middle] != stop:
                continue
            right[i], right[middle] = stop, 0
            if stop < end:
                left[stop] = i
                r = ranks.get(slice_[i : right[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, i, right[stop]))
            if left[i] >= 0:
                r = ranks.get(slice_[left[i] : stop])
                if r is not None:
                    heapq.heappush(heap, (r, left[i], stop))
        out, i = [], 0
        while i < end:
            out.append(ranks[slice_[i : right[i]]])
            i = right[i]
        return out

    def encode(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a piece, and where each row's ids begin (one entry more than rows)."""
        starts = pretokens(piece)
        if len(starts) == 0:
            return np.zeros(0, np.int64), np.zeros(piece.rows + 1, np.int64)
        ends = np.append(starts[1:], len(piece.data))
        codes, _ = pd.factorize(RangeHash(piece.data)(starts, ends))
        ids, upto = self._expand(piece, starts, ends, codes)
        if not np.array_equal(self.decode(ids), piece.data):  # two slices with one hash
            ids, upto = self._expand(piece, starts, ends, np.arange(len(starts)))
        return ids, upto[np.searchsorted(starts, piece.offsets)]

    def _expand(self, piece, starts, ends, codes) -> tuple[np.ndarray, np.ndarray]:
        first = np.empty(int(codes.max()) + 1, np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        raw = piece.data.tobytes()
        packed = self.merged([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        flat = np.frombuffer(b"".join(packed), np.int32)
        at = np.cumsum(sizes) - sizes
        counts = sizes[codes]
        return flat[ragged(at[codes], counts)], np.concatenate([[0], np.cumsum(counts)])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids, end to end."""
        return self.bytes_flat[ragged(self.bytes_at[ids], self.bytes_len[ids])]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each id and, last, of the end."""
        return np.concatenate([[0], np.cumsum(self.bytes_len[ids])])

    def digits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """' 12 7 301': a space and the decimal number for each id, and where each begins."""
        sizes = self.digits_len[ids]
        return self.digits_flat[ragged(self.digits_at[ids], sizes)], np.concatenate([[0], np.cumsum(sizes)])


_open: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The file's vocabulary, read once per worker."""
    if path not in _open:
        _open[path] = Vocabulary(path)
    return _open[path]


def valid_pieces(texts: pa.Array) -> Iterator[Piece]:
    """Pieces of a text column; rows that are not UTF-8 get U+FFFD where they are not."""
    for piece in pieces(texts):
        try:
            piece.data.tobytes().decode("utf-8")
        except UnicodeDecodeError:
            rows = [piece.row(i).decode("utf-8", "replace").encode() for i in range(piece.rows)]
            bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            piece = Piece(piece.first, np.frombuffer(b"".join(rows), np.uint8), bounds)
        yield piece


def _encoder(path: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for piece in valid_pieces(column(batch, text_col)):
                ids, bounds = words.encode(piece)
                begin = words.offsets(ids)[:-1] - np.repeat(piece.offsets[:-1], np.diff(bounds))
                cuts = pa.array(bounds, pa.int32())
                rows = batch.slice(piece.first, piece.rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        *rows.columns,
                        pa.ListArray.from_arrays(cuts, pa.array(ids, pa.int32())),
                        pa.ListArray.from_arrays(cuts, pa.array(begin, pa.int32())),
                    ],
                    names=[*rows.schema.names, "token_ids", "token_offsets"],
                )

    return run


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with token_ids and token_offsets (the byte where each token begins)."""
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c not in ("token_ids", "token_offsets")])
    schema = plus(kept.schema, ("token_ids", "array<int>"), ("token_offsets", "array<int>"))
    return kept.mapInArrow(_encoder(path, text_col), schema)


def _decoder(path: str, ids_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            lists = column(batch, ids_col)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(counts)])
            at = words.offsets(ids)[upto]
            raw = words.decode(ids).tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"]
            )

    return run


def decode(tokens: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """``tokens`` with the text of each row's ids as ``decoded``; null ids give empty text."""
    kept = tokens.select(*[f"`{c}`" for c in tokens.columns if c != "decoded"])
    return kept.mapInArrow(_decoder(path, ids_col), plus(kept.schema, ("decoded", "string")))


def _checked_encoder(path: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for piece in valid_pieces(column(batch, text_col)):
                ids, bounds = words.encode(piece)
                decoded, at = words.decode(ids).tobytes(), words.offsets(ids)[bounds].tolist()
                same = [decoded[a:b] == piece.row(i) for i, (a, b) in enumerate(zip(at[:-1], at[1:]))]
                rows = batch.slice(piece.first, piece.rows)
                kept = [n for n in rows.schema.names if n != text_col]
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*[column(rows, n) for n in kept], lists, pa.array(same, pa.bool_())],
                    names=[*kept, "token_ids", "round_trip"],
                )

    return run


def encode_checked(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with token_ids and round_trip (the ids decode to the text) in place of the text."""
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c not in ("token_ids", "round_trip")])
    schema = plus(kept.drop(text_col).schema, ("token_ids", "array<int>"), ("round_trip", "boolean"))
    return kept.mapInArrow(_checked_encoder(path, text_col), schema)


_DIGESTS = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def _digester(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for piece in valid_pieces(column(batch, "text")):
                ids, bounds = words.encode(piece)
                at = words.offsets(ids)[bounds].tolist()
                decoded = memoryview(words.decode(ids))
                numbers, where = words.digits(ids)
                numbers, where = memoryview(numbers), where[bounds].tolist()
                id_hash = [
                    hashlib.sha256(numbers[a + 1 : b] if b > a else b"").hexdigest()
                    for a, b in zip(where[:-1], where[1:])
                ]
                text_hash = [hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])]
                doc_ids = column(batch, "doc_id").slice(piece.first, piece.rows)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.cast(pa.int64()), pa.array(np.diff(bounds)), pa.array(id_hash), pa.array(text_hash)],
                    schema=_DIGESTS,
                )

    return run


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids in decimal and of the bytes decoded from them."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(
        _digester(path), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
