"""Personal data: fixed patterns as seeds, and bootstrapped contextual extraction.

E-mail addresses, IPv4 addresses, card and phone numbers are found by fixed patterns. These seeds
induce lexical patterns: the words around them and their shape. Patterns and the identifier-like
strings they surround form a bipartite graph that Spark scores in rounds: a pattern is as good as
the share of its instances believed to be of the kind, an instance is believed as far as its
patterns are good. Patterns of high confidence then mark strings that no fixed pattern knows,
as kind ``context``.

All counts are over distinct instances of the whole table, aggregated before they are shuffled; tables of
each round are written to the shared folder. Positions are code points, end exclusive.

Null text counts as empty; repeated rows are searched each; an empty table gives no rows; other
columns are ignored. Rows are read whole, in time linear in their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import (
    Piece,
    byte_set,
    code_points_before,
    column,
    pieces,
    plus,
    possibly_met,
    shielded,
    stage,
    words,
)

KINDS = ("email", "ip", "card", "phone")
FOUND = "context"
ROUNDS = 3
MIN_SEEDS = 5
MIN_CONFIDENCE = 0.9

# The patterns of the kinds. The look-behind only spares starts inside a run of digits,
# where a match fails if it failed at the start of the run.
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(rb"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")

_ALNUM = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOCAL = byte_set(_ALNUM + "._%+-")
_DIGIT = byte_set("0123456789")
_NOT_DIGIT = re.compile(rb"[^0-9]+")
_EDGES = b".,;:!?()[]{}<>\"'|*#&%$"

Span = tuple[int, int, int]  # row, start, end: bytes of a piece


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = d - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def emails(raw: bytes, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Leftmost addresses: each starts with the run of local characters before an at sign."""
    last = start
    at = raw.find(b"@", start, end)
    while at >= 0:
        left = at
        while left > last and _LOCAL[raw[left - 1]]:
            left -= 1
        m = DOMAIN.match(raw, at + 1, end) if left < at else None
        if m:
            yield left, m.end()
            last = m.end()
        else:
            last = at + 1  # the sign itself ends any run of local characters
        at = raw.find(b"@", max(last, at + 1), end)


def row_spans(raw: bytes, start: int, end: int, has_digits: bool) -> list[tuple[int, int, int]]:
    """kind number, start, end of every seed in a row."""
    out = [(0, a, b) for a, b in emails(raw, start, end)]
    if not has_digits:
        return out
    for m in IP.finditer(raw[start:end]):  # a row of its own: the look-behind must not see the row before
        parts = (p.lstrip(b"0") for p in m.group().split(b"."))
        if all(len(p) <= 3 and int(p or b"0") <= 255 for p in parts):
            out.append((1, start + m.start(), start + m.end()))
    for m in CARD.finditer(raw, start, end):
        if m.end() - m.start() <= 37:
            digits = _NOT_DIGIT.sub(b"", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(raw, start, end):
        if 9 <= len(_NOT_DIGIT.sub(b"", m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def seeds(piece: Piece) -> list[list[tuple[int, int, int]]]:
    """Seeds of each row of a piece."""
    raw = piece.data.tobytes()
    digits = np.concatenate([[0], np.cumsum(_DIGIT[piece.data])])
    some = np.diff(digits[piece.offsets]) > 0
    signs = np.concatenate([[0], np.cumsum(piece.data == ord("@"))])
    some_sign = np.diff(signs[piece.offsets]) > 0
    bounds = piece.offsets.tolist()
    return [
        row_spans(raw, bounds[i], bounds[i + 1], bool(some[i])) if some[i] or some_sign[i] else []
        for i in range(piece.rows)
    ]


def shape(text: bytes) -> str:
    """Lengths of runs of letters and digits, other characters as they are: ``a3 9x16``."""
    parts = re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff]", text[:64])
    return "".join(
        f"a{len(p)}" if p[:1].isalpha() or p[0] >= 0x80 else f"9x{len(p)}" if p.isdigit() else p.decode("ascii")
        for p in parts
    )


def _plain(word: bytes) -> str:
    return word.strip(_EDGES).lower().decode("utf-8", "replace")[:40]


def candidates(piece: Piece, found: list[list[tuple[int, int, int]]]) -> list[list[tuple]]:
    """Seeds and identifier-like words of each row: start, end, kind or -1, instance, patterns.

    Identifier-like is a word with four digits or more, or an at sign, outside the seeds.
    """
    w = words(piece)
    raw = piece.data.tobytes()
    digits = np.concatenate([[0], np.cumsum(_DIGIT[piece.data])])
    signs = np.concatenate([[0], np.cumsum(piece.data == ord("@"))])
    like = (digits[w.ends] - digits[w.starts] >= 4) | (signs[w.ends] > signs[w.starts])
    out: list[list[tuple]] = []
    for row in range(piece.rows):
        lo, hi = int(w.bounds[row]), int(w.bounds[row + 1])
        spans = sorted((a, b, k) for k, a, b in found[row])
        items = [(a, b, k) for a, b, k in spans]
        for i in (np.flatnonzero(like[lo:hi]) + lo).tolist():
            a, b = int(w.starts[i]), int(w.ends[i])
            text = raw[a:b]
            a += len(text) - len(text.lstrip(_EDGES))
            b = a + len(text.strip(_EDGES))
            if b - a >= 4 and not any(x < b and a < y for x, y, _ in spans):
                items.append((a, b, -1))
        rows = []
        for a, b, k in items:
            # The word that holds the start, and the one that holds the end.
            i = int(np.searchsorted(w.starts, a, side="right")) - 1
            j = int(np.searchsorted(w.starts, b - 1, side="right")) - 1
            word = lambda n: _plain(raw[w.starts[n] : w.ends[n]]) if lo <= n < hi else ""
            one, two, after = word(i - 1), word(i - 2), word(j + 1)
            form = shape(raw[a:b])
            patterns = [f"L2 {two} {one}", f"LR {one} _ {after}", f"LS {one} {form}", f"SR {form} {after}"]
            instance = hashlib.blake2b(raw[a:b], digest_size=12).hexdigest()
            rows.append((a, b, k, instance, patterns))
        out.append(rows)
    return out


_ROWS = (
    "row_id string, doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, "
    "base_spans string, items array<struct<a:int,b:int,kind:int,instance:string,patterns:array<string>>>"
)
_ROWS_ARROW = pa.schema(
    [
        ("row_id", pa.string()), ("doc_id", pa.int64()),
        *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("base_spans", pa.string()),
        ("items", pa.list_(pa.struct([
            ("a", pa.int32()), ("b", pa.int32()), ("kind", pa.int32()), ("instance", pa.string()),
            ("patterns", pa.list_(pa.string()))]))),
    ]
)


def row_id(doc_id, text: bytes) -> str:
    """Names rows of one id and text alike: they have the same spans."""
    return hashlib.blake2b(text, digest_size=16, key=str(doc_id).encode()).hexdigest()


def _seeker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(column(batch, "text")):
            found = seeds(piece)
            items = candidates(piece, found)
            before = code_points_before(piece)
            ids = column(batch, "doc_id").slice(piece.first, piece.rows).to_pylist()
            out = []
            for row in range(piece.rows):
                zero = before[piece.offsets[row]]
                at = lambda x: int(before[x] - zero)  # noqa: E731, B023
                spans = sorted((k, at(a), at(b)) for k, a, b in found[row])
                text = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
                out.append(
                    {
                        "row_id": row_id(ids[row], piece.row(row)), "doc_id": ids[row],
                        **{f"n_{name}": sum(k == i for k, _, _ in spans) for i, name in enumerate(KINDS)},
                        "base_sha256": hashlib.sha256(text.encode()).hexdigest(), "base_spans": text,
                        "items": [
                            {"a": at(a), "b": at(b), "kind": k, "instance": n, "patterns": p}
                            for a, b, k, n, p in items[row]
                        ],
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema=_ROWS_ARROW)


def seed_rows(docs: DataFrame) -> DataFrame:
    """Per document its seeds and the identifier-like strings with their patterns."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_seeker, _ROWS)


def confident_patterns(
    occurrences: DataFrame,
    rounds: int = ROUNDS,
    min_seeds: int = MIN_SEEDS,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """pattern, kind, confidence: what the graph of patterns and instances supports.

    ``occurrences`` has pattern, instance, kind (-1 where unknown). A pattern needs ``min_seeds``
    distinct seeds of the kind. Confidence is belief summed over distinct instances, over one more
    than their number; an instance that is a seed of another kind is believed to be only that.
    """
    edges = stage(occurrences.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "edges")
    support = stage(
        edges.filter("kind >= 0")
        .groupBy("pattern", F.col("kind").alias("of"))
        .agg(F.count("*").alias("seeds"))
        .filter(F.col("seeds") >= min_seeds),
        "support",
    )
    # Only patterns that some kind supports can ever be confident, so only they stay in the graph.
    graph = stage(edges.join(support, "pattern").drop("seeds"), "graph")
    belief = None
    for round_ in range(rounds):
        seen = graph if belief is None else graph.join(belief, ["instance", "of"], "left")
        believed = F.when(F.col("kind") >= 0, (F.col("kind") == F.col("of")).cast("double")).otherwise(
            F.lit(0.0) if belief is None else F.coalesce("belief", F.lit(0.0))
        )
        scored = stage(
            seen.groupBy("pattern", "of").agg(
                (F.sum(believed) / (F.count("*") + 1)).alias("confidence")
            ),
            f"patterns_{round_}",
        )
        if round_ + 1 < rounds:
            doubt = F.product(1 - F.col("confidence"))
            unknown = graph.filter("kind < 0").join(scored, ["pattern", "of"])
            # Noisy or: an unknown string is doubted only as far as all of its patterns are.
            belief = stage(
                unknown.groupBy("instance", "of").agg((1 - doubt).alias("belief")), f"beliefs_{round_}"
            )
            belief = belief.filter(F.col("belief") >= 0.5)
    return scored.filter(F.col("confidence") >= min_confidence).select(
        "pattern", F.col("of").alias("kind"), "confidence"
    )


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """row_id, doc_id, counts, base_sha256, base_spans and found_spans (array of a, b) per document."""
    rows = stage(seed_rows(docs), "seed_rows")
    items = rows.select("row_id", F.explode("items").alias("i")).select(
        "row_id", "i.a", "i.b", "i.kind", "i.instance", F.explode("i.patterns").alias("pattern")
    )
    good = stage(confident_patterns(items, **options).select("pattern").distinct(), "confident")
    found = (
        items.filter("kind < 0")
        .join(good, "pattern", "left_semi")
        .groupBy("row_id")
        .agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("found_spans"))
    )
    none = F.array().cast("array<struct<a:int,b:int>>")
    return (
        rows.drop("items")
        .join(stage(found, "found"), "row_id", "left")
        .withColumn("found_spans", F.coalesce("found_spans", none))
    )


def all_spans() -> Column:
    """kind:start:end of base spans and found ones, by kind as listed, then start."""
    extra = F.transform("found_spans", lambda s: F.concat_ws(":", F.lit(FOUND), s["a"].cast("string"), s["b"].cast("string")))
    base = F.when(F.col("base_spans") != "", F.array("base_spans")).otherwise(F.array().cast("array<string>"))
    return F.concat_ws(",", F.concat(base, extra))


def _redactor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = column(batch, "text").to_pylist()
        out = []
        for text, spans in zip(texts, column(batch, "_spans").to_pylist()):
            if text and spans:
                marks = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",")))
                parts, at = [], 0
                for a, b, kind in marks:
                    if a >= at:
                        parts += [text[at:a], f"[{kind}]"]
                    at = max(at, b)
                text = "".join(parts) + text[at:]
            out.append(text)
        keep = [n for n in batch.schema.names if n not in ("text", "_spans")]
        yield pa.RecordBatch.from_arrays(
            [*[column(batch, n) for n in keep], pa.array(out, pa.string())], names=[*keep, "text"]
        )


def _name_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = []
        for piece in pieces(column(batch, "text")):
            ids = column(batch, "doc_id").slice(piece.first, piece.rows).to_pylist()
            names += [row_id(i, piece.row(n)) for n, i in enumerate(ids)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(names, pa.string())], names=[*batch.schema.names, "_row_id"]
        )


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; n_chars, where there, follows.

    Texts without spans pass unshuffled: only rows whose id may have some meet the spans.
    """
    docs, back = shielded(docs, "doc_id", "text", "n_chars")
    spans = stage(
        personal_data(docs, **options)
        .select("doc_id", F.col("row_id").alias("_row_id"), all_spans().alias("_spans"))
        .filter("_spans <> ''")
        .distinct(),
        "spans",
    )
    # Ids of seed rows are whole numbers, as personal_data reads them.
    marked = possibly_met(docs, F.col("doc_id").cast("bigint"), spans, F.col("doc_id"))
    named = marked.filter("_met").drop("_met").mapInArrow(_name_rows, plus(docs.schema, ("_row_id", "string")))
    joined = named.join(spans.drop("doc_id"), "_row_id", "left").drop("_row_id")
    fields = [f for f in joined.schema if f.name not in ("text", "_spans")] + [docs.schema["text"]]
    out = joined.mapInArrow(_redactor, type(docs.schema)(fields)).select(*docs.columns)
    out = out.union(marked.filter("not _met").drop("_met"))
    if "n_chars" in docs.columns:
        length = F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", F.coalesce(length, F.col("n_chars")))
    return back(out)
