"""Toxicity by weak supervision.

Voters are lexicons and patterns: a fixed list of insults, words and word beginnings that labelled
rows tie to toxicity, shouting, and insults near the second person. No voter decides alone. A
generative model with one hidden class per document is fitted to the votes of all documents: it
estimates how often each voter fires for either class, and from the votes that remain alike
within a class how strongly voters repeat each other, and discounts those that do. Its posterior then
labels a bounded sample, on which a linear classifier over vote strengths is trained; that
classifier scores every document.

Votes are counted per vote pattern and summed in Spark, over all rows. Labels are used from rows that
``may_learn`` allows, ``SAMPLE`` of them at most: to choose the words and to start the model. A
score sees the text only.

Null and empty texts get no votes and the score of such. Documents that repeat are scored each.
Without labels of both classes the fixed voters work alone, from assumed rates. An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import U64, Piece, RangeHash, column, combine, mix, pieces, plus, runs, stage
from holdfast.llm.minhash import near_duplicates

SAMPLE = 10_000  # labelled rows that are read, at most
MIN_DOCS = 3  # toxic documents a word must occur in, copies counted once
# Least share of toxic documents among those with a word, or a word beginning: lower bounds.
MIN_PRECISION = {"word": 0.75, "begin": 0.9}
WORDS_PER_KIND = 300
VOTERS_PER_KIND = 4
EM_ROUNDS = 8
PREFIXES = (4, 5, 6)

# Insults of the built-in lexicon, by voter.
LEXICON = {
    "insult": ("idiot", "moron", "stupid", "imbecile", "dumb", "fool", "retard", "halfwit", "dimwit"),
    "contempt": ("worthless", "pathetic", "disgusting", "loser", "trash", "scum", "clown", "filth", "vermin", "garbage"),
    "abuse": ("bitch", "bastard", "whore", "slut", "asshole", "fuck", "fucking", "shit", "cunt", "prick"),
}
SECOND_PERSON = ("you", "your", "youre", "u")

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


# --- words ---------------------------------------------------------------------------------------


def lowered(piece: Piece) -> Piece:
    """The piece in lower case; rows may change their length."""
    rows = [piece.row(i).decode("utf-8", "replace").lower().encode() for i in range(piece.rows)]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    return Piece(piece.first, np.frombuffer(b"".join(rows), np.uint8), bounds)


@dataclass
class Terms:
    """Words of a lowered piece, their hashes and those of their beginnings (0 where too short)."""

    piece: Piece
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hashes: dict[str, np.ndarray]
    prefix_ends: dict[str, np.ndarray]


def term_hash(kind: str, term: str) -> int:
    """The hash that ``terms`` gives a word (kind ``word``) or a beginning (``begin4`` ...)."""
    data = np.frombuffer(term.encode(), np.uint8)
    raw = RangeHash(data)(np.array([0]), np.array([len(data)]))
    return int(mix(raw + U64(_SALT[kind]))[0])


_SALT = {"word": 0, **{f"begin{n}": n for n in PREFIXES}}


def terms(piece: Piece) -> Terms:
    low = lowered(piece)
    starts, ends = runs(_WORD[low.data], low.offsets)
    row = np.searchsorted(low.offsets, starts, side="right") - 1
    hashed = RangeHash(low.data)
    at = np.flatnonzero((low.data & 0xC0) != 0x80)
    at = np.append(at, [len(low.data)] * (max(PREFIXES) + 1))
    first = np.searchsorted(at, starts)
    hashes, prefix_ends = {"word": mix(hashed(starts, ends))}, {}
    for n in PREFIXES:
        stop = at[first + n]
        longer = stop < ends
        stop = np.where(longer, stop, ends)
        hashes[f"begin{n}"] = np.where(longer, mix(hashed(starts, stop) + U64(n)), U64(0))
        prefix_ends[f"begin{n}"] = np.where(longer, stop, 0)
    return Terms(low, starts, ends, row, hashes, prefix_ends)


# --- lexicons from labelled rows -----------------------------------------------------------------


def _list_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (row, kind, term) of each text."""
    for batch in batches:
        for piece in pieces(column(batch, "text")):
            t = terms(piece)
            raw = t.piece.data.tobytes()
            toxic = column(batch, "toxic").slice(piece.first, piece.rows).to_pylist()
            for kind, stop in {"word": t.ends, **t.prefix_ends}.items():
                _, first = np.unique(combine(t.hashes[kind], t.row.astype(U64)), return_index=True)
                a, b = t.starts[first], stop[first]
                usual = (b > a) & (b - a <= 64)
                rows = t.row[first][usual].tolist()
                found = [raw[x:y].decode("utf-8", "replace") for x, y in zip(a[usual].tolist(), b[usual].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([toxic[r] for r in rows], pa.int32()), pa.array([kind] * len(rows), pa.string()),
                     pa.array(found, pa.string())],
                    names=["toxic", "kind", "term"],
                )


def once_per_copy(sample: DataFrame) -> DataFrame:
    """text, toxic of one row of each class in each group of near copies: that with the smallest doc_id.

    Groups are those of ``near_duplicates``, confirmed on full shingle sets; equal texts are one row.
    """
    exact = sample.groupBy("toxic", "text").agg(F.min("doc_id").alias("doc_id"))
    exact = stage(exact.withColumn("key", F.xxhash64("text")), "labelled_exact")
    # Texts are named by their hash, as rows of one doc_id may have different texts.
    named = near_duplicates(exact.select(F.col("key").alias("doc_id"), "text").distinct())
    named = stage(named.select(F.col("doc_id").alias("key"), "component_id").distinct(), "labelled_copies")
    first = exact.join(named, "key").groupBy("component_id", "toxic").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    first = stage(first.select("toxic", "first.doc_id", "first.key"), "labelled_first")
    return exact.join(first, ["toxic", "doc_id", "key"], "left_semi").select("text", "toxic")


def telling_terms(sample: DataFrame) -> list[tuple[str, str, int, int]]:
    """kind, term, toxic documents, other documents of the terms tied to toxicity, strongest first.

    ``sample`` has doc_id, text and toxic; ``WORDS_PER_KIND`` terms per kind are kept.
    """
    distinct = stage(once_per_copy(sample), "distinct_labelled")
    sizes = distinct.agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).first()
    if not sizes["p"] or sizes["p"] == sizes["n"]:
        return []
    base = sizes["p"] / sizes["n"]
    counted = stage(
        distinct.mapInArrow(_list_terms, "toxic int, kind string, term string")
        .groupBy("kind", "term")
        .agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q"))
        .filter(F.col("p") + F.col("q") >= MIN_DOCS),
        "terms",
    )
    tested = max(1, counted.count())
    n = F.col("p") + F.col("q")
    share = F.col("p") / n
    # Lower end of the Wilson interval of the share, at 1.28 deviations.
    z2 = 1.28**2
    lower = (share + z2 / (2 * n) - 1.28 * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    # How unlikely the share is for a word that has nothing to do with the label, among all words tried.
    surprise = F.col("p") * F.ln(share / base) + F.when(
        F.col("q") > 0, F.col("q") * F.ln((1 - share) / (1 - base))
    ).otherwise(0.0)
    good = counted.filter(F.col("p") >= MIN_DOCS).withColumn("lower", lower).filter(
        (F.col("lower") >= F.when(F.col("kind") == "word", MIN_PRECISION["word"]).otherwise(MIN_PRECISION["begin"]))
        & (surprise >= math.log(tested) + 1)
    )
    out = []
    for kind in ("word", *[f"begin{k}" for k in PREFIXES]):
        best = good.filter(F.col("kind") == kind).orderBy(F.desc(F.col("lower") * F.col("p")), "term")
        out += [(r["kind"], r["term"], r["p"], r["q"]) for r in best.limit(WORDS_PER_KIND).collect()]
    return out


# --- voters --------------------------------------------------------------------------------------


@dataclass
class Voters:
    """Term hashes with the voter each belongs to, and the names of all voters."""

    names: list[str]
    hashes: dict[str, tuple[np.ndarray, np.ndarray]]  # kind -> sorted hashes, voter numbers
    you: np.ndarray

    def __post_init__(self):
        self.sieve = {}
        for kind, (known, _) in self.hashes.items():
            sieve = np.zeros(1 << 16, bool)
            sieve[(known & U64(0xFFFF)).astype(np.int64)] = True
            self.sieve[kind] = sieve

    def hits(self, kind: str, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known terms, and their voters."""
        known, voter = self.hashes[kind]
        if len(known) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        some = np.flatnonzero(self.sieve[kind][(hashes & U64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(known, hashes[some]), len(known) - 1)
        exact = known[at] == hashes[some]
        return some[exact], voter[at[exact]]

    def strengths(self, piece: Piece) -> np.ndarray:
        """Hits of each voter in each row."""
        t = terms(piece)
        out = np.zeros((piece.rows, len(self.names)))
        insulted = np.zeros(len(t.starts), bool)
        for kind, hashes in t.hashes.items():
            at, voter = self.hits(kind, hashes)
            np.add.at(out, (t.row[at], voter), 1)
            insulted[at] = True
        # An insult within four words after the second person.
        you = np.isin(t.hashes["word"], self.you)
        near = np.zeros(len(you), bool)
        for k in range(1, 5):
            near[k:] |= you[:-k] & (t.row[k:] == t.row[:-k]) if len(you) > k else False
        out[:, self.names.index("aimed")] = np.bincount(t.row[near & insulted], minlength=piece.rows)
        starts, ends = runs(_UPPER[piece.data], piece.offsets)
        loud = starts[ends - starts >= 4]
        out[:, self.names.index("shouting")] = np.bincount(
            np.searchsorted(piece.offsets, loud, side="right") - 1, minlength=piece.rows
        )
        marks, ends = runs(piece.data == ord("!"), piece.offsets)
        out[:, self.names.index("exclaimed")] = np.bincount(
            np.searchsorted(piece.offsets, marks[ends - marks >= 2], side="right") - 1, minlength=piece.rows
        )
        return out


def make_voters(found: list[tuple[str, str, int, int]]) -> Voters:
    """Fixed lexicons, the found terms dealt by rank to a few voters per kind, and the patterns."""
    names = [*LEXICON, "aimed", "shouting", "exclaimed"]
    owner: dict[str, dict[int, int]] = {kind: {} for kind in _SALT}
    for number, listed in enumerate(LEXICON.values()):
        for word in listed:
            owner["word"][term_hash("word", word)] = number
    for kind in _SALT:
        ranked = [term for k, term, _, _ in found if k == kind]
        for v in range(VOTERS_PER_KIND):
            mine = ranked[v::VOTERS_PER_KIND]
            if mine:
                names.append(f"{kind}_{v}")
                for term in mine:
                    owner[kind].setdefault(term_hash(kind, term), len(names) - 1)
    hashes = {}
    for kind, members in owner.items():
        known = np.array(sorted(members), U64)
        hashes[kind] = known, np.array([members[int(h)] for h in known], np.int64)
    you = np.array([term_hash("word", w) for w in SECOND_PERSON], U64)
    return Voters(names, hashes, you)


def _vote(voters: Voters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(column(batch, "text")):
                fired = voters.strengths(piece) > 0
                bits = (fired * (1 << np.arange(fired.shape[1], dtype=np.int64))).sum(axis=1)
                patterns, n = np.unique(bits, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(patterns), pa.array(n)], names=["votes", "n"])

    return run


def vote_patterns(docs: DataFrame, voters: Voters) -> DataFrame:
    """votes (a bit per voter), n: how many documents vote alike."""
    counted = docs.select("text").mapInArrow(_vote(voters), "votes bigint, n bigint")
    return counted.groupBy("votes").agg(F.sum("n").alias("n"))


# --- label model ---------------------------------------------------------------------------------


@dataclass
class LabelModel:
    """Class share, rates at which voters fire in either class, and how far voters repeat each other.

    A silent voter abstains and says nothing of the class; only the silence of all is a vote, the last one.
    A vote counts less the more of the other votes of the same document repeat it.
    """

    share: float
    fires: np.ndarray  # 2 x (voters + 1): clean, toxic
    repeat: np.ndarray

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        votes = with_silence(fired)
        odds = math.log(self.share / (1 - self.share))
        odds = odds + (votes / (1 + votes @ self.repeat)) @ np.log(self.fires[1] / self.fires[0])
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def with_silence(fired: np.ndarray) -> np.ndarray:
    return np.hstack([fired, fired.sum(axis=1, keepdims=True) == 0]).astype(float)


def _expect(model: LabelModel):
    """Expected class sizes, firings and joint firings (toxic class) of a task's vote patterns."""
    m = len(model.repeat) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, hits, joint = np.zeros(2), np.zeros((2, m + 1)), np.zeros((m + 1, m + 1))
        for batch in batches:
            bits = column(batch, "votes").to_numpy()
            n = column(batch, "n").to_numpy().astype(float)
            fired = (bits[:, None] >> np.arange(m)) & 1
            p, votes = model.posterior(fired), with_silence(fired)
            for c, weight in enumerate((n * (1 - p), n * p)):
                sizes[c] += weight.sum()
                hits[c] += weight @ votes
            joint += (votes * (n * p)[:, None]).T @ votes
        flat = np.concatenate([sizes, hits.ravel(), joint.ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["at", "value"]
        )

    return run


def _smooth(hits: np.ndarray, of: float, guess: np.ndarray, weight: float = 4.0) -> np.ndarray:
    return np.clip((hits + weight * guess) / (of + weight), 1e-5, 1 - 1e-5)


def fit_label_model(patterns: DataFrame, fired: np.ndarray, toxic: np.ndarray, rounds: int = EM_ROUNDS) -> LabelModel:
    """EM over the vote patterns of all documents; the votes of labelled rows start it and hold it.

    ``patterns`` are votes and n; ``fired`` and ``toxic`` are the votes and labels of the sample. Each
    round sums, in Spark, the expected firings of every voter and pair of voters.
    """
    votes = with_silence(fired)
    m = votes.shape[1]
    guess = np.stack([np.full(m, 0.001), np.full(m, 0.1)])
    guess[:, -1] = 0.9, 0.05
    held_n = np.array([(toxic == 0).sum(), (toxic == 1).sum()], float)
    held = np.stack([votes[toxic == c].sum(axis=0) for c in (0, 1)])
    share = float(np.clip(held_n[1] / held_n.sum(), 0.01, 0.99)) if held_n.min() > 0 else 0.05
    rates = np.stack([_smooth(held[c], held_n[c], guess[c]) for c in (0, 1)])
    model = LabelModel(share, rates, np.zeros((m, m)))
    for _ in range(rounds):
        parts = patterns.mapInArrow(_expect(model), "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
        flat = np.zeros(2 + 2 * m + m * m)
        for row in parts.collect():  # as many rows as the model has sums
            flat[row["at"]] = row["value"]
        n, hits, joint = flat[:2], flat[2 : 2 + 2 * m].reshape(2, m), flat[2 + 2 * m :].reshape(m, m)
        # The labelled rows weigh as much as all others, so that the classes keep their meaning.
        k = max(1.0, n.sum() / max(1.0, held_n.sum()))
        rates = np.stack([_smooth(hits[c] + k * held[c], n[c] + k * held_n[c], guess[c]) for c in (0, 1)])
        share = float(np.clip((n[1] + k * held_n[1]) / max(1.0, n.sum() + k * held_n.sum()), 0.001, 0.999))
        # Correlation that remains within the toxic class: voters that repeat each other share one vote.
        spread = np.sqrt(np.outer(rates[1] * (1 - rates[1]), rates[1] * (1 - rates[1])))
        repeat = np.clip((joint / max(n[1], 1.0) - np.outer(rates[1], rates[1])) / spread, 0, 1)
        np.fill_diagonal(repeat, 0)
        model = LabelModel(share, rates, repeat)
    return model


# --- classifier ----------------------------------------------------------------------------------


def features(strengths: np.ndarray) -> np.ndarray:
    """Damped hits of each voter, and of all word voters together."""
    named = strengths.sum(axis=1, keepdims=True)
    return np.log1p(np.concatenate([strengths, named, named > 0], axis=1))


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps over the bounded sample; bias last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge * max(1, len(x)) / 100)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    voters: Voters
    labels: LabelModel
    weights: np.ndarray

    def scores(self, piece: Piece) -> np.ndarray:
        x = features(self.voters.strengths(piece))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _strengths(voters: Voters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(column(batch, "text")):
                rows = pa.array(voters.strengths(piece).tolist(), pa.list_(pa.float64()))
                toxic = column(batch, "toxic").slice(piece.first, piece.rows)
                yield pa.RecordBatch.from_arrays([toxic, rows], names=["toxic", "strengths"])

    return run


def may_learn(doc_id: Column) -> Column:
    """Rows whose label may be used: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(doc_id.cast("string")) % 3 != 1


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE) -> Model:
    """Model from labels (doc_id, toxic) of rows that ``may_learn`` allows and the votes of all ``docs``."""
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = usable.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & may_learn(F.col("doc_id")))
    chosen = stage(usable.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_rows), "labelled")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # The sample is at most ``sample_rows`` ids, so it may be sent to every task.
    joined = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    sample = stage(joined.limit(2 * sample_rows), "labelled_texts")
    voters = make_voters(telling_terms(sample))
    seen = sample.mapInArrow(_strengths(voters), "toxic int, strengths array<double>").collect()  # bounded by the sample
    strengths = np.array([r["strengths"] for r in seen], float).reshape(len(seen), len(voters.names))
    toxic = np.array([r["toxic"] for r in seen], np.int64)
    patterns = stage(vote_patterns(docs, voters), "vote_patterns")
    model = fit_label_model(patterns, (strengths > 0).astype(float), toxic)
    if len(seen) == 0:  # nothing to train on: the label model's own weights on presence
        weights = np.zeros(len(voters.names) + 3)
        weights[-2], weights[-1] = 8.0, -4.0
    else:
        weights = fit_linear(features(strengths), model.posterior((strengths > 0).astype(float)))
    return Model(voters, model, weights)


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.scores(piece) for piece in pieces(column(batch, "text"))]
            flat = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(flat, pa.float64())], names=[*batch.schema.names, "toxicity"]
            )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with toxicity, 0 to 1."""
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c != "toxicity"])
    return kept.mapInArrow(_scorer(model), plus(kept.schema, ("toxicity", "double")))
