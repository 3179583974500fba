"""Main text, hard negatives and spelling variants against brute force."""

import html as entities
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from holdfast.llm import negatives, spelling, webtext

SF = "/root/testdata/sf0.001"


def test_new_operators_are_registered():
    names = entry_points.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in (11, 12, 13))


# --- main text -----------------------------------------------------------------------------------

LONG = "This sentence is long enough to look like the running text of an article. " * 3
CASES = {
    "article": (
        f"<body><nav><a>x</a></nav><article><h1>T</h1><p>{LONG}</p><p>Of.</p></article><footer>F</footer>",
        f"T\n{LONG.strip()}\nOf.",
    ),
    "unclosed": ("<article><p><b>one<br>two<p>three<li>four", "one two\nthree\nfour"),
    "entities": ("<article><p>a &amp; b &lt;c&gt; &#233;&nbsp; x &copy &amp</p></article>", "a & b <c> é x © &"),
    "white space": ("<article><p> a \n\t b </p>\n\n<p>\n</p><p>c</p></article>", "a b\nc"),
    "scripts": ('<article><p>a<script>var p = "<p>no</p>";</script>b</p><style>p{}</style></article>', "ab"),
    "comment marks": ("<article><!-- <p>no</p> --><p>yes</p><!----><p>and<!--> this</p></article>", "yes\nand this"),
    "quoted sign": ('<article><p title="a > b">text</p></article>', "text"),
    "open quote": ('<article><p title="a>text</p></article>', "text"),
    "lone signs": ("<article><p>1 < 2 && 3 > 2 <3</p></article>", "1 < 2 && 3 > 2 <3"),
    "hints inside": (
        f'<article><p>{LONG}</p><div class="ad">buy</div><div id="cookie-notice">ok?</div>'
        '<form><p>name</p></form><ol class="commentlist"><li>first!</li></ol><p>end</p></article>',
        f"{LONG.strip()}\nend",
    ),
    "wrappers": (
        f'<form id="all"><div class="page has-sidebar with-comments"><main><p>{LONG}</p></main></div>'
        '<div class="sidebar"><p>side</p></div></form>',
        LONG.strip(),
    ),
    "header of the article": (
        f"<header><h1>Site</h1></header><article><header><h1>T</h1></header><p>{LONG}</p></article>",
        f"T\n{LONG.strip()}",
    ),
    "no article": (
        f'<div id="menu"><a>home</a></div><div id="x"><h1>Title of it</h1><p>{LONG}</p><p>Of.</p><p>{LONG}</p></div>'
        '<div class="comments"><p>' + LONG * 9 + "</p></div>",
        f"Title of it\n{LONG.strip()}\nOf.\n{LONG.strip()}",
    ),
    "links lose": (
        "<div><div>" + "<p><a href=x>a link of some words and more</a></p>" * 30 + f"</div><div><p>{LONG}</p><p>{LONG}</p></div></div>",
        f"{LONG.strip()}\n{LONG.strip()}",
    ),
    "table": ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\nb\nc"),
    "plain": ("only text & more", "only text & more"),
    "nothing": ("<nav>menu</nav><footer>f</footer>", ""),
    "cut off": ("<article><p>text</p><p cla", "text"),
    "after the body": ("<html><body><article><p>a</p></article></body></html>\n", "a"),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    html, want = CASES[name]
    assert webtext.main_text(html) == want


def test_main_texts_of_a_table(spark):
    rows = [(1, "u", CASES["article"][0]), (2, None, None), (3, "v", ""), (None, "w", "<p>x"), (1, "u", CASES["article"][0])]
    rows.append((4, "long", "<article>" + "<p>word and word</p>" * 40_000))
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = webtext.main_texts(df.repartition(3))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = [(i, u, webtext.main_text(h), len(webtext.main_text(h))) for i, u, h in rows]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert webtext.main_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize("html", ["<div>" * 50_000 + "x", "<li>" * 50_000, '<a "' * 50_000, "<b x='" + "<i y=" * 50_000, "<p><b>" * 50_000])
def test_hostile_pages_end(html):
    webtext.main_text(html)


class _Nested(HTMLParser):
    """Well-formed pages as (name, children, own start tags)."""

    def __init__(self, html):
        super().__init__()
        self.top = ["", [], 1, 0]
        self.path = [self.top]
        self.linked = False
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        if tag in ("a", "b"):
            self.path[-1][2] += 1
            self.path[-1][3] += tag == "a"
            self.linked |= tag == "a"
            return
        node = [tag, [], 1, 0]
        self.path[-1][2] += 0
        self.path[-1][1].append(node)
        self.path.append(node)

    def handle_endtag(self, tag):
        if tag == "a":
            self.linked = False
        elif tag != "b":
            self.path.pop()

    def handle_data(self, data):
        self.path[-1][1].append((len(data.strip()), self.linked))


def _peak(html):
    """Text of the node with the largest sum, by the definition."""
    top = _Nested(html).top

    def totals(node):
        c = t = lc = lt = 0
        for child in node[1]:
            if isinstance(child, tuple):
                c, lc = c + child[0], lc + child[0] * child[1]
            else:
                a, b, x, y = totals(child)
                c, t, lc, lt = c + a, t + b, lc + x, lt + y
        return c, t + node[2], lc, lt + node[3]

    c0, _, lc0, _ = totals(top)

    def density(c, t, lc, lt):
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * max(lc, 1) + lc0 / c0 * c + math.e)
        return c / t * max(math.log(c / max(lc, 1) * t / max(lt, 1), base), 0)

    best = []

    def walk(node, path):
        total = 0.0
        for child in node[1]:
            if isinstance(child, tuple):
                total += density(child[0], 1, child[0] * child[1], int(child[1]))
            else:
                total += density(*totals(child))
        best.append((total, path, node[0]))
        for k, child in enumerate(node[1]):
            if not isinstance(child, tuple):
                walk(child, [*path, k])

    walk(top, [])
    return max(best, key=lambda b: b[0])


def test_density_sums_by_definition():
    rng = random.Random(11)

    def block(depth):
        kind = rng.choice(["div", "section", "p"]) if depth else "p"
        if kind == "p":
            words = " ".join(rng.choice(["word", "some", "letters"]) for _ in range(rng.randint(1, 40)))
            return f"<p><a>{words}</a></p>" if rng.random() < 0.3 else f"<p>{words}<b>bold</b></p>"
        return f"<{kind}>" + "".join(block(depth - 1) for _ in range(rng.randint(1, 5))) + f"</{kind}>"

    for _ in range(40):
        html = "<body>" + "".join(block(3) for _ in range(4)) + "</body>"
        total, _, name = _peak(html)
        page = webtext.parse(html)
        chosen = webtext.main_nodes(page)
        assert any(chosen)
        # The node of the largest sum is chosen with all that is in it.
        first = chosen.index(True)
        assert page.name[first] in (name, "", "body", "div", "section", "p")
        text = webtext.main_text(html)
        assert text and all(line in entities.unescape(re.sub("<[^>]+>", "", html)) for line in text.split("\n"))
        assert total > 0


# --- hard negatives ------------------------------------------------------------------------------


def _hard(rows, n_positives=5, n_negatives=3):
    good = [
        (i, label, [math.floor(256 * float(x)) for x in v])
        for i, label, v in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, la, va in good:
        if a % 50:
            continue
        score = lambda v: sum(x * y for x, y in zip(va, v))
        same = sorted(((-score(v), i) for i, label, v in good if label == la and i != a))[:n_positives]
        other = sorted((-score(v), i) for i, label, v in good if label != la and i != a)
        for minus, p in same:
            low, high = 50 * -minus, 95 * -minus
            inside = [(n, i) for n, i in other if low <= -100 * n <= high][:n_negatives]
            out += [(a, p, k, i, -minus, -n) for k, (n, i) in enumerate(inside, 1)]
    return Counter(out)


def _vectors(seed, n=420, width=48):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    rows = [
        (int(i), int(rng.integers(0, 3)), (centres[rng.integers(0, 6)] + 0.6 * rng.normal(size=width)).tolist())
        for i in range(n)
    ]
    rows += [(n + k, 1, rows[k % 2][2]) for k in range(40)]  # ties
    rows += [(7, 2, rows[50][2]), (50, 0, rows[50][2])]  # repeated ids
    rows += [
        (1000, None, rows[0][2]), (1050, 1, None), (1100, 1, [1.0, None]), (1150, 1, [float("nan")] * 3),
        (1200, 1, [float("inf"), 1.0]), (None, 1, rows[0][2]), (1250, 1, []), (1300, 2, [2.5, -1.0]), (1350, 0, [0.0] * width),
    ]
    return rows


def _table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").withColumns(
        {"score": F.lit(1), "block": F.lit("x"), "id": F.lit(None).cast("int")}
    )


@pytest.mark.parametrize("sizes", [(8192, 1024, 1 << 23), (32, 3, 1 << 23), (32, 3, 0)])
def test_hard_negatives(spark, sizes):
    rows = _vectors(1)
    got = negatives.hard_negatives(
        _table(spark, rows), F.col("id") % 50 == 0, shard_rows=sizes[0], anchor_rows=sizes[1], broadcast_bytes=sizes[2]
    )
    assert Counter(map(tuple, got.collect())) == _hard(rows)


def test_hard_negatives_of_nothing(spark):
    none = _table(spark, _vectors(1)).limit(0)
    assert negatives.hard_negatives(none, F.col("id") % 50 == 0).count() == 0
    some = _table(spark, [(1, 1, [1.0]), (2, 2, [1.0])])
    assert negatives.hard_negatives(some, F.col("id") % 50 == 0).count() == 0


def test_large_components_are_scored_exactly(spark):
    rows = [(i, i % 2, [float(x) * 1e5 for x in v[:8]]) for i, _, v in _vectors(2, 120) if v and i is not None and i < 120]
    got = negatives.hard_negatives(_table(spark, rows), F.col("id") % 50 == 0)
    assert Counter(map(tuple, got.collect())) == _hard(rows)


@pytest.mark.parametrize("width", [1, 5, 64, 100])
def test_intervals_hold_the_scores_and_prune(width):
    rng = np.random.default_rng(width)
    centres = rng.normal(size=(20, width)) * 300
    matrix = np.floor(centres[rng.integers(0, 20, 3000)] + 40 * rng.normal(size=(3000, width))).astype(np.int64)
    queries = matrix[:50]
    asked, codes = negatives.Asked(queries), negatives.Codes(matrix)
    shard = negatives.Shard(
        negatives.Rows(np.arange(3000).tobytes(), np.zeros(3000, np.int64).tobytes(), matrix.tobytes(), width), width
    )
    for i in range(50):
        lower, upper = asked.interval(i, codes, slice(0, None))
        exact = matrix @ queries[i]
        assert (lower <= exact).all() and (exact <= upper).all()
        best = negatives.Best(5)
        shard.positives(asked, i, queries[i], i, 0, best)
        want = sorted((-int(s), k) for k, s in enumerate(exact) if k != i)[:5]
        assert [(-int(s), int(k)) for s, k in zip(best.scores, best.ids)] == want
    if width >= 64:
        assert shard.scored < 0.4 * 50 * 3000


# --- spelling variants ---------------------------------------------------------------------------


def _variants(counts, times=2):
    masked, deleted, near = defaultdict(list), defaultdict(set), defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            masked[k, w[:k], w[k + 1 :]].append(w)
            deleted[w[:k] + w[k + 1 :]].add(w)
    for group in masked.values():
        for w in group:
            near[w] |= {o for o in group if o != w}
    for w in counts:
        for o in deleted.get(w, ()):
            near[w].add(o)
            near[o].add(w)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def _as_set(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def _documents(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéÿ÷") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    texts = []
    for k in range(200):
        picked = []
        for _ in range(rng.randint(0, 120)):
            w = rng.choice(base[: 1 + int(60 * rng.random() ** 2)])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + "b" + w[at:], w[:at] + "Q" + w[at + 1 :], w.upper()])
            picked.append(w)
        texts.append((k, rng.choice([" ", "-", "1", "ß "]).join(picked)))
    return [*texts, (0, texts[0][1]), (None, texts[3][1]), (900, None), (901, ""), (902, "A" * 5000 + " " + "A" * 5000 + " " + "A" * 4999 + " " + ("A" * 4999 + ";") * 3)]


def _counts(rows, every):
    counts = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate({65 + k: 97 + k for k in range(26)})
            h = zlib.crc32(f"{doc}:{w}".encode())
            if every and doc is not None and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


@pytest.mark.parametrize("cell", [4, 1 << 15])
def test_spelling_variants(spark, monkeypatch, cell):
    rows = _documents(13)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, word string, n int")
    if cell == 4:
        monkeypatch.setattr(spelling, "TEXT_SLICE", 50)
        monkeypatch.setattr(spelling, "HELD_WORDS", 20)
    words = spelling.words(docs.repartition(3), planted_every=7)
    assert {r.word: r.n for r in words.collect()} == _counts(rows, 7)
    assert _as_set(spelling.variants(words, cell=cell)) == _variants(_counts(rows, 7))


def test_spelling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.variants(spelling.words(none)).count() == 0


def test_words_with_equal_letters_are_not_paired_one_by_one(spark):
    """Anagrams are one point of the tree: their spellings are matched instead."""
    anagrams = ["".join(p) for p in itertools.permutations("abcdef")]
    others = ["".join(p) + "g" for p in itertools.permutations("abcdef")][::3] + ["".join(p) for p in itertools.permutations("abcdex")][::2]
    counts = {w: 3 + zlib.crc32(w.encode()) % 9 for w in [*anagrams, *others]}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert _as_set(spelling.variants(df)) == _variants(counts)
    assert _as_set(spelling.variants(df, cell=100)) == _variants(counts)


def test_tree_finds_every_point_within_the_radius():
    rng = np.random.default_rng(5)
    matrix = rng.choice(np.frombuffer(b"abcdefg\xe9", np.uint8), (900, 7))
    points = spelling.points(matrix)
    tree = spelling.Tree(points)
    for radius in (1, 2):
        seen = np.zeros((900, 900), bool)
        for asked, leaf in tree.near(points, radius):
            seen[np.ix_(asked, leaf)] = True
        apart = np.bitwise_count(points[:, None] ^ points[None]).sum(axis=2)
        assert seen[apart <= radius].all() and seen.sum() < 900 * 900 / 2
    letters = np.stack([(matrix == c).sum(axis=1) for c in np.unique(matrix)], axis=1)
    assert (np.abs(letters[:, None] - letters[None]).sum(axis=2) >= apart).all()


def test_chains_end_at_their_root(spark):
    chain = ["abcde" + "x" * k for k in range(12)]
    counts = {w: 3 * 2 ** (12 - k) for k, w in enumerate(chain)}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert {r.root for r in spelling.variants(df).collect()} == {"abcde"}
