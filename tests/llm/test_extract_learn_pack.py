"""Pages whose article lies where menus are looked for; a plain scorer of random trees; long labelled texts; tails of long documents."""

import random
import tracemalloc
import zlib

import numpy as np
import pytest

from frametide.llm import html, language, packing

SENTENCE = "Some long sentence with words, and commas, that goes on. "
P = f"<p>{SENTENCE * 4}</p>"
CLEAN = (SENTENCE * 4).strip()


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>x</title>{a}</html>",
        "<title>t</title>{a}",
        "<html><head><title>t</title><meta charset=u><link rel=x><script>1</script><body><div>{a}</div>",
        "<html><head>\n<title>t</title>\n words <p>{a}",
        "<body><div class='content no-sidebar'>{a}</div><div class=sidebar><p>Other, text.</p></div></body>",
        "<body><div class='layout sidebar-left'><div>{a}</div><div class='sidebar-left'><p>Other, text.</p></div></div>",
        "<body><div id=page class='site has-sidebar'>{a}</div>",
        "<body><section class=has-social>{a}</section>",
        "<body><form id=aspnet><input type=hidden><input name=q><button>go</button><div class=main>{a}</div></form>",
        "<body><form><article>{a}</article></form><form class=search><label>Search here</label><input><button>go</button></form>",
        "<body><div class=sidebar><main>{a}</main></div><div class=menu><ul><li>One<li>Two</ul></div>",
        "<body><div class='page-header'><div>{a}</div></div><div class=comments>{a}{a}{a}{a}</div>",
        "<body><div class=article>{a}</div><div class=ad>" + "Buy, now. " * 5 + "</div><form><p>Tell us</p><input><input><textarea>x</textarea></form>",
    ],
)
def test_article_is_kept(page):
    got = html.extract(page.replace("{a}", P * 3))
    assert got.replace("words\n", "").split("\n") == [CLEAN] * 3


def test_parts_inside_an_article():
    page = f"<body><article>{P}<div class=side-by-side>{P}</div><p class=related-work>Related work, in words.</p><p>An <label>inline label</label> text</p><p class=ad>Buy</p><div class=share-buttons>Share</div></article>"
    assert html.extract(page).split("\n") == [CLEAN, CLEAN, "Related work, in words.", "An inline label text"]


def test_doubts():
    for name in ("sidebar", "left sidebar", "site-header", "post-comments", "comment-list", "ad", "top_ad_slot", "social-links", "cookie-consent-banner", "side", "side-box", "nav2"):
        assert html.doubt_of(name), name
    for name in ("", "no-sidebar", "has-social", "with-ads", "side-by-side", "left-side", "related-work", "menu-of-the-day", "hidden-xs", "layout sidebar-left", "reader", "headers", "comment-status-open"):
        assert not html.doubt_of(name), name


def _tree(rng, depth=0):
    """(tag, children); a p's children are (text, linked)."""
    if depth and (depth == 5 or rng.random() < 0.45):
        return "p", [(rng.choice(["word ", "a, b, ", "x" * 60 + " ", "long text, with words " * 6]), rng.random() < 0.25) for _ in range(rng.randint(1, 3))]
    return rng.choice(["div", "section", "div", "article"]), [_tree(rng, depth + 1) for _ in range(rng.randint(1, 4))]


def _write(node):
    tag, children = node
    if tag == "p":
        return "<p>" + "".join(f"<a href=x>{t}</a>" if linked else t for t, linked in children) + "</p>"
    return f"<{tag}>" + "".join(map(_write, children)) + f"</{tag}>"


def _plain(tree):
    """The definition: points of each paragraph to every ancestor, halved at each step; the best container and its worthy siblings."""
    found = {}  # path -> [points, characters, linked characters, first paragraph]
    texts = []

    def walk(node, path):
        found[path] = [0.0, 0, 0, len(texts)]
        if node[0] != "p":
            for i, c in enumerate(node[1]):
                walk(c, (*path, i))
            return
        text = " ".join("".join(t for t, _ in node[1]).split())
        linked = min(len(text), sum(len(t) for t, ok in node[1] if ok))
        texts.append((path, text))
        for k in range(len(path) + 1):
            found[path[:k]][1] += len(text)
            found[path[:k]][2] += linked
        for k in range(len(path)):
            found[path[: len(path) - 1 - k]][0] += (1 + text.count(",") + min(3, len(text) // 100)) / 2**k

    walk(tree, ())
    tags = {}

    def name(node, path):
        tags[path] = node[0]
        for i, c in enumerate(node[1] if node[0] != "p" else []):
            name(c, (*path, i))

    name(tree, ())

    def worth(p):
        points, chars, linked, _ = found[p]
        return (points + (5 if points and tags[p] == "article" else 0)) * (1 - linked / max(1, chars))

    best = max((p for p in found if found[p][0]), key=lambda p: (worth(p), -found[p][3], len(p)))
    kept = [best]
    for p in found:
        if best and p[:-1] == best[:-1] and len(p) == len(best) and p != best:
            points, chars, linked, _ = found[p]
            if worth(p) >= 0.2 * worth(best) and points or tags[p] == "p" and linked / chars < 0.25 and chars >= 80:
                kept.append(p)
    return "\n".join(t for path, t in texts if any(path[: len(k)] == k for k in kept))


def test_html_scores_as_defined():
    rng = random.Random(8)
    for _ in range(1500):
        tree = ("section", [_tree(rng, 1) for _ in range(rng.randint(1, 4))])
        assert html.extract(f"<body>{_write(tree)}</body>") == _plain(("body", [tree])), _write(tree)


def test_extract_pages(spark):
    rows = [(1, "u", f"<body>{P}", 1), (1, "u", f"<body>{P}", 1), (None, None, None, 2), (3, "v", "", 3), (4, "w", f"<body>{P * 4000}", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(2)
    got = sorted(((r["page_id"] or 0, r["url"], r["n_chars"], len(r["text"])) for r in html.extract_pages(df).collect()), key=str)
    n = (len(CLEAN) + 1) * 4000 - 1
    assert got == [(0, None, 0, 0), (1, "u", len(CLEAN), len(CLEAN)), (1, "u", len(CLEAN), len(CLEAN)), (3, "v", 0, 0), (4, "w", n, n)]
    assert html.extract_pages(df.limit(0)).count() == 0


def test_language_of_long_texts_alone(spark):
    """A language all of whose labelled texts are long is learned, from their first letters, wherever those begin."""
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    text = lambda letters, n: " ".join(word(letters) for _ in range(n))
    rows = [(i, text("etaoinshr", 60), "en") for i in range(60)] + [(100 + i, "1 " * 9000 * (i % 2) + text("kwzyjąęł", 3000), "pl") for i in range(30)]
    rows += [(200 + i, "12 34" * 3000, "xx") for i in range(9)]  # no letters: no language
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sampled = language.sample(df).collect()
    assert {r["lang"] for r in sampled} == {"en", "pl"} and all(len(r["text"]) <= language.SAMPLE_DOC_CHARS for r in sampled)
    held = language.classify(df).collect()
    assert all(r["lang_pred"] == {0: "en", 1: "pl"}.get(r["doc_id"] // 100, "und") for r in held)
    kept = {r["doc_id"] for r in language.keep_identified(df).collect()}
    assert kept == {i for i, _, lang in rows if lang != "xx"}


def test_language_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_RAW_CHARS", 5000)
    df = spark.createDataFrame([(i, "abc def " * 100, f"l{i % 7}") for i in range(700)], "doc_id long, text string, lang string")
    count = {}
    for r in language.sample(df).collect():
        count[r["lang"]] = count.get(r["lang"], 0) + len(r["text"])
    assert len(count) == 7 and all(5000 <= n < 5000 + 800 for n in count.values())


def test_packing_holds_tails_only():
    """10,000 documents of more than 20,000 ids each with one id to wait: 800 MB if they were held whole."""
    packer = packing.Packer(0)
    ids = np.arange(2048 * 10 + 1, dtype="<u4")
    tracemalloc.start()
    for i in range(10_000):
        packer.add(i, ids)
        packer.take()
        if packer.full():
            packer.pack()
    packer.pack(last=True)
    tail = packer.take()
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()
    assert sum(r[2] for r in tail) == 10_000 and {r[1] for r in tail} == {20480} and {r[4] for r in tail} == {20481}
    assert {r[3] for r in tail} == {zlib.crc32(ids[20480:].tobytes())} and not packer.docs and not packer.left


def test_packing_of_odd_rows(spark):
    rows = [(None, "some words here"), (None, None), (1, "a b"), (1, "a b"), (2, ""), (3, "long text of words " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    got = packing.pack(df).collect()
    coder = packing.encoder()
    want = sorted((str(i), len(coder.ids(t or ""))) for i, t in rows)
    assert sum(r["length"] for r in got) == sum(n for _, n in want)
    assert sorted((str(r["doc_id"]), r["doc_tokens"]) for r in got if r["start"] == 0) == want
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
