"""The HTML cleaner, the block fold and the phrase joins on fixtures and against plain versions."""

from __future__ import annotations

import random
import re
from collections import Counter
from html.parser import HTMLParser

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import lexicon as lx
from quillon.operators import block_fold, html_clean, phrases
from quillon.operators.html_clean import ALLOWED, Cleaner, Site

SITE = Site("https://blog.example.org/blog/", "/how-to", "/api/assets")


def clean(html, slug="fire", articles=None, assets=("fire/a.png",)):
    return Cleaner(slug, articles or {"water": "home"}, set(assets), SITE).clean(html)


def html_of(html, **kw):
    return "".join(clean(html, **kw).html)


def test_tags_and_attributes():
    assert html_of('<p class="x" onclick="go()">a <b>bold</b> <strong id=1>s</strong></p>') == "<p>a bold <strong>s</strong></p>"
    found = clean('<p class="x" data-k="1">a</p><center>b</center>')
    assert list(found.rejected) == ["p@class", "center"]
    assert html_of('<table><tr><td colspan="2" rowspan="x">1</td></tr></table>') == '<table><tr><td colspan="2">1</td></tr></table>'
    assert html_of('<ol start="3"><li>a</li></ol><ol start="3x"></ol>') == '<ol start="3"><li>a</li></ol><ol></ol>'
    assert html_of("a < b > c &amp; &eacute;") == "a &lt; b &gt; c &amp; &eacute;"
    assert html_of('<p title=\'a"b>c\'>x</p>') == "<p>x</p>" and html_of('<a title=\'a"b>c\'>x</a>') == '<a title="a&quot;b&gt;c">x</a>'


def test_what_goes_with_its_content():
    assert html_of("a<script>if (a < b) { '<p>' }</script>b<style>p{}</style>c") == "abc"
    assert html_of("a<svg><svg><p>in</p></svg>still</svg>b") == "ab"
    assert html_of("a<iframe src=x/>b<script>never closed <p>x</p>") == "ab"
    assert html_of("<!doctype html><!-- <p>no</p> --><![CDATA[no]]>yes<!-- open") == "yes&lt;!-- open"


def test_balance():
    assert html_of("<ul><li>a<li>b</ul>") == "<ul><li>a<li>b</li></li></ul>"
    assert html_of("<p>a<p>b") == "<p>a</p><p>b</p>"
    assert html_of("<p>a <em>b<ul><li>c</li></ul>") == "<p>a <em>b</em></p><ul><li>c</li></ul>"
    assert html_of("a</em></p>b<em><strong>c</em>d</strong>") == "ab<em><strong>c</strong></em>d"


def test_links_and_pictures():
    out = ' target="_blank" rel="noopener noreferrer" data-external="1"'
    assert html_of('<a href="https://blog.example.org/blog/x/water.html#s">w</a>') == '<a href="/how-to/home/water#s">w</a>'
    assert html_of('<a href="water">w</a><a href="../blog/water/">w</a>') == '<a href="/how-to/home/water">w</a>' * 2
    assert html_of('<a href="https://other.org">o</a>') == f'<a href="https://other.org/"{out}>o</a>'
    assert html_of('<a href="#top">t</a><a href="mailto:a@b.c">m</a>') == f'<a href="#top">t</a><a href="mailto:a@b.c"{out}>m</a>'
    for bad in ("javascript:alert(1)", "java\tscript:alert(1)", "&#106;avascript:x", "data:text/html,x", "  ", "ftp://x.org/y"):
        assert html_of(f'<a href="{bad}">x</a>') == "<a>x</a>", bad
    assert html_of('<img src="assets/fire/a.png" alt="A&amp;B" onerror=x width=12>') == '<img src="/api/assets/fire/a.png" alt="A&amp;B" width="12">'
    assert html_of('<img src="./assets/fire/a.png"/>x</img>') == '<img src="/api/assets/fire/a.png">x'
    for bad in ("assets/other/a.png", "https://x.org/a.png", "assets/fire/b.png", "assets/fire/../a.png", "assets/fire/a.exe"):
        found = clean(f'<img alt=x src="{bad}">y')
        assert "".join(found.html) == "y" and not found.images and f"img {bad}" in found.rejected


def test_sections():
    found = clean("<p>intro &eacute;&#233;&nbsp;x</p><h2>One\n <em>two</em></h2><p>a</p><p>b<br>c</p><h2></h2><table><tr><td>1</td><td>2</td></tr></table><h2>Open")
    assert found.sections == [["", "intro &eacute;é x"], ["One two", "a\n\nb\n\nc"], ["", "1 2"], ["Open", ""]]


TAGS = ["p", "h2", "ul", "li", "em", "strong", "a", "td", "tr", "table", "div", "script", "svg", "img", "br", "pre"]
PIECES = st.one_of(st.sampled_from([f"<{t}>" for t in TAGS] + [f"</{t}>" for t in TAGS] + ['<a href="javascript:x" onclick=y>', '<p class="', "<!--", "-->", "<", ">", "'", '"', "&lt;", '<img src="assets/fire/a.png">']), st.text("ab <>&\"'=/", max_size=6))


class Balance(HTMLParser):
    def __init__(self):
        super().__init__()
        self.stack, self.seen = [], set()

    def handle_starttag(self, tag, attrs):
        self.seen |= {(tag, None), *((tag, k) for k, _ in attrs)}
        if tag != "img":
            self.stack.append(tag)

    def handle_endtag(self, tag):
        assert self.stack.pop() == tag


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=40).map("".join))
def test_any_fragment_comes_out_balanced_and_listed(html):
    once = html_of(html)
    parser = Balance()
    parser.feed(once)
    parser.close()
    assert parser.stack == [] and {t for t, _ in parser.seen} <= set(ALLOWED)
    assert {(t, k) for t, k in parser.seen if k} <= {(t, k) for t, ks in ALLOWED.items() for k in ks} | {("a", x) for x in ("target", "rel", "data-external")}
    assert "<script" not in once.lower() and "javascript:" not in once


def test_cleaned_table(spark):
    rows = [(1, '<p>a<a href="b.html">b</a><a href="zz">z</a></p>', "fire", ["fire/a.png"], "k"), (2, None, None, None, "k"), (3, '<img src="assets/fire/a.png"><script>x', "fire", ["fire/a.png"], "k")]
    df = spark.createDataFrame(rows, "id long, body string, own string, files array<string>, html string")
    articles = spark.createDataFrame([("b", "cat"), ("c", "cat")], "slug string, category string")
    found = {r.id: r for r in html_clean.cleaned(df, "id", "body", "own", articles, "files", SITE).collect()}
    assert found[1].html.startswith('<p>a<a href="/how-to/cat/b">b</a><a href="https://blog.example.org/blog/zz" target') and found[2].html == "" and found[2].sections == []
    assert found[3].images == ["/api/assets/fire/a.png"] and found[3].rejected == ["script"]
    assert html_clean.cleaned(df.limit(0), "id", "body", "own", articles, "files", SITE).count() == 0


def plain_fold(blocks):
    """The same clean-up over a list, with everything at hand: (text, heading, guessed, page)."""
    shape = lambda t: " ".join(re.sub(r"\d+", "#", t.lower()).split())
    figure = lambda t: re.fullmatch(r"[\d\s.,:%€$+×xX/|-]+", t.strip()) is not None
    blocks = [b for b in blocks if b[0] and b[0].strip()]
    seen = Counter(shape(t) for t, *_ in blocks if len(t) < 150)
    out, wait = [], []
    for text, heading, guessed, page in blocks:
        if (not figure(text) and len(text) < 150 and seen[shape(text)] >= 3) or (page and (figure(text) or re.fullmatch(r"(?i)page\s*\d+(\s*[/|]\s*\d+)?", text.strip()))):
            continue
        if figure(text) and not heading:
            wait.append(text.strip())
            continue
        if wait:
            text, wait = f"{' '.join(wait)} · {text}", []
        if heading and len([c for c in text if c.isalpha()]) < 3:
            continue
        if out and not heading and not out[-1][1] and len(text) < 40 and len(out[-1][0]) < 200 and out[-1][3] == page:
            out[-1][0] += f" · {text}"
        else:
            out.append([text, heading, guessed, page])
    if wait:
        out.append([" ".join(wait), False, False, None])
    heads = [b[1] for b in out] + [False]
    return [(t, h and not (g and heads[k + 1]), p) for k, (t, h, g, p) in enumerate(out)]


def test_block_fold(spark):
    random.seed(3)
    pool = ["96", "12,5 %", "Page 3", "page 4/9", "Header of 2024", "Header of 2025", "header  of 7", "Short", "Ab", "§§", "Un titre", "Deux", "x" * 45, "word " * 30, "long " * 60, None, "", "  ", "3 x 4", "100"]
    docs = {d: [(random.choice(pool), random.random() < 0.3, random.random() < 0.6, random.choice([None, 1, 1, 2])) for _ in range(random.randint(0, 60))] for d in range(60)}
    docs[99], docs[None] = [(f"block {'abcdefgh'[k % 8]} {'y' * (k % 70)}", False, False, None) for k in range(9000)], [("12", False, False, None), ("alone", False, False, None)]
    rows = [(d, k, *b) for d, blocks in docs.items() for k, b in enumerate(blocks)]
    df = spark.createDataFrame(rows, "doc long, pos int, text string, heading boolean, guessed boolean, page int").repartition(7)
    found: dict = {}
    for r in block_fold.folded(df, "doc", most=50).orderBy("doc", "pos").collect():
        assert r.pos == len(found.setdefault(r.doc, []))
        found[r.doc].append((r.text, r.heading, r.page))
    assert found == {d: x for d, blocks in docs.items() if (x := plain_fold(blocks))}
    assert block_fold.folded(df.limit(0), "doc").count() == 0


def test_chapters(spark):
    rows = [(1, 1, None, None), (1, 2, "One", "One"), (1, 3, None, "One"), (1, 4, "", None), (1, 5, None, None), (1, 6, "Two", "Two"), (2, 1, None, None)]
    df = spark.createDataFrame([r[:3] for r in rows], "doc int, pos int, header string")
    assert sorted((r.doc, r.pos, r.chapter) for r in block_fold.chapters(df, "doc", "pos", "header").collect()) == sorted((d, p, c) for d, p, _, c in rows)


def test_phrases_against_every_pair(spark):
    random.seed(6)
    words = ["feu", "eau", "a", "b", "112", "été", "perte", "de"]
    pick = lambda n: [random.choice(words) for _ in range(n)]
    texts, dictionary = [(k, pick(random.randint(0, 12))) for k in range(80)], [(k, pick(random.randint(0, 5))) for k in range(60)]
    found = phrases.found(spark.createDataFrame(texts, "t int, w array<string>"), "w", spark.createDataFrame(dictionary, "p int, v array<string>"), "v")
    inside = lambda w, v: any(w[i : i + len(v)] == v for i in range(len(w) - len(v) + 1))
    assert Counter((r.t, r.p) for r in found.collect()) == Counter((t, p) for t, w in texts for p, v in dictionary if v and inside(w, v))
    found.explain()
    assert phrases.found(spark.createDataFrame(texts, "t int, w array<string>"), "w", spark.createDataFrame([], "p int, v array<string>"), "v").count() == 0


def test_keyword_strength(spark):
    asked = spark.createDataFrame([(1, "Que faire en cas de coupure de courant ?"), (2, "appeler le 112"), (3, "un coup de soleil sur le bras"), (4, None), (5, "plus d'électricité")], "q int, text string")
    articles = spark.createDataFrame([("courant", ["courant", "coupure de courant"]), ("urgences", ["Appeler le 112", "le"]), ("soleil", ["soleil"]), ("elec", ["plus d'electricite"]), ("none", None)], "slug string, keys array<string>")
    found = {(r.q, r.article): (r.keyword, r.level, r.coverage, r.floor) for r in phrases.keyword_strength(asked, "q", "text", articles, "slug", "keys").collect()}
    assert found == {
        (1, "courant"): ("coupure de courant", "complete", 1.0, 0.25),
        (2, "urgences"): ("Appeler le 112", "complete", 1.0, 0.35),
        (3, "urgences"): ("le", "moderate", 0.0, 0.35),
        (3, "soleil"): ("soleil", "moderate", 0.33, 0.35),
        (5, "elec"): ("plus d'electricite", "complete", 1.0, 0.35),
    }


def test_titles_and_words(spark):
    asked = spark.createDataFrame([(1, "Comment soigner une brûlure ?"), (2, "perte de connaissance soudaine"), (3, "je suis là"), (4, "")], "q int, text string")
    titles = spark.createDataFrame([("Brûlure",), ("Perte",), ("Perte de connaissance (médecine)",), ("Je suis",), ("Une",), (None,)], "title string")
    assert {r.q: r.title for r in phrases.longest_title(asked, "q", "text", titles, "title").collect()} == {1: "brulure", 2: "perte de connaissance"}
    row = spark.range(1).select(lx.general_section(F.lit("Premiers  soins et suite")).alias("a"), lx.general_section(F.lit("Les traitements")).alias("b"), lx.useful_keys(F.array(F.lit("je suis perdu"), F.lit("forêt dense"))).alias("c")).first()
    assert (row.a, row.b, row.c) == (True, False, "foret dense")


def test_longest_prefix(spark, capsys):
    paths = spark.createDataFrame([(1, "/c/wiki/A"), (2, "/c/wiki/fr/B/x"), (3, "/d"), (4, None), (5, "/c/wikipedia/Z"), (6, "none")], "id int, path string")
    known = spark.createDataFrame([("/c/wiki/", "w"), ("/c/wiki/fr/", "f"), ("/c/", "c")], "prefix string, title string")
    found = phrases.longest_prefix(paths, "path", known, "prefix")
    assert {r.id: (r.prefix, r.title) for r in found.collect()} == {1: ("/c/wiki/", "w"), 2: ("/c/wiki/fr/", "f"), 3: (None, None), 4: (None, None), 5: ("/c/", "c"), 6: (None, None)}
    found.explain()
    told = capsys.readouterr().out
    assert "NestedLoop" not in told and "Cartesian" not in told


def test_section_search(spark):
    sections = spark.createDataFrame([("fire", 0, "feu de foret", "le feu feu de"), ("fire", 1, "un feu et de l'eau, eau encore eaux", "le feu un feu"), ("water", 0, "eau potable", "eau"), ("call", 0, "rien du tout", "urgences")], "article string, section int, norm string, titles string")
    asked = spark.createDataFrame([(1, ["feu", "eau"], "feu eau"), (2, ["feu"], None), (3, ["rien", "absent"], "rien absent"), (4, ["eau", "potable"], "eau potable")], "question int, words array<string>, phrase string")
    strength = spark.createDataFrame([(3, "call", "complete"), (2, "fire", "moderate")], "question int, article string, level string")
    found = sorted((r.question, r.article, r.section, r.score, r["rank"]) for r in phrases.section_search(asked, sections, strength).collect())
    assert found == [(1, "fire", 1, 9, 1), (2, "fire", 0, 9, 1), (3, "call", 0, 1001, 1), (4, "water", 0, 22, 1)]
