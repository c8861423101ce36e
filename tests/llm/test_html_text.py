from __future__ import annotations

import html
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from caretide.llm import html_text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain  text", "plain text"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<p>a&amp;b&nbsp; c<br>d</p><div>x <b>bo</b>ld</div> tail", "a&b c d\n\nx bold\n\ntail"),
        ("<article><h1>T</h1><p>one<p>two<ul><li>a<li>b</ul><form>q<input></form><p>three</article>", "T\n\none\n\ntwo\n\na\n\nb\n\nthree"),
        ("<body><nav><a href=x>menu</a></nav><main><header><h1>Title</h1></header><p>Body text.</p><aside>side</aside><p>More.</p></main><footer>foot</footer>", "Title\n\nBody text.\n\nMore."),
        ("<div class='content'><p>Hello world this is text</p><div class=\"ad-banner\">buy now</div><p>and more of it</p></div><div id='comments'><p>reader says lots of things in here</p></div>", "Hello world this is text\n\nand more of it"),
        ("<article>a<script>if (a < b) document.write('<p>no</p>')</script><style>p{}</style><!-- <p>no</p> -->b</article>", "ab"),
        ("<article><p>one</p><div class=notice>cookies!</div><section class='comment-list'><p>me too</p></section><p>two &#169; &lt;x&gt;</p></article>", "one\n\ntwo © <x>"),
        ("<nav>menu <article><p>never closed menu</p></article>", "never closed menu"),
        ("<div class='layout with-sidebar'><div id='sidebar'><p>archive of posts</p></div><article class='post has-comments'><p>The story.</p></article></div>", "The story."),
        ("<div class='story'><h1>Title</h1><p>Told in a plain box.</p></div><div class='thread'><article class='comment-body'><p>first!</p></article></div>", "Title\n\nTold in a plain box."),
        ("<main><p>Shown.</p><p hidden>not</p><p style='display: none'>nor this</p><button>Like</button><figure><figcaption>A caption.</figcaption></figure></main>", "Shown.\n\nA caption."),
        ("<div class='page-header'>Site</div><article><div class='entry-header'><h1>Title</h1></div><div style='overflow: hidden'><p>Text.</p></div></article>", "Title\n\nText."),
        ("<script>var x='</p>'", ""), ("<a href=\"foo>bar", ""),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page) == text


def test_labelled_pages_not_seen_in_training():
    for page, kept in html_text.labelled_pages(150, seed=23):
        assert html_text.main_text(page).split() == kept


def test_best_region_against_all_regions():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-2.0, -1.0, -0.5, 0.5, 1.0, 3.0]) for _ in range(rng.randint(0, 12))]
        first, end = html_text.best_region(scores)
        best = max((sum(scores[a:b]) for a, b in itertools.combinations(range(len(scores) + 1), 2)), default=0.0)
        assert abs(sum(scores[first:end]) - max(0.0, best)) < 1e-9


def test_query(spark, small):
    got = {r.page_id: r for r in html_text.query(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article))
        expected = "\n\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (expected, len(expected), r.url)


def test_long_and_broken_pages_end_soon():
    for page in ("<" * 100_000, "<a " * 50_000, "<p>" * 20_000 + "x", "<div>" * 5_000 + "word " * 10, "<!-- " * 20_000, "<a href='" * 20_000, "&" * 100_000):
        html_text.main_text(page)


def test_edge_rows(edge, empty):
    pages = edge.withColumnRenamed("text", "html").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("clash"))
    out = html_text.extract(pages)
    assert out.columns == ["doc_id", "lang", "a.b", "text", "n_chars"]
    assert sorted(r.n_chars for r in out.collect()) == sorted([34, 34, 34, 0, 0, 10, 300_003, 0, 13])
    assert html_text.extract(empty, "text", "main").count() == 0


def test_teaser_articles_beside_the_main_text():
    story = "".join(f"<p>{'word ' * 40}</p>" for _ in range(3))
    page = f"<div class='story'><h1>Title</h1>{story}</div><article class='card'><h3>Teaser</h3><p>short teaser text</p></article>"
    assert html_text.main_text(page).split() == ["Title"] + ["word"] * 120
    for page, kept in html_text.beside_pages(150, seed=31):
        assert html_text.main_text(page).split() == kept


def test_names_inside_the_article():
    body = " ".join(f"w{k}" for k in range(60))
    page = (
        f"<article><h1>T</h1><h2 id='discussion'>Talk</h2><p id='side-effects'>some effects</p><section id='related-work'><p>{body}</p></section><section id='discussion'>short</section>"
        f"<div class='notice'>{body}</div><div class='notice'>cookies</div><div class='my-ad'>buy</div><div class='related-posts'>{body}</div><section id='comments'>{body}</section><div class='discussion'><a href=x>{body}</a></div><p>end</p></article>"
    )
    assert html_text.main_text(page) == f"T\n\nTalk\n\nsome effects\n\n{body}\n\nshort\n\n{body}\n\nend"


def test_the_scan_decides(monkeypatch):
    """Neither the whole page in place of the best region nor flat weights give the main texts."""
    pages = html_text.labelled_pages(40, seed=5) + html_text.boxed_pages(40, seed=6)
    right = lambda weights=None: sum(html_text.main_text(p, weights).split() == kept for p, kept in pages)
    assert right() == len(pages)
    assert right(html_text.Weights({"any": 1.0}, {"<other>": -0.05}, html_text.learned().sides)) < 10
    monkeypatch.setattr(html_text, "best_region", lambda scores: (0, len(scores)))
    assert right() < 10


def test_scan_decides_on_the_tables_pages(spark, small, monkeypatch):
    pages = [r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    texts = [html_text.main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "best_region", lambda scores: (0, len(scores)))
    assert not any(html_text.main_text(p) == t for p, t in zip(pages, texts))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (
            "<html><body><table><tr><td><a href=/>Home</a><br><a href=/a>News</a><br><a href=/b>Sport</a></td><td><h1>Flood in the valley</h1><p>The river rose by two metres on Monday night.</p><p>Nobody was hurt.</p></td></tr></table><div class=foot>Imprint</div></body></html>",
            "Flood in the valley\n\nThe river rose by two metres on Monday night.\n\nNobody was hurt.",
        ),
        (
            "<body><div id=top><span>ACME</span></div><div id=col1><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div><div id=col2><h2>How bees dance</h2>Bees tell each other where food is by dancing in the dark of the hive.<br><br>"
            "The angle gives the direction.<div class=social-history>Their social history goes back many millions of years.</div></div><div id=col3><b>Read also</b> <a href=3>Wasps and their nests</a> <a href=4>Ants</a></div></body>",
            "How bees dance\n\nBees tell each other where food is by dancing in the dark of the hive. The angle gives the direction.\n\nTheir social history goes back many millions of years.",
        ),
        (
            "<article><h1>T</h1><p>One two three four five.</p><section class='social-history'><p>A short text here.</p></section><div class='search-results-analysis'><p>Another one.</p></div><div class='comment-on-policy'><p>A third, which is short too.</p></div><p>End.</p></article>",
            "T\n\nOne two three four five.\n\nA short text here.\n\nAnother one.\n\nA third, which is short too.\n\nEnd.",
        ),
        (
            "<body><header><a href=/>Logo</a></header><section><h1>Bread</h1><p>Mix flour and water.</p><ol><li>Knead it for ten minutes.</li><li>Let it rest.</li></ol><aside>Buy our flour</aside><p>Bake.</p></section>"
            "<section id=comments><p>I tried it and it is very good indeed, thanks a lot for this recipe!</p></section><footer>Imprint</footer></body>",
            "Bread\n\nMix flour and water.\n\nKnead it for ten minutes.\n\nLet it rest.\n\nBake.",
        ),
    ],
)
def test_layouts_written_by_hand(page, text):
    assert html_text.main_text(page) == text


def test_hostile_pages_are_read_in_linear_time(lines_run):
    shapes = ("<div>{n}</i>{n}", "<p><button>{n}<b>{n}<h1>{n}", "<div class='my-ad'>x {n}", "<div>{n}</div>{n}", "<b><i>{n}x</b></i>{n}", "<article>x{n}</nav>{n}")
    for shape in shapes:
        work = [lines_run(html_text.main_text, "".join(part * n for part in shape.split("{n}"))) for n in (2_000, 16_000)]
        assert work[1] < 9 * work[0], (shape, work)


SAID = "The committee met on Monday and looked at the samples that were taken in the spring."
MENU = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav>"


@pytest.mark.parametrize(
    "inside, text",
    [
        (f"<p>{SAID}</p><p><a href='/r'>Read the full report on the commission site</a></p><p>{SAID}</p>", f"{SAID}\n\nRead the full report on the commission site\n\n{SAID}"),
        (f"<p>{SAID}</p><h2>Sources</h2><ul><li><a href='/1'>First source</a></li><li><a href='/2'>Second one</a></li></ul>", f"{SAID}\n\nSources\n\nFirst source\n\nSecond one"),
        (f"<p>{SAID}</p><table><tr><td><a href='/x'>Sample nine</a></td><td>clean</td></tr></table>", f"{SAID}\n\nSample nine\n\nclean"),
        ("<p><a href='/x'>The only paragraph is a link</a></p>", "The only paragraph is a link"),
        ("<p>The area of it is <math><mi>a</mi><mo>=</mo><mi>b</mi><annotation>tex</annotation></math> as all know who read this text.</p>", "The area of it is a=b as all know who read this text."),
        (f"<p>{SAID}</p><div class='related'><ul><li><a href='/1'>Some other story</a></li></ul></div><aside><p><a href='/z'>Buy now</a></p></aside><div><a href='/a'>One</a> <a href='/b'>Two</a></div>", SAID),
    ],
)
@pytest.mark.parametrize("element", ["article", "main"])
def test_links_that_are_text_of_the_article(element, inside, text):
    """Linked paragraphs, items, cells and formulas stay; boxes of links and bare links still go."""
    page = f"<html><body>{MENU}<{element}>{inside}</{element}><footer><ul><li><a href='/i'>Imprint</a></li></ul></footer></body></html>"
    assert html_text.main_text(page) == text


def test_held_out_pages_with_linked_text():
    """Layouts under another seed: the words kept and those left out, all distinct."""
    right = wrong = kept_in_all = 0
    for page, kept in html_text.linked_pages(120, seed=4321):
        got, wanted = set(html_text.main_text(page).split()), set(kept)
        right, wrong, kept_in_all = right + len(got & wanted), wrong + len(got - wanted), kept_in_all + len(wanted)
    assert right >= 0.99 * kept_in_all and wrong <= 0.01 * kept_in_all


def test_an_item_closes_the_one_before_at_any_depth():
    """However many elements stand open in the first item, the next one ends it, and what its names said ends with it."""
    for depth in (3, 63, 64, 500):
        page = f"<article><h1>Sources</h1><p>Here is the list of what was read for this text.</p><ul><li class=advert>{'<span>' * depth}Buy one now<li>The first of the reports.<li>The second of them.</ul></article>"
        assert html_text.main_text(page) == "Sources\n\nHere is the list of what was read for this text.\n\nThe first of the reports.\n\nThe second of them."


def test_a_list_within_an_open_item_keeps_it_open():
    page = f"<article><h1>Sources</h1><ul><li>The first of the reports, {'<b>' * 100}in full<ul><li>its appendix to read</ul> and the index of it</ul><p>The end of the list.</article>"
    assert html_text.main_text(page).split() == "Sources The first of the reports, in full its appendix to read and the index of it The end of the list.".split()
