"""URL cascade and main-text extraction."""

import html
import re
from itertools import product

import pytest

from armlift.llm import html_text, url_filter
from armlift.llm.registry import ALLOW, BLOCK
from armlift.llm.url_filter import Cascade

URLS = [
    None, "", "no scheme at all", "http://", "https://Example.ORG/es/1?q=1", "http://a.example.org/en/1", "x://org",
    "http://deep.sub.example.org/en/2#top", "http://shop.example.com/fr/1", "http://shop.example.com/de/1",
    "http://com/fr/", "http://notexample.org/es/", "http://m.ads-track.example.net/x", "http://ads/",
    "http://roads.example.net/", "http://a.b?c://d/org/", "http://ÉX.Org/ü", "http://casino-win.example.org/es/7",
    "https://u:p@h.example.org:80/en/1", "http://example.org/EN/1", "http://x.com\n/fr/1",
]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(r), r, v) for v, rs in (("allow", ALLOW), ("block", BLOCK)) for r in rs
            for h, p in [(r[: r.index("/")], r[r.index("/"):])]
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    labels = host.split(".")
    listed = any({w for w in label.split("-")} & set(url_filter.LISTED_WORDS) for label in labels[:-1])
    return host, path, None, "block" if listed else "allow"


def test_verdicts(spark):
    pages = spark.createDataFrame(
        [(k % 19, u, "x", 1) for k, u in enumerate(URLS + URLS[:5])], "page_id bigint, url string, host string, keys int")
    got = url_filter.judge_urls(pages, ALLOW, BLOCK).collect()
    want = sorted(((k % 19, u, *judge(u)) for k, u in enumerate(URLS + URLS[:5])), key=repr)
    assert sorted(((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in got), key=repr) == want
    assert url_filter.judge_urls(pages.limit(0), ALLOW, BLOCK).count() == 0


def test_no_rules_and_own_list(spark):
    pages = spark.createDataFrame([(1, "http://a.bad.net/x"), (2, "http://good.net/")], "page_id bigint, url string")
    listed = spark.createDataFrame([("bad.net",), (None,)], "key string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, [], [], listed).collect()}
    assert got == {1: "block", 2: "allow"}


@pytest.mark.parametrize("bits", [1, 16])
def test_cascade_is_exact_over_its_universe(spark, monkeypatch, bits):
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", bits)  # 1: far too few bits, so that many levels are needed
    monkeypatch.setattr(url_filter, "HASHES", 2)
    universe = spark.range(3000).selectExpr("array(concat('k', id), concat('z', id)) AS keys")
    listed = spark.range(0, 3500, 3).selectExpr("concat('k', id) AS key")
    cascade = Cascade.build("c", listed, universe)
    assert bits > 1 or len(cascade.levels) > 3
    from pyspark.sql import functions as F

    flat = universe.select(F.explode("keys").alias("key"))
    got = {r.key for r in cascade.attach(flat).where(cascade.listed(F.col("key"))).collect()}
    assert got == {f"k{i}" for i in range(0, 3000, 3)}


def test_registered_url_query_stays_in_the_jvm(spark, folder):
    from armlift.llm.registry import QUERIES

    for name in ("op1_url_filter", "op7_fingerprints"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


@pytest.fixture(scope="module")
def model(spark, folder):
    pages = [r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    return pages, html_text.train(pages)


def test_given_pages(model, spark, folder):
    def article(page):
        inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split())
                  for b in re.split(r"</?(?:p|h1)>", inside))
        return "\n".join(filter(None, blocks))

    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_text(
        spark.read.parquet(f"{folder}/pages.parquet")).collect()}
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert got == {r.page_id: (t := article(r.html), len(t)) for r in rows}


PAGES = {
    "<body><div class=menu><a href=a>Home</a><a href=b>About us</a></div><div id=content><h2>A story title</h2>"
    "<p>The first paragraph of the story &amp; more words.</p><ul><li>An item</li><li>Two</li></ul></div>"
    "<aside><p>A long text beside the story, with many words in it.</p></aside>"
    "<div class='cookie-notice'><p>We use cookies to improve this site for you.</p></div>"
    "<div class=comments><h3>Comments</h3><article class=comment><p>I liked this very much, thank you!</p></article>"
    "</div><form><p>Please subscribe to our letter.</p></form><footer>All rights reserved.</footer></body>":
        "A story title\nThe first paragraph of the story & more words.\nAn item\nTwo",
    "<main><article><p>Para one is here for   the\nreader.<div class=ad>Buy cheap stuff today, dear reader!</div>"
    "<table><tr><td>1<td>cell two</table><blockquote>Quote me.</blockquote></article><section id=comments>"
    "<p>Nice post, really loved every bit of it.</p></section></main>":
        "Para one is here for the reader.\n1\ncell two\nQuote me.",
    "<article><p>One<br>two <b>three</b><!-- <p>no</p> --><script>var x = '</p>';</script><p>Four a<b, c>d</article>":
        "One two three\nFour ad",
    "<p hidden>Not to be seen by anybody at all.</p><article><p>Seen.</p></article>": "Seen.",
    "": "", "<<<>": "", "<article>": "", "<article><p>&#65;&nbsp;&lt;b&gt;</p></article>": "A <b>",
}


@pytest.mark.parametrize("page", PAGES)
def test_other_pages(model, page):
    assert html_text.main_text(page, model[1]) == PAGES[page]


SHOWN = "The first words of the story stand here for all.\nMore words of it follow here, up to the end."
A, B = (f"<p>{x}</p>" for x in SHOWN.split("\n"))


@pytest.mark.parametrize("page", [
    f"<article>{A}<svg width='1'/>{B}</article>", f"<article>{A}<math/>{B}</article>", f"<article>{A}<svg><path/>{B}</article>",
    f"<article>{A}<div><select><option>One choice<option>Another choice</div>{B}</article>",
    f"<article>{A}<div><video src=a>No video for you, dear reader.</div>{B}</article>",
    f"<article>{A}<div><canvas></div><object data=a><p>A text in place of the thing.</p></object>{B}</article>",
    f"<article>{A}<noscript><p>Please switch scripts on for this.</p></noscript>{B}</article>",
    f"<article>{A.replace('words of', 'words <svg><title>t</title><text>label</text></svg>of')}{B}</article>",
    f"<article>{A.replace('all', '<math><mi>a</mi><mspace/><mi>l</mi><mo>l</mo><annotation>tex</annotation></math>')}{B}</article>",
])
def test_drawings_formulas_and_controls_take_nothing_else(model, page):
    assert html_text.main_text(page, model[1]) == SHOWN


@pytest.mark.parametrize("wrap", [
    '<body class="page page-id-2 has-sidebar"><div id="page">%s</div></body>', '<div class="formula">%s</div>',
    '<div class="page-wrap"><div class="football">%s</div></div>', '<div class="commentary footnotes">%s</div>'])
def test_names_that_only_begin_like_a_hint(model, wrap):
    page = wrap % f'<main><article class="post format-standard">{A}{B}</article></main>'
    assert html_text.main_text(page, model[1]) == SHOWN
    dom = html_text.Dom(page)
    state = html_text.labels_of(dom)
    assert state is not None and all(state[i] for i, _, _ in dom.blocks)
    assert html_text.main_text(wrap % (A + B), model[1]) == html_text.main_text(f"<div>{A}{B}</div>", model[1]) == SHOWN


def test_named_parts_win_over_class_hints():
    dom = html_text.Dom(f'<main class="legal"><article class="post has-sidebar">{A}</article><article class="comment">{B}</article></main>')
    state = html_text.labels_of(dom)
    assert [state[i] for i, _, _ in dom.blocks] == [True, False]
    for names in ("siteHeader", "pagination", "comments-list", "navBar"):
        assert html_text._hints(f'class="{names}"')[0]


STORY = "The river was low that year and people walked across it without fear."


@pytest.mark.parametrize("page, want", [
    (f"<nav><a href=x>Home</a></nav><div>{' '.join([STORY] * 20)}</div><footer>Copyright</footer>", " ".join([STORY] * 20)),
    (f"<div class=container>{STORY}<br>{STORY}<br><br>{STORY}</div><footer>Contact us</footer>", " ".join([STORY] * 3)),
    ("<section>" + f"<div>{STORY} {STORY} {STORY}</div>" * 4 + "</section>", "\n".join([" ".join([STORY] * 3)] * 4)),
    (f"<table><tr><td>{' '.join([STORY] * 8)}</td></tr></table>", " ".join([STORY] * 8)),
    (f"<div><a href=a>One</a> <a href=b>Two</a></div><div>{' '.join([STORY] * 6)}</div><div>Share this</div>", " ".join([STORY] * 6)),
])
def test_text_straight_inside_divisions(model, page, want):
    assert html_text.main_text(f"<html><body>{page}</body></html>", model[1]) == want


def test_training_pages_are_those_that_name_their_main_part(spark):
    # one page in a hundred labels itself: a sample by page_id alone would hold hardly any
    tail = "".join(f"<p>{STORY}</p>" for _ in range(5))
    rows = [(i, "u", f"<main>{tail}</main><div class=x>Read more</div>" if i % 100 == 0 else f"<div>{tail}</div>") for i in range(2000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    import re as regex

    seen = []
    train = html_text.train
    try:
        html_text.train = lambda found: seen.append(found) or train(found)
        html_text.extract_text(pages.union(pages), 15)
    finally:
        html_text.train = train
    assert len(seen[0]) == 15 and all(regex.search(html_text.NAMES_MAIN, p) for p in seen[0])


def test_page_table_with_nulls(spark):
    pages = spark.createDataFrame(
        [(1, None, None, "t"), (1, None, None, "t"), (None, "u", "<article><p>Hi there.</p></article>", "t"),
         (2, "v", "<div>" * 3000 + "<article>" + "<p>Many words in here. </p>" * 5000, "t")],
        "page_id bigint, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract_text(pages).collect()), key=repr)
    long = "\n".join(["Many words in here."] * 5000)
    assert got == sorted([(1, None, "", 0)] * 2 + [(None, "u", "Hi there.", 9), (2, "v", long, len(long))], key=repr)
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_messages_give_exact_marginals():
    parent = [-1, 0, 0, 1, 1]
    odds = [0.5, 2.0, 0.3, 4.0, 0.9]
    pairs = [[[0.8, 0.2], [0.3, 0.7]]] * 5
    weight = [0.0] * 5
    total = 0.0
    for state in product((0, 1), repeat=5):
        w = 1.0
        for i, s in enumerate(state):
            w *= odds[i] if s else 1.0
            if i:
                w *= pairs[i][state[parent[i]]][s]
        total += w
        for i, s in enumerate(state):
            weight[i] += w * s
    want = [w / (total - w) for w in weight]
    assert html_text.marginals(parent, odds, pairs) == pytest.approx(want)
