import html
import random
import re
import time
import zlib

import numpy as np

from tessera.llm import html_text, language_id
from tessera.llm.common import table


def test_held_out_accuracy(spark, sf):
    rows = language_id.op4_language_id(spark, sf)
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    joined = rows.join(docs, "doc_id").collect()
    assert len(joined) == docs.count()
    held = [r for r in joined if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in joined)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in joined)


def test_odd_texts(odd, none, make):
    model = language_id.train(odd)
    rows = language_id.predict(odd, model).collect()
    assert len(rows) == 14
    for r in rows:
        assert r["lang_pred"] in ("und", "en", "de") and 0 <= r["score"] <= 1
        if r["doc_id"] in (0, 1, 2, 4):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert language_id.predict(none, language_id.train(none)).collect() == []
    unlabelled = make([(1, "hello there"), (2, None)])
    assert {r["lang_pred"] for r in language_id.predict(unlabelled, language_id.train(unlabelled)).collect()} == {"und"}
    assert language_id.keep_languages(odd, model, 0.0).columns == odd.columns


def test_sample_is_bounded_and_leaves_out_the_held_out_part(make):
    docs = make([(k, f"text number {k}", "en") for k in range(400)] + [(k, "même texte", "fr") for k in range(400, 420)])
    sample = language_id.labelled_sample(docs, 50).collect()
    assert sum(r["lang"] == "en" for r in sample) <= 50 and sum(r["lang"] == "fr" for r in sample) == sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(400, 420))
    ids = [int(r["text"].rsplit(" ", 1)[1]) for r in sample if r["lang"] == "en"]
    assert ids and all(zlib.crc32(str(k).encode()) % 4 != 2 for k in ids)


def test_machine_separates():
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 20)).astype(np.float32)
    y = np.where(x[:, 0] - x[:, 3] > 0, 1, -1)
    w = language_id.train_machine(x, y)
    assert ((x @ w[:-1] + w[-1] > 0) == (y > 0)).mean() > 0.95


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Menu, items</a></nav>
<div class="sidebar"><p>Side, text, that is long enough to count as a paragraph with commas, really.</p></div>
<div class="content"><h2>Head &amp; line</h2><p>First paragraph, long enough to be counted,\n with some commas, and <a href=x>link</a>.<p>Second &lt;b&gt; one, with more words, to be kept as well, indeed.
<ul><li>one</li><li>two</ul><div class="ad">Buy, now, this</div><script>if(a<b){"</p>"}</script></div>
<div id="comments"><p>Reader one says, this is great, really great stuff, and I like it a lot.</p></div><form><p>Subscribe, now, please, to this</p></form>
<div role="alert">We use cookies, for all sorts of things, as you know, don't you?</div><footer>(c)</footer></body></html>"""


def test_article_without_its_surroundings():
    assert html_text.main_text(PAGE) == "Head & line\nFirst paragraph, long enough to be counted, with some commas, and link.\nSecond <b> one, with more words, to be kept as well, indeed.\none\ntwo"


def test_odd_pages(spark):
    pages = [None, "", "plain text only", "<p>a<b>c</b> d", "<div>" * 20_000 + "x", "<a " * 50_000, "<!-- never closed", "<p>x</p>" * 5000, "a < b & c &nbsp; &#x41;", "<script>never closed"]
    df = spark.createDataFrame([(k % 9, None, p, "x") for k, p in enumerate(pages)], "page_id long, url string, html string, text string")
    rows = html_text.extract(df).collect()
    assert len(rows) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert html_text.main_text(pages[2]) == "plain text only" and html_text.main_text(pages[3]) == "ac d"
    assert html_text.main_text(pages[7]).count("\n") == 4999 and html_text.main_text(pages[8]) == "a < b & c A"
    assert html_text.extract(df.limit(0)).collect() == []


LONG = "A paragraph, long enough, with commas, to be scored as text of an article, indeed it is."
#: What stands in an article, and the blocks that it gives.
INSIDE = {
    "<button>Share</button>": [], "<p>See <label>x</label> tail</p>": ["See x tail"], "<p>a <button>Share</button> b": ["a b"], "<select><option>x</select>": [], "<datalist><option>x</datalist>": [],
    "<p title='hidden gem'>gem</p>": ["gem"], '<p data-hidden="false">shown</p>': ["shown"], '<p data-role="dialog">said</p>': ["said"], "<p title=it's>q</p>": ["q"], "<p hidden>x</p>": [], '<p style="display: none">x</p>': [],
    '<div class="navy">navy</div>': ["navy"], '<div class="commentary">words</div>': ["words"], '<div class="comment">x</div>': [], '<div class="post-comments">x</div>': [], '<div class="has-sidebar"><p>y</p></div>': ["y"], '<div class="share-buttons">x</div>': [],
    "<ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul>": ["one", "two"], "<form><label>x</label><p>x</p></form>": [], "<fieldset><p>x</p></fieldset>": [], "<menu><li>x</menu>": [], "<aside><p>x</p></aside>": [],
    "<figure><img src=x><figcaption>under it</figcaption></figure>": ["under it"], "<table><caption>over it</caption><tr><th>a<th>b<tr><td>1<td>2</table>": ["over it", "a", "b", "1", "2"], "<dl><dt>t<dd>d</dl>": ["t", "d"],
    "<p>x<svg/>y<svg><title>t</title><text>x</text></svg>z</p>": ["xyz"], "<script>'</p>'</script >": [], "<p>a <b>b<br><p>c": ["a b", "c"], "<li>a<li>b<div><li>c": ["a", "b", "c"], "<h2>x<h3>y</h3>": ["x", "y"],
    "<p>it&#39;s &amp; &nbsp; so <!-- c > d --> y": ["it's & so y"], "<p>1 < 2 <3</p>": ["1 < 2 <3"], "<header><h2>Own head</h2></header>": ["Own head"], "<div><table><tr><td></div>in</table>": ["in"],
}


def test_nothing_of_an_article_is_lost():
    for inside, want in INSIDE.items():
        page = f"<html><body><nav>Menu</nav><div class=ad>{LONG}</div><article><h1>Title</h1><p>{LONG}</p>{inside}<p>The end.</p></article><footer>x</footer></body></html>"
        assert html_text.main_text(page).split("\n") == ["Title", LONG, *want, "The end."], inside


def test_generated_pages():
    """Pages put together from parts whose text is known, in articles named by an element, by a class or not at all."""
    r = random.Random(4)
    paragraphs = lambda: [" ".join(r.choices("some words, of a text, that goes on".split(), k=r.randint(20, 60))) for _ in range(r.randint(4, 9))]
    around = ["<nav><ul><li><a href=1>Home</a></ul></nav>", f"<aside>{LONG}</aside>", f"<div class='sidebar'><p>{LONG}</p></div>", f"<form><p>{LONG}</p><input></form>", f"<section id='comments'><p>{LONG}</p></section>", "<ul><li><a href=1>About us</a><li><a href=2>Press</a></ul>", f"<div role=alert>{LONG}</div>"]
    inside = [(h, w) for h, w in INSIDE.items() if "header" not in h and not h.startswith("<li>") and "<td></div>" not in h]
    for n in range(300):
        body, want = [], []
        for p in paragraphs():
            body.append(f"<p>{p}</p>")
            want.append(p)
            if r.random() < 0.5:
                h, w = r.choice(inside)
                body.append(h)
                want += w
        body.append("<p>The end.</p>")
        want.append("The end.")
        opening, closing = [("<article>", "</article>"), ("<main>", "</main>"), ("<div class='entry-content'>", "</div>"), ("<div>", "</div>")][n % 4]
        before, behind = ("".join(r.sample(around, r.randint(0, 3))) for _ in range(2))
        page = f"<!DOCTYPE html><html><body><header><a href=/>Site</a></header>{before}{opening}{''.join(body)}{closing}{behind}<footer>x</footer></body></html>"
        assert html_text.main_text(page).split("\n") == want, page


def test_odd_markup_takes_time_in_proportion():
    for source in ("<svg/>", "<textarea>", "<p title='x>", "<i></b>", "<b><div></b>", "<li>", "<table><tr><td>", "<article>", "<div>x", "<span hidden>x</p>", "<a href=x>y", "<p a=b "):
        began = time.perf_counter()
        html_text.main_text(source * 5_000 + ">")
        once = time.perf_counter() - began
        html_text.main_text(source * 20_000 + ">")
        assert time.perf_counter() - began - once < 10 * once + 0.5, source


def test_pages_of_the_small_table(spark, sf):
    rows = {r["page_id"]: r["text"] for r in html_text.op5_html_extraction(spark, sf).collect()}
    for p in table(spark, sf, "pages").collect():
        inner = p["html"].split("<article>", 1)[1].split("</article>", 1)[0]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", inner))
        assert rows[p["page_id"]].replace("\n", " ") == " ".join(b for b in blocks if b)


#: Names whose last word says what an element is, beside words that containers of articles have too, and names that only look like it.
APART_NAMES = ["main-menu", "main-nav", "page-header", "page-footer", "content-ad", "main-banner", "mainBanner", "story-newsletter", "commentlist", "comment-list", "discussion", "user-reviews", "post-responses", "body_toolbar", "page-breadcrumbs", "post-share", "text-legal"]
KEPT_NAMES = ["menu-page", "footer-content", "entry-header", "post-header", "navy", "film-review", "commentary", "has-sidebar", "article-body", "banner-story-text"]


def test_the_last_word_of_a_name_decides():
    r = random.Random(8)
    compound = [f"{a}{s}{b}" for a in ("main", "page", "post", "content", "body", "story", "text") for s in "-_" for b in r.sample(sorted(html_text.ASIDE_WORDS - {"header"}), 6)]
    for name in APART_NAMES + compound:
        for attribute in (f'class="{name}"', f'id="{name}"', f'class="x1 {name} wide"'):
            aside = f"<div {attribute}><p>{LONG}</p><p>{LONG}</p></div>"
            article = f"<p>One. {LONG}</p>{{}}<p>Two. {LONG}</p>"
            want = f"One. {LONG}\nTwo. {LONG}"
            for opening, closing in (("<article>", "</article>"), ("<div id=content>", "</div>"), ("<div>", "</div>")):
                places = (f"{opening}{article.format(aside)}{closing}", f"{aside}{opening}{article.format('')}{closing}", f"{opening}{article.format('')}{closing}{aside}")
                for body in places[0 if opening != "<div>" else 1 :]:
                    assert html_text.main_text(f"<html><body>{body}</body></html>") == want, body


def test_names_that_begin_with_an_aside_word_stay():
    for name in KEPT_NAMES:
        page = f'<html><body><article><p>One. {LONG}</p><div class="{name}"><p>{LONG}</p></div></article></body></html>'
        assert html_text.main_text(page) == f"One. {LONG}\n{LONG}", name
