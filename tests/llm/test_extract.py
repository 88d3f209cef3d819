import itertools
import random
import time

from recoup.llm import extract


def cost(label, odds, edges):
    c = sum(max(0, round(1000 * o)) if not x else max(0, round(-1000 * o)) for x, o in zip(label, odds, strict=True))
    return c + sum(round(1000 * w) for a, b, w in edges if label[a] != label[b])


def test_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randrange(1, 9)
        odds = [rng.choice([-1, 1]) * rng.random() * rng.choice([0.5, 3]) for _ in range(n)]
        edges = [(i, i + 1, rng.random() * 2) for i in range(n - 1)] + [(rng.randrange(n), rng.randrange(n), rng.random()) for _ in range(rng.randrange(4))]
        edges = [e for e in edges if e[0] != e[1]]
        best = min(cost(x, odds, edges) for x in itertools.product([True, False], repeat=n))
        assert cost(extract.minimum_cut(odds, edges), odds, edges) == best


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy this, now. It is cheap.</div>
<article><h1>Title &amp; more</h1><p><b>First  para&nbsp;graph,
with a break<br>and <i>markup</i>.<p>Second &lt;one&gt; &copy; <a href=x>linked words</a> go on.</p>
<div class="share-bar">Share this</div><ul><li>Item one<li>Item two</ul><form><input value=x>Send</form>
<table><tr><td>A<td>B<tr><td>C</table></article><aside>Side text here.</aside>
<section id="comments"><p>I love this. What a great article, really, thanks.</p></section><footer>&copy; site</footer></body></html>"""


def test_a_page():
    assert extract.main_text(PAGE).split("\n\n") == [
        "Title & more", "First para graph, with a break and markup.", "Second <one> © linked words go on.", "Item one", "Item two", "A", "B", "C"]


def test_a_page_without_an_article():
    page = ('<body><div class="menu"><a href=x>Home</a> <a>About</a></div><div><p>This is a long paragraph of text, with commas. And sentences that go on.</p>'
            '<p>Short one.</p><p>Another long paragraph of text here, and it has many words. Yes.</p></div><div id="comments"><p>I love this. Great article, thanks.</p>'
            '</div><div>Copyright 2020 <a>Terms</a></div></body>')
    assert [t.split()[0] for t in extract.main_text(page).split("\n\n")] == ["This", "Short", "Another"]


def test_broken_markup():
    for page in ("<", "<p", "<p>a<b", "</p></div>x. y, z. long enough text to be content of a page, surely.", "<article><p class='x>a b</article>", "<script>x", "<!-- x", "&#0;&bogus;<article>1 < 2 & 3 > 2",
                 "<article><div hidden>no</div><p style='display: none'>no</p>yes</article>", "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000):
        assert isinstance(extract.main_text(page), str)
    assert extract.main_text("<article>1 < 2 & 3 > 2</article>") == "1 < 2 & 3 > 2"
    assert extract.main_text("<article><div hidden>no</div>yes</article>") == "yes"
    assert extract.main_text(None) == extract.main_text("") == extract.main_text("   ") == ""


def test_long_pages_take_linear_time():
    began = time.process_time()
    extract.main_text("<p>word, and more. " * 20_000)
    extract.main_text("<a class='" * 20_000)
    assert time.process_time() - began < 20


def test_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "y"), (2, None, None, None), (None, "v", "", "z"), (3, "w", "<article>" + "<p>a b c d e.</p>" * 30_000, "q")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, __html string")
    got = extract.extract(df.withColumnRenamed("__html", "text_")).collect()
    assert len(got) == 5 and sorted(len(r["text"]) for r in got)[:2] == [0, 0] and {r["text_"] for r in got} == {"x", "y", None, "z", "q"}
    assert max(len(r["text"]) for r in got) == 30_000 * 12 - 2
    assert extract.extract(df.limit(0)).count() == 0


TEXT = "<h1>A title</h1><p>This is a long paragraph of text, with commas. And sentences that go on.</p><p>Another long paragraph, and it has many words. Yes, it does.</p>"
WANT = "A title\n\nThis is a long paragraph of text, with commas. And sentences that go on.\n\nAnother long paragraph, and it has many words. Yes, it does."


def test_words_about_a_wrapper_do_not_drop_the_article():
    for page in ("<div class='wrap has-sidebar'>%s</div>", "<article class='post no-comments'>%s</article>", "<main id='page-with-menu'>%s</main>",
                 "<div class='sidebar-layout'><article>%s</article></div>", "<div class='menu-open wrap'><main>%s</main></div>", "<article class='post sponsored'>%s</article>"):
        rest = "<nav><a href=x>Home</a> <a href=y>About</a></nav>", "<footer>Terms of the site.</footer>"
        assert extract.main_text(rest[0] + page % TEXT + rest[1]) == WANT, page


def test_the_head_of_an_article_is_kept():
    body = TEXT.replace("<h1>A title</h1>", "")
    for head in ("<header class='entry-header'><h1>A title</h1></header>", "<div class='article-header'><h1>A title</h1></div>"):
        for page in ("<article>%s</article>", "<main>%s</main>", "<div>%s</div>"):
            assert extract.main_text(page % (head + body)) == WANT, (head, page)


def test_words_that_name_boilerplate_still_drop_it():
    comments = "<p>I love this, really. What a great article, thanks to all of you.</p>" * 9
    for page in ("<article>%s</article><div id='comments'>%s</div>", "<article>%s</article><div id='comments'><article class='comment'>%s</article></div>",
                 "<article>%s<div class='related-stories'>%s</div></article>", "<main>%s<section class='post-comments'>%s</section></main>",
                 "<div class='sidebar-layout'><article>%s</article><section id='related'><article>%s</article></section></div>"):
        assert extract.main_text(page % (TEXT, comments)) == WANT, page


def test_formulas_are_text():
    assert extract.main_text("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>") == "So x=2 holds."


def classifier_alone(page):
    found = extract.blocks(page)
    return "\n\n".join(b[0] for b, o in zip(found, extract.text_odds(found, extract.PRIOR), strict=True) if o > 0)


def test_the_cut_overrules_the_classifier():
    comments = "<p>I love this, really. What a great article, thanks to all of you.</p>" * 3
    short = "<ul><li>Salt</li><li>Two eggs</li></ul>"
    page = f"<main>{TEXT}{short}<div class='thread'>{comments}</div></main><footer><p>All the rights are ours, and we say so here. Do read the terms, please.</p></footer>"
    want = WANT + "\n\nSalt\n\nTwo eggs"
    assert extract.main_text(page) == want and classifier_alone(page) != want
    assert "Salt" not in classifier_alone(page) and "I love this" in classifier_alone(page) and "rights are ours" in classifier_alone(page)
    page = "<div><a href=a>Home</a> <a href=b>News</a></div><h1>Title</h1><p>%s</p><p>Short.</p><p>%s</p>" % (("This is a long paragraph of text, with commas. And sentences that go on. " * 3,) * 2)
    assert [t.split()[0] for t in extract.main_text(page).split("\n\n")] == ["Title", "This", "Short.", "This"]


def test_whole_pages_have_minimal_cuts():
    rng = random.Random(5)
    for _ in range(40):
        parts = [rng.choice(["<p>A sentence of some words, here. And more.</p>", "<li>item", "<a href=x>link</a>", "<nav>menu</nav>", "<div>short</div>", "<article>body text</article>"]) for _ in range(rng.randrange(1, 5))]
        page = "<div>" + "".join(parts) + "</div>"
        odds, edges = extract.graph(extract.blocks(page), extract.PRIOR)
        if len(odds) > 14:
            continue
        best = min(cost(x, odds, edges) for x in itertools.product([True, False], repeat=len(odds)))
        assert cost(extract.minimum_cut(odds, edges), odds, edges) == best


def test_weights_are_fitted_on_the_pages(spark):
    page = "<nav><a href=x>Home page</a></nav><article>" + "<p>Some sentence of the text, with words. Another one follows it.</p>" * 3 + "</article><footer>Terms</footer>"
    df = spark.createDataFrame([(i, page) for i in range(6)], "page_id long, html string")
    w = extract.fit(df)
    found = extract.blocks(page)
    assert [o > 0 for o in extract.text_odds(found, w)] == [False, True, True, True, False]
    assert (extract.fit(df.where("page_id < 0")) == extract.PRIOR).all()


def test_deep_pages_take_linear_time():
    began = time.process_time()
    deep = extract.main_text("<article>" + "<div>" * 100_000 + "<p>deep words, and more of them." + "</span></div>" * 100_000)
    extract.main_text("<p><button>" + "<div><li>" * 30_000 + "x")
    extract.main_text("<table>" + "<tr><td><div>" * 30_000 + "</em>y")
    assert deep == "deep words, and more of them." and time.process_time() - began < 20
