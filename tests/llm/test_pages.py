"""Main text of pages whose article is known, in the templates and the breakages that pages have."""

import html
import random

import pytest

from tabwright.llm import pages as p

ARTICLE = ["Title of the page", "A first paragraph with enough words to be one, and a few more besides.", "Short.", "It said “yes” & no <b>."]
PROSE = "Words follow words in this long paragraph that nobody would take for a menu entry at all. "


def test_tree_fits_its_table():
    assert all(p.judge(p.tree(), row[:-1]) == bool(row[-1]) for row in p.LABELLED)
    assert len(p.LABELLED) < 200


def test_flat_blocks():
    page = "<p>one <a href=x>two three</a><p>four<br>five<div>six</div> <script>var x = '</p>';</script>seven&amp;<!-- no -->eight"
    assert [b[:3] for b in p.blocks_of(page)] == [("one two three", 3, 2), ("four five", 2, 0), ("six", 1, 0), ("seven&eight", 2, 0)]


def inside(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style></head><body>{body}</body></html>"


def article(tag="article", extra=""):
    head, *rest = (html.escape(x) for x in ARTICLE)
    return f"<{tag}{extra}><h1>{head}</h1>" + "".join(f"<p>{x}</p>\n" for x in rest) + f"</{tag}>"


AROUND = [
    "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li></ul></nav>",
    '<div class="ad">Buy this now, it is cheap and good and you want it.</div>',
    f'<div id="sidebar"><h2>More</h2><p>{PROSE * 3}</p></div>', f"<aside>{PROSE}</aside>",
    '<div class="cookie-notice">We use cookies. <button>OK</button></div>', "<header><h2>Site name</h2><p>The slogan of the site</p></header>",
    f'<section class="comments"><h3>Comments</h3><article class="comment"><p>{PROSE * 2}</p></article></section>',
    f"<form action=/s><label>Your mail</label><input name=m><textarea>{PROSE}</textarea><button>Send</button></form>",
    f"<footer>&copy; site &middot; {PROSE}</footer>", f"<noscript>{PROSE}</noscript>", "<script>document.write('<p>no</p>')</script>",
    f"<p>{PROSE * 2}</p>",
]


@pytest.mark.parametrize("seed", range(20))
def test_article_without_its_surroundings(seed):
    rng = random.Random(seed)
    parts = rng.sample(AROUND, rng.randint(0, len(AROUND)))
    parts.insert(rng.randint(0, len(parts)), article(*rng.choice([("article",), ("main",), ("div", ' role="main"'), ("div", ' class="post-content"')])))
    page = inside("\n".join(parts))
    assert p.main_text(page) == "\n".join(ARTICLE)
    assert p.main_text(f"<form>{page}</form>") == "\n".join(ARTICLE)


def test_page_that_marks_nothing():
    body = "<div><a href=/>Home</a></div><div><a href=/x>News</a> | <a href=/y>Sport</a></div>"
    body += f"<h1>A headline here</h1><p>{PROSE * 2}</p><p>{PROSE}</p><div><a href=/z>Next page</a></div>"
    assert p.main_text(inside(body)) == "\n".join(["A headline here", (PROSE * 2).strip(), PROSE.strip()])


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), (" \n ", ""), ("<p></p>", ""), ("<article><p>a\n\t b&nbsp;c</p></article>", "a b c"),
        ("<article><p>one<p>two<b>three<p>four</article>tail <footer>x", "one\ntwothree\nfour"),
        ("<article><p>cut &amp; off &am", "cut & off &am"), ("<article><p>cut in a tag</p><di", "cut in a tag"),
        ("<article><p>a < b and c > d</p></article>", "a < b and c > d"), ("</p></div></article><article>x y</article>", "x y"),
        ("<article><p>" + "w " * 50_000, ("w " * 50_000).strip()), ("<article>" + "<div>" * 5000 + "deep", "deep"),
    ],
)
def test_odd_pages(page, text):
    assert p.main_text(page) == text


def test_rows(spark):
    rows = [(1, "u", inside(article()), "x"), (1, "u", inside(article()), "x"), (None, None, None, "x"), (2, "v", "", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = p.extract(frame)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    text = "\n".join(ARTICLE)
    assert sorted(map(str, out.collect())) == sorted(
        str(r) for r in spark.createDataFrame([(1, "u", text, len(text))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], out.schema).collect()
    )
    assert p.extract(frame.limit(0)).count() == 0


FIRST, LAST = "The first paragraph has words enough to stand here.", "The last paragraph has words enough as well."


@pytest.mark.parametrize(
    "middle",
    [
        '<section id="discussion"><h2>Discussion</h2><p>{}</p></section>', '<section class="search-methods"><p>{}</p></section>',
        '<div class="share">{}</div>', '<section id="social-history"><p>{}</p></section>', '<div class="login-flow"><p>{}</p></div>',
        '<h2 id="related-work">{}</h2>', '<div class="comment">{}</div>', '<p class="notice">{}</p>', '<div class="widget widget-text"><p>{}</p></div>',
        '<header class="header"><p>{}</p></header>',
    ],
)
def test_names_inside_an_article_may_be_its_subject(middle):
    body = f"<article><p>{FIRST}</p>{middle.format('We share what we found.')}<p>{LAST}</p></article>"
    found = p.main_text(inside(body)).split("\n")
    assert found[0] == FIRST and found[-1] == LAST and "We share what we found." in found


@pytest.mark.parametrize(
    "noise",
    [
        '<div class="share"><a href=/f>Facebook</a> <a href=/t>Twitter</a></div>', '<div class="ad-slot">Buy it now, it is cheap.</div>',
        '<div class="related-posts"><a href=/1>One more</a><a href=/2>Another one</a></div>', '<div id="comments"><p>I like it a lot.</p></div>',
        '<div class="cookie-notice">We use cookies here.</div>', "<aside>See also the others.</aside>", "<form><p>Your mail address</p></form>",
        "<footer>Posted in: things</footer>", '<div class="newsletter-signup">Sign up today for more.</div>', "<button><div>Send</div></button>",
        '<p hidden>Not shown</p>', "<svg><svg><text>x</text></svg></svg>", "<noscript><p>Turn it on</p></noscript>",
    ],
)
def test_noise_inside_an_article_goes(noise):
    assert p.main_text(inside(f"<article><p>{FIRST}</p>{noise}<p>{LAST}</p></article>")) == f"{FIRST}\n{LAST}"


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>T</title><meta charset=x><body>{}</body>", "<head><title>T</title>{}", "<head><link href=x>{}</html>",
        "<html><head><title>T</title></head><body><button>OK{}", "<body><select><option>a<option>b{}<select><option>c</select>",
        "<body><noscript>no{}", "<body><button>One<div><button>Two</button></div>{}", "<body><video src=x>{}",
    ],
)
def test_what_is_never_closed_ends_with_the_next_block(page):
    body = f"<article><p>{FIRST}</p><p>{LAST}</p></article>"
    assert p.main_text(page.format(body)) == f"{FIRST}\n{LAST}"
