import random
import time

import pytest

from gridloom.llm.html_text import extract, main_text

PARTS = {
    "head": "<head><meta charset=utf-8><title>No, never</title><style>p{margin:0}</style><script>var t='</p>';</script></head>",
    "nav": "<nav><ul><li><a href='/a'>Alpha</a></li><li><a href='/b'>Beta, gamma.</a></li></ul></nav>",
    "ad": "<div class=\"ad\">Buy this, now. Really, it is a long advert, with commas, and so on.</div><!-- ad <p>no</p> -->",
    "cookie": "<div id='cookie-banner' role=dialog><p>We use cookies, as all do.</p></div>",
    "side": "<aside><h2>More</h2><p>Side story, short.</p></aside>",
    "form": "<form><label>Mail</label><input name=q><button>Send</button></form>",
    "comments": "<section class='comments'><h2>Comments</h2><article class='comment'><p>I think, therefore, that this is a very long comment, dear author.</p></article></section>",
    "footer": "<footer>&copy; 2020 &middot; All rights, reserved.",
}
WORDS = "alpha beta, gamma. delta; épsilon 日本語 zeta! eta theta".split()


def page(rng):
    blocks = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 60))) for _ in range(rng.randrange(1, 9))]
    marked = [b.replace("beta,", "<b>beta</b>,").replace("delta;", "delta&#59;").replace(" zeta!", "\n\t<i>zeta</i>!") for b in blocks]
    title = "A title &amp; more"
    body = f"<h1>{title}</h1>" + "".join(f"<p>{b}</p>" if rng.random() < 0.7 else f"<p>{b}" for b in marked)
    wrap = rng.choice([("<article>", "</article>"), ("<main id='m'>", "</main>"), ("<div class='entry-body'>", "</div>")])
    before = "".join(PARTS[k] for k in ("head", "nav", "ad", "cookie") if rng.random() < 0.8)
    after = "".join(PARTS[k] for k in ("side", "form", "comments", "footer") if rng.random() < 0.8)
    return f"<!DOCTYPE html><html lang=en>{before}<body>{wrap[0]}{body}{wrap[1]}{after}", "\n\n".join(["A title & more", *blocks])


def test_pages_made_from_known_text(spark):
    rng = random.Random(0)
    pages = [page(rng) for _ in range(150)]
    rows = [(i, f"http://x/{i}", h, 1) for i, (h, _) in enumerate(pages)] + [(None, None, None, 1), (900, "u", "", 2), (901, "u", "<nav>only</nav>", 3), (0, "http://x/0", pages[0][0], 1)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(3)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r for r in got}
    wrong = [i for i, (_, want) in enumerate(pages) if by[i].text != want]
    assert not wrong, [(pages[i][1][:200], by[i].text[:200]) for i in wrong[:2]]
    assert by[None].text == by[900].text == by[901].text == ""


def test_blocks_and_references():
    assert main_text("<article><p>a&nbsp;b &lt;c&gt; &#x41;<br>d<p>e<ul><li>f<li>g</ul><table><tr><td>1<td>2</table></article>") == "a b <c> A d\n\ne\n\nf\n\ng\n\n1 2"
    assert main_text("plain, text < 3 & more") == "plain, text < 3 & more"


LONG = " ".join(f"This is sentence {k}, of some length; it goes on." for k in range(8))
FIVE = [f"{LONG} {k}" for k in range(5)]


@pytest.mark.parametrize("wrap", ["div class='content no-sidebar'", "div class='site-content has-sidebar'", "div class='post with-comments'", "div id=side-by-side", "div class='tags-page'", "form action='/post'", "div class=plain", "div class=sidebar", "main", "div role=search"])
@pytest.mark.parametrize("after", ["", f"<section class=comments><p>{LONG * 12}</p></section>", "<div><a href=x>Home</a> <a href=y>About</a></div><div>(c) 2020 Some, Inc.</div>"])
def test_names_do_not_delete_the_page(wrap, after):
    body = "".join(f"<p>{p}</p>" for p in FIVE)
    source = f"<html><body><nav>Top</nav><{wrap}><h1>Title</h1>{body}</{wrap.split()[0]}>{after}</body></html>"
    assert main_text(source) == "\n\n".join(["Title", *FIVE])


def test_scores_select_where_no_name_helps():
    links = "<div><a href=/a>Home page</a> <a href=/b>About us</a> <a href=/c>Contact</a></div>"
    rights = "<div><span>(c) 2020 Some Company</span></div>"
    body = "".join(f"<p>{p}</p>" for p in FIVE)
    for source in (f"<body>{links}<div><h1>T</h1>{body}</div>{rights}</body>", f"<body>{links}<div><div><h1>T</h1></div>{body}<div><ul><li><a href=/x>Share</a></ul></div></div>{rights}</body>", f"{links}<h1>T</h1>{body}{rights}"):
        assert main_text(source) == "\n\n".join(["T", *FIVE])
        assert main_text(source, threshold=0) != main_text(source)  # everything counts
    quote = "Another passage, " + LONG[5:150]
    parts = f"<body><div>{body}</div><div class=second><blockquote>{quote}</blockquote></div></body>"
    assert quote in main_text(parts) and quote not in main_text(parts, threshold=1e9)  # the best path alone


def test_small_articles_with_long_adverts():
    advert = f"<div class=ad>{LONG}</div>"
    assert main_text(f"<body>{advert}<article><h1>T</h1><p>Short.</p></article><footer>f, f, f</footer>") == "T\n\nShort."


def test_broken_and_deep_pages_take_linear_time():
    pages = ['<a href="' * 20_000, "<" * 200_000, "<!-- " * 20_000, "<p class='" * 20_000, "<div>" * 3000 + "x, y." + "</div>" * 3000, "<script>" * 5000, "<div>a, b." * 5000, '<a b="c>x ' * 20_000, "<svg>" * 20_000, "<b>" * 20_000 + "<p></p>" * 20_000, "<li><ul>" + "<b>" * 20_000 + "<li></li>" * 20_000, "<div>" * 20_000 + "</p>" * 20_000]
    for text in pages:
        start = time.time()
        main_text(text)
        assert time.time() - start < 5, text[:20]
    assert main_text("<div>a, b." * 50) == "\n\n".join(["a, b."] * 50)


def test_empty(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
