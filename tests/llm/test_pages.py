import numpy as np

from patchlore.llm import pages
from patchlore.llm.tree import train_tree

FULL = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body class="single sidebar-left"><script>var a="</p><p>no";</script>
<div id="cookie-notice"><p>We use cookies to improve this site and to measure what readers like most.</p></div>
<header><h1>The Daily</h1><p>News since ever</p></header><nav><ul><li><a href=/>Home</a></li><li>About</li></ul></nav>
<div class="content"><div class="post-header"><h1>Head&nbsp;&amp;
 line</h1></div><p>First <b>bo</b>ld <a href="x">linked</a> words.<p>Second&#8217;s text.<br>After the break</p><ul><li>point one</li><li>point two</li></ul>
<div class="advert-box">Buy this wonderful thing now, it is cheap and very good for you.</div><form><p>Your mail</p><input></form>
<section id="comments"><h3>2 comments</h3><p>I read all of this article with great pleasure and will come back for more soon.</p></section></div>
<aside><p>A long side text that looks quite like an article but is not one, whatever it says.</p></aside><footer>&copy; us</footer></body></html>"""


ARTICLE = "Head & line First bold linked words. Second’s text. After the break point one point two"


def text(html):
    return pages.main_text(html, pages.train())


def test_article_only():
    assert text(FULL) == ARTICLE


def test_page_without_article_element():
    body = "".join(f"<p>{'some plain words ' * 8}{i}.</p>" for i in range(3))
    got = text(f"<div><a href=a>Home</a> <a href=b>News</a></div>{body}<p>The end of it all, for now.</p><div><a href=c>Imprint</a></div>")
    assert got.startswith("some plain") and got.endswith("for now.") and "Home" not in got and "Imprint" not in got


def test_broken_markup():
    assert text(None) == "" and text("") == "" and text("<p>") == "" and text("<script>x") == ""
    assert text("plain text, a &lt; b &am; &#x41;") == "plain text, a < b &am; A"
    assert text("<article><p>never closed <b>words<div class='ad'>buy") == "never closed words"
    assert text("<article><p>kept</p><nav>menu") == "kept"
    assert text("<article>" + "<p>word</p>" * 20_000) == " ".join(["word"] * 20_000)


def test_omitted_end_tags_lose_no_text():
    assert text("<html><head><meta><title>x</title><body><p>main text") == "main text"
    assert text("<html><head><title>x</title><p>main text") == "main text"
    assert text("<head class=sidebar><title>x</title><style>p{}</style>main text") == "main text"
    for tag in sorted(pages.HIDDEN):
        assert text(f"<article><p>before</p><{tag} id=a><p>after</p></article>") == "before after"
        assert text(f"<article><p>before</p><{tag} id=a><p>after</p><{tag}>gone</{tag}><p>end</p></article>") == "before after end"
        assert text(f"<article><p>a<{tag}><{tag}>b</{tag}><p>c</p></{tag}>d</article>") == "ad"
    for tag in ("svg", "math"):
        assert text(f"<article><p>before</p><{tag} viewBox='0 0 1 1' /><p>after</p><{tag}>x</{tag}><p>end</article>") == "before after end"
    assert text("<article><svg><style/><title>t</title><script href=x /><text>t</text></svg><p>after</article>") == "after"
    assert text("<article><svg><style>p{}</svg><p>after</p><style>q{}</style></article>") == "after"


def test_raw_text_runs_to_its_end_tag_or_the_page_end():
    for tag in ("script", "style", "textarea", "title"):
        assert text(f"<article><p>kept</p><{tag}>gone</p><svg>") == "kept"
        assert text(f"<article><p>kept</p><{tag}>x </svg> <p>y</{tag.upper()} ><p>end</article>") == "kept end"
    assert text("<svg>" * 20_000 + "</video>" * 20_000 + "<article>word</article>") == "word"


def test_labelled_blocks_are_learned():
    rows = np.array(pages.LABELLED, dtype=float)
    tree = pages.train()
    assert ((tree.predict(rows[:, :-1]) >= 0.5) == rows[:, -1]).all()


def test_tree_splits_where_it_should():
    x = np.array([[0.0, 5], [1, 5], [2, 1], [3, 1]])
    tree = train_tree(x, np.array([0.0, 1, 1, 0]))
    assert tree.predict(x).tolist() == [0, 1, 1, 0]
    assert train_tree(x, np.ones(4)).predict(x).tolist() == [1, 1, 1, 1]


def test_extract(spark):
    rows = [(1, "u1", FULL, 9), (1, "u1", FULL, 9), (2, None, None, 9), (None, "u3", "<article>x y</article>", 9)]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int"))
    assert sorted(((r.page_id, r.url, r.text[:4], r.n_chars) for r in got.collect()), key=str) == sorted([(1, "u1", "Head", len(ARTICLE)), (1, "u1", "Head", len(ARTICLE)), (2, None, "", 0), (None, "u3", "x y", 3)], key=str)
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrappers_and_states_do_not_hide_the_article():
    body = "".join(f"<p>{'some plain words ' * 12}{i}.</p>" for i in range(3))
    want = " ".join(f"{'some plain words ' * 12}{i}." for i in range(3))
    menu = "<nav><a href=a>Home</a> <a href=b>News</a></nav>"
    for page in (
            f"{menu}<div class='site-content has-sidebar'>{body}</div>",
            f"<div class='layout-sidebar-right'>{menu}<article>{body}</article></div>",
            f"{menu}<div class='article-body read-more-wrap'>{body}</div>",
            f"{menu}<div class='entry-content no-comments'>{body}</div>",
            f"{menu}<article class='post category-social tag-comment'>{body}</article>",
            f"{menu}<div class='post category-search'>{body}</div>",
            f"<div class='page-header-large'>{menu}<article>{body}</article></div>",
            f"<form id='aspnetForm'>{menu}<main>{body}</main><footer>us</footer></form>"):
        assert text(page) == want, page
    # Comments, teasers and hidden parts stay out, whatever elements they are made of.
    more = f"<article>{body}</article>"
    for extra in ("<div id='comments'><article>{0}</article></div>", "<section class='related'><article>{0}</article></section>",
                  "<div hidden><article>{0}</article></div>", "<article class='comment'>{0}</article>", "<article id='div-comment-5' class='comment-body'>{0}</article>", "<div class='comment-body content'>{0}</div>", "<div class='post-comments'>{0}</div>", "<div class='content ad'>{0}</div>"):
        other = extra.format("<p>" + "words of somebody else " * 20 + "</p>")
        assert text(more + other) == want and text(other + more) == want, extra
