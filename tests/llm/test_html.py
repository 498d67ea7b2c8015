"""Operator 12: held-out page plans, the given pages, and odd markup."""

import html
import re
import time

import pytest

from replaygate.llm import html_extraction as H

# plans that share no layout with the training ones
HELD_OUT = (
    "<div class='site-nav'><a>{-1}</a><a>{-2}</a></div><article class='post'><h1>{+5}</h1><p>{+2}</p><p>{+44}</p><div class='ad-slot'>{-9}</div><p>{+7}</p></article><section id='reader-comments'><div class='comment'><p>{-40}</p></div></section>",
    "<div role='navigation'><ul><li>{-1}</li></ul></div><div role='main'><h2>{+3}</h2><p>{+80}</p><ol><li>{+5}</li><li>{+9}</li></ol></div><div class='subscribe-box'><p>{-12}</p></div><footer><p>{-40}</p></footer>",
    "<div id='gdpr-consent'>{-35}</div><main><article><header><h1>{+4}</h1></header><section><p>{+15}</p><p>{+1}</p></section></article></main><aside><p>{-60}</p></aside>",
    "<p><a>{-1}</a> <a>{-1}</a> <a>{-1}</a></p><h1>{+9}</h1><p>{+52}</p><p>{+41}</p><p>{+38}</p><p><a>{-3}</a></p>",
    "<article><h1>{+2}</h1><p>{+3}</p><p>{+4}</p></article><div class='sidebar-widget'><p>{-30}</p></div><form><p>{-8}</p></form>",
    "<header><nav><a>{-1}</a></nav><p>{-6}</p></header><div class='notice'>{-14}</div><div class='story'><p>{+33}</p><figure><figcaption>{+6}</figcaption></figure><p>{+21}</p></div><div id='disqus_thread'><p>{-25}</p></div>",
)


@pytest.fixture(scope="module")
def tree():
    return H.train_tree(*H.labelled_blocks())


def test_held_out_plans(tree):
    x, y = H.labelled_blocks(HELD_OUT, 10)
    assert ((H.classify(tree, x) > 0.5) == y).mean() >= 0.98


def test_tree_uses_the_best_split():
    import numpy as np
    x = np.array([[0, 5], [1, 5], [2, 1], [3, 1]], dtype=float)
    assert H.train_tree(x, np.array([False, False, True, True]), least=1) == (0, 1.5, 0.0, 1.0)
    assert H.train_tree(x, np.array([True] * 4)) == 1.0


def test_given_pages(spark):
    from tests.conftest import SF001
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF001}/pages.parquet").collect()}
    rows = H.query(spark, SF001).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        body = re.search("<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", body))).split())
        assert r["text"] == want and r["n_chars"] == len(want)


def texts(page):
    return [b[0] for b in H.blocks(page)]


def test_blocks_of_odd_markup():
    assert texts("<p>a<b>c</b>d &copy;&nbsp; x<br>y") == ["acd © x", "y"]
    assert texts("<script>var a='<p>x</p>'</script><p>a<!-- <p>no</p> -->b<style>q{}</style>c") == ["ab", "c"]
    assert texts("a < b &amp;lt; c</span></p><p hidden>no</p><p title='a>b'>d</p>") == ["a < b &lt; c", "d"]
    assert texts("<p>one<p>two<ul><li>three<li>four</ul>five") == ["one", "two", "three", "four", "five"]
    assert texts("") == [] and texts("<") == ["<"] and texts("<!-- open <p>no") == []
    assert H.blocks("<nav><a>x y</a></nav>")[0][1] == 2


def test_very_long_pages_take_linear_time(tree):
    for page in ("<div>x" * 50_000, "<b>x" * 50_000, "<a <a " * 50_000, "</span>x" * 50_000, "<a x='>" * 50_001, "<p><b>y" * 50_000, "<!-- " * 50_000):
        start = time.time()
        H.main_text(page, tree)
        assert time.time() - start < 5
    page = "<nav><a>m</a></nav><article><p>" + "word " * 400_000 + "</p></article><footer>f</footer>"
    assert H.main_text(page, tree) == ("word " * 400_000).strip()


def test_rows_without_text_repeats_and_clashing_columns(spark, tree):
    body = "<nav><a>m</a></nav><article><h1>t u</h1><p>v w x</p></article><footer>f</footer>"
    rows = [(1, None, "a", 7), (2, "", "b", 8), (None, body, None, 9), (3, body, "c", 10), (3, body, "c", 10), (4, "<nav>x</nav>", "d", 11)]
    df = spark.createDataFrame(rows, "page_id long, html string, __text string, text int")
    got = sorted(((r["page_id"] or 0, r["__text"], r["text"]) for r in H.extract(df).collect()), key=str)
    main = "t u v w x"
    assert got == sorted([(1, "a", ""), (2, "b", ""), (0, None, main), (3, "c", main), (3, "c", main), (4, "d", "")], key=str)
    assert H.extract(df.limit(0)).collect() == []
