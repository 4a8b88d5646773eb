import os
import random
import re
import tracemalloc

import numpy as np
import pytest

from datamill.llm import htmlblocks as h
from datamill.llm.q08_html import op8_html

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<!-- ad --><div class="ad">Buy &amp; win</div><article><h1>Big  news</h1><p><b>First &lt;line&gt;,
of <i>text</i><br><p>Second&nbsp;one</p>%s</article><footer>&copy; us</footer>"""


def pages(n):
    rnd = random.Random(2)
    line = lambda: " ".join(rnd.choice("some words that make up lines of text on pages, and more of them.".split()) for _ in range(rnd.randint(3, 30)))
    return [PAGE % "".join(f"<p>{line()}</p>" for k in range(i % 7)) for i in range(n)]


def test_blocks():
    blocks = h.blocks_of(PAGE % "")
    assert [b[0] for b in blocks] == ["T", "A", "B", "Buy & win", "Big news", "First <line>, of text", "Second one", "© us"]
    assert blocks[3][1] == ("html", "body", "div", "ad") and blocks[6][1] == ("html", "body", "article", "p")
    assert blocks[4][3] == blocks[5][3] == blocks[6][3] != blocks[3][3]
    assert h.blocks_of("") == [] and [b[0] for b in h.blocks_of("plain <b")] == ["plain <b"]
    assert [b[0] for b in h.blocks_of("a<script>x</script>b<!-- c")] == ["ab"]


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("<p title=it's>Hello there</p>", ["Hello there"]),
        ("<p title=\"a > b\" x='c > d'>one</p><p a=1/>two", ["one", "two"]),
        ('<p title="open>rest</p>', ["rest"]),
        ("<p\nclass = k >x<br/>y</p >z", ["x", "y", "z"]),
        ("a<svg/>b<svg><text>no</text></svg>c<iframe src=x>no</iframe>", ["abc"]),
        ("1 < 2 and 3 > 2 &amp;lt; <3", ["1 < 2 and 3 > 2 &lt; <3"]),
        ("<noscript>on</noscript><script type='x'>if (a<b) '</p>'</script >end", ["on", "end"]),
        ("<div>" * 5000 + "deep" + "</div>" * 5000, ["deep"]),
    ],
)
def test_markup_is_read_as_browsers_do(page, blocks):
    assert [b[0] for b in h.blocks_of(page)] == blocks


def test_inline_ends_leave_blocks_open():
    blocks = h.blocks_of("<article><b>x<div id=d>one</b> two<p>three</div><p>four</article>five")
    assert [(b[0], b[1]) for b in blocks] == [
        ("x", ("article",)), ("one two", ("article", "div", "d")), ("three", ("article", "div", "d", "p")), ("four", ("article", "p")), ("five", ())
    ]
    assert [b[2] for b in h.blocks_of("<a href=x><div>in</a> out</div>")] == [2]
    assert h.blocks_of("<div>" * 100_000 + "deep")[0][0] == "deep"


def test_names():
    assert h.names_of(" class='A b' data-x=\"class=no\" id=c role class=again") == ["a", "b", "c"]
    assert h.names_of("") == []


@pytest.fixture(scope="module")
def params():
    return h.fit(pages(80))


def text_of(params, page):
    read = h.blocks_of(page)
    return [b[0] for b, y in zip(read, h.label_pages(params, [h.features_of(read)])[0]) if y >= 0.5]


def word_list(page):
    return [b[0] for b in h.blocks_of(page) if h.spoken_label(b) == 1]


def test_articles_in_elements_without_names(params):
    rnd = random.Random(5)
    for page in pages(40):
        want = word_list(page)
        shown = re.sub(r"<(/?)(nav|article|footer)>", lambda m: f"<{m[1]}div" + ("" if m[1] else f" class=x{rnd.randrange(10**6)}") + ">", page).replace('"ad"', f'"y{rnd.randrange(10**6)}"')
        assert word_list(shown) == [] and text_of(params, shown) == want == text_of(params, page)


def test_what_is_not_the_article(params):
    extra = (
        '<div class="comments"><p>nice post, thanks for that.</p><p>me too</p></div><form><p>your name</p><button>send</button></form>'
        '<aside><p>read this as well</p></aside>'
    )
    for page in pages(20):
        assert text_of(params, page.replace("<footer>", extra + "<footer>")) == word_list(page)
        assert text_of(params, page.replace("</article>", '<div class="comments"><p>nice post</p></div></article>')) == word_list(page)


def test_names_inside_an_article_that_say_nothing_there(params):
    prose = "A paragraph of prose, number %d, that says a few things more, with commas, so that it reads like a text."
    for i, page in enumerate(pages(20)):
        for box in ('<section class="related-work"><p>%s</p></section>', '<p class="tags intro">%s</p>', '<div class="notice-board"><p>%s</p></div>'):
            assert text_of(params, page.replace("</article>", box % (prose % i) + "</article>")) == [*word_list(page), prose % i]


def test_labels_by_names():
    label = lambda path, text="some words", linked=0: h.spoken_label((text, tuple(path.split()), linked, 0))
    assert [label(p) for p in ("html body article p", "html body div", "html body nav li", "html body div ad")] == [1, -1, 0, 0]
    assert [label(p) for p in ("article section related-work ~related ~work p", "article p tags intro", "article header h1", "article div comments p", "article div comment-list ~comment ~list")] == [1, 1, 1, 0, 0]
    assert label("article div related a", linked=10) == 0 and label("aside article p") == 0 and label("main div site-header ~site ~header") == -1 and label("div site-header ~site ~header") == 0


def silent(page, rnd):
    """The page without any telling name."""
    page = re.sub(r"<(/?)(article|main|nav|header|footer|aside)\b[^>]*>", lambda m: f"<{m[1]}div>", page)
    return re.sub(r"\s(class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page)


def test_a_table_without_telling_names(spark, tmp_path):
    """Through the query: no page of the table names its article."""
    given = spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()
    rnd, want, rows = random.Random(1), {}, []
    for r in given:
        marked = re.search(r"<article>(.*?)</article>", r["html"], re.S)
        want[r["page_id"]] = "\n".join(b[0] for b in h.blocks_of(marked[1]))
        rows.append((r["page_id"], r["url"], silent(r["html"], rnd)))
    assert all("article" not in html and "class=" not in html for *_, html in rows)
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in op8_html(spark, str(tmp_path)).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)


def test_tables(spark, params):
    rows = [(1, PAGE % "", "x"), (2, None, "x"), (3, "", "x"), (None, PAGE % "", "x"), (1, PAGE % "", "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = h.extract(df, params).collect()
    assert len(got) == 5 and {r["text"] for r in got if r["page_id"] in (1, None)} == {"Big news\nFirst <line>, of text\nSecond one"}
    assert {r["text"] for r in got if r["page_id"] in (2, 3)} == {""}
    assert h.extract(df.where("page_id < 0"), params).count() == 0
    assert h.sample_pages(df) == [PAGE % ""] and h.sample_pages(df.where("page_id = 2")) == []
    quiet = spark.createDataFrame([(i, "<p>x</p>") for i in range(9)] + [(9, "x" * (h.LONGEST_PAGE + 1))], "page_id long, html string")
    assert h.sample_pages(quiet, silent=4) == ["<p>x</p>"] * 4
    unfit = h.fit([])  # names alone speak
    assert {r["text"] for r in h.extract(df.where("page_id = 3 or page_id = 1"), unfit).collect()} == {"", "Big news\nFirst <line>, of text\nSecond one"}


def test_a_very_long_page_takes_little_memory(params):
    page = PAGE % "".join(f"<p>Paragraph {k} of a long page, with words.</p>" for k in range(100_000))
    short = pages(30)
    read = [h.blocks_of(p) for p in [page, *short]]
    tracemalloc.start()
    found = h.label_pages(params, [h.features_of(b) for b in read])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 30 and (found[0] >= 0.5).sum() > 99_000
    assert all(np.allclose(a, b) for a, b in zip(found[1:], h.label_pages(params, [h.features_of(b) for b in read[1:]])))


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in h.new_params().items()}
    x, mask = rng.standard_normal((4, 2, h.INPUT)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    y, counts = rng.integers(0, 2, (4, 2)).astype(float), np.array([[1, 1], [0, 1], [1, 0], [1, 0]], bool)

    def loss(q):
        both = np.concatenate([h.run_way(q, "f", x, mask)[0], h.run_way(q, "b", x, mask)[0]], axis=2)
        z = both @ q["out"] + x @ q["own"] + q["bias"][0]
        return (np.log1p(np.exp(-z * (2 * y - 1))) * counts).sum() / counts.sum()

    g = h.gradients(p, x, mask, y, counts)
    for name, at in (("out", 3), ("fx", (5, 9)), ("bx", (7, 40)), ("fh", (2, 20)), ("bh", (3, 3)), ("fc", 17), ("bias", 0)):
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        assert abs((loss(up) - loss(down)) / 2e-4 - g[name][at]) < 1e-3


def test_a_path_is_multiplied_once(params, monkeypatch):
    """Labels are those of whole rows of features, and paths that many blocks are on make one row each."""
    some = [h.features_of(h.blocks_of(p)) for p in pages(30)]
    x, mask = h.padded([np.column_stack([h.marked(one.paths), one.rest]) for one in some])
    both = np.concatenate([h.run_way(params, way, x, mask)[0] for way in ("f", "b")], axis=2)
    want = h.sigmoid(both @ params["out"] + x @ params["own"] + params["bias"][0])
    rows, marked = [], h.marked
    monkeypatch.setattr(h, "marked", lambda paths: rows.append(len(paths)) or marked(paths))
    got = h.label_pages(params, some)
    assert all(np.allclose(found, want[: len(found), k], atol=1e-5) for k, found in enumerate(got))
    assert sum(rows) == len({c for one in some for c in one.paths}) < 20
