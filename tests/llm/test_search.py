import numpy as np
import pytest

from delimir.llm import tag_paths
from delimir.llm.pruned_graph import beam_of, build, lifted, search, shard_size
from delimir.llm.queries import op10_pruned_graph
from delimir.llm.tag_paths import blocks_of, extract


def brute(rows, k=20):
    ok = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in ok:
        if q % 20:
            continue
        near = sorted(((-float((x * y).sum()), i) for i, y in ok if i != q and len(y) == len(x)))[:k]
        out[q] = [(i, -s) for s, i in near]
    return out


def test_recall_and_form(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want, got = brute(rows), {}
    for r in op10_pruned_graph(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hits) >= 0.95
    vectors = {i: np.array(v, float) for i, v in rows}
    for q, found in got.items():
        assert len(found) == 20 and q not in dict(found)
        assert [(-s, i) for i, s in found] == sorted((-s, i) for i, s in found)
        assert all(s == pytest.approx(float((vectors[q] * vectors[i]).sum()), abs=1e-12) for i, s in found)


def test_recall_of_few_large_shards(spark):
    """Shards far beyond the least size: fewer of them, wider beams, the same recall."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want, got = brute(rows), {}
    for r in search(df, df.where("vec_id % 20 = 0"), shard=60, shards=2, beam=24).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) / len(want[q]) for q in want]) >= 0.95


def test_shard_sizes():
    assert [shard_size(n) for n in (1, 8192, 10**5, 10**6, 10**9)] == [8192, 8192, 8192, 62500, 131072]
    assert [beam_of(128, n) for n in (10, 8192, 32768, 131072)] == [128, 128, 256, 512]


def test_edges_and_copies(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [0.5, 0.5]), (8, [1.0, 2.0, 3.0]), (20, [-1.0, 0.0]), *[(k, [0.0, 1.0]) for k in range(100, 160)], (7, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "2 as row").repartition(4)
    got = {}
    for r in search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got[0][:3] == [(7, 0.5), (7, 0.5), (100, 0.0)] and len(got[0]) == 20
    assert [i for i, _ in got[100]] == list(range(101, 121))
    assert set(got) == {0, 20, 100, 120, 140}
    assert search(df.limit(0), df.limit(0)).count() == 0


def test_graph_degrees():
    x = np.random.default_rng(2).normal(size=(600, 16))
    g = build(lifted(x))
    assert g.shape == (600, 32) and (g < 600).all() and ((g >= 0).sum(1) > 4).all() and not (g == np.arange(600)[:, None]).any()


# -- pages --------------------------------------------------------------------------------------
PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="no-sidebar"><header><h1>Site</h1><p>Slogan, of sorts.</p></header>
<nav><ul><li><a href=/>Home</a><li><a href=/b>More, and more.</a></ul></nav><div class="cookie-notice"><p>We use cookies, of course. Accept them, please.</p></div>
<main><article><header><h2>A   title</h2></header><p>First <b>bold &amp; plain</b> words,<br>over two lines.</p><p>Second, with a <a href=x>link</a> &lt;tag&gt; &#233;.<ul><li>one<li>two</ul>
<script>var a = "<p>no</p>";</script><aside><p>Also, read this. It is long, very long.</p></aside><p hidden>Unseen, and so on.</p><table><tr><td>cell</table><!-- <p>no</p> --></article>
<section id="comments"><p>I think, therefore. So there, you see, I comment.</p></section><form><p>Your name, please.</p><input></form></main><footer><p>&copy; Someone, somewhere.</p></footer></body></html>"""


def test_page():
    assert blocks_of(PAGE) == ["A title", "First bold & plain words, over two lines.", "Second, with a link <tag> é.", "one", "two", "cell"]


def test_page_without_containers():
    assert blocks_of("<div id=a><h2>Title</h2><p>Prose, with commas. And more.<p>Second part, too.</div><div class=sidebar><p>Buy, now, buy.</p></div>") == ["Title", "Prose, with commas. And more.", "Second part, too."]


def test_headers_and_references():
    assert blocks_of('<div class="header"><p>Site, slogan, and more.</p></div><div class="post"><div class="post-header"><h1>A&amp;B &am<b>p;</b></h1></div><p>Text, long enough. Really, it is.</p></div>') == ["A&B &amp;", "Text, long enough. Really, it is."]


PROSE = "<p>First part, with commas. And more.</p><p>Second part, too, of prose.</p>"
TEXTS = ["First part, with commas. And more.", "Second part, too, of prose."]


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="content-sidebar-wrap"><main>{PROSE}</main><div class="sidebar"><p>Buy, now, buy.</p></div></div>',
        f'<body><div class="layout has-sidebar"><div><article>{PROSE}</article></div></div><div class="related"><article><p>Tea, ser.</p></article></div></body>',
        f'<div class="post social-policy">{PROSE}<div class="comments"><p class="comment">{"So, there. " * 50}</p></div></div>',
        f'<div class="has-sidebar"><div class="post share-price">{PROSE}</div></div><div>Tel, fax.</div>',
        f"<body><form id=aspnetForm>{PROSE}</form></body>",
        f"<form><article>{PROSE}<form><p>Your name, please.</p></form></article></form>",
        f"<body><aside>{PROSE}</aside></body>",
        f'<div class="post social"><p>Do, share.</p></div><div class="post">{PROSE}</div>',
    ],
)
def test_marks_around_content(page):
    assert blocks_of(page) == TEXTS


def test_marks_beside_content():
    long = "<p>" + "Words, and words. " * 30 + "</p>"
    assert blocks_of(f'<article>{PROSE}</article><section id="comments"><article class="comment">{long}</article></section>') == TEXTS
    assert blocks_of(f'<article>{PROSE}</article><section id="comments"><article>{long}</article></section>') == TEXTS
    assert blocks_of(f'<main>{PROSE}</main><div class="sidebar">{long}</div>') == TEXTS


@pytest.mark.parametrize("attrs", ['href="/hidden-lakes.html"', 'title="A hidden gem"', 'data-hidden="false"', 'data-state="hidden"', "data-id=ad", 'title=\'x id="ad" hidden\'', 'data-x="a>b" data-class = "ads"', "href=/hidden/id=ad", 'title="style=display:none"'])
def test_names_within_other_attributes(attrs):
    assert blocks_of(f"<article><div {attrs}>Some <b {attrs}>bold</b> words, here.</div></article>") == ["Some bold words, here."]


@pytest.mark.parametrize("attrs", ["hidden", "HIDDEN=''", "title='a' hidden", "x=y hidden", "aria-hidden = true", 'a="1"style="color:red; display: none"'])
def test_hidden_attributes(attrs):
    assert blocks_of(f"<article><p>Some <b {attrs}>unseen</b> words, here.</p></article>") == ["Some words, here."]


def test_quoted_and_repeated_attributes_are_read_once():
    assert blocks_of("<article>" + '<p a="' * 3000) == blocks_of("<p " + "a='\"' " * 3000 + "x") == []
    assert blocks_of(f"<div class='post' class=ads>{PROSE}</div><div class='x ads' id=y><p>Buy, now.</p></div>") == TEXTS


def long(words, n=30):
    return " ".join(f"{words}, {k} of it." for k in range(n))


def test_content_directly_in_body():
    body = ["Title", long("one"), long("two"), "First head", "Second head", long("three"), "An item", "Another", long("four"), "Last item"]
    t, a, b, h, i, c, x, y, d, z = body
    page = f"<div><a href=/>Home</a> <a href=/b>Blog</a></div><h1>{t}</h1><p>{a}</p><p>{b}</p><h2>{h}</h2><h3>{i}</h3><p>{c}</p><ul><li>{x}<li>{y}</ul><p>{d}</p><ol><li>{z}</ol><div>Call us</div><h3>More</h3><footer>x</footer>"
    assert blocks_of(f"<html><body>{page}</body></html>") == blocks_of(page) == body


def test_sibling_sections():
    parts = [("Head", long("first")), ("Other head", long("next", 24)), ("Third", long("last", 27))]
    page = "".join(f"<div class=s{k}><h2>{h}</h2><p>{p}</p><p>{p}</p></div>" for k, (h, p) in enumerate(parts))
    assert blocks_of(f"<body><ul><li><a href=/>Home</a></ul>{page}<p><a href=/x>Imprint</a></p></body>") == [x for h, p in parts for x in (h, p, p)]


def test_short_parts_beside_long_ones():
    page = f"<div id=a><div class=x>{long('one')}</div><div class=y>Short</div><div class=x>{long('two')}</div></div>"
    assert blocks_of(f"<body><div>Call us</div>{page}</body>") == [long("one"), "Short", long("two")]


def test_lists_of_links():
    links = "<h2>References</h2><ol><li><a href=x>A book</a><li><a href=y>A paper</a></ol>"
    want = [long("one"), long("two"), "References", "A book", "A paper"]
    page = f"<p>{want[0]}</p><p>{want[1]}</p>{links}"
    menu = "<ul><li><a href=/>Home</a><li><a href=/b>Blog</a></ul>"
    assert blocks_of(f"{menu}<article>{page}</article>{menu}") == want
    assert blocks_of(f"{menu}<main>{page}</main>{menu}") == want
    assert blocks_of(f"{menu}<div id=text>{page}</div><div>{menu}</div>") == want
    assert blocks_of(f"{menu}{links}<p>{want[0]}</p>{links}<p>{want[1]}</p>{menu}") == [want[0], *want[2:], want[1]]


FURNITURE = f'<article><h1>Title</h1><div class="tools">Print Mail</div><p>{long("one")}</p><div class="x">Rate it</div><div class="y">{long("two")}</div><section>Top</section><p>Short end</p><div class="tools">Print Mail</div></article>'


def test_ratios_decide_within_an_article(monkeypatch):
    want = ["Title", long("one"), long("two"), "Short end"]
    assert blocks_of(FURNITURE) == want
    assert blocks_of(FURNITURE, threshold=1e-9) == ["Title", "Print Mail", long("one"), "Rate it", long("two"), "Top", "Short end", "Print Mail"]
    assert long("two") not in blocks_of(FURNITURE, threshold=3)
    real = tag_paths.ratios

    def constant(blocks):
        _, _, menu = real(blocks)
        same = dict.fromkeys((b[0] for b in blocks), 1.0)
        return same, same, menu

    monkeypatch.setattr(tag_paths, "ratios", constant)
    assert blocks_of(FURNITURE) != want


def test_ratios_decide_without_containers(spark, monkeypatch):
    """The test pages with all their telling names and classes removed."""
    import re

    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    plain = [re.sub(r' class="?[\w -]*"?', "", re.sub("<(/?)(?:article|nav|footer|header|aside)", r"<\1div", p)) for p in pages]
    assert not any(re.search("<(article|nav|footer)| class=", p) for p in plain)

    def right(threshold=tag_paths.THRESHOLD):
        return sum(blocks_of(a, threshold) == blocks_of(b) for a, b in zip(plain, pages, strict=True)) / len(pages)

    usual = right()
    assert usual > 0.8 and right(1e-9) < 0.2
    real = tag_paths.ratios
    monkeypatch.setattr(tag_paths, "ratios", lambda blocks: (dict.fromkeys((b[0] for b in blocks), 1.0),) * 2 + (real(blocks)[2],))
    assert sum(blocks_of(a) == w for a, w in zip(plain, [x for x in map(blocks_of, pages)], strict=True)) / len(pages) < usual


@pytest.mark.parametrize("page", [None, "", "<", "plain & text", "<p", "<a '" * 3000, "<div>" * 3000 + "x", "<b><p>" * 3000, "<script>", "<!--", "</p>" * 3000, "<p>" + "word " * 200000])
def test_damaged_pages(page):
    assert isinstance(blocks_of(page), list)


def test_articles_of_the_test_pages(spark):
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        want = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert blocks_of(r.html) == [x for x in want if x]


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", None), (2, None, "<p>Hi, you.</p>"), (2, None, "<p>Hi, you.</p>")], "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in extract(df).select("page_id", "url", "text", "n_chars").collect() if r.page_id == 1) == [(1, "u", "", 0)]
    assert extract(df).where("text = 'Hi, you.' and n_chars = 8").count() == 2
    assert extract(df.limit(0)).count() == 0
