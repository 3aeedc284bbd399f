"""Element tables and selectors."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestar.sources import elements, feeds

PAGE = """<body><div class="list"><div class="card big" id="a" data-id="1"><h2><a href="/one" title='T "q"'>One <b>bold</b> <i>and <u>deep</u></i></a></h2><p>First</p><div class="card inner"><a href=x>in</a></div></div>
<div class="card" data-id=2><span><a href="http://two">Two</a></span><script>var no = "<a href=bad>";</script><p>Second<p>Third</div></div><ul><li>x<li class="last  one">y</ul></body>"""


@pytest.mark.parametrize("selector, tags", [
    ("a", ["a", "a", "a"]), ("div.card", ["div"] * 3), ("div.list > div.card", ["div"] * 2), ("div.card div.card", ["div"]), ("h2 a[href]", ["a"]), ("#a > p, span a", ["p", "a"]), ("[data-id='2'] p", ["p", "p"]),
    ("a[href^=http]", ["a"]), ("a[href$=one]", ["a"]), ("a[href*='n']", ["a"]), ("li.one", ["li"]), ("ul > li", ["li", "li"]), ("span > a", ["a"]), ("div > a", ["a"]), ("*[title]", ["a"]), ("nav a", []), ("body > a", []),
])
def test_selectors(spark, selector, tags):
    rows = elements.with_elements(spark.createDataFrame([(1, PAGE)], "k int, html string"), "html")
    nodes = F.col("page.nodes")
    assert rows.select(F.transform(elements.find(nodes, selector), lambda i: F.get(nodes, i)["tag"]).alias("t")).first().t == tags


@pytest.mark.parametrize("selector", ["", "a,,b", "a >", "!x"])
def test_what_is_no_selector(selector):
    with pytest.raises(ValueError):
        elements.parse_selector(selector)


def test_cards_hold_their_own_elements(spark):
    payloads = spark.createDataFrame([(3, PAGE), (4, None), (5, ""), (6, "<div class=card><a href=z>é <img alt=q></a>")], "ord long, payload string")
    e = elements.Element(F.col("e"))
    got = elements.cards(payloads, "div.card").select("ord", e.attr("data-id").alias("id"), e.text("a").alias("a"), e.attr("href", "a").alias("href"), e.text("p").alias("p"), e.attr("title", "a").alias("title"), e.text("nav").alias("none")).orderBy("ord").collect()
    assert [tuple(r)[1:] for r in got] == [("1", "One bold and deep", "/one", "First", 'T "q"', None), ("2", "Two", "http://two", "Second", None, None), (None, "é", "z", None, None, None)]
    assert [r.ord >> 20 for r in got] == [3, 3, 6]


def test_cards_with_nested_markup(spark):
    """The closing tags inside a card do not end it."""
    read = lambda page, engine: [(r.url, r.title, r.snippet) for r in feeds.hits_of(spark.createDataFrame([(0, page)], "ord long, payload string"), engine).orderBy("ord").collect()]
    duck = '<div class="result"><div class="x"><div><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fthree.example%2F"><span>Th<b>ir</b>d</span></a></div></div><div class="result__snippet"><div>A</div> <div>b &amp; c</div></div></div><div class="result"><a class="result__a" href="https://four.example">4</a></div>'
    assert read(duck, "duckduckgo") == [("https://three.example/", "Third", "A b & c"), ("https://four.example", "4", "")]
    many = "".join(f'<li class="b_algo"><h2><a href="https://h.example/{k}">{k}</a></h2><p>s</p></li>' for k in range(1500))
    assert len(read(many, "bing")) == 1500
    steam = '<a class="search_result_row ds" data-ds-appid="10,11" href="https://s/app/10?x=1"><div><span class="title">Ga<i>m</i>e</span></div><div class="search_released"><div>1 Feb, 2020</div></div><div><div class="discount_final_price">5€</div></div><img src="p"></a>'
    (r,) = feeds.steam(spark.createDataFrame([(steam,)], "payload string")).collect()
    assert (r.id, r.title, r.canonical_url, r.publication_date.year, r.description, r.thumbnail_url) == ("steam:10", "Game", "https://s/app/10", 2020, "Steam game — released 1 Feb, 2020, 5€", "p")
    itch = '<div class="game_cell x"><div><a class="title game_link" href="https://me.itch.io/g"><b>My</b> game</a></div><div class="game_text"><div>Fun</div></div><div class="game_genre">Puzzle</div></div><div class="game_cell"><a href="https://you.itch.io/h">H</a></div>'
    r, s = feeds.itchio(spark.createDataFrame([(itch,)], "payload string")).orderBy("ord").collect()
    assert (r.title, r.description, r.uploader_name, r.tags[-1]) == ("My game", "Fun", "me", "puzzle") and (s.title, s.canonical_url) == ("h", "https://you.itch.io/h")


def test_elements_of_a_table(spark, sf_dir):
    """Every link of the supplied pages, by selector and by pattern."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    nodes = F.col("page.nodes")
    got = elements.with_elements(pages, "html").select("page_id", F.size(elements.find(nodes, "a[href]")).alias("n")).agg(F.sum("n")).first()[0]
    assert got == pages.select(F.expr("regexp_count(html, '<a [^>]*href=')").alias("n")).agg(F.sum("n")).first()[0]
    assert json.dumps(elements.read("<p>x")) == '{"text": "x", "nodes": [{"tag": "p", "attrs": [], "parent": -1, "last": 0, "start": 0, "stop": 1}]}'


def test_a_page_of_very_many_cards(spark):
    """The time of a page grows with its length: each card is cut out once, and holds only its own elements."""
    many = "<ol>" + "".join(f'<li class="b_algo"><h2><a href="https://h.example/{k}">{k} <b>x</b></a></h2><p>s</p></li>' for k in range(20_000))
    got = feeds.hits_of(spark.createDataFrame([(0, many)], "ord long, payload string"), "bing").selectExpr("count(distinct url)", "sum(if(title = concat(ord, ' x') and url = concat('https://h.example/', ord), 1, 0))").first()
    assert tuple(got) == (20_000, 20_000)


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_cards_are_parts_of_the_whole_table(monkeypatch, piece):
    """Cards of odd markup, read in pieces of any size, against cutting them out of all elements."""
    monkeypatch.setattr(elements, "_PIECE", piece)
    bits = "<div class=card>|<div class='x card'>|</div>|<p>|</p>|<li class=card>|<ul>|</ul>|text |a &amp; b|<br class=card>|<a href=x>|</a>|<script>no <b></script>|<td class=card>|<table>|</table>|<div class=card />|< |&am|p;|<![x|é".split("|")
    rnd, some = random.Random(1), 0
    for _ in range(800):
        page, chains = "".join(rnd.choices(bits, k=rnd.randint(0, 40))), elements.parse_selector(rnd.choice(["div.card", "li.card, td.card", "div .card", "ul > li", "div > .card, p .card", "br.card"]))
        whole = elements.read(page)
        nodes = whole["nodes"]
        rows = [[n["tag"], dict(n["attrs"]), n["parent"]] for n in nodes]
        named = [k for k in range(len(nodes)) if any(elements._stands(rows, chain, k) for chain in chains)]
        outer = [k for k in named if not any(j < k <= nodes[j]["last"] for j in named)]
        want = [(whole["text"][nodes[k]["start"] : nodes[k]["stop"]], [(n["tag"], n["last"] - k, n["start"] - nodes[k]["start"], n["stop"] - nodes[k]["start"]) for n in nodes[k : nodes[k]["last"] + 1]]) for k in outer]
        assert [(c["text"], [(n["tag"], n["last"], n["start"], n["stop"]) for n in c["nodes"]]) for c in elements.read_cards(page, chains)] == want, page
        some += len(want)
    assert some > 100
