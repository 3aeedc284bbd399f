"""Main text of pages: elements that hide nothing they should not, and votes and texts against a tree built by another parser."""

import random
import re
from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from lodestar.llm import html_extract

LONG = "Long paragraph of the article that says some things and then some more of them. " * 3


def text_of(page):
    return html_extract.extract(page, html_extract.vote(page)).replace(LONG.strip(), "L")


P = f"<p>{LONG}</p>"


@pytest.mark.parametrize("page, want", [
    # elements with markup inside that are not closed hide nothing behind them
    (f"<body><article><h1>T</h1>{P}<video src=x>{P}<p>last</p></article><footer>f</footer></body>", "T\nL\nL\nlast"),
    (f"<article>{P}<svg><path d=x>{P}</article>", "L\nL"), (f"<article>{P}<p>a <button>b {P}</article><p>x</p>", "L\na b\nL"), (f"<div><p>intro <object data=q>{P}</div>", "intro\nL"),
    (f"<article>{P}<select><option>one{P}</article>", "L\none\nL"), (f"<article>{P}<noscript>{P}", "L\nL"), (f"<article>{P}<template><p>t</p>{P}</article>", "L\nt\nL"),
    # closed ones go, in the middle of a line too
    (f"<article>{P}<p>a <svg><title>no</title><text>t</text></svg>b <button>Like</button> c</p><video><p>No video</p></video><p>z</p></article>", "L\na b c\nz"),
    (f"<article>{P}<noscript><img src=x>enable</noscript><p>k</p><object><object>in</object>out</object><p>m</p></article>", "L\nk\nm"),
    (f"<article>{P}<p>one<svg/>two <canvas>c</canvas></p></article>", "L\nonetwo"),
    # formulas are text, their sources are not
    (f"<article>{P}<p>where <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding=tex>x=1</annotation></math> is big</p></article>", "L\nwhere x=1 is big"),
    # an article's header keeps its lead
    (f"<article><header><h1>T</h1><p class='subtitle'>Sub</p><ul><li>tag</li></ul></header>{P}</article>", "T\nSub\nL"),
    # raw text
    (f"<article>{P}<script>if (a<b) '<p>no</p>'</script><style>p</style><textarea><p>no</p></textarea><iframe><p>no</p></iframe><p>e</p></article>", "L\ne"),
])
def test_what_hides_text(page, want):
    assert text_of(page) == want


class Tree(HTMLParser):
    """A tree of well-formed pages: [tag with classes, parent, text, text in links, children]."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = self.at = {"step": "", "path": "", "up": None, "text": "", "link": 0, "below": []}
        self.links = 0
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        if tag in ("a", "b"):
            self.links += tag == "a"
            return
        step = ".".join([tag, *sorted({re.sub("[0-9]+", "#", x) for x in dict(attrs).get("class", "").split()})])
        node = {"step": step, "tag": tag, "path": f"{self.at['path']}/{step}", "up": self.at, "text": "", "link": 0, "below": []}
        self.at["below"].append(node)
        self.at = node

    def handle_endtag(self, tag):
        if tag in ("a", "b"):
            self.links -= tag == "a"
        else:
            self.at = self.at["up"]

    def handle_data(self, data):
        self.at["text"] += data
        self.at["link"] += len(data) if self.links else 0

    def nodes(self, node=None):
        node = node or self.root
        yield node
        for child in node["below"]:
            yield from self.nodes(child)


HIDDEN = ("nav", "footer", "aside", "script", "head")


def tree_vote(page):
    """Each text counts for its block's parent, less twice its links, and half for the one above."""
    tree, score, order = Tree(page), Counter(), {}
    for k, node in enumerate(tree.nodes()):
        order[id(node)] = k
        up, hidden = node, False
        while up is not None:
            hidden, up = hidden or up.get("tag") in HIDDEN, up["up"]
        text = " ".join(node["text"].split())
        if text and not hidden:
            holder = node["up"] if node["tag"] in ("p", "h1", "h2", "li") else node
            worth = max(0, len(text) - 2 * node["link"])
            score[id(holder)] += worth
            if holder["up"] is not None:
                score[id(holder["up"])] += worth / 2
    found = max((n for n in tree.nodes() if score[id(n)] > 0), key=lambda n: (score[id(n)], -order[id(n)]), default=None)
    node = found
    while node is not None:
        found, node = (node if node.get("tag") in ("article", "main") else found), node["up"]
    return found and found["path"]


def tree_text(page, path):
    """Text of the blocks below the elements of a path."""
    out = []
    for node in Tree(page).nodes():
        up, inside, hidden = node, False, False
        while up is not None:
            inside, hidden, up = inside or up["path"] == path, hidden or up.get("tag") in HIDDEN, up["up"]
        text = " ".join(node["text"].split())
        if inside and not hidden and text:
            out.append(text)
    return "\n".join(out)


def made_page(r, layout):
    """A page of one of three layouts, and the blocks of its article."""
    words = lambda n: " ".join(r.choice(["alpha", "beta &amp; co", "gamma", "délta", "x &lt; y", "epsilon"]) for _ in range(n))
    blocks = [("h1", words(r.randint(2, 5)))] + [(r.choice(["p", "p", "p", "h2"]), words(r.randint(8, 60))) for _ in range(r.randint(2, 6))]
    shown = "".join(f"<{t}>{x if r.random() < 0.7 else x.replace(' ', chr(10) + '  ')}</{t}>\n" for t, x in blocks)
    menu = "<nav>" + "".join(f"<a href='/{k}'>{words(2)}</a>" for k in range(r.randint(2, 9))) + "</nav>"
    listed = "<div class='c3 links'>" + "".join(f"<p><a href='/{k}'>{words(3)}</a></p>" for k in range(r.randint(0, 5))) + "</div>"
    main = {"a": f"<div class='page{r.randint(1, 99)} wrap'><article class='post-{r.randint(1, 9)}'>{shown}</article>{listed}</div>", "m": f"<main><section>{shown}</section></main>{listed}", "d": f"<div class='content'>{shown}</div>{listed}"}[layout]
    return f"<html><head><title>{words(3)}</title></head><body>{menu}{main}<aside><p>{words(80)}</p></aside><footer><p>{words(30)}</p></footer><script>var x = 1;</script></body></html>"


def test_votes_and_texts_against_a_tree(spark):
    r = random.Random(3)
    rows, votes = [], {}
    for k in range(150):
        host, layout = r.choice([("a.example", "a"), ("m.example", "m"), ("d.example", "d"), ("x.example", r.choice("amd"))])
        rows.append((k, f"https://{host}/{k}", made_page(r, layout)))
        votes.setdefault(host, Counter())[tree_vote(rows[-1][2])] += 1
    assert all(html_extract.vote(page) == tree_vote(page) for _, _, page in rows)
    winners = {host: max(v, key=lambda p: (v[p], p)) for host, v in votes.items()}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("winner", F.lit("w")).withColumn("host", F.lit(1))
    for most in (1000, 0):  # winners broadcast, and joined
        got = {x.page_id: (x.text, x.n_chars) for x in html_extract.main_text(pages.repartition(5), most).collect()}
        for k, url, page in rows:
            want = tree_text(page, winners[url.split("/")[2]]) or tree_text(page, tree_vote(page))
            assert got[k] == (want, len(want))


def test_pages_without_a_host(spark):
    """Pages of null hosts vote together, however many they are."""
    r = random.Random(4)
    rows = [(k, [None, "no address", ""][k % 3], made_page(r, "a")) for k in range(90)] + [(90, None, None), (91, "https://x.example/", "")]
    got = {x.page_id: x for x in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 92 and (got[90].text, got[90].n_chars, got[91].text) == ("", 0, "")
    assert all(got[k].text == tree_text(page, tree_vote(page)) for k, _, page in rows[:90])
