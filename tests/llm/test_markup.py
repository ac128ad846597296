import random

import pytest
from test_page_body import pairs, table

from verbarium.llm import markup as module
from verbarium.llm.markup import container_scores, page_blocks, step_name
from verbarium.llm.page_body import article_line_numbers, articles


def sample(n=200, sep="\n", host="paper.example"):
    """Pages with an article of their own between a menu, a list of links and a footer."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    sentence = lambda: f"The {word()} of the {word()} reads one {word()} for each {word()}."
    rows, want = [], {}
    for i in range(n):
        body = [("h1", f"On {word()} and {word()}"), *[("p", sentence() + " " + sentence()) for _ in range(3)]]
        if i % 40 == 0:
            body += [("h2", "Conclusion"), ("p", sentence())]
        tags = ["<html>", "<head><title>Paper</title>", "<script>var x = '<p>no text.</p>';</script>", "</head>", f'<body class="page-{i}">', '<nav class="top">']
        tags += [f'<a href="/{x}">{x}</a>' for x in ("Home", "News", "Jobs")] + ["</nav>"]
        tags += [f'<div class="main col-{i % 9}">', *[f"<{t}>{x}</{t}>" for t, x in body], "<p>Share this page with a friend.</p>", "</div>"]
        tags += ['<aside class="more">', *[f'<p><a href="/{k}">Why the {word()} drops one {word()}.</a></p>' for k in range(3)], "</aside>"]
        tags += ["<footer>", "<p>© 2020 The Paper. All rights reserved.</p>", "</footer>", "</body></html>"]
        rows.append((i, host, f"{i}\nhttps://{host}/{i}\n" + sep.join(tags)))
        want[i] = [x for _, x in body]
    return rows, want


def test_article_by_paths(spark):
    rows, want = sample()
    assert {r.page_id: r.article.split("\n") for r in articles(table(spark, rows)).collect()} == want
    lines = {(p, k) for p, _, t in rows for k, x in enumerate(t.split("\n"), 1) if k > 2 and any(f">{w}<" in x for w in want[p])}
    assert pairs(article_line_numbers(table(spark, rows))) == lines


def test_without_line_breaks_and_beside_plain_pages(spark):
    rows, want = sample(60, sep="")
    rows += [rows[3], (800, "paper.example", None), (801, "paper.example", "801\nhttps://paper.example/801\nA plain page. It has one line."), (802, "paper.example", "<div></div><p></p>")]
    got = {r.page_id: r.article for r in articles(table(spark, rows)).collect()}
    assert {k: v.split("\n") for k, v in got.items() if k < 800} == want
    assert got[801] == "A plain page. It has one line." and got[802] == "" and 800 not in got
    assert pairs(article_line_numbers(table(spark, rows)).filter("page_id < 800")) == {(i, 3) for i in want}


@pytest.mark.parametrize("limit", [0, 20_000])
def test_layouts_of_hosts_and_rare_pages(spark, monkeypatch, limit):
    monkeypatch.setattr(module, "BROADCAST_HOSTS", limit)
    rows, want = sample(40)
    other = [(1000 + p, "other.example", t.replace('<div class="main', '<section class="story').replace("</div>", "</section>").replace("paper.example", "other.example")) for p, _, t in rows]
    odd = (2000, "paper.example", "2000\nhttps://paper.example/x\n<body><div class='odd'><p>One page has a path of its own. It stands alone.</p></div><div class='foot'>Imprint</div></body>")
    got = {r.page_id: r.article.split("\n") for r in articles(table(spark, [*rows, *other, odd])).collect()}
    assert {k: v for k, v in got.items() if k < 1000} == want
    assert {k - 1000: v for k, v in got.items() if 1000 <= k < 2000} == want
    assert got[2000] == ["One page has a path of its own. It stands alone."]


def test_plain_pages_that_quote_markup_stay_plain(spark):
    page = "5\nhttps://a.example/5\nHow to close a tag.\n<p>One</p><p>two</p>\nThe list is read in order."
    assert {(r.page_id, r.article) for r in articles(table(spark, [(5, "a.example", page)])).collect()} == {(5, "\n".join(page.split("\n")[2:]))}


def test_paths_and_broken_markup():
    assert step_name("div", " Col-12 main  MAIN x_7") == "div.col.main.x"
    blocks = page_blocks("1\nhttps://a.example\n<div class=a><p>One &amp; two<p>Three<ul><li>four<li><a href=x>five</a></ul>\nsix<br>seven</i></span><td>eight</div>\n</div>nine")
    assert [(b.path, b.text, b.lines, b.links) for b in blocks] == [
        ("div.a", "One & two", [3], 0), ("div.a", "Three", [3], 0), ("div.a", "four", [3], 0), ("div.a", "five", [3], 4), ("div.a", "six", [4], 0), ("div.a", "seven", [4], 0),
        ("div.a/td", "eight", [4], 0), ("", "nine", [5], 0),
    ]
    assert page_blocks("") == [] and [b.text for b in page_blocks("<p>x<<>><div")][:1] != []
    assert container_scores([]) == {}
