import random

from verbarium.llm import page_body
from verbarium.llm.page_body import article_line_numbers, articles

SCHEMA = "page_id bigint, site string, text string, host string, code int, article string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def sample(n=80):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    rows, want = [], set()
    for i in range(n):
        site = ("alpha-news.example", "beta.example")[i % 2]
        topic = word()
        title = f"Why the {topic} keeps {word()}"
        sentence = lambda: f"The {word()} of {topic} reads a {word()} for the {word()}."
        lines = [str(i), f"https://{site}/{topic}-{i}", "Alpha" if i % 2 == 0 else "Beta", "Home | News | Jobs", f"Home / News / {title}", ""]
        body = [title, f"By {'Ann Bell'} | {rng.randrange(9)} min read", sentence() + " " + sentence(), f"Notes on {topic} and {word()}", sentence(), f"• fresh {word()} and {word()}", "Advertisement", sentence(), f"Read also: The {word()} of {word()}", sentence()]
        links = ["Most read", *[f"Why the {word()} drops {word()}" for _ in range(3)]]
        foot = ["Back to top", f"© {rng.randrange(2000, 2024)} {site.split('.')[0].split('-')[0].title()}. All rights reserved."]
        if i % 4 < 2:
            lines += body + links + foot
        else:  # the links stand before the title
            lines += links + body + foot
        keep = [x for x in body if not x.startswith(("By ", "Advertisement", "Read also"))]
        want |= {(i, k) for k, x in enumerate(lines, 1) if k > 2 and x in keep}
        rows.append((i, site, ("\r\n" if i % 3 == 0 else "\n").join(lines)))
    return rows, want


def pairs(df):
    return {(r.page_id, r.line_no) for r in df.collect()}


def test_article_lines(spark):
    rows, want = sample()
    rows += [rows[0], rows[5], (900, None, rows[7][2].replace("7\n", "900\n", 1)), (901, "alpha-news.example", None), (902, "alpha-news.example", ""), (903, "beta.example", "903"), (None, "beta.example", "x\ny")]
    got = article_line_numbers(table(spark, rows))
    assert pairs(got.filter("page_id < 900")) == want
    assert {k for p, k in pairs(got) if p == 900} == {k for p, k in want if p == 7}
    assert not {p for p, _ in pairs(got)} & {901, 902, 903}
    assert got.count() == len(pairs(got))


def test_templates_that_travel(spark, monkeypatch):
    rows, want = sample()
    monkeypatch.setattr(page_body, "BROADCAST_TEMPLATES", 20)
    monkeypatch.setattr(page_body, "PAGES_PER_GROUP", 7)
    got = pairs(article_line_numbers(table(spark, rows)))
    assert len(got ^ want) <= 0.02 * len(want)


def test_prefix_of_one_host_in_a_large_collection(spark):
    rows, want = sample()
    # 60 pages of a host with a prefix of its own, among 80,000 of others.
    own = [(1000 + i, "gamma.example", x.replace("beta.example", "gamma.example").replace("alpha-news.example", "gamma.example").replace("Read also:", "Turn to:")) for i, (_, _, x) in enumerate(rows[:60])]
    turn = {(p, k) for p, _, x in own for k, line in enumerate(x.split("\n"), 1) if line.startswith("Turn to:")}
    assert len(turn) == 60
    others = spark.range(100_000, 180_000).selectExpr("id", "concat('h', id % 2000, '.example')", "concat(id, '\nhttps://x.example/', id, '\nOne sentence here.')", "'x'", "1", "'y'")
    got = pairs(article_line_numbers(table(spark, rows + own).union(others)).filter("page_id < 100000"))
    assert not got & turn


def test_pages_without_a_host_vote(spark):
    rows = [(i, None, f"{i}\nno address\nWelcome to the reading room\nThe {'abcdefghij'[i]}{'klmnopqrst'[i]} lantern reads a list.") for i in range(10)]
    assert pairs(article_line_numbers(table(spark, rows))) == {(i, 4) for i in range(10)}


def test_articles(spark):
    rows, want = sample(40)
    texts = {r.page_id: r.article for r in articles(table(spark, rows)).collect()}
    for i, _, text in rows:
        lines = [x.rstrip("\r") for x in text.split("\n")]
        assert texts[i] == "\n".join(x for k, x in enumerate(lines, 1) if (i, k) in want)


def test_empty_table(spark):
    assert article_line_numbers(table(spark, [])).count() == articles(table(spark, [])).count() == 0
