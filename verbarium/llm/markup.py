"""The article of pages that still have their markup (problem 2).

Consensus host paths. Each page is parsed into blocks of text, and each block belongs to a
container, named by its generalised tag-class path: the tags from the root with their classes,
lower-cased and without digits. A page scores its containers by the prose in them that is no
link, and votes for the best and for those that come near it. Votes are counted per host and
path; a path wins if most pages that have it vote for it and what stands there is not the same
on page after page. Pages are then read again with the winning paths of their host: blocks in
them are kept, and so are those beside them, in the same part of the page, whose text is each
page's own (titles, by their place); blocks that the host repeats are left out, headings aside.

Defined cases: a page without any winning path of its host keeps its own best container; a page
without prose has no article; scripts, styles and the head are no text; unclosed and crossed
tags are closed by the next one that can't stand in them; null and empty texts have no article.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbarium.llm.words import slices
from verbarium.session import materialize

#: Share of a page's best score that still is a vote, and share of a path's pages that must vote for it.
NEAR_BEST, WIN_SHARE = 0.2, 0.5
#: Share and number of a host's pages on which a block is one that the host repeats.
REPEATED_SHARE, REPEATED_PAGES = 0.1, 3
#: Least share of a path's text that is not repeated, and most of it that is in links.
OWN_SHARE, LINK_SHARE = 0.5, 0.5
#: Share of a host's pages that must have a path, and number; rarer ones are each page's own matter.
PATH_SHARE, PATH_PAGES = 0.01, 2
#: Hosts up to which their paths are broadcast.
BROADCAST_HOSTS = 20_000

# Elements of HTML.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset("script style noscript template svg head iframe select textarea button".split())
_CONTAINERS = frozenset("html body div section article main nav aside footer header form td th table fieldset details dialog".split())
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote ul ol dl dt dd tr tbody thead figure figcaption address caption summary hgroup center".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element that the start of another one closes.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

_CLOSING_TAG = r"(?i)</(?:html|body|div|p|article|section|main|table|ul|nav|footer)\s*>"
_SENTENCE = re.compile(r"[.!?。！？][)\]\"'”’」』»]*(?:\s|$)|[。！？]")


def has_markup(text: Column) -> Column:
    """Whether a text begins with a tag, after its id and url line if it has them, and has at least two closing tags of blocks."""
    begins = text.rlike(r"^(?:[^\n<]*\n[^\n<]*\n)?\s*<[!a-zA-Z]")
    return F.coalesce(F.when(begins, F.regexp_count(text, F.lit(_CLOSING_TAG)) >= 2), F.lit(False))


def step_name(tag: str, classes: str | None) -> str:
    """A tag with its classes, without digits and case."""
    names = sorted({x for c in (classes or "").lower().split() if (x := re.sub(r"\d+", "", c).strip("-_"))})
    return ".".join([tag, *names])


class Block:
    __slots__ = ("path", "text", "lines", "links", "heading")

    def __init__(self, path: str, text: str, lines: list[int], links: int, heading: bool):
        self.path, self.text, self.lines, self.links, self.heading = path, text, lines, links, heading


class _Parser(HTMLParser):
    def __init__(self, first_line: int):
        super().__init__(convert_charrefs=True)
        self.first_line = first_line
        self.open: list[tuple[str, str]] = []  # tag and name
        self.silent = self.anchors = 0
        self.blocks: list[Block] = []
        self.pieces: list[str] = []
        self.lines: list[int] = []
        self.links = 0

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.pieces)).strip()
        if text:
            at = max((i for i, (t, _) in enumerate(self.open) if t in _CONTAINERS), default=-1)
            path = "/".join(n for t, n in self.open[: at + 1] if t in _CONTAINERS)
            self.blocks.append(Block(path, text, sorted(set(self.lines)), self.links, any(t in _HEADINGS for t, _ in self.open[at + 1 :])))
        self.pieces, self.lines, self.links = [], [], 0

    def close_to(self, at: int) -> None:
        for tag, _ in self.open[at:]:
            self.silent -= tag in _SILENT
            self.anchors -= tag == "a"
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs) -> None:
        block = tag in _CONTAINERS or tag in _LEAVES
        if block or tag in ("br", "hr"):
            self.flush()
        if tag in _VOID:
            return
        if block:
            closes = _CLOSES.get(tag, set()) | ({"p", *_HEADINGS} if tag not in _HEADINGS or not self.open or self.open[-1][0] in {"p", *_HEADINGS} else {"p"})
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in closes:
                    self.close_to(i)
                    break
                if self.open[i][0] in _CONTAINERS or self.open[i][0] in ("ul", "ol", "dl"):
                    break
        self.open.append((tag, step_name(tag, dict(attrs).get("class"))))
        self.silent += tag in _SILENT
        self.anchors += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        if tag in _CONTAINERS or tag in _LEAVES:
            self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.close_to(i)
                return

    def handle_data(self, data: str) -> None:
        if self.silent > 0:
            return
        self.pieces.append(data)
        start = self.getpos()[0] + self.first_line - 1
        for k, part in enumerate(data.split("\n")):
            if part.strip():
                self.lines.append(start + k)
                self.links += len(part.strip()) if self.anchors > 0 else 0


def page_blocks(text: str) -> list[Block]:
    """The blocks of a page, after its id and url line if it has them."""
    parts, first = text.split("\n", 2), 1
    if len(parts) == 3 and "<" not in parts[0] + parts[1]:
        text, first = parts[2], 3
    parser = _Parser(first)
    parser.feed(text)
    parser.close()
    parser.flush()
    return parser.blocks


def container_scores(blocks: list[Block]) -> dict[str, tuple[float, int, int]]:
    """``path -> score, characters, characters in links`` of a page; the score counts the prose outside of links."""
    sums: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    for b in blocks:
        s = sums[b.path]
        s[0] += len(b.text) - min(b.links, len(b.text)) if _SENTENCE.search(b.text) else 0
        s[1] += len(b.text)
        s[2] += min(b.links, len(b.text))
    return {p: (prose * (1 - links / chars) ** 2, chars, links) for p, (prose, chars, links) in sums.items()}


_BLOCKS = (
    "page_id bigint, host string, blocks array<struct<path:string,text:string,lines:array<int>,heading:boolean,hash:bigint>>,"
    " containers array<struct<path:string,chars:bigint,links:bigint,vote:int,best:int>>"
)


def parsed_blocks(pages: DataFrame) -> DataFrame:
    """``page_id, host, text`` parsed once, as a table of blocks and scored containers."""
    block = pa.struct([("path", pa.string()), ("text", pa.string()), ("lines", pa.list_(pa.int32())), ("heading", pa.bool_()), ("hash", pa.int64())])
    container = pa.struct([("path", pa.string()), ("chars", pa.int64()), ("links", pa.int64()), ("vote", pa.int32()), ("best", pa.int32())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in slices(whole, "text", 1 << 20)):
            each, scored = [], []
            for text in batch.column("text").to_pylist():
                blocks = page_blocks(text)
                scores = container_scores(blocks)
                top = max((s for s, _, _ in scores.values()), default=0.0)
                best = next((p for p, (s, _, _) in scores.items() if s == top > 0), None)
                each.append([{"path": b.path, "text": b.text, "lines": b.lines, "heading": b.heading, "hash": xxhash.xxh3_64_intdigest(b.text.lower()) - (1 << 63)} for b in blocks])
                scored.append([{"path": p, "chars": c, "links": l, "vote": int(s > 0 and s >= NEAR_BEST * top), "best": int(p == best)} for p, (s, c, l) in scores.items()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), pa.array(each, pa.list_(block)), pa.array(scored, pa.list_(container))], names=["page_id", "host", "blocks", "containers"]
            )

    return materialize(pages.select("page_id", "host", "text").mapInArrow(parse, _BLOCKS), "blocks")


def host_paths(parsed: DataFrame) -> DataFrame:
    """``host, paths, parts, repeated``: winning paths of each host, the parts of its pages around them, and the blocks that it repeats.

    Counts are by host and path, and by host and block, before they are by host, so a host
    with a third of all pages spans tasks; a host's lists are bounded by the shares.
    """
    sizes = parsed.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    own = parsed.select("host", F.explode(F.array_distinct(F.transform("blocks", lambda b: b["hash"]))).alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    repeated = own.filter(F.col("n") >= REPEATED_PAGES).join(sizes, "host").filter(F.col("n") >= REPEATED_SHARE * F.col("pages")).select("host", "hash")
    repeated = materialize(repeated, "repeated")
    text = parsed.select("host", F.explode("blocks").alias("b")).groupBy("host", F.col("b.path").alias("path"), F.col("b.hash").alias("hash")).agg(F.sum(F.length("b.text")).alias("chars"))
    again = text.join(repeated.withColumn("again", F.lit(1)), ["host", "hash"], "left")
    fresh = again.groupBy("host", "path").agg((F.sum(F.when(F.col("again").isNull(), F.col("chars")).otherwise(0)) / F.sum("chars")).alias("fresh"))
    votes = (
        parsed.select("host", F.explode("containers").alias("c"))
        .groupBy("host", F.col("c.path").alias("path"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("c.vote").alias("votes"), F.sum("c.chars").alias("chars"), F.sum("c.links").alias("links"))
        .join(fresh, ["host", "path"])
        .join(sizes, "host")
        .filter((F.col("n") >= PATH_PAGES) & (F.col("n") >= PATH_SHARE * F.col("pages")) & (F.col("fresh") >= OWN_SHARE) & (F.col("links") <= LINK_SHARE * F.col("chars")))
    )
    votes = materialize(votes.select("host", "path", (F.col("votes") >= WIN_SHARE * F.col("n")).alias("wins")), "paths")
    won = votes.filter("wins").groupBy("host").agg(F.collect_set("path").alias("paths"))
    # Parts of the page: winning paths, and what they stand in, but for the root and the body.
    steps = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    around = F.explode(F.filter(ups, lambda p: ~p.rlike(r"^(?:html[^/]*)?/?(?:body[^/]*)?$")))
    parts = votes.filter("wins").select("host", around.alias("part")).groupBy("host").agg(F.collect_set("part").alias("around"))
    beside = (
        votes.filter("not wins").join(parts, "host").filter(F.exists("around", lambda p: F.startswith("path", F.concat(p, F.lit("/")))))
        .groupBy("host").agg(F.collect_set("path").alias("parts"))
    )
    lists = repeated.groupBy("host").agg(F.collect_set("hash").alias("repeated"))
    every = won.join(beside, "host", "left").join(lists, "host", "left")
    none = F.array().cast("array<string>")
    return materialize(every.select("host", "paths", F.coalesce("parts", none).alias("parts"), F.coalesce("repeated", F.array().cast("array<bigint>")).alias("repeated")), "hosts")


def kept_blocks(pages: DataFrame) -> DataFrame:
    """``page_id, blocks`` of the article of each page ``page_id, host, text``."""
    parsed = parsed_blocks(pages)
    hosts = host_paths(parsed)
    hint = F.broadcast if hosts.count() <= BROADCAST_HOSTS else lambda x: x
    joined = parsed.join(hint(hosts.withColumnRenamed("host", "_host")), F.col("host") == F.col("_host"), "left")
    here = F.transform("containers", lambda c: c["path"])
    own = F.transform(F.filter("containers", lambda c: c["best"] == 1), lambda c: c["path"])
    known = F.coalesce(F.arrays_overlap("paths", here), F.lit(False))
    wanted = joined.withColumn("wanted", F.when(known, F.concat("paths", "parts")).otherwise(own)).withColumn("again", F.coalesce("repeated", F.array().cast("array<bigint>")))
    kept = F.filter("blocks", lambda b: F.array_contains("wanted", b["path"]) & (b["heading"] | ~F.array_contains("again", b["hash"])))
    return wanted.select("page_id", kept.alias("blocks"))
