"""The article of each page without the frame around it (problem 2).

Consensus host paths, on pages whose markup is gone: what a tag-class path is to a page's
tree, the *template* of a line is to its plain text. A template is the line without case,
digits, punctuation and the host's own name; parts between separators and prefixes before
a colon have templates too. Each host's pages vote:

1. on templates: one that many pages of a host (or very many of all) share is frame;
2. on containers: the run of lines after a frame line is scored as text or as a list of
   links, and the host decides by majority whether that frame line opens link lists;
3. on prefixes: one that stands in the running text and never opens a page points elsewhere.

Then each page is read again with the winning templates: frame lines, link lists and lines
that point elsewhere go; a title that ends a link list just before its text stays. Pages that
have their markup still are told by their closing tags and read by tag-class paths (``markup``).

Defined cases: null texts and pages of only an id and url line have no article; exact
duplicate rows count once; a null site is taken from the url line, and pages that have none
there either vote together as one host, named by an empty text; blank lines are never article.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.llm.markup import has_markup, kept_blocks
from verbarium.llm.words import slices
from verbarium.session import materialize

#: Share and number of a host's pages that make a line's template frame.
HOST_SHARE, HOST_PAGES = 0.008, 3
#: Share and number of all pages, and number of hosts, that make it frame everywhere.
ALL_SHARE, ALL_PAGES, ALL_HOSTS = 0.004, 8, 3
#: Share of all pages, and number of pages, on which a prefix must stand to be judged for all
#: hosts; for a host of its own, ``HOST_SHARE`` of the host's pages and the same number.
PREFIX_SHARE, PREFIX_PAGES = 0.001, 4
#: Share and number of all pages that make a word too common to tell what a page is about.
WORD_SHARE, WORD_PAGES = 0.05, 3
#: Templates up to which they are broadcast, about 40 MB; beyond, they travel to their hosts' pages.
BROADCAST_TEMPLATES = 500_000
#: Pages that stand there more than once up to which their keys are broadcast.
BROADCAST_PAGES = 500_000
#: Bytes of pages whose lines a task holds at once, about.
PARSE_BYTES = 1 << 20
#: Pages of one host in one task, where templates travel.
PAGES_PER_GROUP = 5000

_LETTERS = re.compile(r"[\W\d_]+")
_PARTS = re.compile(r"\s+[|·•»›>/]\s+|\xa0*[|·•»›>/]\xa0+|[ \xa0]{2,}|　")
#: What every separator has, looked for first.
_SEPARATORS = re.compile("[|·•»›>/\u3000]|[ \xa0]{2}")
_PREFIX = re.compile(r"^\s*([^:：]+?)\s*[:：]\s*\S")
_ENDED = re.compile(r"[.!?。！？][)\]\"'”’」』»]*\s*$")
_TEASER = re.compile(r"(?:\.\.\.|…)\s*$|^.+?\s-\s[A-Z“\"㐀-鿿぀-ヿ]")
_ITEM = re.compile(r"^\s*(?:[•*\-–]\s|\d{1,2}[.)]\s|[$>“\"「])")
_WORDS = re.compile(r"[a-z][a-z0-9]{3,}")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")


def brand(host: str | None) -> str:
    return re.split(r"[.\-]", host or "", maxsplit=1)[0]


def template(line: str, name: str) -> str:
    form = _LETTERS.sub("", line.lower())
    return form.replace(name, "§") if name else form


def _code(kind: str, form: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}:{form}") - (1 << 63)


def _codes(text: str, name: str) -> tuple[int, tuple[int, ...], int | None]:
    cut = [p for p in _PARTS.split(text) if p.strip()] if _SEPARATORS.search(text) else []
    parts = tuple(_code("part", template(p, name)) for p in cut) if len(cut) > 1 else ()
    m = _PREFIX.match(text) if ":" in text or "：" in text else None
    return _code("line", template(text, name)), parts, _code("prefix", template(m[1], name)) if m else None


#: Frame lines come again and again; long lines are mostly running text.
_cached_codes = lru_cache(maxsize=1 << 16)(_codes)


class Line:
    """One line of a page with its templates."""

    __slots__ = ("no", "text", "line", "parts", "prefix")

    def __init__(self, no: int, text: str, line: int, parts: Sequence[int], prefix: int | None):
        self.no, self.text, self.line, self.parts, self.prefix = no, text, line, parts, prefix


def page_lines(text: str | None, host: str | None) -> list[Line]:
    """The lines of a page after its id and url line, blank ones left out."""
    name = brand(host)
    found = []
    for i, x in enumerate((text or "").split("\n"), 1):
        x = x.strip()
        if i > 2 and x:
            found.append(Line(i, x, *(_cached_codes if len(x) <= 150 else _codes)(x, name)))
    return found


def _ended(text: str) -> bool:
    return bool(_ENDED.search(text)) and not _TEASER.search(text)


def _linklike(text: str) -> bool:
    return not _ended(text) and not _ITEM.match(text)


class Model:
    """What a host's vote decided. ``shared`` holds what counts on all hosts."""

    def __init__(self, own: frozenset[int], shared: frozenset[int]):
        self.own, self.shared = own, shared

    def has(self, code: int | None) -> bool:
        return code is not None and (code in self.own or code in self.shared)

    def frame(self, x: Line) -> bool:
        return self.has(x.line) or any(map(self.has, x.parts))

    def opens_list(self, x: Line) -> bool:
        return self.has(x.line ^ 1)

    def elsewhere(self, x: Line) -> bool:
        return x.prefix is not None and self.has(x.prefix)


def container_votes(lines: list[Line], model: Model) -> Iterator[tuple[int, int]]:
    """``(code, vote)`` of this page: 1 for a link list after a frame line, 0 for text; of prefixes, 1 for running text."""
    kinds = [model.frame(x) for x in lines]
    first = next((i for i, f in enumerate(kinds) if not f), None)
    i, n = 0, len(lines)
    while i < n:
        if not kinds[i]:
            i += 1
            continue
        j = i + 1
        while j < n and not kinds[j]:
            j += 1
        run = lines[i + 1 : j]
        if run:
            lead = 0
            while lead < len(run) and _linklike(run[lead].text):
                lead += 1
            text = lead < len(run)
            if not text:
                later = next((x for x, f in zip(lines[j:], kinds[j:]) if not f), None)
                text = lead == 1 and later is not None and not _linklike(later.text)
            yield lines[i].line ^ 1, int(lead >= 2 or (lead == 1 and not text))
        i = j
    for i, x in enumerate(lines):
        if kinds[i] or x.prefix is None or _ended(x.text):
            continue
        # Between two pieces of running text, or at least after one, and never the first line.
        before = i > 0 and not kinds[i - 1] and not _linklike(lines[i - 1].text)
        yield x.prefix, int(before and i != first)


def _topical(title: str, others: list[str], rest: str, model: Model) -> bool:
    """Whether the text after a list is about the list's last entry, and not less than about the others.

    Words that many pages have say nothing, unless a title has no others.
    """
    if _CJK.search(title):
        return title in rest
    counts = Counter(_WORDS.findall(rest.lower()))

    def score(t: str, alone: bool) -> int:
        words = set(_WORDS.findall(t.lower()))
        rare = {w for w in words if not model.has(_code("word", w))}
        return max((counts[w] for w in rare or (words if alone else ())), default=0)

    return score(title, True) >= max([1, *(score(t, False) for t in others)])


def article_lines(lines: list[Line], model: Model) -> list[int]:
    """The numbers of the lines that belong to the article."""
    found: list[int] = []
    state, pending = "open", []
    trails = {_LETTERS.sub("", _PARTS.split(x.text)[-1].lower()) for x in lines if x.parts and any(map(model.has, x.parts))}
    for i, x in enumerate(lines):
        if model.frame(x):
            if model.opens_list(x):
                state, pending = "list", []
            elif state == "list":
                state = "after"
            continue
        if state == "list" and _linklike(x.text):
            pending.append(x)
            continue
        if pending and not _linklike(x.text):
            last, others = pending[-1].text, [y.text for y in pending[:-1]]
            rest = "\n".join(y.text for y in lines[i:] if not _linklike(y.text))
            # A trail ends with the page's title; without one, the words decide.
            if _LETTERS.sub("", last.lower()) in trails or (not _TEASER.search(last) and _topical(last, others, rest, model)):
                found.append(pending[-1].no)
        state, pending = "open", []
        if not model.elsewhere(x):
            found.append(x.no)
    return found


_COUNTS = "host string, code bigint, n bigint, yes bigint"


def _counted(rows: Iterator[tuple[str | None, int, int]], limit: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Sums of ``(host, code, vote)`` rows, with a bound on what is kept."""

    def batch(n: Counter, yes: Counter) -> pa.RecordBatch:
        keys = list(n)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([n[k] for k in keys], pa.int64()), pa.array([yes[k] for k in keys], pa.int64())],
            names=["host", "code", "n", "yes"],
        )

    n, yes = Counter(), Counter()
    for host, code, vote in rows:
        n[host, code] += 1
        yes[host, code] += vote
        if len(n) > limit:
            yield batch(n, yes)
            n, yes = Counter(), Counter()
    yield batch(n, yes)


_PARSED = "page_id bigint, host string, text string, nos array<int>, lines array<bigint>, prefixes array<bigint>, cuts array<int>, parts array<bigint>"


def _page_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str | None, str, list[Line]]]:
    """``page_id, host, text`` and the lines of parsed pages."""
    for b in (x for batch in batches for x in slices(batch, "text", PARSE_BYTES)):
        for page, host, text, nos, codes, prefixes, cuts, parts in zip(*(b.column(c).to_pylist() for c in ("page_id", "host", "text", "nos", "lines", "prefixes", "cuts", "parts"))):
            raw, at, lines = text.split("\n"), 0, []
            for no, code, prefix, n in zip(nos, codes, prefixes, cuts):
                lines.append(Line(no, raw[no - 1].strip(), code, parts[at : at + n], prefix))
                at += n
            yield page, host, text, lines


def _with_model(pages: DataFrame, model: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work(rows, model_of)`` over the pages; ``model(host, code)`` with a null host for all hosts."""
    spark = pages.sparkSession
    total = model.count()
    # Each code for all hosts stands on a given share of all pages, so there are at most some ten thousand.
    everywhere = frozenset(r.code for r in model.filter("host is null").select("code").collect())
    if total <= BROADCAST_TEMPLATES:
        own: dict[str, set[int]] = {}
        for r in model.filter("host is not null").toLocalIterator():
            own.setdefault(r.host, set()).add(r.code)
        shared = spark.sparkContext.broadcast(({h: frozenset(s) for h, s in own.items()}, everywhere))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, every = shared.value
            none = frozenset()
            yield from work(_page_rows(batches), lambda h: Model(of.get(h, none), every))

        return pages.mapInArrow(run, schema)
    # Hosts are split into groups of pages; each group gets its host's templates.
    every = spark.sparkContext.broadcast(everywhere)
    sizes = pages.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / PAGES_PER_GROUP).alias("groups"))
    on = F.col("p.host").eqNullSafe(F.col("s.host"))
    left = pages.alias("p").join(sizes.alias("s"), on).select("p.*", F.pmod(F.xxhash64("page_id"), F.col("groups")).alias("g"))
    right = model.filter("host is not null").alias("p").join(sizes.alias("s"), on).select("p.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("g"))

    def group(a: pa.Table, b: pa.Table) -> pa.Table:
        m = Model(frozenset(b.column("code").to_pylist()), every.value)
        return pa.Table.from_batches(list(work(_page_rows(iter(a.to_batches())), lambda h: m)))

    return left.groupBy("host", "g").cogroup(right.groupBy("host", "g")).applyInArrow(group, schema)


def distinct_pages(pages: DataFrame, key: str = "page_id", site: str = "site", text: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """``page_id, host, text`` of the distinct pages without and, if there are any, with markup.

    Only keys and hashes are shuffled to find repeated pages, and then these alone.
    """
    url_host = F.regexp_extract(F.element_at(F.split(F.col(text), "\n"), 2), r"^\s*[a-z]+://([^/\s:]+)", 1)
    host = F.coalesce(F.col(site), F.when(F.size(F.split(F.col(text), "\n")) > 1, F.nullif(url_host, F.lit(""))), F.lit(""))
    every = pages.filter(F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("page_id"), host.alias("host"), F.col(text).alias("text"), F.xxhash64(text).alias("h"), has_markup(F.col(text)).alias("markup")
    )
    seen = every.groupBy("page_id", "h").agg(F.count(F.lit(1)).alias("n"), F.max("markup").alias("markup"))
    seen = materialize(seen.filter("n > 1 or markup"), "seen")
    repeated = seen.filter("n > 1").select(F.col("page_id").alias("_p"), F.col("h").alias("_h"))
    if repeated.count() <= BROADCAST_PAGES:
        repeated = F.broadcast(repeated)
    same = F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("h") == F.col("_h"))
    once = every.join(repeated, same, "left_anti").unionByName(every.join(repeated, same, "left_semi").dropDuplicates(["page_id", "host", "text"]))
    plain = once.filter("not markup").select("page_id", "host", "text")
    return plain, None if seen.filter("markup").isEmpty() else once.filter("markup").select("page_id", "host", "text")


def parsed(once: DataFrame) -> DataFrame:
    """Distinct pages ``page_id, host, text`` with the codes of their lines, parsed once, as a table."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch, "text", PARSE_BYTES)):
            each = [page_lines(t, h) for t, h in zip(b.column("text").to_pylist(), b.column("host").to_pylist())]
            columns = [
                pa.array([[x.no for x in p] for p in each], pa.list_(pa.int32())),
                pa.array([[x.line for x in p] for p in each], pa.list_(pa.int64())),
                pa.array([[x.prefix for x in p] for p in each], pa.list_(pa.int64())),
                pa.array([[len(x.parts) for x in p] for p in each], pa.list_(pa.int32())),
                pa.array([[c for x in p for c in x.parts] for p in each], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("text"), *columns], names=["page_id", "host", "text", "nos", "lines", "prefixes", "cuts", "parts"])

    return materialize(once.mapInArrow(parse, _PARSED), "pages")


def templates(pages: DataFrame) -> DataFrame:
    """``host, code`` of the frame templates, of parts and lines; a null host stands for all."""
    codes = F.explode(F.array_distinct(F.concat("lines", "parts"))).alias("code")
    counts = materialize(pages.select("host", codes).groupBy("host", "code").agg(F.count(F.lit(1)).alias("n")), "templates")
    sizes = pages.groupBy(F.col("host").alias("_h")).agg(F.count(F.lit(1)).alias("pages"))
    own = (
        counts.filter(f"n >= {HOST_PAGES} and host is not null")
        .join(sizes, F.col("host") == F.col("_h"))
        .filter(F.col("n") >= HOST_SHARE * F.col("pages"))
        .select("host", "code")
    )
    total = sizes.agg(F.sum("pages").alias("t"))  # one row
    every = (
        counts.groupBy("code")
        .agg(F.sum("n").alias("n"), F.count("host").alias("hosts"))
        .filter((F.col("n") >= ALL_PAGES) & (F.col("hosts") >= ALL_HOSTS))
        .crossJoin(F.broadcast(total))
        .filter(F.col("n") >= ALL_SHARE * F.col("t"))
        .select(F.lit(None).cast("string").alias("host"), "code")
    )
    return materialize(own.unionByName(every).unionByName(_common_words(pages)), "frame")


def _common_words(pages: DataFrame) -> DataFrame:
    """The codes of the words on at least ``WORD_SHARE`` of all pages, for all hosts."""
    total = pages.count()
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_WORDS.pattern), F.lit(0)))).alias("word")
    counts = pages.select(words).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # At most a page's average number of distinct words divided by the share.
    common = [r.word for r in counts.filter(F.col("n") >= max(WORD_SHARE * total, WORD_PAGES)).collect()]
    return pages.sparkSession.createDataFrame([(None, _code("word", w)) for w in common], "host string, code bigint")


def voted(pages: DataFrame, frame: DataFrame) -> DataFrame:
    """``frame`` with the codes of frame lines that open link lists and of prefixes that point elsewhere."""

    def work(rows, model_of) -> Iterator[pa.RecordBatch]:
        yield from _counted((host, code, vote) for _, host, _, lines in rows for code, vote in container_votes(lines, model_of(host)))

    votes = _with_model(pages, frame, work, _COUNTS).groupBy("host", "code").agg(F.sum("n").alias("n"), F.sum("yes").alias("yes"))
    votes = materialize(votes, "votes")
    every = votes.groupBy("code").agg(F.sum("n").alias("all_n"), F.sum("yes").alias("all_yes"), F.count(F.lit(1)).alias("hosts"))
    lists = frame.select(F.col("host").alias("_h"), F.col("code").bitwiseXOR(F.lit(1)).alias("_c"))
    # A host with few votes leans on those of the others.
    joined = votes.join(every, "code")
    weight = (F.col("yes") + 3 * F.col("all_yes") / F.col("all_n")) / (F.col("n") + 3)
    is_list = lists.select("_c").distinct()
    own = joined.join(is_list, F.col("code") == F.col("_c"), "left_semi").filter((weight > 0.5) & F.col("host").isNotNull()).select("host", "code")
    sizes = pages.groupBy(F.col("host").alias("_h")).agg(F.count(F.lit(1)).alias("pages"))
    # Pages count, not lines: one page with many lines of a prefix is one.
    stands = pages.select("host", F.explode(F.array_distinct("prefixes")).alias("code")).filter("code is not null and host is not null")
    stands = stands.groupBy("host", "code").agg(F.count(F.lit(1)).alias("on")).filter(F.col("on") >= PREFIX_PAGES)
    own_prefixes = (
        votes.filter((F.col("n") >= PREFIX_PAGES) & (F.col("yes") >= 0.9 * F.col("n")))
        .join(is_list, F.col("code") == F.col("_c"), "left_anti")
        .join(stands, ["host", "code"])
        .join(sizes, F.col("host") == F.col("_h"))
        .filter(F.col("on") >= HOST_SHARE * F.col("pages"))
        .select("host", "code")
    )
    total = sizes.agg(F.sum("pages").alias("t"))  # one row
    prefixes = (
        every.join(is_list, F.col("code") == F.col("_c"), "left_anti")
        .filter((F.col("all_n") >= PREFIX_PAGES) & (F.col("all_yes") >= 0.9 * F.col("all_n")))
        .crossJoin(F.broadcast(total))
        .filter(F.col("all_n") >= PREFIX_SHARE * F.col("t"))
        .select(F.lit(None).cast("string").alias("host"), "code")
    )
    return materialize(frame.unionByName(own).unionByName(own_prefixes).unionByName(prefixes).distinct(), "model")


def article_line_numbers(pages: DataFrame, key: str = "page_id", site: str = "site", text: str = "text") -> DataFrame:
    """``key, line_no`` of the lines of each page's article; in markup, of the lines that have text of it."""
    plain, markup = distinct_pages(pages, key, site, text)
    base = parsed(plain)
    model = voted(base, templates(base))

    def work(rows, model_of) -> Iterator[pa.RecordBatch]:
        ids, numbers = [], []
        for page, host, _, lines in rows:
            for no in article_lines(lines, model_of(host)):
                ids.append(page), numbers.append(no)
            if len(ids) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32())], names=["page_id", "line_no"])
                ids, numbers = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32())], names=["page_id", "line_no"])

    found = _with_model(base, model, work, "page_id bigint, line_no int")
    if markup is not None:
        found = found.unionByName(kept_blocks(markup).select("page_id", F.explode(F.flatten(F.transform("blocks", lambda b: b["lines"]))).alias("line_no")))
    return found.distinct().select(F.col("page_id").alias(key), "line_no")


def articles(pages: DataFrame, key: str = "page_id", site: str = "site", text: str = "text") -> DataFrame:
    """``key, article`` of each distinct page: the article's lines or blocks, an empty text if there are none."""
    plain, markup = distinct_pages(pages, key, site, text)
    base = parsed(plain)
    model = voted(base, templates(base))

    def work(rows, model_of) -> Iterator[pa.RecordBatch]:
        ids, bodies, held = [], [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bodies, pa.string())], names=["page_id", "article"])

        for page, host, body, lines in rows:
            keep = set(article_lines(lines, model_of(host)))
            ids.append(page)
            bodies.append("\n".join(x.rstrip("\r") for i, x in enumerate(body.split("\n"), 1) if i in keep))
            held += len(bodies[-1])
            if held > 8 << 20:
                yield batch()
                ids, bodies, held = [], [], 0
        yield batch()

    found = _with_model(base, model, work, "page_id bigint, article string")
    if markup is not None:
        found = found.unionByName(kept_blocks(markup).select("page_id", F.array_join(F.transform("blocks", lambda b: b["text"]), "\n").alias("article")))
    return found.select(F.col("page_id").alias(key), "article")
