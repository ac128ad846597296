"""Texts that were cut off (problem 10).

Per source, histograms of text lengths in characters and in bytes are tested for a spike
at the maximum, as a field limit leaves it. A text at a spike is cut, whether its last line
has letters or not, unless it ends with terminal punctuation or with a whole line that other
documents have too. Cuts in mid transfer leave no spike; such a text is cut if a mark of a
cut follows an open sentence, or if its last line has no end though lines like it have one.

What lines like it do is learned from all texts' lines that another line follows, which are
whole. A line's kind is told by how it begins (the first three pieces of its first word, with
letters, digits and signs apart) and by the signs within its last word. Where lines of the
source that begin alike mostly have no end (lists, signatures, commands), or where words with
the same signs mostly end their line (addresses, code), having no end is no sign of a cut. A
source with few such lines leans on those of all sources, and these, if few, on ``PRIOR``. Nor is a
line cut that stands whole elsewhere: followed by other lines in at least two texts, or at
the end of at least ``SITE_SHARE`` of the source's texts, those at a spike aside. Texts that
differ in their last line only, or not at all, count once: copies of a cut text are one witness.

Defined cases: null, empty and blank texts are not cut; a null source is a source of its
own; repeated rows are judged alike, and equal texts alone make no spike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbarium.llm.words import line_form
from verbarium.session import materialize

#: Rows at the maximum that make a spike, and their factor over what the lengths below let
#: expect, both on average and just below.
SPIKE_ROWS, SPIKE_FACTOR = 3, 5.0
#: Lengths over which the rest of a character spreads a cut at a byte limit.
BYTE_SLACK = 3
#: Share of a source's distinct texts, and number, that make a last line one of the site's.
SITE_SHARE, SITE_ROWS = 0.01, 3
#: Share of lines without an end, or of words at the end of their line, from which no end is usual.
USUAL = 0.6
#: What is expected before any line is seen of forms with and without signs, and the weight of that in
#: lines of 25 characters or in words; the rates of all sources weigh as much in each source.
PRIOR, PRIOR_WEIGHT = (0.9, 0.2), 20.0
#: Forms up to which they are broadcast.
BROADCAST_FORMS = 500_000

#: What may follow the end of a text.
_BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff\xad"
_BLANK = r"[\s\h​﻿­]"
_MARK = rf"(?:{_BLANK}*(?:\[\.\.\.\]|\[…\]|\(\.\.\.\)|…|\.\.\.|�))+$"
_CLOSING = ")]\"'”’」』»"
#: Signs at which a sentence ends, and signs after which a text that nothing speaks against may end.
_STOPS, _ENDS = list(".!?。！？"), list(".!?;:。！？；：")
#: Signs that prose does not have within its words; or a dot, colon or bracket between plain letters or digits.
_SIGNS = r"[/@\\{}\[\]<>=_#$*+^~|`]|[.:(](?<=[A-Za-z0-9].)[A-Za-z0-9(]"


def _rtrim(text: Column, signs: str) -> Column:
    """Without these signs at the end; most texts have none, so they are looked at first."""
    return F.when(F.right(text, F.lit(1)).isin(list(signs)), F.rtrim(text, F.lit(signs))).otherwise(text)


def _trimmed(line: Column) -> Column:
    """Without blanks and signs of a link around the end."""
    return _rtrim(line, _BLANKS + "|>»")


def _ends_in(trimmed: Column, signs: list[str]) -> Column:
    return F.right(_rtrim(trimmed, _CLOSING), F.lit(1)).isin(signs)


def _is_blank(line: Column) -> Column:
    return ~line.rlike(f"[^{_BLANKS}]")


def _lead(line: Column) -> Column:
    """How a line begins: the first three pieces of its first word, letters and digits as classes."""
    first = F.regexp_extract(line, rf"^{_BLANK}*((?:\p{{L}}+|\d+|[^\p{{L}}\d\s\h]){{1,3}})", 1)
    for signs, name in ((r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]+", "字"), (r"[\p{L}&&[^字]]+", "a"), (r"\d+", "0")):
        first = F.regexp_replace(first, signs, name)
    return first


def _signs(word: Column) -> Column:
    """The different signs of a word in their order."""
    return F.array_join(F.array_distinct(F.split(F.regexp_replace(word, r"[\p{L}\p{M}\d]+", ""), "")), "")


def _last_word(trimmed: Column) -> Column:
    return F.regexp_extract(trimmed, r"([^\s\h]+)$", 1)


def text_ends(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """What the verdict on each row needs, as a table; null and blank texts have a null ``last``."""
    t = F.col("text")
    body = _rtrim(t, _BLANKS)
    # Only a text that ends like a mark is searched for one.
    open_end = F.when(F.right("body", F.lit(1)).isin(")", "]", "…", "\ufffd") | F.endswith("body", F.lit("...")), F.regexp_replace(F.col("body"), _MARK, "")).otherwise(F.col("body"))
    # After the last line break, without splitting the text.
    last = F.substring_index("open", "\n", -1)
    word = _last_word(F.col("trimmed"))
    return materialize(
        docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text"))
        .withColumn("body", body)
        .withColumn("open", open_end)
        .withColumn("last", F.when(F.length("open") > 0, last))
        .withColumn("trimmed", _trimmed(F.col("last")))
        .select(
            "key",
            "source",
            F.length(t).cast("long").alias("chars"),
            F.octet_length(t).cast("long").alias("bytes"),
            F.xxhash64(t).alias("hash"),
            F.xxhash64(F.left("open", F.length("open") - F.length("last"))).alias("rest"),
            (F.length("open") < F.length("body")).alias("marked"),
            _ends_in(F.col("trimmed"), _ENDS).alias("ended"),
            _ends_in(F.col("trimmed"), _STOPS).alias("stopped"),
            _lead(F.col("last")).alias("lead"),
            F.when(word.rlike(_SIGNS), _signs(word)).alias("signs"),
            F.when(F.length(line_form(F.col("last"))) > 0, F.xxhash64(line_form(F.col("last")))).alias("form"),
            F.col("last").isNotNull().alias("filled"),
        ),
        "ends",
    )


def _rates(counts: DataFrame, prior: Column) -> DataFrame:
    """``source, kind, rate, all`` from ``source, kind, n, yes``: the rates in the source and in all."""
    every = counts.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("yes").alias("yes")).select(
        F.col("kind").alias("_k"), ((F.col("yes") + PRIOR_WEIGHT * prior) / (F.col("n") + PRIOR_WEIGHT)).alias("all")
    )
    own = counts.join(every, F.col("kind") == F.col("_k"))
    return own.select("source", "kind", ((F.col("yes") + PRIOR_WEIGHT * F.col("all")) / (F.col("n") + PRIOR_WEIGHT)).alias("rate"), "all")


def line_habits(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """``what, source, kind, rate, all``: how usual it is, in a source and in all, that lines have no end.

    For ``what`` = lead, the share of lines that begin so and have no end, longer lines
    weighing more; for signs, the share of words with these signs that end their line.
    One row for each kind that a source has: some hundreds, whatever the number of texts.
    """
    lines = F.split(_rtrim(F.col("text"), _BLANKS), "\n")
    inner = F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))
    each = docs.select(F.col(source).alias("source"), F.col(text).alias("text")).filter("text is not null").select("source", F.explode(inner).alias("line")).filter(~_is_blank(F.col("line")))
    each = each.withColumn("trimmed", _trimmed(F.col("line")))

    def counted(what: str, kind: Column, n: Column, yes: Column) -> Column:
        return F.struct(F.lit(what).alias("what"), kind.alias("kind"), n.alias("n"), F.when(yes, n).otherwise(0.0).alias("yes"))

    lead = counted("lead", _lead(F.col("line")), F.sqrt(F.length("trimmed")) / 5, ~_ends_in(F.col("trimmed"), _ENDS))

    def of_words(words: Column) -> Column:
        placed = F.transform(words, lambda x, i: F.struct(x.alias("word"), (i == F.size(words) - 1).alias("last")))
        return F.transform(F.filter(placed, lambda x: x["word"].rlike(_SIGNS)), lambda x: counted("signs", _signs(x["word"]), F.lit(1.0), x["last"]))

    signs = F.transform(F.array(F.split("trimmed", r"[\s\h]+")), of_words)[0]  # split once, however often it is used
    # Both counts in one pass over the lines; only lines with signs are split into words.
    both = F.when(F.col("trimmed").rlike(_SIGNS), F.concat(F.array(lead), signs)).otherwise(F.array(lead))
    counts = each.select("source", F.explode(both).alias("c")).groupBy("source", "c.what", "c.kind").agg(F.sum("c.n").alias("n"), F.sum("c.yes").alias("yes"))
    counts = materialize(counts, "habits")
    has_signs, without = map(F.lit, PRIOR)
    leads, ends = (counts.filter(F.col("what") == w).drop("what") for w in ("lead", "signs"))
    return materialize(
        _rates(leads, F.when(_structural(F.col("kind")), has_signs).otherwise(without))
        .select(F.lit("lead").alias("what"), "*")
        .unionByName(_rates(ends, has_signs).select(F.lit("signs").alias("what"), "*")),
        "habits",
    )


def _structural(lead: Column) -> Column:
    """Whether a line begins with a sign, a numbering or a word with signs, rather than with a word, number, quote or bracket."""
    return lead.rlike(r"^[^\p{L}0\"'“‘(\[「『]|^0[.)、]$|^a[.:@/_]")


def length_spikes(ends: DataFrame) -> DataFrame:
    """``source, measure, low, high``: the lengths that a field limit left, for the sources that have one."""
    measures = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("length"), F.lit(s).alias("slack")) for m, s in (("chars", 1), ("bytes", BYTE_SLACK))]))
    histogram = (
        ends.filter("filled")
        .select("source", "hash", measures.alias("m"))
        .groupBy("source", "m.measure", "m.length", "m.slack")
        .agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("h1"), F.max("hash").alias("h2"))
    )
    top = histogram.groupBy("source", "measure").agg(F.max("length").alias("high"))
    top = top.select(F.col("source").alias("_s"), F.col("measure").alias("_m"), "high")
    # A histogram has as many rows as a source has lengths, so this join has no heavy rows.
    at = histogram.join(top, F.col("source").eqNullSafe(F.col("_s")) & (F.col("measure") == F.col("_m")))
    near = F.col("length") > F.col("high") - F.col("slack")
    below = (F.col("length") >= F.col("high") * 0.8) & ~near
    next_to = ~near & (F.col("length") > F.col("high") - 2 * F.col("slack"))
    sums = at.groupBy("source", "measure", "high", "slack").agg(
        F.sum(F.when(near, F.col("n")).otherwise(0)).alias("n_top"),
        F.sum(F.when(below, F.col("n")).otherwise(0)).alias("n_below"),
        F.sum(F.when(next_to, F.col("n")).otherwise(0)).alias("n_next"),
        F.min(F.when(near, F.col("h1"))).alias("h1"),
        F.max(F.when(near, F.col("h2"))).alias("h2"),
    )
    expected = F.col("n_below") / (F.col("high") * 0.2 + 1) * F.col("slack")
    usual = SPIKE_FACTOR * F.greatest(expected, F.col("n_next"))
    spike = (F.col("n_top") >= SPIKE_ROWS) & (F.col("n_top") >= usual) & (F.col("h1") != F.col("h2"))
    return sums.filter(spike).select("source", "measure", (F.col("high") - F.col("slack") + 1).alias("low"), "high")


def _known_forms(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """``form`` of the wanted lines that stand in two texts, their last lines aside, with another line after them."""
    lines = F.split(_rtrim(F.col(text), _BLANKS), "\n")
    rest = F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))
    forms = F.array_distinct(F.transform(F.filter(rest, lambda x: (F.length(x) > 1) & ~_ends_in(_rtrim(x, _BLANKS), _ENDS)), lambda x: F.xxhash64(line_form(x))))
    each = docs.filter(F.col(text).isNotNull()).select(F.xxhash64(rest).alias("rest"), F.explode(forms).alias("form"))
    wanted = materialize(wanted.distinct(), "wanted")
    few = wanted.count() <= BROADCAST_FORMS
    found = each.join(F.broadcast(wanted) if few else wanted, "form", "left_semi")
    return found.groupBy("form").agg(F.count_distinct("rest").alias("n")).filter("n >= 2").select("form")


def _with_habits(ends: DataFrame, habits: DataFrame) -> DataFrame:
    """With ``usual``: whether lines of the source that begin or end like the last one mostly have no end."""
    hint = F.broadcast if habits.count() <= BROADCAST_FORMS else lambda x: x
    has_signs, without = PRIOR
    for what in ("lead", "signs"):
        mine = habits.filter(F.col("what") == what)
        own = mine.select(F.col("source").alias("_s"), F.col("kind").alias("_k"), "rate")
        every = mine.select(F.col("kind").alias("_k"), F.col("all")).distinct()
        ends = ends.join(hint(own), F.col("source").eqNullSafe(F.col("_s")) & (F.col(what) == F.col("_k")), "left").drop("_s", "_k")
        ends = ends.join(hint(every), F.col(what) == F.col("_k"), "left").drop("_k")
        unseen = F.when(_structural(F.col("lead")), has_signs).otherwise(without) if what == "lead" else F.when(F.col("signs").isNotNull(), has_signs)
        ends = ends.withColumn(f"by_{what}", F.coalesce("rate", "all", unseen, F.lit(0.0)) >= USUAL).drop("rate", "all")
    return ends.withColumn("usual", F.col("by_lead") | F.col("by_signs"))


def truncated(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``key, source, filled, cut, evidence`` of each row; the evidence of a cut is a spike, a mark or an open line."""
    ends = text_ends(docs, key, text, source)
    spikes = length_spikes(ends)
    limit = spikes.groupBy("source").agg(
        *[F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}") for m in ("chars", "bytes") for c in ("low", "high")]
    )
    limit = materialize(limit.withColumnRenamed("source", "_source"), "limits")
    small = limit.count() <= BROADCAST_FORMS
    at_limit = F.coalesce(F.col("chars").between(F.col("chars_low"), F.col("chars_high")), F.lit(False)) | F.coalesce(F.col("bytes").between(F.col("bytes_low"), F.col("bytes_high")), F.lit(False))
    judged = ends.join(F.broadcast(limit) if small else limit, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("spike", at_limit)
    judged = _with_habits(judged, line_habits(docs, text, source))
    signed = F.col("spike") | F.col("marked")
    open_end = F.col("filled") & ((signed & ~F.col("stopped")) | (~F.col("ended") & ~F.col("usual")))
    judged = judged.select("key", "source", "filled", "hash", "rest", "form", "spike", open_end.alias("open"), F.col("marked").alias("sure"))
    asked = judged.filter(F.col("open") & ~F.col("sure") & F.col("form").isNotNull()).select("form")
    known = materialize(_known_forms(docs, asked, text), "known").withColumn("known", F.lit(True))
    few = known.count() <= BROADCAST_FORMS
    joined = judged.join(F.broadcast(known) if few else known, "form", "left")
    sizes = judged.groupBy("source").agg(F.count_distinct("hash").alias("n_all"))
    ends_of = judged.filter("form is not null and not spike").groupBy("source", "form").agg(F.count_distinct("rest").alias("n_end"))
    site = ends_of.filter(F.col("n_end") >= SITE_ROWS).join(
        sizes.select(F.col("source").alias("_s"), "n_all"), F.col("source").eqNullSafe(F.col("_s"))
    ).filter(F.col("n_end") >= SITE_SHARE * F.col("n_all"))
    # At most 1 / SITE_SHARE forms a source.
    site = materialize(site.select(F.col("source").alias("_s"), F.col("form").alias("_f")), "site_ends").withColumn("site", F.lit(True))
    few = site.count() <= BROADCAST_FORMS
    on = F.col("source").eqNullSafe(F.col("_s")) & (F.col("form") == F.col("_f"))
    joined = joined.join(F.broadcast(site) if few else site, on, "left").withColumn("known", F.coalesce("known", "site"))
    cut = F.col("open") & (F.col("sure") | (F.col("known").isNull() & (F.col("form").isNotNull() | F.col("spike"))))
    joined = joined.withColumn("cut", F.coalesce(cut, F.lit(False)))
    evidence = F.when(F.col("cut"), F.when(F.col("spike"), "spike").when(F.col("sure"), "mark").otherwise("open line"))
    return joined.select(F.col("key").alias(key), F.col("source").alias(source), "filled", "cut", evidence.alias("evidence"))


def truncation_rates(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``source, n_texts, n_cut, share`` of each source's non-null texts, and the cut ones by evidence: ``n_spike, n_mark, n_open``."""
    present = docs.filter(F.col(text).isNotNull())
    kinds = [F.count(F.when(F.col("evidence") == e, 1)).alias(n) for e, n in (("spike", "n_spike"), ("mark", "n_mark"), ("open line", "n_open"))]
    return (
        truncated(present, key, text, source)
        .groupBy(source)
        .agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.col("cut").cast("long")).alias("n_cut"), *kinds)
        .withColumn("share", F.round(F.col("n_cut") / F.col("n_texts"), 6))
    )
