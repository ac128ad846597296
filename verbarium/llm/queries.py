"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbarium.llm.words import MONTHS
from verbarium.sources.tables import table


_SCORES = ["tfidf", "phrase_logp", "clicks", "page_rank"]


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    from verbarium.llm.rank_fusion import latest_scores

    saved = latest_scores(table(spark, d, "page_rank_store")).select(F.col("node").cast("long").alias("doc_id"), F.col("score").alias("page_rank"))
    hits = table(spark, d, "query_hits").select("query_id", "doc_id", "tfidf", "phrase_logp", "clicks")
    return hits.join(saved, "doc_id", "left")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from verbarium.llm.rank_fusion import best_items

    return best_items(_candidates(spark, d), "query_id", "doc_id", _SCORES, 5).select("query_id", "doc_id")


def p6_ranking(spark: SparkSession, d: str) -> DataFrame:
    from verbarium.llm.rank_fusion import full_ranking

    return full_ranking(_candidates(spark, d), "query_id", "doc_id", _SCORES)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    from verbarium.llm.encode import encode_documents

    return encode_documents(table(spark, d, "documents"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from verbarium.llm.site_lines import repeated_line_numbers

    return repeated_line_numbers(table(spark, d, "documents"))


def p1_cleaned(spark: SparkSession, d: str) -> DataFrame:
    from verbarium.llm.site_lines import without_repeated_lines

    return without_repeated_lines(table(spark, d, "documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from verbarium.llm.page_body import article_line_numbers

    return article_line_numbers(table(spark, d, "web_corpus"))


def p2_articles(spark: SparkSession, d: str) -> DataFrame:
    from verbarium.llm.page_body import articles

    return articles(table(spark, d, "web_corpus"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    from verbarium.llm.term_counts import term_bands, term_counts

    return term_bands(term_counts(table(spark, d, "documents"), table(spark, d, "word_dict")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_counts(spark, d).filter("band <> 'useful'").select("term", "band")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from verbarium.llm.near_dup import similar_pairs

    return similar_pairs(table(spark, d, "documents"), width=3, threshold=0.5, min_words=40)


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    from verbarium.llm.near_dup import similar_groups

    return similar_groups(table(spark, d, "documents"), width=3, threshold=0.5, min_words=40)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from verbarium.llm.distinctive import distinctive_words

    return distinctive_words(table(spark, d, "documents")).select("doc_id", "term")


def p5_scores(spark: SparkSession, d: str) -> DataFrame:
    from verbarium.llm.distinctive import distinctive_words

    return distinctive_words(table(spark, d, "documents"), best=5, smooth=1.0, normalize=True)


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    from verbarium.llm.encode import count_tokens
    from verbarium.llm.packing import pack

    return pack(count_tokens(table(spark, d, "documents")), "doc_id", "n_tokens", 2048)


def p9_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers, with the number of cases that break it.

    No container holds more than its capacity; every token of every text lies in one part;
    only texts longer than a container are split, and all their parts but the last fill one;
    containers are numbered without gaps; and there are at most 1 % more than the tokens need.
    """
    from verbarium.llm.encode import count_tokens
    from verbarium.llm.packing import pack
    from verbarium.session import materialize

    capacity = 2048
    counted = materialize(count_tokens(table(spark, d, "documents")).filter("n_tokens > 0"), "sizes")
    parts = materialize(pack(counted, "doc_id", "n_tokens", capacity), "containers")
    sizes = counted.select("doc_id", F.col("n_tokens").alias("size"))
    filled = parts.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    per = parts.groupBy("doc_id").agg(
        F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("parts"), F.max(F.col("first") + F.col("n_tokens")).alias("last"),
        F.count(F.when((F.col("n_tokens") < capacity), 1)).alias("short"), F.max(F.when(F.col("first") != F.col("part_no") * capacity, 1)).alias("moved"),
    )
    both = per.join(sizes, "doc_id", "full")
    whole = F.coalesce((F.col("n") == F.col("size")) & (F.col("last") == F.col("size")) & F.col("moved").isNull(), F.lit(False))
    one = lambda name, df: df.select(F.lit(name).alias("invariant"), "cases")
    need = sizes.agg(F.ceil(F.sum("size") / capacity).alias("need"))  # one row
    count = filled.agg(F.count(F.lit(1)).alias("n"), F.max("container_id").alias("last"))  # one row
    return (
        one("over capacity", filled.agg(F.count(F.when(F.col("used") > capacity, 1)).alias("cases")))
        .unionByName(one("tokens lost or repeated", both.agg(F.count(F.when(~whole, 1)).alias("cases"))))
        .unionByName(one("split needlessly", both.agg(F.count(F.when((F.col("parts") != F.ceil(F.col("size") / capacity)) | (F.col("short") > 1), 1)).alias("cases"))))
        .unionByName(one("gaps in numbers", count.select(F.coalesce(F.col("last") + 1 - F.col("n"), F.lit(0)).alias("cases"))))
        .unionByName(one("too many containers", count.crossJoin(F.broadcast(need)).select((F.col("n") > F.ceil(F.col("need") * 1.01)).cast("bigint").alias("cases"))))
    )


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts that the token ids stand for: an exact round trip."""
    from verbarium.llm.encode import decode_documents

    return decode_documents(p8_ids(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from verbarium.llm.truncation import truncated

    return truncated(table(spark, d, "documents")).filter("cut").select("doc_id")


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    from verbarium.llm.truncation import truncation_rates

    return truncation_rates(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_cleaned, p2_found, p2_articles, p3_found, p3_counts, p4_found, p4_groups, p5_found, p5_scores, p6_found, p6_ranking, p8_ids, p8_decoded, p9_containers, p9_invariants, p10_found, p10_sources)}


_WORDS = """
docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
tf AS (
    SELECT doc_id, term, count(*) AS tf
    FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM docs)
    GROUP BY doc_id, term
)"""

_TERMS = f"""
WITH {_WORDS},
counted AS (SELECT term, sum(tf) AS tf, count(*) AS df FROM tf GROUP BY term),
listed AS (
    SELECT DISTINCT lower(regexp_replace(word, '^[\\s\\x{{00a0}}\\x{{3000}}\\x{{feff}}\\x{{200b}}]+|[\\s\\x{{00a0}}\\x{{3000}}\\x{{feff}}\\x{{200b}}]+$', '', 'g')) AS term
    FROM word_dict WHERE lang = 'en' AND word IS NOT NULL
),
every AS (SELECT term, tf, df FROM counted UNION ALL SELECT term, 0, 0 FROM listed WHERE term <> ''),
summed AS (SELECT term, sum(tf)::BIGINT AS tf, sum(df)::BIGINT AS df FROM every GROUP BY term),
banded AS (
    SELECT term, tf, df, CASE WHEN df < 3 THEN 'rare' WHEN df > 0.2 * (SELECT count(*) FROM docs) THEN 'common' ELSE 'useful' END AS band
    FROM summed
)"""


def _scores(best: int, smooth: str, norm: str) -> str:
    return f"""
WITH {_WORDS},
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2),
long AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id HAVING count(*) >= 20),
scored AS (
    SELECT doc_id, term, round((1 + log10(tf)) * log10(((SELECT count(*) FROM docs) + {smooth}) / (df + {smooth})) / {norm}, 6) AS score
    FROM tf JOIN df USING (term) JOIN long USING (doc_id)
),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS place FROM scored)"""


_MONTHS = ", ".join(f"'{m}'" for m in MONTHS)
_REPEATED = f"""
WITH lines AS (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no
    FROM documents WHERE text IS NOT NULL
),
forms AS (
    SELECT doc_id, source, line_no, line, regexp_replace(array_to_string(list_filter(
        string_split_regex(lower(line), '[^\\p{{L}}\\p{{M}}]+'), lambda x: x NOT IN ({_MONTHS})), ''), '[\\x{{FE00}}-\\x{{FE0F}}]', '', 'g') AS form
    FROM lines
),
sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
repeated AS (
    SELECT f.source, form FROM forms f JOIN sizes s ON f.source IS NOT DISTINCT FROM s.source WHERE form <> ''
    GROUP BY f.source, form, n HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id) >= 0.1 * n
),
hits AS (SELECT doc_id, line_no FROM forms f JOIN repeated r ON f.source IS NOT DISTINCT FROM r.source AND f.form = r.form)"""

_SIMILAR = """
WITH words AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
shingles AS (
    SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 40)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT a, b, k = x.n AND k = y.n AS equal FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 2 * k >= x.n + y.n - k)"""

#: Classes are documents of equal sets, groups the components of all pairs.
_GROUPS = f"""
WITH RECURSIVE {_SIMILAR.split('WITH ', 1)[1]},
ends AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
classes AS (SELECT doc_id, least(doc_id, (SELECT min(a) FROM pairs p WHERE p.b = doc_id AND equal)) AS class FROM sizes),
links AS (SELECT DISTINCT x.class AS c, y.class AS o FROM ends JOIN classes x ON x.doc_id = a JOIN classes y ON y.doc_id = b WHERE x.class <> y.class),
reached AS (SELECT doc_id, doc_id AS other FROM sizes UNION SELECT doc_id, b FROM reached JOIN ends ON other = a)
SELECT doc_id, class AS class_id, (SELECT min(other) FROM reached r WHERE r.doc_id = c.doc_id) AS group_id, (SELECT count(*) FROM links WHERE links.c = c.class) AS n_links FROM classes c"""

_RANKING = """
WITH clean AS (SELECT node, run_at, CASE WHEN score::VARCHAR = 'nan' THEN NULL ELSE score END AS score FROM page_rank_store WHERE node IS NOT NULL),
saved AS (
    SELECT node, score AS page_rank FROM clean
    QUALIFY row_number() OVER (PARTITION BY node ORDER BY run_at DESC NULLS LAST, score DESC NULLS LAST) = 1
),
items AS (
    SELECT query_id, doc_id, max(CASE WHEN tfidf::VARCHAR = 'nan' THEN NULL ELSE tfidf END) AS tfidf,
        max(CASE WHEN phrase_logp::VARCHAR = 'nan' THEN NULL ELSE phrase_logp END) AS phrase_logp, max(clicks) AS clicks, max(page_rank) AS page_rank
    FROM query_hits LEFT JOIN saved ON node = doc_id WHERE query_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL
),
placed AS (
    SELECT query_id, doc_id, unnest([
        rank() OVER (PARTITION BY query_id ORDER BY tfidf DESC NULLS LAST),
        rank() OVER (PARTITION BY query_id ORDER BY phrase_logp DESC NULLS LAST),
        rank() OVER (PARTITION BY query_id ORDER BY clicks DESC NULLS LAST),
        rank() OVER (PARTITION BY query_id ORDER BY page_rank DESC NULLS LAST)]) AS place
    FROM items
),
fused AS (SELECT query_id, doc_id, median(place) AS median_place, avg(place) AS mean_place FROM placed GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY median_place, mean_place, doc_id) AS place FROM fused)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _REPEATED + "SELECT doc_id, line_no FROM hits",
        "p1_cleaned": _REPEATED + """
            , kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text, count(*) AS n FROM forms ANTI JOIN hits USING (doc_id, line_no) GROUP BY doc_id)
            SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
                CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) - coalesce(k.n, 0) END::INT AS n_removed
            FROM documents d LEFT JOIN kept k USING (doc_id)""",
        "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p9_invariants": "SELECT unnest(['over capacity', 'tokens lost or repeated', 'split needlessly', 'gaps in numbers', 'too many containers']) AS invariant, 0::BIGINT AS cases",
        "p4_found": _SIMILAR + "SELECT a AS doc_id_a, b AS doc_id_b FROM pairs",
        "p4_groups": _GROUPS,
        "p3_found": _TERMS + "SELECT term, band FROM banded WHERE band <> 'useful'",
        "p3_counts": _TERMS + "SELECT term, tf, df, band FROM banded",
        "p5_found": _scores(3, "0.0", "1") + "SELECT doc_id, term FROM placed WHERE place <= 3",
        "p6_found": _RANKING + "SELECT query_id, doc_id FROM ranked WHERE place <= 5",
        "p6_ranking": _RANKING + "SELECT query_id, doc_id, median_place, mean_place, place FROM ranked",
        "p5_scores": _scores(5, "1.0", "sqrt(n)") + "SELECT doc_id, term, score FROM placed WHERE place <= 5",
    }
