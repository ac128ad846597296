"""Boolean, phrase and ranked search.

Results are rows of documents, equal texts each for themselves; deleted documents are no
hits. Texts are joined last, to the hits alone.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbarium.functions.text import Analyzer
from verbarium.operators.index import BROADCAST_SEGMENTS, TextIndex
from verbarium.operators.running import running_total
from verbarium.operators.scoring import Queries, place_all, summarize
from verbarium.session import materialize

_ID = ["seg_id", "doc_id"]
#: Pairs of query and term that are broadcast at a time, about 10 MB.
BROADCAST_TERMS = 100_000
#: Documents of a slice that a task scores at once: at most, and at least where slices are made for idle cores.
SLICE_DOCS, LEAST_DOCS = 32_768, 2_048


def query_terms(index: TextIndex, words: list[str], analyze: Analyzer | None = None) -> list[str]:
    """The tokens of the distinct words, analyzed as one text."""
    text = " ".join(dict.fromkeys(words))
    return index.spark.range(1).select((analyze or index.analyze)(F.lit(text)).alias("t")).first().t or []


def _live(index: TextIndex, hits: DataFrame) -> DataFrame:
    return hits.join(index.tombstones, _ID, "left_anti")


def _texts(index: TextIndex, hits: DataFrame) -> DataFrame:
    return hits.join(index.documents, _ID).select(*_ID, "key", "text", *[c for c in hits.columns if c not in _ID])


def _none(index: TextIndex) -> DataFrame:
    return index.documents.select(*_ID).limit(0)


def and_ids(index: TextIndex, terms: list[str]) -> DataFrame:
    """``seg_id, doc_id`` of the documents with every term; without terms none."""
    terms = sorted(set(terms))
    if not terms:
        return _none(index)
    rows = index.postings.filter(F.col("term").isin(terms)).select(*_ID)
    # A posting stands once for each term and document, so counting rows counts terms.
    return _live(index, rows.groupBy(*_ID).count().filter(F.col("count") == len(terms)).select(*_ID))


def or_ids(index: TextIndex, terms: list[str]) -> DataFrame:
    if not terms:
        return _none(index)
    return _live(index, index.postings.filter(F.col("term").isin(sorted(set(terms)))).select(*_ID).distinct())


def phrase_ids(index: TextIndex, terms: list[str]) -> DataFrame:
    """The documents in which the terms follow each other in this order."""
    if not index.positional:
        raise NotImplementedError("phrases need a positional index")
    if not terms:
        return _none(index)
    offsets: dict[str, list[int]] = {}
    for i, t in enumerate(terms):
        offsets.setdefault(t, []).append(i)
    shift = F.create_map(*[x for t, o in offsets.items() for x in (F.lit(t), F.array(*map(F.lit, o)))])
    # Each position votes for the places at which the phrase would begin. Both aggregations
    # use the one shuffle by document.
    starts = (
        index.postings.filter(F.col("term").isin(list(offsets)))
        .select(*_ID, "term", F.explode("positions").alias("pos"))
        .select(*_ID, "pos", F.explode(shift[F.col("term")]).alias("o"))
        .select(*_ID, (F.col("pos") - F.col("o")).alias("start"))
        .repartition(*_ID)
        .groupBy(*_ID, "start")
        .count()
        .filter(F.col("count") == len(terms))
    )
    return _live(index, starts.select(*_ID).distinct())


def search_keyword(index: TextIndex, keyword: str) -> DataFrame:
    return _texts(index, and_ids(index, query_terms(index, [keyword])))


def search_and(index: TextIndex, words: list[str]) -> DataFrame:
    return _texts(index, and_ids(index, query_terms(index, words)))


def search_or(index: TextIndex, words: list[str]) -> DataFrame:
    return _texts(index, or_ids(index, query_terms(index, words)))


def search_phrase(index: TextIndex, words: list[str]) -> DataFrame:
    text = " ".join(words)
    terms = index.spark.range(1).select(index.analyze(F.lit(text)).alias("t")).first().t or []
    return _texts(index, phrase_ids(index, terms))


def full_scan(docs: DataFrame, keyword: str, analyze: Analyzer, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose tokens include all of the keyword's, which must have one."""
    query = analyze(F.lit(keyword))
    return docs.filter((F.size(query) > 0) & (F.size(F.array_except(query, analyze(F.col(text)))) == 0))


def _idf(n: Column, df: Column) -> Column:
    return F.log10(n / df + 1)


def tfidf_scores(index: TextIndex, words: list[str], analyze: Analyzer | None = None, include_deleted: bool = False) -> DataFrame:
    """``seg_id, doc_id, score`` of every document with a term of the query.

    idf = log10(N / df + 1); the score is the sum over the query's terms of
    tf idf (idf times the term's count in the query), divided by the length of the
    document's vector of tf idf over the query's terms. N and df count deleted documents.
    """
    spark = index.spark
    text = " ".join(words)
    terms = Counter(spark.range(1).select((analyze or index.analyze)(F.lit(text)).alias("t")).first().t or [])
    if not terms:
        return _none(index).withColumn("score", F.lit(0.0))
    hits = index.postings.filter(F.col("term").isin(list(terms))).select(*_ID, "term", "tf")
    n = index.documents.agg(F.count(F.lit(1)).alias("n"))
    # Tables of one row and of one row per term of the query.
    stats = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", _idf(F.col("n"), F.col("df")).alias("idf"))
    count = F.create_map(*[x for t, c in sorted(terms.items()) for x in (F.lit(t), F.lit(float(c)))])[F.col("term")]
    weight = F.col("tf") * F.col("idf")
    scored = (
        hits.join(F.broadcast(stats), "term")
        .groupBy(*_ID)
        .agg(F.sum(weight * F.col("idf") * count).alias("dot"), F.sum(weight * weight).alias("square"))
        .select(*_ID, (F.col("dot") / F.sqrt("square")).alias("score"))
    )
    return scored if include_deleted else _live(index, scored)


def _ranked(df: DataFrame, digits: int | None) -> DataFrame:
    return df.withColumn("score", F.round("score", digits)) if digits is not None else df


def search_tfidf(
    index: TextIndex, words: list[str], top_k: int | None = None, analyze: Analyzer | None = None, digits: int | None = None, include_deleted: bool = False
) -> DataFrame:
    """The best documents by score, then segment and number; ``top_k`` None gives all, 0 none."""
    scores = _ranked(tfidf_scores(index, words, analyze, include_deleted), digits)
    if top_k is not None:
        scores = scores.orderBy(F.desc("score"), *_ID).limit(top_k)
    return _texts(index, scores).orderBy(F.desc("score"), *_ID)


def search_combined(
    index: TextIndex, words: list[str], pagerank: DataFrame, pr_weight: float, top_k: int | None = None, analyze: Analyzer | None = None, digits: int | None = None
) -> DataFrame:
    """TF-IDF plus ``pr_weight`` times the document's PageRank (``node, score``); unranked documents add nothing."""
    ids = index.documents.select(*_ID, "key")
    ranks = pagerank.select(F.col("node").alias("key"), F.col("score").alias("pr"))
    scores = (
        tfidf_scores(index, words, analyze)
        .join(ids, _ID)
        .join(ranks, "key", "left")
        .select(*_ID, (F.col("score") + pr_weight * F.coalesce("pr", F.lit(0.0))).alias("score"))
    )
    scores = _ranked(scores, digits)
    if top_k is not None:
        scores = scores.orderBy(F.desc("score"), *_ID).limit(top_k)
    return _texts(index, scores).orderBy(F.desc("score"), *_ID)


def search_batch(index: TextIndex, queries: DataFrame, query_id: str = "query_id", words: str = "keywords", top_k: str = "top_k", digits: int = 6) -> DataFrame:
    """TF-IDF of many queries at once: ``query_id, seg_id, doc_id, key, score, place``.

    Null words are left out, a null ``top_k`` gives all hits. The postings are read once, for
    the queries' terms alone, and written by document. Tasks score slices of documents and
    keep the best of each limited query. Of unlimited ones they count documents by score;
    from these counts come the places when the slices are scored again for the result, so
    that hits are neither sorted nor written, however many a query has. ``BROADCAST_TERMS``
    pairs of query and term are scored at a time.
    """
    spark = index.spark
    text = F.array_join(F.filter(F.col(words), lambda x: x.isNotNull()), " ")
    terms = queries.select(F.col(query_id).alias("query_id"), F.col(top_k).alias("k"), F.explode(index.analyze(text)).alias("term")).groupBy("query_id", "k", "term").agg(F.count(F.lit(1)).alias("n_query"))
    terms = materialize(terms, "terms")
    pairs = terms.count()
    hint = F.broadcast if pairs <= BROADCAST_TERMS else lambda x: x
    numbers = terms.select("term").distinct()
    numbers = materialize((numbers.coalesce(1) if pairs <= BROADCAST_TERMS else numbers).withColumn("t", F.monotonically_increasing_id()), "numbers")
    sizes = materialize(index.documents.groupBy("seg_id").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0)), "sizes")
    n, segments = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    slices = max(1, -(-n // SLICE_DOCS), min(4 * spark.sparkContext.defaultParallelism, -(-n // LEAST_DOCS)))
    starts = running_total(sizes, ["all"], [F.col("seg_id").asc()], F.col("n"), "start").select("seg_id", "n", "start")
    starts = F.broadcast(starts) if segments <= BROADCAST_SEGMENTS else starts
    no = F.col("start") + F.least(F.col("doc_id"), F.col("n") - 1)
    found = index.postings.select(*_ID, "term", "tf").join(hint(numbers), "term").groupBy(*_ID).agg(F.collect_list(F.struct("t", "tf")).alias("h"))
    found = found.join(index.documents.select(*_ID, "key"), _ID).join(starts, "seg_id")
    found = materialize(found.select(F.floor(no * slices / n).cast("int").alias("slice"), *_ID, "key", F.col("h.t").alias("ts"), F.col("h.tf").alias("tfs")), "hits")
    df = found.select(F.explode("ts").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    idf = df.select("t", _idf(F.lit(n), F.col("df")).alias("idf"))
    weighted = terms.join(hint(numbers.join(idf, "t")), "term").select("query_id", "k", "t", "n_query", "idf")
    blocks = -(-pairs // BROADCAST_TERMS)
    if blocks > 1:
        weighted = materialize(weighted, "weighted")
    live = _live(index, found).repartition(slices, "slice")
    kinds = {"query_id": terms.schema["query_id"].dataType.simpleString(), "k": terms.schema["k"].dataType.simpleString(), "key": found.schema["key"].dataType.simpleString()}
    parts = [_batch_block(live, weighted.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else weighted, slices, kinds, digits) for i in range(max(1, blocks))]
    return reduce(DataFrame.unionByName, parts)


def _batch_block(found: DataFrame, weighted: DataFrame, slices: int, kinds: dict[str, str], digits: int) -> DataFrame:
    shared = found.sparkSession.sparkContext.broadcast(Queries(weighted.toArrow(), digits))
    row = f"seg_id int, doc_id int, key {kinds['key']}, score double"
    first = found.groupBy("slice").applyInArrow(summarize(shared), f"query_id {kinds['query_id']}, k {kinds['k']}, q int, slice int, {row}, n bigint")
    first = materialize(first, "best")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), *_ID))
    limited = first.filter("n is null").withColumn("place", place).filter(F.col("place") <= F.col("k"))
    # One row for each score of a query and slice that has it.
    counts = first.filter("n is not null").select("q", "score", "slice", "n")
    before = running_total(counts, ["q"], [F.col("score").desc(), F.col("slice").asc()], F.col("n"), "before").drop("n")
    rows = found.unionByName(before, allowMissingColumns=True).repartition(slices, "slice")
    every = rows.groupBy("slice").applyInArrow(place_all(shared), f"query_id {kinds['query_id']}, {row}, place int")
    return limited.select(*every.columns).unionByName(every)
