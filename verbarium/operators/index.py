"""A segmented, positional inverted index as ordinary tables.

Tables (``key`` is the source's id of a document, ``doc_id`` its number in its segment):

* documents  ``seg_id, doc_id, key, text``
* postings   ``seg_id, term, doc_id, tf, positions``; without positions in a plain index
* segments   ``seg_id, n_docs``, the catalogue
* tombstones ``seg_id, doc_id``

All of them are DataFrames. A stored index has a folder for each table and in it one for each
batch of segments that was added at once, named by its first segment; adding segments writes
their own files only, and deletions are added to the tombstones. Files are sorted by term, or
by segment and number, so that a query reads the row groups of its terms and segments and
the columns that it needs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbarium.functions.text import Analyzer, analyzer
from verbarium.operators.running import running_total
from verbarium.session import drop_path, has_path, materialize, scratch_path

#: Documents of one segment, and segments that start a merge.
FLUSH_DOCS, MERGE_SEGMENTS = 1000, 8
#: Segments up to which a table with one row for each is broadcast, about 24 MB.
BROADCAST_SEGMENTS = 1_000_000
_SEGMENTS, _TOMBSTONES = "seg_id int, n_docs bigint", "seg_id int, doc_id int"
_ROW_BITS = 33


def _numbered(docs: DataFrame, key: str, text: str, per_segment: int, first_segment: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    # Repeated keys are told apart by their texts, so that many of them span tasks.
    order = [F.col("key").asc(), F.xxhash64("text").asc()]
    # The id has the task's number and the row's place in the task.
    row = F.monotonically_increasing_id()
    ranged = base.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    stored = materialize(ranged.select(F.shiftright(row, _ROW_BITS).cast("int").alias("slice"), row.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("place"), "key", "text"), "numbered")
    starts, total = [], 0
    for r in stored.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).orderBy("slice").collect():  # one row a task
        starts.append((r.slice, total))
        total += r.n
    no = F.col("start") + F.col("place")
    numbers = [(F.floor(no / per_segment) + first_segment).cast("int").alias("seg_id"), (no % per_segment).cast("int").alias("doc_id")]
    documents = stored.join(F.broadcast(spark.createDataFrame(starts, "slice int, start long")), "slice").select(*numbers, "key", "text")
    count = -(-total // per_segment)
    sizes = F.when(F.col("id") < count - 1, F.lit(per_segment)).otherwise(F.lit(total - (count - 1) * per_segment)).cast("bigint")
    return documents, spark.range(count).select((F.col("id") + first_segment).cast("int").alias("seg_id"), sizes.alias("n_docs"))


def number_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", per_segment: int = FLUSH_DOCS, first_segment: int = 0) -> DataFrame:
    """Documents in the order of their keys, in segments of ``per_segment``; null texts are no documents.

    The table is read and moved once, into ranges of keys that are written to the shared
    folder; a document's number is its place in its range after those of the ranges before.
    """
    return _numbered(docs, key, text, per_segment, first_segment)[0]


def no_tombstones(spark: SparkSession) -> DataFrame:
    """An empty table that the optimizer knows to be empty, so that joins with it go."""
    return spark.range(0).select(F.col("id").cast("int").alias("seg_id"), F.col("id").cast("int").alias("doc_id")).filter(F.lit(False))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _position_lists(pairs: Column) -> Column:
    """From sorted ``(term, pos)`` structs an array of ``(term, positions)``."""
    n = F.size(pairs)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(pairs, i)["term"] != F.get(pairs, i - 1)["term"]))

    def lists(at: Column) -> Column:
        def one(i: Column, k: Column) -> Column:
            run = F.slice(pairs, i + 1, F.coalesce(F.get(at, k + 1), n) - i)
            return F.struct(F.get(pairs, i)["term"].alias("term"), F.transform(run, lambda x: x["pos"]).alias("positions"))

        return F.transform(at, one)

    return _let(starts, lists)


def build_postings(documents: DataFrame, analyze: Analyzer) -> DataFrame:
    """``seg_id, term, doc_id, tf, positions``, made where the documents are: a posting never
    spans rows, so sorting a document's own tokens does and nothing is shuffled."""
    pairs = F.sort_array(F.transform(analyze(F.col("text")), lambda term, pos: F.struct(term.alias("term"), pos.alias("pos"))))
    posts = F.when(F.size(pairs) > 0, _let(pairs, _position_lists))
    each = documents.select("seg_id", "doc_id", F.explode(posts).alias("p"))
    return each.select("seg_id", "p.term", "doc_id", F.size("p.positions").alias("tf"), "p.positions")


@dataclass(frozen=True)
class TextIndex:
    """An index of some segments. Every change gives a new one; the tables of the old stay valid.

    ``path`` is the folder of a stored index: what is deleted or appended is stored there.
    """

    documents: DataFrame
    postings: DataFrame
    tombstones: DataFrame
    catalogue: DataFrame
    analyze: Analyzer = field(default_factory=analyzer)
    positional: bool = True
    path: str | None = None
    #: Whether the documents are read from files as they are.
    from_files: bool = False

    @classmethod
    def build(
        cls, docs: DataFrame, key: str = "doc_id", text: str = "text", analyze: Analyzer | None = None, positional: bool = True, per_segment: int = FLUSH_DOCS
    ) -> TextIndex:
        analyze = analyze or analyzer()
        documents, catalogue = _numbered(docs, key, text, per_segment, 0)
        postings = build_postings(documents, analyze)
        none = no_tombstones(docs.sparkSession)
        return cls(documents, postings if positional else postings.drop("positions"), none, catalogue, analyze, positional, from_files=True)

    @classmethod
    def empty(cls, spark: SparkSession, key_type: str = "bigint", analyze: Analyzer | None = None, positional: bool = True) -> TextIndex:
        docs = spark.createDataFrame([], f"doc_id {key_type}, text string")
        return cls.build(docs, analyze=analyze, positional=positional)

    # --- catalogue ---

    @property
    def spark(self) -> SparkSession:
        return self.documents.sparkSession

    def segments(self) -> DataFrame:
        """``seg_id, n_docs``; deleted documents count until a merge, and a segment may be left without any."""
        return self.catalogue

    def n_segments(self) -> int:
        return self.catalogue.count()

    def n_documents(self, seg_id: int) -> int:
        row = self.catalogue.filter(F.col("seg_id") == seg_id).first()
        if row is None:
            raise ValueError(f"no segment {seg_id}")
        return row.n_docs

    def document_frequencies(self) -> DataFrame:
        """``seg_id, term, df``; deleted documents count until a merge."""
        return self.postings.groupBy("seg_id", "term").agg(F.count(F.lit(1)).alias("df"))

    def document_frequency(self, seg_id: int, term: str) -> int:
        """Of an already analyzed term; 0 if the segment lacks it."""
        self.n_documents(seg_id)
        return self.postings.filter((F.col("seg_id") == seg_id) & (F.col("term") == term)).count()

    def dump(self, seg_id: int | None = None) -> DataFrame:
        """``seg_id, term, doc_ids`` and, in a positional index, the ``positions`` of each document."""
        rows = self.postings if seg_id is None else self.postings.filter(F.col("seg_id") == seg_id)
        pairs = F.sort_array(F.collect_list(F.struct("doc_id", "positions") if self.positional else F.struct("doc_id"))).alias("p")
        lists = [F.transform("p", lambda x: x["doc_id"]).alias("doc_ids")]
        if self.positional:
            lists.append(F.transform("p", lambda x: x["positions"]).alias("positions"))
        return rows.groupBy("seg_id", "term").agg(pairs).select("seg_id", "term", *lists)

    def live(self) -> DataFrame:
        """The documents that are not deleted."""
        return self.documents.join(self.tombstones, ["seg_id", "doc_id"], "left_anti")

    # --- changes ---

    def _next_segment(self) -> int:
        last = self.catalogue.agg(F.max("seg_id")).first()[0]
        return 0 if last is None else last + 1

    def flush(self, docs: DataFrame, key: str = "doc_id", text: str = "text", per_segment: int = FLUSH_DOCS, merge_at: int | None = None) -> TextIndex:
        """With new documents in segments of their own; merges if there are ``merge_at`` segments or more."""
        new, catalogue = _numbered(docs, key, text, per_segment, self._next_segment())
        postings = build_postings(new, self.analyze)
        out = replace(
            self,
            documents=self.documents.unionByName(new),
            postings=self.postings.unionByName(postings if self.positional else postings.drop("positions")),
            catalogue=self.catalogue.unionByName(catalogue),
            path=None,
            from_files=False,
        )
        n = out.n_segments() if merge_at else 0
        return out.merge_pairs() if merge_at and n >= merge_at and n % 2 == 0 else out

    def append(self, docs: DataFrame, key: str = "doc_id", text: str = "text", per_segment: int = FLUSH_DOCS) -> TextIndex:
        """A stored index with new documents in segments of their own; only their files are written."""
        if self.path is None:
            raise ValueError("only a stored index is appended to")
        first = self._next_segment()
        new, catalogue = _numbered(docs, key, text, per_segment, first)
        postings = build_postings(new, self.analyze)
        write_batch(self.path, first, new, postings if self.positional else postings.drop("positions"), catalogue)
        return self.open(self.spark, self.path, self.analyze)

    def delete(self, keyword: str) -> TextIndex:
        """Without the documents that have the first token of ``keyword``; without a token nothing changes."""
        one = self.spark.range(1).select(self.analyze(F.lit(keyword)).alias("t")).first()
        if not one.t:
            return self
        hits = self.postings.filter(F.col("term") == one.t[0]).select("seg_id", "doc_id")
        if self.path is None:
            return replace(self, tombstones=materialize(self.tombstones.unionByName(hits).distinct(), "tombstones"))
        # A reader counts a row once, however often it stands there, so this may run again.
        materialize(hits.join(self.tombstones, ["seg_id", "doc_id"], "left_anti"), "tombstones").write.mode("append").parquet(f"{self.path}/tombstones")
        return self.open(self.spark, self.path, self.analyze)

    def merge_pairs(self) -> TextIndex:
        """Segments 0 and 1, 2 and 3, ... become one each; deleted documents go and numbers close up.

        The number of segments must be even; they are counted in their order, so gaps are no
        matter. A segment without deletions only gets an offset, from a table of one row a
        segment; only the documents and postings of the others are joined.
        """
        n = self.n_segments()
        if n % 2:
            raise ValueError(f"{n} segments can't be merged in pairs")
        # The number of segments, and that of the documents in a merged one, has no bound.
        order = running_total(self.catalogue.withColumn("all", F.lit(0)), ["all"], [F.col("seg_id").asc()], F.lit(1), "place")
        some_dead = not self.tombstones.isEmpty()
        if some_dead:
            dead = self.tombstones.groupBy("seg_id").agg(F.count(F.lit(1)).alias("n_dead"))
            order = order.join(dead, "seg_id", "left").withColumn("n_dead", F.coalesce("n_dead", F.lit(0).cast("long")))
        else:
            order = order.withColumn("n_dead", F.lit(0).cast("long"))
        places = order.select("seg_id", F.floor(F.col("place") / 2).cast("int").alias("new_seg"), (F.col("place") % 2).alias("half"), (F.col("n_docs") - F.col("n_dead")).alias("n_live"), "n_dead")
        places = materialize(places, "merge")
        firsts = places.filter("half = 0").select("new_seg", F.col("n_live").alias("before"))
        moves = places.join(firsts, "new_seg").select("seg_id", "new_seg", F.when(F.col("half") == 1, F.col("before")).otherwise(0).cast("int").alias("offset"), "n_dead")
        clean, hint = moves.filter("n_dead = 0"), F.broadcast if n <= BROADCAST_SEGMENTS else lambda x: x
        moved = None
        if some_dead:
            holed = self.documents.select("seg_id", "doc_id").join(hint(moves.filter("n_dead > 0")), "seg_id").join(self.tombstones, ["seg_id", "doc_id"], "left_anti")
            moved = running_total(holed, ["seg_id"], [F.col("doc_id").asc()], F.lit(1), "place")
            moved = materialize(moved.select("seg_id", "doc_id", "new_seg", (F.col("offset") + F.col("place")).cast("int").alias("new_doc")), "moved")

        def renumbered(df: DataFrame) -> DataFrame:
            def named(joined: DataFrame) -> DataFrame:
                return joined.select(*[F.col({"seg_id": "new_seg", "doc_id": "new_doc"}.get(c, c)).alias(c) for c in df.columns])

            out = named(df.join(hint(clean), "seg_id").withColumn("new_doc", F.col("doc_id") + F.col("offset")))
            return out if moved is None else out.unionByName(named(df.join(moved, ["seg_id", "doc_id"])))

        catalogue = places.groupBy(F.col("new_seg").alias("seg_id")).agg(F.sum("n_live").alias("n_docs"))
        return replace(
            self, documents=renumbered(self.documents), postings=renumbered(self.postings), tombstones=no_tombstones(self.spark), catalogue=catalogue, path=None, from_files=False
        )

    # --- storage ---

    def save(self, path: str) -> TextIndex:
        """Write the tables and return the index that reads them."""
        write_batch(path, 0, self.documents, self.postings, self.catalogue)
        self.tombstones.write.parquet(f"{path}/tombstones")
        return self.open(self.spark, path, self.analyze)

    @classmethod
    def open(cls, spark: SparkSession, path: str, analyze: Analyzer | None = None) -> TextIndex:
        documents = spark.read.parquet(f"{path}/documents").select("seg_id", "doc_id", "key", "text")
        postings = spark.read.parquet(f"{path}/postings")
        positional = "positions" in postings.columns
        columns = ["seg_id", "term", "doc_id", "tf"] + (["positions"] if positional else [])
        catalogue = spark.read.schema(_SEGMENTS).parquet(f"{path}/segments").select("seg_id", "n_docs")
        dead = spark.read.schema(_TOMBSTONES).parquet(f"{path}/tombstones").distinct() if has_path(spark, f"{path}/tombstones") else no_tombstones(spark)
        return cls(documents, postings.select(*columns), dead, catalogue, analyze or analyzer(), positional, path, from_files=True)

    def cached(self) -> TextIndex:
        """With postings, sorted by term, and documents, unless they are in files, written once to the shared folder."""
        postings = self.postings.sortWithinPartitions("term", "seg_id", "doc_id")
        documents = self.documents if self.from_files else materialize(self.documents, "documents")
        return replace(self, documents=documents, postings=materialize(postings, "postings"), catalogue=materialize(self.catalogue, "segments"), from_files=True)

    def create_views(self, prefix: str = "index") -> None:
        """The tables as temporary views ``<prefix>_documents``, ``_postings``, ``_segments`` and ``_tombstones`` for SQL."""
        for name, df in (("documents", self.documents), ("postings", self.postings), ("segments", self.segments()), ("tombstones", self.tombstones)):
            df.createOrReplaceTempView(f"{prefix}_{name}")

    def drop(self, path: str) -> None:
        drop_path(self.spark, path)


def write_batch(path: str, first_segment: int, documents: DataFrame, postings: DataFrame, catalogue: DataFrame) -> None:
    """Write the tables of a batch of segments to the stored index at ``path``, in place of an earlier try."""
    where = f"batch={first_segment}"
    documents.sortWithinPartitions("seg_id", "doc_id").write.mode("overwrite").parquet(f"{path}/documents/{where}")
    postings.sortWithinPartitions("term", "seg_id", "doc_id").write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").parquet(f"{path}/postings/{where}")
    catalogue.coalesce(1).write.mode("overwrite").parquet(f"{path}/segments/{where}")


class IndexWriter:
    """Collects documents and adds them to an index by segments.

    What was added is searchable once it is flushed, which happens by itself when
    ``flush_docs`` documents wait; segments are merged when ``merge_at`` of them, an even
    number, are there. The index lies in the shared folder: a flush adds the files of its own
    segments, a merge writes a new folder, after which the one before the last is removed.
    """

    def __init__(self, index: TextIndex, flush_docs: int = FLUSH_DOCS, merge_at: int | None = MERGE_SEGMENTS):
        self.index, self.flush_docs, self.merge_at = index, flush_docs, merge_at
        self._waiting: list[DataFrame] = []
        self._n_waiting = 0
        self._folders: list[str] = []

    def add(self, docs: DataFrame) -> None:
        """Documents as ``doc_id, text``; the batch is written once to the shared folder."""
        docs = materialize(docs.select("doc_id", "text"), "added")
        self._waiting.append(docs)
        self._n_waiting += docs.count()
        if self._n_waiting >= self.flush_docs:
            self.flush()

    def _store(self) -> None:
        self._folders.append(scratch_path(self.index.spark, "index"))
        self.index = self.index.save(self._folders[-1])
        for old in self._folders[:-2]:
            drop_path(self.index.spark, old)
        self._folders = self._folders[-2:]

    def flush(self) -> None:
        """Without waiting documents nothing happens."""
        if not self._n_waiting:
            return
        if not self._folders:
            self._store()
        waiting = self._waiting[0]
        for more in self._waiting[1:]:
            waiting = waiting.unionByName(more)
        self.index = self.index.append(waiting, per_segment=self.flush_docs)
        self._waiting, self._n_waiting = [], 0
        n = self.index.n_segments() if self.merge_at else 0
        if self.merge_at and n >= self.merge_at and n % 2 == 0:
            self.index = self.index.merge_pairs()
            self._store()
