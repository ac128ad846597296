"""Documents that are copies of each other up to small changes (problem 4).

Two documents match if their sets of word sequences ("shingles") have a Jaccard similarity
of at least ``threshold``. The join uses adaptive multi-match prefixes:

1. One pass counts shingles in a sketch of fixed size (``SKETCH_BITS``), which gives all
   documents one order of shingles, rare ones first, and tells those that surely occur in
   one document only. What the median counter has is taken off, so that common shingles
   stand out however full the sketch is. Copies with equal sets are put into
   classes; one of each class goes on.
2. A document's prefix is its first n - ceil(t n) + l shingles. ``l`` is chosen by the
   estimated cost of the prefix' postings and of the candidates that l shared shingles leave.
   Matching documents of n and m shingles share a >= t/(1+t) (n+m), so their first l common
   shingles stand before places n - a + l and m - a + l: pairs are counted by these places
   only, and become candidates with l counts. The bounds are exact: no match is lost,
   whatever the sketch holds.
3. Candidates are verified on their full sets.

Postings travel as sorted arrays by ranges of the shingles' hashes, not as rows; the ranges
are dealt evenly to the tasks. A shingle of
very many documents is split: its documents fall into blocks, and each pair of blocks is a
group of its own, so no task gets more than two blocks of it.

Defined cases: null, empty and short texts (fewer than ``min_words`` words) match nothing;
keys are expected to be unique, repeated rows of one key count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbarium.session import drop_path, materialize, store

#: Counters of the sketch, one byte each where it is broadcast: 16 MB whatever the input.
SKETCH_BITS = 24
_SLICE_BITS = 16
#: Postings, and shingles, that a task keeps before it passes them on or counts them.
FLUSH_POSTINGS, FLUSH_SHINGLES = 1_000_000, 2_000_000
#: Bytes of text whose words are hashed at once, and that are made into sets at once.
HASH_BYTES, BATCH_BYTES = 1 << 20, 8 << 20
#: Tasks for the ranges of postings; beyond, a task has several ranges, one after the other.
MAX_RANGE_TASKS = 20_000
#: Bytes of postings in one range, about, and by shingle.
RANGE_BYTES, POSTING_BYTES = 16 << 20, 10
#: Documents of one token that meet in one group; more common tokens are split into pairs of blocks.
HOT_BLOCK = 4096
#: Keys up to which a filter on documents is broadcast.
BROADCAST_KEYS = 500_000
#: Members of a class, about, that meet those of another block in one group when pairs are written.
PAIR_BLOCK = 128

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_WORD_BYTES = np.zeros(256, dtype=np.int8)
_WORD_BYTES[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A word's hash is the polynomial of its bytes' values at ``_BASE``, an odd number, which has an inverse.
_VALUES = _mixed(np.arange(1, 257, dtype=np.uint64) * _A)
_BASE = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    """The powers of the base and of its inverse, at least ``n`` of them."""
    if len(_powers[0]) < n:
        for i, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, HASH_BYTES + 1), x, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The start and hash of each word in lower-cased UTF-8 bytes, a stretch of whole words at a time."""
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + HASH_BYTES)
        while end < len(data):  # to the end of the word
            blanks = np.flatnonzero(_WORD_BYTES[data[end - 1 : end + HASH_BYTES]] == 0)
            if len(blanks):
                end += int(blanks[0]) - 1 if blanks[0] else 0
                break
            end = min(len(data), end + HASH_BYTES)
        part = data[at:end]
        inside = np.zeros(len(part) + 2, dtype=np.int8)
        inside[1:-1] = _WORD_BYTES[part]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edges[::2], edges[1::2]
        power, inverse = _powers_to(len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[part] * power[: len(part)], out=sums[1:])
        starts.append(first + at)
        hashes.append((sums[last] - sums[first]) * inverse[first])
        at = end
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate([none.astype(np.int64), *starts]), np.concatenate([none, *hashes])


def shingle_sets(texts: list[str], width: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct hashes of the word sequences of all texts, the bounds of each text's own, and the texts' numbers; short texts are left out."""
    parts = [t.lower().encode() for t in texts]
    begin = np.cumsum([0, *(len(p) + 1 for p in parts)])
    starts, h = word_hashes(np.frombuffer(b" ".join(parts), dtype=np.uint8))
    bounds = np.searchsorted(starts, begin)
    n_words = np.diff(bounds)
    used = np.flatnonzero(n_words >= max(min_words, width, 1))
    if not len(used):
        return np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64), used
    n = len(h) - width + 1
    s = h[:n]
    for k in range(1, width):
        s = _mixed(s * _A + h[k : k + n] * _B + _C)
    ends = np.cumsum(n_words[used] - width + 1)
    all_s = np.empty(ends[-1], dtype=np.uint64)
    new = np.zeros(len(all_s), dtype=bool)
    a = 0
    for x, b in zip(bounds[used].tolist(), ends.tolist()):
        all_s[a:b] = s[x : x + b - a]
        all_s[a:b].sort()
        new[a] = True
        a = b
    new[1:] |= all_s[1:] != all_s[:-1]
    return all_s[new], np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(new)[ends - 1]]), used


def shingles(text: str, width: int, min_words: int) -> np.ndarray | None:
    """The sorted distinct hashes of one text; None for a short text."""
    s, _, used = shingle_sets([text], width, min_words)
    return s if len(used) else None


def _batches(batch: pa.RecordBatch, width: int, min_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``shingle_sets`` of a batch's texts, some MB at a time, with the numbers of their rows."""
    rows, texts, held = [], [], 0
    for i, v in enumerate(batch.column("text")):
        if not v.is_valid:
            continue
        rows.append(i), texts.append(v.as_py())
        held += len(texts[-1])
        if held >= BATCH_BYTES:
            s, bounds, used = shingle_sets(texts, width, min_words)
            yield s, bounds, np.asarray(rows)[used]
            rows, texts, held = [], [], 0
    if texts:
        s, bounds, used = shingle_sets(texts, width, min_words)
        yield s, bounds, np.asarray(rows)[used]


def _first_pass(docs: DataFrame, width: int, min_words: int) -> tuple[DataFrame, str]:
    """``key, size, h1, h2`` of each document, and ``slice, blob`` of each task's sketch; and the table's folder."""
    import zlib

    names = ["key", "size", "h1", "h2", "slice", "blob"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    bits = SKETCH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, dtype=np.uint16)
        over: dict[int, int] = {}  # what exceeds the 16 bits of a counter, in steps of 2^16
        waiting: list[np.ndarray] = []
        held = 0

        def flush() -> None:
            at, n = np.unique((np.concatenate(waiting) >> np.uint64(64 - bits)).astype(np.uint32), return_counts=True)
            now = counts[at].astype(np.int64) + n
            counts[at] = now & 0xFFFF
            for i in np.flatnonzero(now >> 16):
                over[int(at[i])] = over.get(int(at[i]), 0) + int(now[i] >> 16)
            waiting.clear()

        for batch in batches:
            for s, bounds, rows in _batches(batch, width, min_words):
                if not len(rows):
                    continue
                h1 = np.bitwise_xor.reduceat(_mixed(s), bounds[:-1]).view(np.int64)
                h2 = np.add.reduceat(_mixed(s + _A), bounds[:-1]).view(np.int64)
                none = pa.nulls(len(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(rows, pa.int64())), pa.array(np.diff(bounds).astype(np.int32)), pa.array(h1), pa.array(h2), none.cast(pa.int32()), none.cast(pa.binary())],
                    names=names,
                )
                waiting.append(s)
                held += len(s)
                if held > FLUSH_SHINGLES:
                    flush()
                    held = 0
        if waiting:
            flush()
        step = 1 << min(bits, _SLICE_BITS)

        def row(i: int, values: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([None, None, None, None, i // step, zlib.compress(values.tobytes(), 1)], types)], names=names)

        for i in range(0, len(counts), step):
            if counts[i : i + step].any():
                yield row(i, counts[i : i + step])
        for at, n in over.items():
            part = np.zeros(step, dtype=np.uint16)
            for rest in range(n << 16, 0, -65535):
                part[at % step] = min(rest, 65535)
                yield row(at - at % step, part)

    return store(docs.mapInArrow(run, "key bigint, size int, h1 bigint, h2 bigint, slice int, blob binary"), "sketch")


#: The sketch is written in bytes: counts to 63, then six steps to each doubling.
_EXACT, _STEPS = 64, 6


def written_count(n: np.ndarray) -> np.ndarray:
    log = _EXACT + np.floor(_STEPS * np.log2(np.maximum(n, _EXACT) / _EXACT) + 1e-9)
    return np.where(n < _EXACT, n, np.minimum(log, 255)).astype(np.uint8)


def _sketch(first: DataFrame) -> np.ndarray:
    """The tasks' sketches added up, one byte a counter, without what a usual counter of the slice has."""
    import zlib

    bits = SKETCH_BITS
    step = 1 << min(bits, _SLICE_BITS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, blob in zip(batch.column("slice").to_pylist(), batch.column("blob")):
                part = np.frombuffer(zlib.decompress(blob.as_py()), dtype=np.uint16)
                sums[s] = sums.get(s, 0) + part.astype(np.int64)
        for s, n in sums.items():
            usual = int(np.median(n))  # of the many rare shingles; the common ones hardly move it
            q = written_count(np.where(n > 1, np.maximum(n - usual, 2), n))
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([zlib.compress(q.tobytes(), 1)], pa.binary())], names=["slice", "blob"])

    spread = first.filter("slice is not null").select("slice", "blob").repartition("slice")
    sketch = np.zeros(1 << bits, dtype=np.uint8)
    for r in spread.mapInArrow(add, "slice int, blob binary").toLocalIterator():  # 16 MB at most, part by part
        sketch[r.slice * step : (r.slice + 1) * step] = np.frombuffer(zlib.decompress(r.blob), dtype=np.uint8)
    return sketch


def choose_matches(counts: np.ndarray, prefix: int) -> int:
    """How many shared shingles to ask for: the cheapest of 1, 2, 4, ... up to an eighth of the document.

    ``counts`` are those of the shingles, rare first; a longer prefix costs its postings, and
    leaves at most postings / l candidates, each of which costs a part of a verification.
    """
    n = len(counts)
    cost = np.cumsum(np.maximum(counts.astype(np.float64) - 1, 0))
    best, least, l = 1, None, 1
    while l <= max(1, n // 8):
        scan = float(cost[min(n, prefix + l - 1) - 1])
        c = scan + scan / l * n / 16
        if least is None or c < least:
            best, least = l, c
        l *= 2
    return best


#: The largest count that each byte of the sketch stands for.
_AT_MOST = np.where(np.arange(256) < _EXACT, np.arange(256), _EXACT * 2.0 ** ((np.arange(256) - _EXACT + 1) / _STEPS))


def counted_at_most(q: np.ndarray) -> np.ndarray:
    return _AT_MOST[q]


def split_hot(tok: np.ndarray, q: np.ndarray, pos: np.ndarray, key: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and places, with those of hot tokens repeated for every pair of blocks with the document's.

    The last two bits of a place tell how documents of a token may be paired: 0 all of them,
    1 and 2 only with each other.
    """
    blocks = np.ceil(counted_at_most(q) / block).astype(np.int64)
    hot = np.flatnonzero(blocks > 1)
    if not len(hot):
        return tok, pos * 4
    n = blocks[hot]
    own = (int(_mixed(np.array([key], dtype=np.int64).view(np.uint64))[0]) % n.astype(np.uint64)).astype(np.int64)
    at = np.repeat(np.arange(len(hot)), n)
    other = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    mine = own[at]
    pair = np.minimum(mine, other) * np.int64(1 << 20) + np.maximum(mine, other) + 1
    mode = np.where(mine == other, 0, np.where(mine < other, 1, 2))
    cold = blocks <= 1
    return (
        np.concatenate([tok[cold], _mixed(tok[hot][at] ^ pair.astype(np.uint64) * _A)]),
        np.concatenate([pos[cold] * 4, pos[hot][at] * 4 + mode]),
    )


def _postings(docs: DataFrame, sketch, width: int, min_words: int, threshold: float, bits: int) -> DataFrame:
    """``part, docs, posts``: arrays of (key, size, l) and of (token, document, place), by ranges of tokens."""
    sketch_bits = SKETCH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_of = sketch.value
        table: list[tuple[int, int, int]] = []
        tokens, owners, places, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            tok, own, pos = np.concatenate(tokens), np.concatenate(owners), np.concatenate(places)
            order = np.argsort(tok)
            tok, own, pos = tok[order], own[order], pos[order]
            part = (tok >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(tok), dtype=np.int64)
            rows = np.array(table, dtype=np.int64)
            for p in np.unique(part):
                a, b = np.searchsorted(part, [p, p + 1])
                used, local = np.unique(own[a:b], return_inverse=True)
                # The part has the first bits; 32 more tell tokens apart, else verification does.
                short = ((tok[a:b] << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
                posts = np.concatenate([short, local.astype(np.uint32), pos[a:b].astype(np.uint32)])
                if len(used) < 65536 and pos[a:b].max() < 65536:
                    posts = np.concatenate([short.view(np.uint16), local.astype(np.uint16), pos[a:b].astype(np.uint16)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(p)], pa.int32()), pa.array([b - a], pa.int32()), pa.array([rows[used].T.tobytes()], pa.binary()), pa.array([posts.tobytes()], pa.binary())],
                    names=["part", "n", "docs", "posts"],
                )

        for batch in batches:
            keys = batch.column("key").to_pylist()
            for all_s, bounds, rows in _batches(batch, width, min_words):
                all_q = q_of[(all_s >> np.uint64(64 - sketch_bits)).astype(np.int64)]
                for i, a, b in zip(rows.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    s, q, n = all_s[a:b], all_q[a:b], b - a
                    order = np.argsort(q, kind="stable")  # s is sorted, so ties are in the order of the hash
                    q = q[order]
                    prefix = n - int(np.ceil(threshold * n - 1e-9)) + 1
                    l = choose_matches(_AT_MOST[q], prefix)
                    end = min(n, prefix + l - 1)
                    first = int(np.searchsorted(q[:end], 2))  # a count of 1: no other document has it
                    tok, pos = split_hot(s[order[first:end]], q[first:end], np.arange(first, end), keys[i], HOT_BLOCK)
                    tokens.append(tok), owners.append(np.full(len(tok), len(table))), places.append(pos)
                    table.append((keys[i], n, l))
                    held += len(tok)
                    if held > FLUSH_POSTINGS:
                        yield from flush()
                        table.clear(), tokens.clear(), owners.clear(), places.clear()
                        held = 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, "part int, n int, docs binary, posts binary")


def count_pairs(
    tok: np.ndarray, doc: np.ndarray, pos: np.ndarray, key: np.ndarray, size: np.ndarray, least: np.ndarray, threshold: float
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of keys that share tokens at places that a match allows, with counts and the counts they need."""
    order = np.lexsort((size[doc], tok))
    tok, doc, pos, mode = tok[order], doc[order], pos[order] >> 2, pos[order] & 3
    starts = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
    ends = np.repeat(np.r_[starts[1:], len(tok)], np.diff(np.r_[starts, len(tok)]))
    n_docs, ratio = len(key), threshold / (1 + threshold)
    active = np.flatnonzero(np.arange(1, len(tok) + 1) < ends)
    found, held, k = [], 0, 1
    while len(active):
        x, y = doc[active], doc[active + k]
        near = size[x] >= threshold * size[y] - 1e-9  # sorted by size: if one is too long, so are all after it
        active, x, y = active[near], x[near], y[near]
        both = size[x] + size[y]
        share = np.ceil(ratio * both - 1e-9).astype(np.int64)
        l = np.minimum(least[x], least[y])
        ok = (pos[active] < size[x] - share + l) & (pos[active + k] < size[y] - share + l) & (key[x] != key[y])
        ok &= (mode[active] == 0) | (mode[active] != mode[active + k])
        x, y = x[ok], y[ok]
        found.append(np.minimum(x, y) * n_docs + np.maximum(x, y))
        held += len(x)
        k += 1
        active = active[active + k < ends[active]]
        if held > 4_000_000 or (not len(active) and found):
            pair, n = np.unique(np.concatenate(found), return_counts=True)
            a, b = pair // n_docs, pair % n_docs
            yield np.minimum(key[a], key[b]), np.maximum(key[a], key[b]), n, np.minimum(least[a], least[b])
            found, held = [], 0


def _even_labels(spark: SparkSession, n: int) -> list[int]:
    """Numbers that Spark's hash partitioning deals to ``n`` partitions one each."""
    at, found, labels = 0, 0, [0] * n
    missing = set(range(n))
    while missing:
        rows = spark.range(at, at + 8 * n, 1, 1).select(F.col("id").cast("int").alias("x"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p"))
        for r in rows.groupBy("p").agg(F.min("x").alias("x")).toLocalIterator():  # n rows at most
            if r.p in missing:
                missing.discard(r.p)
                labels[r.p] = r.x
        at += 8 * n
    return labels


def _candidates(postings: DataFrame, threshold: float, bits: int) -> DataFrame:
    tasks = min(1 << bits, MAX_RANGE_TASKS)
    labels = F.array(*[F.lit(x) for x in _even_labels(postings.sparkSession, tasks)])
    dealt = postings.withColumn("to", F.get(labels, F.col("part") % tasks)).repartition(tasks, "to")

    def pairs(table: pa.Table) -> pa.Table:
        toks, owners, places, rows, base = [], [], [], [], 0
        for n, docs, posts in zip(*(table.column(c).to_pylist() for c in ("n", "docs", "posts"))):
            d = np.frombuffer(docs, dtype=np.int64).reshape(3, -1)
            raw = np.frombuffer(posts, dtype=np.uint8)
            wide = 4 if len(raw) == 12 * n else 2
            toks.append(np.frombuffer(raw[: 4 * n].tobytes(), dtype=np.uint32))
            kind = np.uint32 if wide == 4 else np.uint16
            owners.append(np.frombuffer(raw[4 * n : (4 + wide) * n].tobytes(), dtype=kind).astype(np.int64) + base)
            places.append(np.frombuffer(raw[(4 + wide) * n :].tobytes(), dtype=kind).astype(np.int64))
            rows.append(d)
            base += d.shape[1]
        key, size, least = np.concatenate(rows, axis=1)
        out = list(count_pairs(np.concatenate(toks), np.concatenate(owners), np.concatenate(places), key, size, least, threshold))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, dtype=np.int64)] * 4
        return pa.Table.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["a", "b", "n", "need"])

    counted = dealt.groupBy("to", "part").applyInArrow(pairs, "a bigint, b bigint, n bigint, need bigint")
    return counted.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need")).filter("n >= need").select("a", "b")


def _only(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` with (or without) the keys; the keys are broadcast if they are few."""
    keys = materialize(keys, "keys")
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "key", how)


def _sets(docs: DataFrame, width: int, min_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, bounds, rows in _batches(batch, width, min_words):
                sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(s.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows, pa.int64())), sets], names=["key", "set"])

    return docs.mapInArrow(run, "key bigint, set array<bigint>")


def similar_classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8, min_words: int = 0
) -> tuple[DataFrame, DataFrame]:
    """``key, class`` of each document (a class is its smallest key of equal sets), and ``a, b`` of matching classes."""
    spark: SparkSession = docs.sparkSession
    base = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    first, folder = _first_pass(base, width, min_words)
    same = ["size", "h1", "h2"]
    one = F.min(F.struct(*same)).alias("s")
    members = first.filter("key is not null").groupBy("key").agg(one).select("key", "s.*")
    heads = members.groupBy(*same).agg(F.min("key").alias("class"))
    classes = materialize(members.join(heads, same).select("key", "class", "size"), "classes")
    total = first.agg(F.sum("size")).first()[0] or 0
    bits = max(3, int(np.ceil(np.log2(max(1, total * POSTING_BYTES / RANGE_BYTES)))))
    heads_only = _only(base, classes.filter("key <> class").select("key"), "left_anti")
    sketch = spark.sparkContext.broadcast(_sketch(first))
    drop_path(spark, folder)
    postings = _postings(heads_only, sketch, width, min_words, threshold, bits)
    candidates = materialize(_candidates(postings, threshold, bits), "candidates")
    involved = candidates.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = materialize(_sets(_only(base, involved, "left_semi"), width, min_words).dropDuplicates(["key"]), "sets")
    shared = F.size(F.array_intersect("x", "y"))
    links = (
        candidates.join(sets.select(F.col("key").alias("a"), F.col("set").alias("x")), "a")
        .join(sets.select(F.col("key").alias("b"), F.col("set").alias("y")), "b")
        .withColumn("shared", shared)
        .filter(F.col("shared") >= threshold * (F.size("x") + F.size("y") - F.col("shared")) - 1e-9)
        .select("a", "b")
    )
    return classes.select("key", "class"), materialize(links, "links")


def equal_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, copy_of`` of each document with a text: the smallest key of those with the same text."""
    base = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).filter("key is not null and text is not null")
    hashed = base.select("key", F.sha2("text", 256).alias("hash")).groupBy("key").agg(F.min("hash").alias("hash"))
    heads = hashed.groupBy("hash").agg(F.min("key").alias("copy_of"))
    return hashed.join(heads, "hash").select(F.col("key").alias(key), "copy_of")


def similar_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", full_class: int | None = None, **options) -> DataFrame:
    """``{key}_a, {key}_b`` of all matching pairs, smaller first.

    With ``full_class``, more than so many documents of one text stand for themselves by
    their smallest key: the others are paired with it only, and it alone with other texts.
    ``equal_texts`` tells whom a key stands for; pairs of different texts are all written.
    """
    classes, links = similar_classes(docs, key, text, **options)
    star = None
    if full_class is not None:
        copies = _only(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), classes.select("key"), "left_semi")
        copies = equal_texts(copies, "key")
        many = copies.groupBy("copy_of").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > full_class).select("copy_of")
        star = materialize(copies.join(many, "copy_of").filter("key <> copy_of").select(F.col("copy_of").alias("a"), F.col("key").alias("b")), "star")
        classes = classes.join(star.select(F.col("b").alias("key")), "key", "left_anti")
    sizes = classes.groupBy("class").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = materialize(sizes.select("class", F.ceil(F.col("n") / PAIR_BLOCK).cast("int").alias("blocks")), "sizes")
    several = materialize(classes.join(sizes, "class").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")), "several")

    # Each pair of blocks of a class meets in a group of its own, so a large class spans tasks.
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    a = several.select("class", F.col("key").alias("a"), F.col("block").alias("i"), F.explode(every).alias("j"))
    b = several.select("class", F.col("key").alias("b"), F.explode(every).alias("i"), F.col("block").alias("j"))
    inside = a.join(b, ["class", "i", "j"]).filter("a < b").select("a", "b")

    def members(pairs: DataFrame, side: str) -> DataFrame:
        blocks = sizes.select(F.col("class").alias(side), "blocks")
        spread = pairs.join(blocks, side, "left").select(*pairs.columns, F.explode(F.coalesce(every, F.array(F.lit(0)))).alias("block"))
        named = several.select(F.col("class").alias(side), "block", F.col("key").alias("_m"))
        return spread.join(named, [side, "block"], "left").withColumn(side, F.coalesce("_m", side)).drop("_m", "block")

    pairs = inside.unionByName(members(members(links, "a"), "b"))
    pairs = pairs if star is None else pairs.unionByName(star)
    return pairs.select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b"))


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``key, class_id, group_id, n_links`` of each document that is long enough.

    A class holds the documents of equal sets and a group is a connected component of
    matches, each named by its smallest key; ``n_links`` counts the other classes that the
    document's class matches. One row a document, however large a class is.
    """
    from verbarium.operators.components import connected_components

    classes, links = similar_classes(docs, key, text, **options)
    degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    groups = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return (
        classes.join(groups.select(F.col("node").alias("class"), "component"), "class", "left")
        .join(degree, "class", "left")
        .select(F.col("key").alias(key), F.col("class").alias("class_id"), F.coalesce("component", "class").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
