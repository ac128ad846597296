"""Token ids of a whole corpus by a public byte-level BPE (problem 8).

Encoding is a monoid: an element is a piece of text with its ids, and two neighbours are
joined by encoding again only a window around the seam. The window reaches, on either
side, to an *anchor*: a place where the tokenizer's pattern always starts a new piece,
whatever surrounds it. BPE never merges across such places, so the tokens outside the
window are proven stable. If a window holds no anchor, it doubles, at worst to the whole
text, which is then simply encoded again.

Texts are encoded as such a tree of halves. Texts longer than ``SPLIT_CHARS`` are first cut
into rows of their own, spread over the cluster, and joined per document at the end.

Defined cases: null and empty text give an empty list; blank text is encoded as it is;
strings that look like special tokens are ordinary text; repeated rows are encoded each;
other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbarium.llm.words import slices

#: Pieces up to this length are leaves of the tree.
LEAF_CHARS = 1024
#: Longer texts become several rows.
SPLIT_CHARS = 1 << 18
#: First width of the window beside a seam.
WINDOW = 32
#: A run without an anchor longer than this goes to the encoder whose time is not quadratic in it.
LONG_RUN = 2000

# Before the place: a letter or digit; after it: something that can't continue it. Only
# characters whose class is the same in every Unicode version are used.
_ANCHOR = re.compile(
    "(?<=[A-Za-z一-龥ぁ-ゖァ-ヺ])(?=[\\s!-@\\[-`{-~、。，])|(?<=[0-9])(?=[\\sA-Za-z!-/:-@\\[-`{-~])"
)


def default_ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """The tokenizer, and the joining of encoded neighbours."""

    def __init__(self, ranks_path: str | None = None, leaf: int = LEAF_CHARS, window: int = WINDOW):
        import public_tokenizers
        import tiktoken

        path = ranks_path or default_ranks_path()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bytes = {i: b for b, i in ranks.items()}
        self._fast = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._slow = None
        self._long = re.compile(r"\S{%d}|\s{%d}" % (LONG_RUN, LONG_RUN))
        # Without the other library's file beside it, long runs only take longer.
        other = path.rsplit(".", 1)[0] + ".json"
        self._json = other if os.path.exists(other) else None
        self.leaf, self.window = leaf, window

    def direct(self, text: str) -> np.ndarray:
        if len(text) > LONG_RUN and self._json and self._long.search(text):
            if self._slow is None:
                from tokenizers import Tokenizer

                self._slow = Tokenizer.from_file(self._json)
                self._slow.encode_special_tokens = True
            return np.asarray(self._slow.encode(text, add_special_tokens=False).ids, dtype=np.int32)
        return np.asarray(self._fast.encode_ordinary(text), dtype=np.int32)

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= self.leaf:
            return self.direct(text)
        middle = len(text) // 2
        left, right = text[:middle], text[middle:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def join(self, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray) -> np.ndarray:
        """The ids of ``left + right`` from those of either."""
        if not left or not right:
            return right_ids if not left else left_ids
        a, b = self._last_anchor(left), self._first_anchor(right)
        tail, head = left[a:], right[:b]
        n_tail = len(left_ids) if a == 0 else len(self.direct(tail))
        n_head = len(right_ids) if b == len(right) else len(self.direct(head))
        return np.concatenate([left_ids[: len(left_ids) - n_tail], self.direct(tail + head), right_ids[n_head:]])

    def _last_anchor(self, text: str) -> int:
        width = self.window
        while True:
            start = max(0, len(text) - width)
            found = [m.start() for m in _ANCHOR.finditer(text, start)]
            # An anchor at the very end depends on what comes next, so it doesn't count.
            found = [x for x in found if 0 < x < len(text)]
            if found:
                return found[-1]
            if start == 0:
                return 0
            width *= 2

    def _first_anchor(self, text: str) -> int:
        width = self.window
        while True:
            for m in _ANCHOR.finditer(text, 0, min(len(text), width)):
                if 0 < m.start() < len(text) - 1:
                    return m.start()
            if width >= len(text):
                return len(text)
            width *= 2

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self._bytes[int(i)] for i in ids).decode("utf-8")


_encoders: dict[str | None, Encoder] = {}


def encoder(ranks_path: str | None = None) -> Encoder:
    """One encoder per worker process and file."""
    if ranks_path not in _encoders:
        _encoders[ranks_path] = Encoder(ranks_path)
    return _encoders[ranks_path]


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def _pieces(text: Column, size: int) -> Column:
    n = F.ceil(F.length(text) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def encode_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str | None = None, split_chars: int = SPLIT_CHARS
) -> DataFrame:
    """``key`` and ``ids array<int>`` of each row."""
    base = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType
    long_rows = F.coalesce(F.length("text") > split_chars, F.lit(False))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        none = np.zeros(0, dtype=np.int32)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [enc.encode(t) if t else none for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), _list_array(ids)], names=[key, "ids"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [enc.encode(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("row", "key", "no", "text")] + [_list_array(ids)], names=["row", "key", "no", "text", "ids"])

    def joined(table: pa.Table) -> pa.Table:
        enc = encoder(ranks_path)
        table = table.sort_by("no")
        lists = table.column("ids").combine_chunks()
        # As arrays, without a Python object for each id.
        bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        parts = [(t, flat[a:b]) for t, a, b in zip(table.column("text").to_pylist(), bounds, bounds[1:])]
        while len(parts) > 1:  # one level of the tree
            pairs = [(a[0] + b[0], enc.join(a[0], a[1], b[0], b[1])) for a, b in zip(parts[::2], parts[1::2])]
            parts = pairs + ([parts[-1]] if len(parts) % 2 else [])
        return pa.Table.from_arrays([table.column("key").slice(0, 1), _list_array([parts[0][1]])], names=[key, "ids"])

    out = f"{key} {kind.simpleString()}, ids array<int>"
    short = base.filter(~long_rows).mapInArrow(whole, out)
    # Repeated rows stay apart by the row's id, which a file scan gives alike each time it runs.
    long = (
        base.filter(long_rows)
        .withColumn("row", F.monotonically_increasing_id())
        .select("row", "key", F.posexplode(_pieces(F.col("text"), split_chars)).alias("no", "text"))
        .repartition("row", "no")
        .mapInArrow(leaves, f"row bigint, key {kind.simpleString()}, no int, text string, ids array<int>")
        .groupBy("row")
        .applyInArrow(joined, out)
    )
    return short.unionByName(long)


def count_tokens(
    docs: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str | None = None, split_chars: int = SPLIT_CHARS
) -> DataFrame:
    """``key`` and ``n_tokens bigint`` of each row, without moving the ids of ordinary texts."""
    kind = docs.schema[key].dataType.simpleString()
    long_rows = F.coalesce(F.length(text) > split_chars, F.lit(False))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for batch in batches:
            n = [len(enc.encode(v.as_py())) if v.is_valid else 0 for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64())], names=[key, "n_tokens"])

    short = docs.filter(~long_rows).select(F.col(key).alias("key"), F.col(text).alias("text"))
    long = encode_documents(docs.filter(long_rows), key, text, ranks_path, split_chars)
    return short.mapInArrow(counted, f"{key} {kind}, n_tokens bigint").unionByName(long.select(key, F.size("ids").cast("long").alias("n_tokens")))


def decode_documents(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """``key`` and ``text`` from lists of ids; an empty or null list gives an empty text."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for batch in batches:
            texts = [enc.decode(x) if x else "" for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=[key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(decoded, f"{key} {kind}, text string")
