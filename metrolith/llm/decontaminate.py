"""Benchmark decontamination by spaced-seed hashing.

Words are ``\\w+`` of the lower-cased text.  An overlap is a stretch of a document
and an equally long one of a test item that hold at least ``min_words`` matching
words (or that share of a shorter item) at a share of at least ``min_identity``.

A seed is a fixed mask over word positions; the positions it ignores may differ.
Every window of every test item is hashed under each mask, every window of every
training document too, and equal hashes join a document place with an item place.
An item's masks are the first family of ``FAMILIES`` without which no overlap with
it can be: ``lossless`` proves it for the asked criterion, whatever the overlap's
length and wherever its substitutions stand.  Along each hit's diagonal all stretches are
weighed, and that with the most matching words is taken.

The test side is a stated query set: it is hashed on the driver in blocks of at
most ``block_words`` words, so what is broadcast has a fixed bound, and larger
benchmarks take more passes over the documents, not more memory.  Documents are
never shuffled.

Defined cases: null and empty texts (documents or items) never match, nor do items
of fewer than ``min_item`` words; repeated rows are each reported by ``overlaps``
and kept or removed by their own text in ``clean``, while ``contaminated`` has one
row for all rows of an id (null is one); ties between overlaps of an item go to the one with more matching
words, then the earlier; an empty table on either side gives no rows (``clean``
then keeps all documents); other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import keep_rows, release, slices

#: Families of masks: 1 is compared, 0 is ignored.  The first loses nothing at 12
#: words and 75 %, later ones at less; a single word is in every overlap.
FAMILIES = (("10111", "1001011"), ("1101",), ("11",), ("1",))
MIN_WORDS = 12
MIN_IDENTITY = 0.75
#: Items of fewer words are no passage: they never match.
MIN_ITEM = 5
#: Words of test items that one pass holds; also the bound of what is broadcast.
BLOCK_WORDS = 2_000_000
#: Words compared at once, and seed hits held at once.
CHUNK = 1_000_000
#: What rounding may take from a share.
EPSILON = 1e-9

WORD = re.compile(r"\w+")
#: Odd multipliers, one for each position of a mask.
MULTIPLIERS = np.array(
    [(0x9E3779B97F4A7C15 * (2 * i + 1) + (i << 33)) & 0xFFFFFFFFFFFFFFFF | 1 for i in range(64)],
    dtype=np.uint64,
)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def mask_hash(ids: np.ndarray, mask: str, starts: np.ndarray) -> np.ndarray:
    """The hash of the compared positions of the windows at ``starts``."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            x = ids[starts + k].astype(np.uint64) * MULTIPLIERS[k]
            out += (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out


def lossless(masks: tuple[str, ...], min_words: int, min_identity: float) -> bool:
    """Whether every overlap by the criterion holds a hit of one of the masks.

    An overlap is read as a string of matches and substitutions.  For each of its
    last words and number of matches (up to ``min_words``), the best balance of
    matches against substitutions that a string without a hit can have is followed
    until it settles; a balance of 0 at ``min_words`` matches is an overlap lost.
    """
    size, least = 1 << (max(map(len, masks)) - 1), max(1, min_words)
    cost = min_identity / (1 - min_identity) if min_identity < 1 else 1e9
    seen = np.arange(2 * size)
    hit = np.zeros(2 * size, dtype=bool)
    for mask in masks:
        hit |= (seen & int(mask, 2)) == int(mask, 2)
    best = np.full((size, least + 1), -np.inf)
    best[0, 0] = 0
    for _ in range(100 * least):
        after = best.copy()
        for same in (0, 1):
            ends = np.arange(size) << 1 | same
            free = ~hit[ends]
            if same:
                moved = np.full((int(free.sum()), least + 1), -np.inf)
                moved[:, 1:] = best[free, :-1] + 1
                moved[:, -1] = np.maximum(moved[:, -1], best[free, -1] + 1)
            else:
                moved = best[free] - cost
            np.maximum.at(after, ends[free] & (size - 1), moved)
        if (after[:, least] >= -EPSILON).any():
            return False
        if (after == best).all():
            return True
        best = after
    return False


@lru_cache(256)
def masks_for(min_words: int, min_identity: float) -> tuple[str, ...]:
    return next((f for f in FAMILIES if lossless(f, min_words, min_identity)), FAMILIES[-1])


class SeedIndex:
    """The hashed windows of one block of test items, sorted for a join by search."""

    def __init__(
        self, items: list[tuple[object, str]], min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY, min_item: int = MIN_ITEM
    ):
        self.min_words, self.min_identity = max(1, min_words), min_identity
        self.item_ids, self.vocabulary = [], {}
        ids, self.begins, self.lengths = [], [], []
        for item_id, text in items:
            found = words_of(text or "")
            if len(found) >= max(1, min_item):
                self.item_ids.append(item_id)
                self.begins.append(len(ids))
                self.lengths.append(len(found))
                ids += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found]
        self.ids = np.array(ids, dtype=np.int64)
        of_length: dict[int, list[int]] = {}
        for i, n in enumerate(self.lengths):
            of_length.setdefault(n, []).append(i)
        self.tables = {}
        for n, alike in sorted(of_length.items()):
            # A mask that is longer than the item is needed for none of its overlaps.
            for mask in masks_for(self.needed(n), min_identity):
                if len(mask) > n:
                    continue
                hashes, items_, places = self.tables.setdefault(mask, ([], [], []))
                for i in alike:
                    at = np.arange(n - len(mask) + 1)
                    hashes.append(mask_hash(self.ids, mask, self.begins[i] + at))
                    items_.append(np.full(len(at), i))
                    places.append(at)
        for mask, columns in self.tables.items():
            h, i, p = (np.concatenate(c) for c in columns)
            order = np.argsort(h, kind="stable")
            self.tables[mask] = h[order], i[order], p[order]
        self.longest = max(self.lengths, default=0)

    def needed(self, n: int) -> int:
        """The matching words of an overlap with an item of n words."""
        return max(1, min(self.min_words, math.ceil(self.min_identity * n - EPSILON)))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items, ascending, and the diagonals (document place minus item place) of all equal hashes."""
        found = np.zeros(0, dtype=np.int64)
        width = len(ids) + self.longest + 1
        known = ids > 0
        for mask, (hashes, items, places) in self.tables.items():
            n = len(ids) - len(mask) + 1
            if n <= 0:
                continue
            whole = np.ones(n, dtype=bool)
            for k, c in enumerate(mask):
                if c == "1":
                    whole &= known[k : k + n]
            starts = np.flatnonzero(whole)
            if not len(starts):
                continue
            h = mask_hash(ids, mask, starts)
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            some = high > low
            starts, low, size = starts[some], low[some], (high - low)[some]
            ends = np.cumsum(size)
            a = 0
            while a < len(starts):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, "right")))
                many = size[a:b]
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                entry = np.repeat(low[a:b], many) + step
                keys = items[entry] * width + np.repeat(starts[a:b], many) - places[entry] + self.longest
                found = np.sort(np.concatenate([found, keys]))
                found = found[np.append(True, found[1:] != found[:-1])] if len(found) else found
                a = b
        return found // width, found % width - self.longest

    def likely(self, ids: np.ndarray):
        """(item, diagonal) of the hits whose whole diagonal has matching words enough."""
        items, diagonals = self.hits(ids)
        if not len(items):
            return
        pad = np.zeros(self.longest, dtype=np.int64)
        padded = np.concatenate([pad, ids, pad])
        borders = np.flatnonzero(np.diff(items)) + 1
        for own, places in zip(np.split(items, borders), np.split(diagonals, borders), strict=True):
            item = int(own[0])
            n = self.lengths[item]
            test = self.ids[self.begins[item] : self.begins[item] + n]
            at = np.arange(n) + self.longest
            step = max(1, CHUNK // n)
            for a in range(0, len(places), step):
                part = places[a : a + step]
                same = (padded[part[:, None] + at] == test).sum(axis=1)
                for d in part[same >= self.needed(n)].tolist():
                    yield item, d

    def overlap(self, ids: np.ndarray, item: int, diagonal: int) -> tuple[int, int, int, int] | None:
        """(document start, item start, length, matching words) of the overlap on a diagonal.

        Of the stretches with a share of ``min_identity`` it is the first with the
        most matching words; it begins and ends with a match.
        """
        n = self.lengths[item]
        a, b = max(0, -diagonal), min(n, len(ids) - diagonal)
        if b <= a:
            return None
        test = self.ids[self.begins[item] + a : self.begins[item] + b]
        equal = ids[diagonal + a : diagonal + b] == test
        matching = np.concatenate([[0], np.cumsum(equal)])
        # A stretch has the share when the balance is no lower at its end than at its start;
        # of each end, the farthest such start is where the balance first got so low.
        balance = matching - self.min_identity * np.arange(b - a + 1)
        starts = np.searchsorted(-np.minimum.accumulate(balance), -(balance + EPSILON), "left")
        counts = matching - matching[starts]
        e = int(np.argmax(counts))
        if not counts[e]:
            return None
        s = int(starts[e])
        s += int(np.argmax(equal[s:e]))
        return diagonal + a + s, a + s, e - s, int(counts[e])

    def overlaps_any(self, text: str) -> bool:
        """Whether the text overlaps some item."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words_of(text)], dtype=np.int64)
        for item, diagonal in self.likely(ids):
            run = self.overlap(ids, item, diagonal)
            if run and run[3] >= self.needed(self.lengths[item]):
                return True
        return False

    def matches(self, text: str) -> list[tuple]:
        """(item_id, doc_start, item_start, n_words, n_equal): the best overlap with each item."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words_of(text)], dtype=np.int64)
        best: dict[int, tuple] = {}
        for item, diagonal in self.likely(ids):
            run = self.overlap(ids, item, diagonal)
            if run and run[3] >= self.needed(self.lengths[item]):
                if item not in best or (-run[3], run[0]) < (-best[item][3], best[item][0]):
                    best[item] = run
        return [(self.item_ids[i], *best[i]) for i in sorted(best)]


def blocks(benchmark: DataFrame, block_words: int, id_column: str, text_column: str):
    """The test items in blocks of at most about ``block_words`` words, streamed to the driver."""
    block, size = [], 0
    rows = benchmark.select(id_column, text_column).where(F.col(text_column).isNotNull())
    for item_id, text in rows.toLocalIterator():
        block.append((item_id, text))
        size += len(words_of(text))
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    min_words: int = MIN_WORDS,
    min_identity: float = MIN_IDENTITY,
    block_words: int = BLOCK_WORDS,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    min_item: int = MIN_ITEM,
) -> DataFrame:
    """One row for each document and test item that overlap.

    Columns: the document's id, the item's id, doc_start and item_start (words
    from 0), n_words (length of the overlap) and n_equal (its matching words).
    """
    spark = docs.sparkSession
    doc_kind, item_kind = dict(docs.dtypes)[id_column], dict(benchmark.dtypes)[item_column]
    schema = (
        f"{id_column} {doc_kind}, {item_column} {item_kind}, "
        "doc_start bigint, item_start bigint, n_words bigint, n_equal bigint"
    )
    narrow = docs.select(id_column, text_column)
    item_type = to_arrow_type(benchmark.schema[item_column].dataType)
    out = None
    for block in blocks(benchmark, block_words, item_column, "text"):
        index = spark.sparkContext.broadcast(SeedIndex(block, min_words, min_identity, min_item))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in slices(batch, 1):
                    rows, places = [], []
                    for i, text in enumerate(texts):
                        for found in index.value.matches(text):
                            places.append(i)
                            rows.append(found)
                    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array(places, pa.int64())),
                            pa.array(columns[0], item_type),
                            *(pa.array(c, pa.int64()) for c in columns[1:]),
                        ],
                        names=[id_column, item_column, "doc_start", "item_start", "n_words", "n_equal"],
                    )
            release()

        found = narrow.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each document that overlaps a test item.

    Columns: doc_id, n_items, items (item ids, ascending, comma-joined),
    n_equal (most matching words with one item).
    """
    id_column = options.get("id_column", "doc_id")
    item_column = options.get("item_column", "item_id")
    found = overlaps(docs, benchmark, **options)
    return found.groupBy(id_column).agg(
        F.count_distinct(item_column).alias("n_items"),
        F.array_join(F.array_sort(F.collect_set(item_column)).cast("array<string>"), ",").alias("items"),
        F.max("n_equal").alias("n_equal"),
    )


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    min_words: int = MIN_WORDS,
    min_identity: float = MIN_IDENTITY,
    block_words: int = BLOCK_WORDS,
    text_column: str = "text",
    item_column: str = "item_id",
    min_item: int = MIN_ITEM,
) -> DataFrame:
    """The documents that overlap no test item, with all their columns.

    Each block of test items is a pass over the rows that are left; nothing is joined back.
    """
    for block in blocks(benchmark, block_words, item_column, "text"):
        index = docs.sparkSession.sparkContext.broadcast(SeedIndex(block, min_words, min_identity, min_item))
        docs = keep_rows(docs, lambda texts, index=index: [not index.value.overlaps_any(t) for t in texts], text_column)
    return docs
