"""Line dedup by an exact set-similarity join.

A line is a ``\\n``-separated piece with at least one word (run of anything but
ASCII white space); its tokens are its distinct words.  Two lines match at a
Jaccard similarity of at least 0.8.  A line is removed when an earlier line (by
doc_id, then place in the document) has the same tokens or matches it.  Rows that
share an id stand one after another by their text, rows without an id last.

Lines with the same tokens form a class, stood for by its first line, so copies
never meet each other.  Classes are joined by prefix filtering: tokens are
ordered by rarity (the level of their hash bucket's count over all documents,
then the hash).  Two sets that match share a token among the first
n - ceil(0.8 n) + 1 of the larger and the first n - ceil(8/9 n) + 1 of the
smaller.  A token whose bucket counts one word has no partner and is left out.

The prefix entries are joined with themselves by token; length, positional and
bitmap filters in the join's condition leave the pairs whose whole sets are then
compared.  A token whose bucket counts more than ``BUCKET_ENTRIES`` words, and ``SHARE`` of
all words, meets in two rounds, as a line needs only one earlier match to go: first each class meets
the ``EARLIEST`` classes of its token and size group, which keeps large groups of
near copies linear; then the classes that stayed meet all earlier ones of these
tokens.  So no pair is left out that could still remove a line.  Where more than
``DEALT`` words are counted, the later sides of the second round are dealt to
shares and each share meets all earlier sides, so that no task buffers a whole token.

The bitmap filter: each token flips one of 96 bits at most, so two sets differ in at least as many tokens as their bitmaps differ in bits, and sets that
match differ in at most a ninth of their summed sizes.

Tokens are compared as the upper 56 bits of a hash joined with their bucket's
level; class keys are two 64-bit hashes.

All rows are handled by built-in functions; the driver alone turns the buckets'
counts, of a fixed number, into levels.

Defined cases: null and empty texts have no lines; blank lines are neither
counted nor removed; rows that repeat an id, or have none, are rows of their own and
are deduplicated like any others (where ids repeat, are null or are no integers,
rows are sorted and numbered first); the class of a line of a row without an id is
written with the id ``null``; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from ._common import materialize

#: Buckets of the word counts; a bucket's level counts thirds of a power of two, 0 for a single word.
BUCKETS = 1 << 20
#: Words of a bucket beyond which its tokens meet in two rounds: this many, and this share of all words.
BUCKET_ENTRIES, SHARE = 1024, 2**-13
#: Candidates of a class, token and size group in the first of these rounds.
EARLIEST = 4
#: Words of a bucket beyond which the second round deals its tokens' later sides to shares.
DEALT = 1 << 19
#: Lines whose tokens are fetched for comparison are broadcast up to this many, and joined by a shuffle beyond.
BROADCAST_LINES = 1_000_000
#: Sizes of sets are told apart up to this one in the join's filters, which let larger sets pass.
SIZES = (1 << 16) - 1
#: White space between words, and what any line with a word has.
SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"


def rarity(docs: DataFrame, text_column: str = "text") -> tuple[DataFrame, int]:
    """The level (thirds of a power of two) of each hash bucket's number of words, one row with an array of fixed length.

    And the level that tokens have at least that meet in two rounds.
    """
    words = docs.select(F.explode(F.split(text_column, SPACE)).alias("w")).where("w != ''")
    counted = words.groupBy(F.xxhash64("w").bitwiseAND(BUCKETS - 1).cast("int").alias("bucket")).count()
    found = counted.toArrow()
    count = np.zeros(BUCKETS, dtype=np.int64)
    count[found.column("bucket").to_numpy()] = found.column("count").to_numpy()
    level = np.minimum(127, np.ceil(3 * np.log2(np.maximum(count, 1)))).astype(np.int8)
    one = pa.table({"level": pa.ListArray.from_arrays(pa.array([0, BUCKETS], pa.int32()), pa.array(level))})
    often = math.floor(3 * math.log2(max(BUCKET_ENTRIES, SHARE * int(count.sum())))) + 1
    return materialize(docs.sparkSession.createDataFrame(one), "line-levels"), min(127, often)


def with_tokens(lines: DataFrame, level: DataFrame) -> DataFrame:
    """``line`` replaced by ``t``, its sorted tokens: the level of a word's bucket, then the upper 56 bits of its hash.

    The levels are a scalar subquery, which a lambda may not hold as written; the optimizer
    puts the column that holds it into its one use, so that rows don't carry the array.
    """
    words = F.array_remove(F.split("line", SPACE), "")
    hashed = F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))

    def token(h):
        at = F.get("levels", h.bitwiseAND(BUCKETS - 1).cast("int"))
        return F.shiftleft(at.cast("bigint"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    rest = [c for c in lines.columns if c != "line"]
    held = lines.select("*", level.scalar().alias("levels"))
    return held.select(*rest, F.sort_array(F.transform(hashed, token)).alias("t"))


def _bitmap(tokens: Column, half: int, bits: int) -> Column:
    """The bits, from the seventh, that the tokens flip whose own seventh bit is ``half``; those beyond 64 are lost."""

    def flip(acc, x):
        one = (x if half else x.bitwiseXOR(64)).bitwiseAND(64)
        return acc.bitwiseXOR(F.call_function("shiftleft", one, x.bitwiseAND(bits - 1).cast("int")))

    return F.aggregate(tokens, F.lit(0).cast("bigint"), flip)


def _below(tokens: Column, level: int) -> Column:
    """How many of the sorted tokens have a lower level."""
    bound = F.lit(level << 56)
    return (F.array_position(F.sort_array(F.array_append(tokens, bound)), bound) - 1).cast("int")


def signed_lines(docs: DataFrame, level: DataFrame, often: int, id_column: str, text_column: str) -> DataFrame:
    """A row of each line with a word: class key, size, bitmap, and the prefix tokens that others may have.
    ``keys`` are hashes of those that meet in one round, ``hot`` the tokens of the others, which follow them;
    ``skipped`` is how many stand before.
    """
    split = docs.select(F.col(id_column).alias("doc_id"), F.posexplode(F.split(text_column, "\n")).alias("line_no", "line"))
    sets = with_tokens(split.where(F.col("line").rlike(WORD)), level)
    n = F.size("t")
    # Sets of one to three tokens match no other set.
    prefix = F.when(n >= 4, n - F.floor((4 * n + 4) / 5).cast("int") + 1).otherwise(0)
    signed = sets.select(
        "doc_id",
        "line_no",
        F.xxhash64("t").alias("h1"),
        F.xxhash64(F.lit(1), "t").alias("h2"),
        n.alias("n"),
        _bitmap(F.col("t"), 1, 64).alias("sig1"),
        F.shiftright(_bitmap(F.col("t"), 0, 32), 6).alias("sig2"),
        F.slice("t", F.lit(1), prefix).alias("p"),
    )
    counted = signed.withColumns({"skipped": _below(F.col("p"), 1), "whole": _below(F.col("p"), often)})
    keys = F.slice("p", F.col("skipped") + 1, F.col("whole") - F.col("skipped"))
    hot = F.slice("p", F.col("whole") + 1, F.size("p") - F.col("whole"))
    low = lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int")
    return counted.select(*signed.columns[:-1], "skipped", F.transform(keys, low).alias("keys"), hot.alias("hot"))


def classes(lines: DataFrame) -> DataFrame:
    """A row of each class, at the place of its first line; its other columns are the same on all its lines."""
    rest = [F.first(c).alias(c) for c in lines.columns[4:]]
    found = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("f"), *rest)
    return materialize(found.select("h1", "h2", "f.*", *lines.columns[4:]), "line-classes")


# --- the join ---------------------------------------------------------------------------

#: An entry beside its token: the class's row, its line number and the smaller part of its bitmap, the larger part,
#: and the token's place in the set and the set's size, both 0 to SIZES.
ENTRY = ["row", "mark", "s1", "spot"]
LOW = (1 << 32) - 1


def _entries(found: DataFrame, column: str, before: Column) -> DataFrame:
    """(token, and ENTRY) of each element of a column of prefix tokens, ``before`` places behind the set's start."""
    flat = found.select(
        F.col("doc_id").alias("row"),
        F.shiftleft("sig2", 32).bitwiseOR(F.col("line_no").cast("bigint")).alias("mark"),
        F.col("sig1").alias("s1"),
        F.col("n").cast("bigint").alias("n"),
        before.alias("before"),
        F.posexplode(column).alias("at", "token"),
    )
    place = F.shiftleft((F.col("before") + F.col("at")).cast("bigint"), 16)
    return flat.withColumn("spot", F.when(F.col("n") < SIZES, place.bitwiseOR(F.col("n"))).otherwise(SIZES)).select("token", *ENTRY)


def _size(side: str) -> Column:
    return F.col(f"{side}spot").bitwiseAND(SIZES)


def _no(side: str) -> Column:
    return F.col(f"{side}mark").bitwiseAND(LOW)


def _possible() -> Column:
    """Whether a pair of entries (``a_`` the earlier) of one token passes the length, positional and bitmap filters.

    Sets that match differ in at most a ninth of their summed sizes.  For the first
    token that they share, all tokens before it, on either side, are such differences.
    """
    na, nb, place_a, place_b = _size("a_"), _size("b_"), F.shiftright("a_spot", 16), F.shiftright("b_spot", 16)
    earlier = (F.col("a_row") < F.col("b_row")) | ((F.col("a_row") == F.col("b_row")) & (_no("a_") < _no("b_")))
    short, long, place = F.least(na, nb), F.greatest(na, nb), F.when(na <= nb, place_a).otherwise(place_b)
    in_mark = F.shiftrightunsigned(F.col("a_mark").bitwiseXOR(F.col("b_mark")), 32)
    differ = F.bit_count(F.col("a_s1").bitwiseXOR(F.col("b_s1"))) + F.bit_count(in_mark)
    # The place in the smaller set is within its first n - ceil(8/9 n) + 1.
    indexed = 9 * place <= short
    placed = (9 * (place_a + place_b) <= na + nb) | (long >= SIZES)
    return earlier & (5 * short >= 4 * long) & placed & (9 * differ <= na + nb) & indexed


def _sides(entries: DataFrame, side: str) -> DataFrame:
    return entries.select([F.col(c).alias(side + c) for c in entries.columns])


def _pairs(met: DataFrame) -> DataFrame:
    found = [F.col("a_row").alias("a_doc"), _no("a_").cast("int").alias("a_no")]
    return met.select(*found, F.col("b_row").alias("b_doc"), _no("b_").cast("int").alias("b_no"))


def _hot(found: DataFrame) -> DataFrame:
    return _entries(found.where(F.size("hot") > 0), "hot", F.col("skipped") + F.size("keys"))


def candidates(found: DataFrame) -> DataFrame:
    """Pairs of classes that may match: all that share a rarer token, and the first ones of each other token."""
    # The token and its spot as one number: rows as short as may be, the same on both sides, so that one shuffle serves both.
    token = F.shiftleft(F.col("token").cast("bigint"), 32).bitwiseOR(F.col("spot"))
    rare = _entries(found, "keys", F.col("skipped")).select(token.alias("token"), *ENTRY[:-1])
    a, b = (_sides(rare, x).withColumn(f"{x}spot", F.col(f"{x}token").bitwiseAND(LOW)) for x in ("a_", "b_"))
    met = _pairs(a.join(b.hint("merge"), (F.shiftright("a_token", 32) == F.shiftright("b_token", 32)) & _possible()))
    group = F.floor(F.log(_size("")) / math.log(1.25) + 1e-9)
    first = Window.partitionBy("token", group).orderBy("row", _no(""))
    often = _hot(found)
    for k in range(1, EARLIEST + 1):
        beside = often.select(F.nth_value(F.struct(*ENTRY), k).over(first).alias("a"), *(F.col(c).alias(f"b_{c}") for c in ENTRY))
        both = beside.where("a is not null").select(*(F.col(f"a.{c}").alias(f"a_{c}") for c in ENTRY), *(f"b_{c}" for c in ENTRY))
        met = met.union(_pairs(both.where(_possible())))
    return materialize(met.distinct(), "line-pairs")


def remaining(found: DataFrame, unsure: DataFrame) -> DataFrame:
    """Pairs that may match of all earlier and the unsure later classes that share a token met in two rounds."""
    later = _hot(found.join(unsure, (F.col("doc_id") == F.col("b_doc")) & (F.col("line_no") == F.col("b_no")), "left_semi"))
    shares = F.ceil(F.pow(F.lit(2.0), F.shiftright("token", 56) / 3) / DEALT).cast("int")
    dealt = later.withColumn("share", F.pmod(F.xxhash64("row", "mark"), shares).cast("int"))
    earlier = _hot(found)
    # Most tokens have one share.
    once = earlier.where(shares <= 1).withColumn("share", F.lit(0))
    often = earlier.where(shares > 1).withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))
    same = (F.col("a_token") == F.col("b_token")) & (F.col("a_share") == F.col("b_share"))
    met = _sides(once.union(often), "a_").join(_sides(dealt, "b_").hint("merge"), same & _possible())
    return materialize(_pairs(met).distinct(), "line-pairs")


def matching(pairs: DataFrame, docs: DataFrame, level: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(b_doc, b_no) of the pairs whose whole sets match."""
    needed = pairs.select(F.col("a_doc").alias("doc"), F.col("a_no").alias("no")).union(pairs.select("b_doc", "b_no"))
    needed = materialize(needed.distinct().groupBy("doc").agg(F.collect_list("no").alias("nos")), "lines-needed")
    few = needed.agg(F.coalesce(F.sum(F.size("nos")), F.lit(0))).first()[0] <= BROADCAST_LINES
    texts = docs.select(F.col(id_column).alias("_d"), F.col(text_column).alias("_t"))
    chosen = texts.join(F.broadcast(needed) if few else needed, F.col("_d") == F.col("doc"))
    chosen = chosen.select("doc", "nos", F.split("_t", "\n").alias("_t"))
    asked = F.transform("nos", lambda k: F.struct(k.alias("no"), F.get("_t", k).alias("line")))
    lines = chosen.select("doc", F.explode(asked).alias("x")).select("doc", "x.*")
    sets = materialize(with_tokens(lines, level), "line-sets")
    left, right = sets.toDF("l_doc", "l_no", "l_t"), sets.toDF("r_doc", "r_no", "r_t")
    both = pairs.join(left, (F.col("a_doc") == F.col("l_doc")) & (F.col("a_no") == F.col("l_no"))).join(
        right, (F.col("b_doc") == F.col("r_doc")) & (F.col("b_no") == F.col("r_no"))
    )
    shared = F.size(F.array_intersect("l_t", "r_t"))
    return both.where(9 * shared >= 4 * (F.size("l_t") + F.size("r_t"))).select("b_doc", "b_no").distinct()


def removed_classes(rows: DataFrame, found: DataFrame, level: DataFrame) -> DataFrame:
    """(x_doc, x_no): the first places of the classes that an earlier class matches."""
    gone = materialize(matching(candidates(found), rows, level, "_row", "_text"), "lines-gone")
    names = ["b_doc", "b_no"]
    often = found.where(F.size("hot") > 0).select(F.col("doc_id").alias("b_doc"), F.col("line_no").alias("b_no"))
    unsure = materialize(often.join(gone, names, "left_anti"), "lines-unsure")
    if unsure.head(1):
        gone = gone.union(matching(remaining(found, unsure), rows, level, "_row", "_text"))
    return gone.toDF("x_doc", "x_no")


def numbered(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, bool]:
    """(_row, _id, _text) of every document, ``_row`` a bigint of its own; and whether that is the id itself.

    It is where ids are integers, present and unique.  Otherwise rows are sorted by id
    (null last) and text and numbered in that order, with gaps.
    """
    both = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    if isinstance(docs.schema[id_column].dataType, IntegralType):
        odd = both.groupBy("_id").count().where("_id is null or count > 1")
        if not odd.head(1):
            return both.select(F.col("_id").cast("bigint").alias("_row"), "_id", "_text"), True
    order = [F.col("_id").isNull(), F.col("_id"), F.coalesce("_text", F.lit(""))]
    parts = max(1, docs.rdd.getNumPartitions())
    placed = both.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialize(placed.select(F.monotonically_increasing_id().alias("_row"), "_id", "_text"), "line-rows"), False


def _decided(rows: DataFrame) -> DataFrame:
    """(row, line_no, class_row, class_no, removed) of every line with a word of the numbered rows."""
    level, often = rarity(rows, "_text")
    lines = materialize(signed_lines(rows, level, often, "_row", "_text"), "lines")
    found = classes(lines)
    gone = removed_classes(rows, found, level)
    marked = found.join(gone, (F.col("doc_id") == F.col("x_doc")) & (F.col("line_no") == F.col("x_no")), "left").select(
        F.col("h1").alias("c_h1"),
        F.col("h2").alias("c_h2"),
        F.col("doc_id").alias("class_row"),
        F.col("line_no").alias("class_no"),
        F.col("x_doc").isNotNull().alias("gone"),
    )
    joined = lines.join(marked, (F.col("h1") == F.col("c_h1")) & (F.col("h2") == F.col("c_h2")))
    later = (F.col("doc_id") != F.col("class_row")) | (F.col("line_no") != F.col("class_no"))
    return joined.select(F.col("doc_id").alias("row"), "line_no", "class_row", "class_no", (F.col("gone") | later).alias("removed"))


def digest(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: lines with a word, removed lines (count and numbers), and its lines' classes.

    ``removed_lines`` are line numbers from 0, comma-joined; ``classes`` are the
    first places (document:line) of its lines' classes, in line order.
    """
    rows, plain = numbered(docs, id_column, text_column)
    per_line = _decided(rows)
    if plain:
        per_line = per_line.withColumnRenamed("class_row", "class_id")
    else:
        names = rows.select(F.col("_row").alias("class_row"), F.coalesce(F.col("_id").cast("string"), F.lit("null")).alias("class_id"))
        per_line = per_line.join(names, "class_row")
    listed = F.array_sort(F.collect_list(F.struct("line_no", "removed", "class_id", "class_no")))
    by_row = per_line.groupBy("row").agg(listed.alias("x"))
    gone = F.transform(F.filter("x", lambda r: r["removed"]), lambda r: r["line_no"].cast("string"))
    class_of = F.transform("x", lambda r: F.concat_ws(":", r["class_id"].cast("string"), r["class_no"].cast("string")))
    return rows.select("_row", "_id").join(by_row, F.col("_row") == F.col("row"), "left").select(
        F.col("_id").alias(id_column),
        F.coalesce(F.size("x"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.array_join(gone, ","), F.lit("")).alias("removed_lines"),
        F.coalesce(F.array_join(class_of, ","), F.lit("")).alias("classes"),
    )


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text) of every row with removed lines taken out."""
    rows, _ = numbered(docs, id_column, text_column)
    gone = _decided(rows).where("removed").groupBy("row").agg(F.collect_list("line_no").alias("gone"))
    kept = F.filter(F.split("_text", "\n"), lambda x, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    return rows.join(gone, F.col("_row") == F.col("row"), "left").select(
        F.col("_id").alias(id_column), F.array_join(kept, "\n").alias(text_column)
    )
