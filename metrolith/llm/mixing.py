"""Mixing sources to target weights with a low-discrepancy schedule.

Sources, in code point order with null last, have the weights 5, 2, 1 repeating.
Targets share all the corpus's words by weight; a target stops at ``most`` times
its source's words, and the excess is shared again by weight until none is above.

The schedule has one slot for every block to be taken.  Slot t takes the point
frac((t + 1) * golden ratio), which is mapped through the cumulative numbers of
blocks that the targets ask for to a source; a slot's rank among its source's
slots names the block it takes.  Documents of a source stand in the order of a
hash of their id and text and are cut, as one long stream of words, into equal
blocks (``BLOCK`` words, fewer in a source whose target holds less than ``LEAST``
such blocks); rank k takes block k modulo the number of blocks, so a source is
read again only after it was read whole.  A document's taken words are the words
its blocks share with it, times the visits of each block.

Ranks and stream offsets are running counts.  They are taken in two levels
(inside a bucket, then over buckets), so a source with a third of all rows is
many tasks' work.  Only one row per source comes to the driver.

Defined cases: null texts and texts without a word are returned with taken 0 and
stand in no stream; documents that repeat an id (or have none) are told apart by
their text's hash and, if alike, by a row number; a source without words has
target 0; an empty table, or one without a word, is mixed to nothing; other
columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import checked, materialize, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
GOLDEN = 0.6180339887498949
#: Words of a block at most, and blocks that a source's target is cut into at least.
BLOCK, LEAST = 1024, 400
#: Rows of ids, hashes, sources and copies (some 120 bytes each) that are broadcast at most; beyond it they are joined by a shuffle.
BROADCAST_KEYS = 1 << 18
#: Rows of a bucket, and slots of a chunk, that one window sees.
BUCKET_ROWS = 4096
CHUNK = 1 << 16


@dataclass(frozen=True)
class SourcePlan:
    source: str | None
    size: int
    rows: int
    target: float

    @property
    def block(self) -> int:
        """Words of a block of this source."""
        return max(1, min(BLOCK, int(self.target / LEAST)))


def targets(sizes: list[tuple[str | None, int, int]], weights=WEIGHTS, most=MOST) -> list[SourcePlan]:
    """The target of each source from (source, size, rows)."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = [weights[i % len(weights)] for i in range(len(order))]
    total = float(sum(s for _, s, _ in order))
    target, open_ = [0.0] * len(order), set(range(len(order)))
    left = total
    while open_:
        whole = sum(weight[i] for i in open_)
        share = {i: left * weight[i] / whole for i in open_}
        full = {i for i in open_ if share[i] > most * order[i][1]}
        if not full:
            for i in open_:
                target[i] = share[i]
            break
        for i in full:
            target[i] = float(most * order[i][1])
        left -= sum(target[i] for i in full)
        open_ -= full
    return [SourcePlan(s, n, r, t) for (s, n, r), t in zip(order, target, strict=True)]


def slot_counts(spark, plans: list[SourcePlan]) -> DataFrame:
    """(s, k): each source's number and the ranks of its slots in the schedule, from 0."""
    blocks = [p.target / p.block for p in plans]
    total = sum(blocks)
    n = math.ceil(total)
    run, edges = 0.0, []
    for x in blocks:
        run += x
        edges.append(run / total)
    point = (F.col("id") + 1) * F.lit(GOLDEN) % F.lit(1.0)
    bounds = F.from_json(F.lit("[" + ",".join(map(repr, edges[:-1])) + "]"), "array<double>")
    source = F.size(F.filter(bounds, lambda e: e <= F.col("x"))).alias("s")
    slots = spark.range(n).withColumn("x", point).select("id", (F.col("id") / CHUNK).cast("bigint").alias("chunk"), source)
    inside = Window.partitionBy("chunk", "s").orderBy("id")
    ranked = slots.withColumn("r", F.row_number().over(inside) - 1)
    counts = slots.groupBy("chunk", "s").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("s").orderBy("chunk")) - F.col("n")
    offsets = counts.select("chunk", "s", before.alias("before"))
    return ranked.join(offsets, ["chunk", "s"]).select("s", (F.col("r") + F.col("before")).alias("k"))


def sizes_of(docs: DataFrame, id_column="doc_id", text_column="text", source_column="source") -> DataFrame:
    """(row_id, source, size, h, h2): words of each document, its place in the shuffle, its text's hash."""
    text = text_or_empty(text_column)
    return docs.select(
        F.col(id_column).alias("row_id"),
        F.col(source_column).alias("source"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("size"),
        F.xxhash64(F.col(id_column), text, F.lit(7)).alias("h"),
        F.xxhash64(text).alias("h2"),
    )


def _scheduled(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """(row_id, h2, source, size, source_size, target, taken, copies) of every document."""
    spark = docs.sparkSession
    sized = materialize(sizes_of(docs, id_column, text_column, source_column), "mix-sizes")
    found = sized.groupBy("source").agg(F.sum("size"), F.count("*")).collect()
    plans = targets([(r[0], r[1], r[2]) for r in found])
    if not any(p.target > 0 for p in plans):
        none = F.lit(0).cast("bigint")
        size = [none.alias("source_size"), F.lit(0.0).alias("target"), none.alias("taken"), none.alias("copies")]
        return sized.select("row_id", "h2", "source", "size", *size)
    known = spark.createDataFrame(
        [(i, p.source, p.size, p.target, p.block, max(1, -(-p.rows // BUCKET_ROWS))) for i, p in enumerate(plans)],
        "s int, p_source string, source_size bigint, target double, block bigint, buckets bigint",
    )
    # Offsets in the source's stream: inside a bucket of the hash order, then over buckets.
    placed = sized.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("p_source"))).withColumn(
        "bucket",
        F.floor((F.shiftrightunsigned("h", 1) / F.lit(2.0**63)) * F.col("buckets")).cast("bigint"),
    )
    wordless, placed = placed.where("size = 0"), placed.where("size > 0")
    inside = Window.partitionBy("s", "bucket").orderBy("h", "row_id", "h2")
    summed = placed.groupBy("s", "bucket").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("s").orderBy("bucket")) - F.col("n")
    starts = summed.select("s", "bucket", before.alias("before"))
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    streamed = (
        placed.withColumn("upto", upto)
        .withColumn("nth", F.row_number().over(inside))
        .join(starts, ["s", "bucket"])
        .withColumn("end", F.col("before") + F.col("upto"))
        .withColumn("start", F.col("end") - F.col("size"))
    )
    names = ["s", "bucket", "nth", "row_id", "h2", "source", "size", "source_size", "target", "block", "start", "end"]
    streamed = materialize(streamed.select(*names), "mix-stream")
    # Visits of each block: slots of its source by rank modulo the number of blocks.
    blocks = known.where("source_size > 0").select(F.col("s").alias("b_s"), F.expr("(source_size + block - 1) div block").alias("blocks"))
    visits = (
        slot_counts(spark, plans)
        .join(F.broadcast(blocks), F.col("s") == F.col("b_s"))
        .where(F.col("k") < MOST * F.col("blocks"))
        .select(F.col("s").alias("v_s"), (F.col("k") % F.col("blocks")).alias("v_block"))
        .groupBy("v_s", "v_block")
        .agg(F.count("*").alias("visits"))
    )
    cut = streamed.withColumn("at", F.explode(F.sequence(F.expr("start div block"), F.expr("(end - 1) div block")))).withColumn(
        "shared",
        F.least(F.col("end"), (F.col("at") + 1) * F.col("block")) - F.greatest(F.col("start"), F.col("at") * F.col("block")),
    )
    taken = (
        cut.join(visits, (F.col("s") == F.col("v_s")) & (F.col("at") == F.col("v_block")))
        .groupBy("s", "bucket", "nth")
        .agg(
            F.sum(F.col("shared") * F.col("visits")).alias("taken"),
            F.max(F.when(F.col("at") == F.expr("start div block"), F.col("visits"))).alias("copies"),
        )
    )
    rows = ["row_id", "h2", "source", "size", "source_size", "target"]
    out = streamed.join(taken, ["s", "bucket", "nth"], "left").select(*rows, "taken", "copies")
    none = F.lit(None).cast("bigint")
    return out.union(wordless.select(*rows, none, none)).na.fill(0, ["taken", "copies"])


def schedule(docs: DataFrame, id_column="doc_id", text_column="text", source_column="source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every document.

    ``copies`` is how often the schedule visits the block in which the document
    starts: how often a mix of whole documents holds it.
    """
    names = [F.col("row_id").alias(id_column), "size", "source_size", "target", "taken", "copies"]
    return _scheduled(docs, id_column, text_column, source_column).select(*names)


def mix(docs: DataFrame, id_column="doc_id", text_column="text", source_column="source") -> DataFrame:
    """The documents of the mix, each as often as the schedule takes it, with all their columns.

    Rows that are alike in id, text and source are numbered, and each is taken as
    often as the schedule says of its number; all others are found by those three.
    """
    h2, key = F.xxhash64(text_or_empty(text_column)), ["row_id", "h2", "source"]
    taken = materialize(_scheduled(docs, id_column, text_column, source_column).where("size > 0").select(*key, "copies"), "mix-taken")
    found = taken.groupBy(*key).agg(F.count("*").alias("rows"), F.max("copies").alias("copies")).where("copies > 0")
    known = checked(found, "mix-copies", BROADCAST_KEYS)

    def fresh(name: str) -> str:
        while name in docs.columns:
            name += "_"
        return name

    def same(other: DataFrame) -> Column:
        return docs[id_column].eqNullSafe(other["row_id"]) & (h2 == other["h2"]) & docs[source_column].eqNullSafe(other["source"])

    nth, times, own = fresh("_nth"), fresh("_times"), [docs[c] for c in docs.columns]
    out = docs.join(known.where("rows = 1"), same(known)).select(*own, F.explode(F.sequence(F.lit(1), known["copies"].cast("int"))).alias(times))
    out = out.select(*docs.columns)
    if known.where("rows > 1").head(1):
        alike = known.where("rows > 1")
        same_key = [taken[c].eqNullSafe(alike[c]) for c in key]
        number = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("copies")))
        shares = taken.join(alike, same_key, "left_semi").select(*key, "copies", number.alias("nth")).where("copies > 0")
        number = F.row_number().over(Window.partitionBy(id_column, h2, source_column).orderBy(F.xxhash64(*docs.columns)))
        rows = docs.join(alike, same(alike), "left_semi").withColumn(nth, number)
        at = rows[id_column].eqNullSafe(shares["row_id"]) & (h2 == shares["h2"]) & rows[source_column].eqNullSafe(shares["source"])
        each = rows.join(shares, at & (rows[nth] == shares["nth"])).select(
            *(rows[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), shares["copies"].cast("int"))).alias(times)
        )
        out = out.union(each.select(*docs.columns))
    return out
