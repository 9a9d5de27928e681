"""SimHash near-duplicate groups by multi-index hashing.

A document's fingerprint has 64 bits: bit i is set when more than half of its
4-word shingles (A-Z lower-cased, words cut at ASCII white space, repeats
counted, XXH64 with seed 42) have bit i set.  Two fingerprints link at a Hamming
distance of at most ``radius``.

Links are found by multi-index hashing.  The 64 bits are cut into m segments;
by the pigeonhole principle two fingerprints within the radius agree in some
segment up to radius // m bits.  Each distinct fingerprint is entered once per
segment in a table keyed by (segment, value); each also enumerates the Hamming
ball of that small radius around each of its segment values, fetches the table
entries of those keys, and the whole distance is verified in the join.  Any m
gives the same links; m only trades probes against candidates, and
``segments_for`` picks the cheaper one from the number of distinct fingerprints.

Copies never meet each other: they share one fingerprint, which is one row here.
Components are found over fingerprints by alternating large-star and small-star
rounds, each written to the shared folder; nothing is collected.

Defined cases: null and empty texts, and texts of white space only, have
fingerprint zero and link like any other; texts of one to three words hash the
whole word sequence; rows that repeat a doc_id each get a row; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checked, materialize, per_document

BITS = 64
SHINGLE = 4
SEED = 42
#: Work of a probe, which is shuffled, spilled and sorted, beside that of a candidate, which is only compared.
PROBE = 8


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype="<u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = [0, *(ends[: n - 1] + 1).tolist()]
        pieces = [joined[a:b] for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
        hashes = np.fromiter(
            map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), dtype="<u8", count=n
        )
    counts = np.zeros(BITS, dtype=np.int64)
    for a in range(0, len(hashes), 65_536):
        bits = np.unpackbits(
            hashes[a : a + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
        )
        counts += bits.sum(axis=0, dtype=np.int64)
    value = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(value.view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each document as a signed bigint."""

    def rows(texts):
        values = np.array([fingerprint(t) for t in texts], dtype=np.uint64)
        return {"fp": pa.array(values.view(np.int64))}

    return per_document(docs, rows, "fp bigint", id_column, text_column)


def cuts(segments: int) -> list[tuple[int, int]]:
    """(offset, width) of each segment; widths differ by one bit at most."""
    edges = [round(BITS * i / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def probes(segments: int, radius: int) -> list[tuple[int, int, int]]:
    """(segment, offset, flip mask) of every key that a fingerprint looks up."""
    out = []
    for i, (offset, width) in enumerate(cuts(segments)):
        for r in range(radius // segments + 1):
            for bits in combinations(range(width), r):
                out.append((i, offset, sum(1 << b for b in bits)))
    return out


def segments_for(distinct: int, radius: int) -> int:
    """The number of segments with the least work in probes and expected random candidates."""

    def cost(m: int) -> float:
        ball = [sum(comb(w, r) for r in range(radius // m + 1)) for _, w in cuts(m)]
        random = sum(b * distinct**2 / 2**w for b, (_, w) in zip(ball, cuts(m), strict=True))
        return PROBE * sum(ball) * distinct + random

    return min(range(2, radius + 2), key=cost)


def links(distinct: DataFrame, radius: int = 4, segments: int = 3) -> DataFrame:
    """(a, b), a < b: pairs of different fingerprints within the radius, each once.

    ``distinct`` has one column fp without repeats.
    """

    def key(segment, value):
        return F.shiftleft(segment.cast("bigint"), 40).bitwiseOR(value)

    def value(fp, offset, width):
        return F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))

    def flipped(fp, i, offset, width):
        masks = [m for s, _, m in probes(segments, radius) if s == i]
        flips = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>")
        own = value(fp, offset, width)
        return F.transform(flips, lambda m: key(F.lit(i), own.bitwiseXOR(m)))

    def ball(fp):
        return F.flatten(F.array(*(flipped(fp, i, o, w) for i, (o, w) in enumerate(cuts(segments)))))

    fp = F.col("fp")
    table = distinct.select(
        fp.alias("b"),
        F.explode(
            F.array(*(key(F.lit(i), value(fp, o, w)) for i, (o, w) in enumerate(cuts(segments))))
        ).alias("kb"),
    )
    looked = distinct.select(fp.alias("a"), F.explode(ball(fp)).alias("ka"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    found = looked.join(table, (F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")) & near)
    return found.select("a", "b").distinct()


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of the component of each node of ``edges`` (a, b).

    Alternates large-star and small-star; minima are aggregated before they are
    joined back, so a node with many neighbours is no single task's work.
    """
    now = materialize(edges.select("a", "b"), name)
    before = None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (
            both.where("v > u")
            .join(least, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        moved = moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        kept = least.select(F.col("m").alias("a"), F.col("u").alias("b"))
        now = materialize(moved.union(kept).distinct(), name)
    else:
        raise RuntimeError("components did not settle")
    stars = now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    return stars.union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(
    docs: DataFrame,
    radius: int = 4,
    segments: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    ``fingerprint`` is 16 lower-case hex digits, ``component_id`` the smallest
    doc_id that links of at most ``radius`` bits reach.
    """
    each = materialize(fingerprints(docs, id_column, text_column), "simhash")
    least = each.groupBy("fp").agg(F.min(id_column).alias("least"))
    distinct = materialize(least, "simhash-distinct")
    m = segments or segments_for(max(1, distinct.count()), radius)
    roots = components(links(distinct.select("fp"), radius, m), "simhash-links")
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(smallest, "root").select(F.col("fp").alias("of_fp"), "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return each.join(by_fp, F.col("fp") == F.col("of_fp")).select(
        id_column, hexed.alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns.

    Documents are told apart by id and text, so repeated and null ids are no copies
    by themselves.  In a group null ids come last, and the smallest hash of the text
    decides between equal ids.  Documents that are left out are the smaller set;
    their ids and the hashes of their texts are joined back.
    """
    row = F.struct(F.col(id_column).isNull().alias("no_id"), F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text"))
    named = docs.select(row.alias("_row"), F.col(text_column).alias("_text"))
    found = near_duplicates(named, id_column="_row", text_column="_text", **options)
    out = found.where(F.col("_row") != F.col("component_id")).select(F.col("_row.id").alias("_gone"), F.col("_row.text").alias("_gone_text"))
    gone = checked(out.distinct(), "simhash-gone")
    same = docs[id_column].eqNullSafe(gone["_gone"]) & (F.xxhash64(docs[text_column]) == gone["_gone_text"])
    kept = docs.join(gone, same, "left_anti")
    repeated = docs.groupBy(id_column).count().where("count > 1").limit(1).count()
    return kept.dropDuplicates([id_column, text_column]) if repeated else kept
