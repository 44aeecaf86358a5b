"""Exact deduplication: group by a 128-bit content hash, compare bytes inside groups, keep the smallest id.

Only DataFrame functions. White space is normalised first: every run of it counts as one space.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, counted, forget, free_name, same, utf8, written

#: Runs of [\x20\x09-\x0D], without those that are a single space and so need no change.
RUNS = r"\x20*+[\x09-\x0D][\x20\x09-\x0D]*+|\x20{2,}+"


#: Rows of a group that are compared with one copy of the keeper's text.
PART_ROWS = 256


def normalised(text: Column) -> Column:
    """The text with every run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " ")


def content_hash(normal: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(utf8(normal)))


def groups(docs: DataFrame, *, digest: Callable[[Column], Column] = content_hash,
           broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest doc_id is kept; a null id only if all ids of the group are null.
    Rows that repeat both id and text count as copies of each other, and one of them is kept. A null text is
    an empty one. Texts that share a hash are compared byte by byte with the text of the group's keeper, and
    those that differ form groups of their own, so a collision of hashes changes nothing. An empty table
    gives no rows.

    Texts are moved only for groups of at least two rows. Their hashes are broadcast if there are at most
    `broadcast_rows` of them; otherwise both sides are shuffled.
    """
    normal = docs.select("doc_id", normalised(F.col("text")).alias("normal"))
    hashed = normal.select(
        "doc_id", digest(F.col("normal")).alias("digest"), F.sha2(utf8(F.col("normal")), 256).alias("text_sha256"), "normal"
    )
    # One pass over the texts for hashes alone.
    rows = written(hashed.drop("normal"), "exact-rows")
    several = written(
        rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1"),
        "exact-groups",
    )
    small = counted(several, broadcast_rows)
    members = written(hashed.join(small, "digest").withColumn("parts", F.ceil(F.col("n") / PART_ROWS)), "exact-members")
    # The keeper's text, once for each part of a group; one text is left before anything is shuffled.
    keeper = members.filter(F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("digest").agg(
        F.min("normal").alias("keeper"), F.min("parts").alias("parts"))
    keeper = keeper.select("digest", "keeper", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    differs = F.when(F.col("normal") != F.col("keeper"), F.col("normal"))
    dealt = members.withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts"))
    compared = dealt.join(keeper, ["digest", "part"]).select("digest", "doc_id", "text_sha256", differs.alias("variant"))
    # Rows that repeat an id are one unit from here on.
    unit = written(
        compared.groupBy("digest", "variant", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("text_sha256").alias("text_sha256")),
        "exact-units",
    )
    forget(members)
    total = unit.groupBy("digest", "variant").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    joined = unit.join(total.withColumnsRenamed({"digest": "of_digest", "variant": "of_variant"}),
                       (F.col("digest") == F.col("of_digest")) & F.col("variant").eqNullSafe(F.col("of_variant")))
    spread = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    grouped = spread.select(
        "doc_id", "keep_id", "group_size",
        ((F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256",
    )
    alone = rows.join(small, "digest", "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    return alone.unionByName(grouped)


def keep_first(docs: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of `docs` that `groups` keeps, with their columns as they are."""
    key, sha = free_name(docs.columns, "key_id"), free_name(docs.columns, "key_sha256")
    marked = groups(docs, broadcast_rows=broadcast_rows).groupBy(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha))
    units = written(marked.agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n")).filter("not stays or n > 1"), "exact-stays")
    keyed = docs.withColumns({key: F.col("doc_id"), sha: F.sha2(utf8(normalised(F.col("text"))), 256)})
    with_copies = counted(units.select(key, sha), broadcast_rows)
    kept = keyed.join(with_copies, same(keyed, with_copies, [key, sha]), "left_anti")
    repeated = units.filter("stays").select(key, sha)
    if repeated.count():  # rows that repeat id and text: one of each
        again = keyed.join(counted(repeated, broadcast_rows), same(keyed, repeated, [key, sha]), "left_semi")
        kept = kept.unionByName(again.dropDuplicates([key, sha]))
    return kept.drop(key, sha)
