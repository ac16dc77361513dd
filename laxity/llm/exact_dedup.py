"""Exact de-duplication by two passes over a Bloom filter; DataFrame operations only.

Pass one counts the rows on each slot of a bit array of 2 ** b slots, each row setting two slots, and keeps as
the filter the slots that two or more rows set. Pass two tests every row: one of whose slots is not in the filter
is certainly unique and passes straight through; only the others shuffle and are grouped exactly, by SHA-256.
The filter is dense, 2 to 4 bytes a row at most, and broadcast up to FILTER_BLOCKS; beyond it the lookups shuffle every row.

Defined results: a null text counts as empty; all empty texts are equal to each other. Of equal texts the row with the most
code points in the original text stays, then the smallest doc_id (a null doc_id comes last); of rows equal in
these too exactly one stays, and which is not defined. An empty table gives an empty result. Other columns are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, packed, stored, table

SPACE = r"[\x20\x09-\x0D]"
SLOTS_PER_ROW = 16
#: Blocks of the filter, of 512 bytes, that are broadcast: 64 MB of bits, enough for any table of 33 million rows.
FILTER_BLOCKS = 1 << 17


def digest(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, ""), 256)


def _bits(rows: int) -> int:
    """log2 of the slots: at least SLOTS_PER_ROW for each row, from 2 ** 10 to 2 ** 40."""
    return min(40, max(10, (max(rows, 1) * SLOTS_PER_ROW - 1).bit_length()))


def _slots(key: str, bits: int) -> list[Column]:
    mask = F.lit((1 << bits) - 1).cast("long")
    return [F.xxhash64(F.lit(seed), F.col(key)).bitwiseAND(mask) for seed in (1, 2)]


def repeat_filter(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """Pass one: (block, words), 64 dense words of 64 slots each, with the bits of the slots that at least two rows set; 2 ** (bits - 12) blocks at most."""
    slots = keys.select(F.explode(F.array_distinct(F.array(*_slots(key, bits)))).alias("slot"))
    repeated = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    words = repeated.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("mask"))
    blocks = words.groupBy(F.shiftright("word", 6).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct(F.expr("cast(word & 63 as int)"), "mask"))).alias("held"))
    return blocks.select("block", F.expr("transform(sequence(0, 63), i -> coalesce(try_element_at(held, i), 0L))").alias("words"))


def maybe_repeated(rows: DataFrame, key: str, bits: int, found: DataFrame, blocks: int, most: int) -> DataFrame:
    """Pass two: rows with a boolean column _maybe, false only for rows whose key no other row has. A filter of up to `most` blocks is broadcast."""
    held, out = [], rows
    for i, slot in enumerate(_slots(key, bits)):
        side = found.select(F.col("block").alias(f"_b{i}"), F.col("words").alias(f"_w{i}"))
        out = out.withColumn(f"_s{i}", slot)
        out = out.join(broadcast_if_small(side, blocks, most), F.shiftright(F.col(f"_s{i}"), 12) == F.col(f"_b{i}"), "left")
        held.append(F.coalesce(F.expr(f"(shiftright(element_at(_w{i}, cast(shiftright(_s{i}, 6) & 63 as int) + 1), cast(_s{i} & 63 as int)) & 1) = 1"), F.lit(False)))
    return out.withColumn("_maybe", held[0] & held[1]).drop(*[f"_{x}{i}" for i in (0, 1) for x in "wbs"])


def _order() -> Column:
    return F.struct((-F.col("n")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"))


def exact_groups(docs: DataFrame, most: int = FILTER_BLOCKS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = stored(docs.select("doc_id", digest(F.col("text")).alias("text_sha256"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n")), "keys")
    bits = _bits(keys.count())
    found = stored(repeat_filter(keys, "text_sha256", bits), "filter")
    flagged = maybe_repeated(keys, "text_sha256", bits, found, found.count(), most)
    alone = flagged.where(~F.col("_maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    rows = flagged.where("_maybe").groupBy("text_sha256", "doc_id", "n").agg(F.count(F.lit(1)).alias("copies"))
    # A table of its own, one row a text: the join then has an exchange on both sides, so that a hot text's rows are split.
    groups = stored(rows.groupBy(F.col("text_sha256").alias("sha")).agg(F.min(_order()).alias("best"), F.sum("copies").alias("group_size")), "groups")
    first = (F.col("n") == -F.col("best.a")) & F.col("doc_id").eqNullSafe(F.col("best.c"))
    grouped = (
        rows.join(groups, F.col("text_sha256") == F.col("sha"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .select("doc_id", F.col("best.c").alias("keep_id"), "group_size", (first & (F.col("copy") == 1)).alias("kept"), "text_sha256")
    )
    return alone.unionByName(grouped)


def drop_exact(docs: DataFrame, most: int = FILTER_BLOCKS) -> DataFrame:
    """docs with all their columns, without the rows that exact_groups() would not keep."""
    sha = digest(F.col("text"))
    keys = stored(docs.select(sha.alias("_sha")), "keys")
    bits = _bits(keys.count())
    found = stored(repeat_filter(keys, "_sha", bits), "filter")
    flagged = maybe_repeated(packed(docs, sha).select("_row", F.col("_key").alias("_sha")), "_sha", bits, found, found.count(), most)
    alone = flagged.where(~F.col("_maybe")).select("_row")
    n = F.length(F.coalesce("_row.text", F.lit("")))
    order = F.struct((-n).alias("a"), F.col("_row.doc_id").isNull().alias("b"), F.col("_row.doc_id").alias("c"))
    best = flagged.where("_maybe").groupBy("_sha").agg(F.min_by("_row", order).alias("_row")).select("_row")
    return alone.unionByName(best).select("_row.*")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT doc_id, length(t) AS n, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM d)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM k WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""
