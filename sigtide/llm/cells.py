"""Dense tables of bits over 64-bit hashes: three cells in one word of 64, as rows of whole segments.

A table is broadcast and looked up on the map side, so only rows that may hold a key are shuffled. Its
size is bounded by ``MAX_CELLS``; with more keys than that serves it lets more rows pass, never fewer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtide.session import materialised

CELLS_PER_KEY = 16
MAX_CELLS = 1 << 29  # 64 MB of bits
SEGMENT = 1024  # words of 64 cells in one row of a table


def words_for(keys: int, max_cells: int = MAX_CELLS) -> int:
    """Words of a table for so many keys, a power of two."""
    return max(SEGMENT, min(max_cells, 1 << (keys * CELLS_PER_KEY).bit_length()) // 64)


def cells_of(h: Column) -> list[Column]:
    """Three cells in a word of 64."""
    return [F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(3)]


def word_of(h: Column, words: int) -> Column:
    return F.shiftrightunsigned(h, 18).bitwiseAND(F.lit(words - 1))


def bit(cell: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), cell)


def mask_of(h: Column) -> Column:
    mask = F.lit(0).cast("long")
    for c in cells_of(h):
        mask = mask.bitwiseOR(bit(c))
    return mask


def dense(bits: DataFrame, words: int) -> DataFrame:
    """(segment, bits) from (word, bits): ``SEGMENT`` words a row, OR-merged, missing ones zero."""
    grid = bits.sparkSession.range(words).select(
        F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    return bits.unionByName(grid).groupBy("word").agg(F.bit_or("bits").alias("bits")).groupBy(
        F.expr(f"word div {SEGMENT}").alias("segment")).agg(F.transform(
            F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits"))


def looked_up(rows: DataFrame, h: Column, table: DataFrame, words: int, hit: str) -> DataFrame:
    """``rows`` with the boolean ``hit``: all cells of the hash are set. Nothing is shuffled."""
    word, mask = word_of(h, words), mask_of(h)
    return rows.withColumns({"_word": word, "_mask": mask}).withColumn(
        "_segment", F.expr(f"_word div {SEGMENT}")).join(F.broadcast(
            table.select(F.col("segment").alias("_segment"), F.col("bits").alias("_bits"))), "_segment").withColumn(
        hit, F.get("_bits", (F.col("_word") % SEGMENT).cast("int")).bitwiseAND(F.col("_mask")) == F.col("_mask")
    ).drop("_segment", "_word", "_mask", "_bits")


class KeyFilter:
    """Which rows may have a key of a table: a Bloom filter that is broadcast."""

    def __init__(self, keys: DataFrame, h: Column, max_cells: int = MAX_CELLS) -> None:
        hashes = materialised(keys.select(h.alias("h")), "filter-keys")
        self.words = words_for(hashes.count(), max_cells)
        self.table = materialised(dense(hashes.select(
            word_of(F.col("h"), self.words).alias("word"), mask_of(F.col("h")).alias("bits")), self.words),
            "filter")

    def split(self, rows: DataFrame, h: Column) -> tuple[DataFrame, DataFrame]:
        """(rows that may have a key, rows that have none for certain)."""
        marked = looked_up(rows, h, self.table, self.words, "_hit")
        return marked.where("_hit").drop("_hit"), marked.where("not _hit").drop("_hit")
