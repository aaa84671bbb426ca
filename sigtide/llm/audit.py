"""Filter interaction audit: what each of five filters removes, in every order of applying them.

Filters A to D depend on a text alone. E fails a row whose text a smaller id holds too. Its test is
exact but moves few texts: a counting Bloom table of all texts (64 cells a word, three cells a text)
is merged from cell counts; a text with a cell that no other text touches is unique and is cleared
on the map side, where the cells counted twice or more are broadcast as dense words of a size bounded
by ``cells.MAX_CELLS``. Only possible repeats are shuffled, grouped by full text after a map-side combine.
With more rows than the bound serves, the table clears fewer texts and the result stays the same.

Rows then become counts by (part, mask of failed filters, labels): at most 128 a part. Everything
reported is a sum over those counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise, permutations
from string import ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sigtide.llm.arrow import extended, map_arrow
from sigtide.llm.cells import MAX_CELLS, bit, cells_of, dense, looked_up, word_of, words_for
from sigtide.llm.words import slices, utf8
from sigtide.session import materialised

FILTERS = "ABCDE"
SALTS = 16


def _marks(chars: str) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[[ord(c) for c in chars]] = 1
    return table


_IS_UPPER, _IS_SIGN = _marks(ascii_uppercase), _marks("#$%&*|")
_IS_CHAR = np.ones(256, np.int64)
_IS_CHAR[0x80:0xC0] = 0  # continuation bytes


def text_masks(texts: pa.Array) -> np.ndarray:
    """Per text the bits 0 to 3: it fails A, B, C, D. NULL counts as empty."""
    data, offsets = utf8(texts)
    raw = data.tobytes()
    n, distinct = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, (start, stop) in enumerate(pairwise(offsets.tolist())):
        found = raw[start:stop].split()  # at 0x20 and 0x09 to 0x0D
        n[i], distinct[i] = len(found), len(set(found))

    def count(table: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(table[data])])[offsets])

    return ((n < 200) | (100 * distinct < 50 * n) << 1
            | (100 * count(_IS_UPPER) > 3 * count(_IS_CHAR)) << 2 | (count(_IS_SIGN) > 0) << 3)


def with_masks(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``mask`` in place of the text."""
    kept = [f for f in rows.schema.fields if f.name != text]
    names = [f.name for f in kept]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(text)):
                part = batch.slice(i, j - i)
                mask = pa.array(text_masks(part.column(text)), pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), mask],
                                                 [*names, "mask"])

    return map_arrow(rows, task, extended(StructType(kept), {"mask": "int"}))


def repeat_cells(hashes: DataFrame, words: int) -> DataFrame:
    """(segment, bits): the cells that two or more rows of ``hashes.h`` touch.

    Counts are combined per task before they are merged. Words nothing repeats in are zero.
    """
    cell = hashes.select(word_of(F.col("h"), words).alias("word"), F.explode(F.array_distinct(
        F.array(*cells_of(F.col("h"))))).alias("cell"))
    return dense(cell.groupBy("word", "cell").count().where("count > 1").select(
        "word", bit(F.col("cell")).alias("bits")), words)


def possible_repeats(rows: DataFrame, cells: DataFrame, words: int) -> DataFrame:
    """The rows whose hash ``h`` touches no cell of its own; the others are unique for certain."""
    return looked_up(rows, F.col("h"), cells, words, "_hit").where("_hit").drop("_hit")


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def failed(docs: DataFrame, doc: str = "doc_id", text: str = "text",
           columns: tuple[str, ...] = ("lang",), max_cells: int = MAX_CELLS) -> DataFrame:
    """Per row of ``docs``: the id, ``columns`` and ``mask``, the bits of the filters A to E it fails.

    NULL texts count as empty, and so equal empty ones. A row without an id is no smaller than any
    other and nothing is smaller than it: it never fails E and makes no other row fail. Rows that
    repeat one id and text do not fail each other. Texts of any length are compared whole. Other
    columns of ``docs`` are not read; an empty table gives no rows.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc).alias("_id"), *[F.col(c).alias(f"_c{k}") for k, c in enumerate(columns)],
                       whole.alias("_text"))
    facts = materialised(with_masks(rows.select(
        "*", F.xxhash64("_text").alias("h"), _key(F.col("_text")).alias("key")), "_text"), "audit-facts")
    words = words_for(facts.count(), max_cells)
    cells = materialised(repeat_cells(facts.select("h"), words), "audit-cells")
    # the full texts decide; their digest only carries the minimum back to rows without texts
    least = possible_repeats(rows.where("_id is not null").select(
        "_id", "_text", F.xxhash64("_text").alias("h")), cells, words).groupBy("_text").agg(
        F.min("_id").alias("least"), F.max("_id").alias("most")).where("least < most").select(
        _key(F.col("_text")).alias("key"), "least")
    salted = materialised(least, "audit-least").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    late = facts.withColumn("salt", F.pmod(F.hash("_id"), F.lit(SALTS))).join(
        salted, ["key", "salt"], "left")
    return late.select(
        F.col("_id").alias(doc), *[F.col(f"_c{k}").alias(c) for k, c in enumerate(columns)],
        (F.col("mask") + F.when(F.col("_id") > F.col("least"), 16).otherwise(0)).alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame, lang: str = "lang", doc: str = "doc_id",
                text: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """(part, mask, n, good, toxic): rows by ``lang`` (NULL: empty) and by the filters they fail.

    ``good`` counts rows that ``labels`` marks quality = 1, ``toxic`` those with toxic = 1. An id with
    several labels is good, or toxic, if any of them says so; NULL labels and ids say nothing.
    """
    marks = labels.where(F.col(doc).isNotNull()).groupBy(F.col(doc).alias("_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = failed(docs, doc, text, (lang,), max_cells).select(
        F.col(doc).alias("_id"), F.coalesce(F.col(lang), F.lit("")).alias("part"), "mask")
    return materialised(rows.join(marks, "_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).cast("long").alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0))).cast("long").alias("toxic")), "audit-counts")


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, and shapley (the filter's removed, summed over all orders).

    ``counts`` is bounded by parts times masks; what depends on a filter and the set before it is
    summed once, then named for every order.
    """
    sets = [(f, before) for f in range(len(filters)) for before in range(1 << len(filters))
            if not before >> f & 1]
    weight = [1] * (len(filters) + 1)  # factorials
    for k in range(1, len(weight)):
        weight[k] = k * weight[k - 1]

    def orders_of(before: int) -> int:
        size = before.bit_count()
        return weight[size] * weight[len(filters) - 1 - size]

    choice = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(b).alias("before"),
                                          F.lit(orders_of(b)).alias("orders")) for f, b in sets]))
    mask, own = F.col("mask"), bit(F.col("c.f")).cast("int")
    now, earlier = mask.bitwiseAND(own) != 0, mask.bitwiseAND(F.col("c.before")) != 0

    def total(which: Column, what: str = "n") -> Column:
        return F.sum(F.when(which, F.col(what)).otherwise(0))

    sums = counts.withColumn("c", choice).groupBy("part", "c.f", "c.before", "c.orders").agg(
        total(~now & ~earlier).alias("kept"), total(now & ~earlier).alias("removed"),
        total(now & earlier).alias("redundant"), total(mask == own).alias("unique_fails"),
        total(now & ~earlier, "good").alias("good_lost"),
        total(now & ~earlier, "toxic").alias("toxic_lost"))
    shapley = sums.groupBy("part", "f").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    steps = [("".join(order), k + 1, filters.index(x), sum(1 << filters.index(y) for y in order[:k]))
             for order in permutations(filters) for k, x in enumerate(order)]
    orders = counts.sparkSession.createDataFrame(
        steps, "filter_order string, step int, f int, before int")
    return sums.join(F.broadcast(orders), ["f", "before"]).join(shapley, ["part", "f"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
        "good_lost", "toxic_lost", "shapley")
