"""Benchmark decontamination with DataFrame functions only.

Every text is normalised to its words with single spaces, cut into segments of ``SEGMENT`` words
(each with the following ``width - 1`` words as look-ahead, so no window is lost), and each segment
into its windows. Windows meet the hash set of benchmark windows in a broadcast join on a 64-bit
hash and are verified on the window itself. Only hits leave the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH = 10
SEGMENT = 256
MAX_BROADCAST_WINDOWS = 1 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_ANY_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # A-Z kept
_KEY = ("_key_id", "_key_hash", "_key_size")


def normal(text: Column) -> Column:
    """Words of a text, A-Z lower-cased, joined by single spaces; NULL gives an empty string."""
    return F.trim(F.regexp_replace(
        F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BREAK + "+", " "))


def n_words(norm: Column) -> Column:
    return F.when(norm == "", 0).otherwise(
        F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1).cast("long")


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text",
                      width: int = WIDTH) -> DataFrame:
    """Distinct windows (_window, _size, _hash, _items): ``width`` words, or a shorter item whole."""
    norm = benchmark.select(F.col(item).cast("string").alias("_item"),
                            normal(F.col(text)).alias("_norm")).where("_norm <> ''")
    size = F.least(n_words(F.col("_norm")), F.lit(width))
    windows = F.when(size < width, F.array("_norm")).otherwise(
        F.regexp_extract_all("_norm", F.lit(_window_regex(width, width)), F.lit(1)))
    return norm.select("_item", size.alias("_size"), F.explode(windows).alias("_window")).groupBy(
        "_window", "_size").agg(F.collect_set("_item").alias("_items")).withColumn(
        "_hash", F.xxhash64("_window"))


def _window_regex(least: int, most: int) -> str:
    return rf"(?=([^ ]++(?: [^ ]++){{{least - 1},{most - 1}}}))[^ ]++"


def _keyed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Rows with their content key; rows of one key are copies under one id."""
    return docs.withColumns({
        _KEY[0]: F.col(doc).cast("string"), _KEY[1]: F.xxhash64(text),
        _KEY[2]: F.length(text)})


def hits(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text",
         item: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key columns, _at, _size, _items) for every benchmark window at word ``_at`` of a text."""
    windows = benchmark_windows(benchmark, item, item_text, width)
    sizes = windows.groupBy("_size").agg(F.count("*").alias("n")).collect()  # at most width rows
    short = sorted(r["_size"] for r in sizes if r["_size"] < width)
    if sum(r["n"] for r in sizes) <= MAX_BROADCAST_WINDOWS:
        windows = F.broadcast(windows)
    least = min([*short, width]) if sizes else width
    segment = (rf"(?=((?:[^ ]++ ?+){{1,{SEGMENT + width - 1}}}))(?:[^ ]++ ?+){{1,{SEGMENT}}}")
    pieces = _keyed(docs.select(doc, text), doc, text).select(*_KEY, F.posexplode(
        F.regexp_extract_all(normal(F.col(text)), F.lit(segment), F.lit(1))).alias("_n", "_part"))
    found = pieces.select(*_KEY, "_n", F.posexplode(F.regexp_extract_all(
        "_part", F.lit(_window_regex(least, width)), F.lit(1))).alias("_i", "_w"))
    if short:
        # a window of fewer words is the beginning of the words that stand here
        found = found.where(F.col("_i") < SEGMENT)
        own = n_words(F.col("_w"))
        keys = F.array(*[F.when(own >= n, F.struct(
            F.lit(n).cast("long").alias("size"), F.substring_index("_w", " ", n).alias("w")))
            for n in [*short, width]])
        found = found.select(*_KEY, "_n", "_i", F.explode(F.array_compact(keys)).alias("_k")).select(
            *_KEY, "_n", "_i", F.col("_k.w").alias("_w"))
    return found.withColumn("_hash", F.xxhash64("_w")).join(windows, "_hash").where(
        "_w = _window").select(*_KEY, (F.col("_n").cast("long") * SEGMENT + F.col("_i")).alias("_at"),
                               "_size", "_items")


def _per_document(found: DataFrame) -> DataFrame:
    """Hit words, item ids and merged word ranges per key. Ranges that touch stay apart."""
    before = Window.partitionBy(*_KEY).orderBy("_at", "_size").rowsBetween(
        Window.unboundedPreceding, -1)
    end = F.col("_at") + F.col("_size")
    seen = F.coalesce(F.max(end).over(before), F.lit(0))
    return found.select(*_KEY, "_items", F.greatest("_at", seen).alias("_from"), end.alias("_to")).groupBy(
        *_KEY).agg(
        F.sum(F.greatest(F.col("_to") - F.col("_from"), F.lit(0))).alias("_n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("_ids"),
        F.collect_list(F.when(F.col("_to") > F.col("_from"), F.struct("_from", "_to"))).alias(
            "_ranges"))


def _on_key(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    right = right.select(*[F.col(k).alias(f"{k}_r") for k in _KEY],
                         *[c for c in right.columns if c not in _KEY])
    same = [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in _KEY]
    return left.join(right, same, how)


def report(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text",
           item: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs``: doc, n_words, n_hit, n_items, items_sha256, contaminated.

    NULL and empty texts have no words and no hits. Repeated rows get equal results each; rows that
    share an id but not a text are judged apart. Benchmark items without words match nothing, items
    without an id count as hits but are not listed. Other columns of ``docs`` are not read.
    """
    rows = _keyed(docs.select(doc, text), doc, text).select(
        doc, *_KEY, normal(F.col(text)).alias("_norm")).select(
        doc, *_KEY, n_words(F.col("_norm")).alias("n_words"))
    per = _per_document(hits(docs, benchmark, doc, text, item, item_text, width)).drop("_ranges")
    hit = F.coalesce("_n_hit", F.lit(0)).cast("long")
    return _on_key(rows, per, "left").select(
        doc, "n_words", hit.alias("n_hit"),
        F.coalesce(F.size("_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("_ids", ","), F.lit("")), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents",
                  doc: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` without contaminated documents, or with the hit words cut out of their texts.

    ``remove`` is ``documents`` or ``spans``. A cut word goes with the separators that follow it.
    All columns of ``docs`` stay; names that begin with ``_key_`` or equal an internal name raise.
    """
    if clash := {*_KEY, "_ranges", "_n_hit", "_ids"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} clash, rename them")
    per = _per_document(hits(docs, benchmark, doc, text, item, item_text, width))
    rows = _keyed(docs, doc, text)
    if remove == "documents":
        return _on_key(rows, per.select(*_KEY), "left_anti").select(*docs.columns)
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    head = F.regexp_extract(text, rf"(?s)^{_ANY_BREAK}*", 0)
    words = F.regexp_extract_all(
        text, F.lit(rf"(?s)[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]+{_ANY_BREAK}*"), F.lit(0))
    kept = F.filter(words, lambda w, i: ~F.exists(
        F.col("_ranges"), lambda r: (i >= r["_from"]) & (i < r["_to"])))
    cut = F.when(F.col("_ranges").isNull(), F.col(text)).otherwise(
        F.concat(head, F.array_join(kept, "")))
    return _on_key(rows, per.select(*_KEY, "_ranges"), "left").select(
        *[cut.alias(c) if c == text else F.col(c) for c in docs.columns])
