"""Text columns: stripping, body assembly, identifiers, tokens and keyword tests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigtide import constants as K

# fixed values: the characters that count as white space at the ends of a text
WHITE_SPACE = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028,
    0x2029, 0x202F, 0x205F, 0x3000)))
TOKEN_BREAK = r"[^\p{L}]+"


def strip_text(text: Column) -> Column:
    """Without white space at either end; reads the ends only, unlike a pattern."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_scorable(stripped: Column) -> Column:
    """Keep text of more than 20 characters (already stripped); NULL is dropped."""
    return F.length(stripped) > K.MIN_SCORABLE_CHARS


def long_enough(body: Column, unit: str = "chars") -> Column:
    """Minimum body length. ``unit='bytes'`` counts UTF-8 bytes instead of characters."""
    size = F.octet_length(body) if unit == "bytes" else F.length(body)
    return size >= K.MIN_BODY_CHARS


def post_body(title: Column, selftext: Column) -> Column:
    """Title alone when the post text is missing or removed, else title, blank line, text."""
    text = F.coalesce(selftext, F.lit(""))
    return F.when(text.isin(*K.REMOVED_BODIES), title).otherwise(
        F.concat(title, F.lit("\n\n"), text))


def record_id(prefix: str, key: Column) -> Column:
    """``<prefix>_`` and the first 16 hex digits of SHA-256 of the key."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(key, 256), 1, 16))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True when any word is a substring (not a whole-word match, by design)."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def count_contained(text: Column, words: Sequence[str]) -> Column:
    """How many of the words occur as substrings."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])


def tokens(text: Column) -> Column:
    """Lower-case letter runs of the whole text, as an array."""
    return F.filter(F.split(F.lower(text), TOKEN_BREAK), lambda t: t != "")


def macro_label(words: Column, topics: dict[str, Sequence[str]] | None = None) -> Column:
    """Label whose keywords occur most often in the joined top words.

    Ties go to the label listed first; no hit gives ``other``.
    """
    topics = topics or K.MACRO_TOPICS
    text = F.lower(words)
    scored = F.array(*[
        F.struct(count_contained(text, keys).alias("hits"), F.lit(-i).alias("order"),
                 F.lit(label).alias("label"))
        for i, (label, keys) in enumerate(topics.items())
    ])
    best = F.array_max(scored)
    return F.when(best["hits"] > 0, best["label"]).otherwise(F.lit(K.TOPIC_OTHER))
