"""Keyword topic routing over a text table (T1), as a batch operator.

Score of a topic = number of its keywords present in the lower-cased text as
plain substrings (each keyword counts once, overlapping keywords all count).
The topic is the highest score, ties going to the earlier topic; all-zero is
the fallback topic.  Whole texts are scanned with native ``contains`` — no
tokenising, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions import constants as K
from tillroll.functions.scalar import count_present


def classify_topics(df: DataFrame, text_col: str = "text",
                    topics: dict[str, list[str]] | None = None,
                    fallback: str = K.TOPIC_FALLBACK) -> DataFrame:
    """Add ``score_<topic>`` per topic and ``topic``."""
    topics = topics or K.TOPIC_KEYWORDS
    low = F.lower(F.col(text_col))
    out = df
    names = list(topics)
    for name in names:
        out = out.withColumn(f"score_{name}", count_present(low, topics[name]))
    best = F.greatest(*[F.col(f"score_{n}") for n in names]) if len(names) > 1 \
        else F.col(f"score_{names[0]}")
    topic = F.when(best == 0, F.lit(fallback))
    for name in names:
        topic = topic.when(F.col(f"score_{name}") == best, F.lit(name))
    return out.withColumn("topic", topic)


def topic_counts(classified: DataFrame) -> DataFrame:
    """Rows per topic."""
    return classified.groupBy("topic").agg(F.count("*").alias("n"))


# --- many keywords in one pass -----------------------------------------------------
def keyword_pattern(keywords: Sequence[str]) -> str:
    """A pattern that captures, at every place of a text, the longest keyword that begins there.

    The keywords are factored into a trie, so a place is left at the first letter that no keyword has.
    """
    trie: dict = {}
    for k in keywords:
        node = trie
        for ch in k:
            node = node.setdefault(ch, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        more = [_escaped(ch) + pattern(child) for ch, child in sorted(node.items()) if ch]
        if not more:
            return ""
        return f"(?:{'|'.join(more)})" + ("?" if "" in node else "")
    return f"(?=({pattern(trie)}))"


def _escaped(ch: str) -> str:
    return ch if ch.isalnum() else f"\\x{{{ord(ch):x}}}"


def keywords_present(text: Column, keywords: Sequence[str]) -> Column:
    """The distinct keywords that a text holds, found in one scan of it, whatever their number.

    The scan gives the longest keyword of each place; a keyword that begins another one is
    present wherever that one is, and one inside or across another has a place of its own.
    """
    known = sorted({k for k in keywords if k})
    if not known:
        return F.array().cast("array<string>")
    held = F.create_map(*[x for k in known for x in (
        F.lit(k), F.array(*[F.lit(p) for p in known if k.startswith(p)]))])
    longest = F.array_distinct(F.regexp_extract_all(text, F.lit(keyword_pattern(known)), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(longest, lambda k: F.element_at(held, k))))


def classify_topics_one_pass(df: DataFrame, text_col: str = "text", topics: dict[str, list[str]] | None = None,
                             fallback: str = K.TOPIC_FALLBACK) -> DataFrame:
    """The columns of ``classify_topics`` for keyword tables of any size: one scan of a text finds all its keywords.

    ``classify_topics`` looks for each keyword on its own, which is the faster way up to some hundred
    keywords.  A null text holds no keyword, as there.
    """
    topics = topics or K.TOPIC_KEYWORDS
    found = keywords_present(F.lower(F.coalesce(F.col(text_col), F.lit(""))), [k for ks in topics.values() for k in ks])
    out = df.withColumn("_found", found)
    for name, keywords in topics.items():
        # a keyword that is listed twice counts twice, as it does one by one
        weight = [(k, keywords.count(k)) for k in dict.fromkeys(keywords)]
        out = out.withColumn(f"score_{name}", sum((F.array_contains("_found", k).cast("int") * n for k, n in weight[1:]),
                                                  F.array_contains("_found", weight[0][0]).cast("int") * weight[0][1])
                             if any(n > 1 for _, n in weight) else F.size(F.array_intersect("_found", F.array(*[F.lit(k) for k, _ in weight]))))
    names = list(topics)
    best = F.greatest(*[F.col(f"score_{n}") for n in names]) if len(names) > 1 else F.col(f"score_{names[0]}")
    topic = F.when(best == 0, F.lit(fallback))
    for name in names:
        topic = topic.when(F.col(f"score_{name}") == best, F.lit(name))
    return out.withColumn("topic", topic).drop("_found")
