"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

A text is normalised by deleting every character of ``[\\x20\\x09-\\x0D]`` and cut after the first
character of ``CUTS`` that follows ``LEAST`` characters (after ``MOST`` at the latest), so that the cuts
depend on content alone. Chunks are deduplicated by SHA-256 to identifiers, each verified: the least and
the greatest chunk of a digest must be the same text. Should two differ, the documents that hold such a
chunk, and only those, have texts for identifiers. Documents are then compared by their ordered lists of
identifiers. A text crosses the network once, as chunks that are combined before the shuffle; whole
documents never do, and lists only where another may equal them.

Null counts as empty; all texts that are empty once normalised are equal and have an empty list.
Rows with the same doc_id are documents of their own; a null doc_id is the smallest. Of equal
texts the one with the most code points as given stays, then the smallest doc_id; of rows alike in that,
one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import flagged, key_filter
from .store import materialize

#: Least and most characters of a chunk.
LEAST, MOST = 1024, 4096
#: A chunk ends with punctuation, with one of a few rare Latin letters, or with one of some frequent letters
#: of scripts that use little punctuation.
CUTS = "\\p{P}qxzjQXZJ的在のと는의"
_CHUNK = f"(?s).{{{LEAST},{MOST - 1}}}?[{CUTS}]|.{{1,{MOST}}}"
_SPACES = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _SPACES, "")


def pieces(norm: Column) -> Column:
    """The chunks of a normalised text, in order; none of an empty one."""
    return F.regexp_extract_all(norm, F.lit(_CHUNK), F.lit(0))


def clashing(docs: DataFrame) -> DataFrame:
    """The SHA-256 digests that stand for two different chunks; each digest's least and greatest chunk are
    compared as text."""
    chunk_rows = docs.select(F.explode(pieces(normalised(F.col("text")))).alias("chunk")).select("chunk", F.unhex(F.sha2("chunk", 256)).alias("digest"))
    return chunk_rows.groupBy("digest").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).filter("lo <> hi").select("digest")


def recipes(docs: DataFrame, by_text: bool = False) -> DataFrame:
    """doc_id, n_points, text_sha256 and the recipe: the chunks' identifiers in order (their texts
    if ``by_text``)."""
    norm = docs.select(F.col("doc_id").cast("long"), F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("n_points"), normalised(F.col("text")).alias("norm"))
    named = F.transform(pieces(F.col("norm")), lambda c: c.cast("binary") if by_text else F.unhex(F.sha2(c, 256)))
    return norm.select("doc_id", "n_points", F.sha2("norm", 256).alias("text_sha256"), named.alias("recipe"))


def identified(docs: DataFrame) -> DataFrame:
    """Rows of ``recipes`` with a number for each row of ``docs``; texts are identifiers in documents with a
    clashing digest."""
    rows = recipes(docs)
    clashes = materialize(clashing(docs), "clashes")
    if not clashes.isEmpty():
        both = recipes(docs, True).withColumn("digests", F.transform("recipe", lambda c: F.unhex(F.sha2(c, 256)))).withColumn("row", F.monotonically_increasing_id())
        both = materialize(both, "recipes_by_text")
        hit = both.select("row", F.explode("digests").alias("digest")).join(clashes, "digest", "left_semi").select("row").distinct().withColumn("hit", F.lit(True))
        rows = both.join(hit, "row", "left").select("doc_id", "n_points", "text_sha256", F.when(F.col("hit"), F.col("recipe")).otherwise(F.col("digests")).alias("recipe"))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "recipes")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``, one kept in each group."""
    rows = identified(docs)
    best = F.min(F.struct((-F.col("n_points")).alias("n"), "doc_id", "row"))
    groups = materialize(rows.groupBy("recipe").agg(F.count("*").alias("group_size"), best.alias("best")).filter("group_size > 1"), "groups")
    told = flagged(rows, "recipe", key_filter(groups, "recipe"))
    alone = told.filter("not __maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    joined = told.filter("__maybe").join(groups, "recipe", "left")
    keep = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    looked = joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), (F.col("row") == F.coalesce("best.row", "row")).alias("kept"), "text_sha256")
    return alone.unionByName(looked)
