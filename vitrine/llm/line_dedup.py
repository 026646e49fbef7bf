"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct words (A-Z lowered). Lines with equal token sets are one class, first at its first line
in the order of (doc_id, text hash, line number). Classes link at a Jaccard similarity of at least THRESHOLD; setjoin
finds the links by prefix, length and position filters over tokens in order of rarity, and verifies them exactly. A line
is removed if an earlier line has its class or a class that links to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, only, prepare, restored
from .setjoin import broadcast_frequencies, candidate_groups, scan_units, verified_counts

THRESHOLD = 0.8


def class_links(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(lines, classes): lines (doc_id, th, line, key) and classes (key, first, links, earlier)."""
    prepare(docs.sparkSession)
    rows = only(docs, "doc_id", "text").where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    lines, tiles, bits = scan_units(rows)
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th", "line")
    classes = cut(lines.groupBy("key").agg(F.min(place).alias("first")))
    groups = candidate_groups(rows, broadcast_frequencies(rows, tiles, bits), threshold).withColumnRenamed("key", "k")
    groups = groups.join(classes.hint("shuffle_hash"), F.col("key") == F.col("k")).select(
        "token", "part", "block", "key", "tokens", "first.doc_id", "first.th", "first.line")
    linked = cut(verified_counts(groups, threshold)).withColumnRenamed("key", "k")
    classes = classes.join(linked, F.col("key") == F.col("k"), "left").select(
        "key", "first", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("earlier", F.lit(False)).alias("earlier")
    )
    return lines, classes


def line_decisions(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, th, line, class_doc, class_line, links, removed) for every non-blank line."""
    lines, classes = class_links(docs, threshold)
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th", "line")
    return lines.join(classes, "key").select(
        "doc_id", "th", "line", F.col("first.doc_id").alias("class_doc"), F.col("first.line").alias("class_line"), "links",
        (F.col("earlier") | (place != F.col("first"))).alias("removed"),
    )


def line_links(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents (doc_id, text, ...) -> doc_id, class_id, n_links, n_lines, n_removed, lines.

    One row for each distinct (doc_id, text); identical rows are one document. `lines` has, for every non-blank line in
    order, its number (from 0, blank lines counted), its class (doc_id and number of the class's first line), the number
    of other classes that link to its class, and whether it is removed. class_id is the least doc_id among its lines'
    classes, n_links the sum of its lines' links. Null, empty and blank texts have no lines: counts of 0 and a class_id
    of their own doc_id. Rows with a null doc_id come last in order. An empty table gives an empty result.
    """
    base = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th")).distinct().toDF("d", "h")
    each = line_decisions(docs, threshold).groupBy("doc_id", "th").agg(
        F.min("class_doc").alias("c"), F.sum("links").alias("n_links"), F.count("*").alias("n_lines"),
        F.sum(F.col("removed").cast("long")).alias("n_removed"),
        F.sort_array(F.collect_list(F.struct("line", "class_doc", "class_line", "links", "removed"))).alias("lines"),
    )
    out = base.join(each, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(F.col("d").alias("doc_id"), F.coalesce("c", "d").alias("class_id"), zero("n_links"), zero("n_lines"), zero("n_removed"), "lines")


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with their removed lines taken out of the text; blank lines, line order and all columns stay."""
    gone = line_decisions(docs, threshold).where("removed").groupBy("doc_id", "th").agg(F.collect_set("line").alias("gone"))
    plain, at = numbered(docs)
    doc_id, text = F.col(at["doc_id"]).cast("long"), F.col(at["text"])
    joined = plain.join(gone, doc_id.eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("th")), "left")
    kept = F.filter(
        F.transform(F.split(text, "\n", -1), lambda x, i: F.when(~F.coalesce(F.array_contains("gone", i), F.lit(False)), x)),
        lambda x: x.isNotNull(),
    )
    new = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    return restored(joined.withColumn(at["text"].strip("`"), new), docs)
