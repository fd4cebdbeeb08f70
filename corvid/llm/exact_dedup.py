"""Exact dedup by progressive refinement, with DataFrame functions only.

1. Rows are grouped by the length of their text without white space, which needs no normalised text.
   Lengths of a single row are done.
2. Rows of the other lengths are grouped by length and a hash of the normalised text's first ``PREFIX``
   characters, for which only the head of the text is normalised.
3. Rows of groups that still hold more than one are grouped by the digest of the whole normalised
   text, which is computed for those rows alone (``digest_all`` gives it for the others too).

The surviving lengths and (length, prefix) keys, the groups of equal texts and the ids to be dropped
are written and counted, and broadcast if they are few, so that texts stay where they are read; if
they are many, Spark joins them by a shuffle. No group is collected: groups are aggregates that
combine before the shuffle, and rows meet their group by an equi-join that Spark may split.

Texts are equal when identical after replacing each ``[\\x20\\x09-\\x0D]+`` by one space; null
counts as empty. Of equal texts the row with the smallest id stays; null ids come last. Of rows
that share both id and text one stays (which, they being copies, cannot be told). Rows that share an
id but not the text are told by their text. An empty table gives an empty result, very long texts are
read whole, and the columns of a table may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm.shared import sized, written

PREFIX = 128
#: Characters of a text that are looked at for its prefix; more only where they are nearly all white space.
HEAD = 4 * PREFIX


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def solid_length(text: Column) -> Column:
    """Bytes that are not white space; the same for equal texts."""
    t = F.coalesce(text, F.lit(""))
    for c in " \n\t\r\x0b\x0c":
        t = F.replace(t, F.lit(c), F.lit(""))
    return F.octet_length(t)


def _prefix(text: Column) -> Column:
    head = normalised(F.substring(text, 1, HEAD))
    return F.xxhash64(F.substring(F.when(F.length(head) > PREFIX, head).otherwise(normalised(text)), 1, PREFIX))


def surviving(docs: DataFrame) -> DataFrame:
    """pre of the (length, prefix) groups of docs (id, text) with more than one row; the same prefix at another length, which costs a digest more, is rare."""
    rows = docs.select("text", solid_length(F.col("text")).alias("len"))
    lengths = rows.groupBy("len").agg(F.count("*").alias("c")).where("c > 1").select("len")
    rows = rows.join(sized(written(lengths, "exact-lengths"), 16), "len", "left_semi")
    both = rows.select("len", _prefix(F.col("text")).alias("pre")).groupBy("len", "pre").agg(F.count("*").alias("c"))
    return sized(written(both.where("c > 1").select("pre", F.lit(True).alias("more")).distinct(), "exact-keys"), 48)


def _digested(docs: DataFrame, keys: DataFrame, digest_all: bool) -> DataFrame:
    """id, more (whether the row survives) and digest, which is null for the other rows unless ``digest_all``."""
    rows = docs.select("id", "text", _prefix(F.col("text")).alias("pre")).join(keys, "pre", "left")
    full = F.unhex(F.sha2(normalised(F.col("text")), 256))
    more = F.coalesce("more", F.lit(False))
    return rows.select("id", more.alias("more"), (full if digest_all else F.when(more, full)).alias("digest"))


def _groups(rows: DataFrame) -> DataFrame:
    """digest, keep_id, group_size, at_keep (rows with the kept id) of every text that stands in more than one row."""
    full = rows.where("more").groupBy("digest", "id").agg(F.count("*").alias("c"))
    order = F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("i"))
    found = full.groupBy("digest").agg(F.min("id").alias("keep_id"), F.sum("c").alias("group_size"), F.min_by("c", order).alias("at_keep"))
    return sized(written(found.where("group_size > 1"), "exact-groups"), 128)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, digest (of the normalised text; null where it was not needed, unless ``digest_all``)."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    rows = written(_digested(docs, surviving(docs), digest_all), "exact-digests")
    out = rows.join(_groups(rows), "digest", "left")
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    out = out.select("id", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), size.alias("group_size"), F.coalesce("at_keep", F.lit(1)).alias("one"), "digest")
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    # Rows that share id and text are counted, and written out again with the first one kept.
    single = out.where(~kept | (F.col("one") == 1)).select("id", "keep_id", "group_size", kept.alias("kept"), "digest")
    again = out.where(kept & (F.col("one") > 1)).groupBy("id", "keep_id", "group_size", "digest").agg(F.count("*").alias("c"))
    again = again.select("id", "keep_id", "group_size", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))).alias("k"), "digest")
    both = single.unionByName(again.select("id", "keep_id", "group_size", (F.col("k") == 1).alias("kept"), "digest"))
    return both.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "digest")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the copies, with its own columns. Rows go by their id, so that texts are not moved; rows without an id, or with one that others have too, go by their digest."""
    cols = docs.columns
    id_col, text = (f"c{cols.index(x)}" for x in (id_col, text))
    docs = docs.toDF(*[f"c{k}" for k in range(len(cols))])  # whatever the columns are named
    own = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    rows = written(_digested(own, surviving(own), False).where("more"), "exact-digests")
    found = _groups(rows)
    copies = rows.join(found, "digest").where("id != keep_id").select("id")
    again = written(own.where("id is not null").groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id"), "exact-again")
    leave = sized(written(copies.unionByName(again).distinct(), "exact-gone"), 48).withColumnRenamed("id", id_col)
    kept = docs.where(F.col(id_col).isNotNull()).join(leave, id_col, "left_anti").select(*docs.columns)
    rest = docs.where(F.col(id_col).isNull()).unionByName(docs.join(sized(again, 48).withColumnRenamed("id", id_col), id_col, "left_semi").select(*docs.columns))
    rest = rest.withColumn("digest", F.unhex(F.sha2(normalised(F.col(text)), 256))).join(found, "digest", "left")
    rest = rest.where(F.col("at_keep").isNull() | F.col(id_col).eqNullSafe(F.col("keep_id")))
    single, several = rest.where(F.coalesce("at_keep", F.lit(1)) == 1), rest.where("at_keep > 1").dropDuplicates(["digest"])
    return kept.unionByName(single.select(*docs.columns)).unionByName(several.select(*docs.columns)).toDF(*cols)
