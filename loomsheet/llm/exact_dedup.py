"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary (``DataFrame.stat.freqItems``) names the digests that may be frequent. Their exact group rows are
counted, the ones that really are frequent (the verified winners, at most ``1 / support`` of them) are broadcast and
resolve their copies on the map side; the remaining digests, none of which is frequent any more, go through an ordinary
shuffle.

Defined cases: a null text counts as the empty text; texts are equal when identical after lower-casing A-Z only; of equal
texts the largest doc_id stays (a null doc_id stays only in a group without any other id); rows that repeat both doc_id and
text are one document written twice, count towards ``group_size`` each and share ``kept``; an empty table gives an empty
result; further columns are ignored, or passed through by :func:`drop_copies`.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsheet.llm.store import stored

#: Misra-Gries counters are 1 / SUPPORT: the bound on what is broadcast.
SUPPORT = 0.001


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. A text of one byte a character holds no other letters, so the fast ``lower`` does for it."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(ascii_lower(text), F.lit("")).cast("binary"), 256))


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )


def resolve(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(doc_id, digest) to (doc_id, digest, keep_id, group_size, kept), one row for each row."""
    least = max(2.0, support * digests.count())
    named = digests.select(F.hex("digest").alias("name")).stat.freqItems(["name"], support)
    candidates = named.select(F.explode("name_freqItems").alias("name")).select(
        F.unhex("name").alias("digest")
    )
    frequent = digests.join(F.broadcast(candidates), "digest", "left_semi")
    winners = stored(_groups(frequent).where(F.col("group_size") >= least), "heavy-digests")
    hot = digests.join(F.broadcast(winners), "digest")
    rest = digests.join(F.broadcast(winners), "digest", "left_anti")
    both = hot.unionByName(rest.join(_groups(rest), "digest"))
    return both.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def digest_table(docs: DataFrame) -> DataFrame:
    """The one pass over the texts; what follows moves 40 bytes a document."""
    return stored(docs.select("doc_id", text_digest(F.col("text")).alias("digest")), "digests")


def exact_dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return resolve(digest_table(docs), support).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def without(docs: DataFrame, keys: dict[str, Column], losers: DataFrame, twice: DataFrame) -> DataFrame:
    """docs without the rows whose keys are among the losers, and one row each of those that stand there twice.

    The joins are merges at every size: a table of losers grows with the documents, so it is never broadcast.
    """
    names = list(keys)
    own = docs.withColumns(keys)

    def meets(table: DataFrame) -> tuple[DataFrame, Column]:
        side = table.select(*(F.col(c).alias(f"{c}_of") for c in names)).hint("merge")
        same = F.lit(True)
        for c in names:
            same = same & F.col(c).eqNullSafe(F.col(f"{c}_of"))
        return side, same

    kept = own.join(*meets(losers), "left_anti")
    if twice.head(1):
        one = kept.join(*meets(twice), "left_semi").dropDuplicates(names)
        kept = kept.join(*meets(twice), "left_anti").unionByName(one)
    return kept.drop(*names)


def drop_copies(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """docs without the copies."""
    rows = stored(resolve(digest_table(docs), support), "resolved")
    names = (F.col("digest").alias("__ls_digest"), F.col("doc_id").alias("__ls_id"))
    losers = stored(rows.where("not kept").select(*names).distinct(), "exact-losers")
    twice = rows.where("kept and group_size > 1").groupBy(*names).count().where("count > 1")
    keys = {"__ls_digest": text_digest(F.col("text")), "__ls_id": F.col("doc_id")}
    return without(docs, keys, losers, stored(twice, "exact-twice"))
