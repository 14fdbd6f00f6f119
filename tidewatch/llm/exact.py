"""Exact deduplication by salted combining.

Copies are combined three times, and each time the grouping key holds the whole
normalised text beside its digest, so two texts count as copies only if they are equal:
in the map task (Spark's partial aggregate), per digest and salt, and per digest over
the winners of the salts. A group with a third of all rows is spread over its salts in
both directions: its verdict goes back to the documents by digest and salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import id_text, staged

SALTS = 256


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null counts as empty.

    The pattern skips single spaces, which would be replaced by themselves.
    """
    return F.regexp_replace(
        F.coalesce(text, F.lit("")), "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+", " "
    )


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _groups(keyed: DataFrame, salts: int) -> DataFrame:
    """Digest, whole text, smallest id and size of each group of equal texts."""
    salted = keyed.groupBy("_digest", (F.pmod(F.xxhash64("doc_id"), F.lit(salts))).alias("_salt"), "_text").agg(
        F.min("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_n")
    )
    return salted.groupBy("_digest", "_text").agg(F.min("_keep").alias("_keep"), F.sum("_n").alias("_n"))


def exact_groups(
    docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays; rows without an id stay only if
    all rows of the group have none (keep_id is then null). Of rows repeated with the
    same id and text, one stays. Null text counts as empty; an empty table gives an
    empty result; other columns are not read.

    `digest` only routes texts to groups: if different texts share a digest, their
    documents are told apart by the text in a second pass over just these digests.
    """
    keyed = (
        id_text(docs)
        .select("doc_id", normalised(F.col("text")).alias("_text"))
        .withColumn("_digest", digest(F.col("_text")))
    )
    groups = staged(
        _groups(keyed, salts)
        .groupBy("_digest")
        .agg(F.min("_keep").alias("keep_id"), F.sum("_n").alias("group_size"), F.count(F.lit(1)).alias("_texts")),
        "exact-groups",
    )
    links = staged(
        keyed.select(
            "doc_id",
            "_digest",
            (F.lit(None).cast("string") if digest is sha256 else sha256(F.col("_text"))).alias("_sha"),
            F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("_salt"),
        ).withColumn("_row", F.monotonically_increasing_id()),
        "exact-links",
    )
    if digest is sha256:
        links = links.withColumn("_sha", F.col("_digest"))

    single = groups.filter("_texts = 1")
    verdicts = links.select("_digest", "_salt").distinct().join(single, "_digest")
    found = links.join(verdicts, ["_digest", "_salt"]).select("_row", "doc_id", "keep_id", "group_size", "_sha", "_digest")
    clashing = groups.filter("_texts > 1").select("_digest")
    if not clashing.isEmpty():
        # the digest does not decide here: group by text, and find the group again by its sha256
        apart = _groups(keyed.join(clashing, "_digest", "left_semi"), salts).select(
            sha256(F.col("_text")).alias("_sha"), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size")
        )
        found = found.unionByName(
            links.join(clashing, "_digest", "left_semi")
            .join(apart, "_sha")
            .select("_row", "doc_id", "keep_id", "group_size", "_sha", "_digest")
        )
    first = (
        found.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("_sha")
        .agg(F.min("_row").alias("_row"))
        .select("_row", F.lit(True).alias("kept"))
    )
    return found.join(first, "_row", "left").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce("kept", F.lit(False)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of `docs`, all columns, of which no equal text has a smaller id.

    Rows repeated with the same id and text are combined in the map tasks first.
    """
    kept = exact_groups(docs, salts).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    rows = docs.withColumn("_sha", sha256(normalised(F.col("text").cast("string")))).dropDuplicates(["doc_id", "_sha"])
    return rows.join(
        kept, rows["doc_id"].cast("bigint").eqNullSafe(kept["_id"]) & (rows["_sha"] == kept["_sha"]), "left_semi"
    ).select(*docs.columns)


ORACLE = """
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents),
grouped AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM texts JOIN grouped USING (t)
"""
