"""Operator 12: exact duplicates by progressive refinement, with DataFrame functions only.

Texts are equal when they are identical after lower-casing A-Z. Three levels, each reading only what the
one before left open:

1. The number of bytes (lower-casing A-Z keeps it). A text whose length no other has is alone.
2. The hash of the first ``PREFIX`` characters, of texts that share their length.
3. SHA-256 of the whole normalised text, of texts that share length and prefix hash.

Levels 1 and 2 count by key with map-side partial sums, so a group that holds a third of all rows is one
row a task. Texts are never shuffled where the keys left fit ``BROADCAST_BYTES``, as counted beforehand;
beyond it they meet their keys in a join whose skewed parts AQE splits. Groups are summed the same way, and
rows (32 bytes and a digest, without text) are joined back to them.

A null text counts as empty. Of equal texts the row with the largest doc_id stays; a null doc_id is smaller
than any, and of rows with the same doc_id one stays. ``keep_id`` is then null where all ids are. Texts of
any length are hashed whole. Columns beside doc_id and text are not read by ``duplicates`` and given back under
any names by ``deduplicate``. An empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: Characters of a text's beginning that the second level hashes.
PREFIX = 64
#: Bytes of keys that are broadcast at most; a key is counted as 64 bytes.
BROADCAST_BYTES = 64 << 20
KEY_BYTES = 64


def normalised(text: Column) -> Column:
    """The text (null: empty) with A-Z lower-cased, and nothing else changed."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _shared(rows: DataFrame, by: list[str]) -> DataFrame:
    """The keys that several rows share."""
    return C.cut(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*by))


def _marked(rows: DataFrame, keys: DataFrame, by: list[str], most: int) -> DataFrame:
    """rows with ``open``, true where the key is among keys and null elsewhere."""
    keys = keys.withColumn("open", F.lit(True))
    if keys.count() * KEY_BYTES <= most:
        keys = F.broadcast(keys)
    return rows.join(keys, by, "left")


def duplicates(docs: DataFrame, digest: bool = False, most: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept: one row a document; with digest also text_sha256, of all texts.

    Without the digest, texts that are alone by length or prefix are not hashed.
    """
    found = _groups(docs.select("doc_id", "text"), digest, most)
    return found.select("doc_id", "keep_id", "group_size", "kept", *["text_sha256"] * digest)


def _groups(docs: DataFrame, digest: bool, most: int) -> DataFrame:
    """docs without their text, and with keep_id, group_size, kept and text_sha256 (null where not needed)."""
    others = [n for n in docs.columns if n != "text"]
    sized = docs.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)))
    lengths = _shared(sized, ["bytes"])
    begun = F.xxhash64(normalised(F.substring("text", 1, PREFIX)))
    sized = _marked(sized, lengths, ["bytes"], most).withColumn("begins", F.when(F.col("open"), begun)).drop("open")
    prefixes = _shared(sized.filter("begins is not null"), ["bytes", "begins"])
    whole = F.sha2(normalised(F.col("text")), 256)
    hashed = _marked(sized, prefixes, ["bytes", "begins"], most)
    hashed = hashed.withColumn("text_sha256", whole if digest else F.when(F.col("open"), whole))
    # written, so that the number that tells equal rows apart is the same whoever reads it
    rows = C.cut(hashed.select(*others, "open", "text_sha256", F.monotonically_increasing_id().alias("row")))
    some = rows.filter("open")
    groups = some.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("stays"))
    groups = C.cut(groups.filter("group_size > 1"))
    left = some.join(groups, "text_sha256", "left").unionByName(rows.filter("open is null"), allowMissingColumns=True)
    kept = F.col("stays").isNull() | (F.col("row") == F.col("stays.row"))
    keep_id = F.when(F.col("stays").isNull(), F.col("doc_id")).otherwise(F.col("stays.doc_id"))
    return left.select(*others, keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), kept.alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The documents that stay, with all their columns as they were.

    Texts are carried through the last join only here, where they are the result.
    """
    docs, order, own = C.plain_names(docs, ["doc_id", "text"])
    kept = _groups(docs.withColumn("whole", F.col("text")), False, most).filter("kept")
    return kept.select(*[F.col("whole").alias("text") if n == "text" else F.col(n) for n in order]).toDF(*own)


ORACLE = f"""
with d as (select doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as t from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
from d window w as (partition by t)
"""
