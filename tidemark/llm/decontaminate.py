"""Operator 3: benchmark decontamination by winnowing, in DataFrame functions only.

Words are runs of ASCII letters and digits and characters beyond ASCII, A-Z lower-cased. A window is
``window`` consecutive words of a benchmark item; an item of fewer, but not none, is one window of its
own length. For each window length L in use (at most ``window`` of them) both sides keep, of every L
consecutive words, the smallest hash among their k-grams (k = min(5, L)): texts that share L words
share a fingerprint. Documents with a fingerprint in common are then extended: their windows are joined
to the item windows on hash and text, so that a hit is certain.

Items of equal words are one text, and the items that a document hits are told once for each different set of
windows hit, so that a window of many items in many documents is not multiplied out. Item fingerprints and
windows are broadcast only when their bytes are counted to be few; otherwise the joins shuffle on the hash. Null and empty texts have no words and are never hit; an item without words never
hits; items of equal words are handled once and counted each (an item_id that stands twice counts once). Rows are
told apart by (doc_id, hash of the text): repeated rows get equal results, a null doc_id is an id like any other.
Texts of any length are read whole; columns beside those named are not read, and ``drop_contaminated`` gives them
back under any names. Empty tables are fine: without items nothing is hit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C

WINDOW = 13
GRAM = 5
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Most bytes of benchmark windows that are broadcast, as counted; beyond it the same joins shuffle.
BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_words(df: DataFrame) -> DataFrame:
    """A column w of words for a column text."""
    return df.withColumn("w", F.expr(f"filter(split(coalesce(translate(text, '{UPPER}', '{LOWER}'), ''), r'{NOT_WORD}'), x -> x <> '')"))


def _fingerprints(length: int) -> str:
    """Distinct winnowed hashes of the words in w for shared runs of that many words."""
    k = min(GRAM, length)
    span = length - k + 1
    grams = f"transform(sequence(1, size(w) - {k - 1}), i -> xxhash64(slice(w, i, {k})))"
    if span > 1:
        picked = f"transform(sequence(1, size(g) - {span - 1}), i -> array_min(slice(g, i, {span})))"
        grams = f"element_at(transform(array({grams}), g -> array_distinct({picked})), 1)"
    else:
        grams = f"array_distinct({grams})"
    return f"if(size(w) >= {length}, {grams}, array())"


def _windows(length: int) -> str:
    return f"if(size(w) >= {length}, transform(sequence(1, size(w) - {length - 1}), i -> struct(i as at, {length} as len, array_join(slice(w, i, {length}), ' ') as words)), array())"


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, th, n_hit, items (sorted texts of item ids): one row a different hit document."""
    items = with_words(benchmark.select("item_id", "text")).filter("size(w) > 0").select("item_id", F.array_join("w", " ").alias("item"))
    # items of equal words are one text
    items = C.cut(items)
    different = items.select("item").distinct().withColumn("w", F.split("item", " ")).withColumn("len", F.least(F.size("w"), F.lit(window)))
    different = C.cut(different)
    lengths = sorted(r[0] for r in different.select("len").distinct().collect())  # at most window numbers
    prints = windows = None
    for n in lengths:
        own = different.filter(F.col("len") == n)
        p = own.select(F.lit(n).alias("len"), F.explode(F.expr(_fingerprints(n))).alias("print")).distinct()
        v = own.select("item", F.explode(F.expr(_windows(n))).alias("v")).select("item", "v.len", "v.words").distinct()
        prints, windows = (p, v) if prints is None else (prints.unionByName(p), windows.unionByName(v))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    if prints is None:
        return keyed.limit(0).select("doc_id", "th", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    windows = C.cut(windows)
    known = C.cut(windows.select("len", "words").distinct().withColumn("window", F.monotonically_increasing_id()))
    size = known.agg(F.coalesce(F.sum(F.octet_length("words") + 64), F.lit(0))).first()[0]
    small = F.broadcast if size <= BROADCAST_BYTES else (lambda df: df)
    # documents that share a fingerprint
    marks = F.expr("flatten(array(" + ", ".join(f"transform({_fingerprints(n)}, p -> struct({n} as len, p as print))" for n in lengths) + "))")
    shared = with_words(keyed).select("doc_id", "th", F.explode(marks).alias("m")).select("doc_id", "th", "m.len", "m.print")
    shared = C.cut(shared.join(small(prints), ["len", "print"], "left_semi").select("doc_id", "th").distinct())
    suspects = keyed.join(shared, keyed["doc_id"].eqNullSafe(shared["doc_id"]) & (keyed["th"] == shared["th"]), "left_semi")
    suspects = with_words(suspects.dropDuplicates(["doc_id", "th"]))
    # their windows that are windows of items
    spread = F.expr("flatten(array(" + ", ".join(_windows(n) for n in lengths) + "))")
    of_docs = suspects.select("doc_id", "th", F.explode(spread).alias("v")).select("doc_id", "th", "v.at", "v.len", "v.words")
    hit = of_docs.join(small(known), ["len", "words"])
    covered = "size(array_distinct(flatten(transform(spans, x -> sequence(x.at, x.at + x.len - 1)))))"
    found = hit.groupBy("doc_id", "th").agg(F.collect_set(F.struct("at", "len")).alias("spans"), F.sort_array(F.collect_set("window")).alias("windows"))
    found = C.cut(found.select("doc_id", "th", F.expr(covered).cast("long").alias("n_hit"), F.xxhash64("windows", F.size("windows")).alias("set"), "windows"))
    # items are told once for each different set of windows, however many documents have it
    sets = found.groupBy("set").agg(F.first("windows").alias("windows")).select("set", F.explode("windows").alias("window"))
    texts = sets.join(small(known), "window").join(small(windows), ["len", "words"]).select("set", "item").distinct()
    listed = texts.join(items, "item").groupBy("set").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return found.join(listed, "set").select("doc_id", "th", "n_hit", "items")


def _judged(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """doc_id, th, n_words, n_hit, n_items, items_sha256, contaminated: one row a document."""
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long").alias("n_words"))
    found = hits(docs, benchmark, window).withColumnsRenamed({"doc_id": "h_id", "th": "h_th"})
    out = base.join(found, base["doc_id"].eqNullSafe(found["h_id"]) & (base["th"] == found["h_th"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "th", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row a document."""
    return _judged(docs, benchmark, window).drop("th")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    found = _judged(docs, benchmark, window).filter("contaminated")
    gone = found.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__th"]), "left_anti")


ORACLE = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
v as (select distinct item_id, least(len(w), 13) as n, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i : i + least(len(w), 13) - 1], ' '))) as s from b where len(w) > 0),
l as (select distinct n from v),
x as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as i, w from d, l where len(w) >= n),
y as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as s from x),
h as (select y.doc_id, y.n, y.i, v.item_id from y join v on y.s = v.s and y.n = v.n),
p as (select distinct doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, n, i from h)),
c as (select doc_id, count(*) as n_hit from p group by doc_id),
k as (select doc_id, count(distinct item_id) as n_items, sha256(string_agg(distinct item_id::varchar, ',' order by item_id::varchar)) as sha from h group by doc_id)
select d.doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, coalesce(sha, sha256('')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) as contaminated
from d left join c using (doc_id) left join k using (doc_id)
"""
