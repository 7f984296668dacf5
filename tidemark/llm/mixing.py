"""Operator 1: mix sources to target weights by systematic sampling.

A document's size is its number of runs of non-space characters (null: 0). Sources, by code point and
null last, get the weights in turn; targets share the total size by weight, but none is above
``cap`` times its source's size, the excess being reshared by weight. Within a source, documents stand
in size classes; the expected copies (target / size, the same for each document of the source) are
prefix-summed in that order, one random offset is added, and a document is emitted once for each
integer boundary that its interval crosses. The offset is random in the source's name and the seed, so that
reruns agree. As documents stand by size, the words taken differ from the target by about the size of the
largest document at most, and cap bounds the copies of each document.

The prefix sum never brings a source into one task: rows are counted by (source, size class, salt) with
map-side partial sums, the bounded tables of counts are prefix-summed level by level, and rows are ranked
only inside their salt. Sources, whatever their number, are summed by sorted ranges. Texts are read once.
Null texts and empty ones have size 0 and are ranked like others (their copies
hold no words); very long ones have large size classes; a null source is a source of its own; repeated rows
are separate documents, ties in doc_id and size any order among them; columns of clashing names are kept as
they are by ``mix``; an empty table gives an empty result. A source of size 0 has target 0 and no copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import common as C

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "tidemark-mix-1"
#: Offsets are multiples of 2**-20, so that adding them to whole numbers is exact.
STEPS = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"

#: Size class: exact below 64, then 64 classes an octave.
CLASS = "case when size < 64 then size else (length(bin(size)) - 6) * 64 + shiftright(size, length(bin(size)) - 7) end"


def targets(sized: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """(source, source_size, target, per_doc, shift): one row a source.

    The level that no target passes is found in closed form: by rising capacity per weight, the sources
    up to some place are full and the rest share what remains by weight.
    """
    listed = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("none", F.col("source").isNull())
    listed = C.sums_before(listed, ["none", "source"], place=F.lit(1))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    listed = listed.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * cap).withColumn("level", F.col("most") / F.col("weight"))
    listed = C.sums_before(listed, ["level", "place"], full_before=F.col("most"), weight_before=F.col("weight"))
    total, weighed = listed.agg(F.sum("source_size"), F.sum("weight")).first()
    # full, if it can't hold its share of what those before it leave
    full = F.col("most") * (F.lit(weighed or 0) - F.col("weight_before")) <= (F.lit(total or 0) - F.col("full_before")) * F.col("weight")
    listed = C.cut(listed.withColumn("full", full))
    held, open_weight = listed.agg(F.sum(F.when(F.col("full"), F.col("most"))), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
    listed = listed.withColumn("rest", F.lit((total or 0) - (held or 0)).cast("long")).withColumn("open", F.lit(open_weight or 0).cast("long"))
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise((F.col("rest") * F.col("weight")).cast("double") / F.col("open"))
    shift = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce("source", F.lit("")))), 1, 5), 16, 10).cast("double") / STEPS
    return listed.select(
        "source", "source_size", target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("per_doc"), shift.alias("shift"),
    )


def _size_and_salt() -> tuple[Column, Column]:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return size, F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), "text", F.lit(""))), 1, 2)


def mix_plan(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken."""
    size, salt = _size_and_salt()
    # texts are read once, for their sizes; what follows reads this small table
    return _plan(C.cut(docs.select("doc_id", "source", size.alias("size"), salt.alias("salt"))), weights, cap, seed)


def _plan(sized: DataFrame, weights, cap: int, seed: str, row: tuple[str, ...] = ()) -> DataFrame:
    """The plan of a table of (doc_id, source, size, salt), with a column that tells rows if there is one."""
    sized = sized.withColumn("class", F.expr(CLASS))
    counts = sized.groupBy("source", "class", "salt").agg(F.count(F.lit(1)).alias("n"))
    # counts of the rows before a salt inside its class, and before a class inside its source
    in_class = Window.partitionBy("source", "class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    in_source = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = counts.groupBy("source", "class").agg(F.sum("n").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(in_source), F.lit(0)))
    salts = counts.withColumn("inner", F.coalesce(F.sum("n").over(in_class), F.lit(0)))
    per = targets(sized, weights, cap, seed)

    def eq(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
        b = b.select(*[F.col(n).alias(f"r_{n}") if n in names else F.col(n) for n in b.columns])
        on = None
        for n in names:
            c = F.col(n).eqNullSafe(F.col(f"r_{n}"))
            on = c if on is None else on & c
        return a.join(b, on, "left").drop(*[f"r_{n}" for n in names])

    salts = eq(salts.select("source", "class", "salt", "inner"), classes.select("source", "class", "base"), ["source", "class"])
    salts = eq(salts, per, ["source"]).withColumn("start", F.col("base") + F.col("inner")).drop("base", "inner")
    # ranked inside the salt, whose rows are a small share of a class of a source
    rank = F.row_number().over(Window.partitionBy("source", "class", "salt").orderBy("doc_id", "size"))
    ranked = eq(sized.withColumn("rank", rank), salts, ["source", "class", "salt"])
    ranked = ranked.select(*row, "doc_id", "source", "size", "source_size", "target", "per_doc", "shift", (F.col("start") + F.col("rank")).alias("place"))

    copies = F.floor(F.col("shift") + F.col("place") * F.col("per_doc")) - F.floor(F.col("shift") + (F.col("place") - 1) * F.col("per_doc"))
    out = ranked.withColumn("copies", copies.cast("long"))
    return out.select(*row, "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The documents themselves, each as often as the mix takes it (all their columns).

    They are written once, numbered, with their sizes; the plan reads the numbers and sizes alone, and texts meet
    their copies by number, which no two rows share.
    """
    docs, names, own = C.plain_names(docs, ["doc_id", "source", "text"])
    size, salt = _size_and_salt()
    whole = C.cut(docs.withColumns({"__size": size, "__salt": salt, "__row": F.monotonically_increasing_id()}))
    sized = whole.select("doc_id", "source", F.col("__size").alias("size"), F.col("__salt").alias("salt"), "__row")
    plan = _plan(sized, weights, cap, seed, ("__row",)).filter("copies > 0").select("__row", "copies")
    return whole.join(plan, "__row").withColumn("__i", F.explode(F.expr("sequence(1L, copies)"))).select(*names).toDF(*own)


ORACLE = rf"""
with d as (select doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
k as (select *, substr(md5(coalesce(doc_id::varchar, text, '')), 1, 2) as salt,
        case when size < 64 then size else (length(bin(size)) - 6) * 64 + (size >> (length(bin(size)) - 7)) end as class from d),
s as (select source, sum(size)::bigint as source_size from d group by source),
p as (select *, row_number() over (order by source collate "binary" nulls last) - 1 as place from s),
w as (select *, (case place % 3 when 0 then 5 when 1 then 2 else 1 end)::bigint as weight from p),
c as (select *, sum(source_size) over () as total, sum(weight) over () as all_weight,
        coalesce(sum(source_size * {CAP}) over (order by source_size * {CAP} / weight, place rows between unbounded preceding and 1 preceding), 0) as full_before,
        coalesce(sum(weight) over (order by source_size * {CAP} / weight, place rows between unbounded preceding and 1 preceding), 0) as w_before from w),
f as (select *, source_size * {CAP} * (all_weight - w_before) <= (total - full_before) * weight as is_full from c),
t as (select source, source_size, is_full, weight, total - sum(case when is_full then source_size * {CAP} else 0 end) over () as rest,
        sum(case when is_full then 0 else weight end) over () as open from f),
g as (select source, source_size, case when is_full then (source_size * {CAP})::double else (rest * weight)::double / open::double end as target,
        ('0x' || substr(md5('{SEED}' || coalesce(source, '')), 1, 5))::bigint::double / {STEPS} as shift from t),
r as (select doc_id, source, size, row_number() over (partition by source order by class, salt, doc_id nulls first, size) as place from k),
j as (select r.doc_id, r.source, r.size, g.source_size, g.target, r.place, g.shift, case when g.source_size > 0 then g.target / g.source_size else 0 end as e
        from r join g on r.source is not distinct from g.source)
select doc_id, size, source_size, target, ((floor(shift + place * e) - floor(shift + (place - 1) * e)) * size)::bigint as taken from j
"""
