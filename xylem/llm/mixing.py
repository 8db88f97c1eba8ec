"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target over its size is how often each of its documents is to be taken: the whole part is certain, the fraction is
a copy probability. Two fractional documents meet in a duel: words move from one to the other, in a direction drawn so
that both expectations hold, until one probability is 0 or 1; the expected words of the pair never change. The other
goes on to the next duel. A leaf of the tree is a bucket of about LEAF documents of one source, folded by ``aggregate``; its one
residual goes up, and levels repeat until a source has one bucket. The last residual goes to the nearer
whole number, so a source's words are within half a document of its target. Draws are hashes of document and level: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from xylem.llm.text import SPACE, WORD
from xylem.session import Workspace

#: Weights of the sources in order of their names, repeating; words to take as a share of all; most copies of a document.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Documents that meet in one leaf of the reduction tree.
LEAF = 128
SEED = 7


def size_of(text):
    """Words of a text."""
    return F.length(F.regexp_replace(F.ltrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")), f"{WORD}+{SPACE[:-1]}*+", "w")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(source, source_size, n, target): ``share`` of all words dealt by weight, none above ``most`` times its own words.

    The shares that stay after resharing again and again are the level L with sum(min(L * weight, most * size)) = share * total:
    in order of size over weight, the sources before the level are full. One row per source meets in the window.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({"full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "used": F.coalesce(F.sum("weight").over(before), F.lit(0.0)), "all_w": F.sum("weight").over(upto), "all": F.sum("source_size").over(upto)})
    level = (F.col("all") * F.lit(float(share)) - F.col("full")) / (F.col("all_w") - F.col("used"))
    # the first source, in this order, whose cap is at or above the level that is left for it and those after it sets the level
    s = s.withColumn("level", level).withColumn("sets", F.col("level") * F.col("weight") <= F.col("cap"))
    s = s.withColumn("final", F.min(F.when(F.col("sets"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("used"), F.col("level")))).over(upto)["level"])
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight")))
    return s.select("source", "source_size", "n", target.alias("target"))


def draw(*cols):
    """Uniform in [0, 1), the same on every run."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(SEED)), 11).cast("double") / F.lit(float(1 << 53))


def duel(rest, item):
    """The residual ``rest`` meets ``item``: (p of rest, p of item) after words moved until one probability is whole.

    Words m1 can go from rest to item, m2 the other way; the first happens with probability m2 / (m1 + m2).
    """
    wr, wi, pr, pi = rest["size"], item["size"], rest["p"], item["p"]
    m1 = F.least(pr * wr, (1 - pi) * wi)
    m2 = F.least((1 - pr) * wr, pi * wi)
    forward = item["u"] * (m1 + m2) < m2
    # the side that becomes whole is set exactly
    r1 = F.when(pr * wr <= (1 - pi) * wi, F.lit(0.0)).otherwise(pr - m1 / wr)
    i1 = F.when(pr * wr <= (1 - pi) * wi, F.least(F.lit(1.0), pi + m1 / wi)).otherwise(F.lit(1.0))
    r2 = F.when((1 - pr) * wr <= pi * wi, F.lit(1.0)).otherwise(F.least(F.lit(1.0), pr + m2 / wr))
    i2 = F.when((1 - pr) * wr <= pi * wi, F.greatest(F.lit(0.0), pi - m2 / wi)).otherwise(F.lit(0.0))
    return F.when(forward, r1).otherwise(r2), F.when(forward, i1).otherwise(i2)


def whole(p):
    return (p <= 1e-12) | (p >= 1 - 1e-12)


def fold(level: DataFrame) -> DataFrame:
    """One row per bucket: ``done`` (decided documents) and ``left`` (at most one document, still fractional)."""
    fields = ["doc_id", "occ", "size", "p", "u"]
    one = F.struct(*fields)
    items = F.array_sort(F.collect_list(F.struct("place", *fields)))
    rows = level.groupBy("source", "bucket").agg(items.alias("items"))
    as_item = lambda x: F.struct(*[x[f].alias(f) for f in fields])
    kind = level.select(one.alias("x")).schema["x"].dataType.simpleString()
    empty = F.struct(F.lit(None).cast(kind).alias("left"), F.array().cast(f"array<{kind}>").alias("done"))

    def put(x, p):
        return F.struct(*[(p if f == "p" else x[f]).alias(f) for f in fields])

    def step(acc, x):
        item = as_item(x)
        p_rest, p_item = duel(acc["left"], item)
        rest, now = put(acc["left"], p_rest), put(item, p_item)
        met = (
            F.when(whole(p_rest) & whole(p_item), F.struct(F.lit(None).cast(kind).alias("left"), F.concat(acc["done"], F.array(rest, now)).alias("done")))
            .when(whole(p_rest), F.struct(now.cast(kind).alias("left"), F.concat(acc["done"], F.array(rest)).alias("done")))
            .otherwise(F.struct(rest.cast(kind).alias("left"), F.concat(acc["done"], F.array(now)).alias("done")))
        )
        return F.when(acc["left"].isNull(), F.struct(item.cast(kind).alias("left"), acc["done"].alias("done"))).otherwise(met)

    return rows.select("source", F.aggregate("items", empty, step).alias("f")).select("source", "f.left", "f.done")


def numbered(*order):
    """The number of a row among those that agree in id, source and size: rows without an id spread over sources and sizes."""
    return F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(*order))


def same(doc_id, source, size, occ):
    """Whether a row with all four columns is the one so named."""
    return F.col("doc_id").eqNullSafe(F.col(doc_id)) & F.col("source").eqNullSafe(F.col(source)) & (F.col("size") == F.col(size)) & (F.col("occ") == F.col(occ))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, leaf: int = LEAF) -> DataFrame:
    """(doc_id, occ, source, size, source_size, target, copies) per row of ``docs`` (doc_id, source, size).

    ``occ`` numbers rows that agree in doc_id, source and size, which are all that counts here. Sizes of 0 and sources
    without words take nothing. Null ids and sources are values like others. An empty table gives no rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "mixing")
    docs = docs.select("doc_id", "source", "size")
    docs = work.save(docs.withColumn("occ", numbered(F.lit(0))), "sizes")
    target = work.save(targets(docs, weights, share, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    target = target.withColumnRenamed("source", "of")
    joined = docs.join(target, F.col("source").eqNullSafe(F.col("of"))).select("source", "doc_id", "occ", "size", "source_size", "n", "target", rate.alias("rate"))
    base = work.save(joined.withColumn("sure", F.floor(F.col("rate") + 1e-12)).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("sure"))), "rates")
    open_ = base.where((F.col("size") > 0) & ~whole(F.col("p"))).select("source", "doc_id", "occ", F.col("size").cast("double").alias("size"), "p", "n")
    decided, level = [], 0
    n = F.col("n")
    while True:
        # a source's n open documents fall into n / leaf buckets by a draw; place is their order there, u decides their duel
        drawn = {k: draw(F.lit(k), F.lit(level), "doc_id", "source", F.col("size").cast("long"), "occ") for k in ("u", "place", "bucket")}
        rows = open_.withColumns({"u": drawn["u"], "place": drawn["place"], "bucket": F.floor(drawn["bucket"] * F.ceil(n / leaf)).cast("long")})
        folded = work.save(fold(rows), f"level{level}")
        decided.append(folded.select("source", F.explode("done").alias("x")).select("source", "x.doc_id", "x.size", "x.occ", "x.p"))
        open_ = folded.where("left IS NOT NULL").select("source", "left.doc_id", "left.occ", "left.size", "left.p")
        counts = open_.groupBy(F.col("source").alias("of")).agg(F.count(F.lit(1)).alias("n"))
        open_ = open_.join(counts, F.col("source").eqNullSafe(F.col("of"))).select("source", "doc_id", "occ", "size", "p", "n")
        level += 1
        if not open_.where("n > 1").head(1):
            decided.append(open_.withColumn("p", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0)).select("source", "doc_id", "size", "occ", "p"))
            break
    took = decided[0]
    for more in decided[1:]:
        took = took.union(more)
    took = took.where("p > 0.5").select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").cast("long").alias("z"), F.col("occ").alias("o"), F.lit(1).alias("extra"))
    out = base.join(took, same("d", "s", "z", "o"), "left")
    copies = F.when(F.col("size") > 0, F.col("sure") + F.when(whole(F.col("p")), F.round("p")).otherwise(F.coalesce("extra", F.lit(0)))).otherwise(0)
    return out.select("doc_id", "occ", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def shares(docs: DataFrame) -> DataFrame:
    """The contract's columns for ``documents``."""
    out = mix(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """``docs``, each row as often as the mix takes it (copies above one repeat the row)."""
    named = docs.select(F.struct("*").alias("row"), "doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("h"))
    took = mix(named.drop("row", "h"), weights, share, most).where("copies > 0").select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("z"), F.col("occ").alias("o"), F.col("copies").alias("n"))
    named = named.withColumn("occ", numbered("h"))
    out = named.join(took, same("d", "s", "z", "o"))
    return out.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("row.*")
