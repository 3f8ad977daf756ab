"""Op 9, mixing sources to target weights by nested hash thresholds, with DataFrame functions only.

A document's hash (48 bits of the MD5 of its id) decides whether it is taken. Words are summed by source and hash bucket
(12 bits); the running sums of at most 4,096 buckets a source give the bucket in which the budget ends. Only that bucket
is summed again by the next 12 bits, and only the one in which the budget then ends by whole hashes. What lies below the
threshold is taken, and of the rest the one document that best fits what the last one leaves: no sort of documents, one pass over the texts, and every sum is pre-aggregated before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe.llm.common import WS, checkpoint

BITS = 12


def word_count(text: Column) -> Column:
    marks = F.regexp_replace(text, f"[^{WS}]+", "x")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target): one row a source.

    Sources by code point, null last, weigh ``weights``, repeating. A target stops at ``most`` times its source's size and
    the excess goes to the others by weight, until none is above: sources fill up in order of size by weight."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), k + 1).cast("double")).withColumn("most", F.col("source_size") * F.lit(most))
    fill, everything = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last()), Window.partitionBy(F.lit(1))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    w = w.withColumn("full", F.col("most") / F.col("w") < level)
    left = F.col("total") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(everything)
    open_w = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(everything)
    return w.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.least("most", left / open_w * F.col("w"))).alias("target"))


def _ends(sums: DataFrame, bucket: str, budget: str) -> DataFrame:
    """Of each source the bucket in which its budget ends, and what is left of it there."""
    running = Window.partitionBy("key").orderBy(bucket)
    upto = sums.withColumn("upto", F.sum("words").over(running)).withColumn("prev", F.col("upto") - F.col("words"))
    return upto.where((F.col("prev") <= F.col(budget)) & (F.col("upto") > F.col(budget)))


#: Sources up to which their table, a row each, is broadcast. Beyond, joins shuffle.
FEW = 100_000


def _rows(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), key.alias("key"), word_count(text).alias("size"), h.alias("h"), *(F.col(c).alias(f"_{c}") for c in carry))


def _plan(rows: DataFrame, weights: tuple[int, ...], most: float) -> tuple[DataFrame, bool]:
    """Of each source its size and target, how often all of it is taken, and the last hash and the one above that are taken
    once more; whether there are few sources."""
    sizes = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes.select("source", "source_size"), weights, most)
    plan = plan.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))).drop("source")
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("times", times.cast("long")).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size"))
    plan = checkpoint(plan)  # a row a source
    few = plan.count() <= FEW
    some = F.broadcast if few else (lambda df: df)

    level = lambda shift: F.shiftright("h", shift)
    one = rows.groupBy("key", level(48 - BITS).alias("b1")).agg(F.sum("size").alias("words")).join(some(plan.select("key", "rest")), "key")
    one = _ends(one, "b1", "rest").select("key", "b1", (F.col("rest") - F.col("prev")).alias("rest"))
    two = rows.select("key", "size", "h", level(48 - BITS).alias("b1")).join(some(one), ["key", "b1"])
    two = two.groupBy("key", level(48 - 2 * BITS).alias("b2")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    two = _ends(two, "b2", "rest").select("key", "b2", (F.col("rest") - F.col("prev")).alias("rest"))
    three = rows.select("key", "size", "h", level(48 - 2 * BITS).alias("b2")).join(some(two), ["key", "b2"])
    three = three.groupBy("key", "h").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    nearer = F.col("upto") - F.col("rest") <= F.col("rest") - F.col("prev")
    gap = F.when(nearer, F.lit(0.0)).otherwise(F.col("rest") - F.col("prev"))
    three = _ends(three, "h", "rest").select("key", F.when(nearer, F.col("h")).otherwise(F.col("h") - 1).alias("last"), gap.alias("gap"))
    # a document that lies across the threshold may be large: the one that fits the gap best comes in its place
    off = F.abs(F.col("words") - F.col("gap"))
    fill = rows.select("key", "h", "size").join(some(three.where("gap > 0")), "key").where((F.col("h") > F.col("last")) & (F.col("size") < 2 * F.col("gap")) & (F.col("size") > 0))
    fill = fill.groupBy("key", "h").agg(F.sum("size").alias("words"), F.first("gap").alias("gap")).where(off < F.col("gap"))
    fill = fill.groupBy("key").agg(F.min(F.struct(off.alias("off"), "h")).alias("fit")).select("key", F.col("fit.h").alias("fill"))
    plan = plan.join(some(three.drop("gap")), "key", "left").join(some(fill), "key", "left")
    return plan.select("key", "source_size", "target", "times", F.coalesce("last", F.lit(-1)).alias("last"), F.coalesce("fill", F.lit(-1)).alias("fill")), few


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, one row for each row of docs; and the columns named in ``carry``.

    Words of null or empty texts: 0, and nothing taken. A null source is a source. Rows with the same doc_id in a source
    share its fate. An empty table gives no rows."""
    rows = checkpoint(_rows(docs))  # small without texts; counted once
    plan, few = _plan(rows, weights, most)
    copies = F.col("times") + ((F.col("h") <= F.col("last")) | (F.col("h") == F.col("fill"))).cast("long")
    mixed = (_rows(docs, carry) if carry else rows).join(F.broadcast(plan) if few else plan, "key").withColumn("copies", copies)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *(F.col(f"_{c}").alias(c) for c in carry))


ORACLE = r"""
WITH r AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS most FROM s),
l AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
             coalesce(sum(most) OVER f, 0.0) AS full_before, coalesce(sum(w) OVER f, 0.0) AS w_before
      FROM w WINDOW f AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, most / w < (total - full_before) / (all_w - w_before) AS isfull FROM l),
t AS (SELECT source, source_size, CASE WHEN isfull THEN most ELSE least(most,
             (total - sum(CASE WHEN isfull THEN most ELSE 0.0 END) OVER ()) / (sum(CASE WHEN isfull THEN 0.0 ELSE w END) OVER ()) * w) END::DOUBLE AS target FROM c),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS times FROM t),
q AS (SELECT *, target - times * source_size AS rest FROM p),
g AS (SELECT source, h, sum(size) AS words FROM r GROUP BY source, h),
u AS (SELECT source, h, words, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
e AS (SELECT u.source, CASE WHEN upto - rest <= rest - (upto - words) THEN u.h ELSE u.h - 1 END AS last,
             CASE WHEN upto - rest <= rest - (upto - words) THEN 0 ELSE rest - (upto - words) END AS gap
      FROM u JOIN q ON u.source IS NOT DISTINCT FROM q.source WHERE upto - words <= rest AND upto > rest),
n AS (SELECT r.source, r.h, sum(r.size) AS words, any_value(e.gap) AS gap FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source
      WHERE r.h > e.last AND r.size > 0 AND r.size < 2 * e.gap GROUP BY r.source, r.h),
f AS (SELECT source, arg_min(h, (abs(words - gap), h)) AS fill FROM n WHERE abs(words - gap) < gap GROUP BY source)
SELECT r.doc_id, r.size, q.source_size, q.target,
       (r.size * (q.times + CASE WHEN r.h <= coalesce(e.last, -1) OR r.h = f.fill THEN 1 ELSE 0 END))::BIGINT AS taken,
       (q.times + CASE WHEN r.h <= coalesce(e.last, -1) OR r.h = f.fill THEN 1 ELSE 0 END)::BIGINT AS copies
FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source LEFT JOIN e ON r.source IS NOT DISTINCT FROM e.source
     LEFT JOIN f ON r.source IS NOT DISTINCT FROM f.source
"""
