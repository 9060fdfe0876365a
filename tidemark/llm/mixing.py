"""Mixing sources to target weights by Pareto order sampling, on DataFrame functions only.

Each source's target is its weighted share of all words, at most ``most`` times its own
size; what that cuts off is shared again by weight. The level at which this settles has
a closed form: with sources in order of limit over weight, those whose ratio lies below
the level get their limit, and all others the level times their weight.

Within a source a document is due c copies, in proportion to its appeal: the number of binary
digits of its size, so that a long text is drawn more often than a short one, but not by as much as it is
longer. c = min(most, level * appeal), and the level is the one at which the copies have the target's words; the closed form
above finds it from the source's words by appeal (64 numbers at most): classes that are due ``most`` copies are certain,
and the rest is shared among the others. floor(c) copies are taken whole. What is left of c is the document's inclusion
probability p: with a uniform number u from its id, documents are ranked by
(u / (1 - u)) / (p / (1 - p)), and the first of them are taken, as many as fill the rest of the target. The sample's size is
thus fixed, and counted in words: a source ends within half a document of its target.

The running sum over a source is a two-level one: ranks fall into BINS bins, bin
totals give each source's cutting bin, and only the rows of that bin are ordered. A hot
source is thus spread over all tasks.

Cases: a null text has 0 words and is never taken; null is a source of its own and the last; ids that repeat
share one number u, and equal rows are interchangeable; a source of 0 words has target 0;
an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

BINS = 4096


def levelled(df: DataFrame, keys: list[str], order: list[Column], total: Column, limit: Column, weight: Column) -> DataFrame:
    """df with ``share`` = min(limit, level * weight), which add up to ``total`` within keys, or to all limits if these are less."""
    by_ratio = Window.partitionBy(*keys).orderBy("l_ratio", *order)
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    at = (F.col("l_total") - F.coalesce(F.sum("l_limit").over(before), F.lit(0.0))) / F.sum("l_weight").over(onward)
    return (
        df.withColumn("l_total", total).withColumn("l_limit", limit).withColumn("l_weight", weight)
        .withColumn("l_ratio", F.when(F.col("l_weight") > 0, F.col("l_limit") / F.col("l_weight")).otherwise(0.0))
        .withColumn("l_at", at)
        .withColumn("l_nth", F.row_number().over(by_ratio))
        .withColumn("l_level", F.min(F.when(F.col("l_at") < F.col("l_ratio"), F.struct("l_nth", "l_at"))).over(Window.partitionBy(*keys))["l_at"])
        .withColumn("share", F.when(F.col("l_level").isNull(), F.col("l_limit")).otherwise(F.least("l_limit", F.col("l_level") * F.col("l_weight"))))
        .drop("l_total", "l_limit", "l_weight", "l_ratio", "l_at", "l_nth")
    )


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sources(source, source_size) with each one's target. There is a row a source."""
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights)).cast("int") + 1)
    numbered = sources.withColumn("weight", weight).withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
    out = levelled(numbered, [], [F.col("source").asc_nulls_last()], F.col("total"), (F.col("source_size") * most).cast("double"), F.col("weight"))
    return out.select("source", "source_size", F.col("share").alias("target"))


def appeal(size: Column) -> Column:
    """Binary digits of a size; 0 of an empty text."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0).cast("long")


def mix_sources(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sized(doc_id, source, size, tie) with source_size, target, copies and taken. ``tie`` orders rows of one id."""
    sized = sized.withColumn("appeal", appeal(F.col("size")))
    classes = written(sized.groupBy("source", "appeal").agg(F.sum("size").alias("words")), "classes")
    aim = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most).withColumnRenamed("source", "t_source")
    classes = classes.join(aim, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    words = F.col("words").cast("double")
    due = levelled(classes, ["source"], [F.col("appeal")], F.col("target"), words * most, words * F.col("appeal"))
    due = due.withColumn("due", F.when(F.col("l_level").isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.col("l_level") * F.col("appeal"))))
    due = due.withColumn("due", F.when(F.col("appeal") > 0, F.col("due")).otherwise(0.0)).withColumn("whole", F.floor("due").cast("long")).withColumn("p", F.col("due") - F.floor("due"))
    rest = F.greatest(F.lit(0.0), F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source")))  # a class a row
    aim = written(due.withColumn("rest", rest).select(F.col("source").alias("s"), F.col("appeal").alias("a"), "source_size", "target", "whole", "p", "rest"), "targets")
    u = (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = sized.withColumn("u", u).join(aim, F.col("source").eqNullSafe(F.col("s")) & (F.col("appeal") == F.col("a"))).drop("s", "a")
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    rows = rows.withColumn("odds", F.when(F.col("p") > 0, odds)).withColumn("bin", F.when(F.col("p") > 0, F.floor(F.col("odds") / (1 + F.col("odds")) * BINS)).otherwise(BINS))
    per_bin = rows.where("p > 0").groupBy(F.col("source").alias("b_source"), F.col("bin").alias("b_bin")).agg(F.sum("size").alias("b_words"), F.first("rest").alias("b_rest"))
    run = Window.partitionBy("b_source").orderBy("b_bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows
    per_bin = per_bin.withColumn("ahead", F.coalesce(F.sum("b_words").over(run), F.lit(0)))
    cutting = per_bin.where((F.col("b_rest") > 0) & (F.col("ahead") <= F.col("b_rest")) & (F.col("ahead") + F.col("b_words") > F.col("b_rest"))).select(F.col("b_source").alias("c_source"), F.col("b_bin").alias("cut"), "ahead")
    cutting = written(cutting, "cutting")  # a row a source: of known size, so the planner can tell whether to broadcast it
    rows = rows.join(cutting, F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source")
    rows = rows.withColumn("cut", F.coalesce("cut", F.lit(BINS + 1)))
    clear = rows.where((F.col("bin") != F.col("cut")) | (F.col("p") == 0)).withColumn("more", (F.col("p") > 0) & (F.col("bin") < F.col("cut")) & (F.col("rest") > 0))
    within = Window.partitionBy("source").orderBy("odds", "doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where((F.col("bin") == F.col("cut")) & (F.col("p") > 0)).withColumn("in_bin", F.coalesce(F.sum("size").over(within), F.lit(0)))
    edge = edge.withColumn("more", F.col("ahead") + F.col("in_bin") + F.col("size") / 2 <= F.col("rest")).drop("in_bin")
    both = clear.unionByName(edge)
    copies = F.col("whole") + F.col("more").cast("long")
    return both.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies")).drop("u", "odds", "bin", "cut", "ahead", "whole", "rest", "more", "appeal")


def sizes(docs: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.crc32(text).alias("tie"), *more)


def mixed(docs: DataFrame, **kw) -> DataFrame:
    """docs, each row as often as the mix takes it."""
    sized = sizes(docs.withColumn("whole_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])), "whole_row")
    out = mix_sources(sized, **kw).where("copies > 0")
    return out.select("whole_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("whole_row.*")


def digest(docs: DataFrame) -> DataFrame:
    sized = written(sizes(docs), "words")
    return mix_sources(sized).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken", F.round("p", 6).alias("p"))


SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, coalesce(text, '') AS tie FROM documents),
app AS (SELECT *, CASE WHEN size > 0 THEN length(ltrim(bin(size), '0')) ELSE 0 END AS appeal FROM sized),
cls AS (SELECT source, appeal, CAST(sum(size) AS DOUBLE) AS words FROM app GROUP BY source, appeal),
per AS (SELECT source, sum(words) AS source_size FROM cls GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, 3 * source_size AS lim, sum(source_size) OVER () AS total FROM per),
lv AS (SELECT *, lim / weight AS ratio, (total - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_level,
  row_number() OVER (ORDER BY lim / weight, source NULLS LAST) AS nth FROM w),
lev AS (SELECT *, arg_min(at_level, nth) FILTER (at_level < ratio) OVER () AS level FROM lv),
aim AS (SELECT source, source_size, CASE WHEN level IS NULL THEN lim ELSE least(lim, level * weight) END AS target FROM lev),
c0 AS (SELECT c.source, c.appeal, c.words, a.source_size, a.target, 3 * c.words AS lim, c.words * c.appeal AS weight, CASE WHEN c.words * c.appeal > 0 THEN 3 * c.words / (c.words * c.appeal) ELSE 0 END AS ratio
  FROM cls c JOIN aim a ON a.source IS NOT DISTINCT FROM c.source),
c1 AS (SELECT *, (target - coalesce(sum(lim) OVER (PARTITION BY source ORDER BY ratio, appeal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / nullif(sum(weight) OVER (PARTITION BY source ORDER BY ratio, appeal ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS at_level,
  row_number() OVER (PARTITION BY source ORDER BY ratio, appeal) AS nth FROM c0),
c2 AS (SELECT *, arg_min(at_level, nth) FILTER (at_level < ratio) OVER (PARTITION BY source) AS level FROM c1),
c3 AS (SELECT *, CASE WHEN appeal = 0 THEN 0 WHEN level IS NULL THEN 3 ELSE least(3, level * appeal) END AS due FROM c2),
c4 AS (SELECT *, floor(due) AS whole, due - floor(due) AS p, target - sum(floor(due) * words) OVER (PARTITION BY source) AS rest FROM c3),
q AS (SELECT s.*, c.source_size, c.target, c.whole, c.rest, c.p, (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM app s JOIN c4 c ON s.source IS NOT DISTINCT FROM c.source AND s.appeal = c.appeal),
o AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM q),
r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, p > 0 ORDER BY odds, doc_id, tie, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM o)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, round(target, 3) AS target, CAST(size * (whole + CASE WHEN p > 0 AND rest > 0 AND ahead + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken, round(p, 6) AS p FROM r
"""
