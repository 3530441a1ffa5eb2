"""Mixing sources to target weights, in DataFrame functions alone.

Every source gets a word budget; whole passes over the source (epochs) come first,
and what is left of the budget is filled by Efraimidis-Spirakis sampling: document
i draws the exponential key -ln(u_i) / w_i with its quality weight w_i, the
documents of a source are sorted by key, and the prefix whose word count comes
nearest to the rest is taken once more.  u_i is a hash of the document, so reruns
and retried tasks agree.

Plan: one pass over the texts leaves a narrow stored table (source, key, size).
Prefix sums run over balanced range blocks of (source, key), so a source with a
third of all rows is spread like any other.  The result per source is one cut
key: a document is in the extra pass iff its key is at most the cut, which is a
map-side comparison and moves no text.  The per-source tables are stored, so Spark
knows their size when it plans the joins with the rows and broadcasts them only
below its own threshold.

Defined cases: a null text has size 0 and is never worth a word; a null source is
a source of its own, ordered last; rows equal in identifier and text draw one key
and are taken together; an empty table gives an empty mix; further columns of any
name are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacelens.functions.ordered import ordered
from pacelens.functions.storage import materialise
from pacelens.llm.common import WORD, table, text_of

SYMBOLS = r"[#*$%&|<>]"
TWO_52 = float(2**52)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def quality_weight(text: Column, size: Column) -> Column:
    """Quality weight in [0.05, 1]: few symbols per word, and half for texts under 50 words."""
    symbols = F.regexp_count(text, F.lit(SYMBOLS))
    clean = F.greatest(F.lit(0.1), F.lit(1.0) - symbols / F.greatest(size, F.lit(1)))
    return clean * F.when(size < 50, 0.5).otherwise(1.0)


def exponential_key(identifier: Column, text: Column, weight: Column) -> Column:
    """-ln(u) / w with u from the first 52 bits of an MD5 of identifier and text."""
    seed = F.md5(F.concat(F.coalesce(identifier.cast("string"), F.lit("")), F.lit("|"), text))
    u = (F.conv(F.substring(seed, 1, 13), 16, 10).cast("double") + 0.5) / TWO_52
    return -F.ln(u) / weight


def measured(docs: DataFrame, identifier: str, text: str, source: str, *carry: Column) -> DataFrame:
    """(source, size, key) of each row, with ``carry`` columns in front."""
    t = text_of(text)
    sized = docs.select(*carry, F.col(source).alias("_source"), t.alias("_t"), F.col(identifier).alias("_id"), word_count(t).alias("_size"))
    keep = [c for c in sized.columns if c not in ("_t", "_id")]
    return sized.select(*keep, exponential_key(F.col("_id"), F.col("_t"), quality_weight(F.col("_t"), F.col("_size"))).alias("_key"))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Word targets per source (one row each): shares by weight, stopped at ``most`` times the source.

    The stopped sources are a prefix of the order by limit / weight, so the
    repeated resharing has a closed form: a source is stopped iff its limit does
    not exceed its part of what the sources before it leave over.
    """
    by_name = Window.orderBy(F.col("_source").isNull(), F.col("_source"))
    everyone = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    named = sizes.select(
        "*",
        F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).alias("_w"),
        (F.col("_source_size") * F.lit(float(most))).alias("_limit"),
        (F.sum("_source_size").over(everyone) * F.lit(float(share))).alias("_budget"),
    )
    by_room = Window.orderBy(F.col("_limit") / F.col("_w"), F.col("_source").isNull(), F.col("_source"))
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_budget") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    weight_left = F.sum("_w").over(everyone) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    stopped = named.withColumn("_stopped", F.col("_limit") <= F.col("_w") * left / weight_left)
    used = F.sum(F.when(F.col("_stopped"), F.col("_limit")).otherwise(0.0)).over(everyone)
    open_weight = F.sum(F.when(F.col("_stopped"), 0.0).otherwise(F.col("_w"))).over(everyone)
    target = F.when(F.col("_stopped"), F.col("_limit")).otherwise(F.col("_w") * (F.col("_budget") - used) / open_weight)
    epochs = F.when(F.col("_source_size") > 0, F.floor(target / F.col("_source_size"))).otherwise(0)
    return stopped.select("_source", "_source_size", target.alias("_target"), epochs.cast("bigint").alias("_epochs"))


def plan(narrow: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: size, target, whole epochs and the cut key of the extra pass (null: none)."""
    sizes = narrow.groupBy("_source").agg(F.sum("_size").alias("_source_size"))
    goal = materialise(targets(sizes, weights, share, most))
    by_key = narrow.where("_size > 0").groupBy("_source", "_key").agg(F.sum("_size").alias("_size"))
    summed = ordered(by_key, ["_source"], ["_key"], sums={"_upto": F.col("_size")})
    goal_k = goal.select(F.col("_source").alias("_s"), (F.col("_target") - F.col("_epochs") * F.col("_source_size")).alias("_rest"))
    inside = F.col("_upto") - F.col("_size") / 2.0 <= F.col("_rest")
    cuts = (
        summed.join(goal_k, F.col("_source").eqNullSafe(F.col("_s"))).where(inside)
        .groupBy("_source").agg(F.max("_key").alias("_cut"))
        .select(F.col("_source").alias("_s"), "_cut")
    )
    return materialise(goal.join(cuts, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s"))


def copies() -> Column:
    """How often the mix takes a row, from its key and its source's plan."""
    return F.col("_epochs") + F.when(F.col("_key") <= F.col("_cut"), 1).otherwise(0)


def mix_counts(docs: DataFrame, identifier: str = "doc_id", text: str = "text", source: str = "source", **goals) -> DataFrame:
    """(identifier, size, source_size, target, taken) per row; ``taken`` counts words with repeats."""
    narrow = materialise(measured(docs, identifier, text, source, F.col(identifier).alias("_row_id")))
    per_source = plan(narrow, **goals).withColumnRenamed("_source", "_s")
    joined = narrow.join(per_source, F.col("_source").eqNullSafe(F.col("_s")), "left")
    return joined.select(
        F.col("_row_id").alias(identifier), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_size") * copies()).alias("taken"),
    )


def mix(docs: DataFrame, identifier: str = "doc_id", text: str = "text", source: str = "source", **goals) -> DataFrame:
    """The mixed rows themselves: each row as often as the mix takes it, columns unchanged."""
    narrow = materialise(measured(docs, identifier, text, source))
    per_source = plan(narrow, **goals).withColumnRenamed("_source", "_s")
    rows = measured(docs, identifier, text, source, F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    joined = rows.join(per_source, F.col("_source").eqNullSafe(F.col("_s")))
    repeated = joined.select(F.explode(F.array_repeat("_row", copies().cast("int"))).alias("_row"))
    return repeated.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def run(spark, folder: str) -> DataFrame:
    """op1: mix all documents; weights 5, 2, 1 in turn, 150 % of all words, two epochs at most."""
    return mix_counts(table(spark, folder, "documents"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), keyed AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || t), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
    / (greatest(0.1, 1.0::DOUBLE - len(regexp_extract_all(t, '[#*$%&|<>]'))::DOUBLE / greatest(size, 1)) * CASE WHEN size < 50 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS k
  FROM sized
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source
), named AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w,
    source_size * 2.0::DOUBLE AS lim, sum(source_size) OVER () * 1.5::DOUBLE AS budget
  FROM sizes
), room AS (
  SELECT *, lim <= w * (budget - coalesce(sum(lim) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS stopped
  FROM named WINDOW before AS (ORDER BY lim / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goal AS (
  SELECT source, source_size, CASE WHEN stopped THEN lim
      ELSE w * (budget - sum(CASE WHEN stopped THEN lim ELSE 0 END) OVER ()) / sum(CASE WHEN stopped THEN 0 ELSE w END) OVER () END AS target
  FROM room
), epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM goal
), summed AS (
  SELECT source, k, size, sum(size) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto
  FROM (SELECT source, k, sum(size)::BIGINT AS size FROM keyed WHERE size > 0 GROUP BY source, k)
), cuts AS (
  SELECT s.source, max(k) AS cut FROM summed s JOIN epochs e ON s.source IS NOT DISTINCT FROM e.source
  WHERE upto - size / 2.0::DOUBLE <= target - whole * source_size GROUP BY s.source
)
SELECT d.doc_id, d.size, e.source_size, e.target, (d.size * (e.whole + CASE WHEN d.k <= c.cut THEN 1 ELSE 0 END))::BIGINT AS taken
FROM keyed d JOIN epochs e ON d.source IS NOT DISTINCT FROM e.source LEFT JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source
"""
