"""Mixing sources to target weights: each document floor(rate) times, and once more with the fraction's probability.

Targets: sources share the whole corpus by weight; no target passes `most` times its source's size, and what that
leaves is shared again by weight. The extra copy of a document is a Bernoulli draw of its own: a number in (0, 1), hashed from its
source and id, is below frac(rate). No other document changes it, and a source's words miss their target by chance only: by
about the root of the sum of frac (1 - frac) size**2, which is small unless a few documents hold most of a source's words.

Null sources are one source, last in order. Null and empty texts have size 0 and are repeated as any other document.
Rows that repeat a source and id share their draw. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_counted, md5_unit, private

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MOST = 3
#: Sources whose rates are broadcast; rates of more are joined, the largest sources apart.
FEW = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target, rate), and `rows` if there.

    In the order of most * size / weight, the first k sources stop at their bound, k being the least number for
    which the rest, shared by weight, leaves the next one within its bound. One row for each source: a small table.
    """
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    return (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), rank + 1).cast("double"))
        .withColumn("bound", F.col("source_size") * float(most))
        .withColumn("ratio", F.col("bound") / F.col("weight"))
        .withColumn("left_size", F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(earlier), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
        .withColumn("level", F.col("left_size") / F.col("left_weight"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
        .withColumn("target", F.least("bound", F.col("level") * F.col("weight")))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0))
        .select("source", "source_size", "target", "rate", *[c for c in sizes.columns if c == "rows"])
    )


def copies(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, most: float = MOST, prefix: str = "mix_") -> DataFrame:
    """Adds size, source_size, target and copies, each with the prefix, to all columns of docs; columns so named are replaced."""
    p = prefix
    docs = docs.drop(*[c for c in docs.columns if c.lower().startswith(p)])
    own = [f"{p}source", f"{p}null"]
    sized = docs.withColumns({f"{p}size": word_count(F.col(text)), own[0]: F.coalesce(F.col(source).cast("string"), F.lit("")), own[1]: F.col(source).isNull()})
    sizes = sized.groupBy(*own).agg(F.sum(f"{p}size").alias("source_size"), F.count("*").alias("rows"))
    sizes = cut(sizes.select(F.when(~F.col(own[1]), F.col(own[0])).alias("source"), "source_size", "rows"))
    plan = targets(sizes, weights, most).select(
        F.coalesce("source", F.lit("")).alias(own[0]),
        F.col("source").isNull().alias(own[1]),
        F.col("source_size").alias(f"{p}source_size"),
        F.col("target").alias(f"{p}target"),
        F.col("rate").alias(f"{p}rate"),
        F.col("rows").alias(f"{p}rows"),
    )
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    drawn = sized.join(F.broadcast(plan.drop(f"{p}rows")), own) if n <= FEW else join_counted(sized, cut(plan), own, f"{p}rows", total)
    rate = F.col(f"{p}rate")
    extra = md5_unit(F.lit("copy"), F.col(own[0]), F.coalesce(F.col(key).cast("string"), F.lit("null"))) < rate - F.floor(rate)
    return drawn.withColumn(f"{p}copies", (F.floor(rate) + extra.cast("int")).cast("int")).drop(*own, f"{p}rate")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    p = private(docs, "__mix_")
    n = F.col(f"{p}copies")
    drawn = copies(docs, prefix=p, **options)
    return drawn.withColumn(f"{p}copy", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)))).select(*[F.col(f"`{c}`") for c in docs.columns])
