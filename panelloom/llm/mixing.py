"""Mixing sources to target weights: certain whole copies, then Pareto order samples for the fractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_table

#: Weights of the sources in code-point order, repeating; most words taken of a source or document, as a multiple of its size.
WEIGHTS, MOST = (5, 2, 1), 3
#: Cells of the histogram over transformed ranks that locates where a source's sample ends.
CELLS = 4096
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    """Runs of bytes other than ASCII white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> (source, source_size, target): shares of the total by weight, none above ``most`` times its size.

    Sorted by cap over weight, the capped sources are a prefix, so one pass of running totals finds the level that
    spends what the caps leave over. Windows hold one row a source. Sources are ordered by code point, null last.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w.cast("double")).withColumn("cap", (most * F.col("source_size")).cast("double"))
    rows = rows.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("all_w", F.sum("w").over(everything))
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level)
    rows = rows.withColumn("final", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)["level"])
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("w")))
    return rows.select("source", "source_size", target.alias("target"))


def unit_draw(key: str, seed: int, nth: str) -> Column:
    """A number strictly between 0 and 1 from the MD5 of seed, key, hash of the text (column __text) and number among rows equal in these."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(":"), F.col("__text").cast("string"), F.lit(":"), F.col(nth).cast("string"))
    return (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def mix_sources(
    docs: DataFrame, key: str = "doc_id", weight: str | None = None, seed: int = 50, weights: tuple[int, ...] = WEIGHTS, most: int = MOST,
) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (= copies * size).

    A document expects target / source_size copies (times its relative ``weight``, a positive column, if one is named;
    null counts as 1), ``most`` at the outside. Whole copies are certain. The fractions p are settled by Pareto order sampling:
    documents of a source are ranked by the odds of a uniform draw over the odds of p, and the head of that ranking whose
    words come nearest to what the whole copies leave of the target gets one more copy. Draws depend on seed, ``key``, text and
    a number among rows that are equal in source, weight, key and text, so reruns agree, and rows without or with equal ids are drawn one by one.

    The head is found without sorting a source: words are added up in CELLS cells of the ranking, and only the cell in which
    the target falls is ranked row by row. The texts are read twice and not shuffled, but for rows with equal key and text, which are numbered: sizes, targets and cuts (one row a
    source) are written to the shared folder, and Catalyst broadcasts the latter if their files are below its threshold.
    Null text or no words: size 0, taken 0. Columns named like results are replaced.
    """
    spark, results = docs.sparkSession, ("size", "source_size", "target", "copies", "taken")
    relative = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(1.0)), F.lit(1e-9)) if weight else F.lit(1.0)
    slim = scratch_table(docs.select("source", F.col(key).alias("key"), word_count().alias("size"), relative.alias("w"), F.xxhash64("text").alias("__text")), "mix-sizes")
    same = lambda key, w: F.xxhash64("source", F.col(key), w, "__text")
    twins = scratch_table(slim.groupBy(same("key", F.col("w")).alias("__twin")).count().where("count > 1").select("__twin"), "mix-twins")
    repeats = not twins.isEmpty()
    sums = scratch_table(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("w")).alias("wsize")), "mix-sums")
    goals = source_targets(sums.select("source", "source_size"), weights, most).withColumnRenamed("source", "__s").join(sums.select(F.col("source").alias("__s2"), "wsize"), F.expr("__s <=> __s2"))
    goals = scratch_table(goals.select("__s", "source_size", "target", F.col("wsize").alias("__wsize")), "mix-targets")

    def numbered(rows: DataFrame, key: str, w: Column) -> DataFrame:
        """``rows`` with __nth, 1 for rows without a twin; which of two equal rows comes first does not change the draws."""
        if not repeats:
            return rows.withColumn("__nth", F.lit(1))
        rows = rows.withColumn("__same", same(key, w))
        order = F.xxhash64(*(F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind))
        more = rows.join(twins, F.expr("__same = __twin"), "left_semi").withColumn("__nth", F.row_number().over(Window.partitionBy("__same").orderBy("source", key, order)))
        return rows.join(twins, F.expr("__same = __twin"), "left_anti").withColumn("__nth", F.lit(1)).unionByName(more).drop("__same")

    def ranked(rows: DataFrame, size: str, w: Column, draw: str) -> DataFrame:
        rows = numbered(rows, draw, w).join(goals, F.expr("source <=> __s")).drop("__s")
        expected = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("__wsize") * w)).otherwise(0.0)
        rows = rows.withColumn("__e", expected).withColumn("__whole", F.floor("__e")).withColumn("__p", F.col("__e") - F.col("__whole"))
        u = unit_draw(draw, seed, "__nth")
        rows = rows.withColumn("__q", F.when((F.col("__p") > 0) & (F.col(size) > 0), (u / (1 - u)) / (F.col("__p") / (1 - F.col("__p")))))
        return rows.withColumn("__cell", F.floor(F.lit(CELLS) * F.col("__q") / (1 + F.col("__q"))))

    rows = ranked(slim, "size", F.col("w"), "key")
    cells = rows.groupBy("source", "__cell").agg(
        F.sum(F.when(F.col("__q").isNotNull(), F.col("size")).otherwise(0)).alias("words"), F.sum(F.col("size") * F.col("__whole")).alias("certain"), F.max("target").alias("target"))
    by_source = Window.partitionBy("source")
    cells = cells.withColumn("rest", F.col("target") - F.sum("certain").over(by_source)).where("__cell is not null")
    cells = cells.withColumn("before", F.sum("words").over(by_source.orderBy("__cell")) - F.col("words")).withColumn("all", F.sum("words").over(by_source))
    # where all fractions together fall short of the rest, all are taken: the end lies behind the last cell
    ends = scratch_table(cells.where("before < rest and (before + words >= rest or all < rest)").groupBy("source").agg(
        F.max(F.when(F.expr("all < rest"), F.lit(CELLS + 1)).otherwise(F.col("__cell"))).alias("__end"), F.max("before").alias("__before"), F.max("rest").alias("__rest")
    ).withColumnRenamed("source", "__s"), "mix-ends")

    last = rows.join(ends, F.expr("source <=> __s")).where("__cell = __end").groupBy("source", "__q").agg(F.sum("size").alias("size"), F.max("__before").alias("b"), F.max("__rest").alias("r"))
    last = last.withColumn("upto", F.col("b") + F.sum("size").over(by_source.orderBy("__q")))
    # the head ends with the last row that brings the words taken no further from the rest
    cut = last.where("abs(upto - r) <= abs(upto - size - r)").groupBy("source").agg(F.max("__q").alias("__cut"))
    cut = scratch_table(ends.join(cut, F.expr("__s <=> source"), "left").select("__s", "__end", "__cut"), "mix-cuts")

    base = docs.drop(*results).withColumn("size", word_count()).withColumn("__text", F.xxhash64("text"))
    rows = ranked(base, "size", relative, key).join(cut, F.expr("source <=> __s"), "left").drop("__s")
    extra = F.coalesce((F.col("__cell") < F.col("__end")) | (F.col("__q") <= F.col("__cut")), F.lit(False))
    rows = rows.withColumn("copies", F.col("__whole") + extra.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return rows.drop("__wsize", "__e", "__whole", "__p", "__q", "__cell", "__end", "__cut", "__text", "__nth")
