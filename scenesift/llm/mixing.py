"""Mixing sources to target weights by weighted sampling with exponential keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenesift.llm.common import stored

#: Weights dealt to the sources in code-point order, repeating.
CYCLE = (3.0, 1.0, 2.0)
#: Documents that one sorted piece of a source should hold.
PIECE_ROWS = 4000


def word_count(text: Column) -> Column:
    """Words of a text split at ASCII blanks; 0 for null."""
    blank = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(blank, r"[\x20\x09-\x0D]+", "")).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the MD5 of seed and key; it repeats on every run and every retry."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**13))


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, cycle: tuple = CYCLE) -> DataFrame:
    """(source_dir, source_size, target) from (source_dir, source_size): the level that fills all caps in turn.

    Every source gets min(cap * size, level * weight) with one level for all, so that the targets add up to
    ``share`` of all sizes. Sources are sorted by cap over weight; those before the level's place are full.
    """
    order = Window.orderBy(F.col("source_dir").asc_nulls_last())
    nth = F.row_number().over(order) - 1
    weights = F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.pmod(nth, F.lit(len(cycle))) + 1).cast("int"))
    # The windows below run over one row for each source.
    rows = sizes.withColumn("weight", weights).withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("full_at", F.col("most") / F.col("weight"))
    order = Window.orderBy("full_at", F.col("source_dir").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = rows.withColumns({
        "place": F.row_number().over(order),
        "full": F.coalesce(F.sum("most").over(upto), F.lit(0.0)),
        "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)),
        "total": F.lit(share) * F.sum("source_size").over(every),
    })
    level = (F.col("total") - F.col("full")) / F.col("open")
    # The first source that its level does not fill sets the level of all; before it every source is full.
    rows = rows.withColumn("level", F.min(F.when(level <= F.col("full_at"), F.struct("place", level.alias("level")))).over(every)["level"])
    target = F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return rows.select("source_dir", "source_size", target.alias("target"))


def mix_sources(samples: DataFrame, key: str = "sample_id", text: str = "text", source: str = "source_dir", quality: Column | None = None,
                share: float = 1.5, cap: float = 2.0, cycle: tuple = CYCLE, seed: int = 7, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """How many words of every sample text a mix of the source folders takes.

    ``samples`` has a sample id, its text and the output root (``source_dir``) it came from. Sources in code-point
    order (null last) weigh 3, 1, 2, repeating; see ``source_targets``. A source's whole epochs come first: each
    sample is taken floor(target / size) times. The rest is filled in the order of the exponential keys
    -ln(u) / quality, u drawn from the sample id: a sample counts once more while the middle of its words lies
    within what is left, so a source misses its target by half a sample at most, and no sample counts more than
    ``cap`` times. ``quality`` (default: the share of letters among the text's characters, from 0.1 to 1.1) is the
    sampling weight.

    The order within a source is cut into pieces by ranges of the key, so a source with a third of all rows is sorted
    by many tasks; each piece starts at the sum of the pieces before it.

    Returns (key, source, size, source_size, target, epochs, taken), one row for each input row. Null and empty texts
    have size 0 and take 0. Ids may be null or repeat. Empty input gives no rows.
    """
    letters = F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", ""))
    quality = 0.1 + letters / F.greatest(F.length(text), F.lit(1)) if quality is None else quality
    rows = samples.select(
        F.col(key).alias("_key"), F.col(source).alias("source_dir"), word_count(F.col(text)).alias("size"),
        F.coalesce(-F.log(uniform(F.col(key), seed)) / F.greatest(quality, F.lit(1e-6)), F.lit(1e9)).alias("rank"),
    )
    # Four numbers a sample, read three times below: written once instead of counting the words of all texts again.
    rows = stored(rows)
    thousandths = F.sum(F.least(F.col("rank"), F.lit(1e6)).cast("decimal(12,3)"))
    sizes = rows.groupBy("source_dir").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"), thousandths.cast("double").alias("rank_sum"))
    targets = source_targets(sizes.select("source_dir", "source_size"), share, cap, cycle)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", whole).withColumn("left", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0)))
    targets = targets.join(sizes.select("n_rows", "rank_sum", F.col("source_dir").alias("_s")), F.col("source_dir").eqNullSafe(F.col("_s"))).drop("_s")
    # Keys over their mean are about exponential, so exp() spreads them evenly; pieces need only be in order.
    dealt = rows.join(targets.withColumnRenamed("source_dir", "_s"), F.col("source_dir").eqNullSafe(F.col("_s"))).drop("_s")
    pieces = F.floor((1 - F.exp(-F.col("rank") * F.col("n_rows") / F.col("rank_sum"))) * F.ceil(F.col("n_rows") / piece_rows)).cast("long")
    dealt = dealt.withColumn("piece", pieces)
    before = Window.partitionBy("source_dir").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("source_dir", "piece").agg(F.sum("size").alias("words")).select(
        F.col("source_dir").alias("_s"), F.col("piece").alias("_p"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("source_dir", "piece").orderBy("rank", F.col("_key").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("end", F.sum("size").over(within)).join(
        starts, F.col("source_dir").eqNullSafe(F.col("_s")) & (F.col("piece") == F.col("_p")))
    middle = F.col("start") + F.col("end") - F.col("size") / 2
    once = F.when((F.col("left") > 0) & (middle <= F.col("left")), F.col("size")).otherwise(F.lit(0))
    return placed.select(
        F.col("_key").alias(key), F.col("source_dir").alias(source), "size", "source_size", "target", "epochs",
        (F.col("epochs") * F.col("size") + once).cast("long").alias("taken"),
    )
