"""Dataset statistics over emitted samples.

``samples``: one row per sample with path, pos, scene_id, frame_id, object_id and
category. ``files``: one row per parsed file with path and scene_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def category_stats(samples: DataFrame) -> DataFrame:
    """Counts per category with the first place it was seen.

    Three nested aggregations stand for the two distinct counts: a category that holds
    a third of all samples is spread over its objects first, and nothing is expanded.
    """
    place = F.struct("path", "pos")
    objects = samples.groupBy("category", "scene_id", "frame_id", "object_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(place).alias("first")
    )
    scenes = objects.groupBy("category", "scene_id").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("objects"), F.min("first").alias("first")
    )
    rows = scenes.groupBy("category").agg(
        F.sum("n").alias("sample_count"), F.sum("objects").alias("object_count"),
        F.count(F.lit(1)).alias("scene_count"), F.min("first").alias("first_seen"),
    )
    return with_ratio(rows)


def with_ratio(rows: DataFrame) -> DataFrame:
    """Adds each row's share of all samples; the total is one row by construction, so it is broadcast."""
    total = rows.agg(F.sum("sample_count").alias("_total"))
    return rows.crossJoin(F.broadcast(total)).withColumn("ratio", F.col("sample_count") / F.col("_total")).drop("_total")


def ordered_categories(stats: DataFrame) -> DataFrame:
    return stats.orderBy(F.desc("sample_count"), "first_seen")


def stats_overview(files: DataFrame, samples: DataFrame) -> DataFrame:
    """One summary row; a file without samples still counts its scene."""
    per_scene = files.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))
    from_files = per_scene.agg(F.count(F.lit(1)).alias("total_scenes"), F.coalesce(F.sum("n"), F.lit(0)).alias("source_file_count"))
    per_category = samples.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    from_samples = per_category.agg(F.count(F.lit(1)).alias("total_categories"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_samples"))
    # Two single rows side by side.
    both = from_files.crossJoin(F.broadcast(from_samples))
    average = F.when(F.col("total_scenes") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("total_samples"), F.col("total_scenes")))
    return both.select("total_scenes", "total_categories", "total_samples", "source_file_count", average.alias("avg_samples_per_scene"))


def scene_distribution(samples: DataFrame) -> DataFrame:
    return samples.groupBy("scene_id").agg(F.count(F.lit(1)).alias("sample_count")).orderBy(F.desc("sample_count"), "scene_id")


def count_samples(files: DataFrame) -> DataFrame:
    """Samples per directory and overall (directory null). ``files`` has source_dir and n_samples."""
    return files.rollup("source_dir").agg(F.sum(F.coalesce("n_samples", F.lit(0)).cast("long")).alias("n_samples"))


def full_mapping(stats: DataFrame, mapping: DataFrame) -> DataFrame:
    """(category, merged): categories without a rule map to themselves."""
    rules = mapping.select("category", F.col("merged").alias("_m"))
    return stats.join(rules, "category", "left").select("category", F.coalesce("_m", "category").alias("merged"))


def merge_categories(stats: DataFrame, mapping: DataFrame) -> DataFrame:
    """Counts summed per merged category; scene counts are summed, not re-counted."""
    rules = mapping.select("category", F.col("merged").alias("_m"))
    merged = stats.join(rules, "category", "left").groupBy(F.coalesce("_m", "category").alias("category")).agg(
        *[F.sum(c).alias(c) for c in ("sample_count", "object_count", "scene_count")]
    )
    return with_ratio(merged).orderBy(F.desc("sample_count"), "category")


def merge_summary(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count(F.lit(1)).alias("merged_category_count"), F.coalesce(F.sum("sample_count"), F.lit(0)).alias("total_samples"))


# Fixed value: most bins of the samples-per-scene histogram.
MAX_BINS = 20


def scene_hist(distribution: DataFrame) -> DataFrame:
    """Equal-width histogram of samples per scene (bin, low, high, n_scenes), last bin closed.

    Values first collapse to (value, scenes), so the range row and the bins are small.
    """
    values = distribution.groupBy(F.col("sample_count").cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    span = values.agg(
        F.coalesce(F.min("v"), F.lit(0.0)).alias("lo"), F.coalesce(F.max("v"), F.lit(0.0)).alias("hi"),
        F.greatest(F.lit(1), F.least(F.lit(MAX_BINS), F.count(F.lit(1)))).cast("int").alias("bins"), F.count(F.lit(1)).alias("n_values"),
    )
    single = F.col("lo") == F.col("hi")
    span = span.select(
        F.when(single, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(single, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), "bins", "n_values",
    )
    edges = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    step = (F.col("hi") - F.col("lo")) / F.col("bins")
    edges = edges.select("bin", "bins", "n_values", (F.col("lo") + F.col("bin") * step).alias("low"),
                         F.when(F.col("bin") == F.col("bins") - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * step).alias("high"))
    last = F.col("bin") == F.col("bins") - 1
    inside = (F.col("v") >= F.col("low")) & (F.when(last, F.col("v") <= F.col("high")).otherwise(F.col("v") < F.col("high")))
    # At most 20 edge rows are broadcast to the distinct values.
    hits = values.join(F.broadcast(edges), inside).groupBy("bin").agg(F.sum("n").alias("n"))
    counted = edges.join(hits, "bin", "left")
    n = F.when(F.col("n_values") == 0, F.lit(1)).otherwise(F.coalesce("n", F.lit(0)))
    return counted.select("bin", "low", "high", n.cast("long").alias("n_scenes"))


def top_categories(stats: DataFrame, k: int) -> DataFrame:
    return ordered_categories(stats).limit(k)


def category_topk_others(stats: DataFrame, k: int) -> DataFrame:
    """The first k categories and the sum of the rest as ``others``; no category gives one ``empty`` row."""
    top = top_categories(stats, k).select(F.col("category").alias("label"), F.col("sample_count").alias("size"))
    rest = stats.agg(F.coalesce(F.sum("sample_count"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("n"))
    shown = top.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("shown"))
    extra = rest.crossJoin(F.broadcast(shown)).select(
        F.when(F.col("n") == 0, F.lit("empty")).when(F.col("total") > F.col("shown"), F.lit("others")).alias("label"),
        F.when(F.col("n") == 0, F.lit(1)).otherwise(F.col("total") - F.col("shown")).cast("long").alias("size"),
    )
    return top.unionByName(extra.filter(F.col("label").isNotNull()))


def merged_boxplot(merged: DataFrame) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and outliers of the merged counts, one row.

    Counts collapse to (value, categories) first; quartiles, whiskers and outliers come from that table.
    """
    values = merged.groupBy(F.col("sample_count").cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    quart = values.agg(F.expr("percentile(v, array(0.25D, 0.5D, 0.75D), n)").alias("q")).select(
        *[F.get("q", F.lit(n)).alias(name) for n, name in enumerate(("q1", "median", "q3"))]
    )
    # One row by construction.
    tagged = values.crossJoin(F.broadcast(quart))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    low_in, high_in = F.col("v") >= F.col("q1") - reach, F.col("v") <= F.col("q3") + reach
    return tagged.groupBy("q1", "median", "q3").agg(
        F.least(F.min(F.when(low_in, F.col("v"))), F.first("q1")).alias("whisker_low"),
        F.greatest(F.max(F.when(high_in, F.col("v"))), F.first("q3")).alias("whisker_high"),
        F.sum(F.when(~(low_in & high_in), F.col("n")).otherwise(F.lit(0))).alias("n_outliers"),
        F.sum(F.when(~(low_in & high_in), F.col("v") * F.col("n"))).alias("outlier_sum"),
    )


def boxplot_outliers(merged: DataFrame) -> DataFrame:
    box = merged_boxplot(merged).select("whisker_low", "whisker_high")
    rows = merged.crossJoin(F.broadcast(box))
    return rows.filter((F.col("sample_count") < F.col("whisker_low")) | (F.col("sample_count") > F.col("whisker_high"))).drop(
        "whisker_low", "whisker_high"
    )


def limit_samples(samples: DataFrame, exported: DataFrame, n: int, overwrite: bool = False) -> DataFrame:
    """First n samples, in file order, that have no output yet (all of them with ``overwrite``)."""
    todo = samples if overwrite else samples.join(exported.select("sample_id"), "sample_id", "left_anti")
    return todo.orderBy("path", "pos").limit(n)


def summary_lines(overview: DataFrame, stats: DataFrame, k: int = 10) -> DataFrame:
    """Text summary as numbered lines: totals, then the first k categories."""
    names = ("total_scenes", "total_categories", "total_samples", "source_file_count")
    facts = [F.struct(F.lit(n).alias("line_no"), F.format_string(f"{c}: %d", F.col(c).cast("long")).alias("line")) for n, c in enumerate(names)]
    facts.append(F.struct(F.lit(4).alias("line_no"), F.format_string("avg_samples_per_scene: %.2f", "avg_samples_per_scene").alias("line")))
    facts.append(F.struct(F.lit(5).alias("line_no"), F.lit(f"Top {k}").alias("line")))
    head = overview.select(F.explode(F.array(*facts)).alias("f")).select("f.line_no", "f.line")
    top = top_categories(stats, k)
    order = Window.partitionBy().orderBy(F.desc("sample_count"), "first_seen")
    text = F.format_string("%s: samples=%d, objects=%d, scenes=%d, ratio=%.2f%%", "category", "sample_count", "object_count", "scene_count", F.col("ratio") * 100)
    return head.unionByName(top.select((F.row_number().over(order) + 5).alias("line_no"), text.alias("line"))).orderBy("line_no")
