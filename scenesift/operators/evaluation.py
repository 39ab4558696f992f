"""Evaluation reports over 7-DoF boxes, and box suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenesift.functions.boxes import BOX_FIELDS, _measures, box, footprint, giou3d, iou3d
from scenesift.session import cut_lineage

# Accuracy thresholds, loss weights, and annotation quality limits.
IOU_THRESHOLDS = (0.25, 0.5)
LOSS_WEIGHTS = {"l1": 5.0, "giou3d": 2.0, "yaw": 1.0}
# Boxes without extent live in cells of this width; room for rounding where volumes rule out an overlap.
MIN_EXTENT, VOLUME_SLACK = 1e-9, 1 - 1e-9
# Groups of up to so many boxes are settled where they lie; so many pairs of their boxes are compared at once.
GROUP_BOXES, PAIRS_AT_ONCE = 512, 1 << 18
MIN_CONFIDENCE, MIN_POINTS, MAX_ASPECT, MIN_DEPTH, MAX_DEPTH = 0.5, 100, 10.0, 0.1, 10.0


def grounding_metrics(pairs: DataFrame, rotated: bool = True) -> DataFrame:
    """Acc@0.25, Acc@0.5 and mean IoU per class and overall (class null)."""
    scored = pairs.select("class_name", iou3d(F.col("pred"), F.col("gt"), rotated).alias("iou"))
    hits = [F.avg((F.col("iou") >= t).cast("double")).alias("acc_" + str(t).replace("0.", "")) for t in IOU_THRESHOLDS]
    return scored.rollup("class_name").agg(F.count(F.lit(1)).alias("n"), *hits, F.avg("iou").alias("miou"))


def box_errors(pairs: DataFrame, rotated: bool = True) -> DataFrame:
    """Adds l1, yaw and giou3d error terms and their weighted total."""
    p, g = F.col("pred"), F.col("gt")
    l1 = sum((F.abs(p[f] - g[f]) for f in ("cy", "cz", "l", "w", "h")), F.abs(p["cx"] - g["cx"]))
    yaw = F.abs(F.sin(p["yaw"]) - F.sin(g["yaw"])) + F.abs(F.cos(p["yaw"]) - F.cos(g["yaw"]))
    rows = pairs.withColumns({"l1": l1, "yaw_error": yaw, "giou3d": 1.0 - giou3d(p, g, rotated)})
    total = F.col("l1") * LOSS_WEIGHTS["l1"] + F.col("giou3d") * LOSS_WEIGHTS["giou3d"] + F.col("yaw_error") * LOSS_WEIGHTS["yaw"]
    return rows.withColumn("total", total)


def match_predictions(pairs: DataFrame, key: list[str], order: list[str], rotated: bool = True) -> DataFrame:
    """Of the candidates of a sample, the one with the smallest cost against its ground truth.

    One ground truth per sample makes the assignment an argmin, which combines before
    the shuffle. ``order`` breaks ties.
    """
    cost = box_errors(pairs, rotated)
    best = cost.groupBy(*key).agg(F.min(F.struct("total", *order, "l1", "yaw_error", "giou3d")).alias("b"), F.count(F.lit(1)).alias("n_candidates"))
    return best.select(*key, "n_candidates", "b.*")


def _rank_key(score: str, tie: list[str]):
    return F.struct((-F.col(score)).alias("s"), *tie)


def overlap_edges(boxes: DataFrame, group: list[str], box_id: str, threshold: float, rotated: bool) -> DataFrame:
    """(group, winner, loser): pairs above the IoU threshold, the higher score wins.

    A hash grid of several levels: a box lives in the cells of the level whose width is
    the next power of two above its own, so it covers at most four. It asks there and in
    its cells of every coarser level in use, so a pair meets at the level of its larger
    box, and only in the cell of its common lower corner: no pair twice, whatever the
    spread of sizes. Pairs whose volumes alone rule out the threshold are dropped early.
    """
    if rotated:
        xs, ys = zip(*footprint(F.col("box")))
    else:
        xs, ys = ([F.col("box")[c] + F.col("box")[size] * half for half in (-0.5, 0.5)] for c, size in (("cx", "l"), ("cy", "w")))
    flat = boxes.select(
        *group, box_id, "rank_key", *[F.col("box")[f].alias("b_" + f) for f in BOX_FIELDS],
        F.least(*xs).alias("x0"), F.greatest(*xs).alias("x1"), F.least(*ys).alias("y0"), F.greatest(*ys).alias("y1"),
    )
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(MIN_EXTENT))
    flat = flat.withColumn("level", F.ceil(F.log2(extent)).cast("int"))
    # The exponents of doubles bound this list.
    in_use = sorted(r["level"] for r in flat.select("level").filter("level IS NOT NULL").distinct().collect())
    coarser = F.filter(F.array(*[F.lit(v) for v in in_use]).cast("array<int>"), lambda v: v >= F.col("level"))
    width = F.pow(F.lit(2.0), F.col("meet_level"))
    meet = group + ["meet_level", "cell_x", "cell_y"]

    def side(prefix, levels):
        tagged = flat.withColumn("meet_level", levels)
        for axis in "xy":
            low, high = F.floor(F.col(axis + "0") / width), F.floor(F.col(axis + "1") / width)
            tagged = tagged.withColumn("cell_" + axis, F.explode(F.sequence(low, high)))
        renamed = {box_id: prefix + "id", "rank_key": prefix + "rank", "level": prefix + "level", **{c: prefix + c for c in ("x0", "x1", "y0", "y1")}, **{"b_" + f: prefix + f for f in BOX_FIELDS}}
        return tagged.select(*meet, *[F.col(c).alias(n) for c, n in renamed.items()])

    pairs = side("h_", F.col("level")).join(side("a_", F.explode(coarser)), meet)
    pairs = pairs.filter((F.col("a_level") < F.col("h_level")) | (F.col("h_rank") < F.col("a_rank")))
    for axis in "xy":
        lower = F.greatest("h_" + axis + "0", "a_" + axis + "0")
        pairs = pairs.filter((lower <= F.least("h_" + axis + "1", "a_" + axis + "1")) & (F.floor(lower / width) == F.col("cell_" + axis)))
    volume = {p: F.col(p + "l") * F.col(p + "w") * F.col(p + "h") for p in ("h_", "a_")}
    pairs = pairs.filter(F.least(*volume.values()) >= F.greatest(*volume.values()) * (threshold * VOLUME_SLACK))
    first = F.col("h_rank") < F.col("a_rank")
    # Without headings the measure is the same both ways round. Otherwise the better box comes first; a Python function
    # keeps that choice out of the join, where it would be repeated for every number of the formula.
    sides = ("h_", "a_")
    if rotated:
        pairs = pairs.withColumns({side + f: F.when(first, F.col(x + f)).otherwise(F.col(y + f)) for side, x, y in (("better_", "h_", "a_"), ("worse_", "a_", "h_")) for f in BOX_FIELDS})
        sides = ("better_", "worse_")
    pairs = pairs.filter(iou3d(*[box(*[F.col(p + f) for f in BOX_FIELDS]) for p in sides], rotated) > threshold)
    return pairs.select(*group, F.when(first, F.col("h_id")).otherwise(F.col("a_id")).alias("winner"), F.when(first, F.col("a_id")).otherwise(F.col("h_id")).alias("loser"))


def nms3d(boxes: DataFrame, group: list[str], box_id: str, score: str, threshold: float, rotated: bool = True) -> DataFrame:
    """Boxes that survive suppression.

    Groups of at most ``GROUP_BOXES`` boxes are settled in one pass over their rows, which cross one shuffle by group at
    most. The boxes of larger groups are spread over a hash grid and decided in rounds.
    """
    counts = boxes.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP_BOXES)
    large = cut_lineage(counts.dropna(subset=group).select(*group))
    if not large.take(1):
        return settled_groups(boxes, group, box_id, score, threshold, rotated)
    few, many = (boxes.join(large, group, kind).select(*boxes.columns) for kind in ("left_anti", "left_semi"))
    return settled_groups(few, group, box_id, score, threshold, rotated).unionByName(settled_rounds(many, group, box_id, score, threshold, rotated))


def settled_groups(boxes: DataFrame, group: list[str], box_id: str, score: str, threshold: float, rotated: bool) -> DataFrame:
    """Surviving boxes of groups that fit into memory: sorted by rank, many groups at a time."""
    b = F.col("box")
    order = Window.partitionBy(*group).orderBy("_rank_key")
    numbers = {"_" + f: b[f] for f in BOX_FIELDS}
    if rotated:
        corners = footprint(b)
        numbers |= {"_c": F.cos(b["yaw"]), "_s": F.sin(b["yaw"])} | {f"_{a}{n}": c[k] for n, c in enumerate(corners) for k, a in enumerate("xy")}
    whole = F.lit(True)
    for column in group:
        whole = whole & F.col(column).isNotNull()
    ranked = boxes.withColumn("_rank_key", _rank_key(score, [box_id]))
    ranked = ranked.select(*boxes.columns, F.rank().over(order).alias("_rank"), (F.row_number().over(order) == 1).alias("_first"), whole.alias("_whole"))
    ranked = ranked.withColumns(numbers | {"_id": F.col(box_id).cast("string")})
    return ranked.mapInArrow(_group_settler(boxes.columns, threshold, rotated, PAIRS_AT_ONCE), boxes.schema)


def _group_settler(columns: list[str], threshold: float, rotated: bool, most: int):
    """Arrow function: boxes in the order of their groups and ranks -> those that survive.

    Tests and numbers are those of ``overlap_edges``, in its order of operations; the rounds are those of ``settled_rounds``.
    """
    overlap, slack = _measures()[0], VOLUME_SLACK

    def values(table):
        """(numbers by name, rows with all numbers); the ground box is that of the corners."""
        import numpy as np

        names = [c for c in table.column_names if c.startswith("_") and c not in ("_rank", "_first", "_whole", "_id") and c not in columns]
        if not rotated:
            names.remove("_yaw")
        there = np.asarray(table.column("_id").is_valid()) & table.column("_whole").to_numpy()
        v = {}
        for c in names:
            there &= np.asarray(table.column(c).is_valid())
            v[c] = table.column(c).fill_null(0.0).to_numpy()
        for axis, size in (("x", "_l"), ("y", "_w")):
            ends = [v[f"_{axis}{n}"] for n in range(4)] if rotated else [v["_c" + axis] + v[size] * half for half in (-0.5, 0.5)]
            v[axis + "0"], v[axis + "1"] = np.minimum.reduce(ends), np.maximum.reduce(ends)
        return v, there

    def above(v, a, b):
        """Whether box ``b`` overlaps the better box ``a`` by more than the threshold."""
        import numpy as np
        import pyarrow as pa

        near = np.ones(len(a), dtype=bool)
        for axis in "xy":
            near &= np.maximum(v[axis + "0"][a], v[axis + "0"][b]) <= np.minimum(v[axis + "1"][a], v[axis + "1"][b])
        volume = v["_l"] * v["_w"] * v["_h"]
        near &= np.minimum(volume[a], volume[b]) >= np.maximum(volume[a], volume[b]) * (threshold * slack)
        at = np.nonzero(near)[0]
        a, b = a[at], b[at]

        def span(centre, size):
            low = np.maximum(v[centre][a] - v[size][a] / 2, v[centre][b] - v[size][b] / 2)
            high = np.minimum(v[centre][a] + v[size][a] / 2, v[centre][b] + v[size][b] / 2)
            return np.maximum(high - low, 0.0)

        ground = span("_cx", "_l") * span("_cy", "_w")
        if rotated:
            turned = np.nonzero((v["_yaw"][a] != 0) | (v["_yaw"][b] != 0))[0]
            sides = [pa.array(v[c][x[turned]]) for x in (a, b) for c in ("_cx", "_cy", "_l", "_w", "_c", "_s")]
            ground[turned] = overlap(*sides).to_numpy()
        shared = ground * span("_cz", "_h")
        joint = volume[a] + volume[b] - shared
        good = (joint != 0) & (shared / np.where(joint != 0, joint, 1.0) > threshold)
        return a[good], b[good]

    def edges(table, first):
        """(better, worse) rows of every pair of a group above the threshold."""
        import numpy as np

        v, there = values(table)
        rank = table.column("_rank").to_numpy()
        rows = np.arange(table.num_rows)
        ends = np.append(np.nonzero(first)[0], table.num_rows)
        left = ends[np.cumsum(first)] - rows - 1
        left[~there] = 0
        upto = np.cumsum(left)
        found, start = [], 0
        while start < len(rows):
            done = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, done + most, side="right")))
            n = left[start:stop]
            a = np.repeat(rows[start:stop], n)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            good = there[b] & (rank[a] < rank[b])
            found.append(above(v, a[good], b[good]))
            start = stop
        return [np.concatenate([f[k] for f in found]) if found else np.zeros(0, "int64") for k in (0, 1)]

    def survivors(table):
        import numpy as np
        import pyarrow as pa

        first = table.column("_first").to_numpy() | ~table.column("_whole").to_numpy()
        winner, loser = edges(table, first)
        table_out = table.select(columns)
        if not len(winner):
            return table_out
        ids = table.column("_id").combine_chunks().dictionary_encode()
        code = ids.indices.fill_null(len(ids.dictionary)).to_numpy(zero_copy_only=False).astype("int64")
        node = np.unique((np.cumsum(first) - 1) * (len(ids.dictionary) + 1) + code, return_inverse=True)[1]
        winner, loser = node[winner], node[loser]
        lost = np.zeros(node.max() + 1, dtype=bool)
        while len(winner):
            beaten = np.zeros(len(lost), dtype=bool)
            beaten[loser] = True
            kept = ~beaten[winner]
            if not kept.any():
                break
            lost[loser[kept]] = True
            still = ~(lost[winner] | lost[loser])
            winner, loser = winner[still], loser[still]
        return table_out.filter(pa.array(~lost[node]))

    def settle(batches):
        import numpy as np
        import pyarrow as pa

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
            starts = np.nonzero(table.column("_first").to_numpy() | ~table.column("_whole").to_numpy())[0]
            # The last group may go on in the next batch.
            cut = int(starts[-1]) if len(starts) else 0
            if cut:
                yield from survivors(table.slice(0, cut)).to_batches()
            held = table.slice(cut)
        if held is not None:
            yield from survivors(held).to_batches()

    return settle


def settled_rounds(boxes: DataFrame, group: list[str], box_id: str, score: str, threshold: float, rotated: bool) -> DataFrame:
    """Surviving boxes of groups of any size, decided in rounds over the overlap graph.

    A box survives once every better neighbour is suppressed and is suppressed once a
    better neighbour survives. Each round settles at least the best open box of every
    overlapping set; boxes without overlap are settled at once.
    """
    ranked = boxes.withColumn("rank_key", _rank_key(score, [box_id]))
    edges = cut_lineage(overlap_edges(ranked, group, box_id, threshold, rotated))
    node = group + ["node"]
    open_edges = edges
    lost = None
    while True:
        losers = open_edges.select(*group, F.col("loser").alias("node")).distinct()
        winners = open_edges.select(*group, F.col("winner").alias("node")).distinct()
        kept = winners.join(losers, node, "left_anti")
        beaten = open_edges.join(kept.withColumnRenamed("node", "winner"), group + ["winner"], "left_semi")
        out = cut_lineage(beaten.select(*group, F.col("loser").alias("node")).distinct())
        lost = out if lost is None else lost.unionByName(out)
        if not out.take(1):
            break
        gone = out.withColumnRenamed("node", "winner")
        open_edges = open_edges.join(out.withColumnRenamed("node", "loser"), group + ["loser"], "left_anti")
        open_edges = cut_lineage(open_edges.join(gone, group + ["winner"], "left_anti"))
    return boxes.join(lost.withColumnRenamed("node", box_id), group + [box_id], "left_anti")


def quality_filter(annotations: DataFrame, min_confidence=MIN_CONFIDENCE, min_points=MIN_POINTS, max_aspect=MAX_ASPECT, min_depth=MIN_DEPTH, max_depth=MAX_DEPTH) -> DataFrame:
    """Adds ``reason`` (null when accepted) and ``is_valid``.

    ``annotations``: confidence, num_points, l, w, h, depth of the box centre.
    """
    longest, shortest = F.greatest("l", "w", "h"), F.least("l", "w", "h")
    reason = (
        F.when(F.col("confidence") < min_confidence, "low confidence")
        .when(F.col("num_points") < min_points, "too few points")
        .when((shortest <= 0) | (longest > shortest * max_aspect), "bad aspect ratio")
        .when((F.col("depth") < min_depth) | (F.col("depth") > max_depth), "depth out of range")
    )
    return annotations.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull())


def annotation_report(statuses: DataFrame) -> DataFrame:
    """Counts per status (success, failed, filtered)."""
    return statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
