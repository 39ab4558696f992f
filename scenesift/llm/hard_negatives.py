"""Hard negatives for grounding: angular bounds from reference directions, integer scores only where they overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenesift.llm.common import stored

#: Rows of the bounded sample that the reference directions are fitted on, and how many directions there are.
FIT_ROWS = 2048
DIRECTIONS = 16
#: Rows of a run with one bound, of a part that one task holds, and anchors of a block.
RUN = 64
PART_ROWS = 32_768
LEAST_PART_ROWS = 2048
BLOCK_ANCHORS = 32_768
CHUNK_ANCHORS = 64
#: Square of the largest norm whose inner products always fit a 64-bit integer.
MAX_SQUARE = 2.0**62
#: What rounding may add to an angle: arc cosines near 1 keep half of the digits.
ANGLE_SLACK = 1e-7


# ---- vectors ----


def quantize(features: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of each value, floor(scale * value)) over all values of the rows that have finite components only."""
    sizes = pc.fill_null(pc.list_value_length(features), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = features.flatten()
    values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(features)), sizes)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(scale * values)
    return owner, scaled


def pack(vector: np.ndarray) -> bytes:
    """The vector as the narrowest of 16, 32 and 64-bit integers, the width in front."""
    top = int(np.abs(vector).max()) if len(vector) else 0
    width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return bytes([width]) + vector.astype(f"<i{width}").tobytes()


def unpack(packed: list[bytes], dim: int) -> np.ndarray:
    """The vectors as rows of ``dim`` integers, shorter ones filled up with 0."""
    out = np.zeros((len(packed), dim), np.int64)
    kinds: dict[tuple[int, int], list[int]] = {}
    for n, p in enumerate(packed):
        kinds.setdefault((p[0], len(p)), []).append(n)
    for (width, size), rows in kinds.items():
        flat = np.frombuffer(b"".join(packed[n][1:] for n in rows), f"<i{width}")
        out[rows, : (size - 1) // width] = flat.reshape(len(rows), -1)
    return out


def dimension(packed: list[bytes]) -> int:
    return max(((len(p) - 1) // p[0] for p in packed), default=0)


def angles_to(vectors: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angle of each vector to each direction; 0 for a zero vector."""
    dim = max(vectors.shape[1], directions.shape[1])
    v, d = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (vectors.astype(float), directions))
    return np.arccos(np.clip(v @ d.T / np.maximum(norms, 1e-300)[:, None], -1, 1)) * (norms > 0)[:, None]


def fit_directions(vectors: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Unit directions in the middle of groups of a sample: spherical k-means from rows that lie far apart."""
    vectors = vectors[np.any(vectors != 0, axis=1)].astype(float)
    if not len(vectors):
        return np.zeros((0, 0))
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    chosen = [0]
    near = unit @ unit[0]
    while len(chosen) < min(count, len(unit)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    centres = unit[chosen]
    for _ in range(rounds):
        home = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, unit)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centres)
    return centres


# ---- bounds and scores in a task ----


def score_bounds(angles: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the score of each anchor with any row of each run, from the triangle inequality for angles.

    An anchor at angle a to a direction and a run between ``low`` and ``high`` are at least max(a - high, low - a) and
    at most min(a + high, 2 pi - a - low) apart; over all directions the tightest counts. ``least`` and ``most`` are the
    norms of a run. Angles are widened by ``ANGLE_SLACK`` and scores by one, so rounding never cuts off a row.
    """
    near, far = np.zeros((len(angles), len(low))), np.full((len(angles), len(low)), np.pi)
    for d in range(angles.shape[1]):
        a, b, c = angles[:, d : d + 1], low[None, :, d], high[None, :, d]
        np.maximum(near, np.maximum(a - c, b - a), out=near)
        np.minimum(far, np.minimum(a + c, 2 * np.pi - a - b), out=far)
    above, below = np.cos(np.maximum(near - ANGLE_SLACK, 0)), np.cos(np.minimum(far + ANGLE_SLACK, np.pi))
    upper = norms[:, None] * above * np.where(above >= 0, most, least)
    lower = norms[:, None] * below * np.where(below >= 0, least, most)
    return lower - 1 - np.abs(lower) * 1e-9, upper + 1 + np.abs(upper) * 1e-9


class Side:
    """Rows of one side of a task, in order of class, nearest direction and angle."""

    def __init__(self, table: pa.Table, codes: np.ndarray, dim: int):
        self.row = table.column("row").to_numpy()
        self.code = codes
        self.norm = table.column("norm").to_numpy()
        self.angles = np.frombuffer(b"".join(table.column("angles").to_pylist()), "<f8").reshape(len(self.row), -1)
        self.vectors = unpack(table.column("vector").to_pylist(), dim)
        near = self.angles.argmin(axis=1) if self.angles.shape[1] else np.zeros(len(self.row), np.int64)
        angle = self.angles[np.arange(len(near)), near] if self.angles.shape[1] else np.zeros(len(self.row))
        self.order = np.lexsort((self.row, angle, near, self.code))
        for name in ("row", "code", "norm", "angles", "vectors"):
            setattr(self, name, getattr(self, name)[self.order])


def runs_of(side: Side) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of runs of up to RUN rows of one class."""
    n = len(side.row)
    edges = np.concatenate(([0], np.flatnonzero(np.diff(side.code)) + 1, [n]))
    starts = np.concatenate([np.arange(a, b, RUN) for a, b in zip(edges, edges[1:])])
    return starts, np.append(starts[1:], n)


def two_sides(anchors: pa.Table, rows: pa.Table) -> tuple[Side, Side]:
    classes = pa.chunked_array([*anchors.column("class").chunks, *rows.column("class").chunks], type=rows.schema.field("class").type)
    codes = classes.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    packed = [t.column("vector").to_pylist() for t in (anchors, rows)]
    dim = max(dimension(packed[0]), dimension(packed[1]))
    return Side(anchors, codes[: len(anchors)], dim), Side(rows, codes[len(anchors) :], dim)


def id_places(rows: pa.Table, order: np.ndarray) -> np.ndarray:
    """Place of each row by id, null last, then by row number."""
    by_id = pc.sort_indices(rows, sort_keys=[("key", "ascending"), ("row", "ascending")], null_placement="at_end").to_numpy()
    place = np.empty(len(by_id), np.int64)
    place[by_id] = np.arange(len(by_id))
    return place[order]


def scores(a: Side, b: Side, some: slice | np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Exact integer scores; as doubles where every sum stays below 2^53, else as integers."""
    left, right = a.vectors[some], b.vectors[columns]
    if float(a.norm.max()) * float(b.norm.max()) < 2.0**52:
        return left.astype(float) @ right.T.astype(float)
    return left @ right.T


def best(score: np.ndarray, fits: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, column) of the first k fitting scores of each line, higher scores first, ties by place."""
    none = -np.inf if score.dtype.kind == "f" else np.iinfo(np.int64).min
    held = np.where(fits, score, none)
    if held.shape[1] > k:
        bound = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
        fits = fits & (held >= bound[:, None])
    line, column = np.nonzero(fits)
    order = np.lexsort((place[column], -held[line, column], line))
    line, column = line[order], column[order]
    first = np.searchsorted(line, line)
    keep = np.arange(len(line)) - first < k
    return line[keep], column[keep]


def _spans(starts: np.ndarray, ends: np.ndarray, which: np.ndarray) -> np.ndarray:
    """All rows of the runs ``which``."""
    size = ends[which] - starts[which]
    return np.repeat(starts[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _chunks(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple]:
    """(sides, chunk of anchors, runs, bounds) for each chunk of anchors that lie near each other."""
    a, b = two_sides(anchors, rows)
    starts, ends = runs_of(b)
    low, high = np.minimum.reduceat(b.angles, starts, axis=0), np.maximum.reduceat(b.angles, starts, axis=0)
    least, most = np.minimum.reduceat(b.norm, starts), np.maximum.reduceat(b.norm, starts)
    for at in range(0, len(a.row), CHUNK_ANCHORS):
        some = slice(at, at + CHUNK_ANCHORS)
        yield a, b, some, starts, ends, *score_bounds(a.angles[some], a.norm[some], low, high, least, most)


def positives_in(anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The first k rows of the anchor's class in one part, for every anchor."""
    out = {name: [] for name in ("anchor", "row", "key", "score")}
    if len(anchors) and len(rows):
        for a, b, some, starts, ends, lower, upper in _chunks(anchors, rows):
            if not out["anchor"]:
                place, keys = id_places(rows, b.order), rows.column("key").combine_chunks()
            same = a.code[some, None] == b.code[starts][None, :]
            # The k + 1 rows with the highest lower bounds (one may be the anchor) are a floor for the k-th score.
            floor = np.where(same, lower, -np.inf)
            order = np.argsort(-floor, axis=1)
            held = np.cumsum(np.where(np.take_along_axis(same, order, 1), (ends - starts)[order], 0), axis=1) > k
            at = np.argmax(held, axis=1)
            floor = np.where(held.any(axis=1), floor[np.arange(len(at)), order[np.arange(len(at)), at]], -np.inf)
            wanted = same & (upper >= floor[:, None])
            columns = _spans(starts, ends, np.flatnonzero(wanted.any(axis=0)))
            score = scores(a, b, some, columns)
            fits = (a.code[some, None] == b.code[columns][None, :]) & (a.row[some, None] != b.row[columns][None, :])
            line, column = best(score, fits, place[columns], k)
            out["anchor"].append(a.row[some][line])
            out["row"].append(b.row[columns[column]])
            out["key"].append(keys.take(pa.array(b.order[columns[column]])))
            out["score"].append(score[line, column].astype(np.int64))
    return _table(out, rows.schema.field("key").type)


def negatives_in(anchors: pa.Table, rows: pa.Table, k: int, low_percent: int, high_percent: int) -> pa.Table:
    """The first k rows of other classes within the score window of each positive score, in one part."""
    out = {name: [] for name in ("anchor", "positive_score", "row", "key", "score")}
    if len(anchors) and len(rows):
        asked = anchors.column("asked").to_pylist()
        for a, b, some, starts, ends, lower, upper in _chunks(anchors, rows):
            if not out["anchor"]:
                place, keys = id_places(rows, b.order), rows.column("key").combine_chunks()
            asks = [asked[n] for n in a.order[some]]
            other = a.code[some, None] != b.code[starts][None, :]
            windows = [[(p, -(-low_percent * p // 100), high_percent * p // 100) for p in ask] for ask in asks]
            bottom = np.array([min((w[1] for w in ws), default=0) for ws in windows], float)
            top = np.array([max((w[2] for w in ws), default=-1) for ws in windows], float)
            wanted = other & (upper >= bottom[:, None]) & (lower <= top[:, None]) & (bottom <= top)[:, None]
            columns = _spans(starts, ends, np.flatnonzero(wanted.any(axis=0)))
            if not len(columns):
                continue
            score = scores(a, b, some, columns)
            other = a.code[some, None] != b.code[columns][None, :]
            for nth in range(max(map(len, windows))):
                mine = [w[nth] if nth < len(w) else (0, 1, 0) for w in windows]
                least, most = (np.array([m[i] for m in mine], np.int64).astype(score.dtype)[:, None] for i in (1, 2))
                line, column = best(score, other & (score >= least) & (score <= most), place[columns], k)
                out["anchor"].append(a.row[some][line])
                out["positive_score"].append(np.array([m[0] for m in mine], np.int64)[line])
                out["row"].append(b.row[columns[column]])
                out["key"].append(keys.take(pa.array(b.order[columns[column]])))
                out["score"].append(score[line, column].astype(np.int64))
    return _table(out, rows.schema.field("key").type)


def _table(out: dict, key_type: pa.DataType) -> pa.Table:
    join = lambda parts: pa.array(np.concatenate(parts), pa.int64()) if parts else pa.array([], pa.int64())
    keys = pa.chunked_array(out["key"], key_type) if out["key"] else pa.array([], key_type)
    return pa.table({name: keys if name == "key" else join(parts) for name, parts in out.items()})


# ---- the operator ----


def _index(samples: DataFrame, scale: float, directions: int, fit_rows: int) -> DataFrame:
    """(row, key, class, asks, vector, norm, angles, near, angle) of (key, class, asks, feature), for all that take part."""
    rows = samples.select(F.monotonically_increasing_id().alias("row"), "key", "class", "asks", "feature")
    rows = rows.filter(F.col("class").isNotNull() & F.col("feature").isNotNull())
    packed_schema = T.StructType([*rows.schema.fields[:4], T.StructField("vector", T.BinaryType()), T.StructField("norm", T.DoubleType())])

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, scaled = quantize(batch.column("feature"), scale)
            with np.errstate(over="ignore", invalid="ignore"):
                square = np.bincount(owner, scaled * scaled, len(batch))
            good = np.flatnonzero(square <= MAX_SQUARE)  # not so for any null, NaN or infinite component
            bounds = np.searchsorted(owner, np.arange(len(batch) + 1))
            vectors = [pack(scaled[bounds[n] : bounds[n + 1]].astype(np.int64)) for n in good]
            taken = batch.take(pa.array(good))
            yield pa.record_batch([*taken.columns[:4], pa.array(vectors, pa.binary()), pa.array(np.sqrt(square[good]))], names=packed_schema.fieldNames())

    packed = stored(rows.mapInArrow(pack_rows, packed_schema))
    fit = packed.orderBy(F.xxhash64("row"), "row").select("vector").limit(fit_rows).toArrow().column("vector").to_pylist()
    towards = fit_directions(unpack(fit, dimension(fit)), directions)
    schema = T.StructType([*packed_schema.fields, T.StructField("angles", T.BinaryType()), T.StructField("near", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            norms = batch.column("norm").to_numpy()
            angles = angles_to(unpack(vectors, dimension(vectors)), norms, towards) if len(towards) else np.zeros((len(batch), 0))
            near = angles.argmin(axis=1) if len(towards) else np.zeros(len(batch), np.int64)
            angle = angles[np.arange(len(batch)), near] if len(towards) else np.zeros(len(batch))
            yield pa.record_batch([*batch.columns, pa.array([a.tobytes() for a in angles], pa.binary()), pa.array(near, pa.int32()), pa.array(angle)], names=schema.fieldNames())

    return packed.mapInArrow(measure, schema)


def mine_hard_negatives(samples: DataFrame, anchors: Column, key: str = "sample_id", label: str = "class_name", feature: str = "feature", positives: int = 5,
                        negatives: int = 3, low_percent: int = 50, high_percent: int = 95, scale: float = 256.0, directions: int = DIRECTIONS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Hard negatives for grounding samples: samples of other classes whose features are nearly as close as a positive.

    ``samples`` has a sample id, the class of its object and a feature vector (an array, of one text prompt or object
    crop). ``anchors`` is a condition on ``samples`` that says which of them ask. Components become
    floor(scale * component); a score is the integer inner product with the anchor, higher ones first, ties by
    smaller id. An anchor's positives are its first ``positives`` other samples of its class. For each of them the
    first ``negatives`` samples of other classes are returned whose score lies between ``low_percent`` and
    ``high_percent`` of the positive's.

    Angular triangle filter: every sample stores its angles to reference directions (spherical k-means over
    ``fit_rows`` rows drawn by hash). Samples are ordered by class, nearest direction and angle and cut into parts;
    in a part, runs of 64 have ranges of angles and norms. Angles of the anchor bound the cosine to a run, the norms
    turn that into score bounds, widened against rounding, and only runs whose bounds meet the wanted scores get
    integer scores. Parts hold at most about 32,768 samples whatever the classes; anchors go to parts in blocks.

    Returns (anchor_id, positive_id, rank, negative_id, positive_score, negative_score); rank counts from 1. Samples
    with a null class, a null vector, or a null, NaN or infinite component take no part, nor do those whose scaled
    norm is above 2^31 (their scores need not fit a long). A shorter vector counts as filled up with 0. A null id comes
    last in ties; rows with equal ids are different samples, each an anchor of its own if ``anchors`` says so. Other
    columns may be used by ``anchors`` alone. Empty input, or no anchor, gives no rows.
    """
    spark = samples.sparkSession
    asking = samples.select(F.col(key).alias("key"), F.col(label).alias("class"), F.coalesce(anchors, F.lit(False)).alias("asks"), F.col(feature).alias("feature"))
    rows = stored(_index(asking, scale, directions, fit_rows))
    n_rows, n_anchors = rows.agg(F.count("*"), F.count_if("asks")).first()
    parts = max(1, -(-n_rows // PART_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // LEAST_PART_ROWS)))
    blocks = max(1, -(-n_anchors // BLOCK_ANCHORS))
    # Written: the ranges are drawn from a sample, and a task run again must find the same parts.
    dealt = stored(rows.repartitionByRange(parts, "class", "near", "angle", "row").withColumn("part", F.spark_partition_id()).drop("near", "angle"))
    told = ["row", "key", "class", "vector", "norm", "angles"]
    copies = dealt.select("part", *told, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    # Aliased, so that the two sides of a cogroup share no column.
    asking = dealt.filter("asks").select(*[F.col(c).alias(c) for c in told], F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))
    key_field = T.StructField("key", samples.schema[key].dataType)

    homes = dealt.select(F.col("class").alias("_c"), F.col("part").alias("part")).distinct()
    at_home = asking.join(homes, F.col("class") == F.col("_c")).drop("_c")
    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("row", T.LongType()), key_field, T.StructField("score", T.LongType())])
    found = at_home.groupBy("part", "block").cogroup(copies.groupBy("part", "block")).applyInArrow(lambda a, b: positives_in(a, b, positives), schema)
    first = Window.partitionBy("anchor").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last(), "row")
    best_of = stored(found.withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") <= positives).drop("_nth"))

    # At most ``positives`` different scores for each anchor.
    asked = best_of.groupBy("anchor").agg(F.collect_set("score").alias("asked"))
    everywhere = asking.join(asked, F.col("row") == F.col("anchor")).drop("anchor").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("positive_score", T.LongType()), *schema.fields[1:]])
    found = everywhere.groupBy("part", "block").cogroup(copies.groupBy("part", "block")).applyInArrow(
        lambda a, b: negatives_in(a, b, negatives, low_percent, high_percent), schema)
    first = Window.partitionBy("anchor", "positive_score").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last(), "row")
    hard = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives)
    hard = hard.select("anchor", "positive_score", "rank", F.col("key").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = dealt.filter("asks").select(F.col("row").alias("anchor"), F.col("key").alias("anchor_id"))
    pairs = best_of.select("anchor", F.col("key").alias("positive_id"), F.col("score").alias("positive_score")).join(ids, "anchor")
    return pairs.join(hard, ["anchor", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
