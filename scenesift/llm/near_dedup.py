"""MinHash near-dedup: an LSH forest proposes neighbours, exact set comparison confirms the links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenesift.llm.common import by_number, integer_ids, mix, numbered_ids, stored, tokens, window_hashes
from scenesift.llm.components import connected, extended

#: Words of a shingle, and the least similarity of linked texts in per cent.
SHINGLE, PERCENT = 4, 80
#: Sorted signature orders, and the hashes that rows of one region of an order share at least. A pair at the bound
#: shares a region of some order with probability 1 - (1 - 0.8^4)^24 > 0.99999.
TREES, DEPTH = 24, 4
#: Further hashes that sort a region, one byte of each.
SORTED = 16
#: Regions and families up to SMALL rows compare all rows. In a larger region a row meets the REACH rows on each side
#: in the sorted order; that only finds most links early, the pairs of its rows are settled by ``exact_rest``.
REACH, SMALL = 2, 16
#: Counters of shingles, which order them from rare to common; any order gives the same links.
BINS = 1 << 20
#: Least estimated similarity of a pair that is confirmed on full sets: over four standard errors below the bound.
LOOSE = 0.62
#: Ids that may be broadcast: eight bytes each, so some 20 MB with the hash table.
BROADCAST_IDS = 1_000_000
#: Bytes of text that are hashed at a time.
CHUNK = 2 << 20


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes."""
    start, size = 0, 0
    for n, text in enumerate(texts):
        size += len(text) + 1
        if size >= CHUNK:
            yield start, n + 1
            start, size = n + 1, 0
    if start < len(texts):
        yield start, len(texts)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted different shingle hashes of each text; a text with fewer words is one shingle, one without has none."""
    _, _, _, h, firsts = tokens([t.lower() for t in texts])
    every = window_hashes(h, size)
    sets = []
    for a, b in zip(firsts, firsts[1:]):
        n = b - a
        if n >= size:
            sets.append(np.unique(every[a : b - size + 1]))
        else:
            short = window_hashes(h[a:b], int(n)) if n else np.zeros(0, np.uint64)
            sets.append(mix(short + np.uint64(n)))
    return sets


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Least value of each of ``size`` hash functions over each set; zeros for an empty set."""
    out = np.zeros((len(sets), size), np.uint32)
    full = [n for n, s in enumerate(sets) if len(s)]
    if full:
        values = np.concatenate([sets[n] for n in full])
        starts = np.cumsum([0] + [len(sets[n]) for n in full[:-1]])
        odd = mix(np.arange(1, 2 * size + 1, dtype=np.uint64))
        for k in range(size):
            hashed = ((values ^ odd[k]) * (odd[size + k] | np.uint64(1))) >> np.uint64(32)
            out[full, k] = np.minimum.reduceat(hashed.astype(np.uint32), starts)
    return out


def digest_of(s: np.ndarray) -> tuple[int, int]:
    return (int(np.bitwise_xor.reduce(mix(s))), int(np.add.reduce(mix(s ^ np.uint64(77))))) if len(s) else (0, 0)


def sign(samples: DataFrame, size: int) -> DataFrame:
    """(key, n_shingles, d1, d2, mins): set size, digest of the whole set and signature of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in chunks(texts):
                sets = shingle_sets(texts[a:b], size)
                mins = signatures(sets, TREES * DEPTH)
                digest = [digest_of(s) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    keys.slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                    *[pa.array(np.array([d[k] for d in digest], np.uint64).view(np.int64)) for k in (0, 1)],
                    pa.array([m.tobytes() if len(s) else None for m, s in zip(mins, sets)], pa.binary()),
                ], names=["key", "n_shingles", "d1", "d2", "mins"])

    return samples.mapInArrow(run, "key long, n_shingles long, d1 long, d2 long, mins binary")


def forest(nodes: DataFrame) -> DataFrame:
    """(region, node, label): a row for each node and order; the label sorts the rows of a region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mins = np.frombuffer(b"".join(batch.column("mins").to_pylist()), np.uint32).reshape(-1, TREES * DEPTH)
            for tree in range(TREES):
                own = [(tree * DEPTH + k) % (TREES * DEPTH) for k in range(DEPTH + SORTED)]
                region = np.full(len(mins), tree, np.uint64)
                for k in own[:DEPTH]:
                    region = mix(region * np.uint64(31) + mins[:, k].astype(np.uint64))
                label = np.ascontiguousarray(mins[:, own[DEPTH:]].astype(np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array(region.view(np.int64)), batch.column("node"), pa.array([x.tobytes() for x in label], pa.binary())], names=["region", "node", "label"])

    return nodes.select("node", "mins").mapInArrow(run, "region long, node long, label binary")


def neighbours(rows: DataFrame) -> DataFrame:
    """(lo, hi): all pairs of a small region, and those near each other in the sorted order of a larger one.

    Each row of a larger region, and of a region that two tasks may have parts of, also gives (node, node).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, node, first = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            fresh = len(region)
            region = np.concatenate((region, batch.column(0).to_numpy()))
            node = np.concatenate((node, batch.column(1).to_numpy()))
            edge = np.flatnonzero(np.diff(region, prepend=region[:1] - 1)) if len(region) else np.zeros(0, np.int64)
            size = np.repeat(np.diff(np.append(edge, len(region))), np.diff(np.append(edge, len(region))))
            first = region[0] if first is None and len(region) else first
            dense = node[(size > SMALL) | (region == first)]
            found = [np.stack([dense, dense])]
            for step in range(1, min(SMALL, len(region))):
                same = region[step:] == region[:-step]
                same &= (step <= REACH) | (size[step:] <= SMALL)
                same[: max(0, fresh - step)] = False  # pairs of rows that the last batch had already
                at = np.flatnonzero(same)
                found.append(np.stack([node[at], node[at + step]]))
            pair = np.concatenate(found, axis=1)
            pair = np.unique(np.stack([pair.min(axis=0), pair.max(axis=0)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["lo", "hi"])
            region, node = region[-SMALL:], node[-SMALL:]
        cut = node[region == region[-1]] if len(region) else node
        yield pa.RecordBatch.from_arrays([pa.array(cut), pa.array(cut)], names=["lo", "hi"])

    # Ranges of (region, label): a large region is sorted by several tasks, which cut it where prefixes differ most.
    dealt = rows.repartitionByRange("region", "label").sortWithinPartitions("region", "label", "node").select("region", "node")
    return dealt.mapInArrow(run, "lo long, hi long").distinct()


def estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in at least LOOSE of their places (judged on one byte of each)."""
    sketch = nodes.select("node", "sketch")
    both = pairs.join(sketch.toDF("lo", "a"), "lo").join(sketch.toDF("hi", "b"), "hi").select("lo", "hi", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, TREES * DEPTH) for c in ("a", "b"))
            alike = ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            keep = pa.array(alike >= LOOSE)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("lo", "hi")], names=["lo", "hi"])

    return both.mapInArrow(run, "lo long, hi long")


def family_pairs(close: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lo, hi) within small families of loosely close nodes, and (centre, node) in large ones.

    A family up to SMALL nodes gives all its pairs. In a larger one every node is paired with the centre: the node
    that agrees best with the commonest signature values of the family. Copies of one text with edits of their own
    agree with the common text at least as well as with each other.
    """
    family = connected(close)
    sizes = family.groupBy("root").agg(F.count("*").alias("n"))
    small = family.join(sizes.filter(F.col("n") <= SMALL).select("root"), "root")
    within = small.select("root", F.col("node").alias("lo")).join(small.select("root", F.col("node").alias("hi")), "root").filter("lo < hi").select("lo", "hi")
    large = family.join(sizes.filter(F.col("n") > SMALL).select("root"), "root").join(nodes.select("node", "sketch"), "node")

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8)
            k = TREES * DEPTH
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(c).to_numpy(), k)) for c in ("root", "node")] + [pa.array(np.tile(np.arange(k, dtype=np.int32), len(sketch) // k)), pa.array(sketch.astype(np.int32))],
                names=["root", "node", "place", "value"])

    places = large.select("root", "node", "sketch").mapInArrow(values, "root long, node long, place int, value int")
    common = places.groupBy("root", "place", "value").count().groupBy("root", "place").agg(F.max_by("value", F.struct("count", "value")).alias("value"))
    score = places.join(common, ["root", "place", "value"]).groupBy("root", "node").count()
    centre = score.groupBy("root").agg(F.max_by("node", F.struct("count", -F.col("node"))).alias("centre"))
    return within, large.select("root", "node").join(centre, "root").filter("node <> centre").select("centre", "node")


def packed_sets(wanted: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(node, shingles): the full sets of the wanted nodes, six bytes of each hash.

    Two sets agree by chance in one shingle with probability below 1e-6.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, content = batch.column("node"), [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for a, b in chunks(content):
                packed = [np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes() for s in shingle_sets(content[a:b], size)]
                yield pa.RecordBatch.from_arrays([nodes.slice(a, b - a), pa.array(packed, pa.binary())], names=["node", "shingles"])

    wanted = stored(wanted)
    # Few ids go to the texts; many are joined by shuffling both.
    few = wanted.count() <= BROADCAST_IDS
    return texts.join(F.broadcast(wanted) if few else wanted, "node").mapInArrow(sets, "node long, shingles binary")


def named_by_set(texts: DataFrame, size: int) -> DataFrame:
    """(node, text): one text without an id for each different set, with the negative node that the set may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for a, b in chunks(content):
                nodes = [-(digest_of(s)[0] >> 1) - 1 if len(s) else None for s in shingle_sets(content[a:b], size)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), batch.column("text").slice(a, b - a)], names=["node", "text"])

    rows = texts.filter("key IS NULL").select("text").mapInArrow(run, T.StructType([T.StructField("node", T.LongType()), texts.schema["text"]]))
    return rows.filter("node IS NOT NULL").groupBy("node").agg(F.first("text").alias("text"))


def unpacked(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full shingle sets have 100 * intersection >= percent * union."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a"), batch.column("b")):
                x, y = x.as_py(), y.as_py()
                n, m = len(x) // 6, len(y) // 6
                if 100 * min(n, m) < percent * max(n, m):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(unpacked(x), unpacked(y), assume_unique=True))
                keep.append(100 * both >= percent * (n + m - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("lo", "hi")], names=["lo", "hi"])

    both = pairs.join(sets.toDF("lo", "a"), "lo").join(sets.toDF("hi", "b"), "hi").select("lo", "hi", "a", "b")
    return both.mapInArrow(compare, "lo long, hi long").distinct()


def tallied(sets: DataFrame) -> np.ndarray:
    """How many of the sets have a shingle of each of BINS kinds: an array of one size, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            for a, b in chunks(packed := batch.column("shingles").to_pylist()):
                total += np.bincount((unpacked(b"".join(packed[a:b])) & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bin", "n"])

    found = sets.select("shingles").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BINS, np.int64)
    out[found.column("bin").to_numpy()] = found.column("n").to_numpy()
    return out


def prefixes(sets: DataFrame, tally: np.ndarray, percent: int) -> DataFrame:
    """(token, node, root, size, place, ahead): the rarest shingles of each set, with their place in its order.

    Two sets at the bound share a shingle among those of the larger one and the ``ahead`` ones of the smaller one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for node, root, packed in zip(*(batch.column(c).to_pylist() for c in ("node", "root", "shingles"))):
                own = unpacked(packed)
                n = len(own)
                most, ahead = n + 1 + -percent * n // 100, n + 1 + -2 * percent * n // (100 + percent)
                order = np.lexsort((own, tally[(own & np.uint64(BINS - 1)).astype(np.int64)]))[:most]
                place = np.arange(len(order))
                found.append((own[order].view(np.int64), *(np.full(len(order), v, np.int64) for v in (node, root, n)), place, place < ahead))
            columns = [np.concatenate(c) for c in zip(*found)] or [np.zeros(0, np.int64)] * 5 + [np.zeros(0, bool)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "node", "root", "size", "place", "ahead"])

    return sets.select("node", "root", "shingles").mapInArrow(run, "token long, node long, root long, size long, place long, ahead boolean")


def apart(groups: DataFrame, own: DataFrame, tally: np.ndarray, percent: int) -> DataFrame:
    """The ``prefixes`` whose shingle stands in ``n`` > 1 connected groups, with the group that most of its nodes have."""
    rooted = own.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = stored(prefixes(rooted, tally, percent))
    each = rows.groupBy("token", "root").count()
    major = each.groupBy("token").agg(F.max_by("root", F.struct("count", "root")).alias("major"), F.count("*").alias("n"))
    return stored(rows.join(major.filter("n > 1"), "token"))


def fitting(both: DataFrame, percent: int) -> DataFrame:
    """(lo, hi): pairs of different groups that can reach the bound.

    With x and y shingles from a shared one on, in the common order from rare to common, two sets share at most
    min(x, y) if that is the first one that they share.
    """
    fit = both.filter(f"""root_a <> root_b AND 100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)
      AND {100 + percent} * least(size_a - place_a, size_b - place_b) >= {percent} * (size_a + size_b)""")
    return fit.select(F.least("node_a", "node_b").alias("lo"), F.greatest("node_a", "node_b").alias("hi")).distinct()


def exact_rest(groups: DataFrame, dense: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``groups`` after all links between nodes of large regions that it does not connect yet: a prefix-filter join.

    Whatever is connected needs no further link, so a shingle whose nodes are all connected gives no pair. While a
    shingle stands in more than SMALL groups, its nodes first meet a centre of its own: the one with the fewest rarer
    shingles, then the same among those outside its main group. In the end all nodes of different groups meet.
    """
    own = stored(sets.join(dense, "node"))
    tally = tallied(own)
    side = lambda rows, x: rows.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "root", "size", "place")])
    rows = apart(groups, own, tally, percent)
    for outside in ("true", "root <> major"):
        large = rows.filter(f"n > {SMALL}")
        if large.isEmpty():
            break
        centre = large.filter(outside).groupBy("token").agg(F.min(F.struct("place", "node", "root", "size")).alias("c")).select("token", "c.*")
        found = stored(confirmed(fitting(side(centre, "a").join(side(large, "b"), "token"), percent), sets, percent))
        if found.isEmpty():
            continue
        groups = extended(groups, found)
        rows = apart(groups, own, tally, percent)
    ahead, main = rows.filter("ahead"), F.col("root") == F.col("major")
    both = side(ahead.filter(~main), "a").join(side(rows, "b"), "token").unionByName(side(ahead.filter(main), "a").join(side(rows.filter(~main), "b"), "token"))
    return extended(groups, confirmed(fitting(both.filter("size_a < size_b OR size_a = size_b AND node_a < node_b"), percent), sets, percent))


def near_duplicates(samples: DataFrame, key: str = "sample_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Groups of near-duplicate sample texts.

    ``samples`` has a sample id, an integer or a text such as ``scene_frame_object_p001``, and a text (a grounding
    description or a whole annotation document). Text ids count in their order. A-Z are lower-cased, words stand between ASCII blanks, and a text's set has its different ``shingle``-word shingles (all
    words as one shingle when there are fewer). Texts are linked when 100 * intersection >= ``percent`` * union.

    Texts with equal sets become one node. In each sorted order of the signatures the nodes of a small region all
    meet, and in a larger one those with the longest common prefix. Close pairs make loose families, in which small
    ones are compared in full and large ones with their centre; every proposed pair is confirmed on full sets. What
    this leaves apart among the nodes of larger regions is joined exactly by the rarest shingles. The links give the
    groups. No group is held by one task, and no pairs of equal texts are made.

    Returns (key, n_shingles, component_id, kept), one row for each input row: the smallest id reachable over links,
    and whether the row has it. Null, empty and blank texts have no shingles, stand alone and are kept. Rows with
    equal ids are one node. A row with a null id takes part in links, has the component of its group (null when no
    row of it has an id) and is kept only when that is null. Other columns are not read. Empty input gives no rows.
    """
    if not integer_ids(samples, key):
        ids = numbered_ids(samples, key)
        out = near_duplicates(by_number(samples, key, text, ids), "_number", "text", shingle, percent)
        out = out.join(ids, "_number", "left").join(ids.select(F.col("_number").alias("component_id"), F.col("_id").alias("_component")), "component_id", "left")
        return out.select(F.col("_id").alias(key), "n_shingles", F.col("_component").alias("component_id"), "kept")
    texts = samples.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    signed = stored(sign(texts, shingle))
    full = signed.filter("n_shingles > 0")
    # A set that only rows without an id have gets a negative node of its own.
    unnamed = -F.shiftrightunsigned("d1", 1) - 1
    nodes = full.groupBy("d1", "d2").agg(F.coalesce(F.min("key"), F.first(unnamed)).alias("node"), F.min("key").isNull().alias("unnamed"), F.first("mins").alias("mins"))
    every_fourth = F.udf(lambda m: np.frombuffer(m, np.uint8)[::4].tobytes(), T.BinaryType())
    nodes = stored(nodes.withColumn("sketch", every_fourth("mins")))
    near = stored(neighbours(forest(nodes)))
    close = stored(estimated(near.filter("lo < hi"), nodes))
    dense = near.filter("lo = hi").select(F.col("lo").alias("node"))
    within, star = family_pairs(close, nodes)
    star = stored(star)
    more = within.unionByName(star.select(F.least("node", "centre").alias("lo"), F.greatest("node", "centre").alias("hi")))
    candidates = stored(close.unionByName(estimated(more.join(close, ["lo", "hi"], "left_anti"), nodes)).distinct())
    ends = candidates.select(F.col("lo").alias("node")).union(candidates.select("hi")).union(star.select("node")).union(star.select("centre")).union(dense)
    with_node = texts.select(F.col("key").alias("node"), "text").filter(F.col("node").isNotNull()).unionByName(named_by_set(texts, shingle))
    sets = stored(packed_sets(ends.distinct(), with_node, shingle))
    groups = exact_rest(connected(confirmed(candidates, sets, percent)), dense, sets, percent)
    held = nodes.select("d1", "d2", "node", "unnamed").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Where the smallest node is none of the given ids, the group has its smallest given id, or none.
    led = held.join(nodes.filter("unnamed").select(F.col("node").alias("root")), "root")
    least = led.groupBy("root").agg(F.min(F.when(~F.col("unnamed"), F.col("node"))).alias("least"), F.lit(True).alias("led"))
    of_node = held.join(least, "root", "left").select("d1", "d2", F.when(F.col("led"), F.col("least")).otherwise(F.col("root")).alias("root"))
    rows = signed.drop("mins").join(of_node, ["d1", "d2"], "left")
    rows = rows.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("key")).otherwise(F.col("root")))
    return rows.select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
