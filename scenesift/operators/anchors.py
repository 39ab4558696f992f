"""Tests of packed anchors, pose by pose.

Spark brings the anchors of a pose, as words, together with what the test needs: the pose's camera views, the depth
buffer or the surface of its object. A small Arrow function then tests the anchors of one pose at a time and answers
with words, so a candidate is never a row of a shuffle. What meets in one group is bounded by the grid and the image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenesift.functions.bits import WORD, bit_in_word, explode_bits, word_of
from scenesift.functions.geometry import cell
from scenesift.operators.occupancy import OBJ
from scenesift.operators.points import FK
from scenesift.session import spread

POSE = OBJ + ["yaw_idx"]
ROW = POSE + ["gx", "gw"]
# Numbers of one view: camera and anchor shift, rotation, eight corners.
VIEW_NUMBERS = 10 + 9 + 24


def pack_candidates(candidates: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Candidate rows (distinct, as the search gives them) to words (ROW, extra, bits); packed ones stay as they are."""
    if "gw" in candidates.columns:
        return candidates
    return candidates.groupBy(*POSE, "gx", word_of(F.col("gy")).alias("gw"), *extra).agg(F.bit_or(bit_in_word(F.col("gy"))).alias("bits"))


def unpack_candidates(words: DataFrame) -> DataFrame:
    return explode_bits(words.filter(F.col("bits") != 0), "bits", "gw", "gy", wide=True)


def _by_pose(rows: DataFrame, bits: str) -> DataFrame:
    """One row per pose with its words as three arrays."""
    lists = rows.groupBy(*POSE).agg(F.collect_list(F.struct("gx", "gw", F.col(bits).alias("m"))).alias("a"))
    return lists.select(*POSE, "a.gx", "a.gw", "a.m")


def _renewed(df: DataFrame) -> DataFrame:
    return df.toDF(*df.columns)


def _answer(rows: DataFrame) -> T.StructType:
    return T.StructType([rows.schema[c] for c in ROW] + [T.StructField("word", T.LongType())])


def _view_numbers(views: DataFrame) -> DataFrame:
    """Views as rows of numbers (``of_`` pose, n); a view that misses one does not count."""
    parts = [F.col(c).cast("double") for c in ("fx", "fy", "cx", "cy", "img_w", "img_h", "voxel_size", "vi", "vj", "lift")]
    parts += [cell(F.col("w2c"), r, c) for r in range(3) for c in range(3)]
    corners = F.flatten(F.transform("base", lambda p: F.array(p["x"], p["y"], p["z"])))
    numbers = views.select(*[F.col(c).alias("of_" + c) for c in POSE], F.concat(F.array(*parts), corners).alias("n"))
    return numbers.dropna(subset=["of_" + c for c in POSE]).filter(F.col("n").isNotNull() & ~F.exists("n", lambda x: x.isNull()))


def _arrow_tools():
    """Closures, so that they travel with the query and need no installed package."""
    word, size = WORD, VIEW_NUMBERS
    keys, pose = list(ROW), list(POSE)

    def lists(table, name):
        """Per row: the numbers of a list column."""
        import numpy as np

        column = table.column(name).combine_chunks()
        ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        return [np.asarray(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]

    def anchors_of(gx, gw, m):
        """Word and bit of every anchor, and its cell."""
        import numpy as np

        at, b = np.nonzero((m[:, None] >> np.arange(word)) & 1)
        return at, b, gx[at].astype("int64"), gw[at].astype("int64") * word + b

    def answer(table, picked):
        """Words of the picked anchors: ``picked`` yields (at, b, chosen) for every row of ``table``."""
        import numpy as np
        import pyarrow as pa

        power = np.left_shift(np.int64(1), np.arange(word, dtype="int64"))
        gx, gw, m = lists(table, "gx"), lists(table, "gw"), lists(table, "m")
        source, where, words = [], [], []
        for n in range(table.num_rows):
            at, b, x, y = anchors_of(gx[n], gw[n], m[n])
            chosen = picked(n, x, y)
            grid = np.zeros((len(m[n]), word), dtype=bool)
            grid[at[chosen], b[chosen]] = True
            some = np.nonzero(grid.any(axis=1))[0]
            source.append(np.full(len(some), n))
            where.append(some)
            words.append(grid[some] @ power)
        take = pa.array(np.concatenate(source).astype("int64") if source else np.zeros(0, "int64"))
        columns = [table.column(c).combine_chunks().take(take) for c in pose]
        for values in (gx, gw):
            picked_values = [v[w] for v, w in zip(values, where)]
            columns.append(pa.array(np.concatenate(picked_values).astype("int32") if picked_values else np.zeros(0, "int32")))
        columns.append(pa.array(np.concatenate(words).astype("int64") if words else np.zeros(0, "int64")))
        return pa.table(dict(zip([*keys, "word"], columns)))

    return lists, answer


# Words of anchors that are tested at once.
WORDS_AT_ONCE = 256


def _view_tester():
    """Arrow function tools: the anchors of all poses of an object against their views, many poses at a time."""
    word, size, most = WORD, VIEW_NUMBERS, WORDS_AT_ONCE

    def projected(n, x, y):
        """(pixel u, pixel v, camera z) of the eight corners at every anchor, in the order of operations of ``camera_views``."""
        import numpy as np

        fx, fy, cx, cy, _, _, vs, vi, vj, lift = n[:10]
        step = (x - vi) * vs, (y - vj) * vs
        moved = [n[19 + k :: 3] + (n[10 + 3 * k] * step[0] + n[11 + 3 * k] * step[1] + n[12 + 3 * k] * lift) for k in range(3)]
        safe = np.where(moved[2] > 0, moved[2], 1.0)
        return moved[0] / safe * fx + cx, moved[1] / safe * fy + cy, moved[2]

    def outside(n, x, y):
        """Corners outside the image."""
        u, v, z = projected(n, x, y)
        return (~((z > 0) & (u >= 0) & (u < n[4]) & (v >= 0) & (v < n[5]))).sum(axis=0)

    def behind(u0, v0, depth):
        """Counts the corners behind a picture of depths that starts at pixel (u0, v0)."""
        import numpy as np

        def hidden(n, x, y):
            u, v, z = projected(n, x, y)
            pu = np.fmax(0.0, np.fmin(n[4] - 1, np.rint(u))).astype("int64") - u0
            pv = np.fmax(0.0, np.fmin(n[5] - 1, np.rint(v))).astype("int64") - v0
            known = (pu >= 0) & (pu < depth.shape[0]) & (pv >= 0) & (pv < depth.shape[1]) & (z > 0)
            near = np.full(z.shape, np.inf)
            near[known] = depth[pu[known], pv[known]]
            return (z > near + n[6]).sum(axis=0)

        return hidden

    def pictures(pixels):
        """Depths around the pixels of a frame as an object sees them: of each pixel the first layer that is not its own."""
        import numpy as np
        import pyarrow.compute as pc

        u, v = (pixels.column(c).to_numpy().astype("int64") for c in "uv")
        u0, v0 = int(u.min()), int(v.min())
        layers = pixels.column("layers").combine_chunks()
        pixel = np.repeat(np.arange(len(u)), layers.value_lengths().fill_null(0).to_numpy())
        z, owners = layers.flatten().flatten()
        z, layer = z.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(pixel)), owners.value_lengths().fill_null(0).to_numpy())
        owners = owners.flatten()

        def picture(owner):
            others = np.ones(len(pixel), dtype=bool)
            others[layer[pc.fill_null(pc.equal(owners, owner), False).to_numpy(zero_copy_only=False)]] = False
            # Layers come nearest first, so the nearest is written last.
            others = np.nonzero(others & (z == z))[0][::-1]
            depth = np.full((int(u.max()) - u0 + 1, int(v.max()) - v0 + 1), np.inf)
            depth[u[pixel[others]] - u0, v[pixel[others]] - v0] = z[others]
            return u0, v0, depth

        return picture

    def passing(left, right, count, good):
        """The words of an object with the anchors whose count over all views of their pose is ``good``."""
        import numpy as np

        yaw, gx, gw, m = (left.column(c).to_numpy().astype("int64") for c in ("yaw_idx", "gx", "gw", "m"))
        yaws = right.column("of_yaw_idx").to_numpy().astype("int64")
        numbers = np.asarray(right.column("n").combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype="float64")
        order = np.argsort(yaws, kind="stable")
        sorted_yaws, views = yaws[order], np.ascontiguousarray(numbers.reshape(-1, size)[order].T)
        first = np.searchsorted(sorted_yaws, yaw, side="left")
        held = np.searchsorted(sorted_yaws, yaw, side="right") - first
        out = np.empty(len(m), dtype="int64")
        for start in range(0, len(m), most):
            part = slice(start, start + most)
            grid = np.unpackbits(m[part].astype("<i8").view("uint8").reshape(-1, 8), axis=1, bitorder="little")
            at, b = np.nonzero(grid)
            at += start
            x, y = gx[at].astype("float64"), (gw[at] * word + b).astype("float64")
            total = np.zeros(len(at), dtype="int64")
            for nth in range(int(held[part].max(initial=0))):
                seen = np.nonzero(held[at] > nth)[0]
                total[seen] += count(views[:, first[at[seen]] + nth], x[seen], y[seen])
            grid[at - start, b] = good(total)
            out[part] = np.packbits(grid, axis=1, bitorder="little").view("<i8").ravel()
        return out

    return outside, behind, pictures, passing


def _tested(words: DataFrame, other: DataFrame, keys: list[str], bits: str, name: str, test) -> DataFrame:
    """(ROW, bits, name): the words with those of their anchors that pass ``test``.

    The words of a group meet their views, and what else ``other`` holds for it (under ``of_`` keys), and each crosses one
    shuffle.
    """
    answer = T.StructType([words.schema[c] for c in ROW] + [T.StructField(n, T.LongType()) for n in (bits, name)])
    row = list(ROW)

    def run(left, right):
        import pyarrow as pa

        columns = [left.column(c) for c in (*row, "m")]
        return pa.table(dict(zip((*row, bits, name), [*columns, pa.array(test(left, right))])))

    of = ["of_" + c for c in keys]
    return spread(words, keys).groupBy(*keys).cogroup(spread(other, of).groupBy(*of)).applyInArrow(run, answer)


def _live(rows: DataFrame, bits: str) -> DataFrame:
    return rows.filter(F.col(bits) != 0).select(*ROW, F.col(bits).alias("m"))


def inside_words(rows: DataFrame, views: DataFrame, bits: str, name: str) -> DataFrame:
    """(ROW, bits, name): the anchors of ``bits`` whose box is fully inside the image, in all of the pose's views."""
    outside, _, _, passing = _view_tester()
    return _tested(_live(rows, bits), _view_numbers(views), OBJ, bits, name, lambda left, right: passing(left, right, outside, lambda n: n == 0))


# Objects of a frame that share one copy of its depth buffer or of its obstacles.
OBJECTS_AT_ONCE = 16


def bundled_frames(rows: DataFrame) -> DataFrame:
    """(frame, bundles): into how many bundles the objects of a frame are dealt."""
    return _renewed(rows.select(*OBJ).distinct().groupBy(*FK).agg(F.ceil(F.count(F.lit(1)) / OBJECTS_AT_ONCE).cast("int").alias("bundles")))


def bundle_of(obj_id: str):
    return F.pmod(F.xxhash64(obj_id), F.col("bundles")).cast("int")


def unhidden_words(rows: DataFrame, views: DataFrame, layers: DataFrame, threshold: float, bits: str, name: str) -> DataFrame:
    """(ROW, bits, name): the anchors of ``bits`` without too large a share of corners behind other geometry.

    About ``OBJECTS_AT_ONCE`` objects of a frame meet one copy of its depth buffer, so pixels are not copied for each object.
    """
    _, behind, pictures, passing = _view_tester()
    share = float(threshold)

    def test(left, right):
        import numpy as np
        import pyarrow.compute as pc

        kept = left.column("m").to_numpy().copy()
        pixels = right.filter(right.column("u").is_valid())
        if not left.num_rows or not pixels.num_rows:
            return kept
        seen_by = pictures(pixels)
        views_of = right.filter(right.column("u").is_null())
        for owner in pc.unique(left.column("obj_id")):
            mine = np.nonzero(pc.equal(left.column("obj_id"), owner).to_numpy())[0]
            own_views = views_of.filter(pc.equal(views_of.column("of_obj_id"), owner))
            kept[mine] = passing(left.take(mine), own_views, behind(*seen_by(owner)), lambda n: ~(n / np.float64(8.0) > share))
        return kept

    words = _live(rows, bits)
    # New names keep the sides apart where all start from the candidates.
    frames = bundled_frames(words)
    words = words.join(frames, FK).select(*words.columns, bundle_of("obj_id").alias("bundle"))
    of = {c: "of_" + c for c in FK}
    numbers = _view_numbers(views).join(frames.withColumnsRenamed(of), list(of.values())).withColumn("of_bundle", bundle_of("of_obj_id")).drop("bundles")
    pixels = layers.select(*FK, "u", "v", "layers").join(frames, FK).withColumn("of_bundle", F.explode(F.sequence(F.lit(0), F.col("bundles") - 1))).drop("bundles")
    return _tested(words, numbers.unionByName(pixels.withColumnsRenamed(of), allowMissingColumns=True), [*FK, "bundle"], bits, name, test)


def held_words(rows: DataFrame, feet: DataFrame, surface: DataFrame, ratio: float, bits: str) -> DataFrame:
    """(ROW, word): the anchors of ``bits`` with their centre of mass and the share ``ratio`` of their feet on the surface.

    ``feet``: per pose n_foot, mean_i, mean_j and the arrays di, dj; ``surface``: cells (object, i, j).
    """
    lists, answer = _arrow_tools()
    share = float(ratio)

    def test(left, right):
        import numpy as np

        if not left.num_rows or not right.num_rows:
            return answer(left.slice(0, 0), None)
        i, j = (right.column(c).to_numpy().astype("int64") for c in "ij")
        i0, j0 = i.min(), j.min()
        there = np.zeros((i.max() - i0 + 1, j.max() - j0 + 1), dtype="int64")
        np.add.at(there, (i - i0, j - j0), 1)

        def at(a, b):
            a, b = a - i0, b - j0
            inside = (a >= 0) & (a < there.shape[0]) & (b >= 0) & (b < there.shape[1])
            return np.where(inside, there[np.where(inside, a, 0), np.where(inside, b, 0)], 0)

        di, dj = lists(left, "di"), lists(left, "dj")
        n_foot, mean_i, mean_j = (left.column(c).to_numpy() for c in ("n_foot", "mean_i", "mean_j"))

        def picked(n, x, y):
            good = at(np.rint(x + mean_i[n]).astype("int64"), np.rint(y + mean_j[n]).astype("int64")) > 0
            if share <= 0:
                return good
            held = np.zeros(len(x), dtype="int64")
            for a, b in zip(di[n], dj[n]):
                held += at(x + a, y + b)
            return good & (held > 0) & (held / n_foot[n] >= share)

        return answer(left, picked)

    posed = spread(_by_pose(rows, bits).join(feet, POSE), OBJ)
    return posed.groupBy(*OBJ).cogroup(spread(_renewed(surface.select(*OBJ, "i", "j")), OBJ).groupBy(*OBJ)).applyInArrow(test, _answer(rows))


def anchor_search(supported: bool):
    """The search of objects of a frame, for ``placement.search_rows``: (poses, obstacles and surfaces) to words of anchors.

    Everything is laid out over an object's region; the layers of a mask column and of an obstacle are bits of a word.
    """
    word, pose = WORD, list(POSE)

    def picture(i, j, x0, x1, y0, y1):
        return (i >= x0) & (i < x1) & (j >= y0) & (j < y1)

    def cells(table):
        """(w, i, j, word) of every entry of a table of lists."""
        import numpy as np

        column = table.column("j").combine_chunks()
        sizes = np.diff(column.offsets.to_numpy())
        w, i = (np.repeat(table.column(c).to_numpy().astype("int64"), sizes) for c in "wi")
        return w, i, column.flatten().to_numpy().astype("int64"), table.column("m").combine_chunks().flatten().to_numpy().astype("int64")

    def lines_of(values):
        """(i, j, length, value) of the stretches of equal values, not zero, in every row of a picture."""
        for i, line in enumerate(values.tolist()):
            start = 0
            for j in range(1, len(line) + 1):
                if j == len(line) or line[j] != line[start]:
                    if line[start]:
                        yield i, start, j - start, line[start]
                    start = j

    def columns_of(di, dj, z):
        """(w, layers of every column) of a mask."""
        import numpy as np

        part = z // word
        for w in np.unique(part).tolist():
            mine = part == w
            layers = np.zeros((int(di.max()) + 1, int(dj.max()) + 1), dtype="int64")
            np.bitwise_or.at(layers, (di[mine], dj[mine]), np.left_shift(np.int64(1), z[mine] % word))
            yield w, layers

    def lengthened(known, name, length, first):
        """The picture of ``length`` set cells in a row from each cell on; ``first()`` gives that of single cells."""
        stored = known.setdefault(name, [None])
        if len(stored) == 1:
            stored.append(first())
        while len(stored) <= length:
            have = stored[-1]
            stored.append(have[:, :-1] & stored[1][:, len(stored) - 1 :])
        return stored[length]

    def words_of(free, y0):
        """Rows of a bool picture that starts at column y0 as words: (first word, words)."""
        import numpy as np

        first = y0 // word
        last = (y0 + free.shape[1] - 1) // word
        wide = np.zeros((free.shape[0], (last - first + 1) * word), dtype=bool)
        wide[:, y0 - first * word : y0 - first * word + free.shape[1]] = free
        return first, wide.reshape(free.shape[0], last - first + 1, word) @ np.left_shift(np.int64(1), np.arange(word, dtype="int64"))

    def on_surface(there, some, p, gx, gy, feet, lines, stretch):
        """Anchors whose feet and centre of mass lie on the surface; ``there`` is the surface over the region.

        Feet in a row are looked up as one stretch of the surface.

        As many support rows must meet the word of an anchor as the pose has feet, and one more: a mask whose
        voxels come twice is held nowhere. With each foot once, a row that is missing has no cell either.
        """
        import numpy as np

        base = int(np.floor(p["mean_j"]))
        half = p["mean_j"] - base == 0.5
        shift = base if half else int(np.rint(p["mean_j"]))
        mass = np.rint(gx + p["mean_i"]).astype("int64")
        held = there[np.ix_(mass - gx[0], (np.rint(gy + p["mean_j"]).astype("int64") if half else gy + shift) - gy[0])]
        for a, b, length, _ in lines:
            held &= stretch(length)[a : a + len(gx), b : b + len(gy)]
        if len(feet) == p["n_foot"]:
            return held

        def at(i, j):
            inside = ((i >= 0) & (i < some.shape[0]))[:, None] & ((j >= 0) & (j < some.shape[1]))[None, :]
            return inside & some[np.clip(i, 0, some.shape[0] - 1)[:, None], np.clip(j, 0, some.shape[1] - 1)[None, :]]

        gw = np.arange(gy[0] // word, gy[-1] // word + 1)
        met = at(mass, gw + shift // word).astype("int64")
        for a, b in feet:
            met += at(gx + a, gw + b // word)
        return held & (met == p["n_foot"] + 1)[:, gy // word - gw[0]]

    def surface_of(i, jw, m):
        """(cells, row words that hold a cell or are followed by one that does) from the origin on."""
        import numpy as np

        if not len(i):
            return np.zeros((1, 1), dtype=bool), np.zeros((1, 1), dtype=bool)
        there = np.zeros((i.max() + 1, jw.max() + 1, word), dtype=bool)
        np.bitwise_or.at(there, (i, jw), ((m[:, None] >> np.arange(word)) & 1).astype(bool))
        some = there.any(axis=2)
        some[:, :-1] |= some[:, 1:].copy()
        return there.reshape(there.shape[0], -1), some

    def searched(left, obstacles, right):
        """(row, gx, gw, raw, stable) of the words of one object; ``obstacles`` are cells of its frame, ``right`` its surface."""
        import numpy as np

        found = []
        if left.num_rows:
            columns = {c: left.column(c).to_numpy().tolist() for c in left.column_names if c not in (*pose, "i", "j", "k")}
            numbers = [dict(zip(columns, values)) for values in zip(*columns.values())]
            voxels = [left.column(c).combine_chunks() for c in "ijk"]
            ends = voxels[0].offsets.to_numpy()
            flat = [v.values.to_numpy().astype("int64") for v in voxels]
            w, i, j, m = obstacles
            surface, some = surface_of(*cells(right)[1:]) if supported else (None, None)
            layouts, pictures, surfaces, known = {}, {}, {}, {}
            for n, p in enumerate(numbers):
                x0, x1, y0, y1 = box = p["x0"], p["x1"], p["y0"], p["y1"]
                if box not in layouts:
                    layouts[box] = {}
                    for part in np.unique(w):
                        mine = (w == part) & picture(i, j, *box)
                        blocked = np.zeros((x1 - x0, y1 - y0), dtype="int64")
                        np.bitwise_or.at(blocked, (i[mine] - x0, j[mine] - y0), m[mine])
                        layouts[box][int(part)] = blocked
                vx, vy, vz = (v[ends[n] : ends[n + 1]] for v in flat)
                di, dj, z = vx - p["vi"], vy - p["vj"], vz - p["vk"] + p["landing_z"]
                # A box turned by half is the same box: equal masks have equal anchors.
                same = (box, p["ext_i"], p["ext_j"], p["landing_z"], p["gz"], p["n_foot"], p["mean_i"], p["mean_j"], np.sort((z * p["ext_i"] + di) * p["ext_j"] + dj).tobytes())
                if same not in known:
                    known[same] = None
                    low = z < p["gz"]
                    high, deep = x1 - p["ext_i"] - x0 + 1, y1 - p["ext_j"] - y0 + 1
                    free = np.ones((high, deep), dtype=bool)
                    for part, layers in columns_of(di[low], dj[low], z[low]):
                        if part not in layouts[box]:
                            continue
                        for a, b, length, value in lines_of(layers):
                            open_cells = lengthened(pictures, (box, part, value), length, lambda: (layouts[box][part] & value) == 0)  # noqa: B023
                            free &= open_cells[a : a + high, b : b + deep]
                    if free.any():
                        stable = None
                        first, raw = words_of(free, y0)
                        if supported:
                            if (box, 0) not in surfaces:
                                surfaces[box, 0] = [None, np.zeros((x1 - x0, y1 - y0), dtype=bool)]
                                part = surface[x0:x1, y0:y1]
                                surfaces[box, 0][1][: part.shape[0], : part.shape[1]] = part
                            gx, gy = x0 + np.arange(high), y0 + np.arange(deep)
                            foot = vz == p["vk"]
                            feet = np.zeros((p["ext_i"], p["ext_j"]), dtype=bool)
                            feet[di[foot], dj[foot]] = True
                            stretch = lambda length: lengthened(surfaces, (box, 0), length, None)  # noqa: B023, E731
                            held = on_surface(stretch(1), some, p, gx, gy, [*zip(di[foot].tolist(), dj[foot].tolist())], lines_of(feet), stretch)
                            stable = words_of(free & held, y0)[1]
                        at = np.nonzero(raw)
                        known[same] = x0 + at[0], first + at[1], raw[at], None if stable is None else stable[at]
                if known[same] is not None:
                    found.append((np.full(len(known[same][0]), n), *known[same]))
        return found

    def search(left, right):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        found = []
        if left.num_rows:
            on_ground = pc.less(right.column("w"), 0)
            obstacles, surfaces = cells(right.filter(pc.invert(on_ground))), right.filter(on_ground)
            for owner in pc.unique(left.column("obj_id")):
                mine = np.nonzero(pc.equal(left.column("obj_id"), owner).to_numpy())[0]
                own = surfaces.filter(pc.equal(surfaces.column("of_obj_id"), owner))
                found += [(mine[n], *words) for n, *words in searched(left.take(mine), obstacles, own)]
        kept = [np.concatenate([f[c] for f in found]) if found else np.zeros(0, "int64") for c in range(4 + (supported and bool(found)))]
        take = pa.array(kept[0].astype("int64"))
        columns = {c: left.column(c).combine_chunks().take(take) for c in pose}
        columns |= {"gx": pa.array(kept[1].astype("int32")), "gw": pa.array(kept[2].astype("int32")), "raw": pa.array(kept[3].astype("int64"))}
        columns["stable"] = pa.array(kept[4].astype("int64")) if supported and found else pa.nulls(len(take), pa.int64())
        return pa.table(columns)

    return search
