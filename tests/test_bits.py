"""Packed words to rows."""

from scenesift.functions.bits import WORD, explode_bits
from scenesift.operators.occupancy import FREE, OCCUPIED, occupancy_grid


def test_words_unpack_to_every_set_bit(spark):
    words = [0, 1, 2, 3, 8, 1 << 53, (1 << 54) - 1, 1 << 61, (1 << WORD) - 1, (1 << 40) + 5]
    rows = [(n, 3, w) for n, w in enumerate(words)]
    df = spark.createDataFrame(rows, "n int, w int, bits long")
    want = {(n, 3 * WORD + b) for n, _, w in rows for b in range(WORD) if w >> b & 1}
    for wide in (False, True):
        got = [tuple(x) for x in explode_bits(df, "bits", "w", "k", wide).collect()]
        assert len(got) == len(want) and set(got) == want


def test_states_come_from_one_pass(spark):
    """The packed grid was made once for each state; where both bits are set the voxel is OCCUPIED."""
    columns = spark.createDataFrame([("s", "f", 1, 2, 0, 0b0110, 0b1000), ("s", "f", 1, 3, 1, 0, 1 << 61), ("s", "f", 1, 4, 0, 0b11, 0b10), ("s", "f", 1, 5, 0, 0, 0)], "scene_id string, frame_id string, i int, j int, w int, free long, occ long")
    grid = occupancy_grid(columns)
    assert "Union" not in grid._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(x)[2:] for x in grid.collect()) == [(1, 2, 1, FREE), (1, 2, 2, FREE), (1, 2, 3, OCCUPIED), (1, 3, 123, OCCUPIED), (1, 4, 0, FREE), (1, 4, 1, OCCUPIED)]
