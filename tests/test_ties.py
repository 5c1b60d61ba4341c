"""Hits of one place: what comes out doesn't depend on the order they come in."""

from motifloom.operators import postprocess


def test_flank_repeats_in_any_order(spark):
    rows = [(1, "R", 74, 85, None, None, 74006.97, 0.0, -1, "#"), (1, "R", 74, 85, None, None, 33850.11, 0.0, -1, "#"), (1, "R", 88, 129, None, None, 79988.38, 0.0, -1, "#")]
    kind = "seq_id long, motif_ac string, begin long, end long, pf_begin int, pf_end int, raw double, norm double, level int, level_tag string"
    # the area is 2.697 with the higher one first and 2.713 with the lower one first
    levels = [{r.level for r in postprocess.flank_repeats(spark.createDataFrame(own, kind).coalesce(1), "R", 100000, 2.705, 20, 1.5).collect()} for own in (rows, rows[::-1], [rows[1], rows[0], rows[2]])]
    assert levels == [{0}] * 3
