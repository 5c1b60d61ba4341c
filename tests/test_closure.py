from motifloom.operators import postprocess


def test_closure_of_a_long_path(spark):
    n = 70
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(None, 3), (200, 201), (201, 200)], "target_ac long, effector_ac long")
    got = {tuple(r) for r in postprocess.closure(links).collect()}
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n + 1)} | {(a, b) for a in (200, 201) for b in (200, 201)}
