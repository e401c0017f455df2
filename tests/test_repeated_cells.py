from inkprobe.operators import numeric

CELLS = "sheet string, row int, col int, value double"


def test_counts_are_shared_and_nothing_is_expanded(spark):
    cells = spark.createDataFrame([("s", 0, 0, 7.5), ("s", 1, 1, 7.5), ("s", 1, 2, 3.0)], CELLS)
    plan = numeric.repeated_cells(cells)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_what_is_left_out(spark):
    grid = [(s, r, c, v) for s in ("s", None) for r, c, v in [(0, 0, 7.5), (3, 1, 7.5), (3, 2, 7.5), (1, 0, 2.25), (2, 0, 2.25), (4, 3, -0.0), (5, 4, 0.0), (6, 4, 1e-12), (7, 1, 1e-12)]]
    grid += [("s", r, r % 2, 9.75) for r in range(20, 29)]  # nine rows
    grid += [("s", 50, c, 100.0 * c) for c in range(1, 5)] + [("s", 51, 7, 200.0)]  # 200 stands in a row that is a sequence
    found = numeric.repeated_cells(spark.createDataFrame(grid, CELLS)).collect()
    assert {(r.sheet, r.value, r.n, r.n_rows, r.n_cols) for r in found} == {(s, v, *k) for s in ("s", None) for v, k in ((7.5, (3, 2, 3)), (0.0, (2, 2, 2)))} and len(found) == 4
