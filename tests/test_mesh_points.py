"""Points in a mesh stay in their rows."""

from gridloom.operators import mesh


def test_points_are_joined_to_their_cell_alone(spark):
    square = [(0, 0.0, 0.0, 4.0, 0.0, 0.0, 4.0), (1, 4.0, 0.0, 4.0, 4.0, 0.0, 4.0)]
    bins = spark.createDataFrame(square, "bin_id long, ax double, ay double, bx double, by double, cx double, cy double")
    spots = [(0, 1.0, 1.0), (1, 3.5, 3.5), (2, 2.0, 2.0), (3, 9.0, 9.0), (4, None, 1.0), (6, float("nan"), 1.0), (5, 4.0, 4.0), (1, 3.5, 3.5)]
    found = mesh.mesh_bin_at(spark.createDataFrame(spots, "id long, x double, y double"), bins, 1.5)
    assert sorted((r.id, r.bin_id) for r in found.collect()) == [(0, 0), (1, 1), (1, 1), (2, 0), (3, -1), (4, -1), (5, 1), (6, -1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_row" not in plan and plan.count("Aggregate") == 1
