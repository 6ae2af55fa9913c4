"""Extended phenotypes keep every region."""

from pyspark.sql import functions as F

from tessera.plans import workflows


def test_region_of_one_pixel_stays(spark):
    rows = [("A1", 0, ch, i, j, 100 + 7 * i + 3 * j * (ch + 1)) for ch in (0, 1) for i in range(6) for j in range(6)]
    px = spark.createDataFrame(rows, "well string, site long, channel int, i int, j int, value int")
    labels = spark.createDataFrame([("A1", 0, i, j, 1) for i in range(3) for j in range(3)] + [("A1", 0, 5, 5, 2)], "well string, site long, i int, j int, label int")
    got = workflows.extended_phenotype(px, {"cell": labels}, 0, [1], morphology=False)
    assert sorted(r["cell"] for r in got.collect()) == [1, 2]
