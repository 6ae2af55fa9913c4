"""Incremental screens on tiles drawn from the suppliers: four suppliers share a
tile of 48 x 48 pixels, each with a cell of its own. The reference SQL knows
barcodes, counts and positions from the drawing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans import screens
from tessera.plans.queries_raster import spread
from tessera.plans.registry import query
from tessera.session import shared_folder

LETTERS = "ACGT"
N_CYCLES = 4

# nucleus, body and three spots of every cell: two with one barcode, one with another
CELLS_SQL = """
s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 8 < 4 THEN 'A1' ELSE 'B2' END AS well, s_suppkey // 4 AS site, (s_suppkey % 4)::INTEGER AS q,
  (12 + 24 * ((s_suppkey % 4) // 2))::INTEGER AS ci, (12 + 24 * (s_suppkey % 2))::INTEGER AS cj, s_nationkey AS n FROM supplier)"""


def drawn_cells(t):
    k = F.col("s_suppkey")
    q = k % 4
    return spread(t.supplier, "s_suppkey").select(
        k.alias("k"), F.when(k % 8 < 4, "A1").otherwise("B2").alias("well"), F.floor(k / 4).alias("site"), q.cast("int").alias("q"),
        (12 + 24 * F.floor(q / 2)).cast("int").alias("ci"), (12 + 24 * (k % 2)).cast("int").alias("cj"), F.col("s_nationkey").alias("n"))


def base_number(k, n, cycle, other):
    """Which base a spot shows: changes from cycle to cycle, differs between the two barcodes."""
    return (k + n * cycle + cycle * (1 + other) + cycle * cycle + 2 * other) % 4


def scene(t):
    """Raw pixels; cycle c is moved by c - 1 pixels along i and 1 or none along j, around the edges."""
    cell = drawn_cells(t)
    spots = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(o).alias("o")) for a, b, o in ((-7, 0, 0), (0, 7, 0), (7, 0, 1))])
    i, j = F.col("i") - F.col("ci"), F.col("j") - F.col("cj")
    px = cell.withColumn("i", F.explode(F.sequence(F.col("ci") - 12, F.col("ci") + 11))).withColumn("j", F.explode(F.sequence(F.col("cj") - 12, F.col("cj") + 11)))
    px = px.withColumn("cycle", F.explode(F.sequence(F.lit(1), F.lit(N_CYCLES)))).withColumn("channel", F.explode(F.array(*map(F.lit, [*LETTERS, "DAPI"]))))
    body = F.when(i * i + j * j <= 64, 400).otherwise(50)
    number = F.array_position(F.array(*map(F.lit, LETTERS)), F.col("channel")) - 1

    def bright(s):
        far = (i - s["a"]) * (i - s["a"]) + (j - s["b"]) * (j - s["b"])
        shows = base_number(F.col("k"), F.col("n"), F.col("cycle"), s["o"]) == number
        return F.when(shows & (far <= 2), F.element_at(F.array(F.lit(4000), F.lit(2400), F.lit(1500)), far.cast("int") + 1)).otherwise(0)

    signal = F.when(F.col("channel") == "DAPI", F.when(i * i + j * j <= (4 + F.col("k") % 3) * (4 + F.col("k") % 3), 3000).otherwise(100) + (F.col("i") + F.col("j")))
    signal = signal.otherwise(body + F.aggregate(F.transform(spots, bright), F.lit(0), lambda a, b: a + b))
    moved = {"i": (F.col("i") + F.col("cycle") - 1) % 48, "j": (F.col("j") + (F.col("cycle") - 1) % 2) % 48}
    return px.withColumn("value", signal.cast("bigint")).withColumns({c: v.cast("int") for c, v in moved.items()}).select(
        "well", "site", "cycle", "channel", "i", "j", "value")


def screen_of(spark, px):
    """The sequencing screen over some pixels, written as files of whole tiles."""
    root = shared_folder(spark, "screen")
    px.repartition("well", "site").write.parquet(f"{root}/pixels")
    return screens.sequencing_screen(
        spark, f"{root}/steps", f"{root}/pixels", px.schema, N_CYCLES, LETTERS, nuclei_threshold=1000, nuclei_area=(20, 300), cell_threshold=300,
        threshold_peaks=200, peak_width=3, max_width=3, correction="none", align={"within": False, "upsample": 1, "window": 1.0}, buckets=8)


BARCODE = "(SELECT string_agg(substr('ACGT', 1 + ((k + n * c + c * (1 + {o}) + c * c + 2 * {o}) % 4)::INTEGER, 1), '' ORDER BY c) FROM (SELECT unnest(range(1, 5)) AS c))"


@query("screen_from_pixels", f"""
WITH {CELLS_SQL}, b AS (SELECT *, {BARCODE.format(o=0)} AS b0, {BARCODE.format(o=1)} AS b1 FROM s),
first AS (SELECT *, ci - (4 + k % 3) AS top FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY well, site ORDER BY top, cj) AS cell FROM first)
SELECT well, site, cell::INTEGER AS cell, b0 AS cell_barcode_0, 2::BIGINT AS cell_barcode_count_0, b1 AS cell_barcode_1, 1::BIGINT AS cell_barcode_count_1, 3::BIGINT AS barcode_count,
  z.area, round(ci + z.i, 6)::DOUBLE AS i, round(cj + z.j, 6)::DOUBLE AS j FROM n, (SELECT count(*) AS area, avg(a) AS i, avg(c) AS j FROM (SELECT unnest(range(-12, 12)) AS a), (SELECT unnest(range(-12, 12)) AS c)
  WHERE a * a + c * c <= 64 OR (a + 7) * (a + 7) + c * c <= 2 OR a * a + (c - 7) * (c - 7) <= 2 OR (a - 7) * (a - 7) + c * c <= 2) AS z""")
def _(t):
    screen = screen_of(t.spark, scene(t))
    screen.run()
    found = screen.table("barcodes").join(screen.table("positions").select("well", "site", "cell", "area", "i", "j"), ["well", "site", "cell"])
    names = ["cell_barcode_0", "cell_barcode_count_0", "cell_barcode_1", "cell_barcode_count_1", "barcode_count", "area"]
    return found.filter("cell > 0").select("well", "site", F.col("cell").cast("int").alias("cell"), *names, F.round("i", 6).alias("i"), F.round("j", 6).alias("j"))
