"""Image files as pixel rows and back: plain grey-scale TIFF pages."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

# fixed values: TIFF tags and field types
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, KIND = 256, 257, 258, 259, 273, 277, 278, 279, 339
FIELD = {1: "B", 3: "H", 4: "I"}


def decode_pages(data: bytes) -> Iterator[np.ndarray]:
    """Pages of a grey-scale TIFF, stored plainly or deflated."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    at = struct.unpack(order + "I", data[4:8])[0]
    while at:
        n = struct.unpack(order + "H", data[at:at + 2])[0]
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack(order + "HHI", data[at + 2 + 12 * k:at + 10 + 12 * k])
            if kind not in FIELD:
                continue
            form = f"{order}{count}{FIELD[kind]}"
            size, place = struct.calcsize(form), at + 10 + 12 * k
            if size > 4:
                place = struct.unpack(order + "I", data[place:place + 4])[0]
            tags[tag] = struct.unpack(form, data[place:place + size])
        one = lambda tag, default: tags.get(tag, (default,))[0]
        if one(SAMPLES, 1) != 1 or one(COMPRESSION, 1) not in (1, 8, 32946):
            raise ValueError("only plain or deflated grey-scale TIFF pages can be read")
        strips = [data[o:o + c] for o, c in zip(tags[OFFSETS], tags[COUNTS])]
        raw = b"".join(strips if one(COMPRESSION, 1) == 1 else map(zlib.decompress, strips))
        letter = {1: "u", 2: "i", 3: "f"}[one(KIND, 1)]
        yield np.frombuffer(raw, f"{order}{letter}{one(BITS, 8) // 8}").reshape(one(HEIGHT, 0), one(WIDTH, 0))
        at = struct.unpack(order + "I", data[at + 2 + 12 * n:at + 6 + 12 * n])[0]


def encode_pages(pages: Sequence[np.ndarray]) -> bytes:
    """Deflated TIFF of equally typed pages; integers that fit become 16 bit,
    other numbers 32-bit floats."""
    out = bytearray(b"II*\0")
    link = len(out)
    out += b"\0\0\0\0"
    for page in pages:
        page = storage_type(page)
        body = zlib.compress(page.tobytes())
        start = len(out)
        out += body + b"\0" * (len(body) % 2)
        kind = {"u": 1, "i": 2, "f": 3}[page.dtype.kind]
        tags = [(WIDTH, page.shape[1]), (HEIGHT, page.shape[0]), (BITS, page.itemsize * 8), (COMPRESSION, 8), (262, 1), (OFFSETS, start),
                (SAMPLES, 1), (ROWS, page.shape[0]), (COUNTS, len(body)), (KIND, kind)]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags))
        for tag, value in tags:
            out += struct.pack("<HHII", tag, 4, 1, value)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def storage_type(page: np.ndarray) -> np.ndarray:
    if page.dtype == bool:
        return page.astype(np.uint8) * 255
    if page.dtype in (np.uint8, np.uint16, np.float32):
        return page
    if page.dtype.kind in "iu":
        small = page.astype(np.uint16)
        return small if (small == page).all() else page.astype(np.float32)
    if page.dtype == np.float64:
        return page.astype(np.float32)
    raise TypeError(f"cannot store pixels of type {page.dtype}")


def read_tiff(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, page, i, j, value). Files are decoded in tasks, scan line by scan
    line; pixels are exploded in the JVM."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def decode(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                for number, page in enumerate(decode_pages(content)):
                    lines = [row.astype(float) for row in page]
                    yield pd.DataFrame({"file": name, "page": number, "i": np.arange(len(lines)), "row": lines})

    lines = files.mapInPandas(decode, "file string, page int, i int, row array<double>")
    return lines.select("file", "page", "i", F.posexplode("row").alias("j", "value"))


def write_tiff(px: DataFrame, folder: str, keys: Sequence[str], page: str | None = None) -> DataFrame:
    """One TIFF per tile in ``folder``; returns the written paths. The folder is
    a URI of a store that all executors reach (``hdfs://``, ``s3://``, or
    ``file://`` for a shared mount); a plain path is for local masters only. A
    repeated task writes the same bytes again under the same name."""
    keys = list(keys)
    if "://" not in folder and not px.sparkSession.sparkContext.master.startswith("local["):
        raise ValueError("name the folder by a URI that all executors reach")
    cols = [*keys, "i", "j", "value"] + ([page] if page else [])

    def write(key, pdf):
        pages = []
        for _, part in pdf.groupby(page) if page else [(0, pdf)]:
            plane = np.zeros((part["i"].max() + 1, part["j"].max() + 1), dtype=part["value"].to_numpy().dtype)
            plane[part["i"], part["j"]] = part["value"]
            pages.append(plane)
        name = f"{folder.rstrip('/')}/" + "_".join(f"{k}-{v}" for k, v in zip(keys, key)) + ".tif"
        store, at = fs.FileSystem.from_uri(name)
        store.create_dir(os.path.dirname(at))
        part_name = f"{at}.{uuid.uuid4().hex}.part"
        with store.open_output_stream(part_name) as f:
            f.write(encode_pages(pages))
        store.move(part_name, at)
        return pd.DataFrame({"path": [name], "pages": [len(pages)]})

    return px.select(*cols).groupBy(*keys).applyInPandas(write, "path string, pages int")


def slice_series(px: DataFrame, n_sites: int, start_site: int = 0, end_site: int | None = None, custom: int | None = None) -> DataFrame:
    """Sites of a time series stored as frame = n_sites * t + site."""
    split = px.withColumns({"site": F.col("page") % n_sites, "t": F.floor(F.col("page") / n_sites).cast("int")})
    last = custom if custom is not None else end_site
    split = split.filter(F.col("site") >= start_site)
    return split.filter(F.col("site") < last) if last is not None else split


def sharpest_plane(px: DataFrame, keys: Sequence[str], z: str = "z", low: int | None = None, high: int | None = None) -> DataFrame:
    """The z plane whose Laplacian varies most, per tile; of all planes, or of
    those with low <= z < high."""
    from tessera.operators.ordered import attach

    planes = px if low is None else px.filter(F.col(z) >= low)
    planes = planes if high is None else planes.filter(F.col(z) < high)
    planes = planes.repartition(*keys, z)
    near = [F.sum("value").over(W.partitionBy(*keys, z, across).orderBy(along).rangeBetween(-1, 1)) for along, across in (("i", "j"), ("j", "i"))]
    inside = planes.withColumn("lap", near[0] + near[1] - 6 * F.col("value"))  # both sums hold the pixel itself
    score = inside.groupBy(*keys, z).agg(F.var_pop("lap").alias("score"))
    best = score.groupBy(*keys).agg(F.min_by(z, F.struct(-F.col("score"), F.col(z))).alias(z))
    return attach(px, best, [*keys, z])
