"""File names to metadata and back."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: the file name grammar, from the outermost folder to the suffix
HOME = r"((.*)\/)?"
DATASET = r"(([0-9]{8}).*?)\/"
SUBDIR = r"(?:(.*)\/)*"
MAG = r"(MAX_)?([0-9]+X)."
CYCLE = r"(?:([^_\.]*).*?(?:.*MMStack)?.)?"
WELL = r"([A-H][0-9]*)"
SITE = r"(?:[_-]Site[_-](([0-9]+)))?"
TILE = r"(?:_Tile-(([0-9]+)))?"
SUFFIX = r"(?:\.(.*))*\.(tif|pkl|csv|fastq)"
FOLDER = r"([0-9]+X).(?:([^_\.]*).*?)\/([A-H][0-9]+)(?:[_-]Site[_-](([0-9]+)))?\/?"

FILE_TAIL = SUBDIR + MAG + CYCLE + WELL + SITE + TILE + SUFFIX
# what a path must hold before a pattern that needs it is tried
HAS_SUFFIX, HAS_DATE = r"\.(?:tif|pkl|csv|fastq)", r"[0-9]{8}"
# pattern and the group number of each field, in order of priority
PATTERNS = [
    ("^" + HOME + DATASET + FILE_TAIL,
     dict(home=2, dataset=3, date=4, subdir=5, mag=7, cycle=8, well=9, site=10, tile=12, tag=14, ext=15)),
    ("^" + FILE_TAIL, dict(subdir=1, mag=3, cycle=4, well=5, site=6, tile=8, tag=10, ext=11)),
    ("^" + HOME + DATASET + FOLDER, dict(home=2, dataset=3, date=4, mag=5, cycle=6, well=7, site=8)),
    ("^" + FOLDER, dict(mag=1, cycle=2, well=3, site=4)),
]
FIELDS = ("home", "dataset", "date", "subdir", "mag", "cycle", "well", "site", "tile", "tag", "ext")

# fixed values: names of files exported from a stage series, by well number or by well name
EXPORT = r"^.*Well({well})_.*Seq(\d+).*?(\d+X).(?:([^_\.]*)_)?.*(\d{{4}})(?:\.(.*))*\.(.*)"
EXPORT_FIELDS = ("seq", "mag", "cycle", "m", "tag", "ext")


def normal_path(path: Column) -> Column:
    path = F.regexp_replace(path, r"\\", "/")
    path = F.regexp_replace(F.regexp_replace(path, r"/(\./)+", "/"), r"/+", "/")
    return F.regexp_replace(path, r"^\./|(?<=.)/$", "")


def parse_filename(path: Column, strict: bool = True) -> Column:
    """Struct of optional parts plus ``file``; no match raises, or is null."""
    path = normal_path(path)
    # one match per pattern: the wanted groups, or nothing if it does not match
    mark = "\u0001"
    texts = []
    for pattern, groups in PATTERNS:  # the dear patterns are tried only where a cheap test allows
        wanted = mark.join(f"${groups[f]}" if f in groups else "" for f in FIELDS)
        replaced = F.regexp_replace(path, pattern + ".*$", wanted)
        tried = F.try_element_at(F.filter(F.array(replaced), lambda x: F.contains(x, F.lit(mark))), F.lit(1))
        for test, needed in ((HAS_DATE, "date" in groups), (HAS_SUFFIX, "ext" in groups)):
            tried = F.when(path.rlike(test), tried) if needed else tried
        texts.append(tried)
    found = F.split(F.coalesce(*texts), mark)
    missing = F.raise_error(F.concat(F.lit("failed to parse filename: "), path)) if strict else F.lit(None)
    # the lambda's variable keeps the matches from being evaluated per field
    build = lambda f: F.struct(*[F.nullif(f[n], F.lit("")).alias(c) for n, c in enumerate(FIELDS)], path.alias("file"))
    matched = F.coalesce(found, missing.cast("array<string>"))
    return F.transform(F.array(matched), lambda f: F.when(f.isNotNull(), build(f)))[0]


def name_file(**parts: Column | str | None) -> Column:
    """Build a path from parts; a tile wins over a site, ``tag`` is required."""
    cols = {k: (v if isinstance(v, Column) else F.lit(v).cast("string")) for k, v in parts.items() if v is not None}
    if "tag" not in cols:
        raise ValueError("a file name needs a tag")
    get = lambda f: cols.get(f, F.lit(None).cast("string")).cast("string")
    place = F.coalesce(F.concat(F.lit("Tile-"), get("tile")), F.concat(F.lit("Site-"), get("site")))
    stem = F.concat_ws("_", get("mag"), get("cycle"), get("well"), place)
    name = F.concat_ws(".", stem, get("tag"), get("ext"))
    return normal_path(F.concat_ws("/", *[F.nullif(get(f), F.lit("")) for f in ("home", "dataset", "subdir")], name))


def guess_filename(tag: str, **parts) -> Column:
    return name_file(**{"subdir": "process", "mag": "10X", "ext": "tif", **parts, "tag": tag})


def parse_export(path: Column, by_name: bool = False) -> Column:
    pattern = EXPORT.format(well=r".\d\d" if by_name else r"\d+")
    fields = ["well" if by_name else "well_ix", *EXPORT_FIELDS]
    parts = [F.nullif(F.regexp_extract(path, pattern, n + 1), F.lit("")).alias(f) for n, f in enumerate(fields)]
    return F.when(path.rlike(pattern), F.struct(*parts))


def export_well(path: Column, wells) -> Column:
    """Well name by the first digit after ``Well`` in an export name."""
    number = F.regexp_extract(path, r"Well(\d)", 1).cast("int")
    return F.element_at(F.array(*map(F.lit, wells)), number)
