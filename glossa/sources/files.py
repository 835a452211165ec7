"""Finding books and files: listings are rows, and choices are expressions over them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import PAGE, be_uint

#: How many slices are inflated at once in a task: 16 MiB at most.
AT_ONCE = 256


def plain_name(name: Column) -> Column:
    """A file's name in lower case, without a version or a final dot, and without the suffix of compressed files."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"(;[0-9]+)?$|\.(;[0-9]+)?$", ""), r"\.ebz\.?$", "")


def chosen_file(listing: DataFrame, wanted: Column) -> DataFrame:
    """The file of each directory that has the wanted name; an uncompressed one comes before a compressed one. listing: directory, name."""
    packed = F.lower("name").rlike(r"\.ebz\.?(;[0-9]+)?$")
    fits = listing.where(plain_name(F.col("name")) == F.lower(wanted)).withColumn("packed", packed)
    return fits.groupBy("directory").agg(F.min(F.struct("packed", "name")).alias("x")).select("directory", "x.name", "x.packed")


def books(listing: DataFrame) -> DataFrame:
    """Directories that hold a catalog, EB or EPWING, by name. listing: directory, name."""
    kind = F.when(plain_name(F.col("name")) == "catalogs", "EPWING").when(plain_name(F.col("name")) == "catalog", "EB")
    found = listing.withColumn("disc", kind).where("disc IS NOT NULL")
    return found.groupBy("directory").agg(F.min("disc").alias("disc")).orderBy("directory")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """directory, name, length of all files under a path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    parts = F.split("path", "/")
    return files.select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("directory"), F.element_at(parts, -1).alias("name"), "length")


def byte_range(content: Column, at: Column, n: Column) -> Column:
    """Bytes from a location on: short at the end of the file, none where the length isn't positive."""
    return F.when(n > 0, F.substring(content, (at + 1).cast("int"), n.cast("int"))).otherwise(F.unhex(F.lit("")))


def paged(files: DataFrame, content: str = "content") -> DataFrame:
    """files exploded into numbered pages of 2048 bytes, the first being 1."""
    count = F.ceil(F.octet_length(content) / PAGE).cast("int")
    each = files.where(count > 0).withColumn("page", F.explode(F.sequence(F.lit(1), count)))
    return each.withColumn("bytes", F.substring(F.col(content), (F.col("page") - 1) * PAGE + 1, F.lit(PAGE))).drop(content)


def ebzip_slices(files: DataFrame, content: str = "content") -> DataFrame:
    """Header fields and the compressed slices of ebzip files: slice, raw (stored as it is), data, slice_size, file_size.

    A slice's size is 2048 shifted by the level; offsets have 2 to 5 bytes by the size of the file. Files without
    the magic word aren't here: they are plain.
    """
    c = F.col(content)
    at = lambda i, n: F.substring(c, i + 1, n)
    head = files.where(at(0, 5) == F.lit(b"EBZip")).withColumns({"level": (be_uint(at(5, 1)) % 16).cast("int"), "file_size": be_uint(at(9, 5))})
    # Level 15 and the like aren't valid: such files fail when they are read.
    head = head.withColumn("level", F.when(F.col("level") <= 5, F.col("level")).otherwise(F.raise_error("ebzip: bad level").cast("int")))
    size = (F.lit(PAGE) * F.pow(F.lit(2), F.col("level"))).cast("int")
    width = F.when(F.col("file_size") < 1 << 16, 2).when(F.col("file_size") < 1 << 24, 3).when(F.col("file_size") < 1 << 32, 4).otherwise(5)
    head = head.withColumns({"slice_size": size, "width": width})
    each = head.withColumn("slice", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("file_size") / F.col("slice_size")) - 1).cast("int"))))
    offset = lambda n: be_uint(F.substring(c, (F.lit(23) + n * F.col("width")).cast("int"), F.col("width").cast("int")))
    each = each.withColumns({"from": offset(F.col("slice")), "to": offset(F.col("slice") + 1)})
    data = F.substring(c, (F.col("from") + 1).cast("int"), (F.col("to") - F.col("from")).cast("int"))
    return each.withColumns({"data": data, "raw": F.col("to") - F.col("from") == F.col("slice_size")}).drop(content, "from", "to", "width")


def inflated(slices: DataFrame) -> DataFrame:
    """slices with ``bytes``: inflated, or as stored. One slice is 64 KiB at most; the last one is cut at the file's end.

    A task's Python holds a batch of compressed slices and ``AT_ONCE`` inflated ones.
    """
    left = F.col("file_size") - F.col("slice").cast("long") * F.col("slice_size")
    kept = [c for c in slices.columns if c not in ("data", "raw")]
    rows = slices.select(F.struct(*kept).alias("row"), "data", "raw")

    def inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                whole = [d.as_py() if r.as_py() else zlib.decompress(d.as_py()) for d, r in zip(part.column(1), part.column(2), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(whole, pa.binary())], names=["row", "bytes"])

    out = rows.mapInArrow(inflate, f"row {rows.schema['row'].dataType.simpleString()}, bytes binary").select("row.*", "bytes")
    return out.withColumn("bytes", F.substring("bytes", F.lit(1), F.least(left, F.col("slice_size").cast("long")).cast("int")))
