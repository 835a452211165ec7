"""A data source for disc files: pages of 2048 bytes, plain or ebzip, read by ranges.

A file is planned by its length alone. Each partition is a range of its bytes, or of its pages where first and last pages are
known, and a task reads only that: of a plain file the bytes of its pages, of a compressed one the header, its own part of
the offsets and the slices in its range, one range after the other where they are short and many. Rows are pages, so none is longer than 2048 bytes.

    spark.dataSource.register(DiscPages)
    spark.read.format("disc_pages").option("path", folder).load()

Options: ``path`` (a folder, read with all below it, or a file); ``names`` (plain file names, comma-separated; all others are passed over);
``first`` and ``last`` page; ``range_bytes`` for each task; ``mode``: ``failfast``, or ``permissive``, where what can't be read is a row
with an ``error`` instead of bytes, or ``drop``. Filters on the page and path are pushed down where the session allows it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

PAGE = 2048
MAGIC = b"EBZip"
HEADER = 22
#: How much of short ranges one task reads at most, and the number of tasks below which each range has its own.
TASK_BYTES, TASKS = 8 << 20, 64
SCHEMA = "path string, page long, bytes binary, error string"
#: What the session must allow for filters to reach a Python data source.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def plain(name: str) -> str:
    """A file's name in lower case, without a version, a final dot or the suffix of compressed files."""
    return re.sub(r"\.ebz\.?$", "", re.sub(r"\.?(;[0-9]+)?$", "", name.lower()))


def opened_at(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    path = re.sub(r"^file:/(?!/)", "file:///", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    """Pages first to last of a file, or the share of it from byte low to byte high, of ``size``; and other ranges that the task reads after it."""

    path: str
    size: int
    low: int
    high: int
    first: int
    last: int | None
    rest: list[Range] = field(default_factory=list)


@dataclass
class Packed:
    """An ebzip file's header: what a slice holds, how wide offsets are, and how many bytes and slices there are."""

    slice_size: int
    width: int
    file_size: int

    @property
    def slices(self) -> int:
        return -(-self.file_size // self.slice_size)


def header(head: bytes) -> Packed:
    mode, level, size = head[5] >> 4, head[5] & 15, int.from_bytes(head[9:14], "big")
    if mode not in (1, 2) or level > 5:
        raise ValueError(f"ebzip: mode {mode}, level {level}")
    return Packed(PAGE << level, 2 if size < 1 << 16 else 3 if size < 1 << 24 else 4 if size < 1 << 32 else 5, size)


def tasks(ranges: list[Range]) -> list[Range]:
    """Neighbouring ranges share a task up to ``TASK_BYTES``, where there are more than ``TASKS`` of them: a task's start costs more than a short read.

    A range of wanted pages counts as its pages.
    """
    length = lambda r: min(r.high - r.low, (r.last - r.first + 1) * PAGE) if r.last is not None else r.high - r.low
    most = min(TASK_BYTES, sum(map(length, ranges)) // TASKS)
    out: list[Range] = []
    held = 0
    for r in ranges:
        if out and held + length(r) <= most:
            out[-1].rest.append(r)
            held += length(r)
        else:
            out.append(r)
            held = length(r)
    return out or [Range("", 0, 0, 0, 1, 0)]


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.names = {x.strip().lower() for x in options.get("names", "").split(",") if x.strip()}
        self.first = int(options.get("first", 1))
        self.last = int(options["last"]) if "last" in options else None
        self.range_bytes = max(PAGE, int(options.get("range_bytes", 8 << 20)) // PAGE * PAGE)
        self.mode = options.get("mode", "failfast").lower()
        self.only: set[str] | None = None
        if self.mode not in ("failfast", "permissive", "drop"):
            raise ValueError(f"unknown mode: {self.mode}")

    def files(self) -> Iterator[tuple[str, int]]:
        """Paths and lengths, from the listing alone; hidden files are passed over, as by other readers."""
        from pyarrow import fs

        system, path = opened_at(self.path)
        # Paths are given as Spark gives them: with the scheme and host they were asked by.
        prefix = "file:" if self.path.startswith("file:") else self.path[: max(0, self.path.find(path.rstrip("/")))]
        top = system.get_file_info(path)
        found = [top] if top.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        for f in sorted(found, key=lambda f: f.path):
            if f.is_file and f.size and not f.base_name.startswith((".", "_")) and (not self.names or plain(f.base_name) in self.names):
                yield prefix + f.path, f.size

    def partitions(self) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        first, step = max(1, self.first), self.range_bytes // PAGE
        for path, size in self.files():
            if self.only is not None and path not in self.only:
                continue
            if self.last is not None and self.last - first < 64 * step:
                # Wanted pages are known, and few: they are all that is read, wherever they stand in a compressed file.
                out += [Range(path, size, 0, size, p, min(self.last, p + step - 1)) for p in range(first, self.last + 1, step)]
            else:
                out += [Range(path, size, at, min(size, at + self.range_bytes), first, self.last) for at in range(0, size, self.range_bytes)]
        return tasks(out)

    def read(self, task: InputPartition) -> Iterator[pa.RecordBatch]:
        for part in (task, *task.rest):
            if part.size:
                yield from self.read_range(part)

    def read_range(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, path = opened_at(part.path)
        with system.open_input_file(path) as file:
            head = file.read_at(min(HEADER, part.size), 0)
            rows = self.packed(file, head, part) if head[:5] == MAGIC else self.stored(file, part)
            for pages, data, errors in rows:
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(pages), pa.string()), pa.array(pages, pa.int64()), pa.array(data, pa.binary()), pa.array(errors, pa.string())], names=["path", "page", "bytes", "error"])

    def stored(self, file, part: Range, step: int = 512) -> Iterator[tuple]:
        first = max(part.first, part.low // PAGE + 1)
        last = min(x for x in (part.last, -(-part.high // PAGE)) if x is not None)
        for at in range(first, last + 1, step):
            n = min(step, last + 1 - at)
            data = file.read_at(min(n * PAGE, part.size - (at - 1) * PAGE), (at - 1) * PAGE)
            cuts = [data[i : i + PAGE] for i in range(0, len(data), PAGE)]
            yield range(at, at + len(cuts)), cuts, [None] * len(cuts)

    def packed(self, file, head: bytes, part: Range) -> Iterator[tuple]:
        try:
            z = header(head)
        except (ValueError, IndexError) as bad:
            if part.low == 0:
                yield from self.broken(None, 1, str(bad))
            return
        per = z.slice_size // PAGE
        # A range of a compressed file's bytes stands for the same share of its slices.
        low = max((part.first - 1) // per, z.slices * part.low // part.size)
        high = min(z.slices * part.high // part.size, (part.last - 1) // per + 1 if part.last is not None else z.slices)
        if low >= high:
            return
        table = file.read_at((high - low + 1) * z.width, HEADER + low * z.width)
        ends = [int.from_bytes(table[i : i + z.width], "big") for i in range(0, len(table), z.width)]
        for s in range(low, high):
            size = min(z.slice_size, z.file_size - s * z.slice_size)
            try:
                begin, end = ends[s - low], ends[s - low + 1]
                if not 0 <= begin <= end <= part.size:
                    raise ValueError(f"ebzip: slice {s} isn't in the file")
                data = file.read_at(end - begin, begin)
                # A slice that isn't shorter than its contents is stored as it is.
                whole = data if end - begin == z.slice_size else zlib.decompress(data)
                if len(whole) < size:
                    raise ValueError(f"ebzip: slice {s} is too short")
            except (ValueError, IndexError, zlib.error) as bad:
                yield from self.broken(s * per + 1, -(-size // PAGE), str(bad), part)
                continue
            pages = [p for p in range(s * per + 1, s * per + 1 + -(-size // PAGE)) if p >= part.first and (part.last is None or p <= part.last)]
            yield pages, [whole[(p - 1 - s * per) * PAGE : min(size, (p - s * per) * PAGE)] for p in pages], [None] * len(pages)

    def broken(self, page: int | None, n: int, why: str, part: Range | None = None) -> Iterator[tuple]:
        if self.mode == "failfast":
            raise ValueError(why)
        if self.mode == "permissive":
            pages = [None] if page is None else [p for p in range(page, page + n) if p >= part.first and (part.last is None or p <= part.last)]
            yield pages, [None] * len(pages), [why] * len(pages)


class FilteredPageReader(PageReader):
    """Takes bounds on the page and names of paths from a query's filters; Spark still applies all of them."""

    def pushFilters(self, filters):
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("page",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, In)):
                self.first = max(self.first, min(value, default=1) if isinstance(f, In) else value + isinstance(f, GreaterThan))
            if column == ("page",) and isinstance(f, (EqualTo, LessThan, LessThanOrEqual, In)):
                bound = max(value, default=0) if isinstance(f, In) else value - isinstance(f, LessThan)
                self.last = bound if self.last is None else min(self.last, bound)
            if column == ("path",) and isinstance(f, (EqualTo, In)):
                wanted = set(value) if isinstance(f, In) else {value}
                self.only = wanted if self.only is None else self.only & wanted
            yield f


class DiscPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "disc_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (FilteredPageReader if self.options.get("pushdown") == "true" else PageReader)(dict(self.options))


def disc_pages(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """path, page, bytes and error of the pages of all files under a path; see this module for the options."""
    spark.dataSource.register(DiscPages)
    # The path in full, as Spark's own readers name files.
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    path = there.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(there).toString()
    allowed = spark.conf.get(PUSHDOWN, "false")
    read = spark.read.format("disc_pages").option("path", path).option("pushdown", allowed)
    for k, v in options.items():
        if v is not None:
            read = read.option(k, str(v))
    return read.load()
