"""Data sources in Spark's own interface: addresses fetched as a batch or a stream, and
page files written with a commit.

Register them once a session (:func:`register`); then

    spark.read.format("fetched").option("path", folder).option("transport", "module:function").load()
    spark.readStream.format("fetched")...
    pages.write.format("page_files").option("path", folder).mode("append").save()

Folders may lie on any file system that ``pyarrow.fs`` opens by its address.
"""

from __future__ import annotations

import importlib
import posixpath
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from weftlake import staging
from weftlake.functions import urls
from weftlake.sources.readers import next_slot

FETCHED = "url string, host string, status int, body binary, error string"


def opened(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    if "://" not in address and not address.startswith("file:"):
        return fs.LocalFileSystem(), posixpath.abspath(address)
    at = "file://" + address.removeprefix("file:") if address.startswith("file:/") and not address.startswith("file://") else address
    return fs.FileSystem.from_uri(at)


def children(files: fs.FileSystem, folder: str) -> list[str]:
    """Names of what is in a folder, sorted; none if it is missing."""
    return sorted(posixpath.basename(f.path) for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)))


# ---- addresses to fetch ----


def write_addresses(requests: DataFrame, folder: str, url: str = "url", parts: int = 64, lanes: int = 1) -> int:
    """Adds the distinct addresses of ``requests`` to ``folder`` as its next batch and
    returns that batch's number; null addresses are left out.

    They are dealt by host into ``parts`` folders, a large host over ``lanes`` of them;
    whatever batch it is in, an address' host and lane decide its part, so one task has
    all of a lane. ``parts`` and ``lanes`` belong to the folder: other ones are an error."""
    spark, kind = requests.sparkSession, f"parts={parts},lanes={lanes}"
    found = [n for n in staging.children(spark, folder) if n.startswith("parts=")]
    if found not in ([], [kind]):
        raise ValueError(f"{folder} has {found[0]}, not {kind}")
    batch = len(staging.children(spark, f"{folder}/{kind}"))
    rows = requests.select(F.col(url).alias("url")).where("url is not null").distinct().withColumn("host", urls.host("url"))
    rows = rows.withColumn("lane", F.pmod(F.xxhash64("url"), F.lit(lanes)).cast("int")).withColumn("part", F.pmod(F.xxhash64("host", "lane"), F.lit(parts)).cast("int"))
    rows.repartition(parts, "part").sortWithinPartitions("part", "host", "lane", "url").write.partitionBy("part").parquet(f"{folder}/{kind}/batch={batch:08d}")
    return batch


def expression(f: Filter) -> pc.Expression | None:
    """A pushed filter on ``url`` or ``host`` as a condition on the addresses; None for others."""
    if not isinstance(f, EqualTo | In | StringStartsWith) or f.attribute not in (("url",), ("host",)):
        return None
    column = pc.field(f.attribute[0])
    if isinstance(f, In):
        return column.isin(pa.array(list(f.value), pa.string()))
    return column == f.value if isinstance(f, EqualTo) else pc.starts_with(column, f.value)


@dataclass
class Part(InputPartition):
    """One part of the addresses over a run of batches; a task asks for them in turn."""

    part: int
    folders: list[str]


class _Addresses:
    def __init__(self, options: dict) -> None:
        self.path, self.transport, self.delay = options["path"], options["transport"], float(options.get("delay", "0.2"))
        self.filters: list[Filter] = []

    def _top(self) -> tuple[fs.FileSystem, str, str]:
        files, root = opened(self.path)
        kind = next((n for n in children(files, root) if n.startswith("parts=")), "")
        return files, posixpath.join(root, kind) if kind else "", kind

    def batches(self) -> int:
        """How many batches are complete: those up to the first without its mark."""
        files, top, _ = self._top()
        done = 0
        while top and files.get_file_info(f"{top}/batch={done:08d}/_SUCCESS").type == fs.FileType.File:
            done += 1
        return done

    def parts(self, start: int, end: int) -> list[Part]:
        """Parts of the batches from ``start`` to before ``end``; only folders are listed here, never addresses."""
        files, top, _ = self._top()
        by: dict[int, list[str]] = {}
        for b in range(start, end):
            for name in children(files, f"{top}/batch={b:08d}"):
                if name.startswith("part="):
                    by.setdefault(int(name[5:]), []).append(f"{top}/batch={b:08d}/{name}")
        return [Part(p, folders) for p, folders in sorted(by.items())]

    def rows(self, part: Part | None) -> Iterator[tuple]:
        if part is None:  # Spark's single partition of a reader that has none
            return
        module, _, name = self.transport.partition(":")
        get: Callable = getattr(importlib.import_module(module), name)
        files, _, kind = self._top()
        lanes = int(kind.rpartition("=")[2])
        wanted = [x for f in self.filters if (x := expression(f)) is not None]
        last: dict[tuple, int] = {}
        for folder in part.folders:
            found = ds.dataset(folder, format="parquet", filesystem=files, exclude_invalid_files=False)
            for batch in found.to_batches(columns=["url", "host", "lane"], filter=reduce(lambda a, b: a & b, wanted) if wanted else None):
                for address, host, lane in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    # slots are counted from a fixed time, so tasks, batches and restarts have the same
                    last[host, lane], at = next_slot(time.time(), 0.0, self.delay, lane, lanes, last.get((host, lane), -1))
                    if (wait := at - time.time()) > 0:
                        time.sleep(wait)
                    try:
                        status, body = get(address)
                        good = 200 <= status < 300
                        yield address, host, status, body if good else None, None if good else f"HTTP {status}"
                    except Exception as e:  # a failed request is a row, whatever went wrong
                        yield address, host, None, None, str(e)


class FetchReader(_Addresses, DataSourceReader):
    def pushFilters(self, filters: list[Filter]):  # noqa: N802  the interface's name
        """Conditions on address or host decide what is asked at all; others are Spark's."""
        for f in filters:
            if expression(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[Part]:
        return self.parts(0, self.batches())

    def read(self, partition: Part | None) -> Iterator[tuple]:
        return self.rows(partition)


class FetchStream(_Addresses, DataSourceStreamReader):
    """Offsets are numbers of complete batches, so a restart asks for just what was not committed."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"batch": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"batch": self.batches()}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.parts(start["batch"], end["batch"])

    def read(self, partition: Part | None) -> Iterator[tuple]:
        return self.rows(partition)


class Fetched(DataSource):
    """``url, host, status, body, error`` of the addresses that :func:`write_addresses` put
    below ``path``, asked by ``transport`` (``module:function``, address to status and body)
    when they are read, ``delay`` seconds apart for each host. An empty or missing folder has
    no rows. A lost task asks for its part again. Filters on ``url`` and ``host`` keep
    addresses from being asked where ``spark.sql.python.filterPushdown.enabled`` is set."""

    @classmethod
    def name(cls) -> str:
        return "fetched"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema) -> FetchReader:
        return FetchReader(self.options)

    def streamReader(self, schema) -> FetchStream:  # noqa: N802
        return FetchStream(self.options)


# ---- page files ----


@dataclass
class Written(WriterCommitMessage):
    """What a task has put aside: its folder and totals, not its files."""

    folder: str
    files: int
    size: int


class FileWriter(DataSourceWriter):
    def __init__(self, options: dict, schema, overwrite: bool) -> None:
        if overwrite:
            raise ValueError("page_files only adds and replaces files: use mode('append')")
        self.path, self.at, self.body = options["path"], options.get("file", "local_path"), options.get("body", "html")
        if missing := {self.at, self.body} - set(schema.fieldNames()):
            raise ValueError(f"no column {', '.join(sorted(missing))}")
        self.aside = f"_aside-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        files, root = opened(self.path)
        own = posixpath.join(root, self.aside, uuid.uuid4().hex)  # an attempt's own, so a second one never meets it
        count = size = 0
        for row in iterator:
            if row[self.at] is None or row[self.body] is None:
                continue
            path = posixpath.normpath(row[self.at])
            if path.startswith(("/", "..")) or path == ".":
                raise ValueError(f"outside of the folder: {row[self.at]}")
            raw = row[self.body].encode() if isinstance(row[self.body], str) else bytes(row[self.body])
            files.create_dir(posixpath.dirname(posixpath.join(own, path)))
            with files.open_output_stream(posixpath.join(own, path)) as f:
                f.write(raw)
            count, size = count + 1, size + len(raw)
        return Written(own, count, size)

    def commit(self, messages: list[Written | None]) -> None:
        """Moves what tasks have put aside into place, task by task, then marks the folder."""
        files, root = opened(self.path)
        for m in filter(None, messages):
            found = [f.path for f in files.get_file_info(fs.FileSelector(m.folder, recursive=True, allow_not_found=True)) if f.type == fs.FileType.File]
            places = [posixpath.join(root, posixpath.relpath(f, m.folder)) for f in found]
            for folder in sorted({posixpath.dirname(p) for p in places}):
                files.create_dir(folder)
            with ThreadPoolExecutor(16) as pool:
                list(pool.map(files.move, found, places))
        self.abort(messages)
        files.create_dir(root)
        with files.open_output_stream(posixpath.join(root, "_SUCCESS")):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        """What tasks have put aside goes, that of failed and repeated attempts too."""
        files, root = opened(self.path)
        if files.get_file_info(posixpath.join(root, self.aside)).type == fs.FileType.Directory:
            files.delete_dir(posixpath.join(root, self.aside))


class PageFiles(DataSource):
    """One file a row below ``path``: column ``file`` (``local_path``) names it, ``body``
    (``html``) fills it. Files appear when all tasks have ended; a run that fails leaves none.
    A path that leads out of the folder fails the run; a null path or body has no file; of
    rows with one path, the one of the last partition stays. The moves are made by the
    driver, 16 at once: for very many pages a table is the better form (``write_pages``)."""

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    for source in (Fetched, PageFiles):
        spark.dataSource.register(source)
