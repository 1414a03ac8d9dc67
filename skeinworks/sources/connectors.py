"""Caches and observations as data sources: ``spark.read.format("skein_cache")`` and ``format("skein_observations")``.

Both split into partitions of whole files and take filters before anything is opened: a filter on ``home`` leaves only
the folders that it names, and filters on a cache's columns skip what Parquet's statistics rule out. Filters are pushed
where the session sets ``spark.sql.python.filterPushdown.enabled``; ``register`` does.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import IntegerType, StructType

#: Folders of observations, and files of a cache, that a partition has at most.
TOGETHER = 64
_MANIFEST = re.compile(r"(\d{8})\.json")
_COMPARED = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CacheSource)
    spark.dataSource.register(ObservationSource)


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


@dataclass
class Files(InputPartition):
    """(place, path) of files, or folders."""

    files: tuple[tuple[int, str], ...]


def _dealt(files: list[tuple[int, str]]) -> list[InputPartition]:
    return [Files(tuple(files[i : i + TOGETHER])) for i in range(0, len(files), TOGETHER)] or [Files(())]


class CacheSource(DataSource):
    """All rows of a log's folders with ``_place``, the number of their folder; option ``version`` for one other than the last."""

    @classmethod
    def name(cls) -> str:
        return "skein_cache"

    def files(self) -> list[tuple[int, str]]:
        fs, root = _opened(self.options["path"])
        known = sorted(int(m[1]) for f in fs.get_file_info(pafs.FileSelector(f"{root}/_log", allow_not_found=True)) if (m := _MANIFEST.fullmatch(f.base_name)))
        version = int(self.options.get("version", known[-1] if known else 0))
        if version not in known:
            raise ValueError(f"{self.options['path']} has no version {version}, or no longer")
        with fs.open_input_file(f"{root}/_log/{version:08d}.json") as stream:
            folders = json.loads(stream.read())["folders"]
        infos = [(i, f) for i, name in enumerate(folders) for f in fs.get_file_info(pafs.FileSelector(f"{root}/{name}", recursive=True))]
        return sorted((i, f.path) for i, f in infos if f.base_name.endswith(".parquet"))

    def schema(self) -> StructType:
        fs, _ = _opened(self.options["path"])
        with fs.open_input_file(self.files()[0][1]) as stream:
            return from_arrow_schema(pq.read_schema(stream).remove_metadata()).add("_place", IntegerType())

    def reader(self, schema: StructType) -> DataSourceReader:
        return CacheReader(self.options["path"], self.files(), schema)


class CacheReader(DataSourceReader):
    def __init__(self, path: str, files: list[tuple[int, str]], schema: StructType):
        self.path, self.files, self.columns, self.taken = path, files, [f.name for f in schema.fields if f.name != "_place"], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (*_COMPARED, In)) and len(f.attribute) == 1 and f.attribute[0] in self.columns:
                self.taken.append((f.attribute[0], type(f), tuple(f.value) if isinstance(f, In) else f.value))
            elif not (isinstance(f, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in {a for a, _, _ in self.taken}):
                yield f

    def partitions(self) -> list[InputPartition]:
        return _dealt(self.files)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(self.path)
        kept = None
        for column, kind, value in self.taken:
            one = pc.field(column).isin(list(value)) if kind is In else _COMPARED[kind](pc.field(column), pa.scalar(value))
            kept = one if kept is None else kept & one
        for place, path in partition.files:
            table = pq.read_table(path, filesystem=fs, columns=self.columns, filters=kept, partitioning=None)
            for batch in table.to_batches():
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([place] * batch.num_rows, pa.int32())], names=[*self.columns, "_place"])


class ObservationSource(DataSource):
    """A folder's */observation.json: source, home (its folder's name), expected (what observation.sha256 holds), actual, text."""

    @classmethod
    def name(cls) -> str:
        return "skein_observations"

    def schema(self) -> str:
        return "source string, home string, expected string, actual string, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ObservationReader(self.options["path"])


class ObservationReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.homes = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("home",):
                named = set(f.value) if isinstance(f, In) else {f.value}
                self.homes = named if self.homes is None else self.homes & named
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = _opened(self.path)
        if self.homes is None:
            folders = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.Directory]
        else:  # the folder itself need not be listed
            folders = [f"{root}/{h}" for h in self.homes if isinstance(h, str) and h and "/" not in h and h not in (".", "..")]
        return _dealt([(0, f) for f in sorted(folders)])

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = _opened(self.path)

        def content(path: str) -> bytes | None:
            if fs.get_file_info(path).type != pafs.FileType.File:
                return None
            with fs.open_input_file(path) as stream:
                return stream.read()

        for _, folder in partition.files:
            data = content(f"{folder}/observation.json")
            if data is not None:
                expected = content(f"{folder}/observation.sha256")
                yield f"{folder}/observation.json", folder.rsplit("/", 1)[1], None if expected is None else expected.decode("ascii", "replace").strip(), f"sha256:{hashlib.sha256(data).hexdigest()}", data.decode("utf-8", "replace")
