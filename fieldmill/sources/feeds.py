"""Source adapters as a Spark data source: sources are pulled in turn, and a stream's offset is the cursor over them."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "listing_feed"
SCHEMA = "source string, external_id string, text string, published_at string"


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path there; a plain path, or one behind file:, is local or mounted."""
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


class Adapter(ABC):
    """What a kind of source has to give: its sources, how far one reaches now, the raw items between two places, and an item's columns."""

    @abstractmethod
    def sources(self) -> list[str]: ...

    @abstractmethod
    def reach(self, source: str) -> int: ...

    @abstractmethod
    def fetch(self, source: str, begin: int, end: int) -> Iterator[dict]: ...

    def stretches(self, source: str) -> list[tuple[int, int]]:
        """What can be read apart; no item may lie across two."""
        return [(0, self.reach(source))]

    def normalise(self, source: str, raw: dict) -> dict | None:
        """The columns of an item; None leaves it out, as one without an identifier."""
        if raw.get("external_id") is None:
            return None
        return {"source": source} | raw


@dataclass
class JsonLines(Adapter):
    """Sources are folders of a shared file system, named source=... or plainly; their items are lines of JSON in files that only grow or are added.

    A place in a source is a number of bytes over its files in order of name, so new files need later names.
    """

    path: str

    def _at(self) -> tuple[pafs.FileSystem, str]:
        return _file_system(self.path)

    def _files(self, source: str) -> list[pafs.FileInfo]:
        fs, root = self._at()
        found = fs.get_file_info(pafs.FileSelector(f"{root}/{source}"))
        return sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.base_name)

    def sources(self) -> list[str]:
        fs, root = self._at()
        return sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(root)) if not f.is_file and not f.base_name.startswith(("_", ".")))

    def reach(self, source: str) -> int:
        return sum(f.size for f in self._files(source))

    def stretches(self, source: str) -> list[tuple[int, int]]:
        ends = list(accumulate(f.size for f in self._files(source)))
        return list(zip([0, *ends], ends))

    def fetch(self, source: str, begin: int, end: int) -> Iterator[dict]:
        fs, _ = self._at()
        at = 0
        for f in self._files(source):
            low, high = max(begin - at, 0), min(end - at, f.size)
            if low < high:
                with fs.open_input_file(f.path) as stream:
                    stream.seek(low)
                    for line in _lines(stream, high - low):
                        try:
                            raw = json.loads(line)
                        except ValueError:
                            continue
                        if isinstance(raw, dict):
                            yield raw
            at += f.size

    def normalise(self, source: str, raw: dict) -> dict | None:
        return super().normalise(source.removeprefix("source="), raw)


def _lines(stream, left: int) -> Iterator[bytes]:
    """Lines of the next `left` bytes, a block at a time."""
    rest = b""
    while left > 0 and (block := stream.read(min(left, 1 << 20))):
        left -= len(block)
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


@dataclass
class _Part(InputPartition):
    source: str
    begin: int
    end: int


class _Rows:
    def __init__(self, adapter: Adapter, names: list[str]):
        self.adapter, self.names = adapter, names

    def read(self, part: _Part) -> Iterator[tuple]:
        for raw in self.adapter.fetch(part.source, part.begin, part.end):
            if (item := self.adapter.normalise(part.source, raw)) is not None:
                yield tuple(None if (v := item.get(c)) is None else v if isinstance(v, str) else json.dumps(v) for c in self.names)


class FeedReader(_Rows, DataSourceReader):
    """All of every source, in the stretches that its adapter names."""

    def partitions(self) -> list[_Part]:
        return [_Part(s, begin, end) for s in self.adapter.sources() for begin, end in self.adapter.stretches(s)]


class FeedStream(_Rows, DataSourceStreamReader):
    """Each batch visits the next sources from the cursor on, around the end, and reads what they have beyond the place where they were left.

    An offset is the cursor and the place in each source, one number a source. Spark asks for the latest offset without
    saying where the query stands, so finished offsets are also kept in the folder `kept`: a query that starts again
    goes on from there. That is one batch behind at most, and visiting the same sources again then adds only what is new.
    """

    def __init__(self, adapter: Adapter, names: list[str], size: int, kept: str):
        super().__init__(adapter, names)
        self.size, self.kept = size, kept
        fs, root = _file_system(kept)
        fs.create_dir(root)
        files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".json"))
        self.count, self.now = len(files), self.initialOffset()
        if files:
            self.count = int(files[-1].rsplit("/", 1)[1].removesuffix(".json")) + 1
            with fs.open_input_file(files[-1]) as f:
                self.now = json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"cursor": 0, "places": {}}

    def latestOffset(self) -> dict:
        """Where the next visit ends; the same offset while no source has anything new."""
        sources = self.adapter.sources()
        size = max(1, min(self.size, len(sources)))
        places, cursor = self.now["places"], self.now["cursor"]
        for _ in range(-(-len(sources) // size)):
            reach = {s: self.adapter.reach(s) for s in (sources[(cursor + i) % len(sources)] for i in range(size))}
            cursor = (cursor + size) % len(sources)
            if any(n > places.get(s, 0) for s, n in reach.items()):
                self.now = {"cursor": cursor, "places": places | {s: max(n, places.get(s, 0)) for s, n in reach.items()}}
                break
        return self.now

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        # A batch that was planned before a restart is read again as it was planned.
        if sum(end["places"].values()) > sum(self.now["places"].values()):
            self.now = end
        return [_Part(s, start["places"].get(s, 0), n) for s, n in sorted(end["places"].items()) if n > start["places"].get(s, 0)]

    def commit(self, end: dict) -> None:
        fs, root = _file_system(self.kept)
        at = f"{root}/{self.count:012d}"
        with fs.open_output_stream(f"{at}.part") as f:
            f.write(json.dumps(end).encode())
        fs.move(f"{at}.part", f"{at}.json")
        if self.count > 1:
            before = f"{root}/{self.count - 2:012d}.json"
            if fs.get_file_info(before).is_file:
                fs.delete_file(before)
        self.count += 1


class FeedSource(DataSource):
    """format("listing_feed"); options: path; on a stream also cursor, a folder of the query's own, and sources_per_batch (5). The schema has text columns only. Subclasses give another adapter."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def adapter(self) -> Adapter:
        return JsonLines(self.options["path"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeedReader(self.adapter(), schema.names)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FeedStream(self.adapter(), schema.names, int(self.options.get("sources_per_batch", "5")), self.options["cursor"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedSource)
