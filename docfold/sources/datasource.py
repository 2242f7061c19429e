"""Books as a data source, batch and stream, and documents as a sink: ``spark.read.format("epub")``, ``df.write.format("yaml_documents")``.

Files are reached by pyarrow's file systems (local and mounted paths, and the stores that it knows by their URI); ``read_epubs`` goes
through Spark's own instead, and so does ``export`` where they aren't local or mounted. The driver lists folders once; archives are opened, and documents written, by tasks alone.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from docfold.operators.increments import decode
from docfold.sources.epub import PAGES, ROWS, book_id, page_text, spine_of

#: Bytes of archives that a task reads, about: small ones share a task, larger ones are cut by ranges of their members.
BYTES = 64 << 20


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EpubSource)
    spark.dataSource.register(DocumentSink)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    plain = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:") if path.startswith("file:") else path
    return pafs.FileSystem.from_uri(plain) if "://" in plain else (pafs.LocalFileSystem(), posixpath.abspath(plain))


def archives(path: str) -> list[tuple[int, str, int]]:
    """(time of change, path, bytes) of the archives that a path stands for: a file, all of a folder, or those of a pattern."""
    fs, at = file_system(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        found = [info]
    elif info.type == pafs.FileType.Directory:
        found = [f for f in fs.get_file_info(pafs.FileSelector(at)) if f.base_name.lower().endswith(".epub")]
    else:
        folder, name = posixpath.split(at)
        found = [f for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if fnmatch.fnmatch(f.base_name, name)]
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.type == pafs.FileType.File)


@dataclass
class Share(InputPartition):
    """What a task reads: (archive, range number, number of ranges)."""

    parts: list[tuple[str, int, int]]


def shares(files: list[tuple[int, str, int]], most: int) -> list[Share]:
    """Files dealt to tasks by their sizes alone, in order of their paths."""
    out: list[Share] = []
    room = 0
    for _, path, size in sorted(files, key=lambda f: f[1]):
        ranges = max(1, -(-size // most))
        if ranges == 1 and size <= room:
            out[-1].parts.append((path, 0, 1))
            room -= size
            continue
        out += [Share([(path, k, ranges)]) for k in range(ranges)]
        room = most - size if ranges == 1 else 0
    return out


def pages_in(fs: pafs.FileSystem, path: str, part: int, ranges: int, with_text: bool) -> Iterator[tuple]:
    """The pages of a range of an archive's members, in its reading order. Only these members are read."""
    with fs.open_input_file(path) as raw, zipfile.ZipFile(raw) as z:
        order = spine_of(z) or [n for n in z.namelist() if posixpath.splitext(n)[1].lower() in PAGES]
        for i in range(len(order) * part // ranges, len(order) * (part + 1) // ranges):
            title, text = page_text(z.read(order[i])) if with_text else (None, None)
            yield book_id(path), i, title, text, order[i]


class EpubSource(DataSource):
    """``pos, title, text`` of every page of every book. Options: ``path``; ``maxBytes`` of archives for a task;
    ``text`` false to list members without reading any."""

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: StructType) -> EpubReader:
        return EpubReader(dict(self.options))

    def streamReader(self, schema: StructType) -> EpubStream:  # noqa: N802
        return EpubStream(dict(self.options))


class _Pages:
    def __init__(self, options: dict[str, str]) -> None:
        given = {k.lower(): v for k, v in options.items()}
        self.path, self.most = given["path"], int(given.get("maxbytes", BYTES))
        self.with_text = given.get("text", "true").lower() != "false"

    def read(self, partition: Share | None) -> Iterator[tuple]:
        fs, _ = file_system(self.path)
        for path, part, ranges in partition.parts if partition else ():  # without any, Spark still runs one task
            yield from pages_in(fs, path, part, ranges, self.with_text)


class EpubReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Share]:
        return shares(archives(self.path), self.most)


class EpubStream(_Pages, DataSourceStreamReader):
    """New archives of a folder, in order of their times of change and paths. The offset is the last one's; an archive that comes with an
    older time than that is not seen, so files are to be written (or moved with a new time), not kept under old times."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        found = archives(self.path)
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Share]:
        after, upto = (start["time"], start["path"]), (end["time"], end["path"])
        return shares([f for f in archives(self.path) if after < f[:2] <= upto], self.most)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    documents: int


class DocumentSink(DataSource):
    """(book, schema, state: JSON) as YAML files ``<path>/<version>/<book>/<schema>.yaml``. Tasks write all files of a new version; the
    commit is one file, ``<path>/current.json``, that names it. Until then, and if it fails, readers see the version before."""

    @classmethod
    def name(cls) -> str:
        return "yaml_documents"

    def schema(self) -> str:
        return "book string, schema string, state string"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        if not overwrite:
            raise ValueError("documents are written as a whole: use mode('overwrite')")
        return DocumentWriter({k.lower(): v for k, v in self.options.items()}["path"], [f.name for f in schema.fields])


class DocumentWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.version, self.columns = path, uuid.uuid4().hex, columns

    def write(self, iterator: Iterator) -> Written:
        from docfold.sinks.ledger import to_yaml

        fs, at = file_system(self.path)
        n, made = 0, set()
        for row in iterator:
            book, schema, state = (row[self.columns.index(c)] for c in ("book", "schema", "state"))
            folder = f"{at}/{self.version}/{quote(book, safe='')}"
            if folder not in made:
                fs.create_dir(folder)
                made.add(folder)
            with fs.open_output_stream(f"{folder}/{quote(schema, safe='')}.yaml") as out:
                out.write(to_yaml(decode(state)).encode())
            n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = file_system(self.path)
        fs.create_dir(at)
        beside = f"{at}/_{self.version}.json"
        with fs.open_output_stream(beside) as out:
            out.write(json.dumps({"version": self.version, "documents": sum(m.documents for m in messages if m)}).encode())
        fs.move(beside, f"{at}/current.json")

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = file_system(self.path)
        if fs.get_file_info(f"{at}/{self.version}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{at}/{self.version}")


def current(path: str) -> dict | None:
    """What the sink's last commit says: version and number of documents; nothing without one."""
    fs, at = file_system(path)
    if fs.get_file_info(f"{at}/current.json").type != pafs.FileType.File:
        return None
    with fs.open_input_stream(f"{at}/current.json") as f:
        return json.loads(f.read())
