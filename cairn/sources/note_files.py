"""``note_files``: a Spark data source for trees of Markdown notes.

``spark.read.format("note_files")`` with the options

* ``roots``: JSON object, project -> URI of the folder that holds its ``.memory`` folder;
* ``what``: ``notes`` (default), one row per note file or error, or ``index``,
  one row per line of the index documents with its byte offset;
* ``splitBytes``: bytes of files (``notes``) or of one document (``index``) that one task reads.

The file list is made once, when the scan is planned, and cut into partitions
by size; a partition carries its own list. Rows are read in batches of bounded size.

``df.write.format("note_files").mode("append").save(root)`` writes rows
(rel string, body string) as files ``root/rel``. A task writes each file
under a hidden name and renames it, so readers and failed tasks never see or
leave half a file, and a repeated task writes the same files again. Every task
lists its files in a hidden folder before it writes them. A job that succeeds
removes the lists. One that fails takes the folder away and removes
the listed files; a task that still writes then misses the folder and removes
its own file. Files that a failed job has replaced are gone.

File systems are those of ``pyarrow.fs`` (local, HDFS, S3, GCS, Azure).
Register with ``register(spark)``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from cairn import schema as S

FILES = "project string, category string, stem string, text string, path string, error string"
INDEX = "project string, at long, line string"
SPLIT = 32 << 20
#: What opening a file costs, in bytes, and what one batch may hold.
OPEN_COST, BATCH = 4 << 10, 4 << 20
STAGED = ".write-"


def file_system(uri: str):
    """(pyarrow file system, path) of a URI or local path."""
    import pyarrow.fs as pafs

    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri.rstrip("/")
    scheme, rest = uri.split(":", 1)
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/").rstrip("/")
    fs, path = pafs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}:{rest}")
    return fs, path.rstrip("/")


def can_open(uri: str) -> bool:
    return uri.split(":", 1)[0] in ("file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss") if ":" in uri else True


def sizes(fs, folder: str) -> Iterator[tuple[str, int]]:
    """(name, bytes) of the files of a folder; of a local one they are listed one at a time."""
    import os

    import pyarrow.fs as pafs

    if fs.type_name == "local":
        with os.scandir(folder) as found:
            for x in found:
                if x.is_file():
                    yield x.name, x.stat().st_size
        return
    for x in fs.get_file_info(pafs.FileSelector(folder)):
        if x.type == pafs.FileType.File:
            yield x.base_name, x.size


def put(fs, path: str, data: bytes, mark: str) -> None:
    """The file at once: a hidden file is renamed; object stores show a file only when it is whole."""
    if fs.type_name not in ("local", "hdfs"):
        with fs.open_output_stream(path) as f:
            f.write(data)
        return
    folder, name = path.rsplit("/", 1)
    hidden = f"{folder}/.{name}.{mark}"
    try:
        with fs.open_output_stream(hidden) as f:
            f.write(data)
        if fs.type_name == "hdfs" and fs.get_file_info(path).is_file:
            fs.delete_file(path)  # a rename there does not replace
        fs.move(hidden, path)
    except BaseException:
        if fs.get_file_info(hidden).is_file:
            fs.delete_file(hidden)
        raise


# ------------------------------------------------------------------ read

@dataclass
class Part(InputPartition):
    """Files of one task: (project, category, path or None, error or None); or one byte range of a document."""

    files: list = field(default_factory=list)
    project: str | None = None
    path: str | None = None
    uri: str | None = None
    start: int = 0
    stop: int = 0

    def __post_init__(self):
        super().__init__(None)


class NoteReader(DataSourceReader):
    def __init__(self, options):
        self.roots = json.loads(options["roots"])
        self.index = options.get("what", "notes") == "index"
        self.split = int(options.get("splitbytes") or options.get("splitBytes") or SPLIT)

    def partitions(self):
        parts = self._documents() if self.index else self._trees()
        return parts or [Part()]

    def _documents(self):
        parts = []
        for project, root in sorted(self.roots.items()):
            fs, base = file_system(root)
            path = f"{base}/{S.EXPORT_DIR_NAME}/{S.EXPORT_INDEX_NAME}"
            info = fs.get_file_info(path)
            for at in range(0, info.size or 0, self.split) if info.is_file else ():
                parts.append(Part(project=project, uri=root, path=path, start=at, stop=min(at + self.split, info.size)))
        return parts

    def _trees(self):
        import pyarrow.fs as pafs

        parts, held, size = [], [], 0
        for row, n in self._listed(pafs):
            if held and size + n > self.split:
                parts.append(Part(files=held))
                held, size = [], 0
            held.append(row)
            size += n
        return [*parts, Part(files=held)] if held else parts

    def _listed(self, pafs):
        for project, root in sorted(self.roots.items()):
            fs, top = file_system(root)
            base = f"{top}/{S.EXPORT_DIR_NAME}"
            if fs.get_file_info(base).type != pafs.FileType.Directory:
                yield (project, root, None, None, f"No {S.EXPORT_DIR_NAME} directory found at {root}"), 1
                continue
            for folder in sorted(fs.get_file_info(pafs.FileSelector(base)), key=lambda x: x.base_name):
                category = folder.base_name
                if folder.type != pafs.FileType.Directory or category.startswith("."):
                    continue
                if category not in S.CATEGORIES:
                    yield (project, root, category, None, f"Unknown category: {category}"), 1
                    continue
                for f in sorted(fs.get_file_info(pafs.FileSelector(folder.path)), key=lambda x: x.base_name):
                    if not f.base_name.endswith(".md"):
                        continue
                    if f.type == pafs.FileType.File:
                        yield (project, root, category, f.path, None), OPEN_COST + f.size
                    else:
                        yield (project, root, category, None, f"{f.base_name}: is a directory"), 1

    def read(self, partition):
        yield from self._lines(partition) if partition.path else self._notes(partition)

    def _notes(self, part) -> Iterator:
        import pyarrow as pa

        kind = pa.schema([(n, pa.string()) for n in ("project", "category", "stem", "text", "path", "error")])
        held, size, opened = [], 0, {}
        for project, root, category, path, error in part.files:
            text = stem = None
            if path is not None:
                if root not in opened:
                    opened[root] = file_system(root)[0]
                name = path.rsplit("/", 1)[1]
                stem = name[:-3]
                with opened[root].open_input_stream(path) as f:
                    data = f.read()
                size += len(data)
                try:
                    text = data.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
                except UnicodeDecodeError as e:
                    error = f"{name}: not UTF-8 at byte {e.start}"
            held.append((project, category, stem, text, path, error))
            if size >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], schema=kind)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], schema=kind)

    def _lines(self, part) -> Iterator:
        """Lines that begin in the part's bytes; the last one is read to its end."""
        import pyarrow as pa

        kind = pa.schema([("project", pa.string()), ("at", pa.int64()), ("line", pa.string())])
        fs, _ = file_system(part.uri)
        with fs.open_input_file(part.path) as f:
            size, at = f.size(), max(0, part.start - 1)
            limit = part.stop if part.stop < size else size + 1  # an empty last line begins at the end
            f.seek(at)
            skip, rest, ats, lines, n = part.start > 0, b"", [], [], 0
            while at < limit:
                data = f.read(BATCH)
                *pieces, rest = (rest + data).split(b"\n")
                for p in pieces if data else [*pieces, rest]:
                    if not skip and at < limit:
                        ats.append(at)
                        lines.append(p.decode("utf-8", "replace"))
                        n += len(p)
                    skip = False  # the line that holds the byte before the range is another part's
                    at += len(p) + 1
                if n >= BATCH or not data or at >= limit:
                    yield pa.RecordBatch.from_arrays([pa.array([part.project] * len(ats), pa.string()), pa.array(ats, pa.int64()), pa.array(lines, pa.string())], schema=kind)
                    ats, lines, n = [], [], 0
                if not data:
                    return


# ----------------------------------------------------------------- write

@dataclass
class Written(WriterCommitMessage):
    manifest: str | None


class NoteWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.root, self.job = options["path"], uuid.uuid4().hex
        self.options = dict(options)

    def _folder(self):
        fs, base = file_system(self.root)
        return fs, base, f"{base}/{STAGED}{self.job}"

    def write(self, iterator):
        from pyspark import TaskContext

        fs, base, staged = self._folder()
        mark = str(TaskContext.get().taskAttemptId())
        made, manifest = set(), f"{staged}/{mark}"
        fs.create_dir(staged, recursive=True)
        with fs.open_output_stream(manifest) as names:
            for batch in iterator:
                for rel, body in zip(batch.column("rel").to_pylist(), batch.column("body").to_pylist()):
                    path = f"{base}/{rel}"
                    folder = path.rsplit("/", 1)[0]
                    if folder not in made:
                        fs.create_dir(folder, recursive=True)
                        made.add(folder)
                    names.write(rel.encode() + b"\n")
                    names.flush()
                    put(fs, path, (body or "").encode("utf-8"), mark)
                    if fs.get_file_info(staged).type.name == "NotFound":
                        fs.delete_file(path)
                        raise RuntimeError("the job was given up")
        return Written(manifest)

    def commit(self, messages):
        fs, _, staged = self._folder()
        if fs.get_file_info(staged).type.name == "Directory":
            fs.delete_dir(staged)

    def abort(self, messages):
        import pyarrow.fs as pafs

        fs, base, staged = self._folder()
        if fs.get_file_info(staged).type.name != "Directory":
            return
        gone = f"{staged}-gone"
        fs.move(staged, gone)
        for info in fs.get_file_info(pafs.FileSelector(gone)):
            with fs.open_input_stream(info.path) as f:
                for rel in f.read().decode().splitlines():
                    folder, name = f"{base}/{rel}".rsplit("/", 1)
                    for path in (f"{folder}/{name}", f"{folder}/.{name}.{info.base_name}"):
                        if fs.get_file_info(path).is_file:
                            fs.delete_file(path)
        fs.delete_dir(gone)


class NoteFiles(DataSource):
    @classmethod
    def name(cls):
        return "note_files"

    def schema(self):
        return INDEX if self.options.get("what") == "index" else FILES

    def reader(self, schema):
        return NoteReader(self.options)

    def writer(self, schema, overwrite):
        return NoteWriter(self.options)


def register(spark: SparkSession) -> None:
    from cairn.session import ship_package

    ship_package(spark)
    spark.dataSource.register(NoteFiles)
