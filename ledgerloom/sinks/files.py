"""A data source that writes a file a statement: `df.write.format("statement-files")`. Its rows are
(file_name, content), a file's rows one after the other; tasks write to a folder of the job's own, which is
moved into place when all have ended, and deleted if one fails. Read again, a folder of a task is a partition:
the driver lists folders, tasks list files, and of a file's name the driver only ever holds a hash."""

from __future__ import annotations

import hashlib
import time
import uuid
from array import array
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "statement-files"
# Files and bytes of a batch that is read, at most (a larger file is a batch of its own).
BATCH_FILES, BATCH_BYTES = 1000, 8 << 20


def file_system(path: str):
    """(file system, path in it) of a URI or a local path, by what pyarrow can reach."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


class StatementFiles(DataSource):
    """Options: path; nothing else is read. Files land in path/part-<task>/<file_name>; mode overwrite
    replaces what is there, append adds to it."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file_name string, content binary"

    def reader(self, schema) -> FileReader:
        return FileReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if [(f.name, f.dataType.simpleString()) for f in schema.fields] != [("file_name", "string"), ("content", "binary")]:
            raise ValueError("statement-files takes the columns file_name string, content binary")
        made = FileWriter(self.options["path"], overwrite)
        file_system(made.path)[0].create_dir(made.staging, recursive=True)
        return made


@dataclass
class Folder(InputPartition):
    path: str


class FileReader(DataSourceReader):
    """(file_name, content) of what was written under a path, which may end with the folders' `/part-*`; a row a file."""

    def __init__(self, path: str):
        self.path = path.rstrip("/").removesuffix("/part-*")

    def partitions(self) -> list[Folder]:
        from pyarrow import fs

        files, path = file_system(self.path)
        return [Folder(f.path) for f in files.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.Directory and f.base_name.startswith("part-")]

    def read(self, partition: Folder):
        import pyarrow as pa
        from pyarrow import fs

        files, names, contents, held = file_system(self.path)[0], [], [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["file_name", "content"])
        for f in files.get_file_info(fs.FileSelector(partition.path)):
            if names and (len(names) >= BATCH_FILES or held + f.size > BATCH_BYTES):
                yield made()
                names, contents, held = [], [], 0
            with files.open_input_stream(f.path) as source:
                contents.append(source.read())
            names.append(f.base_name)
            held += f.size
        if names:
            yield made()


@dataclass
class Written(WriterCommitMessage):
    """hashes: eight bytes for each name."""

    folder: str
    hashes: bytes


def name_hash(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


class FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex[:12]

    @property
    def staging(self) -> str:
        return f"{file_system(self.path)[1]}/_job-{self.job}"

    def write(self, batches) -> Written:
        """A task's own files; a repeated or speculative attempt has a folder of its own. The job's folder is not
        made here: a task that still runs when the job is aborted finds it gone and fails."""
        files, ctx = file_system(self.path)[0], TaskContext.get()
        folder, hashes, last, out = f"part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}", array("Q"), None, None
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None or name != last:
                    if out is not None:
                        out.close()
                    if name is None or "/" in name or name in (".", ".."):
                        raise ValueError(f"not a file name: {name!r}")
                    if not hashes:
                        files.create_dir(f"{self.staging}/{folder}", recursive=False)
                    hashes.append(name_hash(name))
                    last = name
                    out = files.open_output_stream(f"{self.staging}/{folder}/{name}")
                out.write(content or b"")
        if out is not None:
            out.close()
        return Written(folder, hashes.tobytes())

    def twice(self, made: list[Written]) -> str | None:
        """A file name that two tasks, or one task twice, have written. Hashes tell where to look: only folders of a hash that comes
        twice are listed, one at a time, and only names of such hashes are compared."""
        from pyarrow import fs

        hashes = np.sort(np.concatenate([np.frombuffer(m.hashes, np.uint64) for m in made])) if made else np.empty(0, np.uint64)
        again = {int(h) for h in hashes[1:][hashes[1:] == hashes[:-1]]}
        seen: set[str] = set()
        for m in made if again else ():
            own = [int(h) for h in np.frombuffer(m.hashes, np.uint64) if int(h) in again]
            if own:
                found = [f.base_name for f in file_system(self.path)[0].get_file_info(fs.FileSelector(f"{self.staging}/{m.folder}")) if name_hash(f.base_name) in again]
                if names := seen.intersection(found):
                    return min(names)
                if len(found) < len(own):  # a name that was opened twice is one file
                    return next(n for n in found if own.count(name_hash(n)) > 1)
                seen.update(found)
        return None

    def commit(self, messages) -> None:
        """One move a task. A file name that two tasks, or one task twice, have written ends the job: its rows did not stand together."""
        from pyarrow import fs

        files, path = file_system(self.path)
        made = [m for m in messages if m is not None and m.hashes]
        if (name := self.twice(made)) is not None:
            self.abort(messages)
            raise ValueError(f"rows of the file {name!r} did not stand together")
        old = [f for f in files.get_file_info(fs.FileSelector(path, allow_not_found=True)) if not f.path.endswith(f"_job-{self.job}")] if self.overwrite else []
        files.create_dir(path, recursive=True)
        for m in made:
            files.move(f"{self.staging}/{m.folder}", f"{path}/{m.folder}-{self.job}")
        for f in old:
            (files.delete_dir if f.type == fs.FileType.Directory else files.delete_file)(f.path)
        self.abort(messages)
        with files.open_output_stream(f"{path}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        from pyarrow import fs

        files = file_system(self.path)[0]
        for left in range(20, -1, -1):  # a task that is being stopped may still add a file
            try:
                if files.get_file_info(self.staging).type != fs.FileType.NotFound:
                    files.delete_dir(self.staging)
                return
            except OSError:
                if not left:
                    raise
                time.sleep(0.1)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StatementFiles)
