"""Label files as a data source: ``spark.read.format("conll")``, ``readStream``, and ``write``.

A file is read in ranges of bytes, each by a task that holds one line at a time, so
files may be larger than an executor's memory. A sentence belongs to the range that it
begins in. Its number isn't known in the middle of a file; the place of its first byte
is, and stands for it.

A write gives each task a folder of its own beside the label files, with one file for
each name and a list of them; the folders count from the moment on that the driver has
written down which ones belong to the job (``_commits/<job>.json``). So a reader sees
all files of a job or none, attempts that were lost or aborted are never read, and no
file is renamed.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

SCHEMA = "file string, sent_at long, pos int, text string, label string"
#: Fixed value: the token that sentences leave out.
MIDDLE_DOT = "‧"
SPLIT = 64 * 2**20
BOM = b"\xef\xbb\xbf"


@dataclass
class Range(InputPartition):
    """Bytes ``start`` to ``end`` of a file."""

    path: str
    name: str
    start: int
    end: int


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, inner


def _files(options: dict) -> list[tuple[str, str, int, int]]:
    """Path, name, size and time of the label files of a folder (or the one file), by name; with ``latest`` only the last name of each id."""
    from pyarrow import fs

    path = options["path"]
    system, inner = _open(path)
    if system.get_file_info(inner).type == fs.FileType.File:
        infos, folder = [system.get_file_info(inner)], path.rsplit("/", 1)[0]
    else:
        infos, folder = system.get_file_info(fs.FileSelector(inner)), path.rstrip("/")
    labels = lambda found: [i for i in found if i.type == fs.FileType.File and i.base_name.endswith(".conll")]
    found = [(i.base_name, i.size, i.mtime_ns or 0, f"{folder}/{i.base_name}") for i in labels(infos)]
    # what a job wrote has the time of its commit, so that a stream that has been here since the files began doesn't miss them
    for job, time in commits(path).values():
        for part in job["parts"]:
            found += [(i.base_name, i.size, time, f"{folder}/{part}/{i.base_name}") for i in labels(system.get_file_info(fs.FileSelector(f"{inner}/{part}")))]
    found.sort()
    if options.get("latest", "false").lower() == "true":
        by_id = {name.removesuffix(".conll").split("_")[1]: (name, *rest) for name, *rest in found if "_" in name}
        found = sorted(by_id.values())
    return [(whole, name, size, time) for name, size, time, whole in found]


def commits(path: str) -> dict[str, tuple[dict, int]]:
    """What the jobs that wrote to a folder committed, and when, but for jobs that a later one replaced."""
    from pyarrow import fs

    system, inner = _open(path)
    infos = system.get_file_info(fs.FileSelector(f"{inner}/_commits", allow_not_found=True))
    jobs = {}
    for i in infos:
        if i.base_name.endswith(".json"):
            with system.open_input_stream(i.path) as f:
                jobs[i.base_name.removesuffix(".json")] = (json.loads(f.read()), i.mtime_ns or 0)
    gone = {old for job, _ in jobs.values() for old in job["replaces"]}
    return {name: job for name, job in jobs.items() if name not in gone}


def _ranges(files: list[tuple[str, str, int, int]], split: int) -> list[Range]:
    return [Range(path, name, at, min(at + split, size)) for path, name, size, _ in files for at in range(0, size, split)]


def _lines(part: Range) -> Iterator[tuple[int, str]]:
    """Place and text of the lines of all sentences that begin in the range; an empty line ends one."""
    system, inner = _open(part.path)
    with io.BufferedReader(system.open_input_file(inner)) as f:
        begins = True
        if part.start:
            # a sentence begins here if the line before is empty; else what comes first belongs to the range before.
            # The range may begin within a line, and within the two bytes of its end
            near = max(part.start - 8, 0)
            f.seek(near)
            behind = f.read(part.start - near)
            behind += b"" if behind.endswith(b"\n") else f.readline()
            behind = (behind if near else behind.removeprefix(BOM)).replace(b"\r\n", b"\n")
            begins = behind.endswith(b"\n\n") or (not near and behind == b"\n")
            if f.tell() >= part.end:
                return
        while True:
            at = f.tell()
            raw = f.readline()
            if not raw:
                return
            line = raw.decode("utf-8", "replace").removesuffix("\n").removesuffix("\r")
            if at == 0:
                line = line.removeprefix("﻿")
            if line == "":
                if at + len(raw) >= part.end:
                    return
                begins = True
                yield at, ""
            elif begins:
                yield at, line


def sentences(part: Range) -> Iterator[tuple[str, int, int, str, str]]:
    """Only empty lines part sentences, a tab parts token and label, else the last white space; middle dots are dropped, and sentences of nothing else."""
    start, pos = None, 0
    for at, line in _lines(part):
        if line == "":
            start, pos = None, 0
            continue
        start = at if start is None else start
        text, mark, label = line.partition("\t")
        if not mark:
            if len(line.split()) < 2:
                continue
            text, label = line.rstrip().rsplit(None, 1)
        if text != MIDDLE_DOT:
            yield part.name, start, pos, text, label
            pos += 1


def entities(part: Range) -> Iterator[tuple[str, int, int, str, str]]:
    """Lines stripped and split at white space, first part and last; lines of one part are skipped, blank ones part sentences too."""
    start, pos = None, 0
    for at, line in _lines(part):
        parts = line.split()
        if not parts:
            start, pos = None, 0
        elif len(parts) > 1:
            start = at if start is None else start
            yield part.name, start, pos, parts[0], parts[-1]
            pos += 1
        else:
            start = at if start is None else start


FORMS = {"sentences": sentences, "entities": entities}


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.names = options, None

    def pushFilters(self, filters):
        """Which files are asked for is settled here; no other file is opened."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("file",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = asked if self.names is None else self.names & asked
            else:
                yield f

    def partitions(self):
        files = [f for f in _files(self.options) if self.names is None or f[1] in self.names]
        return _ranges(files, int(self.options.get("split", SPLIT))) or [Range("", "", 0, 0)]

    def read(self, partition):
        if partition.path:
            yield from FORMS[self.options.get("form", "sentences")](partition)


class _StreamReader(DataSourceStreamReader):
    """New files by time and name; what a file gets later isn't read again."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self):
        return {"time": 0, "name": ""}

    def latestOffset(self):
        last = max(((t, n) for _, n, _, t in _files(self.options)), default=(0, ""))
        return {"time": last[0], "name": last[1]}

    def partitions(self, start, end):
        low, high = ((o["time"], o["name"]) for o in (start, end))
        return _ranges([f for f in _files(self.options) if low < (f[3], f[1]) <= high], int(self.options.get("split", SPLIT)))

    def read(self, partition):
        return FORMS[self.options.get("form", "sentences")](partition)


@dataclass
class Written(WriterCommitMessage):
    part: str
    files: int
    lines: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator):
        """One line in memory at a time; names come in order, so that each is there once."""
        system, inner = _open(self.path)
        part = f"part-{self.job}-{TaskContext.get().taskAttemptId()}"
        folder = f"{inner}/{part}"
        out, listed, name, files, total = None, None, None, 0, 0

        def close():
            out.close()
            listed.write(json.dumps({"file": name, "lines": lines, "bytes": size, "sha256": digest.hexdigest()}).encode() + b"\n")

        try:
            for row in iterator:
                if out is None or row.file != name:
                    if not row.file or not row.file.endswith(".conll") or row.file[0] in "._" or "/" in row.file:
                        raise ValueError(f"not the name of a label file: {row.file!r}")
                    if out is None:
                        system.create_dir(folder)
                        listed = system.open_output_stream(f"{folder}/manifest.jsonl")
                    else:
                        close()
                        if row.file < name:
                            raise ValueError(f"lines aren't in the order of their files: {row.file} comes after {name}")
                    name, files, lines, size, digest = row.file, files + 1, 0, 0, hashlib.sha256()
                    out = system.open_output_stream(f"{folder}/{name}", buffer_size=2**20)
                data = f"{row.line}\n".encode()
                out.write(data)
                digest.update(data)
                lines, size, total = lines + 1, size + len(data), total + 1
            if out:
                close()
        finally:
            for f in (out, listed):
                if f and not f.closed:
                    f.close()
        return Written(part, files, total)

    def _parts(self, jobs: set[str]):
        """Folders that attempts of these jobs made, and where."""
        from pyarrow import fs

        system, inner = _open(self.path)
        infos = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
        return system, inner, [i.base_name for i in infos if i.base_name.startswith("part-") and i.base_name.split("-")[1] in jobs]

    def commit(self, messages):
        written = [m for m in messages if m and m.files]
        old = set(commits(self.path)) if self.overwrite else set()
        job = {"parts": sorted(m.part for m in written), "files": sum(m.files for m in written), "lines": sum(m.lines for m in written), "replaces": sorted(old)}
        system, inner, made = self._parts({self.job} | old)
        system.create_dir(f"{inner}/_commits")
        with system.open_output_stream(f"{inner}/_commits/{self.job}.tmp") as f:
            f.write(json.dumps(job).encode())
        system.move(f"{inner}/_commits/{self.job}.tmp", f"{inner}/_commits/{self.job}.json")
        for part in set(made) - set(job["parts"]):
            system.delete_dir(f"{inner}/{part}")

    def abort(self, messages):
        system, inner, made = self._parts({self.job})
        for part in made:
            system.delete_dir(f"{inner}/{part}")


class ConllSource(DataSource):
    """``file, sent_at, pos, text, label`` of the ``*.conll`` files of a folder, or of one file.

    Options: ``form`` (``sentences`` or ``entities``, the two ways of reading), ``latest``
    (of names with one id the last), ``split`` (bytes of a range). Empty files and
    folders give no rows.

    Written are ``file, line``, in the order of ``file``, all lines of a file by one task:
    ``write_label_files`` sees to both. ``overwrite`` replaces what earlier jobs wrote, not
    other files of the folder.
    """

    @classmethod
    def name(cls):
        return "conll"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options))

    def streamReader(self, schema):
        return _StreamReader(dict(self.options))

    def writer(self, schema, overwrite):
        if not {"file", "line"} <= set(schema.names):
            raise ValueError("label files are written from the columns file and line")
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session; filters on ``file`` go to the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ConllSource)


def write_label_files(labels: DataFrame, path: str, prefix: str = "doc", suffix: str = "silver", overwrite: bool = False) -> None:
    """One file for each document of ``doc_id, idx, text, label, is_word``, named ``<prefix>_<id>_<suffix>.conll``; all are there at once, or none.

    Documents are dealt over the session's shuffle partitions and sorted there; the
    driver learns of a task's files only where they are and how many.
    """
    from marginalia.operators.spans import conll_lines

    register(labels.sparkSession)
    name = F.concat(F.lit(f"{prefix}_"), F.col("doc_id").cast("string"), F.lit(f"_{suffix}.conll"))
    rows = conll_lines(labels).select(name.alias("file"), "idx", "line").repartition("file").sortWithinPartitions("file", "idx")
    rows.select("file", "line").write.format("conll").mode("overwrite" if overwrite else "append").save(path)


def written_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, lines, bytes, sha256`` of all files that jobs have committed to a folder."""
    lists = [f"{path.rstrip('/')}/{part}/manifest.jsonl" for job, _ in commits(path).values() for part in job["parts"]]
    kind = "file string, lines long, bytes long, sha256 string"
    return spark.read.schema(kind).json(lists) if lists else spark.createDataFrame([], kind)
