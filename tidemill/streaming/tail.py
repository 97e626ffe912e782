"""Growing log files as a streaming source: appended bytes only, complete lines only, and a file that shrank is read again."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes read at a time where the end of the last complete line is looked for.
_STEP = 1 << 16
LINES = "run string, line_no bigint, restarted boolean, value string"


def _files(root: str):  # noqa: ANN202 - a file system of pyarrow and a path on it
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def complete_length(system, path: str, size: int) -> int:  # noqa: ANN001
    """Bytes of a file up to the end of its last complete line."""
    with system.open_input_file(path) as file:
        end = size
        while end > 0:
            start = max(0, end - _STEP)
            at = file.read_at(end - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


@dataclass
class Stretch(InputPartition):
    """Bytes of one file to read."""

    path: str
    start: int
    stop: int
    restarted: bool


class TailReader(DataSourceStreamReader):
    """An offset is how far each file is read, up to the end of a line."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.name = options["path"], options.get("name", "run.jsonl")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"read": {}}

    def latestOffset(self) -> dict:  # noqa: N802
        from pyarrow import fs

        system, root = _files(self.root)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        logs = [i for i in found if i.is_file and (i.base_name == self.name or self.name.startswith("*") and i.base_name.endswith(self.name[1:]))]
        return {"read": {i.path: complete_length(system, i.path, i.size) for i in sorted(logs, key=lambda i: i.path)}}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for path, stop in end["read"].items():
            before = start["read"].get(path, 0)
            if stop != before:
                out.append(Stretch(path, before if stop > before else 0, stop, stop < before))
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        system, _ = _files(self.root)
        with system.open_input_file(partition.path) as file:
            file.seek(partition.start)
            at, rest = partition.start, b""
            while at + len(rest) < partition.stop:
                piece = file.read(min(_STEP * 16, partition.stop - at - len(rest)))
                if not piece:
                    return  # it shrank meanwhile; the next offset tells
                *lines, rest = (rest + piece).split(b"\n")
                for line in lines:
                    yield partition.path, at, partition.restarted, line.decode("utf-8", "replace")
                    at += len(line) + 1


class RunLogTail(DataSource):
    """spark.readStream.format("run_log_tail").load(root): the lines of all logs of a name (option name, run.jsonl unless given) below a root.

    line_no is the byte at which a line begins, so it grows through a file; restarted marks the lines of a file that is
    shorter than it was, from its first line on."""

    @classmethod
    def name(cls) -> str:
        return "run_log_tail"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> TailReader:  # noqa: ANN001, N802
        return TailReader(self.options)
