"""Files of lines that grow, as a stream: each file is read on from the byte where the last whole line ended."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from runlens.operators import cost
from runlens.shared import prepare

_USAGE = "struct<type:string,isSidechain:boolean,message:struct<model:string,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>>>"


@dataclass
class _Ranges(InputPartition):
    """(path, begin, end) ranges of bytes for one task; lines that begin in a range belong to it."""

    ranges: list[tuple[str, int, int]]


class _Reader(DataSourceStreamReader):
    """Offsets have for each file the byte behind its last whole line. They are as many as the files, which the driver lists."""

    def __init__(self, path: str, suffix: str, per_task: int) -> None:
        self.path, self.suffix, self.per_task = path, suffix, per_task
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
        out = {}
        for f in found:
            if f.is_file and f.path.endswith(self.suffix):
                size, end = self.known.get(f.path, (-1, 0))
                if size != f.size:
                    end = _whole_lines(store, f.path, f.size)
                    self.known[f.path] = (f.size, end)
                out[f.path] = end
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out, held, size = [], [], 0
        for path, stop in sorted(end.items()):
            begin = start.get(path, 0) if start.get(path, 0) <= stop else 0  # a shorter file is another one
            while begin < stop:
                cut = min(stop, begin + self.per_task - size)
                held.append((path, begin, cut))
                size, begin = size + cut - begin, cut
                if size >= self.per_task:
                    out.append(_Ranges(held))
                    held, size = [], 0
        return [*out, _Ranges(held)] if held else out

    def read(self, partition: _Ranges) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.path)
        for path, begin, end in partition.ranges:
            with store.open_input_file(path) as f:
                f.seek(max(0, begin - 1))
                if begin and f.read(1) != b"\n":
                    begin += len(_line(f))
                while begin < end:
                    line = _line(f)
                    if not line.endswith(b"\n"):
                        break
                    yield path, begin, line[:-1].decode("utf-8", "replace")
                    begin += len(line)

    def commit(self, end: dict) -> None:
        pass


def _line(f) -> bytes:  # noqa: ANN001
    """The rest of a line, with its end."""
    parts = []
    while part := f.read(1 << 16):
        at = part.find(b"\n")
        if at >= 0:
            f.seek(f.tell() - len(part) + at + 1)
            return b"".join([*parts, part[: at + 1]])
        parts.append(part)
    return b"".join(parts)


def _whole_lines(store: fs.FileSystem, path: str, size: int) -> int:
    """The byte behind the last line end; a half line waits for its rest."""
    with store.open_input_file(path) as f:
        while size > 0:
            low = max(0, size - (1 << 16))
            f.seek(low)
            at = f.read(size - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            size = low
    return 0


class GrowingLines(DataSource):
    """format("growing_lines") with path, suffix (.jsonl) and per_task bytes: (path, position, line)."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "path string, position long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return _Reader(self.options["path"], self.options.get("suffix", ".jsonl"), int(self.options.get("per_task", 32 << 20)))


def growing_lines(spark: SparkSession, path: str, suffix: str = ".jsonl") -> DataFrame:
    """A stream of (path, position, line) of all files below path, which may grow: what is added to a file comes with the next trigger, a half line once it is whole.

    Position is the byte at which a line begins. A file that got shorter is read from its begin again; files that go are forgotten.
    """
    prepare(spark)
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("path", path).option("suffix", suffix).load()


def usage_events(lines: DataFrame) -> DataFrame:
    """(path, turns, model, input, output, cache_read, cache_write) of a batch of transcript lines: a row for each transcript whose main thread has new turns with usage.

    The last of them names the model. Lines that aren't JSON are left out.
    """
    turn = F.from_json("line", _USAGE)
    turns = lines.select("path", F.col("position").alias("pos"), turn.alias("m")).select("path", "pos", "m.type", "m.isSidechain", "m.message.model", "m.message.usage")
    return cost.usage(cost.main_thread(turns), "path")


def write_whole(rows: DataFrame, path: str, key: str = "name", order: str = "pos", line: str = "line") -> None:
    """Writes rows as files path/<key> of their lines by order, each file whole in one task: a file that there is already grows if its first lines are the same."""
    prepare(rows.sparkSession)

    def write(frame):  # noqa: ANN001, ANN202
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{frame[key].iloc[0]}") as f:
            f.write("".join(frame.sort_values(order)[line]).encode())
        return frame[[key]].head(1)

    rows.select(key, order, line).groupBy(key).applyInPandas(write, f"{key} string").write.format("noop").mode("overwrite").save()


def transcript_line(model: Column, input_: Column, output: Column, sidechain: Column, type_: Column) -> Column:
    """A transcript's line as JSON."""
    usage = F.when(type_ == "assistant", F.struct(input_.alias("input_tokens"), output.alias("output_tokens")))
    return F.to_json(F.struct(type_.alias("type"), sidechain.alias("isSidechain"), F.struct(model.alias("model"), usage.alias("usage")).alias("message")))
