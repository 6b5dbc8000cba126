"""Raw runs of text, as a page's renderer gives them, to positioned items. `raw-runs` is a data source over JSON
files, one partition a file: {"statement_id", "pages": [{"page", "height", "items": [{"str", "transform", "width", "height"}]}]}."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import squeeze

RAW = "statement_id long, page long, page_height double, seq long, text string, transform array<double>, width double, height double"
# Fixed value: the size of a font that a run does not tell.
FONT_SIZE = 10.0


def normalise_runs(raw: DataFrame) -> DataFrame:
    """(statement_id, page, x, y, width, height, font_size, seq, text) of raw runs (RAW): y from the top of the
    page down, font size from the transform. Blank runs and those with fewer than six numbers go; a
    number that is null is 0, a height that is null or not positive is the font's."""
    at = lambda i: F.coalesce(F.get("transform", F.lit(i)), F.lit(0.0))
    sized: Column = F.hypot(at(1), at(3))
    size = F.when(sized > 0, sized).when(F.abs(at(3)) > 0, F.abs(at(3))).otherwise(F.lit(FONT_SIZE))
    kept = raw.where((squeeze(F.coalesce("text", F.lit(""))) != "") & F.coalesce(F.size("transform") >= 6, F.lit(False)))
    return kept.select("statement_id", "page", at(4).alias("x"), (F.col("page_height") - at(5)).alias("y"), F.coalesce("width", F.lit(0.0)).alias("width"), F.when(F.col("height") > 0, F.col("height")).otherwise(size).alias("height"), size.alias("font_size"), "seq", "text")


class RawRuns(DataSource):
    """Options: path, a folder or a file that every executor can reach. A file that is no such JSON ends its task
    with its name."""

    @classmethod
    def name(cls) -> str:
        return "raw-runs"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> DataSourceReader:
        return RunsReader(self.options["path"])


class RunsReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        from ..sinks.files import file_system

        files, path = file_system(self.path)
        info = files.get_file_info(path)
        if info.type == fs.FileType.File:
            return [InputPartition(path)]
        return [InputPartition(f.path) for f in files.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.base_name.endswith(".json")]

    def read(self, partition: InputPartition):
        from ..sinks.files import file_system

        with file_system(self.path)[0].open_input_stream(partition.value) as f:
            try:
                given = json.loads(f.read())
            except ValueError as e:
                raise ValueError(f"{partition.value}: {e}") from e
        number = lambda v: None if v is None else float(v)
        for page in given.get("pages") or ():
            for seq, item in enumerate(page.get("items") or ()):
                transform = item.get("transform")
                yield (given["statement_id"], page["page"], number(page["height"]), seq, item.get("str"), None if transform is None else [number(v) for v in transform], number(item.get("width")), number(item.get("height")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawRuns)
