"""One caption file a media, many a task: a Python data source that writes rows in order to named files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class _Written(WriterCommitMessage):
    n_files: int


class _Writer(DataSourceWriter):
    """Writes each run of rows of one name to a file, which gets its name when it is whole."""

    def __init__(self, root: str, extension: str):
        self.root, self.extension = root, extension

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, folder = fs.FileSystem.from_uri(self.root)
        store.create_dir(folder, recursive=True)
        name, out, part, n = None, None, "", 0

        def end() -> None:
            if out is not None:
                out.close()
                store.move(part, f"{folder}/{name}.{self.extension}")

        for row in iterator:
            if row[0] != name or out is None:
                end()
                name, part, n = row[0], f"{folder}/_part-{uuid.uuid4().hex}", n + 1
                out = store.open_output_stream(part)
            out.write(row[1].encode())
        end()
        return _Written(n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = fs.FileSystem.from_uri(self.root)
        store.create_dir(folder, recursive=True)
        store.open_output_stream(f"{folder}/_SUCCESS").close()


class CaptionFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "caption_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return _Writer(self.options["path"], self.options["extension"])


def write_files(rows: DataFrame, path: str, extension: str, *, media: str, order: str, text: str) -> None:
    """``<path>/<media>.<extension>`` with the media's texts in order, byte for byte.

    A media's rows meet in one task, sorted on disk if need be, and stream through it. A file appears
    under its name when it is whole; a task that runs again replaces it by the same bytes. ``path`` is a
    URI that every executor can write.
    """
    rows.sparkSession.dataSource.register(CaptionFiles)
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    (rows.repartition(media).sortWithinPartitions(media, order).select(F.col(media).cast("string").alias("name"), F.col(text).alias("value"))
     .write.format("caption_files").mode("append").option("path", uri).option("extension", extension).save())
