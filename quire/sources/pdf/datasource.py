"""``spark.read.format("pdf")``: a table of the reader as a Python data source.

    spark.dataSource.register(PdfSource)
    spark.read.format("pdf").option("table", "lines").load("/data/pdfs")

Files are listed by the driver, and each is a partition, so the folder must be one that
the driver and all executors see; for stores that only Spark's own readers open, use
``reader.read_pdf``. With the option ``ranged`` a file is read in parts: a linearised
file of which only the first page is asked (``pages`` 1) is not read to its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quire.sources.pdf import ranged, reader


class FilePart(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return reader.SCHEMAS[self.options.get("table", "documents")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return PdfReader(schema, dict(self.options))


def document_id(path: str) -> int:
    """The same as read_pdf's, so that tables of both join: XXH64 with seed 42, signed."""
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(path.encode(), 42)
    return x - (1 << 64) if x >> 63 else x


class PdfReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns, self.options = schema.names, options
        self.only = {int(p) for p in options["pages"].split(",")} if options.get("pages") else None

    def partitions(self) -> list[InputPartition]:
        at = Path(self.options["path"].removeprefix("file:")).resolve()
        return [FilePart(f"file:{p}") for p in (sorted(x for x in at.rglob("*") if x.is_file()) if at.is_dir() else [at])]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        name, path = self.options.get("table", "documents"), Path(partition.path.removeprefix("file:"))
        data = self._parts(path) if self.options.get("ranged", "").lower() == "true" else path.read_bytes()
        doc_id = document_id(partition.path)
        for r in reader.records(name, partition.path, data, self.options.get("password", ""), self.only):
            yield tuple((r | {"doc_id": doc_id}).get(c) for c in self.columns)

    def _parts(self, path: Path) -> bytes:
        """The file with what the first page needs, if that is all that is asked and the file says where it ends; else all of it."""
        with path.open("rb") as f:

            def read(offset: int, length: int) -> bytes:
                f.seek(offset)
                return f.read(length)

            r = ranged.Ranged(read, path.stat().st_size)
            return bytes(r.data) if self.only == {1} and ranged.first_page_end(bytes(r.data[:2048])) else r.complete()
