"""``spark.read.format("sqlite_table")``: a table of a SQLite file (GeoPackage too), read in ranges of row ids.

Options: path (in a folder that all executors share), table, schema (DDL of the columns wanted), parts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class SqliteTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


class _Reader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.table, self.parts = options["path"], options["table"].replace('"', '""'), int(options.get("parts", 8))
        self.names = schema.names

    def _ask(self, sql: str, args: tuple = ()):
        import sqlite3

        db = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            yield from db.execute(sql, args)
        finally:
            db.close()

    def partitions(self) -> list[InputPartition]:
        lo, hi = next(self._ask(f'SELECT min(rowid), max(rowid) FROM "{self.table}"'))
        if lo is None:
            return [InputPartition((0, 0))]
        step = max(1, -(-(hi - lo + 1) // self.parts))
        return [InputPartition((a, min(a + step, hi + 1))) for a in range(lo, hi + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        columns = ", ".join('"' + n.replace('"', '""') + '"' for n in self.names)
        yield from self._ask(f'SELECT {columns} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', partition.value)
