"""Published snapshots: a reader keeps the version it opened while a writer publishes the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from orrery.sources.kv import Backend, KeyExists


class Published:
    """Tables under ``root/<name>/``; for each number the backend has a key that names its folder.

    Publishing writes a folder that no one else writes, then claims the next number for it; of two
    writers one gets the number, the other the next one.  So ``load`` gives a whole table at any time, and
    a DataFrame that was loaded goes on reading the files it was opened with.
    """

    def __init__(self, backend: Backend, root: str):
        self.backend, self.root = backend, root.rstrip("/")

    def _key(self, name: str, number: int) -> str:
        return f"snapshots/{name}/{number:020d}"

    def number(self, name: str) -> int:
        found = self.backend.scan(f"snapshots/{name}/")
        return int(found[-1][0].rsplit("/", 1)[-1]) if found else 0

    def publish(self, name: str, df: DataFrame) -> int:
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        n = self.number(name) + 1
        while True:
            try:
                self.backend.apply({self._key(name, n): path.encode()}, exclusive=True)
            except KeyExists:
                n += 1
            else:
                return n

    def load(self, spark: SparkSession, name: str, number: int | None = None) -> DataFrame | None:
        path = self.backend.get(self._key(name, self.number(name) if number is None else number))
        return None if path is None else spark.read.parquet(path.decode())
