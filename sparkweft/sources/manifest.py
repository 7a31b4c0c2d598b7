"""Numbered manifests: what of a folder counts, decided by one writer a number."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from sparkweft.sources.store import _fs, _path


class Conflict(RuntimeError):
    """Another writer was first; read again and write again."""


class Manifests:
    """``<path>/log/<number>.json``; the newest whole one counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = _fs(spark, self.path)

    def _at(self, number: int):
        return _path(self.spark, f"{self.path}/log/{number:012d}.json")

    def numbers(self) -> list[int]:
        at = _path(self.spark, f"{self.path}/log")
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def newest(self) -> dict:
        for n in reversed(self.numbers()):
            stream = self.fs.open(self._at(n))
            try:
                return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
            except ValueError:  # its writer is at it yet, or died
                continue
            finally:
                stream.close()
        raise FileNotFoundError(f"nothing at {self.path}")

    def put(self, number: int, told: dict, *written: str) -> None:
        """Make a manifest. Where there is one of its number, what was ``written`` below the path for it goes."""
        try:
            out = self.fs.create(self._at(number), False)
        except Exception as e:
            for name in written:
                self.fs.delete(_path(self.spark, f"{self.path}/{name}"), True)
            raise Conflict(f"version {number} of {self.path} is taken") from e
        try:
            out.write(bytearray(json.dumps(told).encode()))
        finally:
            out.close()

    def vacuum(self, number: int, alive: set[str]) -> int:
        """Delete all but one manifest and the folders that are alive; how many folders went. Nobody may be reading them."""
        dead = [s.getPath() for s in self.fs.listStatus(_path(self.spark, self.path)) if s.getPath().getName() not in alive | {"log"}]
        for p in dead:
            self.fs.delete(p, True)
        for n in self.numbers():
            if n != number:
                self.fs.delete(self._at(n), False)
        return len(dead)
