"""A content-addressed cache of tokenised tables: a manifest's hash is the place, and a table appears whole or not at all."""

from __future__ import annotations

import hashlib
import inspect
import json
import time
import types
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODES = ("online", "offline_only", "reuse_only")


def stable_hash(value: Any) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def code_hash(f: Callable) -> str:
    try:
        return hashlib.sha256(inspect.getsource(f).encode()).hexdigest()
    except (OSError, TypeError):
        return hashlib.sha256(repr(f).encode()).hexdigest()


def function_hash(f: Any) -> str:
    """What a function does: its code, constants, names, defaults and, in turn, what it closes over. Functions of one source line that
    hold different values differ."""

    def parts(x: Any, seen: tuple = ()) -> Any:
        if isinstance(x, types.FunctionType):
            if id(x) in seen:
                return "itself"
            seen = (*seen, id(x))
            cells = [parts(c.cell_contents, seen) for c in x.__closure__ or ()]
            return ["function", parts(x.__code__, seen), cells, [parts(d, seen) for d in x.__defaults__ or ()], sorted((k, parts(v, seen)) for k, v in (x.__kwdefaults__ or {}).items())]
        if isinstance(x, types.CodeType):
            return [x.co_code.hex(), list(x.co_names), list(x.co_varnames), [parts(c, seen) for c in x.co_consts]]
        if isinstance(x, (list, tuple)):
            return [type(x).__name__, *[parts(v, seen) for v in x]]
        if isinstance(x, dict):
            return sorted((str(k), parts(v, seen)) for k, v in x.items())
        if x is None or isinstance(x, (str, bytes, int, float, bool)):
            return repr(x)
        if callable(x) and not hasattr(x, "__dict__"):
            return getattr(x, "__qualname__", repr(type(x)))
        return [type(x).__qualname__, parts(dict(vars(x)), seen) if hasattr(x, "__dict__") and not isinstance(x, (type, types.ModuleType)) else getattr(x, "__name__", "")]

    return stable_hash(parts(f))


def cache_root(path: str, base: str) -> str:
    """Where a cache lies: a relative path counts from the project's folder; others, with a scheme too, stay."""
    return path if path.startswith("/") or "://" in path else f"{base.rstrip('/')}/{path}"


def fingerprint(df: DataFrame) -> dict[str, Any]:
    """Rows and an order-insensitive sum of their hashes, in one pass of partial sums."""
    h = F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0)).alias("h")).first()
    return {"rows": row.n, "hash": str(row.h), "columns": sorted(df.columns)}


class TokenCache:
    """A table lies under its manifest's hash. It is built in a staging folder of its own and appears by one rename, manifest and all, so that a
    reader sees a whole table or none; of builders of one table at a time the first to rename wins and the others read its table. The folder needs a file
    system whose renames are atomic and don't replace (HDFS, local disks)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def _fs(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def path(self, trainer: str, split: str, manifest: dict) -> str:
        return f"{self.root}/{trainer}/{split}/{stable_hash(manifest)}"

    def _manifest(self, path: str) -> dict | None:
        fs, p = self._fs(f"{path}/manifest.json")
        try:
            return json.loads(self.spark.read.text(str(p.toString()), wholetext=True).first()[0]) if fs.exists(p) else None
        except (json.JSONDecodeError, TypeError):
            return None  # cut short: not a table

    def get(self, path: str, manifest: dict, required: list[str]) -> DataFrame | None:
        """The table, unless it isn't there, is incomplete, of another manifest, or lacks columns."""
        fs, p = self._fs(f"{path}/dataset")
        if not fs.exists(p) or self._manifest(path) != manifest:
            return None
        df = self.spark.read.parquet(f"{path}/dataset")
        return df if set(required) <= set(df.columns) else None

    def _staged(self, df: DataFrame, manifest: dict, place: str) -> None:
        df.write.parquet(f"{place}/dataset")
        fs, p = self._fs(f"{place}/manifest.json")
        out = fs.create(p, False)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()

    def _moved(self, a: str, b: str) -> bool:
        """Whether folder a is now b. A rename onto a folder that is there would put a inside it: that is undone, and isn't a move."""
        fs, source = self._fs(a)
        _, target = self._fs(b)
        if fs.exists(target) or not fs.rename(source, target):
            return False
        _, inside = self._fs(f"{b}/{a.rsplit('/', 1)[-1]}")
        if fs.exists(inside):
            fs.delete(inside, True)
            return False
        return True

    def build(self, df: Callable[[], DataFrame], manifest: dict, *, trainer: str, split: str, required: list[str], mode: str = "online", reuse: bool = True) -> DataFrame:
        """The cached table, or a new one. online without reuse caches nothing; reuse_only raises on a miss and changes
        nothing; offline_only builds what is missing. What lies at a table's place and isn't it, stale or incomplete, is moved away before the new one comes."""
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        if mode == "online" and not reuse:
            return df()
        path = self.path(trainer, split, manifest)
        if (found := self.get(path, manifest, required)) is not None:
            return found
        if mode == "reuse_only":
            raise FileNotFoundError(f"nothing cached for {trainer}/{split} at {path}")
        place = f"{self.root}/.staging/{uuid.uuid4().hex}"
        fs, staged = self._fs(place)
        try:
            self._staged(df(), manifest, place)
            _, parent = self._fs(f"{self.root}/{trainer}/{split}")
            fs.mkdirs(parent)
            if not self._moved(place, path) and self.get(path, manifest, required) is None:
                self._moved(path, f"{self.root}/.staging/{uuid.uuid4().hex}-stale")
                self._moved(place, path)
        finally:
            fs.delete(staged, True)  # nothing, if it was moved
        if (found := self.get(path, manifest, required)) is None:
            raise FileNotFoundError(f"the table of {trainer}/{split} at {path} was removed, or lacks some of {required}")
        return found

    def sweep(self, older_than: float = 86_400.0) -> int:
        """Removes staging folders that builders left behind, and stale tables, untouched for that many seconds; returns how many. Tables in use stay, and so
        do younger folders, which builders may be writing."""
        fs, root = self._fs(f"{self.root}/.staging")
        if not fs.exists(root):
            return 0
        before = (time.time() - older_than) * 1000
        old = [s.getPath() for s in fs.listStatus(root) if self._newest(fs, s) <= before]
        return sum(bool(fs.delete(p, True)) for p in old)

    def _newest(self, fs: Any, status: Any) -> int:
        """When something below last changed: a folder's own time doesn't tell of files within its folders."""
        times = [status.getModificationTime()]
        if status.isDirectory():
            times += [self._newest(fs, s) for s in fs.listStatus(status.getPath())]
        return max(times)
