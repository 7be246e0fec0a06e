"""Which folders are scanned and how, and how a model is reached: settings of a store, each change
one version of it, refused if another one changed them meanwhile."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational
from ..sources.tables import Conflict, Store
from . import views
from .errors import Invalid, NotFound

DIRECTORIES = "path string, enabled boolean, added_at timestamp, last_scanned_at timestamp, project_count long, seq long"
#: What a client sends back for a key that it has only seen masked: the key stays.
UNCHANGED = "********"
MOST_DEPTH = 20
SCAN = {"watch": True, "parse": True, "max_depth": 8, "exclude": []}
#: Up to this many directories are broadcast to the projects, about 20 MB of paths.
FEW_DIRECTORIES = 100_000


def ancestors(path: Column) -> Column:
    """A path and the folders above it, normalised."""
    parts = F.split(S.normalize_path(path), "/")
    ups = S.let(parts, lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/")))
    return F.array_distinct(F.transform(ups, lambda x: F.when(x == "", F.lit("/")).otherwise(x)))


def directory_counts(directories: DataFrame, projects: DataFrame) -> DataFrame:
    """path, n: how many projects (by path; repeats count once) are at or below each directory,
    zero included. A project below two directories counts for both. Each project goes to its
    own ancestors by equality, never to all directories; counts combine before they move."""
    wanted = directories.select("path", S.normalize_path(_local(F.col("path"))).alias("at"))
    few = directories.count() <= FEW_DIRECTORIES
    owned = projects.where(S.non_empty(F.col("path")).isNotNull()).select(S.normalize_path(F.col("path")).alias("p")).distinct()
    keys = wanted.select("at").distinct()
    met = owned.select(F.explode(ancestors(F.col("p"))).alias("at")).join(F.broadcast(keys) if few else keys, "at")
    n = met.groupBy("at").agg(F.count("*").alias("n"))
    return wanted.join(n, "at", "left").select("path", F.coalesce("n", F.lit(0)).alias("n"))


def whole_paths(projects: DataFrame) -> DataFrame:
    """path of each project, from its root's (where projects have roots)."""
    if "root" not in projects.columns:
        return projects.select(_local(F.col("path")).alias("path"))
    return projects.select(F.concat_ws("/", F.regexp_replace(_local(F.col("root")), "(?<=.)/+$", ""), F.nullif("path", F.lit(""))).alias("path"))


def _local(path: Column) -> Column:
    """A local path as such, not as an address; file:/// and file:/ begin one."""
    return F.regexp_replace(path, "^file:/+", "/")


def after_scan(directories: DataFrame, roots: Sequence[str], projects: DataFrame, now: Column) -> DataFrame:
    """Directories after a scan of ``roots``: those scanned have the time and their number of
    projects, others stay as they are."""
    counts = directory_counts(directories, whole_paths(projects)).withColumnRenamed("n", "_n")
    met = directories.join(counts, "path", "left")
    done = S.normalize_path(_local(F.col("path"))).isin([re.sub("^file:/+", "/", _clean(r)) for r in roots])
    return met.withColumns({"last_scanned_at": F.when(done, now).otherwise(F.col("last_scanned_at")), "project_count": F.when(done, F.col("_n")).otherwise(F.col("project_count"))}).select(directories.columns)


def _clean(path: str) -> str:
    text = path.strip().replace("\\", "/")
    return text if text == "/" else text.rstrip("/") or ("/" if text else "")


def is_folder(spark: SparkSession, path: str) -> bool | None:
    """Whether a folder is there; None: nothing is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(where).isDirectory() if fs.exists(where) else None


def checked_url(text: str) -> str:
    url = text.strip()
    if url and not (url.startswith(("http://", "https://")) and len(url) > len("https://")):
        raise Invalid(f"an address begins with http:// or https://: {url}")
    return url


def masked(key: str) -> str:
    return "" if not key else "****" if len(key) <= 8 else f"{key[:4]}****{key[-4:]}"


class ScanSettings:
    """The directories and scan options of a store."""

    def __init__(self, store: Store):
        self.store = store

    def directories(self, at: int | None = None) -> DataFrame:
        return self.store.read("directories", at) if "directories" in self.store.snapshot(at)["tables"] else self.store.spark.createDataFrame([], DIRECTORIES)

    def _rows(self, at: int) -> list[dict]:
        """All of them: a list that people write."""
        return [r.asDict() for r in self.directories(at).orderBy("seq").collect()]

    def _change(self, change: Callable[[list[dict]], list[dict]]) -> None:
        at = self.store.version()
        rows = [r | {"seq": i} for i, r in enumerate(change(self._rows(at)))]
        self.store.commit({"directories": self.store.spark.createDataFrame([tuple(r[c.split()[0]] for c in DIRECTORIES.split(", ")) for r in rows], DIRECTORIES)}, at=at)

    def add(self, path: str, now) -> None:
        """``now``: a datetime. The folder has to be there, and not on the list by another spelling."""
        clean = _clean(path)
        if not clean:
            raise Invalid("a directory has a path")
        found = is_folder(self.store.spark, clean)
        if not found:
            raise Invalid(f"not a directory: {clean}" if found is not None else f"there is no directory {clean}")

        def change(rows):
            if any(_clean(r["path"]) == clean for r in rows):
                raise Conflict(f"the directory is on the list: {clean}")
            return [*rows, {"path": path.strip(), "enabled": True, "added_at": now, "last_scanned_at": None, "project_count": None}]

        self._change(change)

    def _one(self, rows: list[dict], path: str) -> dict:
        for row in rows:
            if _clean(row["path"]) == _clean(path):
                return row
        raise NotFound("directory", path)

    def remove(self, path: str) -> None:
        def change(rows):
            gone = self._one(rows, path)
            return [r for r in rows if r is not gone]

        self._change(change)

    def enable(self, path: str, enabled: bool) -> None:
        def change(rows):
            self._one(rows, path)["enabled"] = enabled
            return rows

        self._change(change)

    def scanned(self, roots: Sequence[str], now: Column) -> None:
        """After a scan: times and numbers of projects from the store's projects."""
        at = self.store.version()
        if "directories" in self.store.snapshot(at)["tables"]:
            self.store.commit({"directories": after_scan(self.directories(at), roots, self.store.read("projects", at), now)}, reads=["projects"], at=at)

    def roots(self) -> list[str]:
        return [r["path"] for r in self._rows(self.store.version()) if r["enabled"]]

    def options(self) -> dict:
        """watch, parse, max_depth, exclude; the defaults where nothing was saved."""
        saved = _saved(self.store)
        return {k: json.loads(saved[f"scan.{k}"]) if f"scan.{k}" in saved else v for k, v in SCAN.items()}

    def update(self, watch: bool | None = None, parse: bool | None = None, max_depth: int | None = None, exclude: Sequence[str] | None = None) -> dict:
        """Sets what is given; blank patterns are left out."""
        if max_depth is not None and not 1 <= max_depth <= MOST_DEPTH:
            raise Invalid(f"a depth is from 1 to {MOST_DEPTH}")
        patterns = None if exclude is None else [p.strip() for p in exclude if p.strip()]
        given = {"watch": watch, "parse": parse, "max_depth": max_depth, "exclude": patterns}
        _save(self.store, {f"scan.{k}": json.dumps(v) for k, v in given.items() if v is not None})
        return self.options()

    def problems(self) -> list[str]:
        """Why a scan of the enabled directories would not work."""
        rows = self._rows(self.store.version())
        out = [] if rows else ["there is no directory yet"]
        for path in (r["path"] for r in rows if r["enabled"]):
            found = is_folder(self.store.spark, _clean(path))
            out += [f"there is no directory {path}"] if found is None else [] if found else [f"not a directory: {path}"]
        return out

    def view(self, now: Column) -> DataFrame:
        """path, enabled, exists, project_count, scanned (how long ago), in the list's order."""
        there = [(r["path"], bool(is_folder(self.store.spark, _clean(r["path"])))) for r in self._rows(self.store.version())]
        exists = self.store.spark.createDataFrame(there, "path string, exists boolean")
        return self.directories().join(exists, "path").orderBy("seq").select("path", "enabled", "exists", "project_count", F.nullif(S.relative_time(F.col("last_scanned_at"), now), F.lit("")).alias("scanned"))


class ModelSettings:
    """How a model is reached, as key and value; the engine itself calls none."""

    TEXTS, URLS, FLAGS, ROUTES = ("provider", "model", "local_model"), ("url", "local_url"), ("sensitive_local_only",), ("route_fast", "route_deep")

    def __init__(self, store: Store):
        self.store = store

    def update(self, **given) -> dict:
        known = {*self.TEXTS, *self.URLS, *self.FLAGS, *self.ROUTES, "key"}
        if set(given) - known:
            raise Invalid(f"no such setting: {sorted(set(given) - known)}")
        out = {}
        for name, value in given.items():
            if value is None or (name == "key" and value == UNCHANGED):
                continue
            if name in self.ROUTES and value not in ("local", "cloud"):
                raise Invalid(f"a route is local or cloud: {value}")
            out[f"model.{name}"] = checked_url(value) if name in self.URLS else json.dumps(bool(value)) if name in self.FLAGS else value.strip()
        _save(self.store, out, ["model.key"])
        return self.view()

    def view(self) -> dict:
        """As a client may see it: the key is masked."""
        saved = {k.removeprefix("model."): v for k, v in _saved(self.store).items() if k.startswith("model.")}
        key = saved.pop("key", "")
        flags = {f: json.loads(saved.pop(f, "true")) for f in self.FLAGS}
        empty = dict.fromkeys((*self.TEXTS, *self.URLS), "") | dict.fromkeys(self.ROUTES, "local")
        return empty | saved | flags | {"key_masked": masked(key), "cloud_configured": bool(key.strip()) and bool(saved.get("url")), "local_configured": bool(saved.get("local_url"))}


def _rows_of(store: Store, at: int) -> views.Settings:
    return views.Settings(store.read("settings", at)) if "settings" in store.snapshot(at)["tables"] else views.Settings.empty(store.spark)


def _saved(store: Store) -> dict[str, str]:
    return {r["key"]: r["value"] for r in _rows_of(store, store.version()).current().collect()}


def _save(store: Store, values: dict[str, str], sensitive: Sequence[str] = ()) -> None:
    """One commit, in which older values of a key are left out."""
    if values:
        at = store.version()
        rows = _rows_of(store, at).save(values, sensitive).rows
        store.commit({"settings": relational.latest(rows, ["key"], ["seq"])}, at=at)
