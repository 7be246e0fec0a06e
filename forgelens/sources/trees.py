"""Source trees as a data source: ``spark.read.format("source_tree").load(folder)``.

The folder must be mounted where executors run. The driver lists the top of the tree and
deals its folders to partitions; tasks walk them. A file's content is read only where its
name, its place and its length allow it, after the filters on them that the query has. A
folder that cannot be read is a row with an error, and the walk goes on.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from ..functions import rules
from .manifests import PARSERS

SCHEMA = "path string, rel_path string, name string, length long, modified timestamp, content binary, error string"
#: The options and what they are where none is given: levels below the folder, files below one
#: first folder, bytes of a content that is read, partitions, and whether contents are read.
DEPTH, FILES, BYTES, PARTITIONS = 16, 100_000, 2 * 1024 * 1024, 64
#: Bytes of contents in one batch.
BATCH = 8 << 20
_EXCLUDED, _ENDS = frozenset(rules.EXCLUDED), frozenset(e for ends in rules.EXTENSIONS.values() for e in ends.split())
_TYPES = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary(), pa.string()]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def entered(name: str) -> bool:
    """Whether a folder is walked, or a file told of."""
    return name not in _EXCLUDED and not name.endswith(".egg-info")


def secret(name: str) -> bool:
    low = name.lower()
    return low.endswith(tuple(rules.SECRET_ENDS)) or low.startswith(tuple(rules.SECRET_STARTS)) or any(x in low for x in rules.SECRET_PARTS)


def generated(rel_path: str) -> bool:
    parts = rel_path.lower().split("/")
    return parts[-1] in rules.GENERATED_FILES or parts[-1].endswith(tuple(rules.GENERATED_ENDS)) or any(p in rules.GENERATED_FOLDERS for p in parts)


def readable(rel_path: str) -> bool:
    """Whether a content is of use: source text, a manifest, a README or the head of a
    repository; nothing secret or generated."""
    name = rel_path.rsplit("/", 1)[-1]
    if rel_path.endswith(".git/HEAD"):
        return True
    known = name in PARSERS or name.lower().startswith("readme") or ("." in name and name.rsplit(".", 1)[-1].lower() in _ENDS)
    return known and not secret(name) and not generated(rel_path)


def _test(f: ds.Filter) -> Callable[[dict], bool] | None:
    """A filter as a test of a file's facts (rel_path, name, length, which are never null);
    None where Spark must do it."""
    if isinstance(f, ds.Not):
        inner = _test(f.child)
        return None if inner is None else lambda x: not inner(x)
    column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    if column not in ("rel_path", "name", "length"):
        return None
    kinds = {
        ds.EqualTo: lambda a, b: a == b, ds.In: lambda a, b: a in b, ds.GreaterThan: lambda a, b: a > b, ds.GreaterThanOrEqual: lambda a, b: a >= b, ds.LessThan: lambda a, b: a < b,
        ds.LessThanOrEqual: lambda a, b: a <= b, ds.StringStartsWith: lambda a, b: a.startswith(b), ds.StringEndsWith: lambda a, b: a.endswith(b), ds.StringContains: lambda a, b: b in a,
    }
    if isinstance(f, ds.IsNotNull):
        return lambda x: True
    test = kinds.get(type(f))
    value = getattr(f, "value", None)
    if test is None or value is None or (isinstance(value, (list, tuple)) and any(v is None for v in value)):
        return None
    return lambda x: test(x[column], value)


@dataclass
class Part(ds.InputPartition):
    """Folders to walk and files to tell of, relative to the root; and what failed already."""

    folders: list[str]
    files: list[str]
    errors: list[tuple[str, str]]


class TreeReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        get = lambda name, value: int(options.get(name, value))
        self.root = os.path.abspath(options["path"].removeprefix("file://") if options["path"].startswith("file:///") else options["path"].removeprefix("file:"))
        self.depth, self.files, self.bytes, self.parts = get("depth", DEPTH), get("files", FILES), get("bytes", BYTES), max(1, get("partitions", PARTITIONS))
        self.content = options.get("content", "true").lower() == "true"
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[Part]:
        """The tree's first two levels, dealt out; a root that is not there is an error."""
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"no folder {self.root}")
        folders, files, errors = [""], [], []
        for _ in range(2):
            if len(folders) >= self.parts:
                break
            below = []
            for folder in folders:
                inner, here, failed = self._list(folder)
                below += inner
                files += here
                errors += failed
            folders = below
        parts = [Part(folders[i :: self.parts], files[i :: self.parts], []) for i in range(min(self.parts, max(len(folders), 1)))]
        parts[0].files, parts[0].errors = parts[0].files, errors
        for i in range(len(parts), self.parts):  # more files than folders
            parts[i % len(parts)].files += files[i :: self.parts]
        return parts

    def _list(self, folder: str) -> tuple[list[str], list[str], list[tuple[str, str]]]:
        """(folders, files, errors) in a folder, in the order of their names. Links are not
        followed. Of a repository's own folder only its head is told of."""
        folders, files = [], []
        try:
            with os.scandir(os.path.join(self.root, folder)) as found:
                entries = sorted(found, key=lambda e: e.name)
        except OSError as e:
            return [], [], [(folder, f"{type(e).__name__}: {e.strerror or e}")]
        for e in entries:
            rel = f"{folder}/{e.name}" if folder else e.name
            if e.name == ".git" and e.is_dir(follow_symlinks=False):
                if os.path.isfile(os.path.join(e.path, "HEAD")):
                    files.append(f"{rel}/HEAD")
            elif e.is_symlink() or not entered(e.name):
                continue
            elif e.is_dir(follow_symlinks=False):
                folders.append(rel)
            elif e.is_file(follow_symlinks=False):
                files.append(rel)
        return folders, files, []

    def _row(self, rel: str, tests: list[Callable[[dict], bool]]) -> tuple | None:
        path = os.path.join(self.root, rel)
        try:
            facts = os.stat(path)
            known = {"rel_path": rel, "name": rel.rsplit("/", 1)[-1], "length": facts.st_size}
            if not all(t(known) for t in tests):
                return None
            content = read(path) if self.content and facts.st_size <= self.bytes and readable(rel) else None
        except OSError as e:
            return path, rel, None, None, None, None, f"{type(e).__name__}: {e.strerror or e}"
        return path, rel, known["name"], facts.st_size, int(facts.st_mtime * 1_000_000), content, None

    def _rows(self, part: Part) -> Iterator[tuple]:
        tests = [_test(f) for f in self.filters]
        quiet = any(getattr(f, "attribute", ()) for f in self.filters)  # an error has no name, so no filter on one keeps it
        fail = lambda rel, text: (os.path.join(self.root, rel), rel, None, None, None, None, text)
        rows = (self._row(rel, tests) for rel in part.files)
        yield from (r for r in rows if r and not (quiet and r[-1]))
        errors = list(part.errors)
        for first in part.folders:
            stack, told = [first], 0
            while stack:
                folder = stack.pop()
                if folder.count("/") >= self.depth:
                    continue
                folders, files, failed = self._list(folder)
                errors += failed
                stack += reversed(folders)
                for rel in files:
                    if told >= self.files:
                        errors.append((first, f"more than {self.files} files; the others were left out"))
                        stack = []
                        break
                    told += 1
                    if (row := self._row(rel, tests)) and not (quiet and row[-1]):
                        yield row
        if not quiet:
            yield from (fail(rel, text) for rel, text in errors)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in self._rows(partition):
            rows.append(row)
            held += len(row[5] or b"")
            if held >= BATCH or len(rows) >= 2000:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


class TreeSource(ds.DataSource):
    """See the module. Options: depth, files, bytes, partitions, content."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def listing(spark: SparkSession, root: str, **options: int | bool) -> DataFrame:
    """SCHEMA of all files below ``root``, with the filters on it pushed into the walk."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("source_tree")
    for name, value in options.items():
        reader = reader.option(name, str(value).lower())
    return reader.load(root)


def is_local(root: str) -> bool:
    return root.startswith(("/", "file:"))


def failed_projects(errors: DataFrame, roots: DataFrame) -> DataFrame:
    """dir, rel_path, error: the projects (``roots(dir)``) in which something could not be
    read, by an equal join on the folders above it."""
    parts = F.split("rel_path", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return errors.select("rel_path", "error", F.explode(up).alias("dir")).join(roots.select("dir"), "dir")
