"""Tables as other tools export them: numbers for flags, JSON in text columns, any values in
enumerations. Each becomes typed columns, the same names without ``_json``, and goes back.

Reading is lenient by the cell, never by the row: a cell that is null or cannot be what its column
holds becomes the column's default, and ``unreadable`` lists the JSON cells that did. JSON
is held to its shape as a whole: one element of the wrong type, a missing field, or text after
the value, and the cell is unreadable. All of it is expressions; no Python runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import enums
from ..functions import scalars as S

UNREADABLE_EVIDENCE = "(unreadable evidence; analyse again)"


# JSON of a given shape


@dataclass(frozen=True)
class Shape:
    """A Spark type, how a variant becomes a value of it (null where it is none), and whether
    a record may lack it."""

    sql: str
    of: Callable[[Column], Column]
    optional: bool = False


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _whole(most: int) -> Shape:
    """Whole numbers from 0 on; others, fractions among them, are none."""
    return Shape("long", lambda v: S.let(F.when(_kind(v) == "BIGINT", _at(v, "$", "long")), lambda n: F.when((n >= 0) & (n <= most), n)))


TEXT = Shape("string", lambda v: F.when(_kind(v) == "STRING", _at(v, "$", "string")))
REAL = Shape("double", lambda v: F.when(F.regexp_like(_kind(v), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")), _at(v, "$", "double")))
BYTE, WHOLE, LONG = _whole(255), _whole(2**32 - 1), _whole(2**63 - 1)


def maybe(shape: Shape) -> Shape:
    """The same, or nothing."""
    return Shape(shape.sql, shape.of, True)


def of_values(*values: str) -> Shape:
    return Shape("string", lambda v: S.let(TEXT.of(v), lambda t: F.when(t.isin(*values), t)))


def many(shape: Shape) -> Shape:
    """A list whose elements all have the shape."""

    def of(v: Column) -> Column:
        items = F.when(F.startswith(_kind(v), F.lit("ARRAY<")), F.transform(_at(v, "$", "array<variant>"), shape.of))
        return S.let(items, lambda xs: F.when(~F.exists(xs, lambda x: x.isNull()), xs))

    return Shape(f"array<{shape.sql}>", of)


def record(**fields: Shape) -> Shape:
    """An object with these fields; others of it are passed over."""

    def of(v: Column) -> Column:
        def built(s: Column) -> Column:
            bad = [s[n].isNull() & (F.lit(not f.optional) | ~_void(_at(v, f"$.{n}"))) for n, f in fields.items()]
            return F.when(~reduce(lambda a, b: a | b, bad), s)

        made = F.struct(*[f.of(_at(v, f"$.{n}")).alias(n) for n, f in fields.items()])
        return F.when(F.startswith(_kind(v), F.lit("OBJECT<")), S.let(made, built))

    return Shape("struct<" + ",".join(f"{n}:{f.sql}" for n, f in fields.items()) + ">", of)


def _void(v: Column) -> Column:
    """Absent, or JSON's null."""
    return v.isNull() | (_kind(v) == "VOID")


def json_value(raw: Column) -> Column:
    """The one JSON value that a text is, as a variant; else null. Spark's parser stops behind the first
    value. No text but one whole value makes both a list and a record complete."""
    listed = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    held = F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit("}")))
    return F.when(listed.isNotNull(), _at(held, "$.v"))


def parsed(raw: Column, shape: Shape) -> Column:
    """The text's value of the shape, or null."""
    return S.let(json_value(raw), shape.of)


# Columns


@dataclass(frozen=True)
class Cell:
    """A column: its type, its typed value (null where it has none), the value in its place, and
    the shape of its JSON if it is such."""

    sql: str
    typed: Callable[[Column], Column]
    default: Column | None = None
    shape: Shape | None = None
    back: Callable[[Column], Column] | None = None


def _text(default: str | None = "") -> Cell:
    return Cell("string", lambda c: c.cast("string"), None if default is None else F.lit(default))


def _number(sql: str, low: float, high: float | None, default) -> Cell:
    """A number within bounds; what is beyond them becomes the bound."""

    def typed(c: Column) -> Column:
        n = c.try_cast(sql)
        n = n if low is None else F.greatest(n, F.lit(low).cast(sql)) if high is None else S.clamp(n, low, high)
        return F.when(c.try_cast(sql).isNotNull(), n).cast(sql)

    return Cell(sql, typed, None if default is None else F.lit(default).cast(sql))


def _enum(name: str, default: str | None = None) -> Cell:
    other = enums.UNKNOWN.get(name) if default is None else default
    return Cell("string", lambda c: F.when(c.isin(enums.VALUES[name]), c), None if other is None else F.lit(other))


def _json(shape: Shape, default: str | None = "[]") -> Cell:
    """``default``: JSON of the default, None: null."""
    empty = None if default is None else F.from_json(F.lit(default), shape.sql)
    return Cell(shape.sql, lambda c: parsed(c, shape), empty, shape, F.to_json)


def _flag() -> Cell:
    """Any number but 0 is true; a boolean is itself."""
    return Cell("boolean", lambda c: F.coalesce(c.cast("string").try_cast("double") != 0, F.lower(c.cast("string")) == "true"), F.lit(False), back=lambda c: c.cast("int"))


EVIDENCE = record(files=many(TEXT), commits=many(TEXT), used_by=many(TEXT), reasoning=many(TEXT))
ITEM = record(kind=of_values("file", "project", "commit", "symbol"), label=TEXT, target=maybe(TEXT))
HIGHLIGHT = record(title=TEXT, desc=TEXT, evidence_files=many(TEXT))
PAST = record(sessions=WHOLE, commits=WHOLE, completeness=maybe(REAL), phase=maybe(TEXT), salvage=many(TEXT), narrative=TEXT)
PROFILE = record(summary=TEXT, purpose=maybe(TEXT), phase=maybe(TEXT), highlights=many(HIGHLIGHT), archaeology=maybe(PAST), generated_by=TEXT, generated_at=TEXT)
SHARE = record(name=TEXT, pct=BYTE, loc=LONG)

_count = lambda most=None: _number("long", 0, most, 0)
_real = lambda default=0.0: _number("double", None, None, default)
_any = Cell("string", lambda c: F.when(json_value(c).isNotNull(), c), None, Shape("string", lambda v: v.cast("string")))


def _cells() -> dict[str, dict[str, Cell]]:
    text, some, texts = _text(), _text(None), _json(many(TEXT))
    u32 = 2**32 - 1
    return {
        "projects": {
            "id": text, "name": text, "path": text, "description": text, "language": text, "framework": _text("-"), "created_at": some, "updated_at": some, "last_commit_at": some,
            "status": _enum("project_status"), "health_score": _count(255), "completeness": _real(None), "file_count": _count(), "loc": _count(), "symbol_count": _count(), "module_count": _count(),
            "languages_json": _json(many(SHARE)), "tags_json": texts, "git_commits": _count(u32), "has_git": _flag(), "has_readme": _flag(), "has_tests": _flag(), "sensitive": _flag(),
            "ai_profile_json": _json(PROFILE, None), "scanned_at": some,
        },
        "assets": {
            "id": text, "project_id": text, "type": _enum("asset_type"), "name": text, "description": text, "content": some, "source_path": text, "confidence": _real(), "reuse_score": _real(),
            "generality": _real(), "stability": _real(), "tags_json": texts, "evidence_json": _json(EVIDENCE, '{"files":[],"commits":[],"used_by":[],"reasoning":[]}'), "created_at": text, "user_feedback": _enum("user_feedback"),
        },
        "capabilities": {"id": text, "name": text, "description": text, "layer": _enum("capability_layer"), "parent_id": some, "confidence": _real(), "project_count": _count(u32)},
        "relations": {
            "id": text, "source_id": text, "source_type": _enum("entity_kind", "project"), "relation_type": _enum("relation_type"), "target_id": text, "target_type": _enum("entity_kind", "capability"),
            "confidence": _real(), "evidence_json": texts,
        },
        "insights": {
            "id": text, "type": _enum("insight_type"), "title": text, "description": text, "evidence_json": _json(many(ITEM)), "confidence": _real(), "tags_json": texts, "project_ids_json": texts,
            "asset_ids_json": texts, "created_at": text, "user_feedback": _enum("user_feedback"),
        },
        "opportunities": {
            "id": text, "title": text, "description": text, "source_project_ids_json": texts, "source_asset_ids_json": texts, "required_capabilities_json": texts, "missing_capabilities_json": texts,
            "coverage": _real(), "rating": _count(255), "why": text, "evidence_json": texts, "status": _enum("opportunity_status"), "created_at": text,
        },
        "jobs": {
            "id": text, "type": _enum("job_type"), "status": _enum("job_status"), "progress": _real(), "stage": some, "processed": _number("long", 0, None, None), "total": _number("long", 0, None, None),
            "error": some, "payload_json": _any, "created_at": text, "updated_at": text,
        },
        "activities": {"id": text, "icon": _enum("activity_icon"), "title": text, "detail": text, "created_at": text},
        "audit_log": {"id": _number("long", None, None, None), "at": text, "model": text, "route": text, "job_type": text, "summary": text, "project_id": some},
        "settings": {"key": text, "value": text, "sensitive": _flag(), "updated_at": text},
    }


TABLES = ["projects", "assets", "capabilities", "relations", "insights", "opportunities", "jobs", "activities", "audit_log", "settings"]


def typed_name(column: str) -> str:
    return column.removesuffix("_json")


def typed(rows: DataFrame, table: str) -> DataFrame:
    """Stored rows as typed columns, in the table's order. A column that the rows lack has its
    default in all of them; columns that the table does not have are left out. An insight
    without readable evidence has one item that says so."""
    cells = _cells()[table]

    def column(name: str, cell: Cell) -> Column:
        value = cell.typed(rows[name]) if name in rows.columns else F.lit(None).cast(cell.sql)
        return (value if cell.default is None else F.coalesce(value, cell.default)).cast(cell.sql).alias(typed_name(name))

    out = rows.select(*[column(n, c) for n, c in cells.items()])
    if table == "insights":
        none = F.array(F.struct(F.lit("file").alias("kind"), F.lit(UNREADABLE_EVIDENCE).alias("label"), F.lit(None).cast("string").alias("target")))
        out = out.withColumn("evidence", F.when(F.size("evidence") > 0, F.col("evidence")).otherwise(none))
    return out


def unreadable(rows: DataFrame, table: str) -> DataFrame:
    """key, column, text: the JSON cells that are not blank and became a default. One pass."""
    cells = {n: c for n, c in _cells()[table].items() if c.shape and n in rows.columns}
    key = next(iter(_cells()[table]))
    if not cells:
        return rows.select(F.col(key).cast("string").alias("key"), F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("text")).where("false")
    bad = [F.when(S.non_empty(rows[n]).isNotNull() & c.typed(rows[n]).isNull() & ~_null(rows[n], c), F.struct(F.lit(n).alias("column"), rows[n].alias("text"))) for n, c in cells.items()]
    found = rows.select(rows[key].cast("string").alias("key"), F.explode(F.filter(F.array(*bad), lambda x: x.isNotNull())).alias("b"))
    return found.select("key", "b.column", "b.text")


def _null(raw: Column, cell: Cell) -> Column:
    """JSON's null where the column may be null."""
    return F.lit(cell.default is None) & F.coalesce(_kind(json_value(raw)) == "VOID", F.lit(False))


def stored(rows: DataFrame, table: str) -> DataFrame:
    """Typed rows as they are stored: typed(stored(x)) is x."""
    back = {n: (c.back or (lambda c: c)) for n, c in _cells()[table].items()}
    return rows.select(*[f(F.col(typed_name(n))).alias(n) for n, f in back.items() if typed_name(n) in rows.columns])


def read(spark: SparkSession, folder: str, table: str, form: str = "parquet", **options) -> DataFrame:
    """One table of an export, ``folder/table``. Of CSV and JSON lines all cells are read as
    text. Cells of CSV may hold line breaks, so one file is one task: export many files, or Parquet."""
    if table not in TABLES:
        raise ValueError(f"no table: {table}")
    reader = spark.read.format(form).options(**options)
    if form in ("csv", "json"):
        reader = reader.schema(", ".join(f"`{n}` string" for n in _cells()[table])) if form == "json" else reader.option("header", "true").option("multiLine", "true").option("escape", '"')
    return typed(reader.load(f"{folder.rstrip('/')}/{table}"), table)


def read_all(spark: SparkSession, folder: str, form: str = "parquet", **options) -> dict[str, DataFrame]:
    """All tables of an export, for the views."""
    return {t: read(spark, folder, t, form, **options) for t in TABLES}
