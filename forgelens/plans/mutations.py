"""What users change: marks, descriptions, feedback and removals, each with its audit row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.enums import FEEDBACK
from ..operators import relational
from . import merge
from .errors import Invalid, NotFound
from .handlers import Store

#: Code points of a description that are kept.
MOST_DESCRIPTION = 500
#: The model of audit rows that are no call of one.
NO_MODEL = "-"


def set_column(rows: DataFrame, column: str, wanted: DataFrame, key: str = "id") -> DataFrame:
    """Rows with ``column`` as ``wanted(key, value)`` says for theirs, null included; others stay
    as they are. A column that the rows lack is added. Of several values of a key the
    greatest holds."""
    kind = wanted.schema["value"].dataType
    rows = rows if column in rows.columns else rows.withColumn(column, F.lit(None).cast(kind))
    new = wanted.groupBy(key).agg(F.max("value").alias("_new"), F.lit(True).alias("_set"))
    met = rows.join(new, key, "left")
    return met.withColumn(column, F.when(F.col("_set"), F.col("_new")).otherwise(F.col(column))).select(rows.columns)


def set_sensitive(projects: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Projects with the mark of ``wanted(id, value)``, and audit rows (model, project_id,
    summary, ok) of those that were sensitive and no longer are: from then on their text may
    leave the machine."""
    was = projects.where(F.coalesce("sensitive", F.lit(False))).select("id")
    now = wanted.where(~F.coalesce("value", F.lit(False))).select("id").distinct()
    audit = was.join(now, "id", "left_semi").select(F.lit(NO_MODEL).alias("model"), F.col("id").alias("project_id"), F.lit("the project is no longer kept local").alias("summary"), F.lit(None).cast("boolean").alias("ok"))
    return set_column(projects, "sensitive", wanted), audit


def described(text: Column) -> Column:
    """A description as it is kept: trimmed, blank is none, at most 500 code points."""
    return F.substring(S.non_empty(text), 1, MOST_DESCRIPTION)


def set_description(projects: DataFrame, wanted: DataFrame) -> DataFrame:
    return set_column(projects, "description", wanted.select("id", described(F.col("value")).alias("value")))


def set_profile(projects: DataFrame, wanted: DataFrame) -> DataFrame:
    """Profiles of a model, which scans leave alone."""
    return set_column(projects, "ai_profile", wanted)


def set_symbol_counts(projects: DataFrame, symbols: DataFrame) -> DataFrame:
    """Projects with symbol_count and module_count, distinct files, of ``symbols(project_id,
    name, file_path)``; those without symbols: 0."""
    n = symbols.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("_s"), F.count_distinct("file_path").alias("_m"))
    rest = [c for c in projects.columns if c not in ("symbol_count", "module_count")]
    return projects.select(rest).join(n, "id", "left").withColumns({"symbol_count": F.coalesce("_s", F.lit(0)), "module_count": F.coalesce("_m", F.lit(0))}).drop("_s", "_m")


def set_feedback(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Assets or insights with the feedback of ``wanted(id, value)``; null takes it back. A
    value that is no feedback changes nothing."""
    return set_column(rows, "user_feedback", wanted.where(F.col("value").isNull() | F.col("value").isin(FEEDBACK)))


def feedback_state(feedback: Column) -> Column:
    """unread, rediscovered (found useful), affects_scores (judged at all but for ignored)."""
    return F.struct(feedback.isNull().alias("unread"), F.coalesce(feedback == "useful", F.lit(False)).alias("rediscovered"), F.coalesce(feedback.isin("useful", "useless"), F.lit(False)).alias("affects_scores"))


def remove_project(tables: dict[str, DataFrame], project: str) -> dict[str, DataFrame]:
    """The record of a project and what hangs on it; nothing on disk."""
    return merge.clear_project(tables, project)


def prune_relations(relations: DataFrame, least: float, kinds: Sequence[str] | None = None) -> DataFrame:
    """Without edges below a confidence, of the given types alone if there are any."""
    weak = F.col("confidence") < relational.checked_score(least)
    return relations.where(~(weak & F.col("relation_type").isin(list(kinds)) if kinds is not None else weak))


def delete_types(rows: DataFrame, kinds: Sequence[str], column: str = "type") -> DataFrame:
    """Without rows of these types, which a detector makes anew."""
    return rows.where(~F.coalesce(F.col(column).isin(list(kinds)), F.lit(False))) if kinds else rows


class Projects:
    """The same on a store: each change is one version, with its audit rows."""

    def __init__(self, store: Store):
        self.store = store

    def _change(self, project: str, change, *more: str) -> None:
        at = self.store.version()
        tables = self.store.all(at)
        if tables["projects"].where(F.col("id") == project).isEmpty():
            raise NotFound("project", project)
        self.store.commit(change(tables), reads=["projects", *more], at=at)

    def _wanted(self, project: str, value, kind: str) -> DataFrame:
        return self.store.spark.createDataFrame([(project, value)], f"id string, value {kind}")

    def set_sensitive(self, project: str, value: bool, now: Column) -> None:
        def change(tables):
            rows, audit = set_sensitive(tables["projects"], self._wanted(project, value, "boolean"))
            out = {"projects": rows}
            if "audit_log" in tables:
                log = tables["audit_log"]
                full = audit.withColumns({c: F.lit(None).cast(t) for c, t in log.dtypes if c not in (*audit.columns, "seq", "created_at")})
                out["audit_log"] = relational.append(log, full, now)
            return out

        self._change(project, change, "audit_log")

    def set_description(self, project: str, text: str | None) -> None:
        self._change(project, lambda tables: {"projects": set_description(tables["projects"], self._wanted(project, text, "string"))})

    def set_feedback(self, table: str, row: str, value: str | None) -> None:
        if value is not None and value not in FEEDBACK:
            raise Invalid(f"no feedback: {value}")
        at = self.store.version()
        rows = self.store.read(table, at)
        if rows.where(F.col("id") == row).isEmpty():
            raise NotFound(table, row)
        self.store.commit({table: set_feedback(rows, self._wanted(row, value, "string"))}, at=at)

    def remove(self, project: str) -> None:
        self._change(project, lambda tables: {n: df for n, df in remove_project(tables, project).items() if n in ("projects", "assets", "relations")}, "assets", "relations")

    def clear_derived(self) -> DataFrame:
        """Clears what scans and detectors made, as one version: table, n: rows that went."""
        at = self.store.version()
        tables = self.store.all(at)
        cleared = merge.clear_derived(tables)
        gone = [n for n in tables if n != "projects" and cleared[n] is not tables[n]]
        counts = [(n, tables[n].count()) for n in sorted(gone)]
        self.store.commit({n: cleared[n] for n in [*gone, *(["projects"] if "projects" in tables else [])]}, at=at)
        return self.store.spark.createDataFrame(counts, "table string, n long")
