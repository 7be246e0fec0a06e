"""Dependencies that manifests declare, and the frameworks they tell."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules

MOST_BYTES = 512 * 1024
SCHEMA = "project_id string, dependency string, dev boolean"
_SPECIFIER = re.compile(r"^\s*([A-Za-z0-9@][A-Za-z0-9._/@-]*(?:\[[^\]]*\])?)")


def bare(text: str) -> str:
    """The name before a version specifier."""
    m = _SPECIFIER.match(text)
    return m[1] if m else ""


def _json(text: str, runtime: str, dev: str) -> tuple[list[str], list[str]]:
    data = json.loads(text)
    return list(data.get(runtime) or {}), list(data.get(dev) or {})


def _cargo(text: str) -> tuple[list[str], list[str]]:
    data = tomllib.loads(text)
    shared = (data.get("workspace") or {}).get("dependencies") or {}
    return [*(data.get("dependencies") or {}), *shared], [*(data.get("dev-dependencies") or {}), *(data.get("build-dependencies") or {})]


def _pyproject(text: str) -> tuple[list[str], list[str]]:
    data = tomllib.loads(text)
    project, poetry = data.get("project") or {}, (data.get("tool") or {}).get("poetry") or {}
    groups = [x for g in (poetry.get("group") or {}).values() for x in g.get("dependencies") or {}]
    extra = [bare(x) for xs in (project.get("optional-dependencies") or {}).values() for x in xs]
    return [*(bare(x) for x in project.get("dependencies") or []), *(x for x in poetry.get("dependencies") or {} if x != "python")], [*extra, *groups, *(poetry.get("dev-dependencies") or {})]


def _requirements(text: str) -> tuple[list[str], list[str]]:
    return [bare(x) for x in text.splitlines() if x.strip() and not x.strip().startswith(("#", "-"))], []


def _go(text: str) -> tuple[list[str], list[str]]:
    block = re.findall(r"require\s*\(([^)]*)\)", text)
    lines = [x for b in block for x in b.splitlines()] + re.findall(r"^require\s+([^(\s].*)$", text, re.M)
    return [x.split()[0] for x in (re.sub(r"//.*", "", y).strip() for y in lines) if x], []


def _maven(text: str) -> tuple[list[str], list[str]]:
    out: tuple[list[str], list[str]] = ([], [])
    for block in re.findall(r"<dependency>(.*?)</dependency>", text, re.S):
        get = lambda tag: (re.search(rf"<{tag}>\s*([^<]*?)\s*</{tag}>", block) or [None, ""])[1]  # noqa: B023, E731
        if artifact := get("artifactId"):
            out[get("scope") == "test"].append(f"{get('groupId')}:{artifact}" if get("groupId") else artifact)
    return out


def _gems(text: str) -> tuple[list[str], list[str]]:
    return re.findall(r"^\s*gem\s+[\"']([^\"']+)", text, re.M), []


PARSERS = {
    "package.json": lambda t: _json(t, "dependencies", "devDependencies"), "Cargo.toml": _cargo, "pyproject.toml": _pyproject, "requirements.txt": _requirements,
    "go.mod": _go, "pom.xml": _maven, "Gemfile": _gems, "composer.json": lambda t: _json(t, "require", "require-dev"),
}


def checked(name: str, text: str) -> tuple[list[str], list[str], str | None]:
    """(runtime, dev, None), or no dependencies and what is wrong with the manifest."""
    try:
        runtime, dev = PARSERS[name](text)
    except (ValueError, KeyError, AttributeError, TypeError) as e:
        return [], [], f"{name}: {type(e).__name__}: {e}"[:300]
    clean = lambda xs: sorted({x.strip() for x in xs if isinstance(x, str) and x.strip()})
    return clean(runtime), clean(dev), None


def parse(name: str, text: str) -> tuple[list[str], list[str]]:
    """(runtime, dev) dependencies; a broken manifest has none."""
    return checked(name, text)[:2]


def parsed(manifests: DataFrame) -> DataFrame:
    """project_id, dependency, dev, error of ``manifests(project_id, name, content)``: a row a
    dependency, and one with an error, and no dependency, for each manifest that is broken,
    too long, or no text. Files that are too long are not read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for project, name, length, text in frame.itertuples(index=False):
                if length > MOST_BYTES or text is None:
                    rows.append((project, None, None, f"{name}: {'too long' if length > MOST_BYTES else 'not UTF-8'}"))
                    continue
                runtime, dev, error = checked(name, text)
                rows += [(project, d, kind, None) for kind, ds in ((False, runtime), (True, dev)) for d in ds]
                rows += [(project, None, None, error)] if error else []
            yield pd.DataFrame(rows, columns=["project_id", "dependency", "dev", "error"])

    named = manifests.where(F.col("name").isin(list(PARSERS)) & F.col("content").isNotNull())
    length = F.length("content")
    return named.select("project_id", "name", length.alias("length"), F.when(length <= MOST_BYTES, F.try_validate_utf8("content")).alias("text")).mapInPandas(run, f"{SCHEMA}, error string").distinct()


def dependencies(manifests: DataFrame) -> DataFrame:
    """project_id, dependency, dev of ``manifests(project_id, name, content)``."""
    return parsed(manifests).where("error IS NULL").drop("error")


def normalized(dep: Column) -> Column:
    return F.replace(F.lower(F.trim(dep)), F.lit("_"), F.lit("-"))


def frameworks(deps: DataFrame, spark: SparkSession) -> DataFrame:
    """project_id, frameworks: by weight, then name. Exact names and name ends meet the rules
    in an equal join; of prefix rules a dependency takes the longest."""
    dep = normalized(F.col("dependency"))
    forms = F.array_distinct(F.array(dep, F.regexp_extract(dep, r"^([^\[:]+)[\[:]", 1), F.element_at(F.split(dep, ":"), -1), F.element_at(F.split(dep, "/"), -1)))
    named = rules.rows(spark, [(d.lower(), f, w) for d, f, w in rules.FRAMEWORKS], ["form", "framework", "weight"])
    exact = deps.select("project_id", F.explode(forms).alias("form")).join(F.broadcast(named), "form").select("project_id", "framework", "weight")
    tail = F.element_at(F.split(dep, ":"), -1)
    longest = sorted(rules.FRAMEWORK_PREFIXES, key=lambda r: -len(r[0]))
    pick = F.coalesce(*[F.when(dep.startswith(p) | tail.startswith(p), F.struct(F.lit(f).alias("framework"), F.lit(w).alias("weight"))) for p, f, w in longest])
    prefixed = deps.select("project_id", pick.alias("r")).where("r IS NOT NULL").select("project_id", "r.framework", "r.weight")
    best = exact.unionByName(prefixed).groupBy("project_id", "framework").agg(F.max("weight").alias("weight"))
    return best.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "framework"))), lambda x: x["framework"]).alias("frameworks"))


def display_tags(frameworks_: Column, runtime: Column, most: int = 6) -> Column:
    none = F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.concat(F.coalesce(frameworks_, none), F.array_sort(F.coalesce(runtime, none)))), 1, most)
