"""Full-text retrieval: trigrams, BM25 over phrases, and a substring fallback."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import any_of, contains_text, let

GRAM = 3
MOST_GRAMS = 64
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Searched columns of each kind; a phrase must lie inside one of them.
INDEXED = {
    "project": ["name", "description", "tags", "language", "framework"],
    "asset": ["name", "description", "tags", "source_path"],
    "capability": ["name", "description"],
    "insight": ["title", "description", "tags", "type", "evidence"],
    "opportunity": ["title", "description", "why", "capabilities", "evidence"],
}
#: The substring fallback: scores by the first column that matches, the score of a match in
#: any other searched column, and the order after the score.
FALLBACK: dict[str, tuple[list[tuple[str, float]], float, list[tuple[str, bool]]]] = {
    "project": ([("name", 1.0), ("description", 0.7)], 0.5, [("name", True)]),
    "asset": ([("name", 1.0), ("description", 0.7), ("tags", 0.6)], 0.45, [("reuse_score", False)]),
    "capability": ([("name", 1.0)], 0.7, [("project_count", False)]),
    "insight": ([("title", 1.0), ("description", 0.8)], 0.6, [("confidence", False), ("id", True)]),
    "opportunity": ([("title", 1.0), ("description", 0.8), ("why", 0.7)], 0.55, [("rating", False), ("id", True)]),
}


def _is_cjk(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF)))


def phrases_of(token: str) -> list[str]:
    """The token; CJK tokens of four or more also match by any of their trigrams."""
    if len(token) >= 4 and any(map(_is_cjk, token)):
        return list(dict.fromkeys([token, *[token[i : i + GRAM] for i in range(len(token) - GRAM + 1)][:MOST_GRAMS]]))
    return [token]


def compile_query(text: str) -> list[list[str]] | None:
    """AND of ORs of phrases; None if a token is too short for trigrams, or nothing is asked."""
    tokens = text.split()
    return [phrases_of(t) for t in tokens] if tokens and all(len(t) >= GRAM for t in tokens) else None


def needs_fallback(text: str) -> bool:
    return bool(text.strip()) and compile_query(text) is None


def grams(c: Column) -> Column:
    """All trigrams of the lower-cased text, repeats included. The text is split into
    characters once, so that long texts cost in proportion."""
    at = lambda x: F.slice(x, 1, F.size(x) - (GRAM - 1))
    joined = lambda x: F.transform(at(x), lambda first, i: F.concat(first, F.get(x, i + 1), F.get(x, i + 2)))
    return F.when(F.length(F.lower(c)) < GRAM, F.array().cast("array<string>")).otherwise(let(F.split(F.lower(c), ""), joined))


def postings(df: DataFrame, kind: str, columns: Sequence[str], key: str = "id") -> DataFrame:
    """kind, gram, id, place, tf: the index to store, partitioned by kind and sorted by gram."""
    by_column = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), grams(F.col(c)).alias("grams")) for i, c in enumerate(columns)])).alias("x")
    rows = df.select(F.col(key).alias("id"), by_column).select("id", "x.place", F.explode("x.grams").alias("gram"))
    return rows.groupBy(F.lit(kind).alias("kind"), "gram", "id", "place").agg(F.count("*").alias("tf"))


def candidates(index: DataFrame, kind: str, groups: list[list[str]]) -> DataFrame:
    """Ids whose columns hold all trigrams of a phrase of every group, to be verified."""
    out = None
    for group in groups:
        found = None
        for phrase in group:
            parts = sorted({phrase.lower()[i : i + GRAM] for i in range(len(phrase) - GRAM + 1)})
            hit = index.where((F.col("kind") == kind) & F.col("gram").isin(parts)).groupBy("id", "place").agg(F.count("*").alias("n")).where(F.col("n") == len(parts)).select("id").distinct()
            found = hit if found is None else found.union(hit)
        out = found.distinct() if out is None else out.join(found.distinct(), "id", "left_semi")
    return out


def phrase_count(columns: Sequence[str], phrase: str) -> Column:
    """How often the phrase stands in the columns, without overlaps."""
    low = phrase.lower()
    found = lambda t: F.when(F.contains(t, F.lit(low)), (F.length(t) - F.length(F.replace(t, F.lit(low), F.lit("")))) / len(low)).otherwise(F.lit(0.0))
    return reduce(lambda a, b: a + b, [let(F.lower(F.coalesce(F.col(c), F.lit(""))), found) for c in columns])


def match(df: DataFrame, columns: Sequence[str], text: str, index: DataFrame | None = None, kind: str = "", key: str = "id") -> DataFrame:
    """Rows that match all groups, with bm25 (greater is better) and relevance in 0..1.

    Counts of the collection come from one aggregate over it, which is one row. With an index
    the candidates are looked up first, and the text is searched only in them.
    """
    groups = compile_query(text)
    if groups is None:
        return df.where(F.lit(False)).withColumns({"bm25": F.lit(0.0), "relevance": F.lit(0.0)})
    flat = list(dict.fromkeys(p for g in groups for p in g))
    tf = {p: phrase_count(columns, p) for p in flat}
    length = reduce(lambda a, b: a + b, [F.greatest(F.length(F.coalesce(F.col(c), F.lit(""))) - (GRAM - 1), F.lit(0)) for c in columns])
    stats = df.agg(F.count("*").alias("n"), F.avg(length).alias("avg"), *[F.count_if(tf[p] > 0).alias(f"n{i}") for i, p in enumerate(flat)]).first()
    hits = df.join(candidates(index, kind, groups).withColumnRenamed("id", key), key, "left_semi") if index is not None else df
    hits = hits.where(reduce(lambda a, b: a & b, [any_of([tf[p] > 0 for p in g]) for g in groups]))
    score = F.lit(0.0)
    for i, p in enumerate(flat):
        n = stats[f"n{i}"]
        idf = F.greatest(F.log(F.lit((stats["n"] - n + 0.5) / (n + 0.5))), F.lit(LEAST_IDF))
        score = score + idf * tf[p] * (K1 + 1) / (tf[p] + K1 * (1 - B + B * length / (stats["avg"] or 1.0)))
    return hits.withColumn("bm25", score).withColumn("relevance", 1 - 1 / (1 + F.abs(F.col("bm25"))))


def like(df: DataFrame, kind: str, text: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The fallback: the whole query as one substring, scored by where it stands."""
    ranked, rest, _ = FALLBACK[kind]
    columns = list(columns or INDEXED[kind])
    found = {c: F.coalesce(contains_text(F.col(c), text.strip()), F.lit(False)) for c in {*columns, *[c for c, _ in ranked]}}
    score = reduce(lambda acc, x: acc.when(found[x[0]], x[1]), ranked[1:], F.when(found[ranked[0][0]], ranked[0][1])).otherwise(rest)
    return df.where(any_of(list(found.values()))).withColumn("relevance", score)


def recall(df: DataFrame, kind: str, text: str, limit: int = 60, index: DataFrame | None = None) -> DataFrame:
    """At most ``limit`` rows of a kind with relevance and from_substring."""
    if needs_fallback(text):
        order = [F.col(c) if up else F.col(c).desc() for c, up in FALLBACK[kind][2]]
        return like(df, kind, text).withColumn("from_substring", F.lit(True)).orderBy(F.col("relevance").desc(), *order, "id").limit(limit)
    found = match(df, INDEXED[kind], text, index, kind)
    return found.withColumn("from_substring", F.lit(False)).orderBy(F.col("bm25").desc(), "id").limit(limit).drop("bm25")
