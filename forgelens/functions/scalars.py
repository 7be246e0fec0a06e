"""Scalar functions as Column expressions. ``now`` is always given, never the clock."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``; else each use of it may be computed again."""
    return F.transform(F.array(value), body)[0]


def non_empty(c: Column) -> Column:
    """Trimmed; blank becomes null."""
    return F.nullif(F.trim(c), F.lit(""))


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def like_pattern(text: str) -> str:
    """A contains-pattern in which backslash, % and _ of the text are literal."""
    return "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def contains_text(c: Column, text: str) -> Column:
    """Case-insensitive contains, wildcards literal."""
    return F.ilike(c, F.lit(like_pattern(text)), F.lit("\\"))


def parse_time(c: Column) -> Column:
    """RFC 3339, or a date alone at midnight; anything else null."""
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))


def whole_days(since: Column, now: Column) -> Column:
    """Whole periods of 24 hours, not midnights; never negative."""
    return F.when(since.isNotNull(), F.greatest(F.timestamp_diff("DAY", since, now), F.lit(0)))


def idle_days(last_commit: Column, updated: Column, now: Column) -> Column:
    """The shorter of the two ages; null where neither time is known."""
    return F.least(whole_days(last_commit, now), whole_days(updated, now))


def relative_time(ts: Column, now: Column) -> Column:
    """just now, then minutes, hours, days, months of 30 days, years of 365 days; of no time, an empty text."""
    seconds = F.greatest(F.unix_timestamp(now) - F.unix_timestamp(ts), F.lit(0))
    steps = [(60, None, "just now"), (3600, 60, " min ago"), (86400, 3600, " h ago"), (30 * 86400, 86400, " d ago"), (365 * 86400, 30 * 86400, " mo ago")]
    out = F.when(ts.isNull(), F.lit(""))
    for below, unit, label in steps:
        value = F.lit(label) if unit is None else F.concat(F.floor(seconds / unit).cast("string"), F.lit(label))
        out = out.when(seconds < below, value)
    return out.otherwise(F.concat(F.floor(seconds / (365 * 86400)).cast("string"), F.lit(" y ago")))


def date_text(ts: Column) -> Column:
    return F.substring(ts, 1, 10)


def _one_decimal(x: Column) -> Column:
    """A double of 1 or more with one decimal, rounded by its exact value, ties to the even
    digit: what follows the point is, in 2^-52ths, a whole number."""
    whole = F.floor(x)
    tens = ((x - whole) * float(1 << 52)).cast("long") * 10
    digit, rest = F.shiftright(tens, 52), tens.bitwiseAND((1 << 52) - 1)
    up = (rest > 1 << 51) | ((rest == 1 << 51) & (digit % 2 == 1))
    tenths = whole * 10 + digit + up.cast("long")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def _sized(n: Column, steps: list[tuple[int, str]]) -> Column:
    out = None
    for unit, label in reversed(steps):
        value = F.concat(_one_decimal(n.cast("double") / float(unit)), F.lit(label))
        out = F.when(n >= unit, value) if out is None else out.when(n >= unit, value)
    return out


def format_bytes(n: Column) -> Column:
    """Whole bytes below 1024, then KB, MB, GB and TB with one decimal."""
    return _sized(n, [(1024**power, f" {unit}") for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1)]).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def format_count(n: Column, millions: bool = True) -> Column:
    """As it is below 1000, then k and, with ``millions``, M with one decimal."""
    return _sized(n, [(1000, "k"), (1_000_000, "M")][: 1 + millions]).otherwise(n.cast("string"))


def percent(ratio: Column) -> Column:
    return F.round(F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)) * 100).cast("int")


def stars(rating: Column) -> Column:
    r = F.least(F.greatest(rating, F.lit(0)), F.lit(5)).cast("int")
    return F.concat(F.repeat(F.lit("★"), r), F.repeat(F.lit("☆"), F.lit(5) - r))


def mask_key(key: Column) -> Column:
    """First and last four characters of keys longer than eight; shorter ones hidden."""
    n = F.length(key)
    return F.when(n == 0, F.lit("")).when(n <= 8, F.lit("****")).otherwise(F.concat(F.left(key, F.lit(4)), F.lit("****"), F.right(key, F.lit(4))))


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("…")))


def citation_ids(text: Column) -> Column:
    """Ids in square brackets, distinct, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[([A-Za-z0-9_-]+)\]"), F.lit(1)))


def strip_code_fence(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*\n?", ""), r"\n?```\s*$", ""))


def json_of_reply(text: Column, schema: str) -> Column:
    """A JSON object in a model's reply: the text from the first { to the last }."""
    return F.from_json(F.regexp_extract(strip_code_fence(text), r"(?s)(\{.*\})", 1), schema)


def json_or(raw: Column, schema: str, default: Column) -> Column:
    """Parsed JSON; garbage and null give the default, and the row stays."""
    return F.coalesce(F.from_json(raw, schema), default)


def normalize_path(path: Column) -> Column:
    """Forward slashes, none at the end (but the root's)."""
    slashes = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    return F.when(slashes == "/", slashes).otherwise(F.regexp_replace(slashes, r"/+$", ""))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def stable_id(prefix: str, name: Column, *natural_key: Column) -> Column:
    """The same key gives the same id on every run."""
    return F.concat(F.lit(prefix + "_"), slug(name), F.lit("_"), F.lower(F.hex(F.xxhash64(*natural_key))))


def split_identifier(name: Column) -> Column:
    """snake, kebab, camel and acronym parts, lower-cased."""
    parted = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(parted), r"[^a-z0-9]+"), lambda x: x != "")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def count_in(text: Column, terms: list[str]) -> Column:
    """How many of the terms stand in the text."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(t)).cast("int") for t in terms])


def language_colour(language: Column) -> Column:
    """A steady colour for each language: its hue from the name, grey where it is unknown."""
    hue = F.pmod(F.crc32(F.lower(language).cast("binary")), F.lit(360))
    return F.when(non_empty(language).isNull(), F.lit("hsl(0, 0%, 60%)")).otherwise(F.format_string("hsl(%d, 55%%, 50%%)", hue))


def normalize_query(text: Column, most: int = 200) -> Column:
    """Trimmed, runs of white space as one space, at most ``most`` characters."""
    return F.substring(collapse_spaces(text), 1, most)


def group_concat(values: Column, separator: str = " ") -> Column:
    """An aggregate: the distinct values, sorted, as one text."""
    return F.array_join(F.array_sort(F.collect_set(values)), separator)
