"""Order MinHash fingerprints: near in edit distance, near in signature."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .common import SPACES, let

#: Words in a k-mer; tuples of a signature, each of the two least k-mers of an order; bits of
#: a tuple; and sorted lists from which the orders come.
K, TUPLES, TUPLE_BITS, LISTS = 3, 64, 32, 2
#: Bits of a k-mer's place in its text, as a share of the text's length.
PLACE_BITS = 24
#: Texts of up to SHORT code points have tuples of CHARS-character k-mers, too. Words longer
#: than LONG count as their overlapping pieces of PIECE characters.
SHORT, CHARS, LONG, PIECE = 1024, 4, 24, 4
FIRST = -(1 << 63)


def _kmers(hashes: Column, k: int = K) -> Column:
    """Hashes of the k-mers of hashed tokens; of the whole sequence where it is shorter."""
    return let(
        hashes,
        lambda h: F.when(F.size(h) == 0, F.slice(h, 1, 0))
        .when(F.size(h) < k, F.array(F.xxhash64(h)))
        .otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))),
    )


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def _pieces(words: Column) -> Column:
    """Hashes of the words, in place of each long one of all its pieces."""
    cut = lambda w: let(F.split(w, ""), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - PIECE), lambda i: F.xxhash64(*[F.get(c, i + j) for j in range(PIECE)])))
    long_ = lambda w: F.length(w) > LONG
    each = F.flatten(F.transform(words, lambda w: F.when(long_(w), cut(w)).otherwise(F.array(F.xxhash64(w)))))
    return F.when(F.exists(words, long_), each).otherwise(F.transform(words, lambda w: F.xxhash64(w)))


def _characters(text: Column) -> Column:
    """Hashes of the characters, after CHARS - 1 empty ones, so that each has a k-mer."""
    return F.transform(F.concat(F.array_repeat(F.lit(""), CHARS - 1), F.split(text, "")), lambda c: F.xxhash64(c))


def _numbered(kmers: Column) -> Column:
    """The k-mers in the order of the text; the second and later occurrences of one hash
    with their number."""

    def number(pairs: Column) -> Column:
        at = lambda j: F.get(pairs, j)
        starts = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda j: (j == 0) | (at(j)["h"] != at(j - 1)["h"]))
        one = lambda j, s: F.struct(at(j)["p"].alias("p"), F.when(j == s, at(j)["h"]).otherwise(F.xxhash64(at(j)["h"], j - s)).alias("h"))
        every = let(starts, lambda runs: F.flatten(F.transform(runs, lambda s, r: F.transform(F.sequence(s, F.coalesce(F.get(runs, r + 1), F.size(pairs)) - 1), lambda j: one(j, s)))))
        return F.transform(F.sort_array(every), lambda x: x["h"])

    sorted_pairs = F.sort_array(F.transform(kmers, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(kmers)) == F.size(kmers), kmers).otherwise(let(sorted_pairs, number))


def _levels(text: Column, graded: bool) -> list[Column]:
    """Occurrence-numbered k-mers by level. Not ``graded``: of words alone. Else of words in
    which long ones count as their pieces, and of the characters of the words with one space
    between them; null if these are more than SHORT code points. So texts of few words or
    without spaces stay like their edits, and two texts always have a level in common."""
    words = let(_words(text), lambda w: let(_kmers(_pieces(w) if graded else F.transform(w, lambda x: F.xxhash64(x))), _numbered))
    if not graded:
        return [words]
    plain = lambda t: F.when(t == "", F.array().cast("array<long>")).when(F.length(t) <= SHORT, let(_kmers(_characters(t), CHARS), _numbered))
    return [words, let(F.array_join(_words(text), " "), plain)]


def starts(of: int) -> list[int]:
    """Where the orders of a list begin: even steps round the circle of 64-bit numbers, for
    each list a little further on."""
    n = TUPLES // LISTS
    return [-(1 << 63) + j * ((1 << 64) // n) + of * ((1 << 64) // TUPLES) for j in range(n)]


def _sorted(kmers: Column, of: int) -> Column:
    """The k-mers by the hash's bits, turned for each list, each with its place in the text in
    the lowest bits."""
    by = 64 // LISTS * of
    turned = lambda x: F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by else x
    share = lambda i: F.floor(i * float(1 << PLACE_BITS) / F.size(kmers))
    return F.sort_array(F.transform(kmers, lambda x, i: turned(x).bitwiseAND(F.lit(-(1 << PLACE_BITS))).bitwiseOR(share(i))))


def _tuples(kmers: Column, of: int) -> Column:
    """The tuples of a list. An order goes round the sorted k-mers from its start on; hashes
    are random, so each k-mer is as likely the least of it. The two least are put in the order
    of the text and hashed; of a single k-mer, it stands for both."""
    place, bare = lambda m: m.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)), lambda m: F.shiftright(m, PLACE_BITS)
    both = lambda a, b: F.when(place(a) <= place(b), F.xxhash64(bare(a), bare(b))).otherwise(F.xxhash64(bare(b), bare(a))).bitwiseAND(F.lit((1 << TUPLE_BITS) - 1))

    def every(s: Column) -> Column:
        n = F.size(s)
        halves = F.filter(F.array(*[F.lit(1 << h) for h in reversed(range(31))]), lambda h: h <= n)
        step = lambda start: lambda at, h: F.when(F.get(s, at + h - 1) < start, at + h).otherwise(at)
        two = lambda at: let(F.get(s, at % n), lambda a: let(F.get(s, (at + 1) % n), lambda b: both(a, b)))
        return let(halves, lambda hs: F.transform(F.array(*[F.lit(x) for x in starts(of)]), lambda start: let(F.aggregate(hs, F.lit(0), step(start)), two)))

    return let(_sorted(kmers, of), every)


def _signature(kmers: Column) -> Column:
    every = let(kmers, lambda k: F.when(F.size(k) == 0, F.array().cast("array<long>")).otherwise(F.concat(*[_tuples(k, of) for of in range(LISTS)])))
    return F.when(kmers.isNotNull(), every)


def signatures(rows: DataFrame, keys: list[str], texts: dict[str, Column], graded: bool = False) -> DataFrame:
    """keys and a signature for each of ``texts``: its levels, each the tuples as numbers of
    TUPLE_BITS bits; null where the text has no such level.

    The tuples have 64 orders over all occurrence-numbered k-mers, half of them on each of two
    sorted lists (see ``_tuples``): of a text of many k-mers hardly two orders of a list have
    one in common.
    Null and texts without words: no tuples. Rows are independent of each other; nothing is
    exchanged.
    """
    names = ("words", "chars") if graded else ("words",)
    sign = lambda of: let(of, lambda k: _signature(k))
    return rows.select(*keys, *[F.struct(*[sign(of).alias(n) for n, of in zip(names, _levels(text, graded), strict=True)]).alias(name) for name, text in texts.items()])


def as_text(of: Column) -> Column:
    """A signature as hexadecimal digits, eight a tuple."""
    return F.array_join(F.transform(of, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples. Neither has any: 1."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(same / F.lit(TUPLES))


def print_text(of: Column, graded: bool) -> Column:
    """The digits of words; for a short text then a point and those of chars."""
    if not graded:
        return as_text(of["words"])
    return F.concat(as_text(of["words"]), F.when(of["chars"].isNull(), F.lit("")).otherwise(F.concat(F.lit("."), as_text(of["chars"]))))


def print_likeness(a: Column, b: Column, graded: bool) -> Column:
    """By characters if both texts are short, else by words."""
    words = likeness(a["words"], b["words"])
    return F.when(a["chars"].isNotNull() & b["chars"].isNotNull(), likeness(a["chars"], b["chars"])).otherwise(words) if graded else words


def _bounds(keys: DataFrame, ranges: int) -> list[int]:
    """Keys that occur, at which ``ranges`` ranges of about as many rows begin, but for the
    first. From the key column alone."""
    dealt = keys.repartitionByRange(ranges, "k").groupBy(F.spark_partition_id().alias("range")).agg(F.min("k").alias("k"))
    return sorted({r["k"] for r in dealt.collect()})[1:] if ranges > 1 else []


def _range_of(key: Column, bounds: Column, n: int) -> Column:
    """How many of the n sorted bounds are at most the key, by halving."""
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(n.bit_length()))]) if n else F.array().cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= key, at + step).otherwise(at))


def _in_ranges(docs: DataFrame, per_range: int) -> tuple[DataFrame, WindowSpec]:
    """The rows with range, look and wrap, and the order within a range (see with_next)."""
    key = F.coalesce("doc_id", F.lit(FIRST))
    keys = docs.select(key.alias("k"))
    n, low = keys.agg(F.count("*"), F.min("k")).first()
    found = _bounds(keys, max(1, -(-n // max(per_range, math.isqrt(n)))))
    bounds = F.from_json(F.lit(json.dumps(found)), "array<long>")
    at = lambda look, wrap, to: F.struct(F.lit(look).alias("look"), F.lit(wrap).alias("wrap"), to.alias("range"))

    def copies(place: Column) -> Column:
        at_bound = (place > 0) & F.coalesce(F.get(bounds, place - 1) == key, F.lit(False))
        every = F.array(at(False, False, place), F.when(at_bound, at(True, False, place - 1)), F.when(key == F.lit(low), at(True, True, F.lit(len(found)))))
        return F.filter(every, lambda x: x.isNotNull())

    dealt = docs.select("*", F.inline(let(_range_of(key, bounds, len(found)), copies)))
    return dealt, Window.partitionBy("range").orderBy("wrap", key, "text")


def with_next(docs: DataFrame, values: list[str], per_range: int = 2000) -> DataFrame:
    """``docs(doc_id, text)`` with next_<value> from the next row by (doc_id, text), after the
    last the first. Null doc_ids come first.

    Rows are dealt once, to ranges of doc_id whose bounds are ids that occur (found from
    that column alone). The row at a bound also goes to the range before it, where it is
    only looked at; a range's rows are never compared with all others'. There are as many
    rows in a range as ranges, ``per_range`` at least, so neither a range nor the list of
    bounds grows as fast as the table.
    """
    dealt, order = _in_ranges(docs, per_range)
    return dealt.withColumns({f"next_{v}": F.lead(v).over(order) for v in values}).where("NOT look").drop("look", "wrap", "range")


def fingerprint_edits(docs: DataFrame, graded: bool = False, per_range: int = 2000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next for each row of ``docs(doc_id, text)``.

    The edited text: the last floor(n_chars / 4) code points replaced by the first as many
    (or all) of the next document. Null text: empty; its likeness to another empty one is
    1. Rows that share a doc_id follow each other by text; a table of one row is its own
    next. A doc_id of -2^63 stands with the null ones. Other columns are ignored. ``graded``:
    by signatures of words and of characters (see ``_levels``). Texts are exchanged once, to
    the ranges of ``with_next``; all that follows stays there.
    """
    dealt, order = _in_ranges(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), per_range)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    met = dealt.select("range", "look", "doc_id", "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next_text"))
    # In two steps, so that the edited text is made once.
    edits = met.select("range", "look", "doc_id", "place", "text", n.cast("long").alias("n_chars"), F.inline(F.array(F.struct(F.when(~F.col("look"), edited).alias("edited")))))
    hashed = edits.select("*", F.sha2("edited", 256).alias("edited_sha256"))
    keys = ["range", "place", "look", "doc_id", "n_chars", "edited_sha256"]
    signed = signatures(hashed, keys, {"print": F.col("text"), "edited": F.col("edited")}, graded)
    after = signed.withColumn("next", F.lead("print").over(Window.partitionBy("range").orderBy("place"))).where("NOT look")
    a, b, c = F.col("print"), F.col("edited"), F.col("next")
    return after.select("doc_id", "n_chars", "edited_sha256", print_text(a, graded).alias("fingerprint"), print_text(b, graded).alias("edited_fingerprint"), print_likeness(a, b, graded).alias("near_edited"), print_likeness(a, c, graded).alias("near_next"))


def op5_order_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"), graded=True)
