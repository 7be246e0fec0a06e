"""Secret scans: patterns, and Markov models of random strings against identifiers."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, let, named, others

#: kind -> (pattern, group whose length counts, least length), in the order of the kinds.
#: A failing match is dropped after the scan, so it still consumes its characters. For
#: access and hex, matches are whole runs, so the least length can stand in the pattern.
PATTERNS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Runs that the models judge; of those, the parts that the patterns leave.
TOKENS = r"[A-Za-z0-9+/_=-]{20,}"
#: Classes of characters: each small letter, capitals, digits, marks.
CLASSES = "abcdefghijklmnopqrstuvwxyzA0-"
_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_TO = "A" * 26 + "0" * 10 + "-" * 5
#: The least log-likelihood ratio from which a run counts as random: the odds against it, as
#: one run in some 160,000 is a secret. And the share of held-out ordinary samples that
#: calibration lets pass for random.
THRESHOLD, FALSE_ALARMS = 12.0, 0.001
SPAN = "array<struct<s:int,e:int,h:string>>"

VOCABULARY = """
account action active address admin alert amount answer array author backup balance batch before block border branch bridge
browser buffer build button cache callback cancel catalog category change channel check client close cluster code collection
column command comment commit common compare config connection content context control copy count create current customer data
database date debug default delete delivery description detail device directory display document domain download driver edge
element email empty enable engine entry error event example export factory feature field file filter final first folder format
frame function gateway general global graph group handler header height hidden history image import index information input
insert instance interface internal invoice item journal kernel keyword label language layer layout length level library limit
link list loader local location lock logger machine manager mapping market master matrix member memory message method metric
model module monitor network node notification number object observer offset operation option order organization output owner
package page parameter parent parser partition password path pattern payment people picture pipeline plugin policy position
prefix previous price primary process product profile program project property protocol provider public query queue random
range reader record reference region register release remote render report request resource response result return review
router schedule schema scope screen search section security segment select sequence server service session setting shadow
simple single source special stack standard start state status storage stream string structure style subject submit suffix
summary support symbol system table target task template tenant text thread title token total trace transaction transfer
transform tree trigger type unique update upload user utility validate value variable vector version video view visible
warehouse watch widget width window wizard worker workspace wrapper
""".split()


def samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """``n`` labelled strings of each kind: text, random, held_out (every fourth). Random:
    digests in hexadecimal, base 64, and letters with digits; ordinary: two to four words of
    a vocabulary, joined as identifiers and paths are. They are the same on every run."""
    words = F.array(*[F.lit(w) for w in VOCABULARY])
    pick = lambda j: F.get(words, F.pmod(F.xxhash64("id", F.lit(j)), F.lit(len(VOCABULARY))).cast("int"))
    some = F.slice(F.array(*[pick(j) for j in range(4)]), 1, (F.pmod(F.xxhash64("id", F.lit(9)), F.lit(3)) + 2).cast("int"))
    cap = lambda ws: F.transform(ws, lambda w: F.initcap(w))
    of = lambda turns, *kinds: F.element_at(F.array(*kinds), (F.pmod(F.xxhash64("id", F.lit(turns)), F.lit(len(kinds))) + 1).cast("int"))
    joined = F.array_join
    ordinary = of(7, joined(some, "_"), joined(some, "-"), joined(cap(some), ""), joined(some, ""), F.upper(joined(some, "_")), joined(some, "/"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.base64(F.unhex(digest))
    odd = of(8, digest, base64, F.translate(base64, "+/=", "aZ"))
    ids = spark.range(n)
    held = F.pmod(F.xxhash64("id", F.lit(10)), F.lit(4)) == 0
    return ids.select(ordinary.alias("text"), F.lit(False).alias("random"), held.alias("held_out")).unionByName(ids.select(odd.alias("text"), F.lit(True).alias("random"), held.alias("held_out")))


def _classes(token: Column) -> Column:
    """The place in CLASSES of each character of a run, which is split once."""
    code = lambda c: F.ascii(c)
    return F.transform(F.split(F.translate(token, _FROM, _TO), ""), lambda c: F.when(code(c) >= 97, code(c) - 97).when(code(c) == 65, 26).when(code(c) == 48, 27).otherwise(28))


def _pairs(classes: Column) -> Column:
    """For each two neighbours, class * len(CLASSES) + next class."""
    return let(classes, lambda c: F.filter(F.transform(c, lambda x, i: F.get(c, i - 1) * len(CLASSES) + x), lambda x: x.isNotNull()))


def train(labelled: DataFrame) -> list[float]:
    """log P(next | class, random) - log P(next | class, ordinary) by pair of classes, with
    one added to each count: len(CLASSES)^2 numbers, however many samples there are."""
    n = len(CLASSES)
    rows = labelled.where(F.col("text").isNotNull()).select("random", F.explode(_pairs(_classes(F.regexp_replace("text", r"[^A-Za-z0-9+/_=-]", "")))).alias("pair")).groupBy("random", "pair").count().collect()
    counts = {kind: [1] * (n * n) for kind in (False, True)}
    for row in rows:
        counts[row["random"]][row["pair"]] += row["count"]
    log = {kind: [math.log(c / sum(of[i // n * n : i // n * n + n])) for i, c in enumerate(of)] for kind, of in counts.items()}
    return [a - b for a, b in zip(log[True], log[False], strict=True)]


def _weight(classes: Column, model: list[float]) -> Column:
    weights = F.array(*[F.lit(x) for x in model])
    return F.aggregate(_pairs(classes), F.lit(0.0), lambda acc, pair: acc + F.get(weights, pair))


def ratio(text: Column, model: list[float]) -> Column:
    """Log-likelihood of the run as a random string, less that as an ordinary one."""
    return _weight(_classes(text), model)


def calibrated(labelled: DataFrame, false_alarms: float = FALSE_ALARMS) -> tuple[list[float], float]:
    """(model, threshold): trained on the rows of ``labelled(text, random, held_out)`` that
    are not held out; of the ordinary ones that are, of 20 characters or more, at most the
    share ``false_alarms`` reaches the threshold, which is THRESHOLD at least."""
    model = train(labelled.where("NOT held_out"))
    ordinary = labelled.where("held_out AND NOT random AND length(text) >= 20").select(ratio(F.col("text"), model).alias("ratio"))
    n = ordinary.count()
    highest = [r["ratio"] for r in ordinary.orderBy(F.col("ratio").desc()).limit(int(n * false_alarms) + 1).collect()]
    return model, max([THRESHOLD, *[math.nextafter(x, math.inf) for x in highest[-1:]]])


#: Distances at which prefixes are combined; texts of more matches than twice the last do not exist.
_STEPS = [1 << k for k in range(30)]


def prefixes(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """The combination of all values up to each, by doubling: n log n, where a fold that
    appends to its result would copy it n times."""
    steps = lambda v: F.filter(F.array(*[F.lit(k) for k in _STEPS]), lambda k: k < F.size(v))
    wider = lambda acc, k: F.transform(acc, lambda x, i: F.when(i >= k, combine(F.get(acc, i - k), x)).otherwise(x))
    return let(values, lambda v: F.aggregate(steps(v), v, wider))


def _places(text: Column, pattern: str) -> Column:
    """The pattern's leftmost non-overlapping matches as structs s, e, h: where they begin
    and end, in code points, from the lengths of matches and of what lies between."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(g: Column, h: Column) -> Column:
        ends = prefixes(F.transform(h, lambda x, i: F.length(F.get(g, i)) + F.length(x)), lambda a, b: a + b)
        return let(ends, lambda e: F.transform(h, lambda x, i: F.struct((F.get(e, i) - F.length(x)).alias("s"), F.get(e, i).alias("e"), x.alias("h"))).cast(SPAN))

    return F.when(text.rlike(pattern), let(gaps, lambda g: let(hits, lambda h: spans(g, h)))).otherwise(F.array().cast(SPAN))


def _kind(places: Column, order: int, kind: str) -> Column:
    return F.transform(places, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def _odd(text: Column, base: Column, model: list[float], threshold: float) -> Column:
    """The runs of a text, or their parts that no base span covers, that count as random.

    Where runs and base spans begin and end, in order, cuts the text; sums of what begins
    less what ends say of each stretch whether it is in a run, and how many base spans cover
    it. A run is split into characters once, for all of its parts.
    """
    run, span, nth = 1, 2, 16  # in one number: in a run or not, base spans (a kind never overlaps itself), runs begun
    edge = lambda at, d: F.struct(at.alias("at"), F.lit(d).alias("d"))

    def parts(runs: Column) -> Column:
        edges = [F.transform(runs, lambda r: edge(r["s"], run + nth)), F.transform(runs, lambda r: edge(r["e"], -run)), F.transform(base, lambda b: edge(b["s"], span)), F.transform(base, lambda b: edge(b["e"], -span))]

        def cut(at: Column) -> Column:
            depth = prefixes(F.transform(at, lambda x: x["d"]), lambda a, b: a + b)
            return let(depth, lambda d: F.transform(at, lambda x, i: F.struct(x["at"].alias("s"), F.get(at, i + 1)["at"].alias("e"), F.get(d, i).alias("d"))))

        return F.filter(let(F.sort_array(F.concat(*edges)), cut), lambda p: (p["s"] < p["e"]) & (p["d"] % nth == run))

    def judged(runs: Column, classes: Column) -> Column:
        def random(p: Column) -> Column:
            k = F.floor(p["d"] / nth).cast("int") - 1
            return _weight(F.slice(F.get(classes, k), p["s"] - F.get(runs, k)["s"] + 1, p["e"] - p["s"]), model) >= threshold

        return F.filter(parts(runs), random)

    found = let(_places(text, TOKENS), lambda runs: let(F.transform(runs, lambda r: _classes(r["h"])), lambda classes: judged(runs, classes)))
    return F.when(text.rlike(TOKENS), found).otherwise(F.array().cast("array<struct<s:int,e:int,d:int>>"))


def scan(docs: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with base_spans and secret_spans: arrays of structs s, k, e, kind by place.

    secret_spans holds the base spans and, as kind ``markov``, runs of 20 or more that the
    models call random, or of these runs the parts that base spans leave, of any length.
    Places count code points, ends are
    exclusive. Null text: empty, no spans. Columns of docs with one of the new names, in
    whatever case, are replaced. Rows are independent of each other; nothing is exchanged.
    The cost is linear in a text's length, but for sorting and summing its n matches, n log n.
    """
    kept = others(docs, "base_spans", "secret_spans")
    text = F.coalesce(F.col("text"), F.lit(""))
    found = []
    for order, (kind, pattern, group, least) in enumerate(PATTERNS):
        places = _places(text, pattern)
        if group:
            long_enough = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x) >= least)
            places = F.when(text.rlike(pattern), let(long_enough, lambda ok: F.filter(_places(text, pattern), lambda x, i: F.get(ok, i)))).otherwise(F.array().cast(SPAN))
        found.append(_kind(places, order, kind))
    base, run_text = fresh(docs, "base_found", "run_text")
    with_base = docs.select(*kept, text.alias(run_text), F.sort_array(F.concat(*found)).alias(base))
    text = named(run_text)
    odd = _odd(text, named(base), model, threshold)
    return with_base.select(*kept, named(base).alias("base_spans"), F.sort_array(F.concat(named(base), _kind(odd, len(PATTERNS), "markov"))).alias("secret_spans"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each stretch that spans (by start) cover replaced by ``mark``; spans that
    only touch have a mark each. The text is split into characters once."""
    part = lambda chars, a, b: F.array_join(F.slice(chars, a + 1, F.greatest(b - a, F.lit(0))), "")

    def marked(chars: Column, far: Column) -> Column:
        before = lambda i: F.coalesce(F.get(far, i - 1), F.lit(0))
        pieces = F.transform(spans, lambda x, i: F.when(x["s"] >= before(i), F.concat(part(chars, before(i), x["s"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), part(chars, F.get(far, F.size(far) - 1), F.size(chars)))

    found = let(F.split(text, ""), lambda chars: let(prefixes(F.transform(spans, lambda x: x["e"]), lambda a, b: F.greatest(a, b)), lambda far: marked(chars, far)))
    return F.when(F.size(spans) > 0, found).otherwise(text)


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, *calibrated(samples(spark))).select("doc_id", "base_spans", "secret_spans")
    count = lambda kind: F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(kind) for kind, *_ in PATTERNS], F.sha2(as_text(F.col("base_spans")), 256).alias("base_sha256"), as_text(F.col("secret_spans")).alias("spans"))
