"""Sizes as text: rounded by the exact value of the quotient, ties to the even digit."""

from decimal import ROUND_HALF_EVEN, Decimal

from forgelens.functions import scalars as S


def expected(n, base, units):
    for power in range(len(units), 0, -1):
        if n >= base**power:
            return str(Decimal(n / base**power).quantize(Decimal("0.1"), ROUND_HALF_EVEN)) + units[power - 1]
    return None


def test_sizes(spark):
    mb, k = 1024 * 1024, 1000
    sizes = [0, 1023, 1024, 1536, int(31.25 * mb), int(182.25 * mb), int(549.25 * mb), int(31.75 * mb), int(0.25 * mb), 1024**3 - 1, 3 * 1024**4 + 7, 2**60]
    sizes += [x + d for x in (int(31.25 * mb), int(31.75 * mb)) for d in (-1, 1)]
    counts = [0, 999, 1000, 1050, 1150, 1250, 1350, 1449, 1450, 1451, 999_949, 999_950, 999_999, 1_050_000, 1_150_000, 1_250_000, 7 * k**3]
    rows = spark.createDataFrame([(n,) for n in sizes + counts], "n long").select("n", S.format_bytes(S.F.col("n")).alias("b"), S.format_count(S.F.col("n")).alias("c")).collect()
    for r in rows:
        assert r.b == (expected(r.n, 1024, [" KB", " MB", " GB", " TB"]) or f"{r.n} B")
        assert r.c == (expected(r.n, 1000, ["k", "M"]) or str(r.n))
