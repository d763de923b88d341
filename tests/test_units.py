from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from vinculo.operators import amounts as A
from vinculo.operators import units as U
from vinculo.queries.training import funding_in_usd

RATES = [("USD", 1.0), ("EUR", 1.1), ("GBP", 1.3), ("INR", 0.012), ("JPY", 0.007), ("CHF", 1.1), ("SEK", 0.1), ("BRL", 0.2)]
SUMS = [
    ("$8.1 million+", None, None, 8_100_000), ("US$2.92bn", None, None, 2_920_000_000), ("41,5 Mio. €", None, None, 45_650_000), ("€1.234.567,00", None, None, 1_358_024), ("£5'100'000", None, None, 6_630_000), ("3 820 000 €", None, None, 4_202_000),
    ("R$7 800 000", None, None, 1_560_000), ("kr 1376000K", None, None, 137_600_000), ("Fr. 1.92mn", None, None, 2_112_000), ("JP¥70 mln", None, None, 490_000), ("8,3 MBRL", None, None, 1_660_000), ("2,7 M€", None, None, 2_970_000), ("94 lakhs", None, None, 112_800),
    ("Rs 4.6cr", None, None, 552_000), ("20.5 Cr", "INR", None, 2_460_000), ("72.4mn", "eur", None, 79_640_000), ("7,730", None, "figures in thousands of euro", 8_503_000), ("137", None, "USD m", 137_000_000), ("64,900", None, "all amounts in GBP '000", 84_370_000),
    ("40000", None, "stated in kUSD", 40_000_000), ("9", None, "amounts are given in million francs", 9_900_000), ("53.5", None, "unit = 1,000,000 EUR", 58_850_000), ("1,210,000", "GBP", "follows a 2M pilot contract", 1_573_000), ("20100MM", None, "served 3 million users at the time", 20_100_000_000),
    ("raised €44M at a €326M valuation", None, None, 48_400_000), ("around US$235 million from 4 investors", None, None, 235_000_000), ("US$5.1M in 2017", None, None, 5_100_000), ("about $ 7.72M (est.)", None, None, 7_720_000), ("USD 34m (second close)", None, None, 34_000_000),
    ("One and a half million dollars", None, None, 1_500_000), ("half a million kronor", None, None, 50_000), ("twenty-five hundred thousand euros", None, None, 2_750_000), ("Forty million swiss francs", None, None, 44_000_000), ("172.000.000,00 INR", None, None, 2_064_000),
    ("SEK 672 000 000", None, None, 67_200_000), ("$8800 THSD", None, None, 8_800_000), ("46,500,000", None, None, 46_500_000),
    ("undisclosed", None, None, None), (None, None, "follows a 2M pilot contract", None), ("", "USD", None, None), ("?", None, None, None), ("n/a", None, None, None), ("amount withheld", None, None, None),
]


@pytest.mark.parametrize("i", range(len(SUMS)))
def test_parse(i):
    amount, currency, note, usd = SUMS[i]
    got = A.parse(amount, currency, note)
    if usd is None:
        assert got is None
    else:
        scale, _, unit = got[1].rpartition(" ")
        assert round(Fraction(got[0]) * 10 ** U.MONEY_SCALES[scale] * Fraction(str(dict(RATES)[unit]))) == usd


def test_graph_composes_shortest_ways():
    g = U.UnitGraph()
    g.add("C", "K", 1, 273.15)
    g.add("F", "C", Fraction(5, 9), Fraction(-160, 9))
    ways = g.to("K")
    assert ways["F"][1] == 2 and ways["F"][0].scale == Fraction(5, 9) and float(ways["F"][0].scale * 212 + ways["F"][0].shift) == pytest.approx(373.15)
    assert "m" not in ways


def test_contradicting_cycles_are_refused():
    g = U.UnitGraph()
    g.add("m", "cm", 100)
    g.add("cm", "mm", 10)
    g.add("m", "mm", 1000)
    assert g.to("mm")["m"][0].scale == 1000
    g.add("m", "mm", 1001)
    with pytest.raises(U.InconsistentUnits):
        g.to("mm")
    with pytest.raises(U.InconsistentUnits):
        U.money_graph([("EUR", 1.1), ("EUR", 1.2)]).to("USD")
    with pytest.raises(ValueError):
        g.add("x", "y", 0)


def test_convert_keeps_every_row(spark):
    table = U.money_graph(RATES).table(spark, "USD")
    df = spark.createDataFrame([("1", "m EUR"), ("2", "nothing"), (None, "USD"), ("1", None), ("1", "m EUR")], "q string, unit string")
    got = U.convert(df, F.col("q"), F.col("unit"), F.lit("USD"), table).collect()
    assert sorted((r["canonical"] or Decimal(0)) for r in got) == [0, 0, 0, 1_100_000, 1_100_000]


def test_table(spark):
    rows = [(i, a, c, n, "x", 1) for i, (a, c, n, _) in enumerate(SUMS)]
    df = spark.createDataFrame([*rows, rows[0], (None, "$1", None, None, "x", 1)], "event_id long, amount string, currency string, note string, unit string, scale int")
    rates = spark.createDataFrame([*RATES, (None, 1.0), ("XXX", None)], "currency string, usd_per_unit double")
    got = {r["event_id"]: r["amount_usd"] for r in funding_in_usd(df, rates).collect()}
    assert got == {i: s[3] for i, s in enumerate(SUMS) if s[3] is not None}
    assert funding_in_usd(df.limit(0), rates).count() == 0
    assert funding_in_usd(df, rates.limit(0)).where("event_id = 0").count() in (0, 1)


def test_long_texts_end():
    assert A.parse("x" * 100_000, None, None) is None
    assert A.parse("$5m " + "and more " * 5_000, None, "word " * 5_000) == ("5", "m USD")


def test_several_targets_and_real_cycles(spark):
    graph = U.UnitGraph()
    graph.add("km", "m", 1000)
    graph.add("mi", "km", "1.609344")
    graph.add("C", "K", 1, "273.15")
    both = graph.table(spark, "m").unionByName(graph.table(spark, "K"))
    df = spark.createDataFrame([("2", "km", "m"), ("1", "mi", "m"), ("20", "C", "K"), ("20", "C", "m"), (None, "km", "m"), ("1", None, "m")], "q string, unit string, target string")
    got = [r["canonical"] and float(r["canonical"]) for r in U.convert(df, F.col("q"), F.col("unit"), F.col("target"), both).collect()]
    assert sorted(got, key=str) == sorted([2000.0, 1609.344, 293.15, None, None, None], key=str)
    money = U.money_graph(RATES)
    money.add("crore INR", "lakh INR", 99)  # contradicts the steps that are there
    with pytest.raises(U.InconsistentUnits):
        money.to("USD")
