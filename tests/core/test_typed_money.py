"""Typed amounts, rates and formatted money: cases worked out by hand, and a round trip."""

import random

from pyspark.sql import functions as F

from ledgerloom.functions import money as m


def test_strict_money(spark):
    cases = {
        ("1.500.000", "IDR"): (1500000, None), ("12.500,50", "SGD"): (1250050, None), ("-1.234", "IDR"): (-1234, None), ("(1.234)", "IDR"): (-1234, None), (" Rp. 1 500 ", "IDR"): (1500, None),
        ("rp1.500", "IDR"): (1500, None), ("S$ 7,5", "SGD"): (750, None), ("sgd 7", "SGD"): (700, None), ("us$7", "USD"): (700, None), ("$7", "USD"): (None, "FORM"), ("", "IDR"): (0, None), (None, "IDR"): (0, None), ("  ", "USD"): (0, None),
        ("12.500.000,00", "IDR"): (12500000, None), ("250,000", "IDR"): (None, "UNSURE"), ("250,000", "USD"): (None, "UNSURE"), ("250,125", "USD"): (None, "DECIMALS"), ("250,125", "IDR"): (None, "UNSURE"),
        ("1.250,000", "USD"): (125000, None), ("1,5", "IDR"): (None, "DECIMALS"), ("1.25", "USD"): (None, "FORM"), ("1.2500", "IDR"): (None, "FORM"), ("(-5)", "IDR"): (None, "FORM"), ("--5", "IDR"): (None, "FORM"), ("-(5)", "IDR"): (None, "FORM"),
        ("5,", "USD"): (None, "FORM"), ("1234567890123456", "IDR"): (None, "LARGE"), ("000001234567890123456", "IDR"): (None, "LARGE"), ("0000000000123456789012345", "IDR"): (123456789012345, None), ("-0", "IDR"): (0, None), ("abc", "IDR"): (None, "FORM"),
    }
    rows = spark.createDataFrame(list(cases), "text string, currency string")
    value, problem = m.strict_money("text", "currency")
    got = {(r.text, r.currency): (r.value, r.problem) for r in rows.select("*", value.alias("value"), problem.alias("problem")).collect()}
    assert got == cases


def test_rates(spark):
    typed = {"1.31": (131, 2), "11245.50": (1124550, 2), "11,245.50": (1124550, 2), "1,31": (131, 2), "11,245": (11245, 0), "1,2,3": (None, None), "0.00": (None, None), "": (None, None), "-1": (None, None), "1.": (None, None), " 1 2 ": (12, 0), "9" * 30: (int("9" * 30), 0)}
    rows = spark.createDataFrame([(k,) for k in typed], "text string")
    number, scale = m.parse_rate("text")
    assert {r.text: (None if r.n is None else int(r.n), r.s) for r in rows.select("text", number.alias("n"), scale.alias("s")).collect()} == typed
    plain = {"12.250,50": "12250.50", "12,250.50": "12250.50", "12.250": "12250", "1,31": "1.31", "1.31": "1.31", "0.745": "0.745", "1.085": "1085", "12250": "12250", "1.2.3": "1.2.3"}
    rows = spark.createDataFrame([(k,) for k in plain], "text string")
    assert {r.text: r.r for r in rows.select("text", m.normal_rate("text").alias("r")).collect()} == plain
    pairs = {
        ("1.085", "EUR", "USD"): "1.085", ("1.085.000", "EUR", "USD"): "1085000", ("105.234", "JPY", "IDR"): "105.234", ("16.250", "USD", "IDR"): "16250", ("16,250", "USD", "IDR"): "16250",
        ("0.000062", "IDR", "USD"): "0.000062", ("16.250,5", "USD", "IDR"): "16250.5", ("10.500", "IDR", "IDR"): "10500", ("1.250", "JPY", "IDR"): "1250", ("1,31", "SGD", "USD"): "1.31",
    }
    rows = spark.createDataFrame(list(pairs), "text string, currency string, quote string")
    assert {(r.text, r.currency, r.quote): r.r for r in rows.select("*", m.normal_rate("text", "currency", "quote").alias("r")).collect()} == pairs
    shown = {(131, 2): "1.31", (13100, 4): "1.31", (5, 3): "0.005", (1200, 0): "1200", (100, 2): "1", (7, 1): "0.7"}
    rows = spark.createDataFrame(list(shown), "n long, s int")
    assert {(r.n, r.s): r.t for r in rows.select("*", m.format_rate("n", "s").alias("t")).collect()} == shown


def test_formatted_money_reads_back(spark):
    rng = random.Random(1)
    rows = [(rng.choice([-1, 1]) * rng.randrange(10 ** rng.randrange(1, 15)), c) for c in m.SYMBOLS for _ in range(40)] + [(0, "IDR"), (0, "USD"), (-5, "USD")]

    def shown(v, c):
        digits = str(abs(v)).rjust(3, "0") if m.EXPONENTS[c] else str(abs(v)) + "00"
        whole = f"{int(digits[:-2]):,}".replace(",", ".") + ("," + digits[-2:] if m.EXPONENTS[c] else "")
        return ("-" if v < 0 else "") + f"{m.SYMBOLS[c]} {whole}"

    frame = spark.createDataFrame(rows, "v long, c string").withColumn("t", m.format_money("v", "c")).withColumn("a", m.format_money("v", "c", accounting=True)).withColumn("b", m.format_money("v", "c", bare=True))
    back, _ = m.strict_money("t", "c")
    again, problem = m.strict_money("a", "c")
    for r in frame.select("*", back.alias("back"), again.alias("again"), problem.alias("problem")).collect():
        assert r.t == shown(r.v, r.c) and r.back == r.again == r.v and r.problem is None
        assert r.a == (f"({shown(-r.v, r.c)})" if r.v < 0 else r.t) and r.b == r.t.replace(f"{m.SYMBOLS[r.c]} ", "")
