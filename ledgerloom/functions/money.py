"""Money as exact integers: minor units of a currency, with explicit rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimals of each currency's minor unit.
EXPONENTS = {"AUD": 2, "CNY": 2, "EUR": 2, "GBP": 2, "HKD": 2, "IDR": 0, "JPY": 0, "MYR": 2, "SGD": 2, "USD": 2}

WIDE = "decimal(38,0)"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def div(n, d) -> Column:
    """``n div d``, truncating toward zero, as a long."""
    return F.call_function("div", _col(n), _col(d))


def div_round(n, d) -> Column:
    """Integer division that rounds half away from zero; d is positive."""
    n, d = _col(n).cast(WIDE), _col(d).cast(WIDE)
    return F.signum(n).cast("int") * div(F.abs(n) * 2 + d, d * 2)


def half_up(n, d) -> Column:
    """Half-up division for operands that aren't negative."""
    n, d = _col(n).cast(WIDE), _col(d).cast(WIDE)
    return div(n * 2 + d, d * 2)


def to_thousands(v) -> Column:
    """Down to thousands, at least 0."""
    return div(F.greatest(_col(v), F.lit(0)), 1000) * 1000


def exponent(currency) -> Column:
    pairs = [F.lit(x) for code, e in EXPONENTS.items() for x in (code, e)]
    return F.create_map(*pairs)[_col(currency)]


def power10(n) -> Column:
    return F.rpad(F.lit("1"), (_col(n) + 1).cast("int"), "0").cast(WIDE)


def cents(x) -> Column:
    """A double of at most two decimals as hundredths."""
    return F.round(_col(x) * 100).cast("long")


def cents_to_minor(v, currency) -> Column:
    return F.when(exponent(currency) == 2, _col(v).cast("long")).otherwise(div_round(v, 100))


def convert_minor(amount, rate_num, rate_scale, from_currency, to_currency) -> Column:
    """An amount at the rate num / 10^scale, in the other currency's minor units."""
    top = _col(amount).cast("decimal(19,0)") * _col(rate_num).cast("decimal(13,0)") * power10(exponent(to_currency)).cast("decimal(3,0)")
    return div_round(top, power10(_col(rate_scale) + exponent(from_currency)))


def invert_rate(num, scale, digits: int = 10) -> Column:
    """The inverse as an integer with ``digits`` decimals."""
    return div_round(power10(_col(scale) + digits), num)


def split_vat(gross) -> tuple[Column, Column]:
    """Base and tax of a gross amount at 11 percent; the base is rounded half up on the absolute."""
    g = _col(gross).cast("long")
    base = div(F.abs(g) * 100 + 55, 111)
    base = F.signum(g).cast("int") * base
    return base, g - base


def vat_on(base) -> Column:
    return div(_col(base).cast("long") * 22 + 100, 200)


def withholding(base, rate_bp) -> Column:
    """Tax withheld on a base, half up."""
    return half_up(_col(base).cast("long") * _col(rate_bp), 10_000)


def withheld_from_net(net, rate_bp, vat_percent: int) -> Column:
    """The tax withheld behind a payment that arrived net of it, half up."""
    return half_up(_col(net).cast("long") * _col(rate_bp), F.lit(10_000 + 100 * vat_percent) - _col(rate_bp))


def percent_one_decimal(part, whole) -> Column:
    """Tenths of a percent, truncating; null if the base isn't positive."""
    return F.when(_col(whole) > 0, div(_col(part).cast("long") * 1000, F.greatest(_col(whole), F.lit(1))))


def percent_half_up(part, whole) -> Column:
    return F.when(_col(whole) > 0, half_up(_col(part).cast("long") * 100, F.greatest(_col(whole), F.lit(1))))


def let(x: Column, then) -> Column:
    """``then`` of a value that is worked out once: expressions that name a long one many times grow with each step and compile no more."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def _cleaned(text, units: str, then) -> Column:
    """``then`` of an amount's text: a struct of sign, integer digits (whole) and fraction digits.

    The decimal separator is the last of two kinds; a lone separator is one unless exactly three
    digits follow it; a repeated one groups thousands.
    """

    def unsigned(s):
        brackets = s.rlike(r"^\(.*\)$")
        body = F.when(brackets, F.regexp_replace(s, r"^\((.*)\)$", "$1")).otherwise(s)
        return let(F.struct(F.coalesce(brackets, F.lit(False)).alias("brackets"), body.alias("body")), signed)

    def signed(x):
        minus = x["body"].startswith("-")
        s = F.regexp_replace(x["body"], r"^-?\+?", "")
        dots, commas = F.length(F.regexp_replace(s, r"[^.]", "")), F.length(F.regexp_replace(s, "[^,]", ""))
        after = F.regexp_extract(s, r"[.,]([^.,]*)$", 1)
        return let(F.struct(F.when(x["brackets"] != minus, -1).otherwise(1).alias("sign"), s.alias("s"), dots.alias("dots"), commas.alias("commas"), after.alias("after")), parted)

    def parted(x):
        dots, commas = x["dots"], x["commas"]
        lone = F.when(dots > 0, dots).otherwise(commas)
        decimal = F.when((dots > 0) & (commas > 0), True).when(dots + commas == 0, False).otherwise((lone == 1) & (F.length(x["after"]) != 3))
        whole = F.when(decimal, F.regexp_extract(x["s"], r"^(.*)[.,][^.,]*$", 1)).otherwise(x["s"])
        fraction = F.when(decimal, x["after"]).otherwise(F.lit(""))
        return let(F.struct(x["sign"].alias("sign"), F.regexp_replace(whole, "[.,]", "").alias("whole"), fraction.alias("fraction")), then)

    return let(F.regexp_replace(F.trim(_col(text)), rf"(?i)\s|Rp\.?|{units}", ""), unsigned)


def parse_rupiah(text) -> Column:
    """Whole units; the first fraction digit rounds. Null for what is no number, 0 for null or empty."""

    def value(x):
        whole, fraction = x["whole"], x["fraction"]
        fine = whole.rlike(r"^\d{0,18}$") & fraction.rlike(r"^\d*$")
        number = F.coalesce(F.nullif(F.when(fine, whole), F.lit("")).cast("long"), F.lit(0)) + F.when(fraction.rlike("^[5-9]"), 1).otherwise(0)
        return F.when(fine, x["sign"] * number)

    plain = F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"(?i)\s|Rp\.?|IDR", "")
    return F.when(plain.isin("", "-"), F.lit(0).cast("long")).otherwise(_cleaned(text, "IDR", value)).cast("long")


def parse_cents(text) -> Column:
    """Hundredths; further decimals round half away. Null for what is no number, 0 for null or empty."""

    def value(x):
        whole, fraction = x["whole"], x["fraction"]
        fine = whole.rlike(r"^\d{0,16}$") & fraction.rlike(r"^\d{0,18}$") & (F.length(whole) + F.length(fraction) > 0)
        digits = F.nullif(F.when(fine, F.concat(whole, F.rpad(F.substring(fraction, 1, 2), 2, "0"))), F.lit(""))
        number = digits.cast("long") + F.when(F.substring(fraction, 3, 1).rlike("[5-9]"), 1).otherwise(0)
        return F.when(fine, x["sign"] * number)

    plain = F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"(?i)\s|Rp\.?|IDR|SGD|USD", "")
    return F.when(plain.isin("", "-"), F.lit(0).cast("long")).otherwise(_cleaned(text, "IDR|SGD|USD", value)).cast("long")


def split_equally(amount, n, i) -> Column:
    """Part ``i`` (from 1) of ``n`` equal parts; the last takes the remainder."""
    base = div(amount, n)
    return F.when(_col(i) < _col(n), base).otherwise(_col(amount) - base * (_col(n) - 1))


def corporate_tax(taxable, turnover, months: int = 12) -> Column:
    """22 percent of the taxable income; for a yearly turnover of at most 50 billion the share that
    belongs to its first 4.8 billion is taxed at half the rate. Both parts are rounded down; a turnover
    of fewer months counts for the year."""
    base, year = F.greatest(_col(taxable), F.lit(0)).cast("long"), div(_col(turnover).cast("long") * 12, months)
    first = F.lit(4_800_000_000)
    share = div(base.cast("decimal(18,0)") * first.cast("decimal(10,0)"), F.greatest(year, F.lit(1)))
    eased = F.when(year <= 0, 0).when(year <= first, base).when(year <= 50_000_000_000, share).otherwise(0)
    return div(eased * 22, 200) + div((base - eased) * 22, 100)


def progressive_tax(taxable) -> Column:
    """Annual tax over the layers of taxable income."""
    # Upper end and percent of each layer.
    layers = [(60_000_000, 5), (250_000_000, 15), (500_000_000, 25), (5_000_000_000, 30), (None, 35)]
    low, total, taxable = 0, F.lit(0).cast("long"), _col(taxable).cast("long")
    for high, percent in layers:
        top = taxable if high is None else F.least(taxable, F.lit(high).cast("long"))
        total = total + div(F.greatest(F.lit(0), top - low) * percent, 100)
        low = high
    return total


# Symbols of currencies, and what one unit may plausibly cost in IDR.
SYMBOLS = {"IDR": "Rp", "SGD": "S$", "USD": "US$", "EUR": "€", "AUD": "A$", "MYR": "RM", "CNY": "CN¥", "JPY": "¥", "HKD": "HK$", "GBP": "£"}
IDR_BAND = {"USD": (3000, 60000), "SGD": (3000, 60000), "EUR": (3000, 80000), "GBP": (3000, 90000), "AUD": (2000, 50000), "CNY": (500, 10000), "HKD": (500, 10000), "MYR": (500, 20000), "JPY": (20, 1000)}
# Fixed value: digits before the decimals that a typed amount may have.
MOST_DIGITS = 15


def _of(currency, table: dict, item=lambda v: v) -> Column:
    return F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, item(v))])[_col(currency)]


def strict_money(text, currency) -> tuple[Column, Column]:
    """M4: an amount as a person types it, dots between thousands and a comma before decimals, in minor units, and why it can't be
    read (null: it can): FORM, UNSURE (thousands or decimals: "250,000"), LARGE, DECIMALS (more than the currency has). It is
    never rounded and never guessed. Null or blank is 0."""
    s = F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"\s", "")
    names = "|".join(rf"\Q{x}\E" for pair in SYMBOLS.items() for x in pair)
    part = lambda n: F.regexp_extract(s, rf"(?i)^(\(?)(-?)((?:{names})\.?)?(\d{{1,3}}(?:\.\d{{3}})+|\d+)(?:,(\d+))?(\)?)$", n)
    mark, grouped, fraction = F.upper(part(3)), part(4), part(5)
    led = mark.isin("") | (mark == F.upper(_of(currency, SYMBOLS))) | (mark == F.upper(_of(currency, SYMBOLS, lambda v: f"{v}."))) | (mark == _col(currency))
    shape = F.concat(part(1), part(2), part(6))  # brackets or a minus, not both
    digits, places = F.regexp_replace(grouped, r"\.", ""), exponent(currency)
    problem = (
        F.when(s == "", F.lit(None).cast("string"))
        .when((grouped == "") | ~shape.isin("", "-", "()") | ~led, "FORM")
        .when(~grouped.contains(".") & (F.length(fraction) == 3) & ((places == 0) | ~fraction.rlike("[1-9]")), "UNSURE")
        .when(F.length(F.regexp_replace(digits, "^0+", "")) > MOST_DIGITS, "LARGE")
        .when(F.substring(fraction, places + 1, F.length(fraction)).rlike("[1-9]"), "DECIMALS")
    )
    minor = F.concat(digits, F.rpad(F.substring(fraction, F.lit(1), places), places, "0")).try_cast("long")
    return F.when(s == "", F.lit(0).cast("long")).when(problem.isNull(), F.when(shape == "", minor).otherwise(-minor)), problem


def parse_rate(text) -> tuple[Column, Column]:
    """M8: a positive decimal rate as an integer and its decimals, both null if it is none or zero. Commas group thousands, or one
    stands before the decimals."""
    s = F.regexp_replace(_col(text), r"\s", "")
    plain = F.when(s.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$"), F.regexp_replace(s, ",", "")).when(s.rlike(r"^\d+,\d+$"), F.regexp_replace(s, ",", ".")).otherwise(s)
    fine = plain.rlike(r"^\d+(\.\d+)?$") & plain.rlike("[1-9]")
    number = F.when(fine, F.regexp_replace(plain, r"\.", "")).try_cast("decimal(38,0)")
    return number, F.when(number.isNotNull(), F.length(F.regexp_extract(plain, r"\.(\d+)$", 1)))


def normal_rate(text, currency=None, quote=None) -> Column:
    """M8: a typed rate with a point before its decimals. Of two kinds of separators the last stands before decimals; groups of
    three behind one kind are thousands, unless a zero leads. With a pair, one group is decimals between foreign
    currencies, and against IDR what lies in the currency's plausible band alone."""
    s = F.regexp_replace(_col(text), r"\s", "")
    dots, commas = F.length(F.regexp_replace(s, r"[^.]", "")), F.length(F.regexp_replace(s, "[^,]", ""))
    last_is_dot = s.rlike(r"\.[^.,]*$")
    both = F.when(last_is_dot, F.replace(s, F.lit(","), F.lit(""))).otherwise(F.regexp_replace(F.replace(s, F.lit("."), F.lit("")), "^([^,]*),", "$1."))
    groups = s.rlike(r"^\d{1,3}(\.\d{3})+$") | s.rlike(r"^\d{1,3}(,\d{3})+$")
    thousands = F.regexp_replace(s, "[.,]", "")
    decimal = F.regexp_replace(s, "^([^.,]*)[.,]", "$1.")
    guess = thousands
    if currency is not None:
        foreign = (_col(currency) != "IDR") & (_col(quote) != "IDR")
        to_idr = _col(quote) == "IDR"
        base = F.when(to_idr, _col(currency)).otherwise(_col(quote))
        low, high = _of(base, IDR_BAND, lambda v: float(v[0])), _of(base, IDR_BAND, lambda v: float(v[1]))
        lies = lambda n: F.coalesce(F.when(to_idr, n.between(low, high)).otherwise(n.between(1 / high, 1 / low)), F.lit(False))
        as_decimal = lies(decimal.try_cast("double")) & ~lies(thousands.try_cast("double"))
        guess = F.when(foreign, F.when(dots + commas > 1, thousands).otherwise(decimal)).when(low.isNull(), thousands).when(as_decimal, decimal).otherwise(thousands)
    return F.when((dots > 0) & (commas > 0), both).when(dots + commas == 0, s).when(~groups | s.startswith("0"), decimal).otherwise(guess)


def format_rate(number, scale) -> Column:
    """A rate's canonical text: no zeros at its end."""
    digits = _col(number).cast("string")
    digits = F.lpad(digits, F.greatest(F.length(digits), _col(scale) + 1), "0")
    cut = F.length(digits) - _col(scale)
    fraction = F.regexp_replace(F.substring(digits, cut + 1, F.length(digits)), "0+$", "")
    return F.concat(F.substring(digits, F.lit(1), cut), F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""))


def format_money(value, currency, accounting: bool = False, bare: bool = False) -> Column:
    """M9: minor units as text, dots between thousands and a comma before decimals; below zero with a minus or in brackets."""
    places, amount = exponent(currency), F.abs(_col(value).cast(WIDE))
    unit = power10(places)
    whole = F.regexp_replace(F.regexp_replace(div(amount, unit).cast("string"), r"(?<=\d)(?=(\d{3})+$)", "."), "^$", "0")
    body = F.concat(whole, F.when(places > 0, F.concat(F.lit(","), F.lpad((amount % unit).cast("long").cast("string"), places, "0"))).otherwise(""))
    shown = body if bare else F.concat(_of(currency, SYMBOLS), F.lit(" "), body)
    below = F.concat(F.lit("("), shown, F.lit(")")) if accounting else F.concat(F.lit("-"), shown)
    return F.when(_col(value) < 0, below).otherwise(shown)
