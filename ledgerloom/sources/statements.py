"""Bank statements and ledgers as rows, from text files of usual layouts.

Files are read as one row each; a file's lines stay in order as an array position. Only the layout is
decided from content, by expressions, so all files of a folder are one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.money import parse_cents
from ..functions.text import amount_marker

# The first bytes of file kinds, in hexadecimal.
MAGIC = {"25504446": "PDF", "504B0304": "XLSX", "D0CF11E0": "XLS"}
# Words that name columns, in the languages that statements use.
COLUMNS = {
    "date": "date|tanggal|tgl|posting date|value date",
    "description": "description|keterangan|uraian|transaction|details?|memo|remark",
    "debit": "debit|debet|withdrawal|mutasi debet|keluar",
    "credit": "credit|kredit|deposit|mutasi kredit|masuk",
    "amount": "amount|jumlah|mutasi|nominal",
    "balance": "balance|saldo",
    "side": "db/cr|d/k|dr/cr|side|type",
}
# Text by which a bank is known.
BANKS = {"BCA": r"\bBCA\b|BANK CENTRAL ASIA", "BRI": r"\bBRI\b|RAKYAT INDONESIA", "MANDIRI": r"MANDIRI", "BNI": r"\bBNI\b|NEGARA INDONESIA", "CIMB": r"\bCIMB\b", "OCBC": r"\bOCBC\b", "PERMATA": r"PERMATA"}


def file_kind(content) -> Column:
    """PDF, XLSX, XLS, MARKUP or TEXT by a file's first bytes."""
    c = F.col(content) if isinstance(content, str) else content
    head = F.hex(F.substring(c, 1, 4))
    kinds = F.create_map(*[F.lit(x) for kv in MAGIC.items() for x in kv])
    markup = F.decode(F.substring(c, 1, 200), "UTF-8").rlike(r"^\s*<")
    return F.coalesce(kinds[head], F.when(markup, "MARKUP").otherwise("TEXT"))


def bank_of(text) -> Column:
    """The bank that a text names."""
    t, out = F.upper(F.col(text) if isinstance(text, str) else text), F.lit("GENERIC")
    for name, pattern in reversed(BANKS.items()):
        out = F.when(t.rlike(pattern), name).otherwise(out)
    return out


def delimiter(lines) -> Column:
    """Of tab, semicolon and comma the one that splits most of the first twelve lines into the same number of
    cells, by lines times separators (the first at a tie); separators within quotes don't count. A comma if none is there."""
    first = F.slice(F.filter(lines, lambda line: F.trim(line) != ""), 1, 12)
    bare = F.transform(first, lambda line: F.regexp_replace(line, '"[^"]*("|$)', ""))

    def score(d: str) -> Column:
        counts = F.filter(F.transform(bare, lambda line: F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))), lambda n: n > 0)
        most = F.array_max(F.transform(counts, lambda n: F.struct(F.size(F.filter(counts, lambda m: m == n)).alias("lines"), n.alias("n"))))
        return F.coalesce(most["lines"] * most["n"], F.lit(0))

    tabs, semis, commas = map(score, "\t;,")
    return F.when((tabs > 0) & (tabs >= semis) & (tabs >= commas), "\t").when((semis > 0) & (semis >= commas), ";").otherwise(",")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, lines: each text file with its lines in order."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.select("file", F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n").alias("lines"))


def cells_of(line, sep) -> Column:
    """The cells of a line, where quotes may hold the separator: a separator is one where an even
    number of quotes follows."""
    marked = F.regexp_replace(line, F.concat(F.lit("["), sep, F.lit(']+?(?=(?:[^"]*"[^"]*")*[^"]*$)')), F.lit("\u0001"))
    return F.transform(F.split(marked, "\u0001"), lambda c: F.trim(F.regexp_replace(c, '^\\s*"|"\\s*$', "")))


def table_rows(files: DataFrame, day_first: bool = True) -> DataFrame:
    """File, row_number, day, description, amount (cents, signed), balance.

    The header is the first line that names a date and a balance or amount column; columns are found by
    their words. Rows without a date but with an amount take the date above; rows with neither go."""
    sep = delimiter(F.col("lines"))
    rows = files.withColumn("sep", sep).select("file", "sep", F.posexplode("lines").alias("row_number", "line"))
    rows = rows.filter(F.trim("line") != "").withColumn("cells", cells_of(F.col("line"), F.col("sep")))
    low = F.transform("cells", lambda c: F.lower(F.trim(c)))
    has = lambda what: F.exists(low, lambda c: c.rlike(f"^({COLUMNS[what]})\\b"))
    header = has("date") & (has("balance") | has("amount") | has("debit"))
    heads = rows.filter(header).groupBy("file").agg(F.min_by(F.struct("row_number", low.alias("names")), "row_number").alias("head"))
    place = lambda what: F.array_position(F.transform("head.names", lambda c: c.rlike(f"^({COLUMNS[what]})\\b")), True).cast("int")
    body = rows.join(heads, "file").filter(F.col("row_number") > F.col("head.row_number"))
    for what in COLUMNS:
        body = body.withColumn(f"_{what}", F.when(place(what) > 0, F.get("cells", place(what) - 1)))
    amount = parse_cents(F.regexp_replace("_amount", r"(?i)\s*(CR|DB)\.?\s*$", ""))
    side = F.coalesce(amount_marker("_amount"), F.upper("_side"))
    signed = F.when(side.rlike("^(DB|D|DR|DEBIT)$"), -F.abs(amount)).when(side.rlike("^(CR|K|KR|KREDIT|C)$"), F.abs(amount)).otherwise(amount)
    sides = F.coalesce(parse_cents("_credit"), F.lit(0)) - F.coalesce(parse_cents("_debit"), F.lit(0))
    body = body.withColumn("day", parse_date("_date", day_first)).withColumn("amount", F.when(F.col("_amount").isNotNull(), signed).otherwise(sides))
    above = Window.partitionBy("file").orderBy("row_number").rowsBetween(Window.unboundedPreceding, 0)
    body = body.withColumn("day", F.coalesce("day", F.when(F.col("amount") != 0, F.last("day", ignorenulls=True).over(above))))
    balance = F.when(F.trim("_balance") != "", parse_cents("_balance"))
    return body.filter("day is not null").select("file", "row_number", "day", F.coalesce("_description", F.lit("")).alias("description"), F.coalesce("amount", F.lit(0).cast("long")).alias("amount"), balance.alias("balance"))


def mt940_rows(files: DataFrame) -> DataFrame:
    """File, row_number, account, day, amount (cents), description of a SWIFT MT940 message.

    A movement is ``:61:`` with value date, optional booking month and day, mark and amount; RC and RD
    turn a mark round. The text is the ``:86:`` behind it."""
    text = F.array_join("lines", "\n")
    parts = files.select("file", F.posexplode(F.split(text, r"\n(?=:61:)")).alias("row_number", "part"))
    account = F.regexp_extract("part", r":25:([^\n]+)", 1)
    pattern = r"^:61:(\d{6})(\d{4})?(R?[CD])([A-Z])?([\d,]+)"
    mark = F.regexp_extract("part", pattern, 3)
    money = parse_cents(F.regexp_replace(F.regexp_extract("part", pattern, 5), ",$", ",00"))
    order = Window.partitionBy("file").orderBy("row_number").rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.withColumn("account", F.last(F.nullif(account, F.lit("")), ignorenulls=True).over(order)).filter(F.col("part").startswith(":61:"))
    return rows.select(
        "file", "row_number", "account",
        F.to_date(F.regexp_extract("part", pattern, 1), "yyMMdd").alias("day"),
        F.when(mark.isin("C", "RD"), money).otherwise(-money).alias("amount"),
        F.trim(F.regexp_replace(F.regexp_extract("part", r"(?s):86:(.*?)(?=\n:\d\d[A-Z]?:|\n-|$)", 1), "\n", " ")).alias("description"),
    )


def mt940_balances(files: DataFrame) -> DataFrame:
    """Opening and closing balance of each message, in cents."""
    text = F.array_join("lines", "\n")
    value = lambda tag: F.when(F.regexp_extract(text, rf":60F:|:{tag}:", 0) != "", parse_cents(F.regexp_extract(text, rf":{tag}:[CD]\d{{6}}[A-Z]{{3}}([\d,]+)", 1)) * F.when(F.regexp_extract(text, rf":{tag}:([CD])", 1) == "D", -1).otherwise(1))
    return files.select("file", value("60F").alias("opening"), value("62F").alias("closing"))


def mapped_rows(rows: DataFrame, mapping: dict[str, int], day_first: bool = True) -> DataFrame:
    """Rows of ``cells`` by a user's mapping of columns (from 0): date, description, amount or debit
    and credit, balance."""
    cell = lambda what: F.get("cells", F.lit(mapping[what]))
    amount = parse_cents(cell("amount")) if "amount" in mapping else F.coalesce(parse_cents(cell("credit")), F.lit(0)) - F.coalesce(parse_cents(cell("debit")), F.lit(0))
    balance = parse_cents(cell("balance")) if "balance" in mapping else F.lit(None).cast("long")
    return rows.select("file", "row_number", parse_date(cell("date"), day_first).alias("day"), cell("description").alias("description"), amount.alias("amount"), balance.alias("balance")).filter("day is not null")


def day_month_evidence(rows: DataFrame) -> DataFrame:
    """By file, whether a first or second number above 12 proves that days or months come first."""
    first = F.regexp_extract("date_text", r"^(\d{1,2})[-/.](\d{1,2})", 1).try_cast("int")
    second = F.regexp_extract("date_text", r"^(\d{1,2})[-/.](\d{1,2})", 2).try_cast("int")
    rows = rows.groupBy("file").agg(F.max(first > 12).alias("day_first"), F.max(second > 12).alias("month_first"))
    return rows.withColumn("order", F.when(F.col("day_first") & ~F.col("month_first"), "DMY").when(F.col("month_first") & ~F.col("day_first"), "MDY").when(F.col("day_first"), "CONFLICT").otherwise("UNKNOWN"))


# A date of two numbers and an optional year and time.
NUMERIC_DATE = r"^(\d{1,2})[/.-](\d{1,2})(?:[/.-](\d{2}|\d{4}))?(?:[ T]+\d{1,2}[:.]\d{2}(?:[:.]\d{2}(?:\.\d+)?)?(?:\s*[AaPp][Mm])?(?:\s*(?:Z|[+-]\d{2}:?\d{2}))?)?$"


def date_orders(rows: DataFrame) -> DataFrame:
    """File, order, day_first and month_first (the first text that proves each), n: how a file writes numeric dates.

    ``rows``: file, row_number, date_text. DMY or MDY by a number above 12, MIXED by both; without proof the order in which
    the dates run in time, oldest or newest first, DMY if both do; UNKNOWN if neither does. Files without a numeric date have no row."""
    text = F.trim(F.regexp_replace("date_text", "^'", ""))
    rows = rows.select("file", "row_number", text.alias("t")).filter(F.col("t").rlike(NUMERIC_DATE))
    part = lambda k: F.regexp_extract("t", NUMERIC_DATE, k)
    year = F.when(part(3) == "", 0).when(F.length(part(3)) == 2, part(3).try_cast("int") + 2000).otherwise(part(3).try_cast("int"))
    rows = rows.withColumn("a", part(1).cast("int")).withColumn("b", part(2).cast("int")).withColumn("y", year)
    a, b = F.col("a"), F.col("b")
    key = lambda d, m: F.when(m.between(1, 12) & d.between(1, 31), F.col("y") * 10_000 + m * 100 + d)
    rows = rows.withColumn("dmy", key(a, b)).withColumn("mdy", key(b, a))
    before = Window.partitionBy("file").orderBy("row_number").rowsBetween(Window.unboundedPreceding, -1)
    for c in ("dmy", "mdy"):
        rows = rows.withColumn(f"_{c}", F.col(c) - F.last(c, ignorenulls=True).over(before))
    proof = lambda one, other: one.between(13, 31) & other.between(1, 12)
    runs = lambda c: (F.coalesce(F.min(f"_{c}"), F.lit(0)) >= 0) | (F.coalesce(F.max(f"_{c}"), F.lit(0)) <= 0)
    found = rows.groupBy("file").agg(
        F.min_by("t", F.when(proof(a, b), F.col("row_number"))).alias("day_first"), F.min_by("t", F.when(proof(b, a), F.col("row_number"))).alias("month_first"),
        runs("dmy").alias("_d"), runs("mdy").alias("_m"), F.count("*").alias("n"),
    )
    d, m = F.col("day_first").isNotNull(), F.col("month_first").isNotNull()
    order = F.when(d & m, "MIXED").when(d, "DMY").when(m, "MDY").when(F.col("_d"), "DMY").when(F.col("_m"), "MDY").otherwise("UNKNOWN")
    return found.select("file", order.alias("order"), "day_first", "month_first", "n")


def unpivoted(rows: DataFrame, keys: list[str], groups: dict[str, tuple[str, str]]) -> DataFrame:
    """A trial balance's column groups (name to debit and credit columns) as rows of net amounts."""
    array = F.array(*[F.struct(F.lit(g).alias("column_group"), (F.coalesce(parse_cents(d), F.lit(0)) - F.coalesce(parse_cents(c), F.lit(0))).alias("net")) for g, (d, c) in groups.items()])
    return rows.select(*keys, F.inline(array))
