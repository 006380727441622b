"""Headers of ledger and balance files: words with slips, and the first table of a sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns of column headers, in the order in which they are asked.
PATTERNS = {
    "date": r"^(tanggal|tgl\.?|date|entry date|posting date|tanggal transaksi|tanggal jurnal|transaction date)$",
    "code": r"^(kode akun|kode perkiraan|kode|no\.? akun|nomor akun|account code|account no\.?|account number|acc(ount)? code|coa)$",
    "name": r"^(nama akun|nama perkiraan|perkiraan|account name|account|akun|nama)$",
    "debit": r"^(debit|debet|dr|mutasi debit|mutasi debet)(\s*\(.*\))?$",
    "credit": r"^(kredit|credit|cr|mutasi kredit)(\s*\(.*\))?$",
    "amount": r"^(saldo|saldo akhir|jumlah|nilai|balance|amount|closing balance|ending balance)$",
    "level": r"^(level|lvl|tingkat)$",
    "desc": r"^(keterangan|deskripsi|description|uraian|memo|narration|reconstruction logic \/ description)$",
    "voucher": r"^(no\.? bukti|nomor bukti|voucher|no\.? voucher|no\.? jurnal|nomor jurnal|journal no\.?|journal number|transaction no\.?|no\.? transaksi)$",
    "entity": r"^(entitas|entity|perusahaan|company)$",
    "currency": r"^(mata uang|currency|ccy|valuta|curr\.?)$",
    "rate": r"^(kurs|rate|exchange rate|fx rate)$",
    "notes": r"^(notes|catatan|note)$",
}
# Words that are also found with a slip.
WORDS = {
    "date": ["tanggal", "tanggal transaksi", "tanggal jurnal", "entry date", "posting date", "transaction date"],
    "code": ["kode akun", "kode perkiraan", "nomor akun", "account code", "account number"],
    "name": ["nama akun", "nama perkiraan", "perkiraan", "account name"],
    "debit": ["debit", "debet", "mutasi debit", "mutasi debet"],
    "credit": ["kredit", "credit", "mutasi kredit"],
    "amount": ["saldo akhir", "jumlah", "balance", "amount", "closing balance", "ending balance"],
    "desc": ["keterangan", "deskripsi", "description", "uraian", "narration"],
    "voucher": ["nomor bukti", "voucher", "nomor jurnal", "journal number"],
    "entity": ["entitas", "entity", "perusahaan", "company"],
    "currency": ["mata uang", "currency", "valuta"],
    "rate": ["exchange rate"],
    "notes": ["catatan"],
}
# Titles of reports that are never read as balances, and the form of account codes.
TITLES = [
    r"^(laporan )?(laba rugi|laba/rugi|profit (&|and) loss|profit and loss statement|income statement|statement of profit or loss)$",
    r"^(laporan )?(arus kas|cash ?flows?|statement of cash flows?)$",
]
LOOSE_TITLES = [r"\b(laba rugi|profit\s*(&|and)?\s*loss|income statement)\b", r"\b(arus kas|cash ?flows?)\b"]
REPORT_WORD, LEDGER_WORD, BALANCE_WORD = r"\b(report|laporan|statement)\b", r"(ledger|buku besar|\bakun\b|accounts?\b|ikhtisar|mutasi)", r"\b(balance|neraca|posisi keuangan)\b"
CODE = r"^(?=[^ ]*\d)[0-9A-Za-z][0-9A-Za-z.\-_/]*$|^\d+-[0-9A-Za-z\-_. ]+$|^\d+(?: \d+)+$"
PERIOD = r"^\d{1,2}[/.-]\d{1,2}[/.-]\d{4}$|^\d{4}-\d{2}-\d{2}|^(?:\d{1,2}\s+)?(?:jan|feb|peb|mar|apr|mei|may|jun|jul|agu|agt|aug|sep|okt|oct|nov|nop|des|dec)[a-z]{0,6}\.?[\s/-]+(?:\d{2}|\d{4})$"
FIRST_ROWS, TITLE_ROWS, CODE_ROWS = 30, 8, 40


def normal_header(text: Column) -> Column:
    """Lower case, without what stands in brackets, letters and digits with one blank between."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"\(.*?\)", " "), r"[^\p{L}\p{N}]+", " ")
    return F.trim(plain)


def alignment_distance(a: Column, b: Column) -> Column:
    """Insertions, deletions, substitutions and swaps of neighbours that turn ``a`` into ``b``, no part edited twice.

    The rows of the usual table, each from the two before it."""
    # split gives one empty part for an empty text
    columns = F.when(F.length(b) > 0, F.sequence(F.lit(1), F.length(b))).otherwise(F.array().cast("array<int>"))
    lines = F.when(F.length(a) > 0, F.sequence(F.lit(1), F.length(a))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.concat(F.array(F.lit(0)), columns).alias("last"), F.array().cast("array<int>").alias("before"))

    def line(x, y, state, i):
        def cell(row, j):
            same = F.get(x, i - 1) == F.get(y, j - 1)
            steps = F.least(F.get(row, j - 1) + 1, F.get(state["last"], j) + 1, F.get(state["last"], j - 1) + F.when(same, 0).otherwise(1))
            swap = (i > 1) & (j > 1) & (F.get(x, i - 1) == F.get(y, j - 2)) & (F.get(x, i - 2) == F.get(y, j - 1))
            return F.concat(row, F.array(F.when(swap, F.least(steps, F.get(state["before"], j - 2) + 1)).otherwise(steps)))

        return F.struct(F.aggregate(columns, F.array(i), cell).alias("last"), state["last"].alias("before"))

    # both texts are split once and not for each cell
    split = F.array(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y")))
    return F.get(F.transform(split, lambda s: F.element_at(F.aggregate(lines, start, lambda state, i: line(s["x"], s["y"], state, i))["last"], -1)), F.lit(0))


def _shortened(texts: Column) -> Column:
    """All that is left of texts if one letter is taken out."""
    return F.flatten(F.transform(texts, lambda t: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))).otherwise(F.array().cast("array<string>"))))


def slips(word: Column) -> Column:
    """The slips that a word may have: two from nine letters on, one from five, none in shorter ones."""
    letters = F.length(F.replace(word, F.lit(" "), F.lit("")))
    return F.when(letters >= 9, 2).when(letters >= 5, 1).otherwise(0)


def nearest_words(headers: DataFrame, words: DataFrame) -> DataFrame:
    """Header, key, word, distance of the headers that are near a known word: the nearest within its slips, if no word of another
    key is as near.

    ``headers``: header. ``words``: key, word. Two texts within two slips have something in common once up to two letters are
    taken out of each, so candidates meet in an equality join of what is left, and only they are compared. Texts with over two letters that no word has
    can't be near one."""
    words = words.select("key", "word", slips(F.col("word")).alias("_most")).distinct()
    known = words.withColumn("_one", _shortened(F.array("word")))
    left = F.when(F.col("_most") == 2, F.concat(F.array("word"), F.col("_one"), _shortened(F.col("_one")))).when(F.col("_most") == 1, F.concat(F.array("word"), F.col("_one"))).otherwise(F.array("word"))
    known = known.select("key", "word", "_most", F.explode(F.array_distinct(left)).alias("_left"))
    spelt = words.agg(F.max(F.length("word")).alias("longest"), F.concat_ws("", F.collect_list("word")).alias("letters")).first()  # a fixed list
    texts = headers.select("header").distinct().withColumn("_text", normal_header(F.col("header"))).filter("_text <> ''")
    plain = texts.select("_text").distinct().filter(F.length("_text") <= (spelt.longest or 0) + 2)
    # a letter that no word has costs a slip
    plain = plain.filter(F.length(F.translate("_text", spelt.letters, "")) <= 2)
    plain = plain.withColumn("_one", _shortened(F.array("_text")))
    plain = plain.select("_text", F.explode(F.array_distinct(F.concat(F.array("_text"), F.col("_one"), _shortened(F.col("_one"))))).alias("_left"))
    met = plain.join(known, "_left").select("_text", "key", "word", "_most").distinct()
    met = met.filter(F.abs(F.length("_text") - F.length("word")) <= F.col("_most")).withColumn("distance", alignment_distance(F.col("_text"), F.col("word"))).filter("distance <= _most")
    best = met.groupBy("_text", "distance").agg(F.count_distinct("key").alias("_keys"), F.min("key").alias("key"), F.min("word").alias("word"))
    best = best.groupBy("_text").agg(F.min(F.struct("distance", "_keys", "key", "word")).alias("_best")).select("_text", "_best.*").filter("_keys = 1")
    return texts.join(best, "_text").select("header", "key", "word", "distance")


def known_words(spark) -> DataFrame:
    return spark.createDataFrame([(k, w) for k, ws in WORDS.items() for w in ws], "key string, word string")


def _is_title(t: Column, n: Column) -> Column:
    """Whether a row whose first text is ``t`` and that has ``n`` cells calls its sheet another report."""
    has = lambda p: t.rlike(f"(?i){p}")
    any_of = lambda patterns: F.greatest(*[has(p) for p in patterns])
    return any_of(TITLES) | ((F.length(t) <= 60) & (n <= 3) & has(REPORT_WORD) & ~has(LEDGER_WORD) & ~has(BALANCE_WORD) & any_of(LOOSE_TITLES))


def report_titles(cells: DataFrame) -> DataFrame:
    """The sheets whose first rows call themselves an income or cash-flow statement: sheet."""
    rows = cells.filter((F.col("row_no") < TITLE_ROWS) & (F.trim("text") != "")).groupBy("sheet", "row_no").agg(F.min_by(F.trim("text"), "column").alias("t"), F.count("*").alias("n"))
    return rows.filter(_is_title(F.col("t"), F.col("n"))).select("sheet").distinct()


def first_tables(cells: DataFrame) -> DataFrame:
    """Each sheet's first table: sheet, header_row, mode, columns (key to column), typos, data_rows.

    ``cells``: sheet, row_no, column (both from 0), text; empty cells may be left out. A row in the first FIRST_ROWS is a header
    of a LEDGER if it has a date, an account and both sides, and of a BALANCE without a date, with an account and an amount or both sides; rows with
    text must follow. A cell takes the first column of its patterns that no cell before it has, else
    the amount if it is a period (or says Value beside a level), else the column of the nearest word. Where the name column of a balance
    holds codes and a description follows, they are code and name. Sheets that are other reports are left out.

    Cells are dealt by sheet once and all else is windows and sums within it; only texts near a known word are joined."""
    text = F.regexp_replace(F.trim("text"), r"\s+", " ")
    cells = cells.select("sheet", "row_no", "column", text.alias("text")).filter("text <> '' and sheet is not null and row_no is not null")
    exact_of = lambda t: F.filter(F.array(*[F.when(t.rlike(f"(?i){p}"), F.lit(k)) for k, p in PATTERNS.items()]), lambda k: k.isNotNull())
    asked = cells.filter(F.col("row_no") < FIRST_ROWS).select(F.col("text").alias("header")).distinct()
    near = nearest_words(asked, known_words(cells.sparkSession)).select(F.col("header").alias("text"), F.col("key").alias("near"))
    cells = cells.join(near, "text", "left").repartition("sheet")
    early = F.col("row_no") < FIRST_ROWS
    exact = F.when(early, exact_of(F.col("text"))).otherwise(F.array().cast("array<string>"))
    amount = early & F.lower("text").rlike(PERIOD)
    cell = F.struct("column", "text", exact.alias("exact"), amount.alias("amount"), "near")
    cell = F.when(early, cell).otherwise(F.struct("column", "text", F.array().cast("array<string>").alias("exact"), F.lit(False).alias("amount"), F.lit(None).cast("string").alias("near")))
    rows = cells.groupBy("sheet", "row_no").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    beside = F.exists("cells", lambda c: F.array_contains(c["exact"], "level"))
    valued = F.transform("cells", lambda c: c.withField("amount", c["amount"] | (F.lower(c["text"]) == "value")))
    rows = rows.withColumn("cells", F.when(early & beside, valued).otherwise(F.col("cells")))

    def taken(columns, c):
        free = lambda k: ~F.coalesce(F.map_contains_key(columns, k), F.lit(False))
        open_ = F.filter(c["exact"], free)
        key = F.when(F.size(open_) > 0, F.get(open_, F.lit(0))).when(c["amount"] & free(F.lit("amount")), F.lit("amount")).when((F.size(c["exact"]) == 0) & c["near"].isNotNull() & free(c["near"]), c["near"])
        return F.when(key.isNull(), columns).otherwise(F.map_concat(columns, F.create_map(F.coalesce(key, F.lit("")), c["column"])))

    rows = rows.withColumn("columns", F.when(early, F.aggregate("cells", F.create_map().cast("map<string,int>"), taken)))
    at = lambda k: F.try_element_at("columns", F.lit(k))
    account, sides = at("code").isNotNull() | at("name").isNotNull(), at("debit").isNotNull() & at("credit").isNotNull()
    mode = F.when(at("date").isNotNull() & account & sides, "LEDGER").when(at("date").isNull() & account & (at("amount").isNotNull() | sides), "BALANCE")
    sheet = Window.partitionBy("sheet")
    rows = rows.withColumn("mode", mode).withColumn("data_rows", F.count("*").over(sheet.orderBy(F.desc("row_no")).rowsBetween(Window.unboundedPreceding, -1)))
    # the first header, and the name column of a balance that has no codes but a description
    named = F.when((F.col("mode") == "BALANCE") & at("code").isNull() & at("desc").isNotNull(), at("name"))
    rows = rows.withColumn("_head", F.min(F.when(F.col("mode").isNotNull() & (F.col("data_rows") > 0), F.struct("row_no", named.alias("name")))).over(sheet))
    header_row = F.col("_head.row_no")
    below = (F.col("row_no") > header_row) & (F.col("row_no") <= header_row + CODE_ROWS)
    held = F.when(below, F.filter("cells", lambda c: c["column"] == F.col("_head.name")))
    title = (F.col("row_no") < TITLE_ROWS) & _is_title(F.get("cells", F.lit(0))["text"], F.size("cells"))
    head = F.when(F.col("row_no") == header_row, F.struct(F.col("row_no").alias("header_row"), "mode", "columns", "cells", "data_rows"))
    found = rows.groupBy("sheet").agg(
        F.first(head, ignorenulls=True).alias("_found"), F.max(title).alias("_title"),
        F.sum(F.array_size(held)).alias("_n"), F.sum(F.array_size(F.filter(held, lambda c: c["text"].rlike(CODE)))).alias("_k"),
    ).filter("_found is not null and not _title").select("sheet", "_found.*", F.coalesce((F.col("_n") >= 3) & (F.col("_k") >= F.col("_n") * 0.6), F.lit(False)).alias("_coded"))
    typo = F.filter("cells", lambda c: (F.size(c["exact"]) == 0) & ~c["amount"] & c["near"].isNotNull() & (F.try_element_at("columns", F.coalesce(c["near"], F.lit(""))) == c["column"]))
    typos = F.transform(typo, lambda c: F.struct(c["column"].alias("column"), c["near"].alias("key"), c["text"].alias("header")))
    moved = F.map_concat(F.map_filter("columns", lambda k, v: ~k.isin("name", "desc")), F.create_map(F.lit("code"), at("name"), F.lit("name"), at("desc")))
    return found.select("sheet", "header_row", "mode", F.when(F.col("_coded"), moved).otherwise(F.col("columns")).alias("columns"), typos.alias("typos"), "data_rows")
