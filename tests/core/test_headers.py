"""Headers with slips against a plain table of distances, and tables of small sheets."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import headers


def distance(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def slip(rng, word):
    i = rng.randrange(len(word))
    kind = rng.randrange(4)
    return [word[:i] + word[i + 1 :], word[:i] + "q" + word[i:], word[:i] + "x" + word[i + 1 :], word[:i] + word[i + 1 : i + 2] + word[i : i + 1] + word[i + 2 :]][kind]


def test_distances_match_a_plain_table(spark):
    rng = random.Random(2)
    pairs = [("", ""), ("", "ab"), ("ca", "abc"), ("ab", "ba"), ("a", "a")] + [("".join(rng.choices("abc", k=rng.randrange(7))), "".join(rng.choices("abc", k=rng.randrange(7)))) for _ in range(300)]
    got = spark.createDataFrame(pairs, "a string, b string").withColumn("d", headers.alignment_distance(F.col("a"), F.col("b"))).collect()
    assert all(r.d == distance(r.a, r.b) for r in got)


def test_nearest_words_match_all_pairs(spark):
    rng = random.Random(4)
    words = [(k, w) for k, ws in headers.WORDS.items() for w in ws]
    texts = {w for _, w in words} | {"Debit (Rp)", "debik", "dbeit", "akun", "kode", "Kredti", "credet", "", "?!", "saldo  AKHIR", "Mata-Uang", "x" * 60}
    for _, w in words:
        for _ in range(6):
            one = slip(rng, w)
            texts |= {one, slip(rng, one or "a"), slip(rng, slip(rng, one or "a") or "a").upper()}
    most = lambda w: 2 if len(w.replace(" ", "")) >= 9 else 1 if len(w.replace(" ", "")) >= 5 else 0
    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in __import__("re").sub(r"\(.*?\)", " ", t.lower())).split())
    want = {}
    for t in texts:
        near = sorted((distance(plain(t), w), k) for k, w in words if plain(t) and distance(plain(t), w) <= most(w))
        if near and len({k for d, k in near if d == near[0][0]}) == 1:
            want[t] = (near[0][1], near[0][0])
    rows = spark.createDataFrame([(t,) for t in texts] * 2, "header string")
    got = {r.header: (r.key, r.distance) for r in headers.nearest_words(rows, headers.known_words(spark)).collect()}
    assert got == want and {d for _, d in want.values()} == {0, 1, 2}
    short = spark.createDataFrame([("Date",), ("Dat",), ("Kdoe",)], "header string")
    assert headers.nearest_words(short, spark.createDataFrame([("date", "date"), ("code", "kode")], "key string, word string")).collect()[0].header == "Date"


def test_first_tables(spark):
    sheets = {
        "ledger": [["PT Maju"], [], ["Tanggall", "Kode Akun", "Nama  Akun", "Keterangan", "Debit (Rp)", "Kredti"], ["2024-01-05", "1-100", "Kas", "x", "5", "0"]],
        "balance": [["Neraca"], ["Nama Akun", "31/12/2024"], ["Kas", "5"], ["Utang", "-5"]],
        "months": [["Kode", "Perkiraan", "Jan 2024", "Feb 2024"], ["1", "Kas", "1", "2"]],
        "codes": [["Account", "Description", "Balance"], ["1-1000", "Kas", "5"], ["1-1100", "Bank", "5"], ["2-1000", "Utang", "7"], ["Total", "", "9"]],
        "few codes": [["Account", "Description", "Balance"], ["Kas", "tunai", "5"], ["1-1100", "Bank", "5"], ["Utang", "usaha", "7"]],
        "level": [["Level", "Account", "Value"], ["1", "Kas", "5"]],
        "value alone": [["Account", "Value"], ["Kas", "5"]],
        "income": [["PT Maju"], ["Laporan Laba Rugi"], ["Nama Akun", "Jumlah"], ["Penjualan", "5"]],
        "loose": [["All Branch Profit Loss Report"], ["Account", "Balance"], ["Sales", "5"]],
        "named": [["Buku Besar Akun Laba Rugi Report"], ["Account", "Balance"], ["Sales", "5"]],
        "no rows": [["Nama Akun", "Jumlah"], ["", " "]],
        "deep": [["x"]] * 30 + [["Nama Akun", "Jumlah"], ["Kas", "5"]],
    }
    cells = [(s, r, c, t) for s, rows in sheets.items() for r, row in enumerate(rows) for c, t in enumerate(row)]
    got = {r.sheet: r for r in headers.first_tables(spark.createDataFrame(cells, "sheet string, row_no int, column int, text string")).collect()}
    read = {s: (r.header_row, r.mode, dict(r["columns"])) for s, r in got.items()}
    assert read == {
        "ledger": (2, "LEDGER", {"date": 0, "code": 1, "name": 2, "desc": 3, "debit": 4, "credit": 5}),
        "balance": (1, "BALANCE", {"name": 0, "amount": 1}),
        "months": (0, "BALANCE", {"code": 0, "name": 1, "amount": 2}),
        "codes": (0, "BALANCE", {"code": 0, "name": 1, "amount": 2}),
        "few codes": (0, "BALANCE", {"name": 0, "desc": 1, "amount": 2}),
        "level": (0, "BALANCE", {"level": 0, "name": 1, "amount": 2}),
        "named": (1, "BALANCE", {"name": 0, "amount": 1}),
    }
    assert [(t.column, t.key, t.header) for t in got["ledger"].typos] == [(0, "date", "Tanggall"), (5, "credit", "Kredti")]
    assert got["codes"].data_rows == 4 and got["ledger"].data_rows == 1


def test_first_tables_join_words_alone(spark):
    """Sheets are dealt once: no join, and so no broadcast, grows with their number."""
    cells = spark.createDataFrame([("a", 0, 0, "Nama Akun"), ("a", 0, 1, "Jumlah"), ("a", 1, 0, "Kas")], "sheet string, row_no int, column int, text string")
    plan = headers.first_tables(cells)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and not [j for j in joins if "sheet#" in j]
