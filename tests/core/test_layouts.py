"""Separators and orders of days and months, against plain loops."""

import random
import re

from pyspark.sql import functions as F

from ledgerloom.sources import statements as s


def separator(lines):
    best, most = ",", 0
    for d in "\t;,":
        counts = []
        for line in [x for x in lines if x.strip(" ")][:12]:
            quoted, n = False, 0
            for ch in line:
                quoted ^= ch == '"'
                n += ch == d and not quoted
            counts.append(n)
        seen = {c: counts.count(c) for c in counts if c}
        if seen:
            mode = max(seen, key=lambda c: (seen[c], c))
            if mode * seen[mode] > most:
                best, most = d, mode * seen[mode]
    return best


def test_delimiters_match_a_loop(spark):
    rng = random.Random(6)
    files = [["".join(rng.choices('ab,;\t" ', k=rng.randrange(14))) for _ in range(rng.randrange(16))] for _ in range(400)]
    files += [[], [""], ["a"], ["Title, of a, file, x", "a;b", "c;d", "e;f"], ['"x;y;z";1,5', "b;2,5"], ["1,5;2", "1,5;3"], ["a\tb", "c;d", "e,f"]]
    got = spark.createDataFrame(list(enumerate(files)), "k int, lines array<string>").select("k", s.delimiter(F.col("lines")).alias("d")).collect()
    assert {r.k: r.d for r in got} == {k: separator(f) for k, f in enumerate(files)}


def order(texts):
    numeric = [t.lstrip("'") for t in texts if re.match(r"^'?\d{1,2}[/.-]\d{1,2}([/.-](\d{4}|\d{2}))?( \d\d:\d\d)?$", t)]
    parts = [re.match(r"(\d+)\D(\d+)(?:\D(\d{4}|\d{2})(?!\d|:))?", t).groups() for t in numeric]
    parts = [(int(a), int(b), int(y or 0) + (2000 if y and len(y) == 2 else 0)) for a, b, y in parts]
    day = next((t for t, (a, b, _) in zip(numeric, parts) if 12 < a <= 31 and 1 <= b <= 12), None)
    month = next((t for t, (a, b, _) in zip(numeric, parts) if 12 < b <= 31 and 1 <= a <= 12), None)
    if not numeric:
        return None

    def runs(keys):
        return keys == sorted(keys) or keys == sorted(keys, reverse=True)

    dmy = [y * 10_000 + b * 100 + a for a, b, y in parts if 1 <= b <= 12 and 1 <= a <= 31]
    mdy = [y * 10_000 + a * 100 + b for a, b, y in parts if 1 <= a <= 12 and 1 <= b <= 31]
    name = "MIXED" if day and month else "DMY" if day else "MDY" if month else "DMY" if runs(dmy) else "MDY" if runs(mdy) else "UNKNOWN"
    return name, day, month, len(numeric)


def test_date_orders_match_a_loop(spark):
    rng = random.Random(9)
    files = {}
    for k in range(300):
        high = rng.choice([12, 12, 12, 14, 33])
        files[k] = [f"{rng.choice(['', chr(39)])}{rng.randrange(0, high)}{rng.choice('/.-')}{rng.randrange(0, 13)}{rng.choice(['', '/24', '/2024'])}{rng.choice(['', ' 09:30'])}" for _ in range(rng.randrange(1, 5))]
        files[k] = [t for t in files[k] if not re.search(r"\d-\d+/24 ", t)] + rng.choice([[], ["Total", "2024-01-31", "", "1/2/3"]])
    files |= {1000: ["01/02/2024", "01/05/2024", "02/03/2024"], 1001: ["02/03/2024", "01/05/2024", "01/02/2024"], 1002: ["03/02/2024", "01/05/2024", "02/01/2024", "01/01/2024"], 1003: ["13/02/2024", "02/13/2024"], 1004: ["1 May 2024"]}
    rows = [(k, n, t) for k, ts in files.items() for n, t in enumerate(ts)]
    got = {r.file: (r.order, r.day_first, r.month_first, r.n) for r in s.date_orders(spark.createDataFrame([*rows, (2000, 0, None)], "file int, row_number int, date_text string")).collect()}
    assert got == {k: order(ts) for k, ts in files.items() if order(ts)}
    assert [got[k][0] for k in (1000, 1001, 1002, 1003)] == ["MDY", "MDY", "UNKNOWN", "MIXED"] and 1004 not in got
