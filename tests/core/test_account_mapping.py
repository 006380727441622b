"""Mapping of accounts against plain loops over the rules, and cases worked out by hand."""

import random
import re

from ledgerloom.operators import account_mapping as m

WORDS = "beban biaya bank kas bca utang piutang sewa pajak pph 21 23 final tangguhan income sales cost of modal kerja prepaid tax deferred benefit akumulasi penyusutan right use hak guna kasé ébank other umum long term loan to payable qris mesin deposit".split()
CHART = [("1101", "House bank", "CURRENT_ASSET", "bank"), ("1110", "Kas", "CURRENT_ASSET", ""), ("1120", "Tills", "CURRENT_ASSET", ""), ("1140", "Claims", "CURRENT_ASSET", ""), ("1170", "Ahead", "CURRENT_ASSET", ""),
         ("1260", "Far", "FIXED_ASSET", ""), ("2120", "Owed", "CURRENT_LIABILITY", ""), ("2145", "Taxes", "CURRENT_LIABILITY", ""), ("2300", "Long", "LONG_TERM_LIABILITY", ""), ("3100", "Modal", "EQUITY", ""),
         ("1999", "Open", "CURRENT_ASSET", "suspense"), ("6190", "Costs", "RESULT", ""), ("6191", "Kas", "RESULT", ""), ("4110", "Services", "RESULT", "")]
FLAGS = "client_id int, code string, name string, section string, is_bank boolean, is_suspense boolean, is_clearing boolean"


def norm(name):
    return " ".join("".join(c if c.isalnum() else " " for c in name.lower()).split())


def holds(pattern, n):
    return re.search(pattern, n, re.ASCII)


def strong(n):
    return next((k for p, k, but in m.STRONG if holds(p, n) and not (but and holds(but, n))), None)


def digit(code):
    found = re.search("[0-9]", re.sub("^[A-Za-z]+-", "", code))
    return found and found.group()


def kind(code, n, scheme):
    return strong(n) or scheme.get(digit(code)) or next((k for p, k in m.WEAK if holds(p, n)), None) or m.DIGITS.get(digit(code))


def frame(spark, client, rows=CHART):
    return [(client, c, n, s, f == "bank", f == "suspense", f == "clearing") for c, n, s, f in rows]


def suggestion(code, name, hint, term, chart, prior):
    n = norm(name)
    usable = sorted(c for c in chart if not c[3])
    sections = {c: s for c, _, s, _ in usable}
    if n in prior:
        return prior[n], "PRIOR"
    for c, other, _, _ in usable:
        if norm(other) == n:
            return c, "NAME"
    t = hint or kind(code, n, {})
    hit = None
    for r in m.RULES:
        if not holds(r.pattern, n) or (r.but and holds(r.but, n)):
            continue
        if r.types and ((t != r.types) if t else r.strict):
            continue
        if r.code not in sections and not r.template:
            continue
        hit = ("new:" + r.line, "NEW") if r.line and not holds(m.CATCH_ALL, n) else (r.code, "KEYWORD")
        break
    section = sections.get(hit[0]) if hit else None
    to = None
    if t == "LIABILITY" and term == "NON_CURRENT" and section in (None, "CURRENT_LIABILITY"):
        to = "2300"
    elif t == "LIABILITY" and term == "CURRENT" and section == "LONG_TERM_LIABILITY":
        to = "2120"
    elif t == "ASSET" and term == "NON_CURRENT" and section in (None, "CURRENT_ASSET"):
        to = "1260"
    return (to, "TERM") if to in sections else hit or (None, None)


def test_types_match_a_loop(spark):
    rng = random.Random(3)
    rows = [(e, rng.choice(["", "A-", "SKP-UNM-", "x"]) + str(rng.randrange(0, 9999)), " ".join(rng.choices(WORDS, k=rng.randrange(4)))) for e in range(6) for _ in range(60)]
    # books that number their costs with 8, and one with two votes only
    rows += [(7, f"8{i}", "beban") for i in range(4)] + [(7, "85", "sales"), (7, "86", "misteri"), (8, "81", "beban"), (8, "82", "biaya"), (8, "83", "misteri"), (9, "x", "misteri"), (9, "81", "")]
    rows = list(dict.fromkeys(rows))
    got = {(r.entity_id, r.code, r.name): r.type for r in m.account_types(spark.createDataFrame(rows, "entity_id int, code string, name string"), ["entity_id"]).collect()}
    schemes = {}
    for e in {r[0] for r in rows}:
        votes = {}
        for k, c, n in rows:
            if k == e and digit(c) and strong(norm(n)):
                votes.setdefault(digit(c), []).append(strong(norm(n)))
        schemes[e] = {d: max(set(v), key=v.count) for d, v in votes.items() if len(v) >= 3 and max(map(v.count, v)) >= 0.8 * len(v)}
    assert got == {(e, c, n): kind(c, norm(n), schemes[e]) for e, c, n in rows}
    assert got[7, "86", "misteri"] == "EXPENSE" and got[8, "83", "misteri"] is None and got[9, "x", "misteri"] is None


def test_suggestions_match_a_loop(spark):
    rng = random.Random(5)
    rows = []
    for i in range(700):
        name = " ".join(rng.choices(WORDS, k=rng.randrange(1, 5))) if i % 5 else rng.choice(["Kas", "modal", "Ahead", "Owed", "OPEN", "House Bank", "", "--"])
        rows.append((i % 3, i % 4, f"{rng.choice(['', 'B-'])}{rng.randrange(1, 9)}{i:04}", name, rng.choice([None, None, "ASSET", "LIABILITY", "EXPENSE"]), rng.choice([None, "CURRENT", "NON_CURRENT"]), rng.choice([None] * 60 + ["7000"])))
    charts = {0: CHART, 1: CHART[3:9], 2: []}  # the last client has no chart
    prior = {c: {} for c in charts}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        if r[6]:
            prior[r[0]][norm(r[3])] = r[6]
    sources = spark.createDataFrame(rows, "client_id int, entity_id int, code string, name string, type_hint string, term_hint string, account string")
    chart = spark.createDataFrame([x for c, rs in charts.items() for x in frame(spark, c, rs)], FLAGS)
    got = {(r.client_id, r.entity_id, r.code): (r.suggested, r.method) for r in m.suggested_accounts(sources, chart).collect()}
    assert got == {(c, e, k): suggestion(k, n, h, t, charts[c], prior[c]) for c, e, k, n, h, t, a in rows if a is None}
    assert {x for _, x in got.values()} == {None, "PRIOR", "NAME", "KEYWORD", "NEW", "TERM"}


def test_suggestions_by_hand(spark):
    cases = {
        # name, hint, term: suggested, method, confidence, matched
        ("Kas", "ASSET", None): ("1110", "NAME", 95, None),  # 6191 has the name too
        ("Kas toko", None, None): ("1110", "KEYWORD", 80, "kas"),
        ("Kasé", None, None): ("1110", "KEYWORD", 80, "kas"),  # a bound of words knows ASCII only
        ("Open", None, None): (None, None, None, None),  # suspense is not suggested by its name
        ("Bank BCA", "ASSET", "NON_CURRENT"): ("1260", "TERM", 75, None),
        ("Utang Direksi", None, None): ("new:UTANG_LAIN", "NEW", 70, "utang"),
        ("Utang Direksi II", None, "NON_CURRENT"): ("2300", "TERM", 75, None),
        ("Utang lain-lain", None, None): ("2120", "KEYWORD", 80, "utang"),
        ("Pinjaman", "LIABILITY", "CURRENT"): ("2120", "TERM", 75, None),
        ("Deferred tax benefit", None, None): ("8110", "KEYWORD", 80, ""),  # of the template
        ("Pajak tangguhan", "LIABILITY", None): ("2320", "KEYWORD", 80, "pajak tangguhan"),
        ("Bahan baku", None, None): (None, None, None, None),  # strict, and no type is known
        (None, None, None): (None, None, None, None),
    }
    rows = [(1, 1, f"x{i}", n, h, t, None) for i, (n, h, t) in enumerate(cases)]
    rows = [(c, e, "x", n, h, t, a) for c, e, _, n, h, t, a in rows]
    sources = spark.createDataFrame(rows, "client_id int, entity_id int, code string, name string, type_hint string, term_hint string, account string")
    got = {r.name: (r.suggested, r.method, r.confidence_pct, r.matched) for r in m.suggested_accounts(sources, spark.createDataFrame(frame(spark, 1), FLAGS)).collect()}
    assert got == {n: v for (n, _, _), v in cases.items()}


def test_new_codes_match_a_loop(spark):
    rng = random.Random(8)
    rows = [(i % 2, i, rng.choice(["HPP", "UTANG_PAJAK", "PENDAPATAN_LAIN", "UTANG_PAJAK", "PRIVE"]), rng.choice(["Kas", "house bank", f"Name {rng.randrange(60)}", f"NAME-{rng.randrange(60)}"])) for i in range(300)]
    rows += [(0, 1000 + i, "UTANG_PAJAK", f"Tax {i}") for i in range(1100)]  # more than the line has codes
    chart = {0: [*CHART, ("214501", "Used", "CURRENT_LIABILITY", "clearing"), ("5102", "Used too", "RESULT", "")], 1: CHART}
    reserved = ["2146", "2147"]
    want = {}
    for client, books in chart.items():
        used = {c for c, *_ in books}
        names = {}
        for c, n, _, f in sorted(books):
            if not f:
                names[norm(n)] = c
        for c, at, line, name in rows:
            if c != client:
                continue
            n, made = norm(name), False
            if n not in names:
                first, last = m.RANGES.get(line, (1, 0))
                never = {*m.SPECIAL, *reserved, *used}
                free = [str(x) for x in range(first, last + 1) if str(x) not in never] + [x for x in (f"{first - 1}{i:02}" for i in range(1, 1000)) if x not in used and line in m.RANGES]
                names[n] = free[0] if free else None
                used |= {names[n]}
                made = names[n] is not None
            want[client, at] = (names[n], made)
    accepted = spark.createDataFrame(rows, "client_id int, position int, line string, name string")
    books = spark.createDataFrame([x for c, rs in chart.items() for x in frame(spark, c, rs)], FLAGS)
    got = {(r.client_id, r.position): (r.code, r.created) for r in m.allocated_codes(accepted, books, reserved).collect()}
    assert got == want
    assert any(c is None for c, _ in got.values()) and any(c and len(c) == 7 for c, _ in got.values())


def test_empty_tables(spark):
    sources = spark.createDataFrame([], "client_id int, entity_id int, code string, name string, type_hint string, term_hint string, account string")
    chart = spark.createDataFrame([], FLAGS)
    assert m.suggested_accounts(sources, chart).count() == 0
    assert m.account_types(sources.select("entity_id", "code", "name"), ["entity_id"]).count() == 0
