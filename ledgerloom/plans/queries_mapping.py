"""Account lists of other books, derived from the parts, mapped to their clients' charts."""

import re

from pyspark.sql import functions as F

from ..operators import account_mapping as m
from .catalog import register
from .oracle import values

NAMES = [
    "Accumulated amortisation – right of use", "Depreciation of right of use cars", "Akumulasi Penyusutan Kendaraan", "Penyusutan Bangunan", "Pembulatan", "Realised FX difference",
    "Deferred tax benefit", "Aset Pajak Tangguhan", "Deferred Tax", "Pajak Bunga Deposito", "Pendapatan Bunga", "Beban Bunga Leasing", "Admin Bank", "QRIS", "Low value asset", "Kas Besar",
    "BCA 0001", "Giro Mandiri", "Cadangan Kerugian", "Bad debts written off", "PPN Masukan", "Prepaid tax article 22", "Trade Receivables", "Accounts receivable - staff", "Raw material stock",
    "Aset Biologis", "Bahan Baku", "Pembelian bahan baku", "Uang Muka Pembelian", "Piutang Karyawan", "Piutang Lain-lain", "Right of use office", "Software", "Penyertaan", "Peralatan Dapur",
    "Sewa", "Asuransi", "OVO", "PPN Keluaran", "Hutang PPh 21", "PPh 23", "PPh pasal 29", "Utang Pajak", "Imbalan Kerja", "Accrued wages", "Customer deposit", "Down payment", "Down payment to vendor",
    "Kartu Kredit", "Short term debt", "Pinjaman Jangka Panjang", "Utang Usaha", "Utang Direksi", "Other payable", "Agio Saham", "Modal Saham", "Laba Ditahan", "Prive", "Modal", "Modal Kerja",
    "Pajak Kendaraan", "Beban Pajak", "PPh Final", "Other income", "Gain on sale", "Penjualan", "Jasa Pendapatan", "Pembelian", "Harga Pokok", "Biaya Produksi", "Gaji", "BPJS", "Rent", "Listrik", "Bensin",
    "Iklan", "ATK", "Notaris", "Biaya Rumah", "Biaya Umum", "Misterius", "", "Suspense", "Bank of the client", "Trade receivables", "Équipement – kas",
]
# The chart that clients have: code, name, section, kind.
CHART = [
    ("1101", "Bank of the client", "CURRENT_ASSET", "BANK"), ("1110", "Cash", "CURRENT_ASSET", ""), ("1120", "Deposits at banks", "CURRENT_ASSET", ""), ("1130", "Trade receivables", "CURRENT_ASSET", ""),
    ("1140", "Other receivables", "CURRENT_ASSET", ""), ("1150", "Input tax", "CURRENT_ASSET", ""), ("1160", "Stock", "CURRENT_ASSET", ""), ("1170", "Paid in advance", "CURRENT_ASSET", ""),
    ("1180", "Taxes paid in advance", "CURRENT_ASSET", ""), ("1199", "Clearing", "CURRENT_ASSET", "CLEARING"), ("1210", "Fixed assets", "FIXED_ASSET", ""), ("1219", "Depreciation so far", "FIXED_ASSET", ""),
    ("1250", "Rights", "FIXED_ASSET", ""), ("1260", "Other long-lived assets", "FIXED_ASSET", ""), ("1999", "Suspense", "CURRENT_ASSET", "SUSPENSE"), ("2110", "Trade payables", "CURRENT_LIABILITY", ""),
    ("2120", "Other payables", "CURRENT_LIABILITY", ""), ("2130", "Output tax", "CURRENT_LIABILITY", ""), ("2140", "Wage tax", "CURRENT_LIABILITY", ""), ("2141", "Tax on services", "CURRENT_LIABILITY", ""),
    ("2145", "Other taxes", "CURRENT_LIABILITY", ""), ("2150", "Accruals", "CURRENT_LIABILITY", ""), ("2160", "Received in advance", "CURRENT_LIABILITY", ""), ("2210", "Bank debt", "CURRENT_LIABILITY", ""),
    ("2300", "Long debt", "LONG_TERM_LIABILITY", ""), ("2310", "Benefits", "LONG_TERM_LIABILITY", ""), ("3100", "Capital", "EQUITY", ""), ("3110", "Premium", "EQUITY", ""), ("3200", "Retained", "EQUITY", ""),
    ("3300", "Drawings", "EQUITY", ""), ("4100", "Sales", "RESULT", ""), ("4110", "Services", "RESULT", ""), ("4900", "Interest", "RESULT", ""), ("4910", "Sundry", "RESULT", ""), ("5100", "Purchases", "RESULT", ""),
    ("5110", "Cost", "RESULT", ""), ("6100", "Wages", "RESULT", ""), ("6110", "Insurance of staff", "RESULT", ""), ("6120", "Rent", "RESULT", ""), ("6130", "Power", "RESULT", ""), ("6140", "Travel", "RESULT", ""),
    ("6150", "Advertising", "RESULT", ""), ("6160", "Office", "RESULT", ""), ("6170", "Advice", "RESULT", ""), ("6180", "Depreciation", "RESULT", ""), ("6185", "Losses on debtors", "RESULT", ""), ("6190", "Sundry costs", "RESULT", ""),
    ("7100", "Bank costs", "RESULT", ""), ("7110", "Interest paid", "RESULT", ""), ("7190", "Rounding", "RESULT", ""), ("7200", "Exchange", "RESULT", ""), ("8100", "Tax", "RESULT", ""), ("8200", "Final tax", "RESULT", ""),
]
CODES = [c for c, *_ in CHART]


def listed(b):
    """An account per part: a name of the list, every third with the part's own behind it; the digit of its code fits the
    kind of name for most. Some have a type or a term in their file, some are mapped."""
    k, size = F.col("p_partkey"), len(NAMES)
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (k % size + 1).cast("int"))
    name = F.when(k % 3 == 0, F.concat(name, F.lit(" - "), F.col("p_name"))).otherwise(name)
    return b.read("part").select(
        (k % 5).cast("int").alias("client_id"), (k % 25).cast("int").alias("entity_id"),
        F.concat(F.when(k % 2 == 0, "A-").otherwise(""), (F.expr(f"(p_partkey % {size}) div 14") + 1).cast("string"), F.lpad(k.cast("string"), 8, "0")).alias("code"),
        name.alias("name"),
        F.when(k % 7 == 0, "ASSET").when(k % 7 == 1, "LIABILITY").when(k % 14 == 2, "EXPENSE").alias("type_hint"),
        F.when(k % 9 == 0, "CURRENT").when(k % 9 < 3, "NON_CURRENT").alias("term_hint"),
        F.when(k % 41 == 0, F.element_at(F.array(*[F.lit(c) for c in CODES]), (k % len(CODES) + 1).cast("int"))).alias("account"),
    )


def charts(b):
    """Every client has the chart but for the codes whose number leaves its own when divided by 11."""
    rows = b.spark.createDataFrame(CHART, "code string, name string, section string, kind string")
    flags = [(F.col("kind") == k.upper()).alias(f"is_{k}") for k in ("bank", "suspense", "clearing")]
    clients = b.read("region").select(F.col("r_regionkey").cast("int").alias("client_id"))
    return clients.join(rows, F.col("code").cast("int") % 11 != F.col("client_id")).select("client_id", "code", "name", "section", *flags)


def _holds(pattern):
    """DuckDB knows no lookahead, so what must come anywhere is asked part by part."""
    parts = re.findall(r"\(\?=\.\*(\(.*?\))\)", pattern) or [pattern]
    return " and ".join(f"regexp_matches(n, '{p}')" for p in parts)


def _first(cases):
    return "case " + " ".join(f"when {test} then '{kind}'" for test, kind in cases) + " end"


STRONG = _first([(f"{_holds(p)}{f' and not {_holds(but)}' if but else ''}", k) for p, k, but in m.STRONG])
WEAK = _first([(_holds(p), k) for p, k in m.WEAK])
NORM = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
QUOTED = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
LISTED = f"""
    src as (
        select p_partkey % 5 as client_id, p_partkey % 25 as entity_id,
               case when p_partkey % 2 = 0 then 'A-' else '' end || (p_partkey % {len(NAMES)} // 14 + 1) || lpad(p_partkey::varchar, 8, '0') as code,
               ({QUOTED})[p_partkey % {len(NAMES)} + 1] || case when p_partkey % 3 = 0 then ' - ' || p_name else '' end as name,
               case when p_partkey % 7 = 0 then 'ASSET' when p_partkey % 7 = 1 then 'LIABILITY' when p_partkey % 14 = 2 then 'EXPENSE' end as type_hint,
               case when p_partkey % 9 = 0 then 'CURRENT' when p_partkey % 9 < 3 then 'NON_CURRENT' end as term_hint,
               case when p_partkey % 41 = 0 then ({CODES})[p_partkey % {len(CODES)} + 1] end as account
        from part),
    marked as (select *, {NORM.format('name')} as n, regexp_extract(regexp_replace(code, '^[A-Za-z]+-', ''), '[0-9]', 0) as digit from src),
    strongly as (select *, {STRONG} as strong, {WEAK} as weak, map({list(m.DIGITS)}, {list(m.DIGITS.values())})[digit] as by_digit from marked)"""
CHARTS = f"""
    chart as (
        select r_regionkey as client_id, code, name, section, kind, {NORM.format('name')} as n
        from region, (values {values(CHART)}) t(code, name, section, kind) where code::int % 11 <> r_regionkey),
    usable as (select * from chart where kind = '')"""


@register(
    "c9_account_types",
    f"""with {LISTED},
    votes as (select entity_id, digit, strong, count(*) as c from strongly where strong is not null group by all),
    scheme as (select entity_id, digit, strong as learned from (select *, sum(c) over (partition by entity_id, digit) as total from votes) where total >= 3 and c >= 0.8 * total)
    select s.entity_id, code, name, s.digit, coalesce(strong, learned, weak, by_digit) as type from strongly s left join scheme c on c.entity_id = s.entity_id and c.digit = s.digit""",
)
def types(b):
    return m.account_types(listed(b).select("entity_id", "code", "name"), ["entity_id"])


def _rule(i, r):
    """SQL of one rule: the code it gives, for a row whose name and type fit and whose client has the account."""
    test = f"{_holds(r.pattern)}" + (f" and not {_holds(r.but)}" if r.but else "")
    test += "" if not r.types else f" and coalesce(type = '{r.types}', {str(not r.strict).lower()})"
    test += "" if r.template else f" and list_contains(codes, '{r.code}')"
    return f"when {test} then {i}"


RULES = ", ".join(f"({i}, '{r.code}', {repr(r.line) if r.line else 'null'}, '{'' if '(?=' in r.pattern else r.pattern}')" for i, r in enumerate(m.RULES))


@register(
    "c9_suggested_accounts",
    f"""with {LISTED}, {CHARTS},
    prior as (select client_id, n, arg_max(account, (entity_id, code)) as prior from strongly where account is not null group by all),
    same as (select client_id, n, min(code) as exact from usable group by all),
    held as (select client_id, list(code) as codes from usable group by 1),
    rules(i, rule_code, line, pattern) as (values {RULES}),
    open as (select s.*, coalesce(type_hint, strong, weak, by_digit) as type, codes from strongly s join held using (client_id) where account is null),
    hit as (select *, case {' '.join(_rule(i, r) for i, r in enumerate(m.RULES))} end as i from open),
    lined as (
        select h.*, rule_code, pattern, case when not regexp_matches(n, '{m.CATCH_ALL}') then line end as line from hit h left join rules r on r.i = h.i),
    placed as (
        select l.*, coalesce('new:' || line, rule_code) as guess, u.section from lined l left join usable u on u.client_id = l.client_id and line is null and u.code = rule_code),
    sided as (
        select *, case when type = 'LIABILITY' and term_hint = 'NON_CURRENT' and coalesce(section, 'CURRENT_LIABILITY') = 'CURRENT_LIABILITY' then '2300'
                       when type = 'LIABILITY' and term_hint = 'CURRENT' and section = 'LONG_TERM_LIABILITY' then '2120'
                       when type = 'ASSET' and term_hint = 'NON_CURRENT' and coalesce(section, 'CURRENT_ASSET') = 'CURRENT_ASSET' then '1260' end as moved from placed),
    final as (
        select p.*, prior, exact, case when list_contains(codes, moved) then moved end as side from sided p
        left join prior using (client_id, n) left join same using (client_id, n))
    select client_id, entity_id, code, name, coalesce(prior, exact, side, guess) as suggested,
           case when prior is not null then 'PRIOR' when exact is not null then 'NAME' when side is not null then 'TERM' when line is not null then 'NEW' when guess is not null then 'KEYWORD' end as method,
           case when prior is not null or exact is not null then 95 when side is not null then 75 when line is not null then 70 when guess is not null then 80 end as confidence_pct,
           case when prior is null and exact is null and side is null and guess is not null then regexp_extract(n, pattern, 0) end as matched
    from final""",
)
def suggestions(b):
    return m.suggested_accounts(listed(b), charts(b))


LINES = list(m.RANGES)
FREE = ", ".join(f"('{k}', {m.free_codes(k, CODES)})" for k in LINES)


@register(
    "c9_new_accounts",
    f"""with {LISTED}, {CHARTS},
    x as (select client_id, code::varchar as position, ({LINES})[p % {len(LINES)} + 1] as line, name, n from (select *, right(code, 8)::bigint as p from strongly)),
    olds as (select client_id, n, max(code) as old from usable group by all),
    fresh as (select client_id, n, min(position) as position, arg_min(line, position) as line from x where not exists (from olds o where o.client_id = x.client_id and o.n = x.n) group by all),
    ranked as (select *, row_number() over (partition by client_id, line order by position) as place from fresh),
    lists(line, free) as (values {FREE}),
    left_over as (select c.client_id, line, list_filter(free, lambda f: not list_contains(used, f)) as free from lists, (select client_id, list(code) as used from chart group by 1) c),
    dealt as (select r.*, l.free[place] as code from ranked r join left_over l using (client_id, line))
    select x.client_id, x.position, name, coalesce(old, d.code) as code, d.code is not null and x.position = d.position as created
    from x left join olds o on o.client_id = x.client_id and o.n = x.n left join dealt d on d.client_id = x.client_id and d.n = x.n""",
)
def new_accounts(b):
    """Every account is accepted as a new one, on the lines in turn."""
    at = (F.substring("code", -8, 8).cast("long") % len(LINES)).cast("int")
    accepted = listed(b).select("client_id", F.col("code").alias("position"), F.get(F.array(*[F.lit(k) for k in LINES]), at).alias("line"), "name")
    return m.allocated_codes(accepted, charts(b), CODES)
