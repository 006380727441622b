"""Accounts of other books mapped to a client's chart: types from names and codes, suggestions, and codes of new accounts."""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that leave no doubt about an account's type, asked in this order (pattern, type, unless).
STRONG = [
    (r"(akumulasi|accumulat).*(penyusutan|depreciation|amortis|amortiz|deplesi|depletion)", "ASSET", None),
    (r"(expense|beban|biaya|cost of|cogs|hpp|harga pokok|\bloss\b|manfaat pajak|bank charges?|bank fees?|admin(istrasi)? bank|provisi|materai|stamp duty)", "EXPENSE", r"(prepaid|dibayar di ?muka|accrued|accured|payable|\butang\b|\bhutang\b|unearned|diterima di ?muka|deferred|ditangguhkan)"),
    (r"(depreciation|penyusutan|amortisasi|amortization|amortisation)", "EXPENSE", r"(accumulated|akumulasi|accumulat)"),
    (r"(payable|\butang\b|\bhutang\b|accrued|accured|masih harus|liabilit|kewajiban|long term|jangka panjang|non ?bank|\bloan\b|pinjaman|diterima di ?muka|unearned|customer deposits?|deposit pelanggan|uang muka pelanggan)", "LIABILITY", r"(loan to|piutang|receivable)"),
    (r"(receivable|piutang|loan to|placement|penempatan|investment|investasi|tax asset|dibayar di ?muka|prepaid|advance|uang muka)", "ASSET", None),
    (r"(revenue|income|pendapatan|penjualan|\bsales\b|\bgain\b)", "INCOME", r"(payable|receivable|tax payable|diterima di ?muka|unearned|deferred|article|pasal|\bpph\b|prepaid)"),
    (r"(\bsewa\b|\brent(al)?\b|\bhonor|\bgaji\b|\bupah\b|salar|\bwages\b)", "EXPENSE", r"(prepaid|dibayar di ?muka|advance|uang muka|deposit|guarantee|jaminan|receivable|piutang|accrued|accured|payable|\butang\b|\bhutang\b|pembiayaan|liabilit|hak guna|right of use|akumulasi|accumulat|depreciation|penyusutan|amorti)"),
    (r"(capital|modal|saham|shares?|agio|premium|retained|laba ditahan|saldo laba|earnings|dividen|prive)", "EQUITY", None),
]
# Words that decide after the code scheme.
WEAK = [
    (r"(akumulasi|accumulat|allowance|penyisihan)", "ASSET"),
    (r"(\bkas\b|\bcash\b|\bbank\b|inventory|persediaan|goods|asset|aset|equipment|peralatan|deposit|guarantee|jaminan)", "ASSET"),
]
# Types by leading digit of a code.
DIGITS = {"1": "ASSET", "2": "LIABILITY", "3": "EQUITY", "4": "INCOME", "5": "EXPENSE", "6": "EXPENSE"}
# Names that hold anything.
CATCH_ALL = r"(lain ?lain|lainnya|\bother\b|others|misc|sundry|\bumum\b|general|serba ?serbi)"

#: A rule: a name that holds the pattern and not ``but``, of a type among ``types`` (or of none, unless ``strict``),
#: is the account ``code``; a ``line`` makes it a new account there; a ``template`` account needn't be in the chart.
Rule = namedtuple("Rule", "pattern code types but line template strict", defaults=(None, None, None, False, False))

# The rules, the first that holds decides.
RULES = [
    Rule(r"((akumulasi|accumulated|accumulation).*(right of use|hak guna|\brou\b))|((right of use|hak guna|\brou\b).*(akumulasi|accumulated|accumulation))", "1239", template=True),
    Rule(r"(penyusutan|depreciation|amorti[sz]ation|amortisasi).*(right of use|hak guna|\brou\b)", "6181", "EXPENSE", template=True),
    Rule(r"(akumulasi|accumulated|accumulation).*(penyusutan|depreciation|amortization|amortisasi)", "1219"),
    Rule(r"(penyusutan|depreciation|amortisasi|amortization)", "6180", "EXPENSE"),
    Rule(r"(rounding|pembulatan)", "7190"),
    Rule(r"(selisih kurs|foreign exchange|exchange (gain|loss)|forex|\bfx\b|revaluation|revaluasi)", "7200"),
    Rule(r"^(?=.*(pajak tangguhan|deferred tax))(?=.*(laba rugi|penghasilan|manfaat|benefit|income|expense|beban))", "8110", template=True),
    Rule(r"(pajak tangguhan|deferred tax)", "1270", "ASSET", template=True),
    Rule(r"(pajak tangguhan|deferred tax)", "2320", "LIABILITY", template=True),
    Rule(r"(pajak tangguhan|deferred tax)", "8110", "EXPENSE", template=True),
    Rule(r"(tax.*interest|pajak bunga|interest tax)", "8200", "EXPENSE"),
    Rule(r"(interest income|pendapatan bunga|jasa giro|bank interest|bunga bank|bunga tabungan|revenue interest|interest revenue)", "4900", "INCOME"),
    Rule(r"(interest expense|beban bunga|bunga pinjaman|interest p2p)", "7110", "EXPENSE"),
    Rule(r"(bank charge|admin(istrasi)? bank|biaya bank|bank administration|bank admin|provisi|biaya transfer)", "7100", "EXPENSE"),
    Rule(r"(\b(qris|edc|mdr)\b|merchant discount|payment gateway|gateway fee|biaya gateway|\b(xendit|midtrans|doku|flip|ipaymu)\b.*(fee|admin|biaya|charge))", "7100", "EXPENSE", strict=True),
    Rule(r"(low value asset|aset (ber)?nilai rendah|inventaris kecil|barang modal kecil)", "6160", "EXPENSE", strict=True),
    Rule(r"(petty cash|kas kecil|cash in transit|\bkas\b|cash on hand)", "1110", "ASSET", r"bank"),
    Rule(r"\b(bank|giro|tabungan|deposito|time deposits?|call a ?c|ocbc|bca|bri|bni|mandiri|cimb|dbs|uob|citibank|permata|bjb|bsi|btn|maybank|panin|danamon|doku|flip|xendit|midtrans)\b", "1120", "ASSET", r"(non ?bank|payable|utang|hutang|loan|pinjaman)"),
    Rule(r"(allowance|penyisihan|cadangan kerugian|\becl\b|ckpn)", "1135", "ASSET", template=True),
    Rule(r"(bad debts?|doubtful|piutang tak tertagih|ckpn|\becl\b|(penyisihan|cadangan|penurunan nilai|impairment).*(piutang|receivable))", "6185", "EXPENSE"),
    Rule(r"(ppn masukan|vat[- ]?in\b|input vat)", "1150", "ASSET"),
    Rule(r"(prepaid.*(tax|pajak|\bpph\b|article|pasal)|pajak dibayar di ?muka|uang muka pajak|pph .*dibayar di ?muka|tax receivable)", "1180", "ASSET"),
    Rule(r"(trade receivable|piutang usaha|accounts? receivable)", "1130", "ASSET", r"(employee|karyawan|pegawai|staff|related|berelasi|afiliasi|affiliat|\bloan\b|pinjaman)"),
    Rule(r"(persediaan|inventory|supplies|perlengkapan|finished goods|barang jadi|raw material)", "1160", "ASSET"),
    Rule(r"(biologis|biological)", "1160", "ASSET"),
    Rule(r"(bahan baku|bahan kemasan|bahan pendukung|bahan habis pakai|barang dagang|merchandise|seragam|apparel)", "1160", "ASSET", r"(pemakaian|penggunaan|pembelian|usage|consumption|purchase|hpp|beban|biaya)", strict=True),
    Rule(r"(prepaid|dibayar di ?muka|uang muka|advance|deposit|jaminan|guarantee|deferred (expense|charge|cost)|(beban|biaya) ditangguhkan)", "1170", "ASSET"),
    Rule(r"(piutang|receivable|loan to)", "1140", "ASSET", line="PIUTANG_LAIN"),
    Rule(r"(right of use|\baset hak guna|\brou\b)", "1230", "ASSET", template=True),
    Rule(r"(intangible|tak berwujud|tidak berwujud|lisensi|licen[cs]e|merk\b|trademark|software|hak guna|goodwill)", "1250", "ASSET"),
    Rule(r"(investment|investasi|penyertaan|placement|penempatan)", "1260", "ASSET"),
    Rule(r"(fixed asset|asset in progress|aset dalam penyelesaian|construction in progress|aset tetap|equipment|peralatan|kendaraan|vehicle|building|bangunan|renovation|renovasi|furniture|machine|mesin|\bland\b|tanah|inventaris|\bppe\b|\biot\b)", "1210", "ASSET"),
    Rule(r"(\bsewa\b|\brent\b|asuransi|insurance|langganan|subscription)", "1170", "ASSET", r"(hak guna|sewa guna|right of use|pembiayaan|akumulasi|accumulated|penyusutan|depreciation|piutang|receivable|pendapatan|revenue|income|klaim|claim|kendaraan|peralatan|mesin|bangunan)", strict=True),
    Rule(r"\b(gopay|ovo|shopeepay|linkaja|qris|edc)\b", "1120", "ASSET", r"(mesin|peralatan|machine|equipment|mdr|komisi|commission|fee|biaya|beban|uang muka|deposit|jaminan)", strict=True),
    Rule(r"(ppn keluaran|vat[- ]?out\b|output vat)", "2130", "LIABILITY"),
    Rule(r"(pph ?21|article 21|pasal 21)", "2140", "LIABILITY"),
    Rule(r"(pph ?23|article 23|pasal 23)", "2141", "LIABILITY"),
    Rule(r"(pph ?29|article 29|pasal 29)", "2146", "LIABILITY"),
    Rule(r"(tax payable|utang pajak|hutang pajak|article 4|article 25|pasal 4|pasal 25|\bpph\b|\bpb ?1\b|pajak (restoran|hotel|hiburan|reklame|parkir|daerah))", "2145", "LIABILITY"),
    Rule(r"(imbalan kerja|employee benefit|post.?employment|pesangon)", "2310", "LIABILITY"),
    Rule(r"(accrued|accured|masih harus dibayar|accrual|akrual)", "2150", "LIABILITY"),
    Rule(r"(unearned|diterima di muka|deferred revenue|customer deposit|uang muka (pelanggan|penjualan|customer|sales)|advance (from|received)|customer advance)", "2160", "LIABILITY"),
    Rule(r"down ?payment", "2160", "LIABILITY", r"(supplier|vendor|pemasok|pembelian|purchase|to |ke )", strict=True),
    Rule(r"(bank loan|utang bank|hutang bank|pinjaman bank|short term bank|kredit modal|credit card|kartu kredit|\bcc\b)", "2210", "LIABILITY"),
    Rule(r"(short ?term|jangka pendek)", "2120", "LIABILITY"),
    Rule(r"(long ?term|jangka panjang|non ?bank|lease|sewa pembiayaan|loan payable|\bloan\b|pinjaman)", "2300", "LIABILITY"),
    Rule(r"(trade payable|utang usaha|hutang usaha|accounts? payable)", "2110", "LIABILITY"),
    Rule(r"(payable|\butang\b|\bhutang\b|current liabilit|kewajiban lancar)", "2120", "LIABILITY", line="UTANG_LAIN"),
    Rule(r"(additional paid|agio|premium|tambahan modal|modal tambahan|\bapic\b)", "3110", "EQUITY"),
    Rule(r"(share capital|modal saham|modal disetor|ordinary shares?|pref+er+ed shares?|paid ?up|capital stock)", "3100", "EQUITY"),
    Rule(r"(retained|saldo laba|laba ditahan|saldo awal|opening balance|accumulated (loss|deficit)|earnings|laba tahun berjalan)", "3200", "EQUITY"),
    Rule(r"(prive|dividen|dividend|drawing|penarikan (modal|pemilik))", "3300", "EQUITY"),
    Rule(r"(\bmodal\b|setoran modal)", "3100", "EQUITY", r"(kerja|penyertaan|prive|dividen|drawing|penarikan|ditahan)", strict=True),
    Rule(r"((tax|pajak).*(vehicle|kendaraan|pbb|bumi|bangunan|property|properti|stamp|meterai|materai|retribusi|daerah|reklame|parkir))|\b(pkb|pbb|bphtb)\b", "6190", "EXPENSE"),
    Rule(r"(income tax expense|beban pajak|pph badan|tax expense|corporate tax)", "8100", "EXPENSE", r"final"),
    Rule(r"(final tax|pph final|4\(2\))", "8200", "EXPENSE"),
    Rule(r"(other income|pendapatan lain|other revenue|\bgain\b|miscellaneous income)", "4910", "INCOME", line="PENDAPATAN_LAIN"),
    Rule(r"(sales|penjualan)", "4100", "INCOME"),
    Rule(r"(revenue|pendapatan|service income|fee income|income)", "4110", "INCOME", line="PENDAPATAN_USAHA"),
    Rule(r"(purchase|pembelian|material|bahan baku|raw material)", "5100", "EXPENSE"),
    Rule(r"(cost of|hpp|harga pokok|beban pokok)", "5110", "EXPENSE"),
    Rule(r"(production cost|biaya produksi|beban produksi|makloon|maklon|overhead pabrik|factory overhead|direct labou?r|tenaga kerja langsung)", "5110", "EXPENSE", line="HPP"),
    Rule(r"(salary|salaries|gaji|wages|upah|tunjangan|\bthr\b|bonus|payroll|\binterns?(hip)?\b)", "6100", "EXPENSE"),
    Rule(r"(bpjs|insurance|asuransi|medication|kesehatan|medical)", "6110", "EXPENSE"),
    Rule(r"(\brent\b|\bsewa\b|lease expense)", "6120", "EXPENSE"),
    Rule(r"(electric|listrik|water|pdam|internet|telepon|telecommunication|telephone|utilit)", "6130", "EXPENSE"),
    Rule(r"(travel|transport|perjalanan|bensin|fuel|logistic|pengiriman|delivery|parkir|toll|freight)", "6140", "EXPENSE"),
    Rule(r"(marketing|advertis|iklan|promosi|promotion|\bads\b|sponsor)", "6150", "EXPENSE"),
    Rule(r"(office|kantor|stationer|stationary|\batk\b|printing|alat tulis)", "6160", "EXPENSE"),
    Rule(r"(professional|legal|audit|consultant|konsultan|notaris|jasa profesional|\bagent\b)", "6170", "EXPENSE"),
    Rule(r"(expense|beban|biaya)", "6190", "EXPENSE", line="BEBAN_UMUM_ADM"),
]
# Codes of new accounts by statement line (from, to), and codes that are never dealt.
RANGES = {
    "KAS_SETARA_KAS": (1111, 1129), "PIUTANG_USAHA": (1131, 1139), "PIUTANG_LAIN": (1141, 1149), "PERSEDIAAN": (1161, 1169),
    "PAJAK_DIBAYAR_DIMUKA": (1181, 1189), "BIAYA_DIBAYAR_DIMUKA": (1171, 1179), "ASET_TETAP": (1211, 1218), "AKUM_PENYUSUTAN": (1220, 1229),
    "ASET_TIDAK_LANCAR_LAIN": (1251, 1299), "UTANG_USAHA": (2111, 2119), "UTANG_PAJAK": (2146, 2149), "UTANG_LAIN": (2121, 2129),
    "UTANG_BANK": (2211, 2219), "UTANG_JANGKA_PANJANG": (2301, 2399), "MODAL": (3101, 3199), "SALDO_LABA": (3201, 3299),
    "PENDAPATAN_USAHA": (4101, 4199), "PENDAPATAN_LAIN": (4911, 4999), "HPP": (5101, 5999), "BEBAN_PENJUALAN": (6141, 6159),
    "BEBAN_UMUM_ADM": (6191, 6999), "BEBAN_LAIN": (7101, 7189), "BEBAN_PAJAK": (8101, 8199),
}
SPECIAL = ["1190", "1199", "1999", "3200", "3900", "7190", "7200", *(f"110{i}" for i in range(1, 10)), *(f"220{i}" for i in range(1, 10))]


def norm_name(name) -> Column:
    """A name in lower case, its letters and digits as words."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def _holds(text: Column, pattern: str) -> Column:
    return text.rlike(_ascii_bounds(pattern))


def _ascii_bounds(pattern: str) -> str:
    """The pattern with word bounds that know ASCII words only; the names hold neither capitals nor underscores."""
    return pattern.replace(r"\b", "(?:(?<![a-z0-9])(?=[a-z0-9])|(?<=[a-z0-9])(?![a-z0-9]))")


def strong_type(norm: Column) -> Column:
    """The type that a normalised name's words leave no doubt about, or null."""
    return F.coalesce(*[F.when(_holds(norm, p) & ~_holds(norm, but) if but else _holds(norm, p), kind) for p, kind, but in STRONG])


def code_digit(code: Column) -> Column:
    """The first digit of a code behind its prefix of letters, or null."""
    return F.nullif(F.regexp_extract(F.regexp_replace(code, "^[A-Za-z]+-", ""), "[0-9]", 0), F.lit(""))


def code_schemes(accounts: DataFrame, by: list[str], least: int = 3, percent: int = 80) -> DataFrame:
    """by, digit, learned: the type that most strongly named accounts of a leading digit have, if there are ``least`` and ``percent`` of them agree."""
    votes = accounts.select(*by, code_digit(F.col("code")).alias("digit"), strong_type(norm_name("name")).alias("learned")).filter("digit is not null and learned is not null")
    counts = votes.groupBy(*by, "digit", "learned").agg(F.count("*").alias("n"))
    sums = counts.groupBy(*by, "digit").agg(F.sum("n").alias("total"), F.max("n").alias("n"), F.max_by("learned", "n").alias("learned"))
    # a majority of four fifths has no equal, so max_by has no choice
    return sums.filter((F.col("total") >= least) & (F.col("n") * 100 >= F.col("total") * percent)).select(*by, "digit", "learned")


def inferred_type(code: Column, norm: Column, learned: Column | None = None) -> Column:
    """The type by strong words, the file's code scheme, weak words, the leading digit; null if none says."""
    digit = code_digit(code)
    weak = [F.when(_holds(norm, p), kind) for p, kind in WEAK]
    digits = [F.when(digit == d, kind) for d, kind in DIGITS.items()]
    return F.coalesce(strong_type(norm), *([] if learned is None else [learned]), *weak, *digits)


def account_types(accounts: DataFrame, by: list[str]) -> DataFrame:
    """``accounts`` (by, code, name) with ``digit`` and ``type``; the code scheme is learned from the accounts of each ``by``."""
    schemes = code_schemes(accounts, by)
    rows = accounts.withColumn("digit", code_digit(F.col("code"))).join(schemes, [*by, "digit"], "left")
    return rows.withColumn("type", inferred_type(F.col("code"), norm_name("name"), F.col("learned"))).drop("learned")


def suggested_accounts(sources: DataFrame, chart: DataFrame) -> DataFrame:
    """What each unmapped account of other books may be in the client's chart.

    ``sources``: client_id, entity_id, code, name, type_hint, term_hint (CURRENT, NON_CURRENT), account (null: unmapped).
    ``chart``: client_id, code, name, section, is_bank, is_suspense, is_clearing; a code is there once a client.

    In this order: the account that the name has already (of several the one of the last entity and code), the
    first account of that name, the first rule whose account the chart (or the template) has. Where the file says
    current or not, a general account on the wrong side gives way. Banks, suspense and clearing are never suggested.
    Rows: client_id, entity_id, code, name, suggested, method, confidence_pct, matched (the words that a rule found).

    Rules are one projection of the names, without a shuffle; a client's chart travels as one row of codes.
    """
    rows = sources.withColumn("_n", norm_name("name"))
    usable = chart.filter("not (is_bank or is_suspense or is_clearing)")
    books = usable.dropDuplicates(["client_id", "code"]).groupBy("client_id").agg(F.map_from_entries(F.collect_list(F.struct("code", "section"))).alias("_chart"))
    named = usable.groupBy("client_id", norm_name("name").alias("_n")).agg(F.min("code").alias("_exact"))
    prior = rows.filter("account is not null").groupBy("client_id", "_n").agg(F.max_by("account", F.struct("entity_id", "code")).alias("_prior"))

    n, kind = F.col("_n"), F.coalesce("type_hint", inferred_type(F.col("code"), F.col("_n")))
    rows = rows.filter("account is null").withColumn("_type", kind).withColumn("_hits", F.array_compact(F.array(*[F.when(_fits(n, r), F.lit(i)) for i, r in enumerate(RULES)])))
    rows = rows.join(prior, ["client_id", "_n"], "left").join(named, ["client_id", "_n"], "left").join(books, "client_id", "left")

    in_chart = lambda c: F.coalesce(F.map_contains_key("_chart", c), F.lit(False))
    of_rule = lambda field, i: F.get(F.array(*[F.lit(getattr(r, field)) for r in RULES]), i)
    rows = rows.withColumn("_rule", F.get(F.filter("_hits", lambda i: of_rule("template", i) | in_chart(of_rule("code", i))), 0))
    line = F.when(~_holds(n, CATCH_ALL), of_rule("line", F.col("_rule")))
    rows = rows.withColumn("_line", line).withColumn("_hit", F.coalesce(F.concat(F.lit("new:"), "_line"), of_rule("code", F.col("_rule"))))
    rows = rows.withColumn("_known", F.col("_hit").isNotNull() & in_chart(F.coalesce("_hit", F.lit("")))).withColumn("_section", F.when(F.col("_known"), F.try_element_at("_chart", "_hit")))

    asset, debt, later = F.col("_type") == "ASSET", F.col("_type") == "LIABILITY", F.col("term_hint") == "NON_CURRENT"
    side = (
        F.when(debt & later & (~F.col("_known") | (F.col("_section") == "CURRENT_LIABILITY")), "2300")
        .when(debt & (F.col("term_hint") == "CURRENT") & (F.col("_section") == "LONG_TERM_LIABILITY"), "2120")
        .when(asset & later & (~F.col("_known") | (F.col("_section") == "CURRENT_ASSET")), "1260")
    )
    rows = rows.withColumn("_side", side).withColumn("_side", F.when(in_chart(F.coalesce("_side", F.lit(""))), F.col("_side")))
    found = F.coalesce(*[F.when(F.col("_rule") == i, F.regexp_extract("_n", _ascii_bounds(r.pattern), 0)) for i, r in enumerate(RULES)])
    method = (
        F.when(F.col("_prior").isNotNull(), "PRIOR").when(F.col("_exact").isNotNull(), "NAME").when(F.col("_side").isNotNull(), "TERM")
        .when(F.col("_line").isNotNull(), "NEW").when(F.col("_hit").isNotNull(), "KEYWORD")
    )
    rows = rows.withColumn("method", method)
    sure = F.when(F.col("method").isin("PRIOR", "NAME"), 95).when(F.col("method") == "KEYWORD", 80).when(F.col("method") == "TERM", 75).when(F.col("method") == "NEW", 70)
    return rows.select(
        "client_id", "entity_id", "code", "name", F.coalesce("_prior", "_exact", "_side", "_hit").alias("suggested"), "method", sure.alias("confidence_pct"),
        F.when(F.col("method").isin("KEYWORD", "NEW"), found).alias("matched"),
    )


def _fits(norm: Column, rule: Rule) -> Column:
    """Whether a rule says something of a name and its ``_type``, whatever the chart."""
    fits = _holds(norm, rule.pattern)
    if rule.but:
        fits = fits & ~_holds(norm, rule.but)
    if rule.types:
        fits = fits & F.coalesce(F.col("_type") == rule.types, F.lit(not rule.strict))
    return fits


def free_codes(line: str, reserved: list[str]) -> list[str]:
    """The codes that new accounts of a statement line get, in order: its range, then parts of the code before it."""
    first, last = RANGES[line]
    never = {*SPECIAL, *reserved}
    return [c for c in map(str, range(first, last + 1)) if c not in never] + [f"{first - 1}{i:02}" for i in range(1, 1000)]


def allocated_codes(accepted: DataFrame, chart: DataFrame, reserved: list[str]) -> DataFrame:
    """Codes of the accounts that accepted suggestions of a statement line create.

    ``accepted``: client_id, position (the order of acceptance), line, name. A name that the chart has (not as a bank,
    suspense or clearing; of several the last code) is that account, one that is accepted again is the same new account,
    on the line of its first acceptance. ``reserved`` codes are left out of ranges only. Rows: client_id, position, name, code
    (null where a line's codes are used up or the line takes none), created (true for the row that makes the account).
    """
    rows = accepted.withColumn("_n", norm_name("name"))
    here = chart.filter("not (is_bank or is_suspense or is_clearing)").groupBy("client_id", norm_name("name").alias("_n")).agg(F.max("code").alias("_old"))
    used = chart.groupBy("client_id").agg(F.collect_set("code").alias("_used"))
    firsts = rows.groupBy("client_id", "_n").agg(F.min(F.struct("position", "line")).alias("_first")).join(here, ["client_id", "_n"], "left")
    fresh = firsts.filter("_old is null").select("client_id", "_n", "_first.position", "_first.line")
    fresh = fresh.withColumn("_rank", F.row_number().over(Window.partitionBy("client_id", "line").orderBy("position")))
    lists = accepted.sparkSession.createDataFrame([(k, free_codes(k, reserved)) for k in RANGES], "line string, _free array<string>")
    taken = F.coalesce("_used", F.array().cast("array<string>"))
    # a client's free codes are worked out once a line, and places beyond the last of them have none
    lines = fresh.select("client_id", "line").distinct().join(lists, "line").join(used, "client_id", "left").select("client_id", "line", F.posexplode(F.array_except("_free", taken)).alias("_at", "_code"))
    codes = fresh.join(lines.withColumn("_rank", F.col("_at") + 1), ["client_id", "line", "_rank"], "left").select("client_id", "_n", F.col("position").alias("_made"), "_code")
    rows = rows.join(here, ["client_id", "_n"], "left").join(codes, ["client_id", "_n"], "left")
    made = F.coalesce((F.col("position") == F.col("_made")) & F.col("_code").isNotNull(), F.lit(False))
    return rows.select("client_id", "position", "name", F.coalesce("_old", "_code").alias("code"), made.alias("created"))
