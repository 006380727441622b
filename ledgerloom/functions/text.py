"""Text columns: merchant keys, row hashes, name and tax-id normalisation."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .money import _col

# What a bank's description says besides a name.
NOISE = [
    r"\b(TRSF|TRF|TRANSFER|E-BANKING|EBANKING|M-BANKING|MB|IB)\b",
    r"\b(DB|CR|KR|DR)\b",
    r"\b(BI[- ]?FAST|RTGS|SKN|LLG|SWITCHING|KE|DARI|FROM|TO|KLIRING)\b",
    r"\b\d{2,4}/[A-Z0-9]+/[A-Z0-9]+\b",
    r"\b[A-Z]{0,4}\d[A-Z0-9]{5,}\b",
    r"\b\d+([.,]\d+)*\b",
    r"[^A-Z &]",
]
# Words that say how money moved, not who it came from.
CHANNEL_WORDS = (
    "BI FAST BIF OUTGOING INCOMING TRSF TRF TRANSFER TRANSFERS EBANKING MBANKING IBANKING BANKING INTERNET MOBILE ONLINE "
    "DB CR KR DR DEBIT KREDIT CREDIT RTGS SKN LLG KLIRING CLEARING SWITCHING KE DARI FROM TO VIA ATAS NAMA AN OVERBOOKING "
    "PINDAH DANA BUKU PB PINJAMAN LOAN LOANS SETORAN SETOR TUNAI TARIK TARIKAN PENARIKAN CASH WITHDRAWAL ATM DEP DEPOSIT "
    "VA VIRTUAL ACCOUNT TOPUP TOP UP REVERSAL KOREKSI REVERSE PAYMENT PEMBAYARAN BAYAR"
).split()
# Legal forms of bodies.
LEGAL_FORMS = "PT CV UD PD TBK FIRMA FA KOPERASI PERSERO PERUM YAYASAN".split()
# Forms and titles, which identify no one.
NO_NAMES = "PT CV TBK UD PD KOPERASI YAYASAN BAPAK IBU BPK".split()
# Banks and their products, and words of moving own money; neither names a third party.
BANK_WORDS = (
    "BANK GIRO TABUNGAN BCA BJB BLU BNI BRI BRITAMA BSI BTN BTPN CIMB CITI CITIBANK DANAMON DBS DIGIBANK DKI HSBC "
    "JAGO JAKONE JATIM JENIUS MANDIRI MAYBANK MDR MEGA NIAGA NISP OCBC OCTO PANIN PERMATA SEABANK SIMPEDES SINARMAS "
    "SMBC TAHAPAN UOB XPRESI"
).split()
OWN_TRANSFER_WORDS = (
    "PEMILIK OWNER SENDIRI ANTAR REKENING REK SWEEP INTERNAL MODAL KEMBALI PENGEMBALIAN TALANGAN OPERASIONAL MASUK "
    "KELUAR MCM INHOUSETRF INHOUSE NBMB TGL JAM WIB SDR SDRI BPK IBU NO REF CABANG KCP BERITA NOREK ESB"
).split()
TRANSFER_HINT = r"TRSF|\bTRF\b|TRANSFER|PINDAH ?BUKU|PEMINDAHAN|OVERBOOK|SETOR TUNAI|TARIK TUNAI"


def merchant_key(description) -> Column:
    """The stable part of a bank line's description."""
    upper = F.upper(_col(description))
    s = F.concat(F.lit(" "), upper, F.lit(" "))
    for pattern in NOISE:
        s = F.regexp_replace(s, pattern, " ")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.coalesce(F.nullif(s, F.lit("")), F.trim(F.substring(upper, 1, 40)))


def is_generic_key(key) -> Column:
    """Whether all words of a key are channel words, so that it names no one."""
    words = F.filter(F.split(F.upper(_col(key)), r"\s+"), lambda w: w.rlike("^[A-Z]{2,}$"))
    return F.size(F.array_except(words, F.array(*map(F.lit, CHANNEL_WORDS)))) == 0


def own_name_pattern(name) -> Column:
    """A regular expression of what a merchant key prints of an own name; null if that is under three letters.

    It is a run of at least two of its words (one if there is but one), the last of them possibly cut to
    three letters or more, with or without a legal form in front."""
    words = F.filter(F.split(merchant_key(name), " "), lambda w: (w != "") & ~w.isin(LEGAL_FORMS))
    n = F.size(words)
    least = F.least(F.lit(2), n)
    cuts = lambda w: F.array_join(F.transform(F.sequence(F.lit(3), F.length(w) - 1), lambda k: F.substring(w, 1, k)), "|")

    def run(m):
        whole = F.array_join(F.slice(words, 1, m), " ")
        last = F.get(words, m)
        cut = F.when((m < n) & (F.length(last) > 3) & (m + 1 >= least), F.concat(whole, F.when(m > 0, " ").otherwise(""), F.lit("(?:"), cuts(last), F.lit(")")))
        return F.array(cut, F.when((m >= least) & (m > 0), whole))

    runs = F.flatten(F.transform(F.sequence(n, F.lit(0)), run))
    body = F.array_join(F.filter(runs, lambda r: r.isNotNull()), "|")
    pattern = F.concat(F.lit(f"(?<![^ ])(?:(?:{'|'.join(LEGAL_FORMS)}) )?(?:"), body, F.lit(")(?![^ ])"))
    return F.when((n > 0) & (F.length(F.array_join(words, " ")) >= 3), pattern)


def third_party_name(description, patterns) -> Column:
    """Who a description names besides the own names (an array of ``own_name_pattern``), else null."""
    shorter = lambda text, p: F.trim(F.regexp_replace(F.regexp_replace(text, p, " "), " +", " "))
    rest = F.aggregate(_col(patterns), F.regexp_replace(merchant_key(description), r"\s+", " "), shorter)
    known = [*BANK_WORDS, *OWN_TRANSFER_WORDS, *CHANNEL_WORDS]
    return F.nullif(F.array_join(F.filter(F.split(rest, " "), lambda w: w.rlike("^[A-Z]{2,}$") & ~w.isin(known)), " "), F.lit(""))


def mentions(description, names) -> Column:
    """Whether a description holds one of the names (an array, in capitals) as whole words."""
    text = F.upper(_col(description))
    return F.exists(_col(names), lambda n: F.regexp_like(text, F.concat(F.lit(r"(^|[^A-Z0-9])\Q"), n, F.lit(r"\E($|[^A-Z0-9])"))))


def row_hash(day, amount, description, balance) -> Column:
    parts = [F.date_format(_col(day), "yyyy-MM-dd"), _col(amount).cast("string"), _col(description), F.coalesce(_col(balance).cast("string"), F.lit(""))]
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 24)


def row_hash_in_file(day, amount, description, balance, file, order) -> Column:
    """As ``row_hash``, where the n-th repeat in a file carries its ordinal."""
    base = row_hash(day, amount, description, balance)
    n = F.row_number().over(Window.partitionBy(_col(file), base).orderBy(_col(order))) - 1
    return F.when(n == 0, base).otherwise(F.substring(F.sha1(F.concat(base, F.lit("|#"), n.cast("string"))), 1, 24))


def normal_name(name) -> Column:
    """A name in capitals without legal forms and without anything but letters and digits."""
    forms = "|".join(LEGAL_FORMS)
    return F.regexp_replace(F.regexp_replace(F.upper(_col(name)), rf"\b({forms})\b\.?", ""), "[^A-Z0-9]", "")


def plain_words(text) -> Column:
    """A text in capitals, its words of letters and digits with one space between."""
    return F.trim(F.regexp_replace(F.upper(_col(text)), "[^A-Z0-9]+", " "))


def tax_id(text) -> Column:
    """Digits of a tax id; 16 digits that lead with 0 are the 15 behind it."""
    digits = F.regexp_replace(_col(text), r"\D", "")
    return F.when((F.length(digits) == 16) & digits.startswith("0"), F.substring(digits, 2, 15)).otherwise(digits)


def amount_marker(text) -> Column:
    """DB or CR as an amount's text states it behind its digits, in whatever form; a minus behind it is
    DB. Null where it states none or has no digit."""
    t = F.trim(_col(text))
    # The forms of the marker.
    word = F.upper(F.regexp_extract(t, r"(?i)\d[^A-Za-z]*\b?(CR|DB|DR|D|C|K)\.?$", 1))
    return F.when(word.isin("DB", "DR", "D"), "DB").when(word != "", "CR").when(t.rlike(r"^[\d.,\s]*\d[\d.,\s]*-$"), "DB")


# Words of loans, capital and moved money, of what they cost, and of tax payments.
FINANCING = r"(?i)\b(PINJAMAN|LOAN|PRK|PLAFON|ANGSURAN|POKOK|PENCAIRAN (?:KREDIT|KMK|KI)|PELUNASAN (?:KREDIT|KMK|KI)|SETORAN MODAL|MODAL|DEPOSITO|PENEMPATAN|PINDAH ?BUKU|OVERBOOK\w*|ANTAR REKENING)\b"
FINANCING_COST = r"(?i)\b(BUNGA|INTEREST|BIAYA|FEE|ADM\w*|PAJAK|TAX|MATERAI|STAMP|PROVISI)\b"
INTEREST = r"(?i)\b(BUNGA|INTEREST)\b"
FEES = r"(?i)\b(BIAYA|FEE|ADM\w*|MATERAI|STAMP|PROVISI)\b"
CAPITAL = r"(?i)\b(SETORAN MODAL|MODAL)\b"
LOAN_IN = r"(?i)\b(PINJAMAN|LOAN|PLAFON|PRK|PENCAIRAN (?:KREDIT|KMK|KI))\b"
LOAN_OUT = r"(?i)\b(ANGSURAN|POKOK|PINJAMAN|LOAN|PLAFON|PRK|PELUNASAN (?:KREDIT|KMK|KI))\b"
OWN_MOVE = r"(?i)\b(PINDAH ?BUKU|OVERBOOK\w*|ANTAR REKENING)\b"
TAX_PAYMENT = r"(?i)\b(MPN|DJP|SSP|KPP|NTPN|KODE BILLING|PENERIMAAN NEGARA|(?:BAYAR|SETOR|SETORAN|PEMBAYARAN) PAJAK)\b|^\s*PAJAK\s*$"
REGIONAL_TAX = r"(?i)\b(KONSULTAN|KENDARAAN|PKB|PBB|BPHTB|REKLAME|HOTEL|RESTORAN|SAMSAT|BBNKB|AIR TANAH|PARKIR|DAERAH|BAPENDA|BAPPEDA)\b"


def text_account(description, direction) -> Column:
    """C4: the account that a description's words suggest, else null. Words of financing come first: interest and fees that go out are
    costs, other costs suggest nothing, loans go before capital and before money that only moves. Then a payment of a tax to
    the state; regional taxes and advisers are costs."""
    has = lambda p: _col(description).rlike(p)
    out = _col(direction) == "OUT"
    financing = (
        F.when(has(INTEREST), F.when(out, "7110"))
        .when(has(FEES), F.when(out, "7100"))
        .when(has(FINANCING_COST), F.lit(None).cast("string"))
        .when(~out & has(LOAN_IN), "2210")
        .when(~out & has(CAPITAL), "3100")
        .when(out & has(LOAN_OUT), "2210")
        .when(has(OWN_MOVE), "1199")
    )
    tax = F.when(out & has(TAX_PAYMENT) & ~has(REGIONAL_TAX), "2145")
    return F.coalesce(F.when(has(FINANCING), financing), tax)
