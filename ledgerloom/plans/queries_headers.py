"""Headers with slips and the first tables of sheets, both derived from the parts."""

from pyspark.sql import functions as F

from ..operators import headers as h
from .catalog import register

FLAT = [(k, w) for k, ws in h.WORDS.items() for w in ws]


def slipped(b):
    """A header word per part: as it is, or with a letter lost, two swapped, one changed, or one added and the last one lost."""
    k, n = F.col("p_partkey"), len(FLAT)
    word = F.element_at(F.array(*[F.lit(w) for _, w in FLAT]), (k % n + 1).cast("int"))
    rows = b.read("part").select("p_partkey", "p_name", word.alias("w")).withColumn("i", (F.expr(f"p_partkey div {n}") % F.length("w") + 1).cast("int"))
    w, i = F.col("w"), F.col("i")
    head, tail = F.substring(w, F.lit(1), i - 1), lambda d: F.substring(w, i + d, F.length(w))
    letter = lambda d: F.substring(w, i + d, F.lit(1))
    made = (
        F.when(k % 5 == 0, w).when(k % 5 == 1, F.concat(head, tail(1))).when(k % 5 == 2, F.concat(head, letter(1), letter(0), tail(2)))
        .when(k % 5 == 3, F.concat(head, F.lit("x"), tail(1))).otherwise(F.concat(head, F.lit("z"), F.substring(w, i, F.length(w) - i)))
    )
    return rows.withColumn("header", made)


LIST = ", ".join(f"('{k}', '{w}')" for k, w in FLAT)


@register(
    "s19_nearest_headers",
    f"""with known(key, word) as (values {LIST}), numbered as (select word, row_number() over () - 1 as n from known),
    p as (select p_partkey as k, word as w, (p_partkey // {len(FLAT)} % length(word) + 1)::int as i from part join numbered on n = p_partkey % {len(FLAT)}),
    t as (select distinct case k % 5 when 0 then w when 1 then substr(w, 1, i - 1) || substr(w, i + 1) when 2 then substr(w, 1, i - 1) || substr(w, i + 1, 1) || substr(w, i, 1) || substr(w, i + 2)
                               when 3 then substr(w, 1, i - 1) || 'x' || substr(w, i + 1) else substr(w, 1, i - 1) || 'z' || substr(w, i, length(w) - i) end as header from p),
    n as (select header, trim(regexp_replace(lower(header), '[^a-z0-9]+', ' ', 'g')) as text from t),
    d as (select header, key, word, damerau_levenshtein(text, word)::int as distance, case when length(replace(word, ' ', '')) >= 9 then 2 when length(replace(word, ' ', '')) >= 5 then 1 else 0 end as most from n, known),
    b as (select *, min(distance) over (partition by header) as least from d where distance <= most)
    select header, min(key) as key, min(word) as word, distance from b where distance = least group by header, distance having count(distinct key) = 1""",
)
def s19(b):
    return h.nearest_words(slipped(b).select("header"), h.known_words(b.spark))


@register("s15_first_tables")  # columns are taken one after another: tests hold it against sheets read by hand
def s15(b):
    """A sheet per part: a title, a header whose second word may have a slip, and three rows."""
    rows = slipped(b)
    k, name, no = F.col("p_partkey"), F.col("p_name"), F.col("p_partkey").cast("string")
    title = F.when(k % 11 == 0, "Laporan Laba Rugi").when(k % 13 == 0, "All Branch Profit Loss Report").otherwise(name)
    line = lambda *cells: F.array(*[c if not isinstance(c, str) else F.lit(c) for c in cells])
    ledger = line("Tanggal", "Kode Akun", "Nama Akun", F.col("header"), "Debit", "Kredit")
    balance = line("Account", "Description", F.col("header"), "31/12/2024", "", "")
    head = F.when(k % 2 == 0, ledger).otherwise(balance)
    data = [F.when(k % 2 == 0, line("2024-01-05", F.concat(F.lit(f"{n}-"), no), name, "note", "5", "0")).otherwise(line(F.concat(F.lit(f"{n}-"), no), name, "", "5", "", "")) for n in (1, 2, 3)]
    sheets = rows.select(k.alias("sheet"), F.posexplode(F.array(line(title, "", "", "", "", ""), head, *data)).alias("row_no", "cells"))
    cells = sheets.select("sheet", "row_no", F.posexplode("cells").alias("column", "text"))
    found = h.first_tables(cells)
    return found.withColumn("columns", F.array_join(F.array_sort(F.transform(F.map_entries("columns"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ", ")).withColumn("typos", F.array_join(F.col("typos.header"), ", "))
