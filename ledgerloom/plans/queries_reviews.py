"""Reviews: flagged lines, settings in force, reporting periods, row proof, references, more month-close checks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import money as m
from ..operators import ingest as ing
from ..operators import registers as reg
from ..operators import reviews as rv
from ..operators.receivables import open_items
from .catalog import register
from .oracle import with_views
from .queries_registers import FISCAL, assets, groups


def reviewed_lines(b):
    """Bank lines as a reviewer leaves them: account, status, method, confidence, parts, words of financing."""
    k = F.col("k")
    account = F.element_at(F.array(*map(F.lit, ("4100", "6200", "1199", "2100", "5100"))), (k % 5 + 1).cast("int"))
    words = F.when(k % 8 == 0, " ANGSURAN POKOK").when(k % 8 == 1, " BUNGA PINJAMAN").when(k % 8 == 2, " SETORAN MODAL").otherwise("")
    whole = F.abs("amount")
    part = lambda a, v: F.struct(F.lit(a).alias("account"), v.alias("amount"))
    first = m.div(whole * 3, 5)
    return b.bank_line().select(
        "client_id", "entity_id", "line_id", "day", "amount", F.when(k % 11 != 0, account).alias("account"), F.concat("description", words).alias("description"),
        F.element_at(F.array(*map(F.lit, ("NEEDS_REVIEW", "REVIEWED", "POSTED"))), (k % 3 + 1).cast("int")).alias("status"),
        F.element_at(F.array(*map(F.lit, ("HEURISTIC", "AI", "RULE", "MEMORY"))), (k % 4 + 1).cast("int")).alias("method"), k.alias("confidence_pct"),
        F.when(k % 6 == 2, F.array(part("4100", first), part("2100", whole - first))).alias("parts"),
    )


REVIEWED = """
    rl as (select client_id, entity_id, line_id, day, amount, case when k % 11 <> 0 then (['4100', '6200', '1199', '2100', '5100'])[k % 5 + 1] end as account,
        description || case k % 8 when 0 then ' ANGSURAN POKOK' when 1 then ' BUNGA PINJAMAN' when 2 then ' SETORAN MODAL' else '' end as description,
        (['NEEDS_REVIEW', 'REVIEWED', 'POSTED'])[k % 3 + 1] as status, (['HEURISTIC', 'AI', 'RULE', 'MEMORY'])[k % 4 + 1] as method, k as confidence_pct, k % 6 = 2 as split from bank_line),
    rp as (select * replace (case when split then '4100' else account end as account, case when split then sign(amount)::int * (abs(amount) * 3 // 5) else amount end as amount) from rl
        union all select * replace ('2100' as account, sign(amount)::int * (abs(amount) - abs(amount) * 3 // 5) as amount) from rl where split)"""
FINANCING_ROWS = "status <> 'NEEDS_REVIEW' and account in ('4100', '5100', '6200') and (contains(description, ' ANGSURAN POKOK') or contains(description, ' SETORAN MODAL'))"
GUESS_ROWS = "status = 'REVIEWED' and account is not null and (method = 'HEURISTIC' or method = 'AI' and confidence_pct < 60)"
# a line without an account isn't posted, whatever its parts say
FINANCING_SQL = f"select p.* from rp p join rl l using (line_id) where l.account is not null and p.{FINANCING_ROWS.replace('account in', 'p.account in').replace('description', 'p.description')}"


@register("p14_line_parts", with_views("bank_line", "select 1").replace(" select 1", f", {REVIEWED} select line_id, account, amount from rp"))
def p14(b):
    return rv.by_part(reviewed_lines(b)).select("line_id", "account", "amount")


@register(
    "a34_flagged_lines",
    with_views("bank_line", "select 1").replace(
        " select 1", f", {REVIEWED} select 'FINANCING' as flag, client_id, entity_id, line_id, day, account, amount from ({FINANCING_SQL}) union all select 'GUESS', client_id, entity_id, line_id, day, account, amount from rl where {GUESS_ROWS}"
    ),
)
def a34(b):
    return rv.flagged_lines(reviewed_lines(b), b.chart())


@register(
    "j11_settings_in_force",
    with_views(
        "ord",
        """select a.entity_id, a.month, s.rate, s.effective_month from (select distinct entity_id, (year(day) * 12 + month(day) - 1)::int as month from ord) a
        asof left join (select n_nationkey as entity_id, (1993 * 12 + n_nationkey % 7 * 3 + i * 17)::int as effective_month, (n_nationkey * 10 + i)::bigint as rate from nation, range(4) t(i)) s
        on a.entity_id = s.entity_id and a.month >= s.effective_month""",
    ),
)
def j11(b):
    k = F.col("n_nationkey")
    settings = b.read("nation").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    settings = settings.select(k.alias("entity_id"), (1993 * 12 + k % 7 * 3 + F.col("i") * 17).cast("int").alias("effective_month"), (k * 10 + F.col("i")).cast("long").alias("rate"))
    asked = b.order().select("entity_id", (F.year("day") * 12 + F.month("day") - 1).cast("int").alias("month")).distinct()
    return rv.in_force(asked, settings, "entity_id", "rate")


def with_openings(b):
    """The journal of entities that start with an opening: at the last year's end, inside the year, or never."""
    third, kind = F.col("entity_id") % 3, F.col("entry_kind")
    opening = ((third == 0) & (F.col("day") == "1997-12-31")) | ((third == 1) & (F.col("day") == "1998-02-14"))
    return b.journal_line(("1200",)).filter((third != 1) | (F.col("day") >= "1998-02-14")).withColumn("entry_kind", F.when(opening, "OPENING").otherwise(kind))


@register(
    "a26_report_periods",
    with_views(
        "journal",
        """with j as (select client_id, entity_id, day, (entity_id % 3 = 0 and day = date '1997-12-31' or entity_id % 3 = 1 and day = date '1998-02-14') as opening from journal where account = '1200' and (entity_id % 3 <> 1 or day >= date '1998-02-14')),
        o as (select entity_id, min(day) as opening_at from j where opening and day between date '1997-12-31' and date '1998-06-30' group by 1),
        e as (select distinct client_id, entity_id from j),
        f as (select e.*, opening_at, exists (select 1 from j where j.entity_id = e.entity_id and day <= date '1997-12-31') as had, exists (select 1 from j where j.entity_id = e.entity_id and day between date '1997-01-01' and date '1997-06-30') as prior,
            opening_at >= date '1998-01-01' and not exists (select 1 from j where j.entity_id = e.entity_id and day < o.opening_at) as opens from e left join o using (entity_id)),
        g as (select *, case when opens then opening_at + 1 else date '1998-01-01' end as books_start from f)
        select client_id, entity_id, date '1998-01-01' as year_start, books_start, case when books_start > date '1998-06-30' then date '1998-01-01' else books_start end as from_day, opening_at,
            case when had then date '1997-12-31' when opening_at > date '1997-12-31' and opening_at < date '1998-06-30' then opening_at end as compared_balance,
            case when had then coalesce(opening_at = date '1997-12-31', false) when opening_at > date '1997-12-31' and opening_at < date '1998-06-30' then true end as compared_opening,
            case when prior then date '1997-01-01' end as prior_start, case when prior then date '1997-06-30' end as prior_end from g""",
    ),
)
def a26(b):
    return rv.report_periods(with_openings(b), "1998-06-30")


PRINTED = """
    x as (select line_id, bank_account, day, k, case when k % 29 = 0 then 0 when amount < 0 then -amount else 0 end as debit, case when k % 29 = 0 then 0 when k % 31 = 1 then abs(amount) when amount > 0 then amount else 0 end as credit, case when bank_account % 3 > 0 then 1000::bigint end as opening from bank_line),
    y as (select *, credit - debit as mv, sum(credit - debit) over (partition by bank_account order by line_id) + 1000 as running from x),
    z as (select * exclude (running), case when k % 4 = 0 then (running + case when k = 48 then 1 else 0 end)::bigint end as balance from y),
    u as (select *, count(balance) over b as island, last_value(balance ignore nulls) over b as prev from z window b as (partition by bank_account order by line_id rows between unbounded preceding and 1 preceding)),
    v as (select *, (coalesce(prev, opening) + sum(mv) over (partition by bank_account, island order by line_id))::bigint as expected from u),
    s as (select *, case when debit <> 0 and credit <> 0 then 'BAD_AMOUNT' when mv = 0 then 'NO_AMOUNT' when coalesce(prev, opening) is null then 'NO_OPENING' when balance is null then 'NO_BALANCE' when balance = expected then 'OK' else 'BREAK' end as state0 from v),
    n as (select *, coalesce(max(case when state0 <> 'NO_BALANCE' then line_id end) over (partition by bank_account order by line_id rows between unbounded preceding and current row), 0) as _,
        min(case when state0 <> 'NO_BALANCE' then line_id end) over (partition by bank_account order by line_id rows between 1 following and unbounded following) as nx, sum(turn) over (partition by bank_account order by line_id) as seg
        from (select *, case when day = lag(day) over (partition by bank_account order by line_id) then 0 else 1 end as turn from s)),
    pr as (select n.bank_account, n.line_id, n.balance, n.opening, n.expected, case when n.state0 = 'NO_BALANCE' and q.seg = n.seg and q.state0 in ('OK', 'BREAK') then q.state0 else n.state0 end as state from n left join n q on q.bank_account = n.bank_account and q.line_id = n.nx)"""


def printed_rows(b):
    """Statement rows of the bank lines, every fourth with its balance; some misprinted."""
    k, a = F.col("k"), F.col("amount")
    rows = b.bank_line().select(
        "line_id", "bank_account", "day", "k",
        F.when((k % 29 != 0) & (a < 0), -a).otherwise(0).alias("debit"), F.when(k % 29 == 0, 0).when(k % 31 == 1, F.abs(a)).when(a > 0, a).otherwise(0).alias("credit"),
        F.when(F.col("bank_account") % 3 > 0, F.lit(1000).cast("long")).alias("opening"),
    )
    running = F.sum(F.col("credit") - F.col("debit")).over(Window.partitionBy("bank_account").orderBy("line_id")) + 1000
    return rows.withColumn("balance", F.when(k % 4 == 0, running + F.when(k == 48, 1).otherwise(0)))


@register("p9_row_proofs", with_views("bank_line", "select 1").replace(" select 1", f", {PRINTED} select bank_account, line_id, balance, expected, state from pr"))
def p9(b):
    return ing.proved_rows(printed_rows(b), "bank_account", "line_id", chained=True).select("bank_account", "line_id", "balance", "expected", "state")


@register(
    "p9_statement_proofs",
    with_views("bank_line", "select 1").replace(
        " select 1", f""", {PRINTED} select *, opening is not null and problems = 0 as importable from (select bank_account, count(*) as n_rows, coalesce(max_by(coalesce(balance, -1), line_id) = 1000, false) as closing_ok,
        count(*) filter (state <> 'OK') + (not coalesce(max_by(coalesce(balance, -1), line_id) = 1000, false))::int as problems, max(opening) as opening from pr group by 1)""").replace("select *, opening is not null", "select * exclude (opening), opening is not null"),
)
def p9_statements(b):
    rows = ing.proved_rows(printed_rows(b), "bank_account", "line_id", chained=True).withColumn("closing", F.lit(1000).cast("long"))
    return ing.statement_proofs(rows, "bank_account", "line_id")


@register("w4_later_balances", with_views("bank_line", "select line_id, coalesce(line_id < max(line_id) filter (k % 4 = 0) over (partition by bank_account), false) as confirmed from bank_line"))
def w4(b):
    rows = b.bank_line().select("line_id", "bank_account", F.when(F.col("k") % 4 == 0, F.col("amount")).alias("balance"))
    return ing.later_balances(rows, "bank_account", "line_id").select("line_id", "confirmed")


@register(
    "p17_row_references",
    """with r as (select l_suppkey as k, case when l_linenumber % 2 = 0 then 'A' else 'F' end as c, l_partkey as n, l_orderkey * 10 + l_linenumber as pos from lineitem),
    i as (select *, n - row_number() over (partition by k, c order by n) as island, min(pos) over (partition by k, c) as seen from r),
    g as (select k, c, seen, min(n) as lo, max(n) as hi from i group by k, c, seen, island)
    select k as supplier_id, left('S!' || string_agg(c || lo || case when hi > lo then '-' || hi else '' end, ',' order by seen, lo, hi), 500) as reference from g group by 1""",
)
def p17(b):
    cell = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "A").otherwise("F"), "l_partkey")
    rows = b.read("lineitem").select(F.col("l_suppkey").alias("supplier_id"), F.lit("S").alias("sheet"), cell.alias("cell"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    return rv.row_references(rows, "supplier_id")


@register("k4_entities_in_order", with_views("entity", "select client_id, entity_id, row_number() over (partition by client_id order by (kind = 'INDIVIDUAL')::int, entity_name)::int as place from entity"))
def k4(b):
    w = Window.partitionBy("client_id").orderBy((F.col("kind") == "INDIVIDUAL").cast("int"), "entity_name")
    return b.entity().select("client_id", "entity_id", F.row_number().over(w).alias("place"))


@register(
    "k5_codes_in_order",
    r"""select p_brand, code, row_number() over (partition by p_brand order by array_to_string(list_transform(regexp_extract_all(code, '\d+|\D+'), lambda x: case when regexp_matches(x, '^\d') then lpad(x, 18, '0') else x end), ''), code)::int as place
    from (select p_brand, 'A' || p_size || '-' || p_partkey as code from part)""",
)
def k5(b):
    rows = b.read("part").select("p_brand", F.concat(F.lit("A"), "p_size", F.lit("-"), "p_partkey").alias("code"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy(rv.natural_key("code"), "code")))


@register("k6_more_than", with_views("bank_line", "select least(count(*), 200) as n, count(*) > 200 as more from bank_line where amount < 0"))
def k6(b):
    return rv.probe(b.bank_line().filter("amount < 0"))


@register(
    "w16_asset_balances",
    FISCAL
    + """ select asset_id, day, cost, depreciation, c::bigint as cost_to_date, d::bigint as depreciation_to_date, (c - d)::bigint as book_value from (
    select *, sum(cost) over w as c, sum(depreciation) over w as d from (
        select asset_id, acquired_on as day, 0 as movement_id, cost, 0::bigint as depreciation from a
        union all select asset_id, make_date((year - 1)::int, 12, 31), (year - 1)::int, 0, annual from y where months > 0)
    window w as (partition by asset_id order by day, movement_id))""",
)
def w16(b):
    zero = F.lit(0).cast("long")
    bought = assets(b).select("asset_id", F.col("acquired_on").alias("day"), F.lit(0).alias("movement_id"), "cost", zero.alias("depreciation"))
    years = reg.fiscal_years(assets(b), groups(b))
    charged = years.select("asset_id", F.make_date("year", F.lit(12), F.lit(31)).alias("day"), F.col("year").cast("int").alias("movement_id"), zero.alias("cost"), F.col("annual").alias("depreciation"))
    return rv.asset_balances(bought.unionByName(charged)).drop("movement_id")


@register(
    "a47_counted_controls",
    with_views("bank_line entity journal item rates", "select 1").replace(
        " select 1",
        f""", {REVIEWED},
        found as (
            select entity_id, 'FINANCING_TEXT' as check_key, count(*) as n from ({FINANCING_SQL}) group by 1
            union all select entity_id, 'ACCEPTED_GUESSES', count(*) from rl where {GUESS_ROWS} group by 1
            union all select e.entity_id, 'UNCLASSIFIED', count(*) from rl join entity c on c.entity_id = rl.entity_id join entity e on e.client_id = c.client_id where status = 'NEEDS_REVIEW' group by 1
            union all select entity_id, 'OVERPAID_CONTACTS', count(*) from (select entity_id, contact_id from item group by all having sum(open) < 0) group by 1
            union all select entity_id, 'EMPTY_MONTH', 1 from (select entity_id, max(day) as last from journal where day <= date '1998-08-31' group by 1) where last < date '1998-08-01'
            union all select e.entity_id, 'INTERCOMPANY', 1 from entity e join (select client_id from journal where account = '1190' and day <= date '1998-06-30' group by 1 having sum(debit - credit) <> 0) x on x.client_id = e.client_id
            union all select entity_id, 'MISSING_RATES', 1 from entity where currency <> 'IDR' and not exists (select 1 from rates where kind = 'SPOT' and rate_date between date '1998-08-01' and date '1998-08-31'))
        select e.client_id, e.entity_id, k.check_key, case when coalesce(n, 0) > 0 then 'REVIEW' else 'PASS' end as status, coalesce(n, 0)::bigint as n
        from entity e, unnest(['FINANCING_TEXT', 'ACCEPTED_GUESSES', 'UNCLASSIFIED', 'OVERPAID_CONTACTS', 'EMPTY_MONTH', 'INTERCOMPANY', 'MISSING_RATES']) k(check_key) left join found f on f.entity_id = e.entity_id and f.check_key = k.check_key""",
    ),
)
def a47_counted(b):
    lines, entities = reviewed_lines(b), b.entity()
    flagged = rv.flagged_lines(lines, b.chart())
    clients = entities.select("entity_id", "client_id")
    of_client = lambda rows: rows.select("client_id", "n").join(clients, "client_id")
    waiting = of_client(lines.filter("status = 'NEEDS_REVIEW'").groupBy("client_id").agg(F.count("*").alias("n")))
    overpaid = open_items(b.invoice(), b.settlement(), "1998-06-30").groupBy("entity_id", "contact_id").agg(F.sum("open").alias("open")).filter("open < 0")
    residual = b.journal_line(("1190",)).filter("day <= '1998-06-30'").groupBy("client_id").agg(F.sum(F.col("debit") - F.col("credit")).alias("net")).filter("net <> 0").withColumn("n", F.lit(1).cast("long"))
    rates = b.rates().filter("kind = 'SPOT' and rate_date between '1998-08-01' and '1998-08-31'").select(F.lit("IDR").alias("_quote")).distinct()
    foreign = entities.filter("currency <> 'IDR'").join(rates, F.col("_quote") == "IDR", "left_anti")
    findings = [
        ("FINANCING_TEXT", "REVIEW", flagged.filter("flag = 'FINANCING'")),
        ("ACCEPTED_GUESSES", "REVIEW", flagged.filter("flag = 'GUESS'")),
        ("UNCLASSIFIED", "REVIEW", waiting),
        ("OVERPAID_CONTACTS", "REVIEW", overpaid),
        ("EMPTY_MONTH", "REVIEW", rv.empty_months(b.journal_line(), 1998 * 12 + 7)),
        ("INTERCOMPANY", "REVIEW", of_client(residual)),
        ("MISSING_RATES", "REVIEW", foreign),
    ]
    return rv.counted_controls(clients, findings)
