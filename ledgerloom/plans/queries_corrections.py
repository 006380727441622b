"""Benefits, corrections of suspense, removals of imports and suggestions against the books."""

from pyspark.sql import functions as F

from ..operators import benefits as p
from ..operators import corrections as c
from .catalog import register
from .oracle import with_views


def staff(b):
    """Customers as employees of their nation."""
    k = F.col("c_custkey")
    hired = F.date_sub(F.lit("1998-06-30").cast("date"), (k * 7919 % 11000 + 1).cast("int"))
    rows = b.read("customer").select(
        k.alias("employee_id"), F.col("c_nationkey").alias("entity_id"), F.when(k % 2 == 0, "F").otherwise("M").alias("sex"),
        hired.alias("hired"), (F.abs(F.round(F.col("c_acctbal") * 100).cast("long")) * 10 + 5_000_000).alias("wage"), (18 * 365 + k * 104729 % 8000).cast("int").alias("_young"),
    )
    left = F.when(F.col("employee_id") % 7 == 0, F.date_add("hired", (F.col("employee_id") * 31 % 9000 + 100).cast("int")))
    return rows.withColumn("birth", F.date_sub("hired", F.col("_young"))).withColumn("left_on", left).drop("_young")


def settings(b):
    k = F.col("n_nationkey")
    return b.read("nation").select(
        k.alias("entity_id"), ((50 + k % 5 * 5) / F.lit(1000.0)).alias("discount"), ((30 + k % 4 * 10) / F.lit(1000.0)).alias("salary"), F.lit(0.1).alias("disability"),
        F.lit(0.05).alias("resign"), (55 + k % 4).cast("int").alias("retirement_age"), F.lit(30).alias("flat_until"), (50 + k % 3).cast("int").alias("zero_age"),
    )


def mortality(b):
    """Rates by a rule: rising by a twelfth part a year, for men by a fifth more."""
    rate = lambda x: F.when(F.col("sex") == "M", 1.2).otherwise(1.0) * 0.0004 * F.pow(F.lit(1.085), x)
    rows = b.spark.createDataFrame([("F",), ("M",)], "sex string").withColumn("age", F.explode(F.sequence(F.lit(0), F.lit(111))))
    return rows.withColumn("qx", F.least(F.lit(1.0), F.round(rate(F.col("age")), 6)))


VALUED = """staff as (select c_custkey as employee_id, c_nationkey as entity_id, case when c_custkey % 2 = 0 then 'F' else 'M' end as sex, date '1998-06-30' - (c_custkey * 7919 % 11000 + 1)::int as hired,
             abs(round(c_acctbal * 100)::bigint) * 10 + 5000000 as wage, (18 * 365 + c_custkey * 104729 % 8000)::int as young from customer),
    people as (select *, hired - young as birth, case when employee_id % 7 = 0 then hired + (employee_id * 31 % 9000 + 100)::int end as left_on from staff),
    terms as (select n_nationkey as entity_id, (50 + n_nationkey % 5 * 5) / 1000.0::double as discount, (30 + n_nationkey % 4 * 10) / 1000.0::double as salary, 55 + n_nationkey % 4 as retire, 50 + n_nationkey % 3 as zero from nation),
    qx as (select sex, age, least(1.0::double, round(case sex when 'M' then 1.2::double else 1.0::double end * 0.0004::double * pow(1.085::double, age), 6)) as q from (select unnest(['F', 'M']) as sex), (select unnest(range(112)) as age)),
    cases as ({cases}),
    e as (select p.*, c.name, c.valued_on, greatest(0, t.discount + c.dd) as d, greatest(0, t.salary + c.ds) as g, t.retire, t.zero, (valued_on - birth) / 365.25::double as age, (valued_on - hired) / 365.25::double as service
          from people p join terms t using (entity_id), cases c),
    y as (select employee_id, name, 0 as t, 1.0::double as alive, 0.0::double as dbo, 0.0::double as nxt, age, service, d, g, retire, zero, sex, retire - age as n from e where retire > age
          union all
          select employee_id, name, t + 1, alive * greatest(0, 1 - ex - w * span), dbo + value * greatest(0, least(1, (0 - start) / (mid - start))), nxt + value * greatest(0, least(1, (least(1, mid) - start) / (mid - start))), age, service, d, g, retire, zero, sex, n
          from (select *, greatest(-service, mid - 24) as start, alive * ex * (2 * least(9, floor(service + mid) + 1) + {reward}) * pow(1 + g, mid) * pow(1 + d, -mid) as value
                from (select y.*, least(1, n - t) as span, t + least(1, n - t) / 2 as mid, least(1, q * least(1, n - t)) * 1.1::double as ex,
                             case when y.age + t <= 30 then 0.05::double when y.age + t >= zero then 0 else 0.05::double * (zero - (y.age + t)) / (zero - 30) end as w
                      from y join qx on qx.sex = y.sex and qx.age = least(111, floor(y.age + t)) where t < n))),
    z as (select employee_id, name, n, dbo, nxt, alive * (1.75 * least(9, floor(service + n) + 1) + {reward_end}) as benefit, alive, pow(1 + g, n) as grown, pow(1 + d, -n) as disc, greatest(-service, n - 24) as start,
                 1.75 * least(9, floor(service + n) + 1) + {reward_end} as months from y where t >= n),
    f as (select employee_id, name, n as years, months * grown as benefit, dbo + benefit * grown * disc * greatest(0, least(1, (0 - start) / (n - start))) as dbo,
                 nxt + benefit * grown * disc * greatest(0, least(1, (least(1, n) - start) / (n - start))) as nxt from z
          union all select employee_id, name, 0, months, months, months from (select employee_id, name, 1.75 * least(9, floor(service) + 1) + {reward_now} as months from e where retire <= age)),
    v as (select e.*, years, (wage::hugeint * floor(f.benefit * 1e9 + 0.5)::hugeint * 2 + 1000000000) // 2000000000 as benefit_at_retirement, (wage::hugeint * floor(f.dbo * 1e9 + 0.5)::hugeint * 2 + 1000000000) // 2000000000 as dbo,
                 (wage::hugeint * floor((f.nxt - f.dbo) * 1e9 + 0.5)::hugeint * 2 + 1000000000) // 2000000000 as cost from e join f using (employee_id, name))"""


def valued(cases: str) -> str:
    reward = lambda at: "case " + " ".join(f"when {at} >= {y} then {m}" for y, m in p.REWARD) + " else 0 end"
    return VALUED.replace("{cases}", cases).replace("{reward}", reward("service + mid")).replace("{reward_end}", reward("service + n")).replace("{reward_now}", reward("service"))


@register(
    "w12_valued_employees",
    f"""with recursive {valued("select 'now' as name, date '1998-06-30' as valued_on, 0.0 as dd, 0.0 as ds")}
    select employee_id, entity_id, round(years, 9)::double as years_to_retirement, benefit_at_retirement::bigint as benefit_at_retirement, dbo::bigint as dbo, cost::bigint as service_cost from v""",
)
def w12(b):
    rows = staff(b).withColumn("valued_on", F.lit("1998-06-30").cast("date"))
    found = p.valued_employees(rows, settings(b), mortality(b))
    return found.select("employee_id", "entity_id", F.round("years_to_retirement", 9).alias("years_to_retirement"), "benefit_at_retirement", "dbo", "service_cost")


def benefit_books(b):
    """Purchases as if they had been booked on benefits: payables on the liability, stock on the expense."""
    rows = b.journal_line(("1200", "2100")).filter("entry_kind = 'MANUAL'")
    account = F.when(F.col("account") == "1200", p.EXPENSE).otherwise(p.LIABILITY)
    return rows.withColumn("account", account).withColumn("entry_kind", F.when(F.col("entity_id") % 2 == 0, "BENEFIT").otherwise("MANUAL"))


@register(
    "x7_valuations",
    with_views(
        "journal",
        f"""with recursive {valued('''select unnest(['now', 'open', 'discount_up', 'discount_down', 'salary_up', 'salary_down']) as name,
            unnest([date '1998-06-30', date '1997-12-31', date '1998-06-30', date '1998-06-30', date '1998-06-30', date '1998-06-30']) as valued_on,
            unnest([0.0, 0.0, 0.01, -0.01, 0.0, 0.0])::double as dd, unnest([0.0, 0.0, 0.0, 0.0, 0.01, -0.01])::double as ds''')},
        s as (select entity_id, count(*) filter (name = 'now') as n_employees, {", ".join(f"coalesce(sum({x}) filter ({w}), 0)::bigint as {a}" for x, w, a in [
            ("dbo", "name = 'now'", "dbo"), ("cost", "name = 'now'", "service_cost"), ("dbo", "name = 'open'", "opening_dbo"), ("cost", "name = 'open'", "opening_cost"),
            ("dbo", "name = 'now' and hired > date '1997-12-31'", "hired_dbo"), *[("dbo", f"name = '{n}'", n) for n in ("discount_up", "discount_down", "salary_up", "salary_down")]])}
            from v where hired <= valued_on and (left_on is null or left_on > valued_on) group by 1),
        k as (select entity_id, sum(case when account = '2100' then credit - debit else 0 end)::bigint as held, sum(case when account = '2100' and day <= date '1997-12-31' then credit - debit else 0 end)::bigint as held_before,
                     sum(case when account = '1200' and day >= date '1998-01-01' then debit - credit else 0 end)::bigint as booked, bool_or(entity_id % 2 = 0 and day <= date '1997-12-31') as earlier
              from journal where entry_kind = 'MANUAL' and account in ('1200', '2100') and day <= date '1998-06-30' group by 1),
        r as (select s.*, coalesce(held, 0) as held, coalesce(held_before, 0) as held_before, coalesce(booked, 0) as booked, coalesce(earlier, false) as earlier,
                     ((dbo + service_cost)::hugeint * bp * 2 + 10000) // 20000 as interest_cost, ((opening_dbo + opening_cost)::hugeint * bp * 2 + 10000) // 20000 as opening_interest
              from s join (select entity_id, round(discount * 10000)::bigint as bp from terms) using (entity_id) left join k using (entity_id)),
        t as (select *, ((opening_cost + opening_interest) * 6 * 2 + 12) // 24 + hired_dbo as expense_target, case when earlier then 0 else opening_dbo - held_before end as retained from r)
        select entity_id, n_employees, dbo, service_cost, interest_cost::bigint as interest_cost, opening_dbo, opening_cost, opening_interest::bigint as opening_interest, expense_target::bigint as expense_target,
               discount_up, discount_down, salary_up, salary_down, (expense_target - booked)::bigint as expense, retained::bigint as retained,
               (dbo - held - (expense_target - booked) - retained)::bigint as remeasurement, (held - dbo)::bigint as liability from t""",
    ).replace("with sale as", "with recursive sale as").replace(", recursive ", ", "),
)
def x7(b):
    return p.valuations(staff(b), settings(b), mortality(b), benefit_books(b), 1998, 6)


def with_differences(b):
    """The purchases, of which every fourth has its payable as a source difference on suspense, and an old balance of every third entity."""
    rows = b.journal_line().filter("entry_kind = 'MANUAL'").withColumn("n", F.expr("try_cast(substring(entry_id, 2) as bigint)"))
    turned = (F.col("account") == "2100") & (F.col("n") % 4 == 0)
    rows = rows.withColumn("line_id", F.concat_ws("-", "entry_id", "account")).withColumn("source", turned).withColumn("account", F.when(turned, c.SUSPENSE).otherwise(F.col("account")))
    old = b.entity().filter("entity_id % 3 = 0").select(
        F.concat(F.lit("old-"), "entity_id").alias("line_id"), F.lit("old").alias("entry_id"), F.lit("MANUAL").alias("entry_kind"), "entity_id", F.lit("1993-01-01").cast("date").alias("day"),
        F.lit(c.SUSPENSE).alias("account"), F.lit(10**13).cast("long").alias("debit"), F.lit(0).cast("long").alias("credit"), F.lit(False).alias("source"),
    )
    lines = rows.select(*old.columns).unionByName(old)
    return lines, rows.filter("source and n % 16 = 0").select("line_id")


@register(
    "t15_suspense_corrections",
    with_views(
        "journal entity",
        """with j as (select *, entry_id[2:]::bigint as n from journal where entry_kind = 'MANUAL'),
        l as (select entry_id || '-' || account as line_id, entry_id, entity_id, day, case when account = '2100' and n % 4 = 0 then '1999' else account end as account, debit, credit, account = '2100' and n % 4 = 0 as source, n from j
              union all select 'old-' || entity_id, 'old', entity_id, date '1993-01-01', '1999', 10000000000000, 0, false, null from entity where entity_id % 3 = 0),
        o as (select entity_id, sum(debit - credit)::bigint as rest from l where account = '1999' and day <= date '1995-03-31' group by 1),
        w as (select l.*, debit - credit as amount, rest from l join o using (entity_id) where source and day between date '1995-03-01' and date '1995-03-31'),
        f as (select * from w where n % 16 <> 0 and case when amount > 0 then rest >= amount else rest <= amount end),
        x as (select f.line_id, case when count(*) = 1 then min(l.account) end as counter from f join l on l.entry_id = f.entry_id and l.account <> '1999' and abs(f.amount) in (l.debit, l.credit) group by 1)
        select entity_id, f.line_id, entry_id, amount, counter from f left join x using (line_id)
        union all select entity_id, null, arg_max(entry_id, (day, line_id)), any_value(rest), null from w where entity_id not in (select entity_id from f) and rest <> 0 group by 1""",
    ),
)
def t15(b):
    lines, decided = with_differences(b)
    return c.suspense_corrections(lines, decided, "1995-03-01", "1995-03-31")


def imported(b):
    """Cash entries as statements and purchases as ledger files, by entity and month, and what rests on some of them."""
    lines = b.journal_line().filter("entry_kind in ('BANK', 'MANUAL') and (entry_id like 'C%' or entry_id like 'P%')").withColumn("n", F.expr("try_cast(substring(entry_id, 2) as bigint)"))
    lines = lines.withColumn("kind", F.substring("entry_id", 1, 1)).withColumn("import_id", F.concat_ws("-", "kind", "entity_id", "month"))
    lines = lines.withColumn("entry_kind", F.when((F.col("kind") == "P") & (F.col("n") % 503 == 0), "OPENING").otherwise(F.col("entry_kind")))
    imports = lines.groupBy("import_id").agg(F.min("entity_id").alias("entity_id"), F.when(F.min("kind") == "C", "STATEMENT").otherwise("LEDGER").alias("kind"), F.when(F.min("month") % 11 == 0, "DRAFT").otherwise("POSTED").alias("status"))
    heads = lines.select("entry_id", "entity_id", "kind", "n", "day").distinct()
    word = (
        F.when((F.col("kind") == "C") & (F.col("n") % 97 == 0), "SETTLEMENT").when((F.col("kind") == "P") & (F.col("n") % 211 == 0), "SCHEDULE")
        .when((F.col("kind") == "P") & (F.col("n") % 307 == 0), "REVERSAL").when((F.col("kind") == "C") & (F.col("n") % 101 == 0), "PAIR")
    )
    none = F.lit(None).cast("string")
    rests = heads.withColumn("kind", word).filter("kind is not null").select("kind", F.concat_ws(" ", F.lower("kind"), F.col("n").cast("string")).alias("name"), "entry_id", "entity_id", F.date_add("day", 20).alias("day"), none.alias("import_id"))
    per = b.entity().select("entity_id")
    assets = per.filter("entity_id % 4 = 1").select(F.lit("OLD_ASSET").alias("kind"), F.concat(F.lit("asset "), "entity_id").alias("name"), none.alias("entry_id"), "entity_id", F.lit(None).cast("date").alias("day"), none.alias("import_id"))
    bridge = per.filter("entity_id = 3").select(F.lit("BRIDGE").alias("kind"), F.lit("opening of 1994").alias("name"), none.alias("entry_id"), "entity_id", F.lit("1994-12-31").cast("date").alias("day"), F.lit("P-3-23940").alias("import_id"))
    locked = per.filter("entity_id % 5 = 2").select("entity_id", F.explode(F.sequence(F.lit(1992 * 12), F.lit(1993 * 12 + 5))).alias("month"))
    return imports, lines.select("import_id", "entry_id", "entity_id", "entry_kind", "day", "account", "debit", "credit"), rests.unionByName(assets).unionByName(bridge), locked


IMPORTED = """l as (select case when entry_id[1] = 'P' and entry_id[2:]::bigint % 503 = 0 then 'OPENING' else entry_kind end as kind_, entry_id[1] as k, try_cast(entry_id[2:] as bigint) as n, entry_id[1] || '-' || entity_id || '-' || month as import_id, *
          from journal where entry_id[1] in ('C', 'P')),
    h as (select distinct import_id, entry_id, entity_id, k, n, day, month from l),
    shut as (select e.entity_id, m::int as month from entity e, (select unnest(range(1992 * 12, 1993 * 12 + 6)) as m) where e.entity_id % 5 = 2),
    why as (
        select distinct import_id, 1 as rank, 'DRAFT' as reason, null as name from l where k = 'P' and month % 11 = 0
        union select import_id, 2, 'SETTLED', 'settlement ' || n from h where k = 'C' and n % 97 = 0
        union select import_id, 3, 'LOCKED', (h.month // 12) || '-' || lpad((h.month % 12 + 1)::varchar, 2, '0') from h join shut using (entity_id, month)
        union select import_id, 4, 'RESTING', 'schedule ' || n from h where k = 'P' and n % 211 = 0
        union select import_id, 5, 'REVERSED', 'reversal ' || n from h where k = 'P' and n % 307 = 0 and n % 211 <> 0
        union select import_id, 6, 'OPENING', 'asset ' || entity_id from l where kind_ = 'OPENING' and entity_id % 4 = 1
        union select import_id, 7, 'BRIDGE', 'opening of 1994' from h where entity_id = 3 and day <= date '1994-12-31' and import_id <> 'P-3-23940'
        union select import_id, 8, 'PAIR', 'pair ' || n from h join shut s on s.entity_id = h.entity_id and s.month = year(day + 20) * 12 + month(day + 20) - 1 where k = 'C' and n % 101 = 0 and n % 97 <> 0),
    w as (select import_id, rank, reason, count(name) as n_names, coalesce(array_to_string(list_sort(list(name) filter (name is not null))[1:3], ', '), '') as names from why group by all),
    r as (select import_id, arg_min(reason, rank) as reason, arg_min(names, rank) as names, arg_min(n_names, rank) as n_names from w group by 1)"""


@register(
    "t14_import_removals",
    with_views(
        "journal entity",
        f"""with {IMPORTED}
        select import_id, n_entries, n_lines, reason, names, coalesce(n_names, 0) as n_names from (select import_id, count(distinct entry_id) as n_entries, count(*) as n_lines from l group by 1) left join r using (import_id)""",
    ),
)
def t14(b):
    return c.import_removals(*imported(b))[0]


@register(
    "t14_removed_nets",
    with_views("journal entity", f"with {IMPORTED} select import_id, account, sum(debit - credit)::bigint as net from l where import_id not in (select import_id from r) group by all having sum(debit - credit) <> 0"),
)
def t14_nets(b):
    return c.import_removals(*imported(b))[1]


@register(
    "c6_backed_suggestions",
    with_views(
        "bank_line journal",
        """with s as (select line_id, entity_id, (date '1992-01-01' + (line_id % 400)::int)::date as day, amount, case when line_id % 2 = 0 then '1130' else '2100' end as account, case when line_id % 3 = 0 then 'RULE' else 'AI' end as method from bank_line),
        d as (select entity_id, day, sum(case when account = '1130' then debit - credit else 0 end) as r, sum(case when account = '2100' then credit - debit else 0 end) as p from journal where account in ('1130', '2100') group by all),
        c as (select entity_id, day, sum(r) over w as r, sum(p) over w as p from d window w as (partition by entity_id order by day)),
        m as (select s.*, case when method = 'AI' and amount > 0 and account = '1130' and coalesce(c.r, 0) <= 0 then 'NO_RECEIVABLE' when method = 'AI' and amount < 0 and account = '2100' and coalesce(c.p, 0) <= 0 then 'NO_PAYABLE' end as reason
              from s asof left join c on c.entity_id = s.entity_id and s.day >= c.day)
        select line_id, entity_id, day, amount, account, method, case when reason is null then 85 else 55 end::int as confidence_pct, reason from m""",
    ),
)
def c6(b):
    n = F.col("line_id")
    asked = b.bank_line().select(
        "line_id", "entity_id", F.date_add(F.lit("1992-01-01").cast("date"), (n % 400).cast("int")).alias("day"), "amount", F.when(n % 2 == 0, "1130").otherwise("2100").alias("account"),
        F.when(n % 3 == 0, "RULE").otherwise("AI").alias("method"), F.lit(85).alias("confidence_pct"),
    )
    return c.backed_suggestions(asked, b.journal_line(("1130", "2100")), b.chart())
