"""The derived tables in DuckDB's SQL, written apart from the DataFrame plans they check."""

from __future__ import annotations

from .model import CHART, RATES

values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)

VIEWS = {
    "chart": f"select * from (values {values(CHART)}) t(account, account_name, type, fs_line, kind)",
    "rates": f"select day::date as rate_date, kind, rate::bigint as rate from (values {values(RATES)}) t(day, kind, rate)",
    "entity": """
        select n_nationkey as entity_id, n_regionkey as client_id, n_name as entity_name,
               case when n_nationkey % 4 = 3 then 'INDIVIDUAL' else 'COMPANY' end as kind,
               case when n_nationkey >= 20 then 'USD' else 'IDR' end as currency, (n_nationkey + 5) % 25 as partner_id
        from nation""",
    "contact": """
        select c_custkey as contact_id, c_name as contact_name, c_nationkey as entity_id, c_nationkey % 5 as client_id,
               c_mktsegment as channel, round(c_acctbal * 100)::bigint as advance
        from customer""",
    "ord": """
        select o_orderkey as order_id, o_custkey as contact_id, c.entity_id, c.client_id, c.channel, o_orderdate::date as day,
               round(o_totalprice * 100)::bigint as total, o_orderstatus as status, o_orderpriority[1] as priority
        from orders join contact c on c.contact_id = o_custkey""",
    "sale": """
        select order_id, ship_day, net, (net * t * 2 + 100) // 200 as tax, net * 6 // 10 as cost, returned, line_status, part_id, supplier_id
        from (select l_orderkey as order_id, l_shipdate::date as ship_day,
                     (round(l_extendedprice * 100)::bigint * (100 - round(l_discount * 100)::bigint) * 2 + 100) // 200 as net,
                     round(l_tax * 100)::bigint as t, l_returnflag = 'R' as returned, l_linestatus as line_status,
                     l_partkey as part_id, l_suppkey as supplier_id
              from lineitem)""",
    "journal": """
        with s as (
            select order_id, ship_day, sum(net)::bigint as net, sum(tax)::bigint as tax, sum(cost)::bigint as cost,
                   sum(case when returned then net else 0 end)::bigint as returned
            from sale group by all),
        e as (
            select 'S' || s.order_id || '-' || s.ship_day as entry_id, 'INVOICE' as entry_kind, o.client_id, o.entity_id, s.ship_day as day, o.contact_id,
                   unnest(['1130', '4100', '2130', '5100', '1200', '7100', '6100', '2100']) as account,
                   unnest([net + tax, -net, -tax, cost, -cost, returned // 10, net // 50, -(returned // 10 + net // 50)]) as amount
            from s join ord o on o.order_id = s.order_id
            union all
            select 'C' || order_id, 'BANK', client_id, entity_id, day, contact_id, unnest(['1100', '1130']),
                   unnest([1, -1]) * case status when 'F' then total when 'P' then total // 2 else 0 end from ord
            union all
            select 'P' || order_id, 'MANUAL', client_id, entity_id, day, contact_id, unnest(['1200', '1100', '2100']),
                   unnest([total // 2, -(total // 4), total // 4 - total // 2]) from ord
            union all
            select 'T' || order_id, 'BANK', client_id, entity_id, day, contact_id, unnest(['1190', '1100']), unnest([1, -1]) * (total // 10) from ord where priority = '1'
            union all
            select 'U' || order_id, 'BANK', o.client_id, n.partner_id, day, contact_id, unnest(['1100', '1190']), unnest([1, -1]) * (total // 10)
            from ord o join entity n on n.entity_id = o.entity_id where priority = '1')
        select entry_id, entry_kind, client_id, entity_id, day, (year(day) * 12 + month(day) - 1)::int as month, account,
               greatest(amount, 0)::bigint as debit, greatest(-amount, 0)::bigint as credit, contact_id
        from e where amount <> 0""",
    "invoice": """
        select order_id as invoice_id, contact_id, entity_id, client_id, channel, day as issue_date, (day + interval 30 day)::date as due_date, total from ord""",
    "settlement": """
        select s.order_id as invoice_id, greatest(o.day, s.ship_day) as paid_on, o.total // 8 as amount
        from sale s join ord o on o.order_id = s.order_id""",
    "bank_line": """
        select event_id as line_id, (user_id % 12)::int as bank_account, (user_id % 4 * 5)::int as entity_id, 0 as client_id, ts::date as day, ts,
               case when event_type in ('purchase', 'error') then -1 else 1 end * round(value * 100)::bigint as amount,
               case event_type when 'purchase' then 'PAYMENT' when 'error' then 'TRSF E-BANKING DB' when 'click' then 'TRANSFER CR' else 'SETORAN' end
                   || ' ' || lpad(json_extract_string(props, '$.k'), 4, '0') || '-' || (user_id % 90 + 10)
                   || case json_extract_string(props, '$.k')::int % 3 when 0 then ' REKENING SENDIRI' when 1 then '' else ' PT ' || upper(event_type) || ' JAYA' end as description,
               json_extract_string(props, '$.k')::int as k
        from events""",
    "tb": """
        select c.client_id, a.account, a.account_name, a.type, a.fs_line, a.kind, coalesce(s.net, 0)::bigint as net
        from (select distinct client_id from journal where day <= date '{as_of}') c cross join chart a
        left join (
            select j.client_id, case when a.type in ('INCOME', 'EXPENSE') and j.day < date '{year}-01-01' then '3200' else j.account end as account, sum(j.debit - j.credit) as net
            from journal j join chart a on a.account = j.account where j.day <= date '{as_of}' group by all) s
        on s.client_id = c.client_id and s.account = a.account""",
    "tbe": """
        select c.client_id, c.entity_id, a.account, a.account_name, a.type, a.fs_line, a.kind, coalesce(s.net, 0)::bigint as net
        from (select distinct client_id, entity_id from journal where day <= date '{as_of}') c cross join chart a
        left join (
            select j.entity_id, case when a.type in ('INCOME', 'EXPENSE') and j.day < date '{year}-01-01' then '3200' else j.account end as account, sum(j.debit - j.credit) as net
            from journal j join chart a on a.account = j.account where j.day <= date '{as_of}' group by all) s
        on s.entity_id = c.entity_id and s.account = a.account""",
    "item": """
        select i.*, coalesce(s.settled, 0)::bigint as settled, (i.total - coalesce(s.settled, 0))::bigint as open, (date '{as_of}' - i.due_date)::int as days_past_due,
               case when date '{as_of}' - i.due_date <= 0 then 'CURRENT' when date '{as_of}' - i.due_date <= 30 then 'D1_30'
                    when date '{as_of}' - i.due_date <= 60 then 'D31_60' when date '{as_of}' - i.due_date <= 90 then 'D61_90' else 'OVER_90' end as bucket
        from invoice i left join (select invoice_id, sum(amount) as settled from settlement where paid_on <= date '{as_of}' group by 1) s using (invoice_id)
        where i.issue_date <= date '{as_of}'""",
}
NEEDS = {
    "ord": ["contact"], "journal": ["sale", "ord", "entity"], "invoice": ["ord"], "settlement": ["sale", "ord"],
    "tb": ["journal", "chart"], "tbe": ["journal", "chart"], "item": ["invoice", "settlement"],
}


def with_views(names: str, body: str, as_of: str = "1998-06-30") -> str:
    """A statement over the named views and what they need."""
    order: list[str] = []

    def add(name):
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names.split():
        add(n)
    fill = lambda s: s.replace("{as_of}", as_of).replace("{year}", as_of[:4])
    head = ", ".join(f"{n} as ({fill(VIEWS[n])})" for n in order)
    body = fill(body).strip()
    return f"with {head}, {body[5:]}" if body.startswith("with ") else f"with {head} {body}"
