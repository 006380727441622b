"""Open items, aging, allowances and settlement."""

from pyspark.sql import functions as F

from ..functions.text import normal_name
from ..operators import receivables as ar
from .catalog import register
from .oracle import with_views

AS_OF = "1998-06-30"


def items(b):
    return ar.open_items(b.invoice(), b.settlement(), AS_OF)


@register("a28_open_items", with_views("item", "select * from item"))
def a28(b):
    return items(b)


@register(
    "a29_aging_by_contact",
    with_views(
        "item",
        "select client_id, contact_id, "
        + ", ".join(f"coalesce(sum(open) filter (bucket = '{k}'), 0)::bigint as {k.lower()}" for k in ar.BUCKETS)
        + ", sum(open)::bigint as total, count(*) as n_items from item where open > 0 group by all",
    ),
)
def a29(b):
    return ar.aging_by_contact(items(b))


@register("a30_unallocated_cash", with_views("item", "select client_id, contact_id, sum(-open)::bigint as free, count(*) as n_items from item where open < 0 group by all"))
def a30(b):
    return ar.unallocated(b.settlement(), b.invoice(), AS_OF)


@register(
    "a31_subledger_proof",
    with_views(
        "item journal",
        """select coalesce(s.entity_id, l.entity_id) as entity_id, coalesce(subledger, 0)::bigint as subledger, coalesce(ledger, 0)::bigint as ledger, (coalesce(subledger, 0) - coalesce(ledger, 0))::bigint as difference
        from (select entity_id, sum(open) as subledger from item group by 1) s
        full join (select entity_id, sum(debit - credit) as ledger from journal where account = '1130' and day <= date '{as_of}' group by 1) l on l.entity_id = s.entity_id""",
    ),
)
def a31(b):
    return ar.subledger_proof(b.journal_line(("1130",)), items(b), "1130", AS_OF)


@register(
    "a32_sales_by_channel",
    with_views(
        "invoice",
        """select client_id, coalesce(channel, 'NONE') as channel, coalesce(sum(total) filter (month(issue_date) = 6), 0)::bigint as month_sales, sum(total)::bigint as year_sales, count(*) as n_invoices
        from invoice where year(issue_date) = 1998 and month(issue_date) <= 6 group by all""",
    ),
)
def a32(b):
    return ar.sales_by_channel(b.invoice(), "1998-06-01")


@register(
    "a54_receivables_view",
    with_views(
        "item contact",
        """select coalesce(a.contact_id, c.contact_id) as contact_id, coalesce(total, 0)::bigint as total, coalesce(advance, 0)::bigint as advance, (coalesce(total, 0) - coalesce(advance, 0))::bigint as net
        from (select contact_id, sum(open) as total from item where open > 0 group by 1) a
        full join (select contact_id, advance from contact where advance > 0) c on c.contact_id = a.contact_id""",
    ),
)
def a54(b):
    return ar.receivables_view(items(b), b.contact())


ROLL = """
    with me as (select m, last_day(make_date(m // 12, m % 12 + 1, 1)) as e from (select unnest(range(1998 * 12 + 5 - 12, 1998 * 12 + 6)) as m)),
    st as (
        select i.client_id, i.invoice_id, i.due_date, i.total, me.m, me.e,
               i.total - coalesce((select sum(amount) from settlement s where s.invoice_id = i.invoice_id and s.paid_on <= me.e), 0) as open,
               case when me.e - i.due_date <= 0 then 1 when me.e - i.due_date <= 30 then 2 when me.e - i.due_date <= 60 then 3 when me.e - i.due_date <= 90 then 4 else 5 end as b
        from invoice i join me on i.issue_date <= me.e),
    pr as (
        select x.client_id, x.b, x.m, sum(x.open)::hugeint as base, sum(greatest(0, least(x.open, y.open)))::hugeint as rolled
        from st x join st y on y.invoice_id = x.invoice_id and y.m = x.m + 1 where x.open > 0 and y.b > x.b group by all),
    rr as (
        select client_id, ['CURRENT', 'D1_30', 'D31_60', 'D61_90'][b] as from_bucket, ((sum(p) * 2 + count(*)) // (2 * count(*)))::bigint as ppm, count(*) as samples
        from (select *, (rolled * 2000000 + base) // (2 * base) as p from pr) group by all)"""


@register("a41_roll_rates", with_views("invoice settlement", "select * from rr").replace(" select * from rr", ", " + ROLL.strip()[5:] + " select * from rr"))
def a41(b):
    return ar.roll_rates(b.invoice(), b.settlement(), "1998-06-01")


LOSS = """
    , w as (select client_id, max(ppm) filter (from_bucket = 'CURRENT') as r1, max(ppm) filter (from_bucket = 'D1_30') as r2, max(ppm) filter (from_bucket = 'D31_60') as r3, max(ppm) filter (from_bucket = 'D61_90') as r4 from rr group by 1),
    l4 as (select *, case when r4 = 0 then 0 else (r4 * 1000000 * 2 + 1000000) // 2000000 end as v4 from w),
    l3 as (select *, case when r3 = 0 then 0 else (r3 * v4 * 2 + 1000000) // 2000000 end as v3 from l4),
    l2 as (select *, case when r2 = 0 then 0 else (r2 * v3 * 2 + 1000000) // 2000000 end as v2 from l3),
    l1 as (select *, case when r1 = 0 then 0 else (r1 * v2 * 2 + 1000000) // 2000000 end as v1 from l2),
    lr as (select client_id, unnest(['OVER_90', 'D61_90', 'D31_60', 'D1_30', 'CURRENT']) as bucket, unnest([1000000, v4, v3, v2, v1])::bigint as loss_ppm from l1)"""


@register("a42_loss_rates", with_views("invoice settlement", "select 1").replace(" select 1", ", " + ROLL.strip()[5:] + LOSS + " select * from lr"))
def a42(b):
    return ar.loss_rates(ar.roll_rates(b.invoice(), b.settlement(), "1998-06-01"))


@register(
    "a43_allowance",
    with_views("item", "select 1").replace(
        " select 1",
        ", "
        + ROLL.strip()[5:]
        + LOSS
        + """ select lr.client_id, lr.bucket, coalesce(o.open, 0)::bigint as open, loss_ppm,
        case when loss_ppm is null then case when coalesce(o.open, 0) > 0 then null else 0 end else ((coalesce(o.open, 0)::hugeint * loss_ppm * 10500 * 2 + 10000000000) // 20000000000)::bigint end as allowance
        from lr left join (select client_id, bucket, sum(open) as open from item where open > 0 group by all) o on o.client_id = lr.client_id and o.bucket = lr.bucket""",
    ),
)
def a43(b):
    return ar.allowance(items(b), ar.loss_rates(ar.roll_rates(b.invoice(), b.settlement(), "1998-06-01")), 10_500)


def receipts(b):
    return b.contact().filter("advance > 0").select("contact_id", (F.col("advance") * 40).alias("receipt"))


@register(
    "j18_fifo_allocation",
    with_views(
        "invoice contact",
        """select contact_id, invoice_id, total, greatest(0, least(total, receipt - c + total))::bigint as allocated from (
        select i.contact_id, invoice_id, total, advance * 40 as receipt, sum(total) over (partition by i.contact_id order by due_date, invoice_id) as c
        from invoice i join contact k on k.contact_id = i.contact_id where advance > 0 and total > 0) where receipt - c + total > 0""",
    ),
)
def j18(b):
    return ar.fifo_allocation(receipts(b), b.invoice())


@register(
    "j17_settlement_candidates",
    with_views(
        "item contact",
        r"""with r as (select contact_id, entity_id, advance * 40 as receipt, list_filter(regexp_split_to_array(upper(contact_name), '[^A-Z0-9]+'), lambda w: w <> '') as said from contact where advance > 0),
        i as (select i.*, list_filter(regexp_split_to_array(upper(contact_name), '[^A-Z0-9]+'), lambda w: len(w) >= 3) as name, i.invoice_id::varchar as number from item i join contact using (contact_id) where open > 0),
        p as (
            select r.contact_id as receipt_id, r.contact_id, r.receipt, i.invoice_id, i.contact_id as item_contact_id, i.open, i.contact_id = r.contact_id as same_contact, i.open = r.receipt as exact,
                   len(name) > 0 and list_has_all(said, name) or len(number) >= 3 and list_contains(said, number) as named,
                   case when i.open = r.receipt then 2 when i.open > r.receipt then 1 else 0 end as score, i.due_date, i.issue_date
            from r join i on i.entity_id = r.entity_id)
        select receipt_id, contact_id, receipt, invoice_id, item_contact_id, open, same_contact, exact, named, score,
               (row_number() over (partition by receipt_id order by same_contact desc, exact and named desc, exact desc, named desc, score desc, due_date, invoice_id))::int as rank
        from p where same_contact or (exact or named) and issue_date <= date '{as_of}'""",
    ),
)
def j17(b):
    paid = receipts(b).join(b.contact().select("contact_id", "entity_id", F.col("contact_name").alias("description")), "contact_id")
    paid = paid.select("*", F.col("contact_id").alias("receipt_id"), F.lit("IN").alias("direction"), F.to_date(F.lit(AS_OF)).alias("day"), F.lit(None).cast("string").alias("account"))
    # stored, as contacts, amounts and numbers each read the open items
    opened = b.stored("items", items(b).filter("open > 0").select("invoice_id", "entity_id", "contact_id", "issue_date", "due_date", "open"))
    opened = opened.join(b.contact().select("contact_id", "contact_name"), "contact_id")
    return ar.settlement_candidates(
        paid,
        opened.select(
            "*", F.lit("IN").alias("direction"), F.col("invoice_id").cast("string").alias("number"), F.lit("1130").alias("account"), F.lit(0).cast("long").alias("expected_tax")
        ),
    )


@register(
    "j19_aging_file_difference",
    with_views(
        "item contact",
        """select coalesce(o.key, f.key) as key, coalesce(own, 0)::bigint as own, coalesce(amount, 0)::bigint as amount, (coalesce(own, 0) - coalesce(amount, 0))::bigint as difference
        from (select 'CUSTOMER' || regexp_replace(contact_name, '[^0-9]', '', 'g') as key, sum(open) as own from item join contact using (contact_id) where open > 0 group by 1) o
        full join (select 'CUSTOMER' || regexp_replace(contact_name, '[^0-9]', '', 'g') as key, advance as amount from contact where advance > 0) f on f.key = o.key
        where coalesce(own, 0) <> coalesce(amount, 0)""",
    ),
)
def j19(b):
    listed = b.contact().filter("advance > 0").select(normal_name("contact_name").alias("key"), F.col("advance").alias("amount"))
    return ar.aging_file_difference(items(b), b.contact(), listed)


@register(
    "j20_cut_off_candidates",
    with_views(
        "journal",
        """select entry_id, day, sum(debit - credit)::bigint as amount from journal where account = '4100' and day between date '1998-06-23' and date '1998-07-07'
        group by all order by abs(sum(debit - credit)) desc, entry_id limit 20""",
    ),
)
def j20(b):
    return ar.cut_off_candidates(b.journal_line(("4100",)), "4100", AS_OF)
