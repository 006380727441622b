"""Statements of bank lines as MT940 files, one a user with a message a day, some with a fault, and what is read of them."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.money import cents
from ..sources import mt940
from .catalog import register

FAULTY = 10  # users that leave 1 to 9 by 16 have a fault, from their second or third message on
STEP = 1_000_000_000  # line numbers of a message


def written(b):
    """file, line_no, text: the lines of all files."""
    u = F.col("user_id")
    value = cents("value")
    k = F.get_json_object("props", "$.k").cast("int")
    events = b.read("events").select("user_id", "event_id", "ts", F.to_date("ts").alias("day"), F.when(F.col("event_type").isin("purchase", "error"), -value).otherwise(value).alias("amount"), "event_type", k.alias("k"))
    user = Window.partitionBy("user_id").orderBy("day")
    days = events.groupBy("user_id", "day").agg(F.sum("amount").alias("net"))
    days = days.withColumn("i", F.row_number().over(user)).withColumn("shut", u * 1000 + F.sum("net").over(user)).withColumn("open", F.col("shut") - F.col("net"))
    days = days.withColumn("since", F.coalesce(F.lag("day").over(user), F.date_sub("day", 1))).withColumn("last", F.lead("day").over(user).isNull())

    figure = _figure
    fault = u % 16
    second = F.col("i") == 2
    off = F.when(second & (fault == 4), 100).otherwise(0)
    balance = lambda tag, day, c: F.concat(F.lit(f":{tag}:"), F.when(c < 0, "D").otherwise("C"), day, F.lit("IDR"), figure(c))
    short = lambda d: F.date_format(d, "yyMMdd")
    since = F.when(second & (fault == 8), "240230").otherwise(short(F.when(second & (fault == 9), F.date_add("since", 1)).otherwise(F.col("since"))))
    account = F.concat(F.lit(":25:CENAIDJA/"), F.lpad(u.cast("string"), 10, "0"))
    line = lambda at, text, test=F.lit(True): F.struct(F.lit(at).cast("long").alias("at"), F.when(test, text).alias("text"))
    frame = F.array(
        line(0, F.lit("{1:F01CENAIDJAXXXX0000000000}{2:I940CENAIDJAXXXXN}{3:{108:X}}{4:")),
        line(1, F.concat(F.lit(":20:"), u.cast("string"))), line(2, account), line(3, account, second & (fault == 7)),
        line(4, F.concat(F.lit(":28C:"), (F.col("i") + F.when((fault == 3) & (F.col("i") > 2), 1).otherwise(0)).cast("string"), F.lit("/1"))),
        line(5, balance("60F", since, F.col("open") + off), ~(second & (fault == 6))),
        line(STEP - 2, balance("62F", short(F.col("day")), F.col("shut") + off + F.when(second & (fault == 1), 1).otherwise(0)), ~(F.col("last") & (fault == 2))),
        line(STEP - 1, F.lit("-}")),
    )
    frames = days.select("user_id", "i", F.inline(frame))

    rows = events.join(days.select("user_id", "day", "i"), ["user_id", "day"]).withColumn("j", F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id")))
    amount, turned = F.col("amount"), u % 5 == 0
    mark = F.when(second & (F.col("j") == 1) & (fault == 5), "X").when(amount < 0, F.when(turned, "RC").otherwise("D")).otherwise(F.when(turned, "RD").otherwise("C"))
    move = F.concat(F.lit(":61:"), short(F.date_sub("day", 1)), F.date_format("day", "MMdd"), mark, figure(amount), F.lit("NTRFREF"), F.col("k").cast("string"), F.lit("//"), F.col("event_id").cast("string"))
    told = F.col("k") % 4 > 0
    lines = F.array(
        F.struct((F.col("j") * 3 + 7).cast("long").alias("at"), move.alias("text")),
        F.struct((F.col("j") * 3 + 8).cast("long").alias("at"), F.when(told, F.concat(F.lit(":86:"), F.col("event_type"))).alias("text")),
        F.struct((F.col("j") * 3 + 9).cast("long").alias("at"), F.when(told, F.concat(F.lit("  no. "), F.col("event_id").cast("string"), F.lit("\r"))).alias("text")),
    )
    moves = rows.select("user_id", "i", F.inline(lines))
    return frames.unionByName(moves).filter("text is not null").select(F.concat(F.lit("u"), u.cast("string")).alias("file"), (F.col("i").cast("long") * STEP + F.col("at")).alias("line_no"), "text")


def _said(b):
    """The lines of all files and what they say, stored once as faults, messages and movements each read it."""
    lines = b.stored("mt940-lines", written(b))
    return lines, b.stored("mt940-tags", mt940.read(lines))


def _figure(c):
    """Cents with a comma, nothing behind it if there are none."""
    whole, rest = F.floor(F.abs(c) / 100), F.abs(c) % 100
    return F.concat(whole.cast("string"), F.lit(","), F.when(rest == 0, "").otherwise(F.lpad(rest.cast("string"), 2, "0")))


BOOKS = f"""
    e as (
        select user_id, event_id, ts, ts::date as day, event_type, json_extract(props, '$.k')::int as k,
               case when event_type in ('purchase', 'error') then -1 else 1 end * round(value * 100)::bigint as amount,
               dense_rank() over (partition by user_id order by ts::date) as i, row_number() over (partition by user_id, ts::date order by ts, event_id) as j from events),
    d as (select user_id, day, i, sum(amount)::bigint as net from e group by all),
    m as (select *, (user_id * 1000 + sum(net) over (partition by user_id order by day))::bigint as shut, max(i) over (partition by user_id) as n, user_id % 16 as f from d),
    bad as (
        select user_id, min(f) as f, min(n) as n from m group by 1
        having min(f) = 2 or (min(f) between 1 and {FAULTY - 1} and min(n) >= case when min(f) = 3 then 3 else 2 end))"""


@register(
    "s8_mt940_rows",
    f"""with {BOOKS}
    select 'u' || e.user_id as file, e.i * {STEP} + e.j * 3 + 7 as line_no, lpad(e.user_id::varchar, 10, '0') as account_number, 'IDR' as currency, e.day,
           case when k % 4 > 0 then event_type || ' no. ' || event_id else 'TRF REF' || k || ' ' || event_id end as description, amount,
           case when e.j = max(e.j) over (partition by e.user_id, e.day) then shut end as balance
    from e join m using (user_id, day) where e.user_id not in (select user_id from bad)""",
)
def rows(b):
    return mt940.rows(*_said(b))


@register(
    "s8_mt940_statements",
    f"""with {BOOKS}
    select 'u' || user_id as file, lpad(user_id::varchar, 10, '0') as account_number, 'IDR' as currency, min(day) as period_start, max(day) as period_end,
           user_id * 1000 as opening, arg_max(shut, day) as closing, count(*) as n_messages, (select count(*) from e where e.user_id = m.user_id) as n_rows
    from m where user_id not in (select user_id from bad) group by user_id""",
)
def statements(b):
    return mt940.statements(*_said(b))


@register(
    "s8_mt940_faults",
    f"""with {BOOKS}
    select 'u' || user_id as file,
           ['SUM', 'NO_CLOSING', 'PAGE_MISSING', 'BALANCE_BROKEN', 'MOVEMENT_UNREADABLE', 'MOVEMENT_BEFORE_OPENING', 'ACCOUNT_AGAIN', 'NO_SUCH_DAY', 'DAYS_MISSING'][f] as fault,
           case f when 2 then n when 3 then 3 else 2 end * {STEP} + case f when 5 then 10 when 6 then 10 when 7 then 3 else 5 end as line_no
    from bad""",
)
def faults(b):
    return mt940.faults(*_said(b))
