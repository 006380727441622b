"""Which lines of an entry are covered by the schedules that were made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import folded

FIXED, PREPAID = "FIXED_ASSETS", "PREPAID"


def covered_lines(lines: DataFrame, schedules: DataFrame) -> DataFrame:
    """entity_id, entry_id, account, net, schedule_id of each entry's net movement by account; schedule_id is null where none covers it.

    ``lines``: entity_id, entry_id, line_id, account, account_name, fs_line (FIXED_ASSETS, PREPAID, or else income received in
    advance), debit, credit. ``schedules``: schedule_id, entity_id, entry_id (where it was made from), source_account (or
    null), kind, debit_account, credit_account, amount, memo.

    A schedule covers one line and a line is covered once. One that names its source account covers that. Others are
    taken by what they carry, DEPRECIATION last, in the order of their ids: a prepayment is released by a credit to its
    account, income received by a debit; of several that fit the one that the memo mentions, else the one of the
    amount, else the first. A depreciation covers an asset whose code or name its memo holds (a code before a name, a
    name with the amount first, then the longest), else one of its amount or the entry's only asset, unless memo or amount point at another line.
    An entry's lines and schedules are folded together; no other entry is held."""
    kind = lines.schema["entry_id"].dataType.simpleString()
    number = schedules.schema["schedule_id"].dataType.simpleString()
    entity = lines.schema["entity_id"].dataType.simpleString()
    nets = lines.groupBy("entity_id", "entry_id", "account").agg(F.min("line_id").cast("string").alias("place"), F.min("account_name").alias("account_name"), F.min("fs_line").alias("fs_line"), F.sum(F.col("debit") - F.col("credit")).cast("long").alias("net"))
    made = schedules.select("entity_id", "entry_id", "schedule_id", "source_account", "kind", "debit_account", "credit_account", "amount", F.lower("memo").alias("memo"))
    rows = nets.withColumn("part", F.lit(0)).unionByName(made.join(nets.select("entity_id", "entry_id").distinct(), ["entity_id", "entry_id"], "left_semi").withColumn("part", F.lit(1)), allowMissingColumns=True)
    return folded(rows, ["entity_id", "entry_id"], ["part", "place", "schedule_id"], _entry, f"entity_id {entity}, entry_id {kind}, account string, net long, schedule_id {number}")


def _entry(rows):
    rows = list(rows)  # one entry
    lines = [r for r in rows if r["part"] == 0]
    schedules = [r for r in rows if r["part"] == 1]
    by: dict[str, object] = {}
    for s in schedules:
        if s["source_account"] in {x["account"] for x in lines}:
            by.setdefault(s["source_account"], s["schedule_id"])
    unnamed = [s for s in schedules if s["source_account"] is None]
    for s in sorted(unnamed, key=lambda s: s["kind"] == "DEPRECIATION"):
        line = _line_of(s, lines, by)
        if line is not None:
            by[line["account"]] = s["schedule_id"]
    return ({"entity_id": x["entity_id"], "entry_id": x["entry_id"], "account": x["account"], "net": x["net"], "schedule_id": by.get(x["account"])} for x in lines)


def _line_of(s: dict, lines: list[dict], by: dict):
    """The line that a schedule covers, by what it carries."""
    memo = s["memo"] or ""
    words = set(memo.split())
    coded = lambda x: x["account"].lower() in words
    named = lambda x: (x["account_name"] or "").lower() in memo
    first = lambda *choices: next((x for choice in choices for x in choice), None)
    free = [x for x in lines if x["account"] not in by]
    deferred = [x for x in lines if x["fs_line"] != FIXED and (x["net"] > 0 if x["fs_line"] == PREPAID else x["net"] < 0)]
    fitting = [x for x in deferred if x in free and s["credit_account" if x["fs_line"] == PREPAID else "debit_account"] == x["account"]]
    released = first((x for x in fitting if coded(x) or named(x)), (x for x in fitting if abs(x["net"]) == s["amount"]), fitting)
    if s["kind"] != "DEPRECIATION":
        return released
    assets = [x for x in lines if x["fs_line"] == FIXED]
    open_ = [x for x in assets if x in free]
    said = sorted((x for x in open_ if named(x)), key=lambda x: -len(x["account_name"] or ""))
    equal = [x for x in open_ if x["net"] == s["amount"]] + (open_ if len(assets) == len(open_) == 1 else [])
    if any(coded(x) or named(x) or (x in free and abs(x["net"]) == s["amount"]) for x in deferred):
        equal = []  # the memo or the amount points at another line
    return first((x for x in open_ if coded(x)), (x for x in said if x["net"] == s["amount"]), said, equal) or released
