"""Matching of bank lines, documents and entries."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import business_days_apart
from ..functions.text import LEGAL_FORMS, TRANSFER_HINT, is_generic_key, mentions, merchant_key, normal_name, own_name_pattern, plain_words, tax_id, text_account, third_party_name
from .folds import folded
from .ledger import total


def transfer_lines(lines: DataFrame, entity: DataFrame | None = None) -> DataFrame:
    """Adds ``third_party`` (whom the description names besides the own entities, else null) and
    ``hinted`` (it has a transfer word or an own name, and is neither matched nor taken out of a pair).

    ``entity`` (entity_id, entity_name) holds the group's own names, those of the line's client if both
    sides have client_id. ``matched`` and ``pair_refused`` are read if they are there."""
    free = F.lit(True)
    for flag in ("matched", "pair_refused"):
        if flag in lines.columns:
            free = free & ~F.coalesce(flag, F.lit(False))
    empty = F.array().cast("array<string>")
    if entity is None:
        rows = lines.withColumn("_names", empty).withColumn("_patterns", empty)
    else:
        by = "client_id" if {"client_id"} <= set(lines.columns) & set(entity.columns) else "_group"
        if by == "_group":
            lines, entity = lines.withColumn(by, F.lit(1)), entity.withColumn(by, F.lit(1))
        name = F.upper("entity_name")
        bare = F.array_join(F.filter(F.split(name, r"\s+"), lambda w: (w != "") & ~w.isin(LEGAL_FORMS)), " ")
        own = entity.select(by, name.alias("name"), F.when(F.length(bare) >= 3, bare).alias("bare"), own_name_pattern("entity_name").alias("pattern"))
        words = F.size(F.filter(F.split(F.coalesce(merchant_key("name"), F.lit("")), " "), lambda w: (w != "") & ~w.isin(LEGAL_FORMS)))
        longest = F.array_sort(F.collect_list(F.when(F.col("pattern").isNotNull(), F.struct((-words).alias("n"), "pattern"))))
        own = own.groupBy(by).agg(
            F.array_distinct(F.concat(F.collect_list("name"), F.collect_list("bare"))).alias("_names"), F.transform(longest, lambda x: x["pattern"]).alias("_patterns")
        )
        rows = lines.join(own, by, "left").withColumn("_names", F.coalesce("_names", empty)).withColumn("_patterns", F.coalesce("_patterns", empty)).drop("_group")
    rows = rows.withColumn("third_party", third_party_name("description", "_patterns"))
    hint = F.upper("description").rlike(TRANSFER_HINT) | mentions("description", "_names")
    return rows.withColumn("hinted", F.coalesce(hint & free, F.lit(False))).drop("_names", "_patterns")


def transfer_edges(lines: DataFrame, within: int = 2, entity: DataFrame | None = None) -> DataFrame:
    """Pairs of opposite amounts in different bank accounts, at most two business days apart, where
    both descriptions look like a transfer and name no third party. The amount is the join key and the
    dates, in cells of ``within`` + 3 days, a second one, so that an amount that is common doesn't meet
    itself at all dates."""
    width = within + 3
    hinted = transfer_lines(lines, entity).filter("hinted and third_party is null").withColumn("_cell", F.floor(F.unix_date("day") / width))
    outs = hinted.filter("amount < 0").select(F.col("line_id").alias("out_id"), (-F.col("amount")).alias("amount"), F.col("day").alias("out_day"), F.col("bank_account").alias("out_account"), F.col("entity_id").alias("out_entity"), "_cell")
    ins = hinted.filter("amount > 0").select(F.col("line_id").alias("in_id"), "amount", F.col("day").alias("in_day"), F.col("bank_account").alias("in_account"), F.col("entity_id").alias("in_entity"), F.explode(F.array(F.col("_cell") - 1, F.col("_cell"), F.col("_cell") + 1)).alias("_cell"))
    pairs = outs.join(ins, ["amount", "_cell"]).filter("out_account <> in_account")
    return pairs.filter(business_days_apart("out_day", "in_day") <= within).drop("_cell")


def _degrees(edges: DataFrame) -> DataFrame:
    n_out, n_in = F.count("*").over(Window.partitionBy("out_id")), F.count("*").over(Window.partitionBy("in_id"))
    return edges.withColumn("n_in", n_out).withColumn("n_out", n_in)


SURE = "n_in = 1 and n_out = 1"


def transfer_pairs(lines: DataFrame, entity: DataFrame | None = None) -> DataFrame:
    """An edge with no rival on either side is a pair (clearing within an entity, intercompany
    between two); all others are suggestions."""
    return _degrees(transfer_edges(lines, entity=entity)).select(
        "out_id", "in_id", "amount", "n_in", "n_out",
        F.when(F.col("out_entity") == F.col("in_entity"), "1199").otherwise("1190").alias("account"),
        F.when(F.expr(SURE), 99).otherwise(80).alias("confidence_pct"),
    )


def transfer_suggestions(lines: DataFrame, entity: DataFrame | None = None) -> DataFrame:
    """Each line that has rivals, with the account of its first possible other half and the others
    (line_id, day, amount) of its group: an outgoing line, its candidates and their other outgoing lines.
    Lines are in the order of their day and id; a line is in the first group that holds it."""
    edges = _degrees(transfer_edges(lines, entity=entity)).filter(f"not ({SURE})")
    edges = edges.withColumn("_out", F.struct("out_day", "out_id")).withColumn("_in", F.struct("in_day", "in_id"))
    account = F.when(F.col("out_entity") == F.col("in_entity"), "1199").otherwise("1190")
    ins = edges.groupBy("in_id").agg(F.min("_out").alias("owner"), F.min_by(account, "_out").alias("account"))
    near = edges.join(ins.select("in_id", "owner"), "in_id")
    outs = near.groupBy("out_id").agg(F.min("owner").alias("owner"), F.min_by(account, "_in").alias("account"))
    placed = outs.withColumnRenamed("out_id", "line_id").unionByName(ins.withColumnRenamed("in_id", "line_id"))
    cores = placed.select(F.col("owner")["out_id"].alias("owner_id")).distinct()
    reach = edges.join(cores, F.col("out_id") == F.col("owner_id")).select("owner_id", "in_id")
    held = reach.join(edges, "in_id")
    members = held.select("owner_id", F.col("out_id").alias("line_id"), F.col("out_day").alias("day"), (-F.col("amount")).alias("amount"))
    members = members.unionByName(held.select("owner_id", F.col("in_id").alias("line_id"), F.col("in_day").alias("day"), "amount")).distinct()
    groups = members.groupBy("owner_id").agg(F.array_sort(F.collect_list(F.struct("day", "line_id", "amount"))).alias("_all"))
    rows = placed.withColumn("owner_id", F.col("owner")["out_id"]).join(groups, "owner_id")
    return rows.select("line_id", "account", F.lit(80).alias("confidence_pct"), F.filter("_all", lambda x: x["line_id"] != F.col("line_id")).alias("others"))


def own_name_lines(lines: DataFrame, entity: DataFrame) -> DataFrame:
    """Unpaired lines with a transfer hint whose description names an own entity, as whole words.

    Lines meet the names of which they hold the first word, and only those are looked for."""
    names = entity.select(F.col("entity_id").alias("named_id"), plain_words("entity_name").alias("name")).filter("name <> ''").withColumn("_word", F.substring_index("name", " ", 1))
    rows = lines.filter(F.upper("description").rlike(TRANSFER_HINT)).select("line_id", plain_words("description").alias("_text"))
    rows = rows.withColumn("_word", F.explode(F.array_distinct(F.split("_text", " ")))).join(names, "_word")
    held = F.concat(F.lit(" "), F.col("_text"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("name"), F.lit(" ")))
    return rows.filter(held).groupBy("line_id").agg(F.min("named_id").alias("named_id"))


# Words of a text that identify no one.
NAME_NOISE = "PT CV TBK UD PERSERO INDONESIA TRSF TRANSFER DARI BANKING KE DB CR".split()


def one_to_one(docs: DataFrame, book: DataFrame) -> DataFrame:
    """Documents and book rows of one entity and amount, matched one to one; all others stay alone.

    Documents choose in the order of day and id among the free book rows: the same tax id first, then a
    shared name word of four letters or more, then the nearest day, then the least id. ``tax_id`` and
    ``text`` are read where a side has them. The choice of a document hangs on all earlier ones of its
    key, so a key is one task's group; its rows are looked up by tax id, word and day, not all by all."""

    def side(df, name):
        digits = tax_id("tax_id") if "tax_id" in df.columns else F.lit(None).cast("string")
        text = F.split(F.upper("text"), "[^A-Z0-9]+") if "text" in df.columns else F.lit(None).cast("array<string>")
        words = F.array_distinct(F.filter(text, lambda w: (F.length(w) >= 4) & ~w.isin(NAME_NOISE)))
        return df.select("entity_id", "amount", f"{name}_id", f"{name}_day", F.nullif(digits, F.lit("")).alias("tax"), F.coalesce(words, F.array().cast("array<string>")).alias("words"))

    docs, book = side(docs, "doc"), side(book, "book")
    types = {f.name: f.dataType.simpleString() for f in [*docs.schema.fields, *book.schema.fields]}
    schema = f"entity_id {types['entity_id']}, amount {types['amount']}, rank int, doc_id {types['doc_id']}, doc_day date, book_id {types['book_id']}, book_day date"
    return docs.groupBy("entity_id", "amount").cogroup(book.groupBy("entity_id", "amount")).applyInPandas(_choose, schema)


class _Free:
    """The free ones of places in order; those beside a place are found by paths that get shorter with each look."""

    def __init__(self, places):
        self.places = list(places)
        self.after, self.before = list(range(len(self.places) + 1)), list(range(len(self.places) + 1))

    @staticmethod
    def _end(paths, k):
        end = k
        while paths[end] != end:
            end = paths[end]
        while paths[k] != end:
            paths[k], k = end, paths[k]
        return end

    def take(self, place):
        k = bisect_left(self.places, place)
        self.after[k], self.before[k + 1] = k + 1, k

    def near(self, at, first_of_day):
        """The first free place from ``at`` on, and the first one of the day of the last free place before it."""
        k = bisect_left(self.places, at)
        later, earlier = self._end(self.after, k), self._end(self.before, k)
        if later < len(self.places):
            yield self.places[later]
        if earlier:
            yield self.places[self._end(self.after, bisect_left(self.places, first_of_day(self.places[earlier - 1])))]


def _choose(docs, book):
    import pandas as pd

    docs, book = docs.sort_values(["doc_day", "doc_id"]), book.sort_values(["book_day", "book_id"])
    rows = list(zip(book["book_day"], book["book_id"], book["tax"], book["words"]))
    days, left = [r[0] for r in rows], [True] * len(rows)
    by_tax, by_word = defaultdict(list), defaultdict(list)
    for k, (_, _, tax, words) in enumerate(rows):
        if tax:
            by_tax[tax].append(k)
        for w in words:
            by_word[w].append(k)
    by_tax, by_word = ({key: _Free(places) for key, places in d.items()} for d in (by_tax, by_word))
    every = _Free(range(len(rows)))
    first_of_day = lambda k: bisect_left(days, days[k])
    out = []
    for day, doc_id, tax, words in zip(docs["doc_day"], docs["doc_id"], docs["tax"], docs["words"]):
        at = bisect_left(days, day)
        # the first of its day on either side has the least id
        for some in ([by_tax[tax]] if tax and tax in by_tax else [], [by_word[w] for w in words if w in by_word], [every]):
            near = {k for free in some for k in free.near(at, first_of_day)}
            if near:
                break
        best = min(near, key=lambda k: (abs((rows[k][0] - day).days), rows[k][1]), default=None)
        out.append((doc_id, day, *((None, None) if best is None else (rows[best][1], rows[best][0]))))
        if best is not None:
            left[best] = False
            every.take(best)
            if rows[best][2]:
                by_tax[rows[best][2]].take(best)
            for w in rows[best][3]:
                by_word[w].take(best)
    out += [(None, None, r[1], r[0]) for r, alone in zip(rows, left) if alone]
    some = docs if len(docs) else book
    found = pd.DataFrame(out, columns=["doc_id", "doc_day", "book_id", "book_day"], dtype=object)
    found.insert(0, "entity_id", some["entity_id"].iloc[0])
    found.insert(1, "amount", some["amount"].iloc[0])
    found.insert(2, "rank", range(1, len(out) + 1))
    return found


def _entries(lines: DataFrame) -> tuple[DataFrame, list[str]]:
    """One row per entry with its day, amount and kind, and the columns that are the same for the same lines: amount,
    number and 128 bits of hashes."""
    kind = F.col("entry_kind") if "entry_kind" in lines.columns else F.lit(None).cast("string")
    is_kind = lambda *kinds: F.coalesce(F.max(kind.isin(*kinds)), F.lit(False))
    # the sums of two hashes of 64 bits, in halves that don't overflow, are the same for the same lines in any order;
    # numbers and days alone, so that the entries are hashed and not sorted, and one pass over the lines
    hashes = F.xxhash64("account", "debit", "credit"), F.xxhash64(F.lit("again"), "credit", "account", "debit")
    halves = {f"_h{i}{j}": F.sum(half) for i, h in enumerate(hashes) for j, half in enumerate((F.shiftright(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))))}
    entries = lines.groupBy("entity_id", "entry_id").agg(
        F.min("day").alias("day"), total("debit").alias("amount"), F.count("*").alias("_n"), is_kind("BANK").alias("bank"), is_kind("OPENING", "RECLASS").alias("_never"),
        *[h.alias(name) for name, h in halves.items()],
    )
    return entries, ["amount", "_n", *halves]


def equal_neighbours(lines: DataFrame, days: int = 3) -> DataFrame:
    """Each entry of an entity beside the next one (by day and entry_id) with the same lines, if that is at most ``days`` later.

    These are the pairs that ``duplicate_entries`` chooses from where nothing is excluded: all kinds take part, and an
    entry may stand in two of them."""
    entries, same = _entries(lines)
    order = Window.partitionBy("entity_id", *same).orderBy("day", "entry_id")
    found = entries.withColumn("other_id", F.lead("entry_id").over(order)).withColumn("other_day", F.lead("day").over(order))
    return found.filter(F.date_diff("other_day", "day") <= days).select("entity_id", "entry_id", "other_id", "day", "other_day", "amount")


def duplicate_entries(lines: DataFrame, days: int = 3, materiality: int = 0, since: str | None = None) -> DataFrame:
    """Disjoint pairs of entries of an entity with the same lines, at most ``days`` apart: each entry
    takes the first later one that is free and allowed.

    Entries of kind OPENING or RECLASS and those under ``materiality`` never pair, nor do two of kind
    BANK, nor two of one ``import_id`` whose ``memo`` differs; the later one is not before ``since``.
    Columns that aren't there exclude nothing. Lines are the same if their amount, number and 128 bits of
    hashes are; entries without such a neighbour near enough are left at once. An entry has one kind."""
    has = lambda c: F.first(c, True) if c in lines.columns else F.lit(None)
    entries, same = _entries(lines)
    entries = entries.filter((F.col("amount") >= materiality) & ~F.col("_never"))
    order = Window.partitionBy("entity_id", *same).orderBy("day", "entry_id")
    there = (F.date_diff(F.lead("day").over(order), "day") <= days) | (F.date_diff("day", F.lag("day").over(order)) <= days)
    signature = F.concat_ws(":", *same)
    entries = entries.withColumn("_near", there).filter("_near").select("entity_id", "entry_id", "day", "amount", "bank", signature.alias("signature"))
    if {"import_id", "memo"} & set(lines.columns):
        memo = F.regexp_replace(F.trim(F.lower(has("memo").cast("string"))), r"\s+", " ")
        said = lines.join(entries.select("entity_id", "entry_id"), ["entity_id", "entry_id"], "left_semi").groupBy("entity_id", "entry_id").agg(has("import_id").cast("string").alias("import_id"), F.coalesce(memo, F.lit("")).alias("memo"))
        entries = entries.join(said, ["entity_id", "entry_id"])
    else:
        entries = entries.withColumn("import_id", F.lit(None).cast("string")).withColumn("memo", F.lit(""))
    entries = entries.withColumn("since", F.lit(since).cast("date"))
    types = {f.name: f.dataType.simpleString() for f in entries.schema.fields}
    schema = f"entity_id {types['entity_id']}, entry_id {types['entry_id']}, other_id {types['entry_id']}, day date, other_day date, amount {types['amount']}"

    def pairs(rows):
        waiting: list[dict] = []  # free entries of the last days, in order
        for y in rows:
            waiting = [x for x in waiting if (y["day"] - x["day"]).days <= days]
            late = y["since"] is not None and y["day"] < y["since"]

            def allowed(x, y=y):
                same_file = x["import_id"] is not None and x["import_id"] == y["import_id"] and x["memo"] != y["memo"]
                return not same_file and not (x["bank"] and y["bank"])

            x = None if late else next(filter(allowed, waiting), None)
            if x is None:
                waiting.append(y)
            else:
                waiting.remove(x)
                yield {"entity_id": x["entity_id"], "entry_id": x["entry_id"], "other_id": y["entry_id"], "day": x["day"], "other_day": y["day"], "amount": x["amount"]}

    return folded(entries, ["entity_id", "signature"], ["day", "entry_id"], pairs, schema)


def overlapping_ranges(rows: DataFrame, key: str, start: str, end: str, row_id: str) -> DataFrame:
    """Rows whose period begins before the end of an earlier one of the key."""
    order = Window.partitionBy(key).orderBy(start, row_id).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_until", F.max(end).over(order))
    return rows.filter(F.col(start) <= F.col("_until")).drop("_until")


def conflicting_facts(facts: DataFrame) -> DataFrame:
    """Keys that have several values, whatever their case."""
    return facts.groupBy("entity_id", "key").agg(F.count_distinct(F.lower("value")).alias("n_values")).filter("n_values > 1")


def covered_days(periods: DataFrame, key: str) -> DataFrame:
    """The union of periods (start, end) by key: number of separate stretches and days."""
    order = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = periods.withColumn("_before", before)
    begin = F.when(F.col("_before").isNull() | (F.col("start") > F.date_add("_before", 1)), 1).otherwise(0)
    days = F.greatest(F.lit(0), F.date_diff("end", F.greatest(F.col("start"), F.coalesce(F.date_add("_before", 1), F.col("start")))) + 1)
    return rows.withColumn("_new", begin).withColumn("_days", days).groupBy(key).agg(F.sum("_new").alias("n_stretches"), F.sum("_days").alias("n_days"))


def hand_over(statements: DataFrame) -> DataFrame:
    """A statement's opening against the closing of the one before it in the account."""
    order = Window.partitionBy("bank_account").orderBy("start")
    rows = statements.withColumn("previous_closing", F.lag("closing").over(order)).filter("previous_closing is not null")
    return rows.select("bank_account", "start", "previous_closing", "opening", (F.col("opening") - F.col("previous_closing")).alias("gap"))


def checkpoints(moves: DataFrame, points: DataFrame) -> DataFrame:
    """Stated balances (key, day, balance) against the running sum of movements up to the day.

    Points and movements are one ordered stream per key, so this is a window and no range join."""
    stream = moves.select("key", "day", "amount", F.lit(0).alias("point"), F.lit(None).cast("long").alias("stated")).unionByName(
        points.select("key", "day", F.lit(0).cast("long").alias("amount"), F.lit(1).alias("point"), F.col("balance").alias("stated"))
    )
    order = Window.partitionBy("key").orderBy("day", "point").rowsBetween(Window.unboundedPreceding, 0)
    rows = stream.withColumn("running", F.sum("amount").over(order)).filter("point = 1")
    return rows.select("key", "day", "stated", "running", (F.col("stated") - F.col("running")).alias("difference"))


def new_rows(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of a file that the store doesn't have, by hash."""
    return incoming.join(stored.select("hash"), "hash", "left_anti")


def classified(lines: DataFrame, pairs: DataFrame, rules: DataFrame, memory: DataFrame) -> DataFrame:
    """The first that answers: transfer, rule, memory, tax text, guess; and whether to post.

    A line's rule is the one of the least priority and the longest pattern that its description holds; rules
    are a list that people keep by hand, memory grows with the merchants and is joined."""
    keyed = lines.withColumn("merchant", merchant_key("description")).withColumn("direction", F.when(F.col("amount") < 0, "OUT").otherwise("IN"))
    sure = pairs.filter("confidence_pct = 99")
    pair = sure.select(F.col("out_id").alias("line_id"), F.col("account").alias("_t")).unionByName(sure.select(F.col("in_id").alias("line_id"), F.col("account").alias("_t")))
    hit = keyed.select("line_id", "description").join(F.broadcast(rules), F.upper("description").contains(F.col("pattern")))
    hit = hit.groupBy("line_id").agg(F.min_by("rule_account", F.struct("priority", -F.length("pattern"), "pattern")).alias("_r"))
    known = memory.select("merchant", "direction", F.col("memory_account").alias("_m"))
    rows = keyed.join(pair, "line_id", "left").join(hit, "line_id", "left").join(known, ["merchant", "direction"], "left")
    m = F.when(~is_generic_key("merchant"), F.col("_m"))
    text = text_account("description", "direction")
    method = F.when(F.col("_t").isNotNull(), "TRANSFER").when(F.col("_r").isNotNull(), "RULE").when(m.isNotNull(), "MEMORY").when(text.isNotNull(), "TEXT").otherwise("HEURISTIC")
    account = F.coalesce("_t", "_r", m, text, F.when(F.col("direction") == "OUT", "6200").otherwise("4100"))
    confidence = F.when(method == "TRANSFER", 99).when(method == "RULE", 97).when(method == "MEMORY", 95).when(method == "TEXT", 50).otherwise(30)
    post = (confidence >= 90) & ~method.isin("AI", "HEURISTIC")
    return rows.select("line_id", "merchant", method.alias("method"), account.alias("account"), confidence.alias("confidence_pct"), F.when(post, account).otherwise("1999").alias("posted_to"))


def name_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two lists with the same normalised name."""
    return left.withColumn("key", normal_name("name")).join(right.withColumn("key", normal_name("other_name")), "key")
