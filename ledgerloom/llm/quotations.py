"""Chat formatting by quotation linking, with DataFrame operations only.

A message's lines are parsed into quote levels (the leading ``>`` marks). A run of lines of one level
is a passage. Quoted passages are normalised and hashed, and joined to the messages of the same
conversation that wrote the same passage, line or whole text themselves; a quote of several lines also
to those that wrote these lines one after the other. The earliest such message before the quoting one
is what it answers; a message that quotes nothing known answers the turn before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

KEY = ["conv_id", "turn", "copy"]


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, copy, passage (number in the message), level, text, norm, lines (array)."""
    marks = F.regexp_extract("line", r"^([ \t]*>)+", 0)
    lines = messages.select(*KEY, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n", "line"))
    lines = lines.select(
        *KEY,
        "n",
        (F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))).alias("level"),
        F.regexp_replace("line", r"^([ \t]*>)+ ?", "").alias("line"),
    )
    within = Window.partitionBy(*KEY).orderBy("n")
    starts = F.when(F.col("level") != F.lag("level", 1, -1).over(within), 1).otherwise(0)
    lines = lines.withColumn("_new", starts).withColumn("passage", F.sum("_new").over(within))
    runs = lines.groupBy(*KEY, "passage").agg(F.first("level").alias("level"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("_lines"))
    runs = runs.withColumn("lines", F.transform("_lines", lambda x: x["line"])).drop("_lines")
    return runs.withColumn("text", F.array_join("lines", "\n")).withColumn("norm", normalised(F.col("text")))


def _line_hashes(lines: Column) -> Column:
    """The hashes of the lines that aren't blank."""
    return F.transform(F.filter(F.transform(lines, normalised), lambda x: x != ""), lambda x: F.sha2(x, 256))


def _joint(hashes: Column) -> Column:
    return F.sha2(F.array_join(hashes, ""), 256)


def link_passages(quoted: DataFrame, runs: DataFrame, body: DataFrame) -> DataFrame:
    """Sets ``origin``: the first turn that wrote the quoted passage, line or whole text itself, if it is an earlier one."""
    own = runs.filter("level = 0 and norm != ''")
    written = (
        own.select("conv_id", "turn", "norm")
        .unionByName(own.select("conv_id", "turn", F.explode("lines").alias("line")).select("conv_id", "turn", normalised(F.col("line")).alias("norm")))
        .unionByName(body.select("conv_id", "turn", normalised(F.col("body")).alias("norm")))
        .filter("norm != ''")
    )
    first = written.groupBy("conv_id", F.sha2("norm", 256).alias("hash")).agg(F.min("turn").alias("origin"))
    return quoted.join(first, ["conv_id", "hash"], "left").withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))


def link_stretches(linked: DataFrame, runs: DataFrame) -> DataFrame:
    """Sets ``origin`` for quotes without one whose lines an earlier turn wrote one after the other.

    Blank lines don't count. Only stretches that begin with a quote's first line and have its number of
    lines are hashed, so a line that is common costs one hash for each length that is quoted with it."""
    linked = stage(linked, "quotes")
    heads = linked.filter("origin is null and size(hashes) > 1").select("conv_id", F.col("hashes")[0].alias("head"), F.size("hashes").alias("m")).distinct()
    if heads.isEmpty():
        return linked
    ordered = F.array_sort(F.collect_list(F.struct("passage", "lines")))
    bodies = runs.filter("level = 0").join(heads.select("conv_id").distinct(), "conv_id", "left_semi").groupBy(*KEY).agg(F.flatten(F.transform(ordered, lambda x: x["lines"])).alias("lines"))
    bodies = bodies.select(*KEY, _line_hashes(F.col("lines")).alias("hashes"))
    spots = bodies.select(*KEY, F.size("hashes").alias("n"), F.posexplode("hashes").alias("pos", "head")).join(heads, ["conv_id", "head"]).filter("pos + m <= n")
    spots = spots.groupBy(*KEY).agg(F.collect_list(F.struct("pos", "m")).alias("spots"))
    stretches = bodies.join(spots, KEY).select("conv_id", "turn", F.explode(F.transform("spots", lambda x: _joint(F.slice("hashes", x["pos"] + 1, x["m"])))).alias("joint"))
    first = stretches.groupBy("conv_id", "joint").agg(F.min("turn").alias("_first"))
    rows = linked.withColumn("joint", _joint(F.col("hashes"))).join(first, ["conv_id", "joint"], "left")
    return rows.withColumn("origin", F.coalesce("origin", F.when(F.col("_first") < F.col("turn"), F.col("_first")))).drop("joint", "_first")


def link_quotations(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, copy, role, answers_turn, depth, n_quotes, n_linked, text.

    ``text`` is the message without its quotes, trimmed; ``answers_turn`` is null for what starts a
    conversation; ``depth`` is the number of messages above it. Messages in (conv_id, turn, copy)
    order are in reply order, as an answer always comes later than what it answers.

    A null text is empty. Null conv_ids form one conversation of their own, null turns come first in
    theirs, and all nulls stay null; an answer to a null turn has a null ``answers_turn`` and a depth.
    A very long text is split into its lines like any other. Rows that repeat a turn are numbered by ``copy`` in the order of role and
    text; all of them count as that turn. Empty quotes link with nothing. An empty table gives an
    empty result; other columns are not read.
    """
    # a null is a key like any other, and the first
    key = lambda c: F.struct(F.col(c).isNotNull().alias("known"), F.coalesce(F.col(c).cast("long"), F.lit(0)).alias("id")).alias(c)
    value = lambda c: F.when(F.col(f"{c}.known"), F.col(f"{c}.id")).alias(c)
    clean = messages.select(key("conv_id"), key("turn"), "role", "text")
    repeats = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    clean = stage(clean.withColumn("copy", F.row_number().over(repeats) - 1), "messages")
    runs = stage(passages(clean), "passages")

    quoted = stage(runs.filter("level > 0 and norm != ''").select(*KEY, "passage", "level", F.sha2("norm", 256).alias("hash"), _line_hashes(F.col("lines")).alias("hashes")), "quoted")
    body = runs.filter("level = 0").groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("passage", "text"))), lambda x: x["text"]), "\n").alias("body"))
    # a join with no quotes would be cut short while its other side still runs, on files that go as the join ends
    linked = quoted.withColumn("origin", F.lit(None).cast(clean.schema["turn"].dataType)) if quoted.isEmpty() else link_stretches(link_passages(quoted, runs, body), runs)
    quotes = linked.groupBy(*KEY).agg(
        F.count("*").alias("n_quotes"),
        F.count("origin").alias("n_linked"),
        F.min(F.when(F.col("origin").isNotNull(), F.struct("level", "passage", "origin")))["origin"].alias("origin"),
    )
    turns = clean.select("conv_id", "turn").distinct()
    turns = turns.withColumn("before", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")))
    joined = (
        clean.drop("text")
        .join(turns, ["conv_id", "turn"])
        .join(quotes, KEY, "left")
        .join(body, KEY, "left")
        .select(
            *KEY,
            "role",
            F.coalesce("origin", "before").alias("answers_turn"),
            F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
            F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
            F.regexp_replace(F.coalesce("body", F.lit("")), r"^[ \t\r\n]+|[ \t\r\n]+$", "").alias("text"),
        )
    )
    joined = stage(joined, "replies")
    depths = reply_depths(joined.groupBy("conv_id", "turn").agg(F.min("answers_turn").alias("up")))
    answered = joined.join(depths, ["conv_id", "turn"])
    return answered.select(value("conv_id"), value("turn"), "copy", "role", value("answers_turn"), "n_quotes", "n_linked", "text", "depth")


def reply_depths(links: DataFrame) -> DataFrame:
    """conv_id, turn, depth from conv_id, turn, up: pointer doubling, so a chain of n takes log2(n) rounds,
    of which a turn of depth d takes part in log2(d)."""
    links = links.select("conv_id", "turn", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    while not (open_ := links.filter("up is not null")).isEmpty():
        above = links.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        higher = open_.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"))
        links = stage(links.filter("up is null").unionByName(higher), "depths")
    return links.select("conv_id", "turn", "depth")


def formatted(messages: DataFrame, template: str = "<|%s|>\n%s\n") -> DataFrame:
    """Adds ``formatted``: the role and the unquoted text in a chat template."""
    return link_quotations(messages).withColumn("formatted", F.format_string(template, F.coalesce("role", F.lit("unknown")), "text"))
