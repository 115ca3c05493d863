"""Chat formatting into budgeted windows. Native SQL functions only.

A turn is written <s>role, a line feed, text, </s>. Control strings inside roles and texts are escaped: a backslash is
doubled, and one is put behind the first character of each control string, which is then none any more. In a role a
percent sign and a line feed are written %25 and %0A besides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Strings that no escaped text holds, as patterns of what follows their first character.
CONTROL = r"[<\[](?=/?s>|<SYS>>|</SYS>>|/?INST\])"
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
#: Tokens of a turn's marks.
MARKS = 4


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unrole(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x)


def turns_in_order(rows: DataFrame) -> DataFrame:
    """Turns with i, their place from 0, tokens and upto, the prefix sum of tokens in their conversation."""
    turns = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("tokens", F.regexp_count("text", F.lit(TOKEN)).cast("long") + MARKS)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.withColumn("i", F.row_number().over(order) - 1).withColumn("upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _starts(turns: Column, room: Column) -> Column:
    """Index of each span's first turn: a span ends before its tokens, by prefix sums, pass the room; a larger turn stands alone."""
    first = F.struct(F.array(F.lit(0)).alias("at"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("before"))

    def step(a: Column, x: Column) -> Column:
        over = (x["upto"] - a["base"] > room) & (a["before"] > a["base"])
        return F.struct(F.when(over, F.concat(a["at"], F.array(x["i"]))).otherwise(a["at"]).alias("at"), F.when(over, a["before"]).otherwise(a["base"]).alias("base"), x["upto"].alias("before"))

    return F.aggregate(turns, first, step, lambda a: a["at"])


def windows(rows: DataFrame, budget: int = 1024, history: int = 256, target: str = "assistant") -> DataFrame:
    """Rows (conv_id, window, formatted, loss, repeated, tokens) for the conversations of rows(conv_id, turn, role, text).

    A window holds the system turn, if the conversation begins with one, then as many of the turns before its span as
    fit in `history` tokens, then its span; `repeated` counts the turns that an earlier window has had already. `loss`
    lists (start, length) in characters of the target texts of the span; repeated targets aren't in it. A window has
    at most `budget` tokens unless one turn and the system turn alone have more. A null role or text is empty, turns
    of equal number are ordered by role and text, repeated rows are turns of their own, a null conv_id is one
    conversation, an empty table gives no rows, other columns are ignored. Of a whole conversation only places and
    prefix sums come together, 16 bytes a turn, so one conversation may have some ten million turns; texts come together
    by window. A turn is written once for each window that has it.
    """
    turns = turns_in_order(rows)
    sums = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "upto"))).alias("all"), F.max(F.when((F.col("i") == 0) & (F.col("role") == "system"), F.col("tokens"))).alias("sys"))
    room = F.greatest(F.lit(1).cast("long"), F.lit(budget).cast("long") - history - F.coalesce("sys", F.lit(0)))
    spans = sums.withColumn("at", _starts(F.col("all"), room))
    done = F.transform("at", lambda b: F.coalesce(F.get("all", b - 1)["upto"], F.lit(0)))
    spans = spans.select(F.col("conv_id").alias("_conv"), F.col("sys").isNotNull().alias("has_sys"), F.arrays_zip(F.col("at").alias("at"), done.alias("done")).alias("spans"))
    # the windows of a turn: its own span's, later ones that it is history of, and all of them for the system turn; its
    # span is the last to begin by it, and it is history up to the last window whose span begins within reach of it
    spans = spans.select("_conv", "has_sys", F.size("spans").alias("n"), F.posexplode("spans").alias("window", "s")).select("_conv", "has_sys", "n", "window", F.col("s.at").alias("begin"), F.col("s.done").alias("done"))
    empty = {c: F.lit(None).cast(t).alias(c) for c, t in turns.dtypes}
    ends = F.col("upto") - F.col("tokens") + history
    marks = spans.select(F.col("_conv").alias("conv_id"), *[v for c, v in empty.items() if c not in ("conv_id", "i")], F.col("begin").alias("i"), F.col("done").alias("reach"), "window", "n", "has_sys")
    both = turns.withColumn("reach", ends).withColumn("window", F.lit(None).cast("int")).withColumn("n", F.lit(None).cast("int")).withColumn("has_sys", F.lit(None).cast("boolean")).unionByName(marks)
    mark = F.when(F.col("tokens").isNull(), 0).otherwise(1)
    upto_here = [Window.partitionBy("conv_id").orderBy(c, mark).rowsBetween(Window.unboundedPreceding, 0) for c in ("i", "reach")]
    both = both.withColumn("own", F.last("window", True).over(upto_here[0])).withColumn("n", F.last("n", True).over(upto_here[0])).withColumn("has_sys", F.last("has_sys", True).over(upto_here[0]))
    both = both.withColumn("last", F.last("window", True).over(upto_here[1])).where("tokens is not null")
    reach = F.when(F.col("has_sys") & (F.col("i") == 0), F.col("n") - 1).otherwise(F.greatest("own", "last"))
    held = both.select("conv_id", "i", "role", "text", "tokens", F.col("own"), F.explode(F.sequence("own", reach)).alias("window"))
    old = F.col("window") > F.col("own")
    piece = F.struct("i", F.concat(F.lit("<s>"), _role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"), (~old & (F.col("role") == target)).alias("loss"), old.alias("old"), "tokens")
    packed = held.select("conv_id", "window", piece.alias("p")).groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("p")).alias("pieces"))
    loss = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("out")),
        lambda a, p: F.struct(
            (a["pos"] + F.length(p["head"]) + F.length(p["body"]) + 4).alias("pos"),
            F.when(p["loss"], F.concat(a["out"], F.array(F.struct((a["pos"] + F.length(p["head"])).alias("start"), F.length(p["body"]).cast("long").alias("length"))))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("</s>"))), "")
    return packed.select("conv_id", "window", text.alias("formatted"), loss.alias("loss"), F.size(F.filter("pieces", lambda p: p["old"])).alias("repeated"), _sum(F.transform("pieces", lambda p: p["tokens"])).alias("tokens"))


def read_back(made: DataFrame) -> DataFrame:
    """Rows (conv_id, window, turns, targets): new turns (role, text) and targets, parsed from a window's string and mask alone."""
    pieces = F.split("formatted", "</s>", -1)
    new = F.slice(pieces, F.col("repeated") + 1, F.greatest(F.lit(0), F.size(pieces) - 1 - F.col("repeated")))
    turns = F.transform(new, lambda p: F.struct(_unrole(F.substring_index(p, "\n", 1).substr(F.lit(4), F.length(p))).alias("role"), unescape(p.substr(F.instr(p, "\n") + 1, F.length(p))).alias("text")))
    targets = F.transform("loss", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return made.select("conv_id", "window", turns.alias("turns"), targets.alias("targets"), F.length("formatted").cast("long").alias("chars"))


def digests(made: DataFrame) -> DataFrame:
    """What the formatted windows hold, read back from them, by conversation."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = read_back(made).select("conv_id", "chars", F.struct("window", F.size("turns").alias("n"), said.alias("said"), F.array_join("targets", "").alias("loss")).alias("w"))
    got = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"))
    got = got.select("conv_id", "formatted_chars", _sum(F.col("w.n")).alias("n_turns"), F.array_join("w.said", "").alias("said"), F.array_join("w.loss", "").alias("loss"))
    return got.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
