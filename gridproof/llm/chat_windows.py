"""Chat formatting in budgeted windows, in DataFrame functions only.

A fold over the turns' tokens cuts a conversation into spans of whole turns. A window is a span with the system turn and
the last few turns before it repeated; the loss mask covers the assistant turns of the span itself, so that each
assistant text is a target once. Template of a turn: ``### role: text</turn>`` and a line feed, where backslash,
``#``, ``<`` and ``:`` of role and text are written as two-character escapes, so that no control string can occur in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings around a turn's role and text.
HEAD, MIDDLE, TAIL = "### ", ": ", "</turn>\n"
#: Characters that are escaped, and the letter that stands for each after a backslash. Fixed values.
ESCAPES = {"\\": "b", "#": "h", "<": "l", ":": "c"}


def escape(text: Column) -> Column:
    for char, letter in ESCAPES.items():  # the backslash first
        text = F.replace(text, F.lit(char), F.lit("\\" + letter))
    return text


def unescape(text: Column) -> Column:
    for char, letter in reversed(ESCAPES.items()):  # the backslash last
        text = F.replace(text, F.lit("\\" + letter), F.lit(char))
    return text


def tokens(text: Column) -> Column:
    """A turn's size for the budget: a token for every four characters begun, and four for its marks."""
    return F.ceil(F.length(text) / 4).cast("long") + 4


def chat_windows(turns: DataFrame, budget: int = 256, history: int = 2) -> DataFrame:
    """conv_id, window, n_context, n_turns, n_tokens, oversized, formatted, mask: array of (start, length) in code points of ``formatted``.

    Windows of a conversation count from 0. The first ``n_context`` turns of a window repeat earlier ones (the
    system turn, if the conversation opens with one, and at most ``history`` turns before the span). System turn,
    history and span together stay within ``budget`` tokens: beside a span's first turn the history goes first, its
    oldest turn before the others, then the system turn, and the span takes further turns as long as they fit. A turn
    is never cut: one that is over the budget by itself is a span of its own, after the system turn only, and
    ``oversized`` marks its window. Rows without a conversation (null conv_id) are one conversation; equal turn
    numbers stand in order of role and text; repeated rows are turns each; null roles and texts are empty.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    by_turn = Window.partitionBy("conv_id").orderBy("nth")
    placed = rows.withColumn("nth", F.row_number().over(order)).withColumn("cost", tokens(F.col("text")))
    placed = placed.withColumns({
        "before": F.coalesce(F.sum("cost").over(by_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "system": F.max(F.when((F.col("nth") == 1) & (F.col("role") == "system"), F.col("cost"))).over(by_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    cost, system, nth = F.col("cost"), F.col("system"), F.col("nth")
    lowest = F.when(system.isNull(), 1).otherwise(2)
    behind = [F.when(nth - k >= lowest, F.col("before") - F.lag("before", k).over(by_turn)) for k in range(1, history + 1)]
    # what a window has before its own turns, if it begins at this one
    headed = system.isNotNull() & (nth > 1) & ((system + cost <= budget) | (cost > budget))
    sums = placed.withColumn("behind", F.array_compact(F.array(*behind)) if behind else F.array().cast("array<bigint>")).withColumn("headed", headed)
    opened = cost + F.when(F.col("headed"), system).otherwise(0)
    fits = F.when(F.col("headed") | system.isNull(), F.filter("behind", lambda n: n + opened <= budget)).otherwise(F.array().cast("array<bigint>"))
    head = F.concat(F.lit(HEAD), escape(F.col("role")), F.lit(MIDDLE))
    body = escape(F.col("text"))
    piece = F.struct(
        "nth",
        F.concat(head, body, F.lit(TAIL)).alias("piece"),
        (F.col("role") == "assistant").alias("said"),
        F.length(head).alias("at"),
        F.length(body).alias("size"),
        "cost",
        F.col("headed").cast("int").alias("headed"),
        F.size("fits").alias("n_history"),
        (opened + F.coalesce(F.array_max("fits"), F.lit(0))).alias("opened"),
    )
    talks = sums.withColumn("fits", fits).groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("all"))
    none = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("starts"))
    cut = F.aggregate(
        "all",
        none,
        lambda s, t: F.when((F.size(s["starts"]) > 0) & (s["used"] + t["cost"] <= budget), F.struct((s["used"] + t["cost"]).alias("used"), s["starts"].alias("starts"))).otherwise(
            F.struct(t["opened"].alias("used"), F.concat(s["starts"], F.array(t["nth"])).alias("starts"))
        ),
        lambda s: s["starts"],
    )

    def window(first: Column, i: Column) -> Column:
        opening = F.get(F.col("all"), first - 1)
        own = F.slice(F.col("all"), first, F.coalesce(F.get(F.col("starts"), i + 1), F.size("all") + 1) - first)
        context = F.concat(F.slice(F.col("all"), F.lit(1), opening["headed"]), F.slice(F.col("all"), first - opening["n_history"], opening["n_history"]))
        return F.struct(
            i.alias("window"),
            F.size(context).alias("n_context"),
            (opening["cost"] > budget).alias("oversized"),
            F.concat(F.transform(context, lambda t: t.withField("said", F.lit(False))), own).alias("turns"),
        )

    gathered = talks.withColumn("starts", cut).select("conv_id", F.inline(F.transform("starts", window)))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start: int, length: int>>").alias("mask"))
    folded = F.aggregate(
        "turns",
        start,
        lambda s, t: F.struct(
            (s["end"] + F.length(t["piece"])).alias("end"),
            F.when(t["said"], F.concat(s["mask"], F.array(F.struct((s["end"] + t["at"]).alias("start"), t["size"].alias("length"))))).otherwise(s["mask"]).alias("mask"),
        ),
    )
    return gathered.select(
        "conv_id",
        F.col("window").cast("long").alias("window"),
        "n_context",
        F.size("turns").alias("n_turns"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["cost"]).alias("n_tokens"),
        "oversized",
        F.array_join(F.col("turns")["piece"], "").alias("formatted"),
        folded["mask"].alias("mask"),
    )


def read_turns(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns (array of role, text: those that are new in the window), targets (array of text), size."""
    pieces = F.split("formatted", TAIL)
    new = F.slice(pieces, F.col("n_context") + 1, F.col("n_turns") - F.col("n_context"))

    def parse(piece: Column) -> Column:
        rest = F.substring(piece, len(HEAD) + 1, 2**31 - 1)
        at = F.instr(rest, MIDDLE)
        return F.struct(unescape(F.substr(rest, F.lit(1), at - 1)).alias("role"), unescape(F.substr(rest, at + len(MIDDLE), F.lit(2**31 - 1))).alias("text"))

    return windows.select(
        "conv_id",
        "window",
        F.transform(new, parse).alias("turns"),
        F.transform("mask", lambda m: unescape(F.substr(F.col("formatted"), m["start"] + 1, m["length"]))).alias("targets"),
        F.length("formatted").cast("long").alias("size"),
    )


def chat_digests(turns: DataFrame, budget: int = 256, history: int = 2) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the windows.

    Empty tables give empty results; other columns are neither read nor returned; see ``chat_windows`` for the rest.
    """
    read = read_turns(chat_windows(turns, budget, history))
    held = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "targets"))).alias("windows"), F.sum("size").alias("formatted_chars"))
    said = F.flatten(F.col("windows")["turns"])
    loss = F.array_join(F.flatten(F.col("windows")["targets"]), "")
    lines = F.array_join(F.transform(said, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return held.select(
        "conv_id",
        F.size(said).cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
