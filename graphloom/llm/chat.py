r"""Operator 2: chat formatting in budgeted, turn-aligned windows.

Template (fixed format): every turn is written `<|turn|>role<|text|>text<|end|>`. In roles and texts a backslash is put
before each backslash and inside every control string (`<|`, `<s>`, `</s>`, `[INST]`, `[/INST]`, `<<SYS>>`, `<</SYS>>`);
dropping one backslash before any character undoes it, so no text can forge a marker and nothing is lost.

Windows: a turn costs its tokens plus OVERHEAD. Tokens are the caller's `cost` (such as counts by operator 6, a join away, where
the budget must hold for one tokenizer) or, by default, the word, digit and punctuation pieces of PIECES. With P the prefix sum of costs before a turn and W
half of what the budget leaves beside the system turn and the history, spans are cut where floor(P / W) changes and around
turns that cost more than W. A span costs at most 2 * W, so the window keeps to the budget unless one single turn, or a
system turn that leaves no room, is larger (turns are never cut). Each window holds the conversation's
leading system turn, then up to `history` cost of whole turns before the span (repeated, masked), then the span's turns.
The loss mask covers the text of every assistant turn in the one window whose span owns it, so each is learned once.

Prefix sums are taken in blocks of BLOCK turn numbers and then over blocks, so a long conversation is not one task; the
turns that meet in a window are bounded by the budget. Null texts and roles count as empty, null turn numbers sort first,
null conversation ids form one conversation, turns with equal numbers are ordered by role and text, repeated rows are
turns of their own. Other columns are ignored. An empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PIECES = r"[\p{L}\p{M}]+|\p{N}|[^\s\p{L}\p{M}\p{N}]"
OVERHEAD = 4
BLOCK = 256
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_GUARD = r"(?=\\)|(?<=<)(?=\||/?s>|</?SYS>>)|(?<=\[)(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _GUARD, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN), escape(role), F.lit(TEXT), escape(text), F.lit(END))


def format_windows(turns: DataFrame, budget: int = 1024, history: int = 128, cost: Column | None = None) -> DataFrame:
    """Rows conv_id, window (long, in order), formatted, repeated (turns at the start that are repeats), loss
    (array of struct(start, length) in characters of formatted, counted from 0), cost.

    turns: conv_id, turn, role, text. history must not exceed a quarter of the budget. cost: the tokens of a turn's text, a
    column over turns, null as 0.
    """
    if not 0 <= history <= budget // 4:
        raise ValueError("history must lie between 0 and a quarter of the budget")
    text = F.coalesce("text", F.lit(""))
    pieces = F.regexp_count(text, F.lit(PIECES)) if cost is None else F.coalesce(cost, F.lit(0))
    base = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), (pieces + OVERHEAD).cast("long").alias("cost")
    ).withColumn(
        "block", F.call_function("div", F.col("turn").cast("long"), F.lit(BLOCK).cast("long")) - (F.col("turn") < 0).cast("long")
    )
    order = ["turn", "role", "text"]
    here = Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = base.withColumn("p", F.coalesce(F.sum("cost").over(here), F.lit(0)))
    over = Window.partitionBy("conv_id").orderBy("block")
    blocks = base.groupBy("conv_id", "block").agg(F.sum("cost").alias("c")).select(
        F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block"),
        F.coalesce(F.sum("c").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    placed = local.join(
        blocks, F.col("conv_id").eqNullSafe(F.col("b_conv")) & F.col("block").eqNullSafe(F.col("b_block"))
    ).withColumn("p", F.col("p") + F.col("before")).drop("b_conv", "b_block", "before", "block")
    # The system turn opens the conversation: it stands at prefix sum 0.
    system = placed.filter((F.col("p") == 0) & (F.col("role") == "system")).select(
        F.col("conv_id").alias("s_conv"), _render(F.col("role"), F.col("text")).alias("s_text"), F.col("cost").alias("s_cost")
    )
    sizes = system.select(F.col("s_conv").alias("c_conv"), "s_cost")
    placed = placed.join(sizes, F.col("conv_id").eqNullSafe(F.col("c_conv")), "left").drop("c_conv")
    room = F.call_function("div", budget - history - F.coalesce("s_cost", F.lit(0)), F.lit(2).cast("long"))
    half = F.greatest(room, F.lit(max(history, 1)).cast("long"))
    placed = placed.withColumn("half", half).drop("s_cost")
    half = F.col("half")
    cut = placed.withColumn("bin", F.call_function("div", F.col("p"), half)).withColumn("long", F.col("cost") > half)
    reach = (~F.col("long")) & ((F.col("bin") + 1) * half - F.col("p") <= history)
    turn = F.struct("p", "bin", "long", "role", "text", "cost")
    bins = (
        cut.withColumn("at", F.explode(F.when(reach, F.array(F.col("bin"), F.col("bin") + 1)).otherwise(F.array("bin"))))
        .groupBy("conv_id", "at").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    )
    own = F.filter("turns", lambda t: t["bin"] == F.col("at"))
    spans = (
        bins.select(
            "conv_id", "at", "turns",
            F.explode(F.array(F.filter(own, lambda t: ~t["long"]), F.filter(own, lambda t: t["long"]))).alias("span"),
        )
        .filter(F.size("span") > 0)
        .withColumn("start", F.col("span")[0]["p"])
        .withColumn("window", 2 * F.col("at") + F.col("span")[0]["long"].cast("long"))
        .withColumn("past", F.filter("turns", lambda t: (t["p"] < F.col("start")) & (F.col("start") - t["p"] <= history)))
        .drop("turns")
    )
    joined = spans.join(system, F.col("conv_id").eqNullSafe(F.col("s_conv")), "left")
    with_system = (F.col("start") > 0) & F.col("s_text").isNotNull()
    # The system turn must not come twice where the history reaches back to it.
    past = F.filter("past", lambda t: ~(with_system & (t["p"] == 0)))
    render = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END))
    rows = joined.withColumn("past", past).withColumn(
        "head", F.concat(F.when(with_system, F.col("s_text")).otherwise(F.lit("")), F.array_join(F.transform("past", render), ""))
    )
    state = F.struct(F.length("head").cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss"))

    def step(acc: Column, t: Column) -> Column:
        role, body = F.length(escape(t["role"])), F.length(escape(t["text"]))
        start = (acc["at"] + len(TURN) + role + len(TEXT)).cast("long")
        mark = F.struct(start.alias("start"), body.cast("long").alias("length"))
        return F.struct(
            (start + body + len(END)).cast("long").alias("at"),
            F.when(t["role"] == "assistant", F.concat(acc["loss"], F.array(mark))).otherwise(acc["loss"]).alias("loss"),
        )

    return rows.select(
        "conv_id", "window",
        F.concat("head", F.array_join(F.transform("span", render), "")).alias("formatted"),
        (F.size("past") + with_system.cast("int")).alias("repeated"),
        F.aggregate("span", state, step, lambda s: s["loss"]).alias("loss"),
        (
            F.aggregate(F.concat("past", "span"), F.lit(0).cast("long"), lambda a, t: a + t["cost"])
            + F.when(with_system, F.col("s_cost")).otherwise(F.lit(0))
        ).alias("cost"),
    )


def read_turns(windows: DataFrame) -> DataFrame:
    """Parse windows back: adds `turns` (array of struct(role, text), repeats left out) and `learned` (array of the
    unescaped texts under the loss mask)."""
    parts = F.slice(F.split("formatted", r"\Q" + END + r"\E"), F.lit(1), F.size(F.split("formatted", r"\Q" + END + r"\E")) - 1)
    body = lambda t: F.split(F.substring(t, len(TURN) + 1, 2**31 - 1), r"\Q" + TEXT + r"\E")
    fresh = lambda p: F.slice(p, F.col("repeated") + 1, F.size(p))
    return windows.withColumn("parts", parts).withColumn(
        "turns",
        F.transform(
            fresh(F.col("parts")), lambda t: F.struct(unescape(body(t)[0]).alias("role"), unescape(body(t)[1]).alias("text"))
        ),
    ).withColumn(
        "learned",
        F.transform("loss", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int")))),
    ).drop("parts")


def op2_chat(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"),
    )
    windows = format_windows(table.unionByName(extra))
    back = read_turns(windows).select(
        "conv_id", "window", F.size("turns").cast("long").alias("n"), F.length("formatted").cast("long").alias("chars"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("learned", "").alias("learned"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("window", "said", "learned")))
    return back.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), ordered.alias("w"), F.sum("chars").alias("formatted_chars")
    ).select(
        "conv_id", "n_turns",
        F.sha2(F.array_join(F.transform("w", lambda x: x["said"]), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(F.array_join(F.transform("w", lambda x: x["learned"]), "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join(F.transform("w", lambda x: x["learned"]), "").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
