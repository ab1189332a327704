"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens cut a conversation into turn-aligned spans, greedily: a span takes turns while they fit the
stride. The token axis is divided into stretches of `STRETCH` strides, spans start anew at each, and the starts of one
stretch are found in one pass over its turns, a bounded number; so a conversation with a third of all rows spreads over
tasks and has at most one span more for each `STRETCH` than greedy spans from its first turn on, shorter ones none. The
sums are taken in two levels (chunks of turns, then chunk totals). A window is a span, headed by the conversation's
system turn and by the last turns before it that have at most `history` tokens and fit the rest of the budget. No window
exceeds the budget but one whose single turn does so together with the system turn (its `n_tokens` says so).

Template: `<|im_start|>role`, newline, text, `<|im_end|>`, newline. In texts `<|` becomes `<%|`, and `<%|` becomes
`<%%|` and so on, so texts hold no control string and the escape can be undone; roles escape %, < and newline by code.
The loss mask is a list of spans of the window, which cover assistant texts that are new in it: repeated turns, and so
repeated targets, have no loss.

Defined results: null roles and texts are empty; turns go by (turn, role, text), nulls first, repeated rows stay; the
system turn is a first turn of role `system`; a null conv_id is a conversation; an empty table has no windows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Tokens of a window, of its history at most, turns of a chunk of the prefix sums, and strides of a stretch.
BUDGET, HISTORY, CHUNK, STRETCH = 1024, 256, 64, 64
START, END = "<|im_start|>", "<|im_end|>\n"


def tokens(text: Column) -> Column:
    """Tokens of a turn, about: a quarter of the bytes, rounded up, and four for the template."""
    return F.floor((F.octet_length(text) + 3) / 4).cast("long") + 4


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(%*)\|", "<%$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<%(%*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


#: A conversation's key: its id and whether that is null, so that joins and windows share one partitioning.
KEY = ["conv", "nil"]


def placed_turns(turns: DataFrame, chunk: int, tokens_col: str | None = None) -> DataFrame:
    """(conv, nil, role, text, n, idx, p, sys, head), conv_id being of any type that a string can hold: the tokens n of a
    turn (those of `tokens_col` and four for the template, if given), its place idx in its conversation, the tokens p
    before it without the system turn's, the system turn's tokens, and whether it is that turn.

    Rows are shuffled once, to their chunk; chunk totals, a row each, carry on from chunk to chunk."""
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("conv_id").isNull().alias("nil"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        *([F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)).alias("given")] if tokens_col else []),
    )
    rows = rows.withColumns({"n": F.col("given") + 4 if tokens_col else tokens(F.col("text")), "chunk": F.coalesce(F.expr(f"turn div {chunk}"), F.lit(-(1 << 62)))})
    inside = Window.partitionBy(*KEY, "chunk").orderBy(F.asc_nulls_first("turn"), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"i0": F.count(F.lit(1)).over(inside), "p0": F.coalesce(F.sum("n").over(inside), F.lit(0))})
    totals = rows.groupBy(*KEY, "chunk").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.max(F.when((F.col("i0") == 0) & (F.col("role") == "system"), F.col("n"))).alias("h"))
    order = Window.partitionBy(*KEY).orderBy("chunk")
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*KEY, "chunk", F.coalesce(F.sum("c").over(above), F.lit(0)).alias("c"), F.coalesce(F.sum("s").over(above), F.lit(0)).alias("s"), F.coalesce(F.first("h").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("sys"))
    rows = rows.join(totals, [*KEY, "chunk"]).withColumns({"idx": F.col("i0") + F.col("c"), "p": F.col("p0") + F.col("s")})
    head = (F.col("idx") == 0) & (F.col("sys") > 0)
    return rows.select(*KEY, "role", "text", "n", "idx", F.when(head, 0).otherwise(F.col("p") - F.col("sys")).alias("p"), "sys", head.alias("head"))


def span_starts(rows: DataFrame) -> DataFrame:
    """(conv, nil, stretch, starts): the idx and p at which spans start, in order; a stretch holds a bounded number of
    turns, since each has four tokens at least."""
    turn = F.struct("p", "n", "idx")
    open_ = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("room"), F.expr("cast(array() as array<struct<idx:bigint,p:bigint>>)").alias("starts"))

    def step(a: Column, x: Column) -> Column:
        more = F.struct(x.p.alias("at"), a.room.alias("room"), F.array_append(a.starts, F.struct(x.idx.alias("idx"), x.p.alias("p"))).alias("starts"))
        return F.when((a["at"] < 0) | (x.p + x.n - a["at"] > F.col("stride")), more).otherwise(a)

    own = rows.where("not head").groupBy(*KEY, "stretch", "stride").agg(F.array_sort(F.collect_list(turn)).alias("xs"))
    return own.select(*KEY, "stretch", F.aggregate("xs", open_, step, lambda a: a.starts).alias("starts"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, chunk: int = CHUNK, stretch: int = STRETCH, tokens_col: str | None = None) -> DataFrame:
    """(conv_id, window, formatted, loss_spans, n_repeated, n_tokens): windows of each conversation, numbered in order with
    gaps.

    `loss_spans` are (start, length) in code points of `formatted`; the first n_repeated turns of it were new before.
    Placed turns are written out once (a checkpoint), as spans, histories and system turns all read them."""
    left = F.lit(budget) - F.col("sys")
    rows = placed_turns(turns, chunk, tokens_col).withColumn("stride", F.greatest(left - history, F.least(F.lit(budget // 4).cast("long"), left), F.lit(1).cast("long")))
    rows = cut(rows.withColumn("stretch", F.expr(f"p div (stride * {stretch})")))
    # a turn's span is the last one that starts at or before it; the system turn goes with the first
    spans = rows.join(span_starts(rows), [*KEY, "stretch"], "left")
    mine = F.element_at(F.filter("starts", lambda x: x.idx <= F.col("idx")), -1)
    first = (F.col("sys") > 0).cast("long")  # idx of the first turn behind the system turn
    at = F.when(F.col("head") | F.col("starts").isNull(), F.lit(0).cast("long")).otherwise(F.when(mine["idx"] == first, 0).otherwise(mine["idx"]))
    rows = cut(spans.withColumn("w", at).select(*KEY, "role", "text", "n", "idx", "p", "sys", "head", "w"))
    own = rows.select(*KEY, "w", "idx", F.lit(False).alias("repeated"), "role", "text", "n")
    later = rows.where("w > 0").groupBy(*KEY, "w").agg(F.min("p").alias("p0"), F.max("sys").alias("sys"), F.sum("n").alias("n"))
    later = later.withColumn("reach", F.least(F.lit(history).cast("long"), F.lit(budget) - F.col("sys") - F.col("n")))
    system = rows.where("head").select(*KEY, "text", "n")
    kept = later.where("sys > 0").drop("n").join(system, KEY).select(*KEY, "w", F.lit(0).cast("long").alias("idx"), F.lit(True).alias("repeated"), F.lit("system").alias("role"), "text", "n")
    near = later.where("reach > 0").select(*KEY, F.col("w").alias("to"), F.col("p0").alias("until"), "reach", F.explode(F.array_distinct(F.array(F.expr(f"greatest(0, p0 - {history}) div {history}"), F.expr(f"(p0 - 1) div {history}")))).alias("b"))
    past = rows.where("not head").select(*KEY, F.expr(f"p div {history}").alias("b"), "p", "idx", "role", "text", "n")
    again = past.join(near, [*KEY, "b"]).where("p < until and p >= until - reach").select(*KEY, F.col("to").alias("w"), "idx", F.lit(True).alias("repeated"), "role", "text", "n")
    return render(own.union(kept).union(again)).withColumn("conv_id", F.when(~F.col("nil"), F.col("conv")).cast(turns.schema["conv_id"].dataType)).select("conv_id", "window", "formatted", "loss_spans", "n_repeated", "n_tokens")


def render(rows: DataFrame) -> DataFrame:
    """Turns of each window in order, in the template; a window has as many turns as the budget lets it."""
    part = F.struct("idx", "repeated", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("before"), escape(F.col("text")).alias("body"), (~F.col("repeated") & (F.col("role") == "assistant")).alias("target"))
    grouped = rows.select(*KEY, "w", "n", part.alias("x")).groupBy(*KEY, "w").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.sum("n").alias("n_tokens"))
    spans = F.aggregate(
        "xs",
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans")),
        lambda a, x: F.struct(
            (a.at + F.length(x.before) + F.length(x.body) + len(END)).alias("at"),
            F.when(x.target & (F.length(x.body) > 0), F.array_append(a.spans, F.struct((a.at + F.length(x.before)).alias("start"), F.length(x.body).cast("long").alias("length")))).otherwise(a.spans).alias("spans"),
        ),
        lambda a: a.spans,
    )
    formatted = F.array_join(F.transform("xs", lambda x: F.concat(x.before, x.body, F.lit(END))), "")
    return grouped.select(*KEY, F.col("w").alias("window"), formatted.alias("formatted"), spans.alias("loss_spans"), F.size(F.filter("xs", lambda x: x.repeated)).alias("n_repeated"), "n_tokens")


def read_turns(formatted: Column, n_repeated: Column) -> Column:
    """array<struct<role, text>> of the turns that are new in a window, read back from its formatted text."""
    blocks = F.split(formatted, r"<\|im_end\|>\n")
    new = F.slice(blocks, n_repeated + 1, F.greatest(F.size(blocks) - 1 - n_repeated, F.lit(0)))
    bodies = F.transform(new, lambda b: F.substring(b, len(START) + 1, 1 << 30))
    return F.transform(bodies, lambda b: F.struct(unescape_role(F.substring_index(b, "\n", 1)).alias("role"), unescape(F.substring(b, F.instr(b, F.lit("\n")) + 1, F.lit(1 << 30))).alias("text")))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are control strings, formatted and read back."""
    probe = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = windows(turns)
    new = out.withColumn("turns", read_turns(F.col("formatted"), F.col("n_repeated")))
    each = new.select(
        "conv_id", "window", F.size("turns").alias("n"), F.length("formatted").alias("chars"),
        F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "").alias("said"),
        F.array_join(F.transform("loss_spans", lambda x: unescape(F.substring(F.col("formatted"), (x.start + 1).cast("int"), x.length.cast("int")))), "").alias("loss"),
    )
    said, loss = F.array_join("ws.said", ""), F.array_join("ws.loss", "")
    whole = each.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"), F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("ws"))
    return whole.select("conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_windows")


OP3_SQL = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS idx, (strlen(text) + 3) // 4 + 4 AS n,
  12 + length(replace(replace(replace(role, '%', '%25'), '<', '%3C'), chr(10), '%0A')) + 1 + length(regexp_replace(text, '<(%*)\\|', '<%\\1|', 'g')) + 11 AS chars FROM c),
h AS (SELECT *, idx = 0 AND role = 'system' AS head FROM o),
s AS (SELECT *, coalesce(max(CASE WHEN head THEN n END) OVER (PARTITION BY conv_id), 0) AS sys, coalesce(max(CASE WHEN head THEN chars END) OVER (PARTITION BY conv_id), 0) AS sys_chars,
  CASE WHEN head THEN 0 ELSE coalesce(sum(CASE WHEN head THEN 0 ELSE n END) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS p FROM h),
k AS (SELECT *, CAST(greatest({BUDGET - HISTORY} - sys, least({BUDGET // 4}, {BUDGET} - sys), 1) AS BIGINT) AS stride FROM s),
g AS (SELECT *, p // (stride * {STRETCH}) AS stretch, row_number() OVER (PARTITION BY conv_id ORDER BY idx) AS k FROM k WHERE NOT head),
walk(conv_id, k, stretch, start, first) AS (SELECT conv_id, k, stretch, p, idx FROM g WHERE k = 1
  UNION ALL SELECT g.conv_id, g.k, g.stretch, CASE WHEN g.stretch > walk.stretch OR g.p + g.n - walk.start > g.stride THEN g.p ELSE walk.start END, CASE WHEN g.stretch > walk.stretch OR g.p + g.n - walk.start > g.stride THEN g.idx ELSE walk.first END
  FROM walk JOIN g ON g.conv_id IS NOT DISTINCT FROM walk.conv_id AND g.k = walk.k + 1),
w AS (SELECT k.*, CASE WHEN head THEN 0 WHEN walk.first = CASE WHEN sys > 0 THEN 1 ELSE 0 END THEN 0 ELSE walk.first END AS w FROM k LEFT JOIN walk ON walk.conv_id IS NOT DISTINCT FROM k.conv_id AND walk.k = k.idx + CASE WHEN sys > 0 THEN 0 ELSE 1 END AND NOT head),
l AS (SELECT conv_id, w, min(p) AS p0, max(sys_chars) AS sys_chars, least({HISTORY}, {BUDGET} - max(sys) - sum(n)) AS reach FROM w WHERE w > 0 GROUP BY 1, 2),
r AS (SELECT l.conv_id, sum(t.chars) AS chars FROM l JOIN w t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND NOT t.head AND t.p < l.p0 AND t.p >= l.p0 - l.reach GROUP BY 1),
y AS (SELECT conv_id, sum(sys_chars) AS chars FROM l GROUP BY 1)
SELECT w.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY idx), '')) AS loss_sha256,
  CAST(sum(w.chars) + coalesce(max(r.chars), 0) + coalesce(max(y.chars), 0) AS BIGINT) AS formatted_chars, count(DISTINCT w.w) AS n_windows
FROM w LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM w.conv_id GROUP BY w.conv_id
"""
