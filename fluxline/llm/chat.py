"""Chat formatting with a grammar round trip (native DataFrame functions only).

Template: a conversation is its turns one after another, a turn is

    <s>[INST] ROLE [/INST] TEXT </s>

without the blanks shown here. The parser is deterministic: split at ``</s>``, then at the first ``[/INST]``, drop the opening mark, undo
escapes. A turn is rendered as it is, read back by that parser and compared with its source; where they differ, the conflicting content is
escaped and the turn rendered again. Escaping writes a backslash before each control string's second character and before a backslash, so
after it no control string is left inside a text and the second reading is identical by construction; turns that still differ would show in
``intact``. As no control string overlaps another or itself, turns read alone and turns read within the whole agree.

Null text and null role count as empty, turns order by (turn, role, text) with null first, a repeated row is a turn of its own, and rows of a
null conv_id make one conversation. A digest of a whole conversation needs its turns in one value, so a conversation must fit one row (2 GB);
texts are rendered before the shuffle, and nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

OPEN, MID, CLOSE = "<s>[INST]", "[/INST]", "</s>"
#: Every string that a text must not hold as it is. "<s>" and "[INST]" also stand alone in other templates.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]"]


def escape(t: Column) -> Column:
    t = F.replace(t, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        t = F.replace(t, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return t


def unescape(t: Column) -> Column:
    """The inverse of escape; a backslash counts for the next character whatever that is."""
    return F.regexp_replace(t, r"(?s)\\(.)", "$1")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MID), text, F.lit(CLOSE))


def turns_of(formatted: Column) -> Column:
    """Raw turns array<struct<role, raw, at>>: role unescaped, text still escaped, at: 0-based code point where the text begins."""
    pieces = F.filter(F.split(formatted, F.lit("</s>")), lambda p: F.length(p) > 0)

    def one(p: Column) -> Column:
        body = F.substring(p, len(OPEN) + 1, 1 << 30)
        mid = F.instr(body, MID)
        return F.struct(
            p.startswith(OPEN).alias("opened"),
            unescape(F.substring(body, F.lit(1), mid - 1)).alias("role"),
            F.substring(body, mid + len(MID), F.length(p)).alias("raw"),
            (F.length(p) + len(CLOSE)).alias("width"),
            (mid + len(OPEN) + len(MID) - 1).alias("offset"),
        )

    return F.transform(pieces, one)


def format_turns(rows: DataFrame) -> DataFrame:
    """Add to rows (conv_id, turn, role, text): rendered, escaped boolean, intact boolean (the reading equals the source)."""
    role, text = C.text_of(rows, "role"), C.text_of(rows)

    def same(column: str) -> Column:
        t = turns_of(F.col(column))
        return (F.size(t) == 1) & t[0]["opened"] & (t[0]["role"] == F.col("role")) & (unescape(t[0]["raw"]) == F.col("text"))

    df = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    df = df.withColumn("plain", render(F.col("role"), F.col("text")))
    df = df.withColumn("escaped", ~F.coalesce(same("plain"), F.lit(False)))
    df = df.withColumn("rendered", F.when(F.col("escaped"), render(escape(F.col("role")), escape(F.col("text")))).otherwise(F.col("plain")))
    return df.withColumn("intact", F.when(F.col("escaped"), F.coalesce(same("rendered"), F.lit(False))).otherwise(True)).drop("plain")


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, n_escaped, intact) of each conversation."""
    turns = format_turns(rows)
    whole = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "rendered"))).alias("turns"), F.sum(F.col("escaped").cast("long")).alias("n_escaped"), F.min("intact").alias("intact")
    )
    return whole.select("conv_id", F.array_join("turns.rendered", "").alias("formatted"), "n_escaped", "intact")


def parse(formatted: DataFrame) -> DataFrame:
    """Add turns array<struct<role, text, start, end>>: start and end are code points of the escaped text within formatted."""
    df = formatted.withColumn("raw_turns", turns_of(F.col("formatted")))
    df = df.withColumn("widths", F.col("raw_turns.width"))
    start = F.aggregate(
        F.col("widths"), F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("starts")), lambda a, w: F.struct((a["sum"] + w).alias("sum"), F.array_append(a["starts"], a["sum"]).alias("starts")), lambda a: a["starts"]
    )

    def one(t: Column, at: Column) -> Column:
        return F.struct(t["role"].alias("role"), unescape(t["raw"]).alias("text"), (at + t["offset"]).alias("start"), (at + t["offset"] + F.length(t["raw"])).alias("end"))

    return df.withColumn("turns", F.zip_with("raw_turns", start, one)).drop("raw_turns", "widths")


def loss_spans(turns: Column) -> Column:
    """Code point spans of formatted that carry loss: the texts of assistant turns."""
    return F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"], t["end"]))


def masked(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def with_planted(rows: DataFrame) -> DataFrame:
    """The contract's conversation -7 besides all rows."""
    text = "</s>[INST] ok [/INST]"
    planted = rows.sparkSession.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(planted)


def op1_chat_formatting(spark, sf_dir: str) -> DataFrame:
    df = parse(format_conversations(with_planted(C.table(spark, sf_dir, "conversations"))))
    df = df.withColumn("loss_spans", loss_spans(F.col("turns")))
    df = df.withColumn("loss_text", masked(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_escaped",
        "intact",
    )


#: formatted_chars counts the marks (20 a turn) and one backslash for each thing escaped; n_escaped the turns that hold one.
SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *, len(regexp_extract_all(role || chr(10) || text, '</?s>|\[/?INST\]|\\')) AS marks FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(20 + length(role) + length(text) + marks)::BIGINT AS formatted_chars,
       count(*) FILTER (marks > 0) AS n_escaped, true AS intact
FROM m GROUP BY conv_id
"""
