"""Chat formatting as one relational expression (DataFrame functions only).

Turns of a conversation are collected as structs, sorted, and adjacent turns of one role
are merged into one block by array aggregation. A block is ``<turn:ROLE>`` + texts, with
``<and/>`` between merged texts, + ``</turn>`` + newline. In roles and texts a backslash
becomes ``\\b``, ``<`` becomes ``\\l`` and, in roles, ``>`` becomes ``\\g``; so a control string can
never arise from a text and the original comes back exactly. The loss mask is a list of
[start, end) spans, in code points, over the formatted string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlane.llm.common import read

OPEN, MID, CLOSE, AND = "<turn:", ">", "</turn>\n", "<and/>"
#: Turns whose offsets are summed together, so that long conversations do not copy growing lists.
STEP = 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _role_in(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def _role_out(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\g"), F.lit(">")))


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv``, ``formatted`` and ``loss_spans``.

    Turns sort by turn number (NULL first), then role, then text; repeated rows are turns
    of their own. NULL role or text counts as empty; a NULL conversation id is an id like
    any other. An empty table gives no rows; other columns are not carried.
    """
    plain = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    chats = rows.groupBy(F.col(conv)).agg(F.sort_array(F.collect_list(plain)).alias("_turns"))
    safe = F.transform("_turns", lambda t: F.struct(_role_in(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == loss_role).alias("loss")))
    chats = chats.select(conv, safe.alias("_turns"))
    turns = F.col("_turns")
    # a turn opens a block if its role differs from the one before, and closes it if it differs from the next
    other = lambda i, j: (j < 0) | (j >= F.size(turns)) | (F.get(turns, j)["role"] != F.get(turns, i)["role"])

    def pieces(t: Column, i: Column) -> Column:
        head = F.when(other(i, i - 1), F.concat(F.lit(OPEN), t["role"], F.lit(MID))).otherwise(F.lit(AND))
        tail = F.when(other(i, i + 1), F.lit(CLOSE)).otherwise(F.lit(""))
        return F.struct(head.alias("head"), t["text"].alias("text"), tail.alias("tail"), t["loss"].alias("loss"))

    chats = chats.select(conv, F.transform(turns, pieces).alias("_pieces"))
    whole = F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["text"], p["tail"])), "")
    size = lambda p: F.length(p["head"]) + F.length(p["text"]) + F.length(p["tail"])
    steps = F.transform(F.sequence(F.lit(0), F.floor(F.size("_pieces") / STEP).cast("int")), lambda b: F.slice("_pieces", b * STEP + 1, STEP))
    chats = chats.select(conv, whole.alias("formatted"), steps.alias("_steps"))
    # where each step begins, then the spans within it
    begins = F.aggregate(F.transform("_steps", lambda s: F.aggregate(s, F.lit(0).cast("long"), lambda n, p: n + size(p))), F.array(F.lit(0).cast("long")), lambda ends, n: F.concat(ends, F.array(F.element_at(ends, -1) + n)))

    def advance(state: Column, p: Column) -> Column:
        begin = state["at"] + F.length(p["head"])
        span = F.array(F.struct(begin.alias("start"), (begin + F.length(p["text"])).alias("end")))
        return F.struct((state["at"] + size(p)).alias("at"), F.when(p["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    def spans(step: Column) -> Column:
        start = F.struct(step["at"].alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
        return F.aggregate(step["pieces"], start, advance, lambda s: s["spans"])

    found = F.flatten(F.transform(F.arrays_zip(F.slice(begins, 1, F.size("_steps")).alias("at"), F.col("_steps").alias("pieces")), spans))
    return chats.select(conv, "formatted", found.alias("loss_spans"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """Add ``turns`` (array of role and text, as they went in) and ``loss_texts`` read from the output."""
    blocks = F.filter(F.split("formatted", F.lit(CLOSE)), lambda b: b != "")
    block = lambda b: F.transform(
        F.split(F.regexp_replace(b, "^<turn:[^>]*>", ""), F.lit(AND)),
        lambda x: F.struct(_role_out(F.regexp_extract(b, "^<turn:([^>]*)>", 1)).alias("role"), unescape(x).alias("text")),
    )
    texts = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumns({"turns": F.flatten(F.transform(blocks, block)), "loss_texts": texts})


def op6_relational_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text")
    )
    back = parse_chats(format_chats(rows.unionByName(extra)))
    spoken = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(spoken).cast("long").alias("loss_chars"),
        F.sha2(spoken, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), o AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before, lead(role) OVER w AS after,
         replace(replace(text, '\', '\b'), '<', '\l') AS safe,
         replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g') AS safe_role
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text))
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(safe) + CASE WHEN before IS NULL OR before <> role THEN length(safe_role) + 7 ELSE 6 END
           + CASE WHEN after IS NULL OR after <> role THEN 8 ELSE 0 END)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""

QUERIES = {"op6_relational_chat": op6_relational_chat}
ORACLES = {"op6_relational_chat": OP6_SQL}
