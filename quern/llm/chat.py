r"""Chat formatting with a grammar round trip, in DataFrame operations alone.

A turn is rendered as `[INST]role[TEXT]text[/INST]</s>`. The deterministic grammar splits at the closing string, takes
the role up to the first `[TEXT]` and undoes escapes: of `\`, `[` or `<` followed by a backslash the backslash goes.
A turn is first rendered as it is. What the grammar does not give back unchanged is rendered again with a backslash
after each of these characters, after which no control string is left in it. Whole conversations are then parsed once
more; should one differ, all its turns are escaped, and a difference that is left raises an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import read

OPEN, TEXT, CLOSE = "[INST]", "[TEXT]", "[/INST]</s>"
CLOSE_PATTERN = r"\[/INST\]</s>"


def escape(content: Column) -> Column:
    return F.regexp_replace(content, r"[\\\[<]", r"$0\\")


def unescape(content: Column) -> Column:
    return F.regexp_replace(content, r"([\\\[<])\\", "$1")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(TEXT), text, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """Turns of a rendered string: role, text, and content, the text as it stands there. Null where the grammar fails."""
    parts = F.split(formatted, CLOSE_PATTERN, -1)
    bodies = F.slice(parts, 1, F.size(parts) - 1)

    def turn(body: Column) -> Column:
        inner = F.substring(body, F.lit(len(OPEN) + 1), F.length(body))
        cut = F.instr(inner, TEXT)
        content = F.substring(inner, cut + len(TEXT), F.length(inner))
        return F.struct(unescape(F.substring(inner, F.lit(1), cut - 1)).alias("role"), unescape(content).alias("text"), content.alias("content"))

    sound = (F.element_at(parts, -1) == "") & F.forall(bodies, lambda b: b.startswith(OPEN) & (F.instr(b, TEXT) > 0))
    return F.when(sound, F.transform(bodies, turn))


def source_turns(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def parsed_turns(formatted: Column) -> Column:
    return F.transform(parse(formatted), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its id, formatted (the rendered string) and loss_spans (start, length in code points of
    each assistant text as it stands in formatted).

    Null roles and texts count as empty. Rows of one turn number stay apart, ordered by role and text; a null number
    comes first; rows with a null id form one conversation. Other columns are ignored; an empty table gives an empty
    table. A conversation is one value, so its turns meet in one row; nothing larger than a conversation does.
    """
    role_text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), *role_text)
    once = parsed_turns(render(F.col("role"), F.col("text")))
    same = F.coalesce(once == F.array(F.struct("role", "text")), F.lit(False))
    rows = rows.withColumn("piece", F.when(same, render(F.col("role"), F.col("text"))).otherwise(render(escape(F.col("role")), escape(F.col("text")))))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "piece"))).alias("turns"))
    first = F.array_join(F.transform("turns", lambda t: t["piece"]), "")
    chats = chats.withColumn("formatted", first)
    whole = F.array_join(F.transform("turns", lambda t: render(escape(t["role"]), escape(t["text"]))), "")
    agrees = lambda: F.coalesce(parsed_turns(F.col("formatted")) == source_turns(F.col("turns")), F.lit(False))
    chats = chats.withColumn("formatted", F.when(agrees(), F.col("formatted")).otherwise(whole))
    chats = chats.withColumn("formatted", F.when(agrees(), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip"))))
    return chats.select(F.col("conv_id").alias(conv_id), "formatted", loss_spans(F.col("formatted")).alias("loss_spans"))


def loss_spans(formatted: Column) -> Column:
    bodies = F.split(formatted, CLOSE_PATTERN, -1)
    empty = F.array().cast("array<struct<start:bigint,length:bigint>>")

    def add(state: Column, body: Column) -> Column:
        ahead = F.instr(body, TEXT) + len(TEXT) - 1
        span = F.struct((state["at"] + ahead).cast("bigint").alias("start"), (F.length(body) - ahead).cast("bigint").alias("length"))
        mine = body.startswith(OPEN + "assistant" + TEXT)
        return F.struct((state["at"] + F.length(body) + len(CLOSE)).cast("bigint").alias("at"), F.when(mine, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(bodies, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("spans")), add, lambda s: s["spans"])


def read_back(chats: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Digests made from formatted and its loss spans alone."""
    turns = parse(F.col("formatted"))
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    read = chats.select(conv_id, "formatted", turns.alias("turns"), F.array_join(masked, "").alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conv_id,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


CONFLICT = "</s>[INST] ok [/INST]"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql(f"SELECT bigint(-7) AS conv_id, bigint(turn) AS turn, role, '{CONFLICT}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    return read_back(format_chats(turns.unionByName(planted)))


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(role) + length(text) + length('[INST][TEXT][/INST]</s>')
         + CASE WHEN contains(role || text, '[/INST]</s>') OR contains(role, '[TEXT]') OR regexp_matches(role || ' ' || text, '[\\\[<]\\')
                THEN length(regexp_replace(role || text, '[^\\\[<]', '', 'g')) ELSE 0 END AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
