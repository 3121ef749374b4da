"""Chat formatting with typed content parts, in DataFrame functions only.

A visitor turns every content part into text: a text part is escaped, an image, audio or
document part becomes an ordered placeholder, and what it refers to and the tokens it will
expand to are recorded. The template marks turns; control strings inside texts are escaped by
one backslash after their first character, which parsing takes away again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURN, TEXT, END = "<|turn|>", "<|text|>", "</s>"
#: What may not stand in a text as it is: the first character, backslashes of earlier escapes, and the rest.
_REST = r"(/?s>|/?INST\]|/?<SYS>>|<?/?SYS>>|\|[A-Za-z0-9_:]+\|>)"
CONTROL = r"([<\[])(\\*)" + _REST
ESCAPED = r"([<\[])(\\*)\\" + _REST
#: A content part. Sizes are those that the expansion needs; what a kind doesn't have is null.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens: image patches of so many pixels square, audio frames a second, tokens a document page.
PATCH, FRAMES, PAGE = 28, 25.0, 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def expanded(part: Column) -> Column:
    """Tokens that a part's placeholder stands for: at least 1; unknown sizes count as the least."""
    least = lambda x: F.greatest(F.coalesce(F.ceil(x), F.lit(1)).cast("long"), F.lit(1).cast("long"))
    image = least(part["width"] / PATCH) * least(part["height"] / PATCH)
    return F.when(part["type"] == "image", image).when(part["type"] == "audio", least(part["seconds"] * FRAMES)).when(part["type"] == "document", least(part["pages"].cast("double")) * PAGE).otherwise(1).cast("long")


def is_text(part: Column) -> Column:
    return F.coalesce(part["type"] == "text", F.lit(True))


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str | None = "text", parts: str | None = None, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, n_turns, loss, attachments, attachment_tokens), one row for each conversation. An empty table gives no rows.

    loss lists the (start, length) spans of the content of the trained roles' turns, in code points
    from 0. attachments lists (ordinal, type, ref, tokens) of all parts that aren't text.
    parts names a column of arrays of PART; without it, or where it is null, the text column is
    the one text part. Turns go by turn (null first), then role and content, so that repeated
    rows stay and order is defined. Null roles and texts are empty; null conversation ids are
    one conversation. A part without a type is text; other types are kept as they are named.
    Extra columns are ignored. One shuffle, on the conversation.
    """
    one = F.array(F.struct(F.lit("text").alias("type"), (F.col(text).cast("string") if text else F.lit(None).cast("string")).alias("text"), *(F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))
    content = F.coalesce(F.col(parts).cast(f"array<{PART}>"), one) if parts else one
    base = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), content.alias("parts"))
    base = base.withColumn("others", F.filter("parts", lambda p: ~is_text(p)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("seq", F.row_number().over(order)).withColumn("before", F.coalesce(F.sum(F.size("others")).over(upto), F.lit(0)))

    def visit(part: Column, i: Column) -> Column:
        rank = F.size(F.filter(F.slice(F.col("parts"), F.lit(1), i + 1), lambda p: ~is_text(p)))
        name = F.regexp_replace(part["type"], "[^A-Za-z0-9_]", "_")
        return F.when(is_text(part), escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), name, F.lit(":"), (F.col("before") + rank).cast("string"), F.lit("|>")))

    # Text parts of a turn that follow each other are escaped apart; an escape can't form across them, as the pieces are joined by a line break.
    base = base.withColumn("content", F.array_join(F.transform("parts", visit), "\n"))
    head = F.concat(F.lit(TURN), escape("role"), F.lit(TEXT))
    base = base.withColumn("head", head).withColumn("chars", F.length("head") + F.length("content") + len(END))
    base = base.withColumn("at", F.coalesce(F.sum("chars").over(upto), F.lit(0)))
    span = F.when(F.col("role").isin(*trained), F.struct((F.col("at") + F.length("head")).cast("int").alias("start"), F.length("content").alias("length")))
    refs = F.transform("others", lambda p, i: F.struct((F.col("before") + i + 1).cast("int").alias("ordinal"), p["type"].alias("type"), p["ref"].alias("ref"), expanded(p).alias("tokens")))
    turns = F.array_sort(F.collect_list(F.struct("seq", F.concat("head", "content", F.lit(END)).alias("text"), span.alias("span"), refs.alias("refs"))))
    done = base.groupBy("conv_id").agg(turns.alias("turns"))
    attached = F.flatten(F.transform("turns", lambda t: t["refs"]))
    done = done.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("formatted"),
        F.size("turns").cast("long").alias("n_turns"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss"),
        attached.alias("attachments"),
    )
    return done.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def parse_chats(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation, unescaped."""
    body = F.slice(F.split(formatted, r"<\|turn\|>"), 2, F.greatest(F.size(F.split(formatted, r"<\|turn\|>")) - 1, F.lit(0)))

    def one(x: Column) -> Column:
        at = F.locate(TEXT, x) if isinstance(x, str) else F.instr(x, TEXT)
        text = F.substring(x, at + len(TEXT), F.length(x) - at - (len(TEXT) - 1) - len(END))
        return F.struct(unescape(F.substring(x, F.lit(1), at - 1)).alias("role"), unescape(text).alias("text"))

    return F.transform(body, one)


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from formatted and loss alone."""
    turns = parse_chats(F.col("formatted"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    seen = chats.select("conv_id", "formatted", turns.alias("turns"), F.array_join(masked, "").alias("masked"))
    return seen.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(told, "UTF-8"), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.encode("masked", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def chat_sql() -> str:
    """What the query returns, in DuckDB SQL."""
    esc = lambda x: f"regexp_replace({x}, '{CONTROL}', '\\1\\2\\\\\\3', 'g')"
    return f"""
        WITH c AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), t AS (
          SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
            coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS masked,
            sum(length('{TURN}{TEXT}{END}') + length({esc("role")}) + length({esc("text")}))::BIGINT AS formatted_chars
          FROM c GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(masked)::BIGINT AS loss_chars, sha256(masked) AS loss_sha256, formatted_chars FROM t
    """
