"""Chat formatting with a grammar round trip.

A conversation is its turns one after another::

    ### <role>: <text>
    </turn>

In texts ``### `` and ``</turn>`` are control strings. A turn is first rendered as it
is and reparsed by the grammar, in which a control string that no backslash precedes
is always a mark; where the result is not the source, the turn is rendered
again with a backslash more before every control string (and the backslashes
before it), which the parser takes away again. In roles, ``%``, ``:``, ``<``, ``#``, backslashes and line
breaks are written as %XX. The whole is parsed once more and compared with
the source; a difference is an error, never a changed text.

Everything is DataFrame functions. Null texts and roles are empty; turns go by number, nulls first, ties
by role and text, and repeated rows are turns of their own. Rows with a null conv_id are
one conversation. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, SEP, END = "### ", ": ", "\n</turn>\n"
# a control string with the backslashes before it
CONTROL = r"(\\*)(### |</turn>)"
ROLE_CODES = (("%", "%25"), (":", "%3A"), ("<", "%3C"), ("#", "%23"), ("\\", "%5C"), ("\n", "%0A"), ("\r", "%0D"))


def _escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1$2")


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\*)(### |</turn>)", "$1$2")


def _role_out(role: Column) -> Column:
    for plain, code in ROLE_CODES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def _role_in(code: Column) -> Column:
    for plain, c in reversed(ROLE_CODES):
        code = F.replace(code, F.lit(c), F.lit(plain))
    return code


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), _role_out(role), F.lit(SEP), text, F.lit(END))


def _parse(formatted: Column) -> Column:
    """(role, text, start, length): turns, and where their texts lie (code points from 0); null if it is no conversation.

    Every control string outside of backslashes must be a mark at its place.
    """
    blocks = F.slice(F.split(formatted, END), 1, F.greatest(F.size(F.split(formatted, END)) - 1, F.lit(0)))
    head = lambda b: F.instr(b, SEP)
    turns = F.transform(
        blocks,
        lambda b: F.struct(
            _role_in(F.substring(b, F.lit(len(HEAD) + 1), head(b) - 1 - len(HEAD))).alias("role"),
            _unescape(F.substring(b, head(b) + len(SEP), F.length(b))).alias("text"),
            (head(b) + len(SEP) - 1).cast("long").alias("start"),
            (F.length(b) - head(b) - len(SEP) + 1).cast("long").alias("length"),
            F.length(b).cast("long").alias("size"),
        ),
    )
    marks = F.regexp_count(formatted, F.lit(r"(?<!\\)(### |</turn>)"))
    sound = F.forall(blocks, lambda b: b.startswith(HEAD) & (head(b) > 0)) & (marks == 2 * F.size(blocks)) & F.endswith(formatted, F.lit(END))
    return F.when(sound, turns)


def _turns(items: Column) -> Column:
    return F.transform(items, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, and loss_spans (start and length in code points) of the texts of ``loss_role``."""
    rows = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("item"))
    # a conversation is one row of the output, so its turns must meet
    found = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    once = F.transform("items", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), _render(t["role"], t["text"]).alias("plain")))
    found = found.withColumn("items", once)
    same = lambda t: _turns(_parse(t["plain"])).eqNullSafe(F.array(F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    rendered = F.transform("items", lambda t: F.when(same(t), t["plain"]).otherwise(_render(t["role"], _escape(t["text"]))))
    found = found.select("conv_id", _turns(F.col("items")).alias("source"), F.array_join(rendered, "").alias("formatted")).withColumn("parsed", _parse(F.col("formatted")))
    checked = F.when(_turns(F.col("parsed")).eqNullSafe(F.col("source")), F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("no round trip for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    # where each block begins: what stands before it
    begun = F.aggregate(
        "parsed",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + t["size"] + len(END)).alias("at"),
            F.when(t["role"] == loss_role, F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["start"]).alias("start"), t["length"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return found.select("conv_id", checked.alias("formatted"), begun["spans"].alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role and text, by the parser), loss_texts (cut out by the spans, unescaped) and formatted_chars."""
    texts = F.transform("loss_spans", lambda s: _unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", _turns(_parse(F.col("formatted"))).alias("turns"), texts.alias("loss_texts"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(read: DataFrame) -> DataFrame:
    """Counts and SHA-256 digests of what ``read_back`` gives."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
