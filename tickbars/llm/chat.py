"""Chat texts that can be read back, by a grammar round trip. DataFrame functions only.

The template, one deterministic grammar (a turn is known by how it begins and ends):

    conversation := turn*
    turn := "[INST] " body " [/INST]"              a user's
          | body "</s>"                            an assistant's
          | "[TURN]" role "[/TURN]" body "</s>"    anyone else's

1. Every conversation is rendered with its texts as they are.
2. The rendered text is parsed: cut behind each `[/INST]` and `</s>`, a turn for each piece. A body with a control
   string in it is no body; backslashes within one, as in `[\\INST]`, are escapes and come off.
3. The turns so recovered are compared with the source. Where they differ, conflicting content is escaped (control
   strings, with any backslashes in them, get one more), and the conversation is rendered, parsed and compared again.
   Escaping leaves text without such strings as it is, so only the conflicting turns change. If that were not identical
   either, the query would stop.

A control string begins with `[` or `<` and holds neither further on, so none can arise where a text meets a mark.

A conversation has to be one text, so its turns come together in one row, and it can't be larger than a row can (2 GB).
That takes one shuffle by conversation; no other rows meet.

Defined cases: null text or role is empty; null turns come first; turns of one number are in the order of role and text.
A null conversation number is a conversation as any other. Repeated rows are repeated turns. Other columns are not
read. No rows give no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template, and what they begin with.
CONTROL = ("[INST]", "[/INST]", "[TURN]", "[/TURN]", "<s>", "</s>")
_NAMES = r"/?INST\]|/?TURN\]|/?s>"
# A control string with any number of backslashes behind its first character; one without; one with.
_FAMILY = rf"([<\[])(\\*)({_NAMES})"
_BARE = rf"[<\[](?:{_NAMES})"
_ESCAPED = rf"([<\[])\\(\\*)({_NAMES})"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _FAMILY, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _rendered(role: Column, body: Column, role_body: Column) -> Column:
    return (
        F.when(role == "user", F.concat(F.lit("[INST] "), body, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(body, F.lit("</s>")))
        .otherwise(F.concat(F.lit("[TURN]"), role_body, F.lit("[/TURN]"), body, F.lit("</s>")))
    )


def rendered(turns: Column, escape: bool) -> Column:
    """The text of an array of turns, each a struct of role and text."""
    safe = escaped if escape else (lambda c: c)
    return F.array_join(F.transform(turns, lambda t: _rendered(t["role"], safe(t["text"]), safe(t["role"]))), "")


def _body(text: Column) -> Column:
    """What a body says; null if it is none."""
    return F.when(~text.rlike(_BARE), unescaped(text))


def _inside(piece: Column, before: int, after: int) -> Column:
    return F.substring(piece, F.lit(before + 1), F.length(piece) - before - after)


def parsed(text: Column) -> Column:
    """The turns that a rendered text consists of, as structs of role, text and body (the text as it is written).

    A text that is none of a conversation gives turns with null in them.
    """
    pieces = F.filter(F.split(text, r"(?<=\[/INST\]|</s>)"), lambda p: p != "")

    def turn(p: Column) -> Column:
        ends = p.endswith(F.lit("</s>"))
        user = p.startswith(F.lit("[INST] ")) & p.endswith(F.lit(" [/INST]")) & (F.length(p) >= 15)
        # The mark ends where the first [/TURN] does: a role holds none.
        rest = _inside(p, 6, 4)
        role = F.substring_index(rest, "[/TURN]", 1)
        body = (
            F.when(user, _inside(p, 7, 8))
            .when(p.startswith(F.lit("[TURN]")) & ends & rest.contains("[/TURN]"), F.substring(rest, F.length(role) + 8, F.length(rest)))
            .when(ends, _inside(p, 0, 4))
        )
        name = F.when(user, "user").when(p.startswith(F.lit("[TURN]")), _body(role)).otherwise("assistant")
        return F.struct(name.alias("role"), _body(body).alias("text"), body.alias("body"))

    return F.transform(pieces, turn)


def _same(found: Column, source: Column) -> Column:
    """Whether parsing gave the turns that were rendered."""
    plain = F.transform(found, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return F.coalesce(plain == source, F.lit(False))


def _turns(rows: DataFrame, id_col: str) -> DataFrame:
    """Conversations with `source`, their turns in order (among structs a null field is the least)."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    element = F.struct(F.col("turn"), text("role").alias("role"), text("text").alias("text"))
    together = rows.select(F.col(id_col), element.alias("t")).groupBy(id_col).agg(F.array_sort(F.collect_list("t")).alias("turns"))
    only = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    return together.select(id_col, F.transform("turns", only).alias("source"))


def formatted(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation: the id, `formatted`, the text to train on, `turns`, the turns read back from it
    (role, text, and body as it is written), and `mask`: lengths in code points, in order, of what a model learns from
    (bodies of assistants) and what not."""
    source = _turns(rows, id_col)
    first = source.withColumn("plain", rendered(F.col("source"), escape=False))
    first = first.withColumn("found", parsed(F.col("plain")))
    first = first.withColumn("same", _same(F.col("found"), F.col("source")))
    text = F.when(F.col("same"), F.col("plain")).otherwise(rendered(F.col("source"), escape=True))
    second = first.select(id_col, "source", "same", "found", text.alias("formatted"))
    again = F.when(F.col("same"), F.col("found")).otherwise(parsed(F.col("formatted")))
    second = second.select(id_col, "source", "formatted", again.alias("turns"))
    checked = F.when(_same(F.col("turns"), F.col("source")), F.col("turns")).otherwise(
        F.raise_error(F.lit("a conversation can't be read back from its text"))
    )
    return second.select(id_col, "formatted", checked.alias("turns")).select(id_col, "formatted", "turns", _mask(F.col("turns")).alias("mask"))


def _mask(turns: Column) -> Column:
    """Stretches of the text as structs of chars and loss."""
    stretch = lambda chars, loss: F.struct(chars.alias("chars"), F.lit(loss).alias("loss"))
    length = lambda t: F.length(t["body"])
    marks = lambda t: F.when(t["role"] == "user", 15).otherwise(17 + F.length(escaped(t["role"])))
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.when(t["role"] == "assistant", F.array(stretch(length(t), True), stretch(F.lit(4), False))).otherwise(
                F.array(stretch(length(t) + marks(t), False))
            ),
        )
    )


# The conversation that the contract adds.
_HARD = "</s>[INST] ok [/INST]"


def with_hard_conversation(rows: DataFrame) -> DataFrame:
    """The rows, and conversation -1: a user and an assistant who both say control strings."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    extra = rows.sparkSession.range(2).select(
        F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"),
        F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_HARD).alias("text"),
    )
    return rows.select("conv_id", "turn", "role", "text").unionByName(extra)


def chat_report(rows: DataFrame) -> DataFrame:
    """Counts and digests of what is read back from every formatted conversation."""
    made = formatted(with_hard_conversation(rows))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learnt = F.filter("turns", lambda t: t["role"] == "assistant")
    loss = F.array_join(F.transform(learnt, lambda t: t["text"]), "")
    return made.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def oracle_sql() -> str:
    """The report in DuckDB's SQL."""
    escape = rf"regexp_replace({{0}}, '([<\[])(\\*)({_NAMES})', '\1\\\2\3', 'g')"
    return f"""
    with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
               union all select -1, 0, 'user', '{_HARD}' union all select -1, 1, 'assistant', '{_HARD}'),
    t as (select *, {escape.format("text")} as body, {escape.format("role")} as name from r),
    f as (select *, case role when 'user' then '[INST] ' || body || ' [/INST]' when 'assistant' then body || '</s>'
                    else '[TURN]' || name || '[/TURN]' || body || '</s>' end as part from t),
    c as (select conv_id, count(*) as n_turns,
                 string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as lines,
                 coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '') as loss,
                 string_agg(part, '' order by turn nulls first, role, text) as formatted
          from f group by conv_id)
    select conv_id, n_turns, sha256(lines) as turns_sha256, cast(length(loss) as bigint) as loss_chars,
           sha256(loss) as loss_sha256, cast(length(formatted) as bigint) as formatted_chars from c"""
