"""Chat formatting of typed content parts, in DataFrame operations only.

A message's ``parts`` are visited in order: text is escaped and kept; an image, audio or document part becomes a
placeholder, and its reference and expanded token count are appended to the list of attachments, so the n-th
placeholder belongs to the n-th attachment.  Turns are marked by control strings.  Those strings (and the escape
sign itself) are replaced inside texts by two-sign codes that no control string can contain, so a text can neither
open nor close a turn, and unescaping restores it exactly.

Output is one row per *segment*: the turns of a conversation whose number falls into one range of
``SEGMENT_TURNS``.  A conversation is its segments in order, nothing between, so a very long conversation is
spread over tasks.  ``loss_spans`` holds (start, length) in code points of the segment, each the content of one
assistant turn.

Turns are ordered by number, then role and text (nulls first); repeated rows are repeated turns.  A null number
comes first, in a segment of its own.  Null text is empty, a null role is the empty role, null parts are none.  A
part of unknown kind is an attachment without tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT_TURNS = 64
ESCAPE = "\\"
#: role: what opens and what closes its turns.
TURNS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
ROLE_OPEN, ROLE_CLOSE, TURN_CLOSE = "[ROLE]", "[/ROLE]", "[/TURN]"
PLACEHOLDERS = {"image": "[IMAGE]", "audio": "[AUDIO]", "document": "[DOCUMENT]"}
OTHER = "[OTHER]"
#: No control string has "[" or "<" after its first sign; two in a row, or one and a text, never form a third.
CONTROLS = [*(x for pair in TURNS.values() for x in pair), ROLE_OPEN, ROLE_CLOSE, TURN_CLOSE, *PLACEHOLDERS.values(), OTHER]
CODES = {control: ESCAPE + chr(ord("A") + i) for i, control in enumerate(CONTROLS)}

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens of a square image patch side in pixels, of a second of audio, of a page.
PATCH, SECOND_TOKENS, PAGE_TOKENS = 28, 25, 1024


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column) -> Column:
    c = _replace(c, ESCAPE, ESCAPE + "0")
    for control, code in CODES.items():
        c = _replace(c, control, code)
    return c


def unescape(c: Column) -> Column:
    for control, code in CODES.items():
        c = _replace(c, code, control)
    return _replace(c, ESCAPE + "0", ESCAPE)


def text_parts(text: Column) -> Column:
    """The parts of a message that is one text."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"))).cast("array<struct<kind:string,text:string>>")


def _field(part: Column, name: str, fields: list[str]) -> Column:
    return part[name] if name in fields else F.lit(None)


def _visit(part: Column, fields: list[str]) -> Column:
    """What a part leaves in the content."""
    mark = F.lit(OTHER)
    for kind, placeholder in PLACEHOLDERS.items():
        mark = F.when(part["kind"] == kind, F.lit(placeholder)).otherwise(mark)
    return F.when(part["kind"] == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(mark)


def _tokens(part: Column, fields: list[str]) -> Column:
    """The tokens that a part's placeholder expands to."""
    side = lambda n: F.ceil(F.coalesce(_field(part, n, fields), F.lit(0)).cast("double") / PATCH)
    return (
        F.when(part["kind"] == "image", side("width") * side("height"))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(_field(part, "seconds", fields), F.lit(0.0)).cast("double") * SECOND_TOKENS))
        .when(part["kind"] == "document", F.coalesce(_field(part, "pages", fields), F.lit(0)).cast("long") * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def format_chats(messages: DataFrame) -> DataFrame:
    """From ``conv_id, turn, role, parts``: ``conv_id, segment, n_turns, formatted, loss_spans, attachments``.

    ``parts`` is an array of structs with ``kind`` and ``text`` and any of the other fields of ``PART``.
    """
    fields = messages.schema["parts"].dataType.elementType.names
    role = F.coalesce(F.col("role"), F.lit(""))
    parts = F.coalesce(F.col("parts"), F.array().cast(messages.schema["parts"].dataType))
    opened, closed = F.concat(F.lit(ROLE_OPEN), escape(role), F.lit(ROLE_CLOSE)), F.lit(TURN_CLOSE)
    for name, (a, b) in TURNS.items():
        opened = F.when(role == name, F.lit(a)).otherwise(opened)
        closed = F.when(role == name, F.lit(b)).otherwise(closed)
    content = F.array_join(F.transform(parts, lambda p: _visit(p, fields)), "")
    held = F.transform(
        F.filter(parts, lambda p: ~p["kind"].eqNullSafe(F.lit("text"))),
        lambda p: F.struct(
            p["kind"].alias("kind"), _field(p, "ref", fields).cast("string").alias("ref"), _tokens(p, fields).alias("tokens")
        ),
    )
    each = messages.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / SEGMENT_TURNS), F.lit(-(1 << 62))).cast("long").alias("segment"),
        F.col("turn").alias("turn"),
        role.alias("role"),
        content.alias("content"),
        opened.alias("opened"),
        closed.alias("closed"),
        held.alias("held"),
    )
    grouped = each.groupBy("conv_id", "segment").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "content", "opened", "closed", "held"))).alias("t")
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["opened"])
        size = F.length(t["content"]).cast("long")
        span = F.array(F.struct(begin.alias("start"), size.alias("length")))
        return F.struct(
            (begin + size + F.length(t["closed"])).alias("at"),
            F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return grouped.select(
        "conv_id",
        "segment",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda t: F.concat(t["opened"], t["content"], t["closed"])), "").alias("formatted"),
        F.aggregate("t", start, step, lambda acc: acc["spans"]).alias("loss_spans"),
        F.flatten(F.transform("t", lambda t: t["held"])).alias("attachments"),
    )


def turns_of(formatted: Column) -> Column:
    """Read a formatted text back: an array of ``(role, text)``; placeholders stay as they are."""
    ends = "|".join([r"\[/SYS\]", r"\[/INST\]", "</s>", r"\[/TURN\]"])
    whole = F.filter(F.split(formatted, f"(?<={ends})", -1), lambda p: p != "")

    def parse(p: Column) -> Column:
        at = F.locate(ROLE_CLOSE, p)
        role = unescape(F.substring(p, F.lit(len(ROLE_OPEN) + 1), at - len(ROLE_OPEN) - 1))
        skip, tail = at + len(ROLE_CLOSE) - 1, F.lit(len(TURN_CLOSE))
        for name, (a, b) in TURNS.items():
            is_it = F.startswith(p, F.lit(a))
            role = F.when(is_it, F.lit(name)).otherwise(role)
            skip = F.when(is_it, F.lit(len(a))).otherwise(skip)
            tail = F.when(is_it, F.lit(len(b))).otherwise(tail)
        return F.struct(role.alias("role"), unescape(F.substring(p, skip + 1, F.length(p) - skip - tail)).alias("text"))

    return F.transform(whole, parse)


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation, from its formatted segments alone: turns, loss text and their digests.

    The digests are of the whole conversation's text, which therefore meets in one row.
    """
    loss = F.array_join(
        F.transform("loss_spans", lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )
    read = segments.select(
        "conv_id", "segment", turns_of(F.col("formatted")).alias("turns"), loss.alias("loss"), F.length("formatted").alias("chars")
    ).select(
        "conv_id",
        "segment",
        F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        "loss",
        "chars",
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("segment", "said", "loss"))).alias("s"),
        F.sum(F.length("loss")).cast("long").alias("loss_chars"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join("s.said", ""), 256).alias("turns_sha256"),
        "loss_chars",
        F.sha2(F.array_join("s.loss", ""), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _sql_escaped(c: str) -> str:
    for old, new in {ESCAPE: ESCAPE + "0", **CODES}.items():
        c = f"replace({c}, '{old}', '{new}')"
    return c


def sql() -> str:
    """DuckDB SQL for the digests of texts-only conversations."""
    role, text = "coalesce(role, '')", "coalesce(text, '')"
    marks = " ".join(f"WHEN {role} = '{r}' THEN {len(a + b)}" for r, (a, b) in TURNS.items())
    other = f"{len(ROLE_OPEN + ROLE_CLOSE + TURN_CLOSE)} + length({_sql_escaped(role)})"
    order = f"ORDER BY turn NULLS FIRST, {role}, {text}"
    said = f"{role} || chr(10) || {text} || chr(10)"
    loss = f"CASE WHEN role = 'assistant' THEN {text} ELSE '' END"
    return f"""
        WITH c AS (
            SELECT conv_id, turn, role, text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        )
        SELECT conv_id,
               count(*) AS n_turns,
               sha256(string_agg({said}, '' {order})) AS turns_sha256,
               CAST(sum(length({loss})) AS BIGINT) AS loss_chars,
               sha256(string_agg({loss}, '' {order})) AS loss_sha256,
               CAST(sum(CASE {marks} ELSE {other} END + length({_sql_escaped(text)})) AS BIGINT) AS formatted_chars
        FROM c GROUP BY conv_id
    """
