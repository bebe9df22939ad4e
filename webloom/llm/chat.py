"""Chat formatting with Spark expressions only (operator 13).

The turns of a conversation are collected as structs and sorted; neighbours of one role become
a block; blocks become segments (marks and texts), whose concatenation is the formatted
conversation.  Segments say whether they are trained on, which is the loss mask.  All array
work is linear in the number of turns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of blocks by role; ``other`` holds roles without marks of their own, with the role's name between the first two."""

    roles: tuple[tuple[str, str, str], ...] = (("system", "<<SYS>>\n", "\n<</SYS>>\n\n"), ("user", "<s>[INST] ", " [/INST]"), ("assistant", "<<ANSWER>> ", " </s>"))
    other: tuple[str, str, str] = ("<<ROLE>>", "<<TEXT>>", "<</ROLE>>")
    #: Between turns of one role in a block.
    join: str = "<<TURN>>"
    trained: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        """Every control string (a word in angle or square brackets); inside texts none is left unescaped."""
        found = [re.findall(r"<{1,2}[^<>\\\s]+>{1,2}|\[[^\[\]\\\s]+\]", m) for m in [*(m for _, *pair in self.roles for m in pair), *self.other, self.join]]
        if not all(found):
            raise ValueError("every mark needs a control string")
        return sorted({c for cs in found for c in cs}, key=len, reverse=True)

    def escaped(self, text: Column) -> Column:
        """Backslashes doubled, and one put after the first character of each control string."""
        heads = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in self.controls())
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), heads, r"\\")

    @staticmethod
    def unescaped(text: Column) -> Column:
        return F.regexp_replace(text, r"\\([\s\S])", "$1")

    def open(self, role: Column) -> Column:
        out = F.concat(F.lit(self.other[0]), self.escaped(role), F.lit(self.other[1]))
        for name, mark, _ in self.roles:
            out = F.when(role == name, F.lit(mark)).otherwise(out)
        return out

    def close(self, role: Column) -> Column:
        out = F.lit(self.other[2])
        for name, _, mark in self.roles:
            out = F.when(role == name, F.lit(mark)).otherwise(out)
        return out


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008  frozen
    """One row per conversation: conv_id, formatted, segments (array of text, trained).

    ``turns``: conv_id, turn, role, text; more columns are ignored.  Turns go by number (nulls
    first), then role, then text; neighbours of one role are one block.  ``formatted`` is the
    concatenation of the segments' texts; the loss mask is the segments whose ``trained`` is true.

    Null roles and texts are empty and keep their turns; rows without conv_id are one
    conversation of its own; repeated rows each are a turn; an empty table gives an empty result.  A conversation is one
    value of the result and so is held by one task, as long as it may be.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("plain"), template.escaped(text).alias("text")).alias("t"))
    sorted_ = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    at = lambda i: F.element_at("turns", i + 1)["role"]
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (at(F.greatest(i - 1, F.lit(0))) != at(i)))
    found = sorted_.withColumn("starts", starts)
    end = lambda k: F.coalesce(F.get("starts", k + 1), F.size("turns"))
    blocks = F.transform("starts", lambda s, k: F.slice("turns", s + 1, end(k) - s))
    part = lambda x, trained=F.lit(False): F.struct(x.alias("text"), trained.alias("trained"))

    def segments(block: Column) -> Column:
        role = F.element_at(block, 1)["role"]
        trained = role.isin(*template.trained)
        body = F.transform(block, lambda t, j: F.when(j == 0, F.array(part(t["text"], trained))).otherwise(F.array(part(F.lit(template.join)), part(t["text"], trained))))
        return F.concat(F.array(part(template.open(role))), F.flatten(body), F.array(part(template.close(role))))

    out = found.select("conv_id", F.flatten(F.transform(blocks, segments)).alias("segments"))
    return out.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def parse_chats(formatted: Column, template: Template = Template()) -> Column:  # noqa: B008  frozen
    """The turns (array of role, text) that a formatted conversation was made of."""
    ends = "|".join(re.escape(m) for m in [*(c for *_, c in template.roles), template.other[2]])
    blocks = F.filter(F.split(formatted, ends), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = template.unescaped(F.substring_index(F.substr(block, F.lit(len(template.other[0]) + 1)), template.other[1], 1))
        begin = F.locate(template.other[1], block) + len(template.other[1])
        for name, mark, _ in template.roles:
            mine = F.startswith(block, F.lit(mark))
            role, begin = F.when(mine, F.lit(name)).otherwise(role), F.when(mine, F.lit(len(mark) + 1)).otherwise(begin)
        texts = F.split(F.substr(block, begin), re.escape(template.join))
        return F.transform(texts, lambda t: F.struct(role.alias("role"), template.unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def trained_text(segments: Column, template: Template = Template()) -> Column:  # noqa: B008  frozen
    """All text under the loss mask, unescaped, in order and with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["trained"]), lambda s: template.unescaped(s["text"])), "")


OP13_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, lag(role) OVER o IS DISTINCT FROM role AS fresh,
    length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '</?s>|\[/?INST\]|<</?(?:SYS|ROLE)>>|<<(?:ANSWER|TEXT|TURN)>>')) AS n
    FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(n + CASE WHEN NOT fresh THEN 8 WHEN role = 'system' THEN 19 WHEN role = 'user' THEN 18 WHEN role = 'assistant' THEN 16 ELSE 25 + length(role) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op13_chat_formatting(spark, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = format_chats(turns).select("conv_id", F.length("formatted").alias("chars"), parse_chats(F.col("formatted")).alias("turns"), trained_text(F.col("segments")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest(lines).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        digest(F.col("loss")).alias("loss_sha256"), F.col("chars").cast("long").alias("formatted_chars"),
    )
