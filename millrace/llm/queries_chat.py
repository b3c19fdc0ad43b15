"""Query of the chat formatter: digests of all conversations, read back from the formatted text."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import chat_template
from .common import table

DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_arrow = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
#: A conversation whose texts look like control strings.
TRICKY = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def digest(conv_id: int, parts) -> dict:
    turns, loss = hashlib.sha256(), hashlib.sha256()
    n_turns = loss_chars = formatted_chars = 0
    for text, spans in parts:
        formatted_chars += len(text)
        for role, said in chat_template.read_turns(text):
            n_turns += 1
            turns.update(f"{role}\n{said}\n".encode())
        for span in spans:
            learned = chat_template.unescape(text[span["start"] : span["end"]])
            loss_chars += len(learned)
            loss.update(learned.encode())
    return {"conv_id": conv_id, "n_turns": n_turns, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": formatted_chars}


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame(TRICKY, "conv_id long, turn long, role string, text string")
    return chat_template.read_back(chat_template.format_conversations(rows.unionByName(tricky)), digest, DIGESTS, _arrow)


QUERIES = {"op1_chat_format": op1_chat_format}
#: The same digests from the rows themselves; formatted_chars follows from the template's marks and escapes.
CHAT_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
x as (
  select *, length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|OUT\]|<SYS>>|</SYS>>|<ROLE>>|</ROLE>>)', '\1\2\\\3', 'g'))
    + case role when 'user' then 18 when 'assistant' then 10 when 'system' then 15 else 21 + length(role) end as n
  from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256, cast(sum(n) as bigint) as formatted_chars
from x group by 1
"""
ORACLES = {"op1_chat_format": CHAT_SQL}
