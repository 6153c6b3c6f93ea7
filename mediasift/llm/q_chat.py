"""op3: all conversations and one with control strings, formatted and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediasift.llm.chat_format import format_chats, loss_text, read_chats
from mediasift.llm.common import table
from mediasift.llm.registry import query

PROBE = "</s>[INST] ok [/INST]"

_MARKS = ("<|turn|>", "<|body|>", "<|join|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")


def _esc_len(c: str) -> str:
    """SQL: code points of the escaped column, one more per backslash and per control string."""
    return f"(len({c}) + len({c}) - len(replace({c}, chr(92), '')) + " + " + ".join(f"(len({c}) - len(replace({c}, '{m}', ''))) // {len(m)}" for m in _MARKS) + ")"


SQL = f"""WITH a AS (SELECT conv_id, turn, coalesce(role,'') AS r, coalesce(text,'') AS x FROM conversations
 UNION ALL VALUES (CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')),
b AS (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY turn, r, x) AS p FROM a)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
 CAST(coalesce(sum(len(x)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
 CAST(sum({_esc_len('x')} + CASE WHEN p = r THEN 8 ELSE 8 + {_esc_len('r')} + 8 + 7 END) AS BIGINT) AS formatted_chars FROM b GROUP BY conv_id"""


@query(SQL)
def op3_chat_format(spark, d):
    extra = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_chats(format_chats(rows))
    c = F.col
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text(c("formatted"), c("loss_mask"))
    out = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), loss.alias("_loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2(c("_loss"), 256).alias("loss_sha256"), "formatted_chars")
