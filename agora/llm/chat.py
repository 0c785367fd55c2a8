"""Chat formatting: a finite-state machine over roles checks the turn order, and a declarative template gives text
segments with a loss flag each. DataFrame functions only.

A turn becomes open + role + sep + text + close. Inside role and text every character that can begin a control string
is escaped (``~`` and a digit, ``~`` itself first), so a text can neither forge a mark nor close its turn, and reading
back is exact. Loss lies on the texts of the template's loss roles, never on marks or roles.

Defined results: rows of a conversation are ordered by turn (null first), then role and text; null text and role are
empty; an unknown role makes the order invalid but is formatted; rows that repeat are turns of their own; a null
conv_id is a conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATE = {
    "open": "<|turn|>", "sep": "<|text|>", "close": "<|end|>",
    "loss": ("assistant",),
    # control strings of this and of other templates; none of them may stand in a formatted text
    "controls": ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>"),
    "start": "start", "accept": ("assistant",),
    "next": {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
}


def _codes(template: dict) -> list[tuple[str, str]]:
    """(character, its escape), the escape character first."""
    first = sorted({c[0] for c in (*template["controls"], template["open"], template["sep"], template["close"])} - {"~"})
    return [("~", "~0"), *((c, f"~{i}") for i, c in enumerate(first, 1))]


def escape(text: Column, template: dict = TEMPLATE) -> Column:
    for c, code in _codes(template):
        text = F.replace(text, F.lit(c), F.lit(code))
    return text


def unescape(text: Column, template: dict = TEMPLATE) -> Column:
    for c, code in reversed(_codes(template)):
        text = F.replace(text, F.lit(code), F.lit(c))
    return text


def valid_order(roles: Column, template: dict = TEMPLATE) -> Column:
    """Runs the machine: the last state must accept; a step that the table lacks ends in the state "invalid"."""
    table = F.create_map(*(F.lit(x) for a, to in template["next"].items() for b in to for x in (f"{a}>{b}", b)))
    step = lambda s, r: F.coalesce(F.try_element_at(table, F.concat(s, F.lit(">"), r)), F.lit("invalid"))
    return F.aggregate(roles, F.lit(template["start"]), step).isin(*template["accept"])


def format_chats(turns: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """conv_id, valid, segments (array of text and loss, in order) of each conversation."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("t", lambda t: F.array(
        part(F.concat(F.lit(template["open"]), escape(t["role"], template), F.lit(template["sep"])), F.lit(False)),
        part(escape(t["text"], template), t["role"].isin(*template["loss"])),
        part(F.lit(template["close"]), F.lit(False)))))
    return convs.select("conv_id", valid_order(F.col("t.role"), template).alias("valid"), segments.alias("segments"))


def read_back(chats: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """conv_id, valid, formatted, turns (array of role and text) and loss_text, from the formatted text and the flags."""
    quoted = lambda x: r"\Q" + x + r"\E"
    formatted = chats.select("conv_id", "valid", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                             F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "").alias("loss_text"))

    def turn(x: Column) -> Column:
        pair = lambda p: F.struct(unescape(p[0], template).alias("role"), unescape(p[1], template).alias("text"))
        return F.transform(F.array(F.split(x, quoted(template["sep"]))), pair)[0]

    pieces = F.split("formatted", quoted(template["open"]))
    inner = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x: turn(F.substr(x, F.lit(1), F.length(x) - len(template["close"]))))
    return formatted.withColumn("turns", inner)


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    probe = spark.sql("SELECT -7L AS conv_id, CAST(t AS BIGINT) AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = read_back(format_chats(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"), "valid")


OP7_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^~<\[]', '', 'g')) + 23 AS n,
  coalesce(lag(role) OVER w, 'start') || '>' || role AS step, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS back
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars,
  bool_and(step IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')) AND bool_or(back = 1 AND role = 'assistant') AS valid
FROM e GROUP BY conv_id
"""
