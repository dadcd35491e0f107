"""Preference formatting: the longest common turn prefix as prompt, two masked completions (native: DataFrame functions only).

All turns of one conversation meet in one row, which is the training sample itself; nothing else is gathered. The work on
a pair happens inside its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"


def conversations_of(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turns``: the turns (``role, text``) of each conversation in order.

    Rows without a conversation are left out. A null turn number comes first; rows repeated whole count once, and other
    rows of one turn number are ordered by role, then text. Null roles and texts count as empty.
    """
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                   F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = turns.filter(F.col(conv).isNotNull()).groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_set(row)).alias("all"))
    return grouped.select("conv_id", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many leading turns are the same in both."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first == 0, F.size(same)).otherwise(first - 1)


def opening(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))


def content(t: Column) -> Column:
    """A turn's text; a marker inside it is broken up, so no text can start a turn."""
    return F.replace(t["text"], F.lit("<|"), F.lit("< |"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(opening(t), content(t), F.lit("<|end|>\n"))), "")


def loss_spans(turns: Column) -> Column:
    """Characters of the rendered turns that are trained on: content and end mark of the trained role's turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    mark = len("<|end|>")

    def step(acc, t):
        begin = acc["at"] + F.length(opening(t))
        end = begin + F.length(content(t)) + mark
        spans = F.when(t["role"] == TRAINED_ROLE, F.array_append(acc["spans"], F.struct(begin.alias("start"), end.alias("end")))).otherwise(acc["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """``pair_id, prompt_turns, prompt, chosen, rejected, chosen_loss, rejected_loss, degenerate`` of every pair.

    ``pairs`` has ``pair_id, chosen, rejected`` (arrays of ``role, text``; null counts as empty). The prompt is the longest
    common prefix of turns, rendered once. The completions are the rest of each side; a side that is wholly prompt has an
    empty completion. ``degenerate``: nothing tells the sides apart, so the pair teaches nothing.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    sides = pairs.select("pair_id", F.coalesce("chosen", empty).alias("c"), F.coalesce("rejected", empty).alias("r"))
    cut = sides.withColumn("n", common_turns(F.col("c"), F.col("r")))

    def rest(side):
        return F.slice(side, F.col("n") + 1, F.size(side))

    parts = cut.select(
        "pair_id", "n", F.slice("c", 1, F.col("n")).alias("p"), rest(F.col("c")).alias("c"), rest(F.col("r")).alias("r"))
    return parts.select(
        "pair_id", F.col("n").alias("prompt_turns"), rendered(F.col("p")).alias("prompt"), rendered(F.col("c")).alias("chosen"),
        rendered(F.col("r")).alias("rejected"), loss_spans(F.col("c")).alias("chosen_loss"), loss_spans(F.col("r")).alias("rejected_loss"),
        ((F.size("c") == 0) & (F.size("r") == 0)).alias("degenerate"))


def answer_swaps(conversations: DataFrame) -> DataFrame:
    """A pair for each conversation: itself as chosen; with its last trained turn's text taken from its neighbour as rejected.

    The neighbour has the id that differs in the last bit. Where it has no such turn, or is absent, the rejected side
    lacks the turn. A conversation without a trained turn is rejected as it is (a degenerate pair).
    """
    last = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"] == TRAINED_ROLE)), F.lit(True)).cast("int")
    own = conversations.select("conv_id", "turns", last.alias("last"))  # 0-based place; the size where there is none
    answer = F.when(F.col("last") < F.size("turns"), F.get("turns", F.col("last"))["text"])
    other = own.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("other"), answer.alias("swap"))
    joined = own.join(other, F.col("conv_id") == F.col("other"), "left")
    role = F.lit(TRAINED_ROLE)
    swapped = F.when(F.col("swap").isNotNull(), F.array(F.struct(role.alias("role"), F.col("swap").alias("text"))))
    swapped = F.coalesce(swapped, F.array().cast("array<struct<role:string,text:string>>"))
    rejected = F.when(F.col("last") == F.size("turns"), F.col("turns")).otherwise(F.concat(
        F.slice("turns", 1, F.col("last")), swapped, F.slice("turns", F.col("last") + 2, F.size("turns"))))
    return joined.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), rejected.alias("rejected"))


def digest(formatted: DataFrame) -> DataFrame:
    """The query's columns: spans as text beside the formatted sides."""
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")

    return formatted.withColumn("chosen_loss", listed("chosen_loss")).withColumn("rejected_loss", listed("rejected_loss"))


SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
last AS (SELECT conv_id, max(i) FILTER (role = 'assistant') AS k, max(i) AS size FROM n GROUP BY conv_id),
answer AS (SELECT xor(conv_id, 1) AS conv_id, text AS swap FROM n JOIN last USING (conv_id) WHERE i = k),
prefix AS (
  SELECT l.conv_id, l.k, l.size, a.swap,
         CASE WHEN l.k IS NULL OR a.swap = n.text THEN l.size
              WHEN a.swap IS NULL AND l.k < l.size AND x.role = 'assistant' AND x.text = n.text THEN l.k
              ELSE l.k - 1 END AS p
  FROM last l LEFT JOIN answer a USING (conv_id) LEFT JOIN n ON n.conv_id = l.conv_id AND n.i = l.k
  LEFT JOIN n x ON x.conv_id = l.conv_id AND x.i = l.k + 1),
sides AS (
  SELECT p.conv_id, p.p, side, n.role, n.i,
         CASE WHEN side = 'r' AND n.i = p.k THEN p.swap ELSE n.text END AS text, n.i > p.p AS rest
  FROM prefix p JOIN n USING (conv_id), (VALUES ('c'), ('r')) AS s(side)
  WHERE NOT (side = 'r' AND n.i = p.k AND p.swap IS NULL)),
shown AS (
  SELECT *, '<|' || role || '|>' || chr(10) AS head, replace(text, '<|', '< |') || '<|end|>' AS body FROM sides),
placed AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, side, rest ORDER BY i) AS e FROM shown),
agg AS (
  SELECT conv_id, side, rest, string_agg(head || body || chr(10), '' ORDER BY i) AS txt,
         string_agg((e - 1 - length(body))::BIGINT || '-' || (e - 1)::BIGINT, ',' ORDER BY i) FILTER (role = 'assistant') AS loss
  FROM placed GROUP BY ALL)
SELECT p.conv_id AS pair_id, p.p::INT AS prompt_turns, coalesce(a.txt, '') AS prompt, coalesce(c.txt, '') AS chosen,
       coalesce(r.txt, '') AS rejected, coalesce(c.loss, '') AS chosen_loss, coalesce(r.loss, '') AS rejected_loss,
       c.txt IS NULL AND r.txt IS NULL AS degenerate
FROM prefix p LEFT JOIN agg a ON a.conv_id = p.conv_id AND a.side = 'c' AND NOT a.rest
LEFT JOIN agg c ON c.conv_id = p.conv_id AND c.side = 'c' AND c.rest
LEFT JOIN agg r ON r.conv_id = p.conv_id AND r.side = 'r' AND r.rest
"""
