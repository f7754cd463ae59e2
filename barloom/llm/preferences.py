"""Preference pairs from chosen and rejected conversations, with built-in functions only.

The longest common prefix of turns is rendered once as the prompt; what follows on either side is a completion, with
the character spans a loss may count: the texts and end marks of assistant turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the rendering.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(CLOSE))), "")


def _spans(turns: Column, trained: str) -> Column:
    """``from-to`` of each trained stretch, comma-separated: one running sum over the turns."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(held, turn):
        first = held["at"] + F.length(_head(turn))
        last = first + F.length(turn["text"]) + len(CLOSE)
        more = F.when(turn["role"] == trained, F.array(F.concat_ws("-", first.cast("string"), last.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct(last.cast("long").alias("at"), F.concat(held["spans"], more).alias("spans"))

    return F.aggregate(turns, start, step, lambda held: F.array_join(held["spans"], ","))


def format_pairs(turns: DataFrame, sides: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """``pair_id, chosen_id, rejected_id, n_common, prompt, chosen, rejected, chosen_spans, rejected_spans`` per pair.

    ``sides`` has ``pair_id, conv, side`` (0 chosen, 1 rejected).  Turns go by number, then role, then text; null roles
    and texts are empty.  Equal conversations are all prompt with empty completions.  Turns without a conversation, and
    pairs of which a side has no turns, give no row; repeated turns are turns of their own.  All turns of a pair become
    one row, which is the example to train on; nothing larger is ever gathered.
    """
    rows = turns.select(F.col(conv).alias("c"), F.col(turn).alias("n"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    named = sides.select("pair_id", F.col(conv).alias("c2"), "side")
    return _paired(rows.join(named, rows["c"] == named["c2"]), trained)


def format_neighbours(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """The same where conversation ``2 k`` is chosen over ``2 k + 1`` (pair ``k``): no table of sides, one shuffle."""
    rows = turns.filter(F.col(conv).isNotNull()).select(
        F.floor(F.col(conv) / 2).alias("pair_id"), F.pmod(F.col(conv), F.lit(2)).alias("side"), F.col(conv).alias("c"), F.col(turn).alias("n"),
        F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"),
    )
    return _paired(rows, trained)


def _paired(rows: DataFrame, trained: str) -> DataFrame:
    told = F.struct("n", "role", "text")

    def side(n):
        return F.sort_array(F.collect_list(F.when(F.col("side") == n, told)))

    pairs = rows.groupBy("pair_id").agg(
        F.max(F.when(F.col("side") == 0, F.col("c"))).alias("chosen_id"), F.max(F.when(F.col("side") == 1, F.col("c"))).alias("rejected_id"), side(0).alias("a"), side(1).alias("b"),
    ).filter("size(a) > 0 AND size(b) > 0")
    shorter = F.least(F.size("a"), F.size("b"))
    same = F.zip_with(F.slice("a", 1, shorter), F.slice("b", 1, shorter), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    differs = F.array_position(same, False)
    pairs = pairs.withColumn("n_common", F.when(differs > 0, differs - 1).otherwise(shorter).cast("int"))
    one, two = F.slice("a", F.col("n_common") + 1, F.size("a")), F.slice("b", F.col("n_common") + 1, F.size("b"))
    return pairs.select(
        "pair_id", "chosen_id", "rejected_id", "n_common", _render(F.slice("a", 1, F.col("n_common"))).alias("prompt"), _render(one).alias("chosen"), _render(two).alias("rejected"),
        _spans(one, trained).alias("chosen_spans"), _spans(two, trained).alias("rejected_spans"),
    )


NEIGHBOURS_SQL = """
WITH t AS (
  SELECT conv_id, conv_id // 2 AS pair_id, conv_id % 2 AS side, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS i,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), a AS (SELECT * FROM t WHERE side = 0), b AS (SELECT * FROM t WHERE side = 1),
n AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(min(coalesce(a.i, b.i)) FILTER (WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text) - 1, count(*)) AS n_common
  FROM a FULL JOIN b ON a.pair_id = b.pair_id AND a.i = b.i GROUP BY 1 HAVING count(a.i) > 0 AND count(b.i) > 0
), r AS (
  SELECT t.*, n_common, '<|' || role || '|>' || chr(10) AS head, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS full_text FROM t JOIN n USING (pair_id)
), s AS (
  SELECT *, sum(CASE WHEN i > n_common THEN length(full_text) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i)::BIGINT AS til FROM r
), g AS (
  SELECT conv_id, pair_id, side, n_common, coalesce(string_agg(full_text, '' ORDER BY i) FILTER (WHERE i <= n_common), '') AS prompt,
    coalesce(string_agg(full_text, '' ORDER BY i) FILTER (WHERE i > n_common), '') AS rest,
    coalesce(string_agg((til - length(full_text) + length(head)) || '-' || til, ',' ORDER BY i) FILTER (WHERE i > n_common AND role = 'assistant'), '') AS spans
  FROM s GROUP BY ALL
)
SELECT a.pair_id, a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.n_common::INTEGER AS n_common, a.prompt, a.rest AS chosen, b.rest AS rejected,
  a.spans AS chosen_spans, b.spans AS rejected_spans
FROM g a JOIN g b ON a.pair_id = b.pair_id AND a.side = 0 AND b.side = 1
"""
