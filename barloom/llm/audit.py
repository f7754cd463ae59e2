"""What every filter removes at every place in every order, from counts per combination of failed conditions.

The filters applied so far are a state, a set of bits; applying one more is an edge of the lattice of states.  A row is
alive in a state if it fails none of its filters, so what an edge removes depends on the combination of conditions that
a row fails and on nothing else: one count per part and combination answers for all orders.  Orders that reach a state
are counted forward from the empty set, orders that leave it backward from the full one; their product is the number of
orders that use an edge.  Removals weighed by it add up to the Shapley sums, and the steps of a single order are read
from the same edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import drop_tables, settle

#: Filters at most: the lattice has 2 to their number of states, for each part.
MAX_FILTERS = 8
#: The names of the text filters, in order of their bits; the last one is the repeated text.
TEXT_FILTERS = "ABCDE"


def lattice(n: int, after: tuple[tuple[int, int], ...] = ()) -> list[tuple[int, int, int]]:
    """Edges ``(state, filter, orders)``: the orders of ``n`` filters that apply the filter next in that state.

    ``after`` has pairs ``(first, later)`` of filters whose order is set; edges that no order uses are left out.
    """
    if not 0 < n <= MAX_FILTERS:
        raise ValueError(f"1 to {MAX_FILTERS} filters")

    def free(state: int) -> list[int]:
        return [i for i in range(n) if not state >> i & 1 and all(state >> a & 1 for a, b in after if b == i)]

    full = (1 << n) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for state in range(full):
        for i in free(state):
            reach[state | 1 << i] += reach[state]
    for state in reversed(range(full)):
        leave[state] = sum(leave[state | 1 << i] for i in free(state))
    edges = [(s, i, reach[s] * leave[s | 1 << i]) for s in range(full) for i in free(s)]
    return [e for e in edges if e[2]]


def orders(edges: list[tuple[int, int, int]], names: str) -> list[tuple[str, int, int, int]]:
    """``(order, step, state, filter)`` of every path through the lattice."""
    paths = [("", 0, [])]
    for step in range(len(names)):
        paths = [
            (o + names[i], s | 1 << i, seen + [(step + 1, s, i)])
            for o, at, seen in paths for s, i, _ in edges if s == at
        ]
    return [(o, *row) for o, _, seen in paths for row in seen]


def audit(states: DataFrame, names: str, after: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Counts at every edge: ``part, state, bit, orders, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    ``states`` has ``part, mask, n, good, toxic``: rows of a part that fail just the filters whose bits are set in
    ``mask`` (several rows for one combination add up; null masks count as none).  Parts may be null, which is a part of
    its own.  An empty table gives no rows.  ``names`` has one letter a filter, ``after`` pairs of letters whose order is
    set.  Work grows with parts times combinations; the rows behind them are never read again.
    """
    edges = lattice(len(names), tuple((names.index(a), names.index(b)) for a, b in after))
    listed = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(i).alias("bit"), F.lit(w).cast("long").alias("orders")) for s, i, w in edges])
    rows = states.select("part", F.coalesce("mask", F.lit(0)).alias("mask"), "n", "good", "toxic", F.explode(listed).alias("e"))
    rows = rows.select("part", "mask", "n", "good", "toxic", "e.*", F.expr("shiftleft(1, e.bit)").alias("own"))
    fails, alive = F.expr("mask & own != 0"), F.expr("mask & state = 0")

    def total(what, *when):
        return F.sum(F.when(F.expr("true") if not when else when[0], F.col(what)).otherwise(0)).cast("long")

    found = rows.groupBy("part", "state", "bit", "orders").agg(
        total("n", F.expr("mask & (state | own) = 0")).alias("kept"), total("n", fails & alive).alias("removed"),
        total("n", fails & ~alive).alias("redundant"), total("n", F.expr("mask = own")).alias("unique_fails"),
        total("good", fails & alive).alias("good_lost"), total("toxic", fails & alive).alias("toxic_lost"),
    )
    # a filter has at most 2 to the number of the others of edges in a part
    return found.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "bit")).cast("long"))


def steps(spark: SparkSession, found: DataFrame, names: str, after: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """The edges of :func:`audit` read along every order: ``part, filter_order, step`` and the counts."""
    edges = lattice(len(names), tuple((names.index(a), names.index(b)) for a, b in after))
    read = spark.createDataFrame(orders(edges, names), "filter_order string, step int, state int, bit int")
    # as many rows as there are orders and filters, whatever the data
    rows = found.join(F.broadcast(read), ["state", "bit"])
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return rows.select("part", "filter_order", "step", *counts)


def text_mask(text) -> F.Column:
    """Bits of the conditions that a text fails: few words, few different words, capitals, marks (not: repeated text).

    Every one is a function of the whole text.  An empty text has too few words and fails nothing else.
    """
    return (
        F.when(F.size("__words") < 200, 1).otherwise(0)
        + F.when(100 * F.size(F.array_distinct("__words")) < 50 * F.size("__words"), 2).otherwise(0)
        + F.when(100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text), 4).otherwise(0)
        + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)
    )


def text_states(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic`` of documents under the five text filters.

    A null text is an empty one, a null source the part of the empty string.  A document repeats a text if a smaller key
    has the same; rows of one key do not outdo each other, and a row without key neither repeats nor is repeated.  A
    document is good (toxic) if any label row of its key has quality 1 (toxic 1), no label counts as neither.  Columns
    other than these are not read, whatever their names.  Texts are read once; from then on rows are a key, a digest and
    small numbers.
    """
    whole = F.coalesce(F.col(text), F.lit("")).alias("__text")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(source), F.lit("")).alias("part"), whole)
    rows = rows.withColumn("__words", F.array_remove(F.split("__text", r"[\x20\x09-\x0D]+"), ""))
    rows = rows.select("key", "part", text_mask(F.col("__text")).alias("mask"), F.unhex(F.sha2("__text", 256)).alias("digest"))
    # a key may hold many rows: they are counted before anything is joined to them
    rows = rows.groupBy("key", "part", "mask", "digest").agg(F.count("*").alias("n"))
    told = labels.select(F.col(key).alias("key"), (F.col("quality") == 1).cast("int").alias("good"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    told = told.groupBy("key").agg(F.coalesce(F.max("good"), F.lit(0)).alias("good"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"))
    rows = settle(rows.join(told, "key", "left").na.fill(0, ["good", "toxic"]), "audited")
    # the first of equal texts is found by digest and key, so a group of copies is one row of this join
    least = rows.groupBy("digest").agg(F.min("key").alias("key")).withColumn("first", F.lit(True))
    rows_ = rows.join(least, ["digest", "key"], "left")
    repeats = F.when(F.col("first") | F.col("key").isNull(), 0).otherwise(16)
    mask = F.col("mask") + repeats
    found = rows_.groupBy("part", mask.alias("mask")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )
    found = settle(found, "states")
    drop_tables(rows)
    return found


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per part, every order of the five text filters and every step: what it keeps, removes and loses."""
    found = audit(text_states(docs, labels, key, text, source), TEXT_FILTERS)
    return steps(docs.sparkSession, found, TEXT_FILTERS)


AUDIT_SQL = r"""
WITH told AS (
  SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic FROM labels GROUP BY doc_id
), whole AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS failed
  FROM whole LEFT JOIN told USING (doc_id)
), sums AS (
  SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, failed
), names AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), permuted AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM names a, names b, names c, names d, names e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), placed AS (
  SELECT filter_order, step, filter_order[step] AS own, '[' || filter_order[1:step - 1] || '.]' AS earlier
  FROM permuted, (SELECT unnest(range(1, 6))::INT AS step)
), counted AS (
  SELECT part, filter_order, step, own,
    sum(n) FILTER (NOT contains(failed, own) AND NOT regexp_matches(failed, earlier)) AS kept,
    sum(n) FILTER (contains(failed, own) AND NOT regexp_matches(failed, earlier)) AS removed,
    sum(n) FILTER (contains(failed, own) AND regexp_matches(failed, earlier)) AS redundant,
    sum(n) FILTER (failed = own) AS unique_fails,
    sum(good) FILTER (contains(failed, own) AND NOT regexp_matches(failed, earlier)) AS good_lost,
    sum(toxic) FILTER (contains(failed, own) AND NOT regexp_matches(failed, earlier)) AS toxic_lost
  FROM sums, placed GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""
