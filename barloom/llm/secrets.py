"""Secret scans over all historical versions, with a ledger of what was scanned by which rule.

A version's content is addressed by its hash.  The ledger has a row for every content and scan: the rules, each with its
version, that looked at it, and what they found.  A scan reads only contents that some current rule has not seen, runs
only those rules over them, adds one row for each to the ledger, and joins the findings of all current rules back to
every path and version that has the content.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from barloom.llm.common import drop_tables, join_copies, settle, shuffles_dropped, table
from barloom.session import work_dir


class Rule(NamedTuple):
    """A kind of secret: matches of the pattern count if the group holds enough characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    version: int = 1

    @property
    def mark(self) -> str:
        return f"{self.kind}@{self.version}"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: The base rules, then public formats of tokens and keys that they miss or find in part only.
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", "AKIA[A-Z0-9]{16,}"),  # a run too short has no part that is long enough
    Rule("hex", "[0-9a-f]{24,}"),
)
RULES = (
    *BASE,
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("login", r"://[^\x00-\x20/:@]{1,200}:[^\x00-\x20/:@]{1,200}@"),
)
LEDGER = "blob binary, marks array<string>, spans array<struct<mark string, start int, end int>>"
#: Matches whose lengths are added up in one run.
_RUN = 128


def _ends(sizes: str) -> str:
    """SQL for the running sums of an array column, a run of a fixed length at a time, so that cost stays near linear."""
    add, run = "(a, x) -> a + x", f"slice({sizes}, r * {_RUN} + 1, {_RUN})"
    inside = f"transform({run}, (s, i) -> t.base + aggregate(slice({sizes}, r * {_RUN} + 1, i + 1), 0, {add}))"
    more = f"named_struct('base', t.base + aggregate({run}, 0, {add}), 'ends', concat(t.ends, {inside}))"
    start = "named_struct('base', 0, 'ends', cast(array() AS array<int>))"
    return f"aggregate(sequence(0, (size({sizes}) - 1) div {_RUN}), {start}, (t, r) -> {more}, t -> t.ends)"


def _judge(rule: Rule):
    def judged(hit, end):
        held = F.length(F.regexp_extract(hit, rule.pattern, rule.group) if rule.group else hit)
        return F.struct(F.lit(rule.mark).alias("mark"), (end - F.length(hit)).alias("start"), end.alias("end"), (held >= rule.least).alias("good"))

    return judged


def find(rows: DataFrame, rules: Sequence[Rule], text: str = "text", asked: str = "asked") -> DataFrame:
    """``rows`` with ``spans``: what the rules whose marks are in ``asked`` find in the text, in place of the text.

    Matches are leftmost, do not overlap within a kind, and are dropped if their group is too short (what they cover
    stays covered).  Places are code points, ends exclusive.  A rule that is not asked does not look at the text.  Where
    a match starts follows from the lengths of what lies between matches; a text without a match is not cut.
    """
    kept = [c for c in rows.columns if c != text]
    for i, r in enumerate(rules):
        hits = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))
        rows = rows.withColumn(f"__hit{i}", F.when(F.array_contains(asked, r.mark), hits))
    for i, r in enumerate(rules):
        rows = rows.withColumn(f"__gap{i}", F.when(F.size(f"__hit{i}") > 0, F.split(text, r.pattern, -1)))
    for i, r in enumerate(rules):
        sizes = F.expr(f"transform(__hit{i}, (h, i) -> length(__gap{i}[i]) + length(h))")
        rows = rows.withColumn(f"__size{i}", F.when(F.size(f"__hit{i}") > 0, sizes))
    lists = []
    for i, r in enumerate(rules):
        ends = F.when(F.size(f"__hit{i}") > 0, F.expr(_ends(f"__size{i}")))
        rows = rows.withColumn(f"__end{i}", ends)

        found = F.filter(F.zip_with(f"__hit{i}", f"__end{i}", _judge(r)), lambda s: s["good"])
        lists.append(F.when(F.size(f"__hit{i}") > 0, F.transform(found, lambda s: F.struct(s["mark"].alias("mark"), s["start"].alias("start"), s["end"].alias("end")))))
    none = F.array().cast("array<struct<mark string, start int, end int>>")
    return rows.select(*kept, F.concat(*[F.coalesce(found, none) for found in lists]).alias("spans"))


class Ledger:
    """Scanned contents below a shared folder; every scan adds files and changes none."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """``blob, marks, spans`` per content and scan; nothing where no scan has been."""
        try:
            return self.spark.read.schema(LEDGER).parquet(self.path)
        except AnalysisException as fault:
            if "PATH_NOT_FOUND" not in str(fault):
                raise
            return self.spark.createDataFrame([], LEDGER)

    def add(self, rows: DataFrame) -> None:
        """Append one scan.  A row holds its marks together with its findings, so a scan that breaks off leaves only
        whole rows, and the next one takes up the rest."""
        with shuffles_dropped(self.spark):
            rows.write.mode("append").parquet(self.path)


def unseen(versions: DataFrame, ledger: Ledger, rules: Sequence[Rule], paths: Sequence[str]) -> DataFrame:
    """Contents and the rules that have not seen them: ``blob, asked`` and the path of one version, the smallest."""
    first = versions.groupBy("blob").agg(F.min(F.struct(*paths)).alias("at"))
    seen = ledger.read().groupBy("blob").agg(F.flatten(F.collect_set("marks")).alias("seen"))
    wanted = F.array(*[F.lit(r.mark) for r in rules])
    asked = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    return first.join(seen, "blob", "left").select("blob", "at", asked.alias("asked")).filter(F.size("asked") > 0)


def scan(history: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES, paths: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``paths``, ``blob`` and ``spans`` (mark, start, end) of every version, after the ledger has been brought up to date.

    One row per row of ``history``, repeated ones included.  Null and empty texts are one content without findings.
    Paths may be null and may repeat with other texts; columns other than the paths and the text are not read, whatever
    their names.  An empty table gives no rows and leaves the ledger as it is.  Contents that many versions share are
    scanned once (rows alike in path and text, each), and their findings are dealt out over several cells.
    Findings of rules that are no longer current stay in the ledger and are not returned.
    """
    named = [f"__path{i}" for i in range(len(paths))]
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = history.select(*[F.col(p).alias(n) for p, n in zip(paths, named)], whole.alias("__text"))
    rows = rows.withColumn("blob", F.unhex(F.sha2("__text", 256)))
    versions = settle(rows.select(*named, "blob"), "versions")
    todo = unseen(versions, ledger, rules, named)
    todo = settle(todo.select("blob", "asked", *[F.col(f"at.{n}").alias(f"__at{i}") for i, n in enumerate(named)]), "unseen")
    # contents lie with their smallest path; only their texts move, and few of them are small enough to be sent instead
    same = rows["blob"] == todo["blob"]
    for i, n in enumerate(named):
        same = same & rows[n].eqNullSafe(todo[f"__at{i}"])
    texts = rows.join(todo, same).select(todo["blob"], "asked", "__text")
    found = find(texts, rules, "__text")
    ledger.add(found.select("blob", F.col("asked").alias("marks"), "spans"))
    marks = [r.mark for r in rules]
    held = ledger.read().filter(F.size("spans") > 0).select("blob", F.explode("spans").alias("s")).filter(F.col("s.mark").isin(marks))
    # a content may have been scanned twice, by rows alike in path and text: its findings count once
    held = settle(held.groupBy("blob").agg(F.sort_array(F.collect_set("s")).alias("spans")), "findings")
    joined = join_copies(versions, held, "blob")
    none = F.array().cast("array<struct<mark string, start int, end int>>")
    drop_tables(todo)
    return joined.select(*[F.col(n).alias(p) for n, p in zip(named, paths)], "blob", F.coalesce("spans", none).alias("spans"))


def listed(spans, rules: Sequence[Rule], kinds: Collection[str] | None = None) -> F.Column:
    """``kind:start:end`` of spans by start, then kind in the order of the rules, joined by commas."""
    used = [r for r in rules if kinds is None or r.kind in kinds]
    place = F.create_map(*[x for i, r in enumerate(used) for x in (F.lit(r.mark), F.lit(i))])
    kind = F.create_map(*[x for r in used for x in (F.lit(r.mark), F.lit(r.kind))])
    taken = F.filter(spans, lambda s: s["mark"].isin([r.mark for r in used]))
    ordered = F.sort_array(F.transform(taken, lambda s: F.struct(s["start"].alias("start"), place[s["mark"]].alias("place"), s["end"].alias("end"), kind[s["mark"]].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, ledger: Ledger, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: findings of each base rule, the digest of their list, and the list of all spans."""
    found = scan(docs, ledger, RULES, (key,), text)
    counts = [F.size(F.expr(f"filter(spans, s -> s.mark = '{r.mark}')")).cast("long").alias(f"n_{r.kind}") for r in BASE]
    base = F.sha2(listed("spans", RULES, [r.kind for r in BASE]), 256)
    return found.select(key, *counts, base.alias("base_sha256"), listed("spans", RULES).alias("spans"))


def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The report of the documents with a ledger of their own."""
    return report(table(spark, folder, "documents"), Ledger(spark, work_dir(spark, "ledger")))


def _kind_sql(place: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    held = f"regexp_extract(hit, '{pattern}', {rule.group})"
    return f"""
  SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, stop - length(hit) AS start, stop FROM (
    SELECT doc_id, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
      SELECT doc_id, unnest(hits) AS hit, unnest(string_split_regex(t, '{pattern}')[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i
      FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS hits FROM texts) WHERE len(hits) > 0
    )
  ) WHERE length({held}) >= {rule.least}"""


SCAN_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({" UNION ALL ".join(_kind_sql(i, r) for i, r in enumerate(RULES))}
), told AS (
  SELECT doc_id, count(*) FILTER (place = 0) AS a, count(*) FILTER (place = 1) AS b, count(*) FILTER (place = 2) AS c,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (place < 3) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(told.spans, '') AS spans
FROM texts LEFT JOIN told USING (doc_id)
"""
