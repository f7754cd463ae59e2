"""Toxicity by a weighted lexicon: folded texts, Aho-Corasick matching, exception phrases, scores normalised by length.

Lexicon, exceptions and the two-number calibration are learned from a bounded sample of labelled rows; every text is
then scored whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import settle, spread

#: Bound of the fit: labelled rows of each class.  Terms and phrases are all those of these rows that pass the tests below.
SAMPLE_ROWS = 20_000
#: A term needs this many toxic rows and this share of them, this log odds and this log-likelihood ratio; a phrase this
#: many clean rows to be an exception.
MIN_ROWS, MIN_SHARE, MIN_ODDS, MIN_RATIO, MIN_CLEAN = 5, 0.01, 1.5, 15.0, 5
#: Lengths of the word beginnings tried as terms, besides whole words.
STEMS = (4, 5, 6, 7, 8)
#: Letters of other scripts and signs that pass for Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ß": "ss", "ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
}
_TABLE = str.maketrans(HOMOGLYPHS)
_WORD = re.compile(r"[^\W_]+")
#: Digits and signs only stand for letters next to a letter.
_SIGN = re.compile(r"(?<![^\W\d_])[0-9@$]+(?![^\W\d_])")


def fold(text: str | None) -> str:
    """Lower case, compatibility forms and marks removed, look-alike letters, digits and signs as the letters they pass for."""
    if not text:
        return ""
    text = text.lower()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return _SIGN.sub(" ", text).translate(_TABLE)


@dataclass
class Lexicon:
    """Terms (word beginnings) with weights, exception phrases, and the calibration ``bias, per_text, per_length``."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    calibration: tuple[float, float, float] | None = None

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term in {*self.weights, *self.exceptions}:
            found.add_word(term, (len(term), self.weights.get(term), term in set(self.exceptions)))
        if len(found):
            found.make_automaton()
        return found if len(found) else None

    def hits(self, folded: str, automaton) -> list[tuple[int, int, float]]:
        """``start, end, weight`` of the longest term at each word start that no exception phrase covers."""
        if automaton is None:
            return []
        best, spared = {}, []
        for end, (size, weight, excepted) in automaton.iter(folded):
            start = end + 1 - size
            if start and folded[start - 1].isalnum():
                continue
            if excepted and (end + 1 == len(folded) or not folded[end + 1].isalnum()):
                spared.append((start, end))
            if weight is not None and best.get(start, (0, 0.0))[0] < end + 1:
                best[start] = (end + 1, weight)
        return [(s, e, w) for s, (e, w) in best.items() if not any(a <= s and e <= b + 1 for a, b in spared)]

    def features(self, folded: str, automaton) -> tuple[float, float]:
        """Weight of all hits (logarithm), and weight per hundred words."""
        total = sum(w for _, _, w in self.hits(folded, automaton))
        return math.log1p(total), 100.0 * total / max(1, len(folded.split())) if total else 0.0

    def score(self, folded: str, automaton) -> float:
        """Between 0 and 1; 0 where nothing could be learned."""
        if self.calibration is None:
            return 0.0
        bias, a, b = self.calibration
        x, y = self.features(folded, automaton)
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, bias + a * x + b * math.log1p(y)))))


def held_out(key) -> F.Column:
    """True for rows whose crc32 of the key as text is divisible by 5; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _terms(folded: str) -> set[str]:
    out = set()
    for word in set(_WORD.findall(folded)):
        if len(word) >= STEMS[0]:
            out.add(word)
            out.update(word[:n] for n in STEMS if n < len(word))
    return out


def _phrases(folded: str, lexicon: Lexicon, automaton) -> set[str]:
    """Word pairs around each hit."""
    hits = lexicon.hits(folded, automaton)
    if not hits:
        return set()
    spans = [(m.start(), m.group()) for m in _WORD.finditer(folded)]
    at, out = {s: i for i, (s, _) in enumerate(spans)}, set()
    for start, _, _ in hits:
        i = at.get(start)
        if i is None:
            continue
        for a, b in ((i - 1, i), (i, i + 1)):
            if a >= 0 and b < len(spans) and spans[a][0] + len(spans[a][1]) + 1 == spans[b][0]:
                out.add(folded[spans[a][0] : spans[b][0] + len(spans[b][1])])
    return out


def _counted(sample: DataFrame, of) -> DataFrame:
    """``term, toxic, clean``: rows of each class that hold a term, summed within a task before the shuffle."""

    def run(batches):
        import pyarrow as pa

        def pack(held):
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held)), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())], names=["term", "toxic", "clean"]
            )

        counter = of()
        held: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1)):
                toxic = toxic.as_py()
                for term in counter(fold(text.as_py())):
                    held.setdefault(term, [0, 0])[1 - toxic] += 1
                if len(held) > 200_000:
                    yield pack(held)
                    held = {}
        if held:
            yield pack(held)

    rows = sample.select("text", "toxic").mapInArrow(run, "term string, toxic long, clean long")
    return rows.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``text, toxic, stands`` of up to :data:`SAMPLE_ROWS` rows of each class, the first by hash, held-out rows never among them.

    ``stands`` is the number of labelled texts of the class for each one taken, so that sums of it keep the class shares.
    Copies of a text count once, so that the words of a much-copied row do not become terms.  Labels other than 0 and 1 are dropped; of several for one key the largest holds.
    """
    told = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("toxic"))
    told = told.filter(~held_out(F.col(key)))
    every, chosen = told, None
    for kind in (0, 1):
        part = told.filter(F.col("toxic") == kind).orderBy(F.xxhash64(key), key).limit(SAMPLE_ROWS)
        chosen = part if chosen is None else chosen.union(part)
    chosen = F.broadcast(chosen.select(F.col(key).alias("__key"), "toxic"))  # at most 2 * SAMPLE_ROWS small rows
    rows = docs.select(F.col(key).alias("__id"), F.col(text).alias("text"))
    told = rows.join(chosen, F.col("__id") == F.col("__key")).select("text", "toxic")
    sample = settle(told.groupBy("text").agg(F.max("toxic").alias("toxic")), "labelled")
    taken, held = _classes(sample), None
    if max(r["count"] for r in every.groupBy("toxic").count().collect() or [{"count": 0}]) > SAMPLE_ROWS:
        marked = docs.select(F.col(key).alias("__id"), F.xxhash64(F.lit(1), text).alias("print"))
        marked = marked.join(every.select(F.col(key).alias("__key"), "toxic"), F.col("__id") == F.col("__key"))
        held = _classes(marked.groupBy("print").agg(F.max("toxic").alias("toxic")))
    weight = [(held or taken).get(k, 0) / taken[k] if taken.get(k) else 1.0 for k in (0, 1)]
    return sample.withColumn("stands", F.when(F.col("toxic") == 1, weight[1]).otherwise(weight[0]))


def _classes(rows: DataFrame) -> dict[int, int]:
    return {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}


def fit(sample: DataFrame) -> Lexicon:
    """Terms by log odds, a longer one only where it says more than its beginning; exceptions from phrases of clean rows; a logistic calibration."""
    size = sample.agg(F.sum("toxic"), F.count("*"), F.max(F.expr("IF(toxic = 1, stands, NULL)")), F.max(F.expr("IF(toxic = 0, stands, NULL)"))).first()
    n_toxic, n_clean = size[0] or 0, (size[1] or 0) - (size[0] or 0)
    if not n_toxic:
        return Lexicon()
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    counts = _counted(sample, lambda: _terms).withColumn("odds", odds)
    share = F.lit(n_toxic / (n_toxic + n_clean)) * (F.col("toxic") + F.col("clean"))
    ratio = F.col("toxic") * F.log(F.col("toxic") / share) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (F.col("toxic") + F.col("clean") - share))).otherwise(0.0)
    rows = counts.filter((F.col("toxic") >= max(MIN_ROWS, MIN_SHARE * n_toxic)) & (F.col("odds") >= MIN_ODDS) & (2 * ratio >= MIN_RATIO)).collect()
    weights: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r.term), r.term)):
        begun = [weights[r.term[:n]] for n in range(STEMS[0], len(r.term)) if r.term[:n] in weights]
        if not (begun and abs(begun[-1] - r.odds) < 0.5) and not (begun and begun[-1] >= 5.0):
            weights[r.term] = min(8.0, r.odds)
    lexicon = Lexicon(weights)

    def phrases():
        automaton = lexicon.automaton()
        return lambda folded: _phrases(folded, lexicon, automaton)

    spared = _counted(sample, phrases).withColumn("odds", odds)
    spared = spared.filter((F.col("clean") >= MIN_CLEAN) & (F.col("odds") < 0)).collect()
    lexicon.exceptions = tuple(sorted(r.term for r in spared))

    def measure(batches):
        import pyarrow as pa

        automaton = lexicon.automaton()
        for batch in batches:
            found = Counter()
            for text, toxic in zip(batch.column(0), batch.column(1)):
                x, y = lexicon.features(fold(text.as_py()), automaton)
                found[(round(x, 2), round(math.log1p(y), 2), toxic.as_py())] += 1
            columns = list(zip(*((*k, n) for k, n in found.items()))) if found else [[]] * 4
            kinds = (pa.float64(), pa.float64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["x", "y", "toxic", "n"])

    # at most 2 * SAMPLE_ROWS rows
    seen = sample.select("text", "toxic").mapInArrow(measure, "x double, y double, toxic int, n long").toPandas()
    stands = seen["toxic"].map({1: size[2], 0: size[3]}).to_numpy(float)
    lexicon.calibration = _logistic(seen[["x", "y"]].to_numpy(), seen["toxic"].to_numpy(), seen["n"].to_numpy() * stands)
    return lexicon


def _logistic(x, y, n, penalty: float = 1.0, rounds: int = 50):
    import numpy as np

    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(3), np.diag([0.0, penalty, penalty])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - ridge @ w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge + 1e-6 * np.eye(3), slope)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def score(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score, hits`` per row, over whole texts; ``hits`` are the distinct matched terms as folded.

    Null and empty texts, and texts without a term, get the score of no hits.  Repeated rows stay repeated; other
    columns are not read, whatever their names.
    """

    def run(batches):
        import pyarrow as pa

        automaton = lexicon.automaton()
        for batch in batches:
            scores, hits = [], []
            for t in batch.column(1):
                folded = fold(t.as_py())
                scores.append(lexicon.score(folded, automaton))
                hits.append(sorted({folded[a:b] for a, b, _ in lexicon.hits(folded, automaton)}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(hits, pa.list_(pa.string()))], names=[key, "score", "hits"])

    schema = T.StructType([docs.schema[key], T.StructField("score", T.DoubleType()), T.StructField("hits", T.ArrayType(T.StringType()))])
    return spread(docs.select(key, text), key).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, score, predicted`` per row, learned from the labels of rows that are not held out.

    Without toxic labels nothing can be learned and every score is 0.  A null key is held out.
    """
    found = score(docs, fit(labelled_sample(docs, labels, key, text)), key, text)
    return found.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows whose text scores below ``limit``, all columns kept, whatever their names.

    Null and empty texts hold no term and stay, repeated rows stay or go together, an empty table gives no rows; without
    toxic labels nothing can be learned and every row stays.
    """
    lexicon = fit(labelled_sample(docs, labels, key, text))
    at = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        automaton = lexicon.automaton()
        for batch in batches:
            keep = [lexicon.score(fold(t.as_py()), automaton) < limit for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return spread(docs).mapInArrow(run, docs.schema)
