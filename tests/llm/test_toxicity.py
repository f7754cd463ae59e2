"""Folding, matching, exceptions, held-out accuracy, edge cases."""

import random
import zlib

from barloom.llm import toxicity as x
from barloom.llm.queries import QUERIES


def test_fold_and_match():
    assert x.fold("1D10T mоrоn сlown $cum") == "idiot moron clown scum"
    assert x.fold("Ünïcode ﬁne 100 a1") == "unicode fine   ai"
    lexicon = x.Lexicon({"idio": 5.0, "idiotic": 7.0, "rose": 3.0}, ("red rose",))
    automaton = lexicon.automaton()
    assert lexicon.hits("idiots idiotic videoidio", automaton) == [(0, 4, 5.0), (7, 14, 7.0)]
    assert lexicon.hits("a red rose", automaton) == [] and lexicon.hits("a red roses", automaton) == [(6, 10, 3.0)]
    assert x.Lexicon().hits("idiot", x.Lexicon().automaton()) == []


def _corpus(spark, seed=4):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("lor", "dol", "sit", "ame", "con") for b in ("em", "or", "et", "is", "ut", "ad")]
    rows, labels = [], []
    for i in range(900):
        w = rng.choices(vocabulary, k=rng.randint(5, 60))
        toxic = i % 3 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["blarg", "fnord", "blargs"])
        elif i % 25 == 1:  # rare enough for the word to be a term of its own
            w += ["royal", "fnord"]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_learns_terms_and_exceptions(spark):
    rows, labels = _corpus(spark)
    rows += [(2000, "lorem blаrg"), (2001, "lorem BL4RG"), (2002, None), (2003, ""), (2004, "lorem " * 30000 + "blarg " * 3000), (None, "x"), (2005, "a"), (2005, "a")]
    labels += [(2002, 0, None), (None, 0, 1), (2005, 0, 1), (2005, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS toxic")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in x.toxicity(docs, told).collect()}
    assert len(got) == len(rows) - 1
    truth = {i: t for i, _, t in labels[:900]}
    assert sum(got[i].predicted == t for i, t in truth.items()) / len(truth) > 0.97
    assert all(r.held_out == (zlib.crc32(str("" if i is None else i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[2000].predicted == got[2001].predicted == got[2004].predicted == 1 and got[2002].predicted == got[2003].predicted == 0
    kept = x.keep_clean(docs, told)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in x.toxicity(docs, none).collect()] == [0.0, 0.0]
    assert x.toxicity(docs.limit(0), none).count() == 0


def test_query_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg({"toxic": "max"}).withColumnRenamed("max(toxic)", "toxic")
    rows = QUERIES["op4_toxicity"](spark, folder).join(labels, "doc_id").collect()
    test = [r for r in rows if r.held_out]
    assert len(test) > 50 and sum(r.predicted == r.toxic for r in test) / len(test) >= 0.93


def test_class_shares_beyond_the_sample(spark, monkeypatch):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(2000):
        toxic = i % 10 == 0
        w = rng.choices(["lorem", "dolor", "sitam"], k=rng.randint(5, 30)) + [f"n{i}"]
        if rng.random() < (0.9 if toxic else 0.2):
            w.append("blarg")
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(i + 5000, t) for i, t in rows[:300]]  # copies count once
    labels += [(i + 5000, t) for i, t in labels[:300]]
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    whole = x.fit(x.labelled_sample(docs, told))
    every = {t: l for (i, t), (_, l) in zip(rows, labels) if zlib.crc32(str(i).encode()) % 5}
    monkeypatch.setattr(x, "SAMPLE_ROWS", 100)
    sample = x.labelled_sample(docs, told)
    sums = {r.toxic: r.s for r in sample.groupBy("toxic").agg({"stands": "sum"}).withColumnRenamed("sum(stands)", "s").collect()}
    assert abs(sums[1] - sum(every.values())) < 1e-6 and abs(sums[0] - sum(1 - v for v in every.values())) < 1e-6
    capped = x.fit(sample)
    # the mean score is the class share
    means = [sum(r.score for r in x.score(docs, lexicon).collect()) / len(rows) for lexicon in (whole, capped)]
    assert all(abs(m - 0.1) < 0.04 for m in means), means
