import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import quality_classifier as qc
from plumbline.llm import quality_rules as qr
from plumbline.llm.queries import op6_quality_classifier, op7_quality_rules


def _repeats(words):
    """Words in windows of 8 found twice or more, by counting windows."""
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(i, i + 8))
    return len(covered)


def test_rules_against_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_quality_rules(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r["doc_id"]]
        words = text.encode().split()
        lines = [x for x in text.split("\n") if x.encode().split()]
        want = (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), _repeats(words))
        assert want == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_rules_clean_lines(spark):
    prose = "This is a line of plain prose that ends as lines of prose do, with a stop, after some more words to be long enough."
    assert qr.judge_text(prose)[-1] == prose
    page = f"Home | News | Sport | Contact | About\n{prose}\n\nBUY!! NOW!! CHEAP!! CLICK!!\nAll rights reserved.\n### $$$ ***"
    found = qr.judge_text(page)
    assert found[-1] == f"{prose}\n"
    assert qr.judge_text(f"{prose}\n" + "A | B | C | D | E | F | G\n" * 30)[6] is False
    assert qr.judge_text(prose + " This keeps it.")[6] is True
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "word " * 50_000), (4, prose), (4, prose)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS kept", "1 AS n_words")
    got = docs.select("doc_id", qr.quality_rules(F.col("text")).alias("x")).collect()
    assert [g["x"]["n_words"] for g in got] == [0, 0, 0, 50_000, 25, 25]
    assert [g["x"]["base_failed"] for g in got] == [True, True, True, True, False, False]
    assert docs.limit(0).select(qr.quality_rules(F.col("text"))).count() == 0


def _faulty(lines, i):
    """The line rules again, each put as plainly as can be."""
    line = lines[i]
    words = line.split()
    marks_only = [w for w in words if all(c in "|»«·•›‹>/\\–—-" for c in w)]
    if len(marks_only) >= 3 and len(marks_only) / len(words) >= 0.2 or len(words) >= 3 and len(marks_only) >= (len(words) - 1) / 2:
        return True
    if len(words) <= 30 and any(phrase in line.lower() for phrase in qr.BOILERPLATE):
        return True
    loud = [w for w in words if len(w) >= 2 and all(c in "!?#*$%&|<>=~^_+@" for c in w[-2:])]
    if len(loud) > len(words) / 2 or sum(c in "#*$%&|<>{}[]=~^_+@\\" for c in line) > sum(map(len, words)) / 4:
        return True
    if not any(c.isalnum() for c in line):
        return True
    ends = any(c in ".!?:;,…。！？：；，" for c in line) or line.rstrip()[-1] in "\"'”’»›)]"
    rest = lines[i + 1 :]
    if len(words) >= 12 and not ends and not (rest and rest[0].split()[0][0].islower()):
        return True
    if len(words) >= 8 and sum(words[k] == words[k + 1] for k in range(len(words) - 1)) > len(words) / 2:
        return True
    short = [len(x.split()) <= 4 and x.rstrip()[-1] not in ".!?:;,…。！？：；，\"'”’»›)]" for x in lines]
    return any(all(short[k : k + 3]) and len(short[k : k + 3]) == 3 for k in range(max(0, i - 2), i + 1))


def _verdict(text):
    lines = [x for x in text.split("\n") if x.encode().split()]
    words = text.encode().split()
    size = [sum(len(w.decode()) for w in x.encode().split()) for x in lines]
    lost = sum(n for i, n in enumerate(size) if _faulty(lines, i))
    failed = len(words) < 20 or 100 * _repeats(words) > 30 * len(words)
    return not failed and (not lines or lost <= sum(size) / 2)


def test_verdicts_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = {r["doc_id"]: r["kept"] for r in op7_quality_rules(spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: _verdict(text) for i, text in docs.items()}
    assert 0 < sum(got.values()) < len(got)


def test_line_rules_in_several_languages():
    prose = "Die Vermessung begann am Morgen, und sie endete erst, als die Sonne unterging."
    menu = "Startseite\nNachrichten\nSport heute\nKontakt"
    assert qr.judge_text(f"{menu}\n{prose}\n\n{prose} Danach war Ruhe.")[-1] == f"{prose}\n\n{prose} Danach war Ruhe."
    for line in ("Alle Rechte vorbehalten", "Tous droits réservés.", "Lea nuestra política de privacidad"):
        assert qr.judge_text(f"{prose}\n{line}")[-1] == prose
    wrapped = "the survey began in the morning of a long day in the north\nand went on until the sun had set behind the hills of home\nwhen everyone went home."
    assert qr.judge_text(wrapped)[-1] == wrapped
    assert qr.judge_text(prose + "\none two three four five six seven eight nine ten eleven twelve")[-1] == prose
    poem = "Roses are red,\nViolets are blue,\nSugar is sweet."
    assert qr.judge_text(poem)[-1] == poem


def test_classifier_scores_are_the_gaussians(spark):
    rng = np.random.default_rng(4)
    d = len(qc.STATISTICS)
    x = np.concatenate([rng.normal(0, 1, (300, d)), rng.normal(1, 2, (200, d))])
    y = [0] * 300 + [1] * 200
    rows = [(v.tolist(), k) for v, k in zip(x, y, strict=True)] + [(x[0].tolist(), None), (x[1].tolist(), 7)]
    model = qc.fit(spark.createDataFrame(rows, "statistics array<double>, quality int"))
    density = []
    for k in (0, 1):
        own = x[np.array(y) == k]
        pooled = sum(np.diag(np.cov(x[np.array(y) == j].T, bias=True)) * (y.count(j) / 500) for j in (0, 1))
        s = 0.9 * np.cov(own.T, bias=True) + np.diag(0.1 * pooled + qc.RIDGE)
        z = x - own.mean(axis=0)
        density.append(math.log(len(own) / 500) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z))
    want = 1 / (1 + np.exp(-(density[1] - density[0]) / qc.TEMPERATURE))
    assert np.allclose(model.scores(x), want)


def test_classifier_edge_cases(spark):
    labelled = spark.createDataFrame([(qc.statistics("a b c"), 1)] * 3, "statistics array<double>, quality int")
    assert qc.fit(labelled).scores(np.zeros((2, len(qc.STATISTICS)))).tolist() == [1.0, 1.0]
    assert qc.fit(labelled.limit(0)).scores(np.zeros((1, len(qc.STATISTICS)))).tolist() == [0.5]
    rows = [(1, None), (2, ""), (3, "\u00a0"), (4, "x " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score")
    got = docs.select(qc.document_statistics("text").alias("s")).collect()
    assert all(len(r["s"]) == len(qc.STATISTICS) and all(map(math.isfinite, r["s"])) for r in got)


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = op6_quality_classifier(spark, sf)
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = found.where("held_out").join(labels, "doc_id").collect()
    right = [r["predicted"] == r["quality"] for r in rows]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
