import random

import numpy as np

from plumbline.llm import minhash_dedup as md
from plumbline.llm.queries import op9_minhash_dedup


def _brute(rows, width, percent):
    """Components by comparing all pairs of small data."""
    sets = []
    for _, text in rows:
        w = [x.lower() for x in text.encode().split()] if text else []
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return [(doc_id, len(sets[i]), least.get(root(i))) for i, (doc_id, _) in enumerate(rows)]


def _corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.choice([1, 1, 2, 6, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) * 7 % 1009, " ".join(copy)))
    rng.shuffle(rows)
    return rows


def test_against_all_pairs(spark):
    extra = [(2000, None), (2001, ""), (2002, "Two Words"), (2003, "two words"), (2004, "two"), (2005, " \n"), (2006, "x " * 50_000), (2007, "X " * 40_000), (2003, "two words")]
    for seed, width, percent, how in ((1, 3, 85, {"bands": 24, "rows": 5}), (2, 5, 80, {})):
        rows = _corpus(seed) + extra
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS node", "1 AS component")
        got = md.near_duplicates(docs.repartition(3), shingle_words=width, percent=percent, **how).collect()
        key = lambda t: tuple(-1 if x is None else x for x in t)
        assert sorted((tuple(r)[:3] for r in got), key=key) == sorted(_brute(rows, width, percent), key=key)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_deduplicate(spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(5, text, 1), (3, text, 2), (9, text + " more", 3), (4, "other words here", 4), (4, "other words here", 4), (None, text, 5), (8, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept long")
    got = sorted((r["doc_id"] or 0, r["kept"]) for r in md.deduplicate(docs).collect())
    assert got == [(0, 5), (3, 2), (4, 4), (8, 6)]
    assert md.deduplicate(docs.limit(0)).count() == 0


def test_deduplicate_with_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a, 1), (5, a + " more", 2), (5, b, 3), (7, c, 4), (7, c + " more", 5), (8, c, 6), (9, "", 7), (9, None, 8), (9, "", 9), (5, b.upper(), 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long")
    got = sorted(r["row"] for r in md.deduplicate(docs).collect())
    assert {1} <= set(got) and 2 not in got and 6 not in got
    assert len({3, 10} & set(got)) == 1 and len({4, 5} & set(got)) == 1  # one row for each component
    assert 8 in got and len({7, 9} & set(got)) == 1 and len(got) == 5


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    for shared in (400, 300, 100):
        both = rng.integers(0, 2**63, shared).astype(np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, 400 - shared).astype(np.uint64)])) for _ in range(2))
        similarity = shared / (800 - shared)
        bits = sum(int(x).bit_count() for x in (md.odd_sketch(md.minhash(a, 120)) ^ md.odd_sketch(md.minhash(b, 120))).view(np.uint64))
        estimate = 1 + 512 / (4 * 120) * np.log(1 - 2 * bits / 512)
        assert abs(estimate - similarity) < 0.2
    assert md.most_differing_bits(0.85, 120) < md.most_differing_bits(0.5, 120) < 256


def test_query_whole_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op9_minhash_dedup(spark, sf).collect()
    assert sorted(tuple(r)[:3] for r in got) == sorted(_brute(rows, 3, 85))


def test_small_blocks_and_shared_hubs(spark, monkeypatch):
    """Texts that lie about the threshold of each other, a hub of many pairs, blocks of a few nodes."""
    monkeypatch.setattr(md, "HUB_PAIRS", 3)
    monkeypatch.setattr(md, "BLOCK", 4)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(60):
        copy = list(base)
        for i in range(k % 5):  # two words changed between two texts are within the threshold, three are not
            copy[rng.randrange(len(copy))] = f"x{k % 20}y{i}"
        rows.append((k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = md.near_duplicates(docs).collect()
    assert sorted(tuple(r)[:3] for r in got) == sorted(_brute(rows, 5, 80))
    assert 2 < len({r["component_id"] for r in got}) < 60


def test_many_rows_with_a_null_or_equal_id(spark, monkeypatch):
    """Texts are found by id and set, so that rows met follow the rows there are."""
    met = []
    kept = md.saved

    def counted(df, name):
        out = kept(df, name)
        if name == "dedup-texts":
            met.append(out.count())
        return out

    monkeypatch.setattr(md, "saved", counted)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(240):
        copy = list(base)
        copy[rng.randrange(len(copy))] = f"x{k}"
        rows.append((None if k % 3 else 7, " ".join(copy)))
    rows += [(7, None), (None, None), (7, ""), (9, " ".join(base)), (9, None), (9, "another text"), (11, "another text")] + rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = md.near_duplicates(docs).collect()
    key = lambda t: tuple(-1 if x is None else x for x in t)
    assert sorted((tuple(r)[:3] for r in got), key=key) == sorted(_brute(rows, 5, 80), key=key)
    assert met and sum(met) <= len(rows)
    got = [(r["doc_id"], r["text"]) for r in md.deduplicate(docs).collect()]
    assert [r for r in got if r[0] == 7] and (9, " ".join(base)) not in got
