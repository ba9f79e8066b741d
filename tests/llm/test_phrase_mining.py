import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
import zstandard

from plumbline.llm import phrase_mining
from plumbline.llm.queries import ORACLE_SQL, op12_phrase_mining

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_automaton_counts_all_short_substrings():
    random.seed(1)
    for _ in range(300):
        depth, symbols = random.choice([1, 2, 3, 3, 4, 5]), random.choice([1, 2, 3, 5])
        automaton, want = phrase_mining.PhraseAutomaton(depth), Counter()
        for _ in range(random.randint(1, 8)):
            sequence, weight = [random.randrange(symbols) for _ in range(random.randint(1, 14))], random.randint(1, 3)
            automaton.add(sequence, weight)
            for i in range(len(sequence)):
                for n in range(1, min(depth, len(sequence) - i) + 1):
                    want[tuple(sequence[i : i + n])] += weight
        got = [(tuple(r), n) for rows, counts in automaton.substrings() for r, n in zip(rows.tolist(), counts.tolist(), strict=True)]
        assert len(got) == len(want) and dict(got) == want


def test_automaton_states_are_classes_of_end_positions():
    random.seed(2)
    for _ in range(100):
        depth, symbols = random.choice([1, 2, 3, 4]), random.choice([1, 2, 3, 5])
        automaton, ends = phrase_mining.PhraseAutomaton(depth), {}
        for k in range(random.randint(1, 8)):
            sequence = [random.randrange(symbols) for _ in range(random.randint(1, 14))]
            automaton.add(sequence, 1)
            for i in range(len(sequence)):
                for n in range(1, min(depth, i + 1) + 1):
                    ends.setdefault(tuple(sequence[i - n + 1 : i + 1]), set()).add((k, i))
        automaton.build()
        classes = {}
        for string, where in ends.items():
            classes.setdefault(frozenset(where), []).append(string)
        assert len(automaton.length) == len(classes) + 1 and automaton.link[0] == -1
        for where, strings in classes.items():
            state = 0
            for symbol in max(strings, key=len):
                steps = slice(*automaton.first[state : state + 2])
                state = automaton.states[steps][automaton.symbols[steps] == symbol].item()
            assert automaton.length[state] == max(map(len, strings)) and automaton.count[state] == len(where)
            assert automaton.length[automaton.link[state]] == min(map(len, strings)) - 1


def test_automaton_without_sequences():
    assert [len(rows) for rows, _ in phrase_mining.PhraseAutomaton(3).substrings()] == [0, 0, 0]


def _counted(pieces):
    found = Counter()
    for piece, weight in pieces.items():
        words = piece.split()
        for n in (1, 2, 3):
            for phrase in zip(*(words[i:] for i in range(n)), strict=False):
                found[phrase] += weight
    return found


def test_shard_costs_less_than_its_phrases_counted_one_by_one():
    random.seed(5)
    words = [f"w{i}".encode() for i in range(20_000)]
    pieces = {b" ".join(random.choices(words[:2000], k=4) + random.choices(words, k=4)): 1 for _ in range(20_000)}
    costs = {}
    for name, run in (("shard", lambda: list(phrase_mining._shard_rows("en", pieces, 3, 8))), ("plain", lambda: _counted(pieces))):
        for _ in range(4):
            began = time.process_time()
            run()
            costs[name] = min(costs.get(name, np.inf), time.process_time() - began)
    assert costs["shard"] < costs["plain"]


def test_shard_has_one_row_for_each_bucket():
    random.seed(6)
    pieces = {b" \t".join(random.choices([b"a", b"b", b"\xc3\x9f", b"\x00", b"w1"], k=random.randint(1, 9))): random.randint(1, 3) for _ in range(200)}
    found, rows = Counter(), list(phrase_mining._shard_rows("en", pieces, 3, 16))
    unpack = zstandard.ZstdDecompressor().decompress
    for _, _, phrases, counts, _ in rows:
        lines = unpack(phrases).split(b"\n")
        assert lines.pop() == b""
        for line, n in zip(lines, np.frombuffer(unpack(counts), np.int64).tolist(), strict=True):
            assert tuple(line.split(b" ")) not in found
            found[tuple(line.split(b" "))] = n
    assert found == _counted(pieces)
    assert len({bucket for _, bucket, *_ in rows}) == len(rows) == 16
    assert sum(words for *_, words in rows) == sum(weight * len(piece.split()) for piece, weight in pieces.items())


def _mined(rows, most=3, least=10, percent=50, top=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(_LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, most + 1):
                for i in range(len(words) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inner = Counter()
        for q, a in candidates.items():
            for n in range(2, len(q)):
                for i in range(len(q) - n + 1):
                    inner[q[i : i + n]] = max(inner[q[i : i + n]], a)
        scored = []
        for p, a in candidates.items():
            if inner[p] and 100 * inner[p] >= percent * a:
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(map(str, out))


def _rows():
    random.seed(3)
    words = [f"w{i}" for i in range(12)] + ["É", "ß", "\x01", " ", "a b"]
    rows = []
    for i in range(120):
        text = "".join(random.choice(words) + random.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r"]) for _ in range(random.randint(0, 60)))
        rows.append((random.choice(["en", "de", None, "und"]), text))
    rows += [("en", "New York City is New York City. " * 30), ("en", "New York!" * 15), ("en", "x " * 5000), ("en", None), (None, None), ("fr", ""), ("fr", " \n.\t"), ("fr", "rare words here")]
    return rows + rows[:40]


@pytest.mark.parametrize("shard_words,top,most", [(300_000, 2000, 3), (50, 2000, 3), (200, 7, 3), (100, 2000, 4), (100, 2000, 2)])
def test_against_brute_force(spark, shard_words, top, most):
    df = spark.createDataFrame([(*r, "clash", 1) for r in _rows()], "lang string, text string, phrase string, bucket int")
    found = phrase_mining.collocations(df, most_words=most, top=top, shard_words=shard_words).select(*COLUMNS)
    assert sorted(str(tuple(r)) for r in found.collect()) == _mined(_rows(), most=most, top=top)


def test_buckets_summed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(phrase_mining, "HELD_BYTES", 100)
    df = spark.createDataFrame(_rows(), "lang string, text string")
    found = phrase_mining.collocations(df, shard_words=50).select(*COLUMNS)
    assert sorted(str(tuple(r)) for r in found.collect()) == _mined(_rows())


def test_large_counts_are_exact(spark):
    rows = [(3_037_000_500, 3_037_000_501, 3_037_000_503), (10**15, 10**15, 10**15), (10**15 - 1, 10**15, 10**15), (7, 2**62, 2**62), (999_999, 1_000_000, 999_999)]
    df = spark.createDataFrame(rows, "a long, l long, r long").selectExpr("a", "l", "r", f"{phrase_mining._SCORE} AS score")
    assert all(r["score"] == 10**6 * r["a"] ** 2 // (r["l"] * r["r"]) for r in df.collect())


def test_empty_table(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert phrase_mining.collocations(none).count() == 0


def test_query_against_sql(spark, sf):
    documents = duckdb.read_parquet(f"{sf}/documents.parquet")  # noqa: F841  named in the SQL
    want = duckdb.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL['op12_phrase_mining']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in op12_phrase_mining(spark, sf).select(*COLUMNS).collect())
