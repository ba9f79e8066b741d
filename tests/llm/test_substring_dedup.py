import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from plumbline.llm import substring_dedup
from plumbline.llm.queries import ORACLE_SQL, op11_substring_dedup

COLUMNS = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def _brute(rows, window=13):
    texts = [(2**63 - 1 if d is None else d, re.findall(r"[^\x20\x09-\x0d]+", t or "")) for d, t in rows]
    least = {}
    for own, words in texts:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            least[key] = min(own, least.get(key, own))
    out = []
    for (doc, _), (own, words) in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(words) - window + 1):
            if least[tuple(words[i : i + window])] < own:
                gone |= set(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append(((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()), kept))
    return out


def _rows():
    random.seed(7)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "\x01", " ", "a\x1cb", "字"]
    passages = [[random.choice(vocabulary) for _ in range(random.choice([12, 13, 14, 40, 90]))] for _ in range(12)]
    rows = []
    for d in range(160):
        words = []
        for _ in range(random.randint(0, 5)):
            words += random.choice(passages) if random.random() < 0.5 else [random.choice(vocabulary) for _ in range(random.randint(1, 60))]
        rows.append((d * 7 % 160, "".join(w + random.choice([" ", "  ", "\n", "\t\r", "\x0b"]) for w in words)))
    rows += rows[:20] + [(1000 + d, t) for d, t in rows[:30]] + [(None, t) for _, t in rows[:10]] + [(None, rows[3][1])] * 3
    rows += [(5000, "same " * 3000), (5001, "same " * 40), (5002, "same " * 12), (5003, None), (5004, ""), (None, None), (5005, " \n "), (5003, " ".join(passages[3] * 2)), (-4, " ".join(passages[4])), (2**63 - 1, rows[5][1])]
    return rows


@pytest.mark.parametrize("block_bytes,group_suffixes,window", [(8_000_000, 250_000, 13), (2_000, 250_000, 13), (3_000, 3, 13), (3_000, 40, 5), (2_000, 100, 1), (20_000, 1, 2)])
def test_against_brute_force(spark, block_bytes, group_suffixes, window):
    rows = _rows()
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "doc_id long, text string, digest string, id int, n_words int").repartition(5)
    found = substring_dedup.repeated_passages(df, window, block_bytes, group_suffixes).collect()
    want = [r for r, _ in _brute(rows, window)]
    assert sorted(str(tuple(r[c] for c in COLUMNS)) for r in found) == sorted(map(str, want))
    for r in found:
        assert sum(x["stop"] - x["start"] for x in r["removed"]) == r["n_removed"]
        assert all(a["stop"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:], strict=False))


def test_texts_without_repeats(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.without_repeats(df, block_bytes=3_000).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in found) == sorted(str((r[0], kept)) for r, kept in _brute(rows))


def test_subtree_is_sorted_with_common_prefixes():
    rows = np.random.default_rng(1).integers(0, 3, (500, 4)).astype(np.int32)
    order, common = substring_dedup.subtree(rows)
    ordered = rows[order].tolist()
    assert ordered == sorted(rows.tolist())
    for a, b, n in zip(ordered, ordered[1:], common[1:], strict=False):
        assert a[:n] == b[:n] and (n == 4 or a[n] != b[n])


def test_hashes_pack_into_six_bytes():
    values = np.random.default_rng(2).integers(0, 2**48, 1000, dtype=np.uint64)
    assert (substring_dedup._unpacked_hashes(substring_dedup._packed_hashes(values)) == values).all()


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.repeated_passages(none).count() == 0
    assert substring_dedup.without_repeats(none).count() == 0


def test_query_against_sql(spark, sf):
    documents = duckdb.read_parquet(f"{sf}/documents.parquet")  # noqa: F841  named in the SQL
    want = duckdb.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL['op11_substring_dedup']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in op11_substring_dedup(spark, sf).collect())
