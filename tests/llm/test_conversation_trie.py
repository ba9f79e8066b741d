import hashlib
import random
import zlib

import duckdb

from plumbline.llm import conversation_trie
from plumbline.llm.queries import ORACLE_SQL, op13_conversation_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _rebuilt(rows):
    by = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in by.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def _trie(convs):
    """The trie by plain recursion over sets of conversations."""
    found = []

    def walk(depth, members, parent, words):
        groups = {}
        for c in members:
            if len(convs[c]) > depth:
                groups.setdefault(convs[c][depth], []).append(c)
        own = min(members)
        leaves, saved = (0, (len(members) - 1) * words) if groups else (1, (len(members) - 1) * words)
        for (_, text), below in groups.items():
            n, s = walk(depth + 1, below, own, len(text.split()))
            leaves, saved = leaves + n, saved + s
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == depth)
        found.append((own, depth, parent, len(members), len(groups), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if convs:
        walk(0, list(convs), None, 0)
    return sorted(map(str, found))


def _run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 7, 1) for r in rows], "conv_id long, turn long, role string, text string, node string, depth int, pos int")
    return sorted(str(tuple(r)) for r in conversation_trie.shared_start_trie(df).select(*COLUMNS).collect())


def test_against_recursion(spark):
    random.seed(5)
    rows = []
    for c in [*range(0, 90), -3, -20, -41, 2**40 + 20, 2**40 + 21]:
        for turn in range(random.choice([1, 1, 2, 3, 5, 9, 18])):
            rows.append((c, turn, random.choice(["user", "assistant"]), random.choice(["a b", "a  b", "c", "", "d e\tf g"])))
    rows += [(101, None, None, None), (101, None, "user", "x"), (101, 3, "user", None), (101, 3, "user", None), (101, 3, "", "zz")]
    rows += [(None, 1, "user", "belongs to none"), (None, None, None, None), (5, 2, "user", "w " * 60_000)]
    rows += [(c, t, "user", f"copy {t}") for c in range(200, 260) for t in range(6)]
    rows += [(300, t, "user", "long") for t in range(700)] + [(301, t, "user", "long") for t in range(650)]
    assert _run(spark, rows) == _trie(_rebuilt(rows))


def test_chunks_of_ids(spark, monkeypatch):
    rows = [(20 * c, 0, "user", "same") for c in range(500)]
    assert _run(spark, rows) == _trie(_rebuilt(rows))


def test_empty_table(spark):
    assert _run(spark, []) == []
    assert _run(spark, [(None, 1, "user", "x")]) == []


def test_query_against_sql(spark, sf):
    conversations = duckdb.read_parquet(f"{sf}/conversations.parquet")  # noqa: F841  named in the SQL
    want = duckdb.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL['op13_conversation_trie']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in op13_conversation_trie(spark, sf).select(*COLUMNS).collect())
