"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversation_trie,
    html_extraction,
    language_id,
    minhash_dedup,
    nearest_neighbours,
    packing,
    phrase_mining,
    quality_classifier,
    quality_rules,
    source_mixing,
    substring_dedup,
    token_counts,
    url_filters,
)
from .common import crc_of_id, saved


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose id's CRC-32 leaves another remainder than 1 by 3."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_of_id(F.col("doc_id")) % 3 == 1, F.lit(True))
    model = language_id.train(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), language_id.language(F.col("text"), model).alias("x"))
    return found.select("doc_id", "held_out", "x.lang_pred", "x.score", "x.rejected")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources by target weights takes of every document."""
    mixed = source_mixing.mix_counts(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, found in flat token streams by their separators."""
    counted = token_counts.document_token_counts(_table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_tokens")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of at most 1,024 tokens."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_extraction.extract(pages)
    return found.select("page_id", "url", "text", html_extraction.text_length(F.col("text")).alias("n_chars"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels whose id's CRC-32 is no multiple of 5."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_of_id(F.col("doc_id")) % 5 == 0, F.lit(True))
    known = saved(
        docs.select("doc_id", held_out.alias("held_out"), quality_classifier.document_statistics("text").alias("statistics")),
        "quality-statistics",
    )
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality_classifier.fit(known.where(~F.col("held_out")).join(labels, "doc_id"))
    scored = known.select("doc_id", "held_out", quality_classifier.quality_score(F.col("statistics"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality_classifier.THRESHOLD).cast("int"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    docs = _table(spark, sf_dir, "documents")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    judged = docs.select("doc_id", quality_rules.quality_rules(F.col("text"), names).alias("x"))
    return judged.select("doc_id", *[f"x.{n}" for n in names])


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every row whose id is divisible by 100, among all rows."""
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest_neighbours.search(vectors, F.col("vec_id") % 100 == 0, k=10)


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by 3-word shingles at a similarity of 0.85."""
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3, percent=85, bands=24, rows=5)


def url_rules(spark: SparkSession) -> DataFrame:
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge_urls(pages, url_rules(spark)).drop("url")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that passages of 13 words cover which a document with a smaller id has too."""
    found = substring_dedup.repeated_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best collocations of two and three words of each language."""
    return phrase_mining.collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all conversations, each rebuilt on the first turns of its block."""
    return conversation_trie.shared_start_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_source_mixing,
        op3_token_counts,
        op4_packing,
        op5_html_extraction,
        op6_quality_classifier,
        op7_quality_rules,
        op8_nearest_neighbours,
        op9_minhash_dedup,
        op10_url_filters,
        op11_substring_dedup,
        op12_phrase_mining,
        op13_conversation_trie,
    )
}

_SIZE = r"CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END"

ORACLE_SQL: dict[str, str] = {
    "op2_source_mixing": rf"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, CAST({_SIZE} AS BIGINT) AS size, md5('17:' || COALESCE(CAST(doc_id AS VARCHAR), 'null')) AS k
    FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
    FROM d GROUP BY source
), fill(step, level, clamped) AS (
    SELECT 0, CAST(0 AS DOUBLE), CAST(-1 AS BIGINT)
    UNION ALL
    SELECT f.step + 1, CAST((any_value(t.total) - sum(CASE WHEN 3 * s.source_size < f.level * s.weight THEN 3 * s.source_size ELSE 0 END)) AS DOUBLE)
                       / CAST(sum(CASE WHEN 3 * s.source_size < f.level * s.weight THEN 0 ELSE s.weight END) AS DOUBLE),
           CAST(sum(CASE WHEN 3 * s.source_size < f.level * s.weight THEN 1 ELSE 0 END) AS BIGINT)
    FROM fill f, s, (SELECT sum(source_size) AS total FROM s) t
    WHERE f.step < 1000
    GROUP BY f.step, f.level, f.clamped
    HAVING sum(CASE WHEN 3 * s.source_size < f.level * s.weight THEN 1 ELSE 0 END) <> f.clamped
), p AS (
    SELECT s.*, CASE WHEN 3 * source_size < level * weight THEN CAST(3 * source_size AS DOUBLE) ELSE level * weight END AS target
    FROM s, (SELECT level FROM fill ORDER BY step DESC LIMIT 1)
), q AS (
    SELECT source, source_size, target,
           CASE WHEN source_size > 0 THEN CAST(floor(floor(target + 0.5) / source_size) AS BIGINT) ELSE 0 END AS whole
    FROM p
), r AS (
    SELECT *, CAST(floor(target + 0.5) AS BIGINT) - whole * source_size AS extra FROM q
), o AS (
    SELECT d.*, sum(size) OVER (PARTITION BY source, k, doc_id, size) AS held, count(*) OVER (PARTITION BY source, k, doc_id, size) AS n,
           sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
    FROM d
)
SELECT o.doc_id, o.size, r.source_size, r.target,
       CAST(r.whole * o.size + least(greatest(floor((r.extra - (o.upto - o.held)) / o.n), 0), o.size) AS BIGINT) AS taken
FROM o JOIN r ON o.source IS NOT DISTINCT FROM r.source
""",
    "op10_url_filters": r"""
WITH rules(r_host, r_path, r_verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), u AS (
    SELECT page_id, COALESCE(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           COALESCE(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path, row_number() OVER () AS n
    FROM pages
), best AS (
    SELECT n, first(r_host || r_path ORDER BY length(r_host) + length(r_path) DESC) AS rule,
           first(r_verdict ORDER BY length(r_host) + length(r_path) DESC) AS verdict
    FROM u JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
    GROUP BY n
)
SELECT page_id, host, path, rule, COALESCE(verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (n)
""",
    "op11_substring_dedup": r"""
WITH d AS (
    SELECT row_number() OVER () AS n, doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents
), windows AS (
    SELECT n, COALESCE(doc_id, 9223372036854775807) AS id, i, array_to_string(w[i:i + 12], ' ') AS passage
    FROM (SELECT n, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)
), least AS (
    SELECT passage, min(id) AS id FROM windows GROUP BY passage HAVING min(id) < max(id)
), hits AS (
    SELECT v.n, list(v.i) AS starts FROM windows v JOIN least l USING (passage) WHERE v.id > l.id GROUP BY v.n
), gone AS (
    SELECT n, list_distinct(flatten(list_transform(starts, lambda i: range(i, i + 13)))) AS places FROM hits
), places AS (
    SELECT n, unnest(places) AS i FROM gone
), words AS (
    SELECT n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d WHERE n IN (SELECT n FROM gone)
), kept AS (
    SELECT words.n, string_agg(word, ' ' ORDER BY words.i) AS text FROM words ANTI JOIN places ON words.n = places.n AND words.i = places.i GROUP BY words.n
)
SELECT doc_id, len(w) AS n_words, COALESCE(len(places), 0) AS n_removed,
       sha256(CASE WHEN places IS NULL THEN array_to_string(w, ' ') ELSE COALESCE(kept.text, '') END) AS kept_sha256
FROM d LEFT JOIN gone USING (n) LEFT JOIN kept USING (n)
""",
    "op12_phrase_mining": r"""
WITH pieces AS (
    SELECT COALESCE(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), words AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM words, unnest([1, 2, 3]) AS t(k)
), f AS (
    SELECT lang, phrase, any_value(k) AS k, count(*) AS f FROM grams GROUP BY lang, phrase
), candidates AS (
    SELECT lang, phrase, k, f AS a FROM f WHERE k > 1 AND f >= 10
), longer AS (
    SELECT lang, unnest([regexp_extract(phrase, '^(.*) [^ ]*$', 1), regexp_extract(phrase, '^[^ ]* (.*)$', 1)]) AS phrase, a AS longest FROM candidates WHERE k = 3
), left_over AS (
    SELECT * FROM candidates c WHERE NOT EXISTS (FROM longer q WHERE q.lang = c.lang AND q.phrase = c.phrase AND 100 * q.longest >= 50 * c.a)
), cuts AS (
    SELECT lang, phrase, a, cut, array_to_string(string_split(phrase, ' ')[1:cut], ' ') AS first, array_to_string(string_split(phrase, ' ')[cut + 1:k], ' ') AS rest
    FROM left_over, unnest([1, 2]) AS t(cut) WHERE cut < k
), scored AS (
    SELECT c.*, p.f AS l, q.f AS r, CAST(a::HUGEINT * a * 1000000 // (p.f::HUGEINT * q.f) AS BIGINT) AS score
    FROM cuts c JOIN f p ON p.lang = c.lang AND p.phrase = c.first JOIN f q ON q.lang = c.lang AND q.phrase = c.rest
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM ranked JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang) USING (lang) WHERE rank <= 2000
""",
    "op13_conversation_trie": r"""
WITH own AS (
    SELECT conv_id AS c, COALESCE(role, '') AS role, COALESCE(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, COALESCE(role, ''), COALESCE(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT c, c - c % 20 AS base, (4294967295 - list_reduce(
               list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
               lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END))
           )) % 4 AS h
    FROM (SELECT DISTINCT c FROM own)
), turns AS (
    SELECT convs.c, 0 AS part, pos, role, text FROM convs JOIN own ON own.c = convs.base AND pos <= h
    UNION ALL
    SELECT own.c, 1, pos, role, text FROM own JOIN convs USING (c) WHERE pos > h
), rebuilt AS (
    SELECT *, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth FROM turns
), prefixes AS (
    SELECT c, depth, text, md5(string_agg(concat(length(role), ':', length(text), ':', role, text), '') OVER (PARTITION BY c ORDER BY depth)) AS node
    FROM rebuilt
    UNION ALL SELECT c, 0, '', 'root' FROM convs
), nodes AS (
    SELECT node, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^ 	-
]+')) AS tokens
    FROM prefixes GROUP BY node, depth
), parents AS (
    SELECT n.*, p.node AS parent, o.conv_id AS parent_conv_id
    FROM nodes n LEFT JOIN prefixes p ON p.c = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN nodes o ON o.node = p.node AND o.depth = n.depth - 1
), children AS (
    SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM parents WHERE parent IS NOT NULL GROUP BY ALL
), below AS (
    SELECT p.node, p.depth, sum(n.tokens) AS saved_tokens, sum(CASE WHEN k.n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves
    FROM nodes n LEFT JOIN children k USING (node, depth) JOIN prefixes p ON p.c = n.conv_id AND p.depth <= n.depth
    GROUP BY p.node, p.depth
), ends AS (
    SELECT node, depth, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends
    FROM prefixes JOIN (SELECT c, max(depth) AS depth FROM prefixes GROUP BY c) USING (c, depth) GROUP BY node, depth
)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, COALESCE(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, COALESCE(ends, sha256('')) AS ends_sha256
FROM parents LEFT JOIN children USING (node, depth) JOIN below USING (node, depth) LEFT JOIN ends USING (node, depth)
""",
}
