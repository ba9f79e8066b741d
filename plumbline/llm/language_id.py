"""Language identification by compression.

For each language a raw-content dictionary of its words is built. A text is encoded with every
dictionary, and the language whose dictionary gives the fewest bytes is chosen; if the next one comes
close, the choice is rejected. Every word of a text is encoded, in pieces of `PIECE` words, so that a piece
draws on the dictionary and not on what came long before; what lies between words is encoded as one blank,
as digits, marks and white space belong to no language.

Defined results: a null text or one without a letter is `und`, with score 0, and rejected. Ties go to the
language with more labelled rows, then to the smaller name. Rows with a null language or a text without
a letter teach nothing; what rows of the sample teach, they teach whole. Each language with a row that
teaches is learned. With no such row at all every text is `und`; with one language it is always chosen, with
score 0. Rows with null or repeated ids teach as others do, repeated rows are told alike, and no column but
those named is read.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import frees

UNDETERMINED = "und"
#: Bytes of a dictionary.
DICTIONARY_BYTES = 131_072
#: Rows of each language, at most, that its dictionary is built from.
SAMPLE_ROWS = 600
#: Words encoded at once.
PIECE = 300
#: Relative saving over the next best language below which a choice is rejected.
MIN_MARGIN = 0.005

#: A word begins with a letter; marks belong to it, as do the joiners inside words of some scripts.
_LETTERS = regex.compile(r"\p{L}(?:[\p{L}\p{M}]|[\u200C\u200D](?=\p{L}))*")


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries by language, the most common language first."""

    dictionaries: tuple[tuple[str, bytes], ...]


def _first_words(text: str, most_bytes: int) -> list[str]:
    """A text's words, each once and in order, until they fill a dictionary."""
    words: dict[str, None] = {}
    size = 0
    for found in _LETTERS.finditer(text.lower()):
        if size >= most_bytes:
            break
        if found[0] not in words:
            words[found[0]] = None
            size += len(found[0].encode()) + 1
    return list(words)


def train(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    sample_rows: int = SAMPLE_ROWS,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> LanguageModel:
    """Build the dictionaries from a sample of labelled rows, chosen by a hash of the id."""
    rows = labelled.select(
        F.col(f"`{lang_col}`").cast("string").alias("lang"),
        F.col(f"`{text_col}`").alias("text"),
        F.xxhash64(F.col(f"`{id_col}`").cast("string")).alias("hash"),
    ).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel(())
    # Some twice the wanted rows pass this filter, so that the window below meets a bounded number of them.
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, 2 * sample_rows / n))).otherwise(rate)
    sample = rows.where(F.pmod("hash", F.lit(1_000_003)) < rate * 1_000_003)
    order = Window.partitionBy("lang").orderBy("hash", "text")
    sample = sample.withColumn("row", F.row_number().over(order)).where(F.col("row") <= sample_rows).select("lang", "row", "text")

    @F.arrow_udf("array<string>")
    @frees
    def words_of(column: pa.Array) -> pa.Array:
        return pa.array([_first_words(t.as_py(), dictionary_bytes) for t in column], pa.list_(pa.string()))

    texts: dict[str, list[tuple[int, list[str]]]] = {}
    for r in sample.select("lang", "row", words_of("text").alias("words")).collect():
        texts.setdefault(r["lang"], []).append((r["row"], r["words"]))
    built = []
    for lang in sorted(texts, key=lambda k: (-counts[k], k)):
        words: dict[str, None] = {}
        size = 0
        for _, text in sorted(texts[lang]):
            for word in text:
                if word not in words:
                    words[word] = None
                    size += len(word.encode()) + 1
            if size >= dictionary_bytes:
                break
        built.append((lang, " ".join(words).encode()[:dictionary_bytes]))
    return LanguageModel(tuple(built))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    raw = dictionary if len(dictionary) >= 8 else dictionary.ljust(8)
    content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(
        compression_level=3,
        strategy=zstandard.STRATEGY_GREEDY,
        min_match=3,
        window_log=18,
        hash_log=17,
        chain_log=16,
        search_log=3,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )
    content.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=content)


def classify(text: str | None, coders: list, min_margin: float) -> tuple[str, float, bool]:
    """Language, relative saving over the next best language, and whether the choice is rejected."""
    if not text or not coders or not any(c.isalpha() for c in text):
        return UNDETERMINED, 0.0, True
    words = _LETTERS.findall(text.lower())
    sizes = [0] * len(coders)
    for k in range(0, len(words), PIECE):
        piece = " ".join(words[k : k + PIECE]).encode()
        for i, (_, coder) in enumerate(coders):
            sizes[i] += len(coder.compress(piece))
    best = min(range(len(sizes)), key=sizes.__getitem__)
    rest = min((s for i, s in enumerate(sizes) if i != best), default=sizes[best])
    score = (rest - sizes[best]) / rest if rest else 0.0
    return coders[best][0], score, score < min_margin and len(coders) > 1


def language(text: Column, model: LanguageModel, min_margin: float = MIN_MARGIN) -> Column:
    """A struct (lang_pred, score, rejected) for a text column."""
    dictionaries = model.dictionaries
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    coders: list = []

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    @frees
    def identify(texts: pa.Array) -> pa.Array:
        if not coders:
            coders.extend((name, _compressor(content)) for name, content in dictionaries)
        rows = [classify(t.as_py(), coders, min_margin) for t in texts]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind[i].type) for i in range(3)], fields=list(kind))

    return identify.asNondeterministic()(text)  # so that Catalyst doesn't evaluate it once for each use
