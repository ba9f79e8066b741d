from pyspark.sql import functions as F

from plumbline.llm import language_id
from plumbline.llm.queries import op1_language_id


def _model(spark):
    rows = [(i, "the cat and the dog went to the house of this man " * 3, "en") for i in range(8)]
    rows += [(100 + i, "der hund und die katze gingen nicht mit dem mann ins haus " * 3, "de") for i in range(5)]
    rows += [(200, None, "en"), (201, "123 456", "xx"), (202, "no language here", None)]
    return language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_edge_cases(spark):
    model = _model(spark)
    assert [name for name, _ in model.dictionaries] == ["en", "de"]
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (4, "the dog and the man"), (5, "der mann und die katze"), (6, "the house " * 20_000), (6, "the house " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(1))
    found = docs.select("doc_id", language_id.language(F.col("text"), model).alias("x")).collect()
    told = sorted((r["doc_id"], r["x"]["lang_pred"], r["x"]["rejected"]) for r in found)
    assert told[:3] == [(1, "und", True), (2, "und", True), (3, "und", True)]
    assert [t[1] for t in told[3:]] == ["en", "de", "en", "en"]
    assert all(0 <= r["x"]["score"] <= 1 for r in found)


def test_empty_input_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language_id.train(none)
    assert none.select(language_id.language(F.col("text"), model)).count() == 0
    one = spark.createDataFrame([("words",)], "text string").select(language_id.language(F.col("text"), model).alias("x"))
    assert one.first()["x"]["lang_pred"] == "und"


def test_held_out_accuracy(spark, sf):
    found = op1_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.where("held_out").join(truth, "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert found.count() == truth.count()
    assert rows[0] > 0.97


def test_a_very_long_text_does_not_cost_its_language(spark):
    rows = [(1, "1 " * 50_000 + "the cat sat on the mat " * 200_000, "en"), (2, "der hund bellt und die katze schweigt", "de"), (None, "le chat dort", "fr"), (None, "le chat dort", "fr")]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [name for name, _ in model.dictionaries] == ["fr", "de", "en"]


def test_whole_texts_are_encoded(spark):
    """The sizes are those of all words of a text, repeats included, cut into pieces and nowhere else."""
    model = _model(spark)
    coders = [(name, language_id._compressor(content)) for name, content in model.dictionaries]
    text = "Der Hund, 12 the house! " * 400 + "mit dem mann " * 300
    words = [w.lower() for w in text.replace(",", " ").replace("!", " ").split() if w.isalpha() or w.strip(",!").isalpha()]
    pieces = [" ".join(words[i : i + language_id.PIECE]).encode() for i in range(0, len(words), language_id.PIECE)]
    sizes = {name: sum(len(coder.compress(x)) for x in pieces) for name, coder in coders}
    lang, score, rejected = language_id.classify(text, coders, language_id.MIN_MARGIN)
    assert lang == min(sizes, key=sizes.get) and score == (max(sizes.values()) - min(sizes.values())) / max(sizes.values())
    assert rejected == (score < language_id.MIN_MARGIN)


def test_words_keep_their_marks(spark):
    """Hindi, Thai, decomposed French and Persian joiners: marks belong to words, so that languages of one script differ."""
    assert language_id._LETTERS.findall("हिन्दी भाषा, กำลัง été می‌خواهم x1y_z 12") == ["हिन्दी", "भाषा", "กำลัง", "été", "می‌خواهم", "x", "y", "z"]
    texts = {"hi": "हिन्दी भाषा में लिखा गया यह वाक्य किसी पुस्तक का है", "mr": "मराठी भाषेत लिहिलेले हे वाक्य एका पुस्तकातील आहे", "th": "ภาษาไทย เป็น ภาษา ที่ ใช้ ใน ประเทศไทย", "fr": "l'été a été très chaud cette année"}
    rows = [(i, t, k) for i, (k, t) in enumerate(texts.items())] * 3 + [(90, "word " * 80_000 + "ende", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    found = docs.select("lang", language_id.language(F.col("text"), model).alias("x")).select("lang", "x.lang_pred").distinct().collect()
    assert {(r["lang"], r["lang_pred"]) for r in found} == {(k, k) for k in [*texts, "de"]}
    assert b"ende" in dict(model.dictionaries)["de"]  # a long text teaches whole


def test_fifty_languages(spark):
    """Each of fifty made-up languages is told from words that its dictionary holds."""
    import random

    rng = random.Random(2)
    words = {f"l{i:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(120)] for i in range(50)}
    rows = [(i * 10 + k, " ".join(rng.choice(words[lang]) for _ in range(60)), lang) for i, lang in enumerate(words) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    tests = spark.createDataFrame([(" ".join(rng.choice(w) for _ in range(40)), lang) for lang, w in words.items()], "text string, lang string")
    assert tests.select((language_id.language(F.col("text"), model)["lang_pred"] == F.col("lang")).alias("ok")).where("ok").count() == 50
