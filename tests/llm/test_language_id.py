import random

import numpy as np
from pyspark.sql import functions as F

from foliant.llm.language_id import UNKNOWN, WORDS, Model, fit, held_out, identify

SMALL = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SMALL)
    found = identify(docs, fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert right > 0.97


def test_learns_only_from_the_rest(spark):
    rows = [(i, "aaa bbb", "x") for i in range(60)] + [(100 + i, "ccc ddd", "y") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    third = docs.where(held_out("doc_id")).select("doc_id", F.lit("zzz zzz").alias("text"), F.lit("only-held-out").alias("lang"))
    model = fit(docs.where(~held_out("doc_id")).union(third))
    assert model.langs == ["x", "y"] and "zzz" not in model.words


def test_backoff_and_odd_texts(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join("".join(rnd.choice(s) for _ in range(4)) + end for _ in range(30)), lang) for i in range(80) for s, end, lang in [("abc", "tion", "p") if i % 2 else ("xyz", "heit", "q")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(docs)
    odd = ["unseenabtion", "zzxheit", None, "", "123 $$$", "日本語", "x" * 60_000, "Ab cATION, abction!"]
    langs, score = model.predict(odd)
    assert langs[:5] == ["p", "q", UNKNOWN, UNKNOWN, UNKNOWN] and langs[5] in model.langs and langs[6] == "q" and langs[7] == "p"
    assert (score[2:5] == 0).all() and ((score >= 0) & (score <= 1)).all()


def test_words_come_before_ngrams():
    model = Model(["p", "q"], [("p", 0, "word", 50), ("q", 0, "other", 50), ("q", 4, "word", 500), ("p", 1, "a", 1)])
    assert model.predict(["word", "words"])[0] == ["p", "q"]


def test_carry_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "aaa", "x", 5), (1, "aaa", "x", 5), (None, "aaa", None, 5), (2, None, "x", 5)], "doc_id long, text string, lang string, score int")
    rows = identify(docs, fit(docs), carry=True).collect()
    assert len(rows) == 4 and set(rows[0].asDict()) == {"doc_id", "text", "lang", "held_out", "lang_pred", "score"}
    none = docs.where("false")
    assert identify(none, fit(none)).count() == 0
    assert {r["lang_pred"] for r in identify(docs, fit(none)).collect()} == {UNKNOWN}


def test_what_a_letter_is():
    model = Model(["p", "q"], [("p", 0, "word", 50), ("q", 0, "other", 50), ("p", 1, "a", 1)])
    langs, score = model.predict(["²", "½ ¼", "1²3 _ !", "ⅷ Ⅻ", "é", "́", "नमस्ते"])
    assert langs[:4] == [UNKNOWN] * 4 and (score[:4] == 0).all()
    assert langs[4] in model.langs and langs[5] == UNKNOWN and langs[6] in model.langs
    assert WORDS.findall("नमस्ते cafés x²y") == ["नमस्ते", "cafés", "x", "y"]


def test_packed_grams_and_single_words_agree():
    rnd = random.Random(2)
    grams = {"".join(rnd.choice("^abcdé$") for _ in range(n)) for n in (1, 1, 2, 3, 4, 5) for _ in range(30)}
    model = Model(["p", "q"], [(x, len(g), g, rnd.randint(1, 9)) for g in sorted(grams) for x in "pq"])
    words = ["", "x", "日本", "a", *{"".join(rnd.choice("abcdéz") for _ in range(rnd.randint(1, 9))) for _ in range(500)}]
    assert np.allclose(model._guess(words), model._guess_each(words), atol=1e-5)
    wide = Model(["p"], [("p", 2, chr(0x4E00 + i) + chr(0x5000 + i), 2) for i in range(5_000)])
    assert wide._packed() is None and wide.predict(["一倀"])[0] == ["p"]
    assert Model(["p"], [])._guess(["abc"]).tolist() == [[0.0]]


def test_ties():
    model = Model(["p", "q"], [("p", 0, "same", 5), ("q", 0, "same", 5), ("p", 2, "ab", 9), ("q", 2, "cd", 9)])
    assert model.predict(["same", "zzz"])[0] == ["p", "p"]


def test_model_counts_all_words_of_the_sample(spark):
    docs = spark.createDataFrame([(i, "uno dos" if i % 2 else "one two one", "es" if i % 2 else "en") for i in range(90)], "doc_id long, text string, lang string").repartition(7)
    model = fit(docs, least_count=1)
    assert set(model.words) == {"uno", "dos", "one", "two"} and {"^on", "one$", "^o", "o"} <= set(model.grams)
