"""Awkward rows that every operator on documents must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, word int, stratum double, length string"

TEXTS = [
    None,
    "",
    " \t\n ",
    "word",
    "two words",
    "the cat sat on the mat and the cat sat on the mat again " * 12,
    "the cat sat on the mat and the cat sat on the mat again " * 12,
    "Straße ΑΣ ς İ ﬁ   \x1c \x85   x́ 日本語 テキスト 🎉🎉 'S it's I'LL 12345 <|endoftext|> ###\n\n\n  end",
    "a\nb\na\nb\n\n \n",
    "x" * 5000,
    "ab " * 4000,
    "All rights reserved.\nReleased under the MIT License.",
]


def rows(texts=TEXTS):
    return [(i, x, "en" if i % 2 else None, "src", len(x or ""), "clash", 1, 0.5, "clash") for i, x in enumerate(texts)]


def documents(spark, texts=TEXTS):
    return spark.createDataFrame(rows(texts) + rows(texts)[-1:], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
