import re

ODD = [
    (1, "The quick brown fox jumps over the lazy dog again and again today", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, "   \n\t ", "fr", None),
    (5, "one", "en", "a"),
    (6, "ONE", "en", "a"),
    (7, "two words", None, "a"),
    (8, "The quick brown fox jumps over the lazy dog again and again today", "en", "a"),
    (8, "The quick brown fox jumps over the lazy dog again and again today", "en", "a"),
    (None, "The quick brown fox jumps over the lazy dog again and again TODAY", "en", "a"),
    (10, "12345 67890 !!! ???", "en", "a"),
    (11, "é ü ß 你好 世界 \x1c\x1fodd\x00 a b ‘quote’ <|endoftext|> 's I'm it'll", "de", "a"),
    (12, "word " * 30000, "en", "a"),
    (13, "x" * 100000, "en", "a"),
]


def frame(spark, rows=ODD):
    """documents with columns whose names clash with those of the operators."""
    return spark.createDataFrame(
        [(*r, len(r[1] or ""), 1, "x", "y", "z", 5, 6) for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long, n int, cls string, key string, block string, rank int, label int",
    )


def words(text, lower=False):
    text = text or ""
    if lower:
        text = text.translate({c: c + 32 for c in range(65, 91)})
    return re.findall("[^\x20\x09-\x0d]+", text)
