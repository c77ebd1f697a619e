"""A small documents table with every odd case, and an empty one; extra columns have names that operators use themselves."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, kept boolean, row string, size bigint, rank int, key string"
LONG = " ".join(f"word{k % 977} other{k % 13}" for k in range(30_000))
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog again and again until it rests for the night", "a"),
    (2, "the quick brown fox jumps over the lazy dog again and again until it rests for the night", "a"),
    (3, "The Quick brown fox jumps over the lazy dog again and again until it rests for the night now", "b"),
    (4, None, "a"),
    (5, "", None),
    (6, "   \n\t ", "b"),
    (7, "one two", "b"),
    (8, "One  two", "c"),
    (9, LONG, "c"),
    (10, LONG, "c"),
    (11, "x" * 30_000, "a"),
    (12, "mail bob.k@mail1.example.com or +1 (017) 555-7713 from 10.0.0.300 and 10.0.0.30 card 4111 1111 1111 1111", "a"),
    (13, "line\nline\nline\nanother line with words\n#### $$$$ %%%% &&&&", "a"),
    (13, "line\nline\nline\nanother line with words\n#### $$$$ %%%% &&&&", "a"),
    (None, "a document without any id but with enough words to pass all rules of quality", "a"),
    (15, "naïve café 中文字符 😀 <|endoftext|> it's 12³ é", None),
]


def documents(spark):
    rows = [(i, t, "en", s, None if t is None else len(t), 7, True, "r", 3, 1, "k") for i, t, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
