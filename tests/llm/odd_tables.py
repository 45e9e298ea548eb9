"""Tables with nulls, repeated rows, empty and very long texts and clashing column names."""

import random

LONG = " ".join(random.Random(3).choice(["lorem", "ipsum", "dolor", "sit", "amet,", "consectetur", "é中😀", "x" * 40])
                + str(random.Random(i).randrange(500)) for i in range(12_000))
ROWS = [
    (1, "one two three four five six seven.", "en", "a"),
    (1, "one two three four five six seven.", "en", "a"),
    (2, "one two three four five six seven.", "en", "b"),
    (None, "a text without a number", "en", None),
    (None, None, None, None),
    (3, None, "de", "a"),
    (4, "", "de", "a"),
    (5, " \n\t  \x0b", "de", "a"),
    (6, LONG, None, "a"),
    (7, LONG + " end", None, "a"),
    (8, "Ünïcödé 中文 \U0001f600 naïve space  two\r\nlines <|endoftext|>", "fr", "b"),
    (-9, "I'm 12 years; they'll say 'no'!\n\n  indented", "fr", "b"),
]
# Names that the operators use inside.
CLASHING = ["rid", "key", "name", "score", "n", "word", "piece", "length", "ids", "kept", "g", "level", "rate", "salt"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def odd_documents(spark):
    return spark.createDataFrame(
        [(*r, len(r[1] or ""), *(f"{c}{i}" for c in CLASHING)) for i, r in enumerate(ROWS)], SCHEMA).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
