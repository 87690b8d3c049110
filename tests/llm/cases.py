"""Odd rows that every operator must take: nulls, empty and long texts, repeated rows, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, score string, component long, rest string, key string"
PROSE = "The quick brown fox jumps over the lazy dog near the quiet river bank while seven birds sing above."


def odd_rows():
    rng = random.Random(9)
    long = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(20_000))
    texts = {1: PROSE, 2: PROSE, 3: PROSE.upper(), 4: "", 5: None, 6: "   \n\t ", 7: "12345 ... 678", 8: "é ü ß 中文 😀 \x00 end", 9: long, 10: long[1000:], 11: "a", 12: "Der schnelle braune Fuchs springt über den faulen Hund und die Vögel singen."}
    rows = [(i, t, "en" if i < 12 else "de", None, len(t or ""), 99, "x", "y", 7, "z", "k") for i, t in texts.items()]
    return [*rows, rows[0], (1, "another text of the same id", None, None, None, None, None, None, None, None, None), (None, PROSE, "en", "s", 1, 1, None, None, None, None, None)]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
