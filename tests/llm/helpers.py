"""Small tables with what goes wrong: nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, pos int, copies string, row int, score string, g int, fp string, sub string, label string, values string"


def rows(seed=0, n=60):
    dice = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Epsilon,", "zeta.", "éta", "theta", "iota", "kappa"]
    phrase = " ".join(dice.choice(words) for _ in range(50))
    out = []
    for i in range(n):
        text = " ".join(dice.choice(words) + str(dice.randrange(40)) for _ in range(dice.randrange(1, 90)))
        if i % 5 == 0:
            text += "\n" + phrase + " " + text
        out.append((i * 3, text, "en", f"s{i % 4}", len(text)))
    out += [(1000, out[0][1], "en", "s0", 1), (1001, out[0][1], None, "s1", 2), (1002, out[1][1].upper(), "en", None, 3)]
    out += [(1003, "", "en", "s0", 0), (1004, None, None, None, None), (1005, " \t\n ", "en", "s2", 4), (None, phrase, "en", "s0", 5), (None, None, None, "s0", None), (-7, "one two", "en", "s3", 7)]
    out += [(2000, "x " * 3000 + phrase, "en", "s1", 9), (2001, "long " + "word" * 2000 + " " + phrase, "en", "s1", 9)]
    out += [(3000, "the same row " + phrase, "en", "s2", 1)] * 5 + [(3001, "a a a " * 13, "en", "s2", 1), (3002, "b " * 36 + "c", "en", "s2", 1)]
    return out


def docs(spark, data=None):
    data = rows() if data is None else data
    return spark.createDataFrame([(*r, "x", 1, "y", 2, "z", 3, "f", "s", "l", "v") for r in data], SCHEMA)


def same_rows(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))
