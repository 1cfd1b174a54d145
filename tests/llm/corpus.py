"""A small corpus with the awkward cases: missing, empty, repeated, very long, similar."""

import random

SCHEMA = "key string, doc_id long, text string, doc string, n_chars long, id string, spans string, lang string, source string"


def words(rng, n, size=400):
    letters = "abcdeéñößfgh"
    return [" ".join([])] and ["".join(rng.choice(letters) for _ in range(2 + rng.randrange(size) % 7)) for _ in range(n)]


def texts(seed=5):
    rng = random.Random(seed)
    passage = " ".join(words(rng, 60))
    base = [" ".join(words(rng, 120)) for _ in range(6)]
    near = base[0].split(" ")
    near[50] = "changed"
    out = [
        None, "", "   \n\t ", "one", "two words", "ends here\n", "\n\nstarts late",
        base[0], base[0], base[0].upper(), " ".join(near), base[1] + "\n" + passage, passage + "\n" + base[2],
        base[3] + " " + passage + " " + base[4], "ab " * 90, ("la " * 36).strip(), ("la " * 35).strip(), "la " * 34,
        "The quick brown fox\njumps over the lazy dog today\nand runs away", "The quick brown fox\nit jumps over the lazy dog today\nand sleeps",
        "dog lazy the over jumps today\nThe quick brown fox", "tab\tand\x0bvertical\x0cfeed\rreturn hard wide",
        " ".join(words(rng, 6000)), "x" * 5000 + " " + "y" * 3000, base[5] + "\n" + base[5],
    ]
    return out


def rows():
    found = [("k", i * 3, t, "d", 1, "i", "s", "en", "src0") for i, t in enumerate(texts())]
    found.append(found[7])  # a repeated row
    found += [("k", None, texts()[7], None, None, None, None, None, None), ("k", None, None, None, None, None, None, None, None)]
    return found


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
