import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows, extra=""):
    """Documents from (doc_id, text[, lang[, source]]); ``extra`` adds columns of these names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", len(r[1]) if r[1] is not None else None) for r in rows]
    names = extra.split()
    return spark.createDataFrame([(*r, *(f"x{i}" for i in range(len(names)))) for r in full], ", ".join([SCHEMA, *(f"`{n}` string" for n in names)]))


class Words:
    def __init__(self, seed=0, size=400):
        self.r = random.Random(seed)
        self.vocabulary = ["".join(self.r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(self.r.randint(2, 9))) for _ in range(size)]

    def text(self, n):
        return " ".join(self.r.choice(self.vocabulary) for _ in range(n))


def edge_rows():
    long = "word " * 30000
    return [(1, None), (2, ""), (3, "  \n\t \n"), (4, "x"), (5, long), (5, long), (None, "some text without an id here"), (6, "ünï çødé — 漢字 🎉 ok"), (7, None, None, None), (8, "tie " * 80), (9, "tie " * 80)]
