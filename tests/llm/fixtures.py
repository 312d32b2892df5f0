"""Small documents with every odd case, and a plain copy of them for brute force."""

import random

from pyspark.sql import functions as F

WORDS = "the of and to in is that for with was on by this are from it as be at alpha beta gamma delta epsilon zeta eta theta".split()
LICENCE = "Licensed to whom it may concern under public terms."


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice(["", "", "", ".", ","])) for _ in range(n))


def documents(spark, plain=False):
    """(doc_id, text, lang, source, n_chars) and extra columns whose names operators might want for themselves."""
    base = prose(1, 300)
    near = base.replace("alpha", "omega", 2)
    rows = [
        (1, base), (2, base), (3, near), (4, base + " " + prose(2, 5)),
        (5, None), (6, ""), (7, " \n\t\x0b"), (8, "one"), (9, "Two words"), (10, "two WORDS"),
        (11, "x" * 30_000), (12, prose(3, 20_000)), (13, "\n".join([LICENCE, prose(4, 80)])),
        (14, "\n".join([prose(5, 80), " " + LICENCE.upper() + "\t", LICENCE])), (15, "\n".join([LICENCE, "", prose(6, 80), ""])),
        (16, "Ünïcode Straße é́ \U0001f642 \x00 \x1c\x85\xa0 <|endoftext|> ." * 20), (17, "word " * 400), (18, "".join(prose(1, 300)[50:900])),
        (2, base), (19, prose(7, 200) + "\n" + prose(1, 300)[200:700] + "\n" + prose(8, 60)), (None, base), (None, None), (20, "é" * 40 + "aé" * 40), (21, "è" * 40 + "aé" * 40),
    ]
    if plain:
        return rows
    df = spark.createDataFrame([(i, t, "en" if i and i % 2 else None, "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    names = ("key", "node", "shard", "text_hash", "spans", "_kept_id", "_gone", "bands", "length", "bucket")
    return df.select("*", *[F.lit(0).alias(n) for n in names])


def empty(spark):
    return documents(spark).limit(0)
