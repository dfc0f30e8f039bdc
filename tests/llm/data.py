"""Small inputs that every operator has to take."""

import random

ODD = ["", None, " ", "  a  b ", "a\nb\tc\r\n", "<|endoftext|> a<|endoftext|>  b \n<|endoftext|>x", "\u0000áé ﬁ　x", "a\x1cb c\x85d  e", "İstanbul ΣΑΣ Σ ́x", "x" * 70 + " " + "y\n" * 50, " lead", "trail ", "▁x ▁", "it's don't we'll", "日本語 テスト 😀"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n string, uid string, h string, part string, bands string"


def texts(n=60, seed=3):
    r = random.Random(seed)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(1, 9))) for _ in range(300)]
    out = [" ".join(r.choices(words, k=r.randint(1, 120))) for _ in range(n)]
    long = " ".join(r.choices(words, k=6000))
    near = out[0].split(" ") + r.choices(words, k=80)
    return [*ODD, *out, out[3], out[3], out[4] + " ", long, "q" * 30_000, " ".join(near), " ".join([*near[:-1], "zzz"]), long[:9000] + " tail"]


def frame(spark, rows=None):
    """Texts as documents, with repeated rows, a null id and columns whose names the operators use themselves."""
    if rows is None:
        rows = list(enumerate(texts()))
        rows += [rows[20], (None, "a row without an id"), (None, None)]
    return spark.createDataFrame([(i, t, None, "src0", len(t) if t is not None else None, "x", "x", "x", "x", "x") for i, t in rows], SCHEMA).repartition(5), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
