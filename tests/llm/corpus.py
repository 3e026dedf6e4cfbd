"""Small corpora with the awkward cases: nulls, empty and long texts, copies, clashing columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use inside
        T.StructField("id", T.StringType()),
        T.StructField("part", T.StringType()),
        T.StructField("k", T.StringType()),
        T.StructField("row", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("block", T.StringType()),
    ]
)
EN = "the of and that with from this was for are not but had they which one you were all her".split()
FR = "le la les des une est dans pour que qui sur avec pas plus son ses être été même tout".split()


def sentence(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "ing" if words is EN else "ement"]) for _ in range(n))


def rows(seed=1, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang, words = (("en", EN), ("fr", FR))[i % 3 == 0]
        lines = [sentence(rng, words, rng.randrange(4, 30)) for _ in range(rng.randrange(1, 6))]
        out.append((i, "\n".join(lines), lang, f"s{i % 4}" if i % 5 else "hot"))
    base = sentence(rng, EN, 120)
    for j in range(6):  # near copies
        w = base.split()
        w[10 * j] = f"changed{j}"
        out.append((100 + j, " ".join(w), "en", "hot"))
    out += [(110, base, "en", "hot"), (111, base.upper(), "en", "hot"), (112, base, "en", "hot")]
    out += [(120, None, "en", "s1"), (121, "", "fr", None), (122, " \n\t ", None, "s1"), (123, "12345 !!", "en", ""), (124, "one", "en", "s2"), (125, "Two words", None, "s2")]
    out += [(130, sentence(rng, EN, 6000), "en", "hot"), (131, "x" * 5000, "en", "s3"), (132, "é ß  ok　wide  gap", "fr", "s3")]
    out += [(-5, "negative ids are ids too " * 8, "en", "s3"), (2**62, "and large ones " * 12, "en", "s3")]
    return out


def documents(spark, seed=1, n=60, extra=()):
    data = [(i, t, la, s, None if t is None else len(t), "x", "y", "z", "r", "q", "b") for i, t, la, s in [*rows(seed, n), *extra]]
    return spark.createDataFrame(data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
