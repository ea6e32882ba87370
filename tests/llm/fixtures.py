"""Small tables that the tests of the text operators share."""

import numpy as np

DOCS = "doc_id long, text string, source string, lang string, n_chars long, kept string"


def frame(spark, texts, first=0):
    return spark.createDataFrame([(None if t == "NOID" else i + first, t, None if i % 5 == 4 else f"s{i % 3}", "en", len(t or ""), "x") for i, t in enumerate(texts)], DOCS)


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega", "theta", "kappa", "sigma"], n))


EDGES = [None, "", "  \n", "one", "one two three four five", "one two three four five", "NOID"]

#: Extra columns with the names that operators use themselves, and their values.
CLASHES = {c: f"own {c}" for c in ("size", "source_size", "target", "times", "key", "full", "cut_key", "part", "score", "seen", "base", "spans", "found", "ids", "kept", "d", "h", "mark", "copy", "node", "k", "n")}


def clashing(spark, texts):
    """frame() with a column for each of CLASHES."""
    from pyspark.sql import functions as F

    return frame(spark, texts).drop("kept").select("*", *[F.lit(v).alias(c) for c, v in CLASHES.items()])
