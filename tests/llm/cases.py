"""Documents with everything that may go wrong, and small plain helpers."""

import random

import string

# Column names that the operators use inside.
CLASHING = ("score", "row", "node", "key", "digest", "line", "size", "range", "count", "at", "term", "n", "_row", "_toxicity")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
WORDS = ["alpha", "beta", "gamma", "delta", "été", "MIT", "license", "zeta", "eta", "theta", "iota", "kappa", "x", "12"]
_FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def fold(text):
    return (text or "").translate(_FOLD)


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


def texts(seed=1):
    """Plain, empty, blank, null, very long, repeated, nearly repeated and odd texts."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(1, 60)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20 + i, t) for i, t in enumerate(base[:5])]  # exact copies
    rows += [(130 + i, t.replace("alpha", "omega", 1)) for i, t in enumerate(base)]  # near copies
    rows += [(40, None), (41, ""), (42, " \n\t "), (43, "Word"), (44, "  " + base[0].upper() + "  \n"), (45, "\x00é  \U0001F600 a-b")]
    rows += [(46, sentence(rng, 15_000)), (46, "other text under the same id"), (47, base[3]), (47, base[3]), (None, base[4]), (None, None), (None, "alone without id")]
    return rows


def frame(spark, rows, parts=3):
    data = [(doc_id, text, None, "hot", None, *["?"] * len(CLASHING)) for doc_id, text in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(parts) if data else spark.createDataFrame([], SCHEMA)


def written(spark, rows, folder, name="documents"):
    path = f"file://{folder}/{name}.parquet"
    frame(spark, rows).write.parquet(path)
    return spark.read.parquet(path)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
