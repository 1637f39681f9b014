"""Documents with every edge case, and frames of them with extra columns whose names clash with results."""

import random

LONG = " ".join(f"w{k % 997}" for k in range(30_000))
CLASHING = "node long, component_id long, kept boolean, tokens string, score double, spans string, p int, kind int, print long, payload binary, _row string, n_words string, label string"


def texts(seed=1, n=60):
    """Random prose with copies, near copies, shared passages, periodic and empty texts; (doc_id, text)."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.choice([1, 2, 3, 5])))
    vocabulary = [word() for _ in range(150)]
    prose = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, out = prose(60), []
    for k in range(n):
        words = prose(rng.choice([0, 1, 4, 5, 19, 20, 21, 80, 200]))
        if k % 5 == 1 and out:
            words = list(out[rng.randrange(len(out))])
        elif k % 5 == 2 and out:
            words = list(out[rng.randrange(len(out))])
            for _ in range(len(words) // 40):
                words[rng.randrange(len(words))] = word()
        elif k % 5 == 3:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage[: rng.choice([15, 20, 30, 60])]
        out.append(words)
    rows = [(k * 7 % 101, rng.choice([" ", "\n", "  ", "\t"]).join(w)) for k, w in enumerate(out)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "a " * 60), (204, "a " * 60), (205, "x" * 300), (206, "Ab " * 30), (207, "aB " * 30), (208, LONG), (209, LONG + " end")]
    return rows


def frame(spark, rows, extra=True):
    """documents with clashing columns."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if not extra:
        return df
    from pyspark.sql import functions as F

    more = [c.split() for c in CLASHING.split(", ")]
    return df.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), *[F.lit(None).cast(kind).alias(name) for name, kind in more])


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}
