"""Small tables with the awkward cases that every operator has to take."""
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or put out.
CLASH = ("h1", "id", "t", "th", "row", "node", "kept", "n_lines", "kept_text", "pos", "domain", "mix_times", "lang_pred", "_c0", "label")


def table(spark, rows, clash=False, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    if clash:
        from pyspark.sql import functions as F
        df = df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH if c not in df.columns])
    return df


def awkward(seed=1, n=60):
    """Documents of shared lines, near copies, nulls, blanks, repeated rows and one long text."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    line = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    common, out = ["All rights Reserved", "  Menu\t", "x"], []
    for i in range(n):
        body = [line(r.randint(3, 30)) for _ in range(r.randint(1, 6))] + r.sample(common, r.randint(0, 3))
        r.shuffle(body)
        out.append((i, "\n".join(body), r.choice(["en", "de", None]), r.choice(["a", "a", "b", None]), 5))
    for i in range(n, n + 20):  # near copies of the first texts
        words = out[i % 7][1].split(" ")
        words[r.randrange(len(words))] = "changed"
        out.append((i, " ".join(words), "en", "a", 5))
    out += [(n + 20, out[3][1], "en", "b", 5), (n + 21, None, None, None, None), (n + 22, "", "en", "a", 0), (n + 23, " \n\t\n", "en", "a", 4),
            (n + 24, "one Two", "en", "a", 7), (n + 25, "One two", "de", "a", 7), (None, "no id here at all\nmenu", "en", None, 1),
            (n + 26, "\n".join(line(10) for _ in range(3000)), "en", "a", 9), (n + 27, "É É x É y " * 6, "fr", "c", 9)]
    return out + [out[5], out[5], (None, None, None, None, None), (None, None, None, None, None)]
