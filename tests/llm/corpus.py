"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp string"


def words(rng, n, kind="en"):
    parts = {"en": "th he in er an re on at en nd".split(), "fr": "eau que les oi ou é è ai tre ion".split()}[kind]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(spark, rows=60, seed=3):
    """Documents with columns of names that operators use themselves."""
    rng = random.Random(seed)
    texts = []
    for i in range(rows):
        kind = "fr" if i % 3 == 0 else "en"
        texts.append((words(rng, rng.randint(1, 120), kind).capitalize() + ".", kind))
    texts += [texts[1], texts[1], (texts[2][0] + " and", texts[2][1]), ("", "en"), ("  \n\t ", "en"), (None, "fr"), ("12 + 34 !!", None), ("é", "fr")]
    texts += [(words(rng, 4000), "en"), ("x" * 5000, None), ("Ünïcode ТЕКСТ 漢字 \x00\x1f end", "en")]
    data = [(i, t, k, "src", len(t or ""), 0.5, "own") for i, (t, k) in enumerate(texts)]
    data += [data[4], data[4], (None, texts[5][0], "en", None, None, None, None), (None, None, None, None, None, None, None)]
    data.append((7, "another text under an id that is taken", "en", None, None, None, None))
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return df.collect()


def colliding(spark, size, n=2):
    """Texts of ``size`` characters, no two alike, that agree in Spark's 32-bit hash."""
    from pyspark.sql import functions as F

    own = F.concat(F.lit("Text "), F.rpad(F.sha2(F.col("id").cast("string"), 512), size - 6, F.sha2(F.col("id").cast("string"), 256)), F.lit("."))
    made = spark.range(400_000).select("id", own.alias("text")).withColumn("hash", F.hash("text", F.lit("tie")))
    twins = made.groupBy("hash").agg(F.sort_array(F.collect_list("text")).alias("texts")).where(F.size("texts") >= n)
    return twins.orderBy("hash").first().texts[:n]
