"""Language identification: naive Bayes over letter trigrams, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import scratch, stored

#: Any three letters in a row, wherever they begin.
GRAM = r"(?=(\p{L}{3}))"


def grams(texts: DataFrame) -> DataFrame:
    """doc_id, gram and its count n in each text (doc_id, text): all runs of three letters, overlapping ones included."""
    found: Column = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(GRAM), F.lit(1))
    return texts.select("doc_id", F.explode(found).alias("gram")).groupBy("doc_id", "gram").agg(F.count("*").alias("n"))


def train(texts: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """code, gram and weight (log probability, add-one) from labelled texts (doc_id, text, lang); each language's
    weight for unseen grams is its row with a null gram. `own` is grams(texts) where that is stored already."""
    labelled = texts.filter(F.col("lang").isNotNull()).select("doc_id", "lang")
    own = grams(texts) if own is None else own
    folder = scratch(texts.sparkSession)
    counts = stored(own.join(labelled, "doc_id").groupBy(F.col("lang").alias("code"), "gram").agg(F.sum("n").alias("n")), folder, "counts")
    size = counts.select("gram").distinct().agg(F.count("*").alias("v"))
    totals = counts.groupBy("code").agg(F.sum("n").alias("total")).crossJoin(size)  # one row on the right
    known = counts.join(F.broadcast(totals), "code").select("code", "gram", F.log((F.col("n") + 1) / (F.col("total") + F.col("v"))).alias("weight"))
    unseen = totals.select("code", F.lit(None).cast("string").alias("gram"), F.log(1 / (F.col("total") + F.col("v"))).alias("weight"))
    return stored(known.unionByName(unseen), folder, "model")


def classify(texts: DataFrame, model: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """doc_id, code and confidence (normalised probability) of the likeliest language of each text; one without three letters in a row
    has no code and confidence 0. Of equally likely languages the last by name is taken."""
    floors = [(r.code, r.weight) for r in model.filter("gram IS NULL").select("code", "weight").orderBy("code").collect()]  # a row for each language
    if not floors:
        return texts.select("doc_id", F.lit(None).cast("string").alias("code"), F.lit(0.0).alias("confidence"))
    own = grams(texts) if own is None else own
    # A row for each gram, with what it adds for each language; a text's scores are then sums of one aggregate.
    by_gram = model.filter("gram IS NOT NULL").groupBy("gram").agg(*[F.sum(F.when(F.col("code") == c, F.col("weight") - w)).alias(f"gain{i}") for i, (c, w) in enumerate(floors)])
    gains = [F.sum(F.col("n") * F.coalesce(f"gain{i}", F.lit(0.0))) for i in range(len(floors))]
    sums = own.join(by_gram, "gram", "left").groupBy("doc_id").agg(F.sum("n").alias("total"), *[g.alias(f"sum{i}") for i, g in enumerate(gains)])
    scores = F.array(*[F.struct((F.col("total") * w + F.col(f"sum{i}")).alias("score"), F.lit(c).alias("code")) for i, (c, w) in enumerate(floors)])
    best = sums.withColumn("scores", scores).withColumn("best", F.array_max("scores"))
    share = F.aggregate("scores", F.lit(0.0), lambda done, x: done + F.exp(x["score"] - F.col("best.score")))
    best = best.select("doc_id", F.col("best.code").alias("code"), (1 / share).alias("confidence"))
    return texts.select("doc_id").join(best, "doc_id", "left").select("doc_id", "code", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
