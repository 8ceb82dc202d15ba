"""Text classifier: hashed word and character n-grams with log TF-IDF into a balanced logistic regression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.functions import text as txt
from lurewatch.session import cut_lineage

C = 4.0
#: Bytes of a row group of counted terms. A reader unpacks a group's rows, 4,096 at most, at once, and counts take five times as much unpacked.
ROW_GROUP = 2 << 20


def prepare(corpus: DataFrame) -> DataFrame:
    """corpus(key, text, label, source): masked, short texts and texts with both labels dropped, one copy kept.

    The copy with the smallest key stays, whatever the order of arrival.
    """
    clean = corpus.withColumn("text", txt.masked(F.col("text"))).where(F.length("text") > 20)
    return clean.groupBy("text").agg(F.min(F.struct("key", "source")).alias("k"), F.min("label").alias("label"), F.max("label").alias("other")).where(
        "label = other").select("k.key", "k.source", "text", "label")


def with_grams(texts: DataFrame) -> DataFrame:
    """Adds words and character 3- to 5-grams inside space-padded words."""
    words = F.regexp_extract_all("text", F.lit(r"(?U)\b\w\w+\b"), 0)
    padded = F.transform(F.split("text", " "), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w):
        size = F.length(w)
        return F.flatten(F.transform(F.array(F.lit(3), F.lit(4), F.lit(5)), lambda n: F.when(size >= n, F.transform(
            F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(w, i, n))).otherwise(F.array().cast("array<string>"))))

    return texts.withColumns({"words": words, "chars": F.flatten(F.transform(padded, grams))})


def terms(bits: int = 18) -> list:
    size = 1 << bits
    return [
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS word_terms FROM __THIS__"),
        HashingTF(inputCol="word_terms", outputCol="word_tf", numFeatures=size),
        HashingTF(inputCol="chars", outputCol="char_tf", numFeatures=size),
    ]


def features() -> list:
    return [
        IDF(inputCol="word_tf", outputCol="word_idf"), IDF(inputCol="char_tf", outputCol="char_idf"),
        Normalizer(inputCol="word_idf", outputCol="word_vec"), Normalizer(inputCol="char_idf", outputCol="char_vec"),
        VectorAssembler(inputCols=["word_vec", "char_vec"], outputCol="features"),
    ]


@dataclass(frozen=True)
class Model:
    """Terms of a text, and what was learned over their counts."""

    counted: PipelineModel
    fitted: PipelineModel


_TERMS = ("words", "chars", "pairs", "word_terms")
_VECTORS = ("word_tf", "char_tf", "word_idf", "char_idf", "word_vec", "char_vec", "features", "rawPrediction", "probability", "prediction")


def term_counts(texts: DataFrame, bits: int = 18) -> tuple[PipelineModel, DataFrame]:
    """The terms of each text, counted once and kept in the shared folder: every step of the training reads them again."""
    grams = with_grams(texts)
    counting = Pipeline(stages=terms(bits)).fit(grams)
    return counting, cut_lineage(counting.transform(grams).drop(*_TERMS), **{"parquet.block.size": str(ROW_GROUP)})


def train(prepared: DataFrame, bits: int = 18) -> Model:
    return train_on(*term_counts(prepared, bits))


def train_on(counting: PipelineModel, counted: DataFrame) -> Model:
    """Both classes get the same total weight."""
    n = counted.groupBy("label").agg(F.count("*").alias("n"))
    sums = {r["label"]: r["n"] for r in n.collect()}  # two rows
    total = sum(sums.values())
    weight = F.when(F.col("label") == 1, total / (2.0 * sums.get(1, 1))).otherwise(total / (2.0 * sums.get(0, 1)))
    regression = LogisticRegression(weightCol="weight", regParam=1.0 / (C * total), elasticNetParam=0.0, maxIter=30)
    rows = counted.select(weight.alias("weight"), F.col("label").cast("double").alias("label"), "word_tf", "char_tf")
    return Model(counting, Pipeline(stages=[*features(), regression]).fit(rows))


def predict(model: Model, texts: DataFrame) -> DataFrame:
    """Adds score, the probability of the positive class."""
    return predict_counted(model, model.counted.transform(with_grams(texts)).drop(*_TERMS))


def predict_counted(model: Model, counted: DataFrame) -> DataFrame:
    return model.fitted.transform(counted).withColumn("score", vector_to_array("probability")[1]).drop(*_VECTORS)
