"""The simple word tokenizer: vocabulary, encoding and statistics as DataFrames; and models of the SentencePiece library."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from textquarry.functions import text as T

#: Ids of the special tokens.
SPECIAL = {"<pad>": 0, "<unk>": 1, "<bos>": 2, "<eos>": 3}


class Tokenizer(Protocol):
    def tokenize(self, text: Column) -> Column: ...

    def encode(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame: ...


class SimpleTokenizer:
    """Words and signs in lower case; the vocabulary is a small DataFrame (token, id)."""

    def __init__(self, vocab_size: int = 32000, vocabulary: DataFrame | None = None):
        self.vocab_size, self.vocabulary = vocab_size, vocabulary

    def tokenize(self, text: Column) -> Column:
        return T.tokens(text)

    def token_counts(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        return df.select(F.explode(self.tokenize(F.col(text_col))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))

    def train(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """The most frequent tokens, ids from 4 on; equal counts in the order of the tokens."""
        spark = df.sparkSession
        top = self.token_counts(df, text_col).orderBy(F.desc("n"), "token").limit(max(0, self.vocab_size - len(SPECIAL)))
        ids = top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "token")) + (len(SPECIAL) - 1))  # vocab_size rows at most
        special = spark.createDataFrame([(t, 0, i) for t, i in SPECIAL.items()], "token string, n long, id int")
        self.vocabulary = special.unionByName(ids).select("token", "n", F.col("id").cast("long").alias("id"))
        return self.vocabulary

    def encode(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, ids): unknown tokens have id 1; the vocabulary, of vocab_size rows, is broadcast as a map."""
        if self.vocabulary is None:
            raise ValueError("the tokenizer has no vocabulary; train or load one first")
        known = df.sparkSession.sparkContext.broadcast({r.token: r.id for r in self.vocabulary.select("token", "id").collect()})

        @F.pandas_udf(ArrayType(LongType()))
        def ids(tokens: pd.Series) -> pd.Series:
            get = known.value.get
            return tokens.map(lambda ts: [get(t, SPECIAL["<unk>"]) for t in ts], na_action="ignore")

        return df.select(id_col, ids(self.tokenize(F.col(text_col))).alias("ids"))

    def decode(self, df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
        """(id, text): tokens joined by blanks; ids outside the vocabulary become <unk>."""
        known = df.sparkSession.sparkContext.broadcast({r.id: r.token for r in self.vocabulary.select("token", "id").collect()})

        @F.pandas_udf(StringType())
        def texts(ids: pd.Series) -> pd.Series:
            get = known.value.get
            return ids.map(lambda xs: " ".join(get(x, "<unk>") for x in xs), na_action="ignore")

        return df.select(id_col, texts(ids_col).alias("text"))

    def save(self, path: str) -> None:
        self.vocabulary.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SimpleTokenizer:
        vocabulary = spark.read.parquet(path)
        return cls(vocabulary.count(), vocabulary)


class SentencePieceTokenizer:
    """An existing SentencePiece model file, shipped to the executors; models are not trained here."""

    def __init__(self, model_path: str):
        self.model_path = model_path

    def encode(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        with open(self.model_path, "rb") as f:
            model = df.sparkSession.sparkContext.broadcast(f.read())
        cache: dict[int, object] = {}

        @F.pandas_udf(ArrayType(LongType()))
        def ids(texts: pd.Series) -> pd.Series:
            import sentencepiece

            if 0 not in cache:
                cache[0] = sentencepiece.SentencePieceProcessor(model_proto=model.value)
            return texts.map(lambda t: cache[0].encode(t), na_action="ignore")

        return df.select(id_col, ids(text_col).alias("ids"))


def create_tokenizer(kind: str, **options) -> SimpleTokenizer | SentencePieceTokenizer:
    kinds = {"simple": SimpleTokenizer, "sentencepiece": SentencePieceTokenizer}
    if kind not in kinds:
        raise ValueError(f"unknown tokenizer: {kind}")
    return kinds[kind](**options)


def process(df: DataFrame, tokenizer: SimpleTokenizer, max_length: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens, num_tokens, truncated) of every text; num_tokens is counted after the cut to max_length."""
    base = df.filter(F.col(text_col).isNotNull()).select(id_col, tokenizer.tokenize(F.col(text_col)).alias("all"))
    cut = F.slice("all", 1, max_length) if max_length else F.col("all")
    return base.select(id_col, cut.alias("tokens"), T.count(cut).alias("num_tokens"), (F.size("all") > F.size(cut)).alias("truncated"))


def statistics(processed: DataFrame) -> DataFrame:
    """texts, total, average, least and most tokens, texts cut and their share."""
    n = F.count("*")
    return processed.agg(
        n.alias("texts"), F.coalesce(F.sum("num_tokens"), F.lit(0)).cast("long").alias("total_tokens"), F.coalesce(F.avg("num_tokens"), F.lit(0.0)).alias("avg_tokens"),
        F.min("num_tokens").alias("min_tokens"), F.max("num_tokens").alias("max_tokens"), F.count_if("truncated").alias("truncated"),
        F.when(n > 0, F.count_if("truncated") / n).otherwise(0.0).alias("truncation_rate"),
    )


def estimate_tokens(df: DataFrame, tokenizer: SimpleTokenizer, sample_size: int = 1000, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Tokens of the whole from the mean over a seeded sample; an estimate by definition, ``statistics`` counts all."""
    texts = df.filter(F.col(text_col).isNotNull())
    some = texts.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(sample_size)
    mean = some.agg(F.avg(F.size(tokenizer.tokenize(F.col(text_col))))).first()[0]
    return int((mean or 0.0) * texts.count())
