"""Schemas of the tables that pass between the operators."""

from pyspark.sql import types as T

TOKEN = T.StructType(
    [
        T.StructField("raw", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("candidates", T.ArrayType(T.StringType())),
        T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("silent", T.BooleanType()),
        T.StructField("approx", T.BooleanType()),
        T.StructField("note", T.StringType()),
    ]
)
LEXICON = T.StructType(
    [
        T.StructField("word", T.StringType()),
        T.StructField("primary", T.IntegerType()),
        T.StructField("valid", T.ArrayType(T.IntegerType())),
        T.StructField("ambiguous", T.BooleanType()),
        T.StructField("source", T.StringType()),
    ]
)
POST = T.StructType(
    [
        T.StructField("action", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("record", T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("langs", T.ArrayType(T.StringType())), T.StructField("reply", T.StringType())])),
    ]
)
