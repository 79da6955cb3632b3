"""Table layouts, stated once and never inferred from files."""

from pyspark.sql import types as T

MESSAGES = T.StructType(
    [
        T.StructField("tweet_id", T.LongType()),
        T.StructField("author_id", T.StringType()),
        T.StructField("inbound", T.BooleanType()),
        T.StructField("text", T.StringType()),
        T.StructField("response_tweet_id", T.StringType()),
        T.StructField("in_response_to_tweet_id", T.LongType()),
    ]
)

SAMPLES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("sender", T.ArrayType(T.StringType())),
        T.StructField("tweets", T.ArrayType(T.StringType())),
        T.StructField("response", T.StringType()),
        T.StructField("author_id", T.StringType()),
    ]
)

# Chain files hold comma lists, one message id and one sender per turn.
CHAIN_FILE = T.StructType(
    [
        T.StructField("sender", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("response", T.LongType()),
        T.StructField("author_id", T.StringType()),
        T.StructField("id", T.StringType()),
    ]
)

AUTHORS = T.StructType(
    [T.StructField("author_id", T.StringType()), T.StructField("code", T.IntegerType())]
)

VOCABULARY = T.StructType(
    [T.StructField("subword", T.StringType()), T.StructField("id", T.IntegerType())]
)

EMBEDDINGS = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
    ]
)
