"""Message tables and noisy texts derived from the given tables, as SQL.

The same statement runs on Spark and on DuckDB; the two placeholders are the
engines' names for text and for integer division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ACCOUNTS = ("VirginAmerica", "AmazonHelp", "AppleSupport", "SpotifyCares")

REPLY_GRAPH = """
select event_id as tweet_id,
  case when user_id % 3 = 0 then 'AmazonHelp'
       else concat('u', cast(user_id % 2 as {S})) end as author_id,
  user_id % 3 <> 0 as inbound,
  concat(event_type, ' ', cast({offset} event_id as {S})) as text,
  case when 2*event_id+2 > (select max(event_id) from events) then null
       when event_id % 10 = 0 then concat(cast(2*event_id+1 as {S}), ',',
            cast(2*event_id+2 as {S}), ',', cast(2*event_id+3 as {S}))
       else concat(cast(2*event_id+1 as {S}), ',', cast(2*event_id+2 as {S}))
  end as response_tweet_id,
  case when event_id < 4 then null else (event_id-1) {div} 2 end as in_response_to_tweet_id
from events"""

# The reply graph with handles, phone numbers, signatures and Spanish words.
CHATTY_TEXT = """concat(event_type, ' note ', cast(event_id as {S}),
    case when event_id % 5 = 0 then ' see @AmazonHelp' else '' end,
    case when event_id % 7 = 0 then ' call 800 555 1234' else '' end,
    case when event_id % 13 = 0 then ' En casa' else '' end,
    case when event_id % 3 = 0 then ' ^AB' else '' end)"""
CHATTY_GRAPH = REPLY_GRAPH.replace(
    "concat(event_type, ' ', cast({offset} event_id as {S}))", CHATTY_TEXT
)

LINEAR_GRAPH = """
select conv_id*1000+turn as tweet_id,
  case when role = 'assistant' then 'AmazonHelp'
       else concat(role, cast(conv_id as {S})) end as author_id,
  role <> 'assistant' as inbound,
  text,
  cast(lead(conv_id*1000+turn) over (partition by conv_id order by turn) as {S})
    as response_tweet_id,
  lag(conv_id*1000+turn) over (partition by conv_id order by turn) as in_response_to_tweet_id
from conversations"""

NOISY_TEXTS = """
select doc_id, concat('@', cast(114000+doc_id as {S}), ' ',
  case doc_id % 3 when 0 then '@AmazonHelp ' when 1 then 'call +1 800-555-1234 ' else '' end,
  text, ' https://www.ex-', cast(doc_id as {S}), '.com/p?q=1',
  case when doc_id % 2 = 0 then ' ^AB' else ' - Kim' end) as text
from documents"""

# Two messages of one author (k = 0, 1) answered by one reply (k = 2), which
# is answered in turn (k = 3).
DIAMONDS = """
select event_id as tweet_id,
  case when event_id % 4 < 2 then concat('u', cast(event_id {div} 4 % 7 as {S}))
       when event_id % 4 = 2 then 'AmazonHelp' else 'v' end as author_id,
  event_id % 4 <> 2 as inbound,
  concat(event_type, ' note ', cast(event_id as {S})) as text,
  case when event_id % 4 < 2 then cast(event_id {div} 4 * 4 + 2 as {S})
       when event_id % 4 = 2 then cast(event_id + 1 as {S}) end as response_tweet_id,
  case when event_id % 4 < 2 then null
       when event_id % 4 = 2 then event_id - 2 else event_id - 1 end as in_response_to_tweet_id
from events"""

# Chains of 500 messages, rings of 50, and chains of 450 below each ring.
RINGS = """
select event_id as tweet_id,
  case when event_id % 1000 = 0 then null
       when event_id % 1000 = 500 then event_id + 49
       else event_id - 1 end as in_response_to_tweet_id
from events"""

# Nine of ten messages name one reply, which names the rest.
HUBS = """
select event_id as tweet_id, concat('u', cast(user_id % 5 as {S})) as author_id, true as inbound,
  concat(event_type, ' ', cast(event_id as {S})) as text,
  case when event_id = 1 then '2,3' when event_id < 10 then null
       when event_id % 10 = 0 then cast(event_id + 1 as {S}) else '1' end as response_tweet_id,
  case when event_id < 10 then event_id + 20 when event_id % 10 = 1 then event_id - 1 end
    as in_response_to_tweet_id
from events"""

# Conversation turns with placeholders beside and inside their words.
MARKED_TURNS = """
select conv_id*1000+turn as tweet_id,
  concat(text, case turn % 3 when 0 then ' <url>' when 1 then '<usr> ok' else '' end) as text
from conversations"""

# Messages of few groups, some of them large.
CROWDS = """
select event_type as context, concat('u', cast(user_id % 3 as {S})) as author_id,
  event_id {div} 5000 as next, event_id % 7 as rpos, event_id as tweet_id,
  concat(event_type, ' ', cast(event_id as {S})) as text
from events"""

SCORE_ITEMS = """
select vec_id {div} 64 as batch_id, (vec_id % 64) {div} 2 as slot,
  vec_id % 2 = 0 as is_context, vec_id, embedding
from embeddings"""


def on_spark(template: str, offset: str = "") -> str:
    return template.format(S="string", div="div", offset=offset)


def on_duckdb(template: str, offset: str = "") -> str:
    return template.format(S="varchar", div="//", offset=offset)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, template: str, offset: str = "") -> DataFrame:
    """Run a template over the tables of ``sf_dir``."""
    source = template.rsplit("from ", 1)[1].strip()
    return spark.sql(
        on_spark(template, offset).replace("from " + source, "from {" + source + "}"),
        **{source: table(spark, sf_dir, source)},
    )


def reply_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, REPLY_GRAPH)


def boundary_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts such as ``view 12345`` whose letter share is exactly the bar."""
    return derive(spark, sf_dir, REPLY_GRAPH, "10000 +")


def chatty_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, CHATTY_GRAPH)


def linear_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, LINEAR_GRAPH)


def noisy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, NOISY_TEXTS)


def diamonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, DIAMONDS)


def score_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, SCORE_ITEMS)
