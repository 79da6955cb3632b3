"""Every registered query: operators over the given tables or data derived from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import fixtures as D
from threadloom import fixed_values as V
from threadloom.functions import arrays as A
from threadloom.functions import text as X
from threadloom.operators import (
    authors,
    cbow,
    embeddings,
    fan_in,
    gates,
    inverted_file,
    metrics,
    mining,
    numbering,
    packing,
    ranking,
    rehydrate,
    reply_chains,
    stats,
    subwords,
    unigram,
    word_encoding,
)
from threadloom.operators.reply_hop import Rules
from threadloom.plans import prepare
from threadloom.session import fresh_path, materialize
from threadloom.sources import files

MERGES = 40
PACK_MERGES = 24
WEIGHTS = [(k % 7 - 3) / 10 for k in range(64)]
Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTERED[f.__name__] = f
    return f


def flat(*columns: str, sep: str = "|") -> list:
    """Array columns as delimited texts."""
    return [F.array_join(F.col(c).cast("array<string>"), sep, "NULL").alias(c) for c in columns]


def sample_columns() -> list:
    return ["id", *flat("sender", "tweets"), "response", "author_id"]


def small_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts found in the reply graph, coded in name order."""
    found = gates.discover_accounts(D.reply_graph(spark, sf_dir))
    known = found.unionByName(spark.createDataFrame([(a,) for a in D.ACCOUNTS], "author_id string"))
    return known.distinct().select(
        "author_id", F.row_number().over(Window.orderBy("author_id")).alias("code")
    )


# --- mining -----------------------------------------------------------------


@query
def mine_conversations(spark, sf_dir):
    return mining.mine(D.reply_graph(spark, sf_dir), gate_english=False).select(*sample_columns())


@query
def mine_stored(spark, sf_dir):
    """The same with replies in sorted buckets, chains never broadcast."""
    rules = Rules(broadcast_bytes=-1, store=True)
    return mining.mine(D.reply_graph(spark, sf_dir), gate_english=False, rules=rules).select(*sample_columns())


@query
def mine_shuffled(spark, sf_dir):
    rules = Rules(broadcast_bytes=-1, hot_rows=1 << 60, hot_bytes=1 << 60)
    return mining.mine(D.reply_graph(spark, sf_dir), gate_english=False, rules=rules).select(*sample_columns())


@query
def mine_salted(spark, sf_dir):
    """Rings of replies with one reply that very many name, joined with a salt."""
    rules = Rules(broadcast_bytes=-1, hot_rows=0)
    return mining.mine(D.derive(spark, sf_dir, D.HUBS), gate_english=False, rules=rules).select(*sample_columns())


@query
def mine_by_ids(spark, sf_dir):
    """The flagship's result with texts attached after the walk."""
    samples = prepare.mine_by_ids(D.reply_graph(spark, sf_dir), gate_english=False)
    return samples.select(*sample_columns())


@query
def mine_gated(spark, sf_dir):
    return mining.mine(D.boundary_graph(spark, sf_dir)).select(*sample_columns())


@query
def mine_linear(spark, sf_dir):
    return mining.mine(D.linear_graph(spark, sf_dir)).select(*sample_columns())


@query
def mine_diamonds(spark, sf_dir):
    return mining.mine(D.diamonds(spark, sf_dir)).select(*sample_columns())


@query
def mining_progress(spark, sf_dir):
    return mining.progress_of(
        mining.mine_levels(D.reply_graph(spark, sf_dir), gate_english=False)
    )


@query
def chains_cut_by_depth(spark, sf_dir):
    levels = mining.mine_levels(D.reply_graph(spark, sf_dir), max_depth=6, gate_english=False)
    return mining.cut_by_depth(levels, 6)


@query
def conversation_roots(spark, sf_dir):
    return gates.roots(D.reply_graph(spark, sf_dir)).select("tweet_id", "author_id", "text")


@query
def open_messages(spark, sf_dir):
    return gates.still_open(D.reply_graph(spark, sf_dir)).select("tweet_id", "response_tweet_id")


@query
def reply_hops(spark, sf_dir):
    """Every reply edge, with both texts: fan-out and join of one level."""
    messages = D.reply_graph(spark, sf_dir)
    edges = gates.still_open(messages).select(
        "author_id",
        "text",
        F.explode(F.split("response_tweet_id", ",").cast("array<bigint>")).alias("reply_id"),
    )
    replies = messages.select(
        F.col("tweet_id").alias("reply_id"),
        F.col("author_id").alias("reply_author"),
        F.col("text").alias("reply_text"),
    )
    hops = edges.join(replies, "reply_id")
    return gates.not_self_response(hops, F.col("author_id"), "reply_author")


@query
def fan_in_merge(spark, sf_dir):
    """Pairs answered by one reply, merged in the empty root context."""
    fans = D.diamonds(spark, sf_dir).filter("in_response_to_tweet_id is null")
    fans = fans.select(
        F.lit("").alias("context"),
        "author_id",
        F.col("response_tweet_id").cast("bigint").alias("next"),
        F.lit(1).alias("rpos"),
        "tweet_id",
        "text",
    )
    merged = fan_in.merge_fans(fans)
    return merged.select("author_id", "next", "rpos", *flat("tweet_ids", sep=","), "text")


@query
def fan_in_parts(spark, sf_dir):
    """Large groups of messages merged in parts of bounded size."""
    parts = numbering.merged_parts(D.derive(spark, sf_dir, D.CROWDS), part=CROWD)
    return parts.select(
        "context", "author_id", "next", "part", "rpos", *flat("tweet_ids", sep=","), "text"
    )


@query
def reply_depths(spark, sf_dir):
    """Roots and depths of chains far longer than any walk goes."""
    return reply_chains.reply_depths(D.derive(spark, sf_dir, D.RINGS))


@query
def reply_cycles(spark, sf_dir):
    return reply_chains.reply_cycles(D.derive(spark, sf_dir, D.RINGS))


def _paths_out(paths: DataFrame) -> DataFrame:
    context = F.array_join(F.transform("context", lambda ids: F.array_join(ids, "+")), ",")
    return paths.select(
        *flat("sender", sep=","), context.alias("context"), "response", "author_id"
    )


@query
def mine_fan_in(spark, sf_dir):
    return _paths_out(fan_in.mine_fan_in(D.reply_graph(spark, sf_dir), gate_english=False))


@query
def mine_fan_in_diamonds(spark, sf_dir):
    return _paths_out(fan_in.mine_fan_in(D.diamonds(spark, sf_dir)))


@query
def rehydrate_paths(spark, sf_dir):
    messages = D.diamonds(spark, sf_dir)
    paths = fan_in.mine_fan_in(messages)
    return rehydrate.rehydrate(paths, messages).select(
        *flat("sender", "tweets"), "response", "author_id"
    )


@query
def context_lookup(spark, sf_dir):
    messages = D.linear_graph(spark, sf_dir)
    paths = _flat_paths(fan_in.mine_fan_in(messages, gate_english=False))
    texts = messages.filter("inbound")
    found = rehydrate.context_texts(paths, texts)
    response = paths.select("id", "response")
    return found.join(response, "id").select("response", "pos", "sender", "tweet_id", "text")


@query
def context_lookup_gaps(spark, sf_dir):
    """Turns of all speakers looked up in a message table that lacks every eleventh message."""
    messages = D.linear_graph(spark, sf_dir)
    paths = _flat_paths(fan_in.mine_fan_in(messages, gate_english=False))
    found = rehydrate.context_texts(paths, messages.filter("tweet_id % 11 <> 0"))
    response = paths.select("id", "response")
    return found.join(response, "id").select("response", "pos", "sender", "tweet_id", "text")


@query
def response_lookup(spark, sf_dir):
    messages = D.linear_graph(spark, sf_dir)
    paths = fan_in.mine_fan_in(messages, gate_english=False)
    return rehydrate.response_texts(paths, messages).select(
        "response", "author_id", "text", "wordcount"
    )


@query
def longest_contexts(spark, sf_dir):
    paths = fan_in.mine_fan_in(D.reply_graph(spark, sf_dir), gate_english=False)
    return rehydrate.by_context_length(paths).select("length", "response", "author_id")


def _flat_paths(paths: DataFrame) -> DataFrame:
    return paths.withColumn("context", F.flatten("context"))


# --- text -------------------------------------------------------------------


def _text_query(name: str, expression) -> None:
    def run(spark, sf_dir):
        return D.noisy_texts(spark, sf_dir).select("doc_id", expression("text").alias("text"))

    run.__name__ = name
    query(run)


_text_query("clean_text", lambda t: X.clean_text(t, D.ACCOUNTS))
_text_query("clean_text_loose", lambda t: X.clean_text(t, D.ACCOUNTS, "loose"))
_text_query("mask_urls", X.mask_urls)
_text_query("mask_phones", X.mask_phones)
_text_query("mask_users", X.mask_users)
_text_query("mask_bots", lambda t: X.mask_bots(t, D.ACCOUNTS))
_text_query("mask_signature", X.mask_signature)
_text_query("mask_signature_loose", lambda t: X.mask_signature(t, "loose"))
_text_query("drop_disallowed", X.drop_disallowed)


@query
def placeholder_split(spark, sf_dir):
    texts = D.noisy_texts(spark, sf_dir)
    cleaned = texts.select("doc_id", X.clean_text("text", D.ACCOUNTS).alias("text"))
    return cleaned.select(
        "doc_id",
        F.array_join(X.text_pieces("text"), "|").alias("pieces"),
        F.array_join(X.placeholder_tokens("text"), "|").alias("tokens"),
    )


@query
def english_gate(spark, sf_dir):
    return D.boundary_graph(spark, sf_dir).select(
        "tweet_id", X.is_english("text").alias("is_english")
    )


@query
def english_documents(spark, sf_dir):
    return gates.keep_english(D.table(spark, sf_dir, "documents")).select("doc_id", "text")


@query
def spanish_gate(spark, sf_dir):
    return gates.reject_spanish(D.table(spark, sf_dir, "documents")).select("doc_id", "text")


@query
def empty_gate(spark, sf_dir):
    """Nothing left after dropping words of ASCII letters and blanks."""
    rest = F.regexp_replace("text", "[A-Za-z .,\n]", "").alias("text")
    return gates.reject_empty(D.table(spark, sf_dir, "documents").select("doc_id", rest))


@query
def none_links(spark, sf_dir):
    return gates.fill_none(D.reply_graph(spark, sf_dir)).select(
        "tweet_id", "response_tweet_id", "in_response_to_tweet_id"
    )


@query
def min_words(spark, sf_dir):
    return gates.min_words(D.linear_graph(spark, sf_dir)).select("tweet_id", "wordcount")


@query
def discover_accounts(spark, sf_dir):
    return gates.discover_accounts(D.linear_graph(spark, sf_dir))


@query
def distinct_authors(spark, sf_dir):
    return authors.distinct_authors(D.linear_graph(spark, sf_dir))


# --- counts and reports -----------------------------------------------------


@query
def row_counts(spark, sf_dir):
    return stats.row_count(gates.keep_english(D.boundary_graph(spark, sf_dir)))


@query
def length_histogram(spark, sf_dir):
    samples = mining.mine(D.reply_graph(spark, sf_dir), gate_english=False)
    return stats.length_histogram(samples).withColumn("log_n", F.round("log_n", 6))


@query
def char_frequency(spark, sf_dir):
    return stats.char_frequency(D.table(spark, sf_dir, "documents"))


@query
def running_lists(spark, sf_dir):
    turns = D.table(spark, sf_dir, "conversations")
    over = (["conv_id"], ["turn"])
    return turns.select(
        "conv_id",
        "turn",
        F.array_join(fan_in.running_list("role", *over), ",").alias("roles"),
        fan_in.running_first("role", *over).alias("first_role"),
    )


@query
def running_parts(spark, sf_dir):
    """Roles of every conversation in order, in lists of three."""
    turns = D.table(spark, sf_dir, "conversations")
    parts = numbering.list_parts(turns, ["conv_id"], ["turn"], ["role"], part=3)
    return parts.select("conv_id", "part", F.array_join("role", ",", " ").alias("roles"))


@query
def top_texts(spark, sf_dir):
    documents = D.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return stats.top_rows(documents, "n_chars", "doc_id", 20)


# --- authors and speakers ---------------------------------------------------


@query
def author_codes(spark, sf_dir):
    messages = D.linear_graph(spark, sf_dir).select("tweet_id", "author_id")
    return authors.encode_authors(messages, small_authors(spark, sf_dir))


@query
def speaker_ids(spark, sf_dir):
    """Speaker class per sample turn, repeated over the turn's words."""
    samples = mining.mine(D.linear_graph(spark, sf_dir), gate_english=False)
    classed = authors.speaker_classes(samples, small_authors(spark, sf_dir))
    turns = F.transform("tweets", lambda t: F.split(t, " "))
    return classed.select(
        "id",
        F.array_join(A.repeat_over_turns("sender_class", turns), "").alias("sender_ids"),
        "author_class",
    )


@query
def speaker_ids_joined(spark, sf_dir):
    """The same rows with a dictionary too long to be compared in place."""
    samples = mining.mine(D.linear_graph(spark, sf_dir), gate_english=False)
    classed = authors.speaker_classes(samples, small_authors(spark, sf_dir), inline=0)
    turns = F.transform("tweets", lambda t: F.split(t, " "))
    return classed.select(
        "id",
        F.array_join(A.repeat_over_turns("sender_class", turns), "").alias("sender_ids"),
        "author_class",
    )


# --- subwords ---------------------------------------------------------------


def _word_table(spark, sf_dir) -> DataFrame:
    return materialize(subwords.word_counts(D.table(spark, sf_dir, "documents")), "words")


@query
def word_counts(spark, sf_dir):
    return subwords.word_counts(D.table(spark, sf_dir, "documents"))


@query
def pair_counts(spark, sf_dir):
    counts = subwords.word_counts(D.table(spark, sf_dir, "documents"))
    return subwords.pair_counts(counts.select(subwords.spaced("word").alias("spaced"), "n"))


@query
def learn_merges(spark, sf_dir):
    return subwords.learn_merges(_word_table(spark, sf_dir), MERGES)


@query
def learn_vocabulary(spark, sf_dir):
    counts = _word_table(spark, sf_dir)
    base = subwords.vocabulary(counts, subwords.learn_merges(counts, MERGES))
    return subwords.with_placeholders(base)


@query
def encode_turns(spark, sf_dir):
    counts = _word_table(spark, sf_dir)
    merges = subwords.learn_merges(counts, MERGES)
    encoder = subwords.TurnEncoder(merges, subwords.vocabulary(counts, merges))
    cleaned = D.noisy_texts(spark, sf_dir).select(
        "doc_id", X.clean_text("text", D.ACCOUNTS).alias("text")
    )
    ids = cleaned.select("doc_id", encoder.encode("text").alias("ids"))
    return ids.select("doc_id", *flat("ids", sep=" "))


def _letters(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Conversation turns as characters, and a vocabulary of document characters."""
    turns = D.linear_graph(spark, sf_dir).select(
        "tweet_id", F.split("text", "").alias("subwords")
    )
    counted = stats.char_frequency(D.table(spark, sf_dir, "documents")).select(
        F.col("character").alias("subword"),
        F.row_number().over(Window.orderBy(F.desc("n"), "character")).alias("id"),
    )
    return turns, counted


@query
def vocab_lookup(spark, sf_dir):
    turns, vocab = _letters(spark, sf_dir)
    found = subwords.lookup_ids(turns, vocab, "tweet_id")
    return found.select("tweet_id", *flat("ids", sep=" "))


@query
def decode_ids(spark, sf_dir):
    turns, vocab = _letters(spark, sf_dir)
    ids = subwords.lookup_ids(turns, vocab, "tweet_id")
    return subwords.decode_ids(ids, vocab, "tweet_id")


SEEDS = 300
LONGEST_SEED = 6
CROWD = 50


def _seeds(spark, sf_dir) -> DataFrame:
    counts = subwords.word_counts(D.derive(spark, sf_dir, D.MARKED_TURNS))
    return unigram.seed_pieces(materialize(counts, "words"), SEEDS, LONGEST_SEED)


@query
def unigram_seeds(spark, sf_dir):
    """Characters and best substrings of the words of all turns."""
    return _seeds(spark, sf_dir)


@query
def learn_unigram(spark, sf_dir):
    """A unigram vocabulary of the usual 8,000 entries, learned from all turns."""
    counts = subwords.word_counts(D.derive(spark, sf_dir, D.MARKED_TURNS))
    return unigram.learn_unigram_vocabulary(materialize(counts, "words"))


def _seed_vocabulary(spark, sf_dir) -> DataFrame:
    """Seeds with the scores that learning starts from."""
    seeds = materialize(_seeds(spark, sf_dir), "seeds")
    total = seeds.agg(F.sum("gain").alias("total"))
    score = F.round(F.log(F.col("gain") / F.col("total")) * unigram.MICRO).cast("long")
    pieces = seeds.crossJoin(F.broadcast(total)).select("piece", score.alias("score"))
    return materialize(unigram.unigram_vocabulary(pieces), "vocabulary")


@query
def unigram_vocabulary(spark, sf_dir):
    return _seed_vocabulary(spark, sf_dir)


def _digits(spark, sf_dir) -> DataFrame:
    turns = D.derive(spark, sf_dir, D.MARKED_TURNS)
    return word_encoding.digit_sentences(turns, _seed_vocabulary(spark, sf_dir), "tweet_id")


@query
def digit_sentences(spark, sf_dir):
    """Raw turns as digit strings of their best segmentations."""
    return _digits(spark, sf_dir).select("tweet_id", *flat("sentence", sep=" "))


@query
def noise_table(spark, sf_dir):
    """How likely each word length of all turns is drawn as noise."""
    counts = cbow.token_counts(_turn_sizes(spark, sf_dir), "ids")
    return rounded(cbow.noise_table(counts), "share", digits=9)


@query
def cbow_vectors(spark, sf_dir):
    """Vectors trained on the digit sentences of all turns, all numbers of a vector as text."""
    sentences = materialize(_digits(spark, sf_dir).select("sentence"), "digits")
    found = cbow.train_cbow(sentences, settings=cbow.Settings(dim=16, epochs=2))
    return found.select("token", "n", *flat("vector", sep=" "))


# --- packing ----------------------------------------------------------------


def _turn_sizes(spark, sf_dir) -> DataFrame:
    """Word lengths of every conversation turn, as an array of small numbers."""
    return D.linear_graph(spark, sf_dir).select(
        "tweet_id", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("ids")
    )


@query
def left_pad(spark, sf_dir):
    padded = _turn_sizes(spark, sf_dir).withColumn("padded", A.left_pad("ids", 16))
    return padded.select("tweet_id", *flat("padded", sep=","))


@query
def padding_mask(spark, sf_dir):
    padded = _turn_sizes(spark, sf_dir).withColumn("mask", A.padding_mask(A.left_pad("ids", 16)))
    return padded.select("tweet_id", *flat("mask", sep=""))


@query
def valid_samples(spark, sf_dir):
    samples = mining.mine(D.chatty_graph(spark, sf_dir), gate_english=False)
    return packing.with_reject_reason(samples).select("id", "reject_reason")


def _packed(spark, sf_dir) -> DataFrame:
    """Mined samples packed with a vocabulary learned from the documents."""
    counts = _word_table(spark, sf_dir)
    merges = subwords.learn_merges(counts, PACK_MERGES)
    encoder = subwords.TurnEncoder(merges, subwords.vocabulary(counts, merges))
    samples = mining.mine(D.chatty_graph(spark, sf_dir), gate_english=False)
    return packing.pack(samples, encoder, small_authors(spark, sf_dir), list(D.ACCOUNTS))


@query
def pack_samples(spark, sf_dir):
    return packing.packed_lines(_packed(spark, sf_dir))


@query
def unpack_rows(spark, sf_dir):
    """Packed rows written as lines and read back; every part as text."""
    path = fresh_path(spark, "lines")
    files.write_packed(_packed(spark, sf_dir), path)
    rows = files.read_packed(spark, path)
    return rows.select(*flat(*packing.ROW_PARTS, sep=","), "bad_record")


@query
def split_samples(spark, sf_dir):
    events = D.table(spark, sf_dir, "events").select("event_id")
    return packing.assign_split(events, "event_id")


@query
def batch_feed(spark, sf_dir):
    events = D.table(spark, sf_dir, "events").select("event_id")
    return packing.batch_feed(events, "event_id", buckets=8)


@query
def batch_feed_global(spark, sf_dir):
    """All events in one random order, in full batches but for the last."""
    events = D.table(spark, sf_dir, "events").select("event_id")
    return numbering.global_feed(events, "event_id")


@query
def batch_feed_resumed(spark, sf_dir):
    """The same feed in another epoch, from its tenth batch on."""
    events = D.table(spark, sf_dir, "events").select("event_id")
    return numbering.global_feed(events, "event_id", epoch=3, start_batch=10)


@query
def prepared_rows(spark, sf_dir):
    """Messages to packed rows with their split, with a given vocabulary, turns encoded once."""
    counts = _word_table(spark, sf_dir)
    merges = subwords.learn_merges(counts, PACK_MERGES)
    made = prepare.prepare(
        D.chatty_graph(spark, sf_dir),
        small_authors(spark, sf_dir),
        merges=merges,
        vocabulary=subwords.vocabulary(counts, merges),
        gate_english=False,
        rate=0.1,
    )
    rows = made.rows.withColumn("line", A.packed_line(*packing.ROW_PARTS))
    return rows.select("id", "line", "split")


@query
def prepared_splits(spark, sf_dir):
    """Messages to packed rows with their split, all steps at once."""
    made = prepare.prepare(
        D.linear_graph(spark, sf_dir), small_authors(spark, sf_dir), vocab_size=160
    )
    return prepare.samples_by_split(made.rows)


# --- scoring and selection --------------------------------------------------


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    items = D.score_items(spark, sf_dir).withColumnRenamed("embedding", "vector")
    return items.filter("is_context"), items.filter("not is_context")


def _scores(spark, sf_dir, squash: bool = False) -> DataFrame:
    return ranking.score_matrix(*_sides(spark, sf_dir), squash)


def rounded(rows: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return rows.withColumns({c: F.round(c, digits) for c in columns})


@query
def score_matrix(spark, sf_dir):
    return rounded(_scores(spark, sf_dir), "score")


@query
def sigmoid_scores(spark, sf_dir):
    return rounded(_scores(spark, sf_dir, squash=True), "score")


@query
def triplet_loss(spark, sf_dir):
    return rounded(ranking.triplet_loss(_scores(spark, sf_dir)), "loss", "all_loss")


@query
def triplet_loss_narrow(spark, sf_dir):
    return rounded(ranking.triplet_loss(_scores(spark, sf_dir), 0.05), "loss", "all_loss")


@query
def anchor_losses(spark, sf_dir):
    return rounded(ranking.anchor_losses(_scores(spark, sf_dir), 0.05), "loss", "all_loss")


@query
def hard_triplets(spark, sf_dir):
    found = ranking.hard_triplets(_scores(spark, sf_dir), 0.05)
    return rounded(found, "positive_score", "negative_score")


@query
def select_responses(spark, sf_dir):
    contexts, responses = _sides(spark, sf_dir)
    return rounded(
        ranking.select_responses(
            contexts.select(F.col("vec_id").alias("context_id"), "vector"),
            responses.select(F.col("vec_id").alias("response_id"), "vector"),
            5,
            digits=9,
        ),
        "score",
    )


@query
def select_responses_blocked(spark, sf_dir):
    """The same selection with no context shared: block against block."""
    contexts, responses = _sides(spark, sf_dir)
    return rounded(
        ranking.select_responses(
            contexts.select(F.col("vec_id").alias("context_id"), "vector"),
            responses.select(F.col("vec_id").alias("response_id"), "vector"),
            5,
            context_values=0,
            digits=9,
        ),
        "score",
    )


@query
def select_responses_indexed(spark, sf_dir):
    """Every twentieth vector against all, through an inverted file."""
    vectors = _vector_table(spark, sf_dir)
    contexts = vectors.filter("id % 20 = 0").select(F.col("id").alias("context_id"), "vector")
    responses = vectors.select(F.col("id").alias("response_id"), "vector")
    return rounded(inverted_file.select_responses_indexed(contexts, responses, 5, 32, 20), "score")


def _millionths(column: str):
    """All numbers of a vector, as whole millionths, in one text."""
    return F.array_join(
        F.transform(column, lambda x: F.round(x.cast("double") * 1e6).cast("long").cast("string")), ","
    )


def _vector_table(spark, sf_dir) -> DataFrame:
    return D.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("int").alias("id"), F.col("embedding").alias("vector")
    )


def _token_rows(spark, sf_dir) -> DataFrame:
    """Document words mapped to small ids, some of them 0."""
    ids = F.transform(F.split("text", " "), lambda w, i: (F.length(w) * 7 + i) % 450)
    return D.table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids"))


def _pooled_out(rows: DataFrame) -> DataFrame:
    long_form = rows.select("doc_id", F.posexplode("pooled").alias("dim", "value"))
    return rounded(long_form, "value")


@query
def mean_pool(spark, sf_dir):
    return _pooled_out(
        embeddings.mean_pool(_token_rows(spark, sf_dir), _vector_table(spark, sf_dir))
    )


@query
def mask_many_accounts(spark, sf_dir):
    """Handles of all orders, masked by a dictionary of customers whose names begin one another."""
    debtors = D.table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(
        F.concat(F.lit("C"), "c_custkey").alias("author_id"), F.col("c_custkey").alias("code")
    )
    text = F.concat(F.lit("hi @C"), "o_custkey", F.lit(" bye"))
    return D.table(spark, sf_dir, "orders").select(
        "o_orderkey", X.mask_bots(text, authors.account_names(debtors)).alias("text")
    )


@query
def mean_pool_joined(spark, sf_dir):
    """The same means with a table that no executor holds."""
    rows, table = _token_rows(spark, sf_dir), _vector_table(spark, sf_dir)
    return _pooled_out(embeddings.mean_pool(rows, table, matrix_values=0))


@query
def vector_lookup(spark, sf_dir):
    """Vectors of the turns' ids, all numbers of a vector in one digest."""
    found = embeddings.lookup_vectors(
        _turn_sizes(spark, sf_dir), _vector_table(spark, sf_dir), "tweet_id"
    )
    return found.select(
        "tweet_id",
        "pos",
        "id",
        F.md5(_millionths("vector")).alias("vector"),
    )


@query
def logistic_score(spark, sf_dir):
    rows = _vector_table(spark, sf_dir)
    scored = embeddings.logistic_scores(rows, WEIGHTS, 0.25, "vector").select("id", "score")
    return rounded(scored, "score")


@query
def embedding_table(spark, sf_dir):
    """Half the ids have a given vector; the others get the seeded draw."""
    vectors = _vector_table(spark, sf_dir)
    n = vectors.count()
    table = embeddings.embedding_table(vectors.filter("id % 2 = 0"), n + 7, 64, seed=7)
    long_form = table.select("id", F.posexplode("vector").alias("dim", "value"))
    return long_form.withColumn("value", F.round(F.col("value").cast("double"), 4))


@query
def word_vectors(spark, sf_dir):
    """Vectors trained on conversation turns given as digit sentences."""
    turns, vocab = _letters(spark, sf_dir)
    sentences = embeddings.digit_sentences(subwords.lookup_ids(turns, vocab, "tweet_id"))
    trained = embeddings.train_word_vectors(sentences, dim=16, partitions=4)
    return trained.select("id", F.size("vector").alias("dim"))


# --- metrics ----------------------------------------------------------------


def _steps(spark, sf_dir) -> DataFrame:
    return D.table(spark, sf_dir, "events").selectExpr(
        "event_id div 880 as epoch",
        "event_id % 880 as step",
        "value as loss",
        "value * 2 as all_loss",
    )


@query
def metric_rollup(spark, sf_dir):
    return rounded(metrics.metric_rollup(_steps(spark, sf_dir)), "loss", "all_loss")


@query
def evaluation_means(spark, sf_dir):
    return rounded(metrics.evaluation_means(_steps(spark, sf_dir)), "loss", "all_loss")


@query
def weighted_cross_entropy(spark, sf_dir):
    rows = D.table(spark, sf_dir, "embeddings").selectExpr(
        "embedding as logits",
        "cast(vec_id % 64 as int) as target",
        "if(vec_id % 3 = 0, 0, 1) as weight",
    )
    return rounded(metrics.weighted_cross_entropy(rows), "loss", "metric")


# --- files ------------------------------------------------------------------


@query
def messages_csv(spark, sf_dir):
    """Messages written as CSV, with line ends inside texts, and read back."""
    path = fresh_path(spark, "messages")
    files.write_messages(D.linear_graph(spark, sf_dir), path)
    return files.read_messages(spark, path)


@query
def messages_csv_split(spark, sf_dir):
    """The same file read back by byte ranges."""
    path = fresh_path(spark, "messages")
    files.write_messages(D.linear_graph(spark, sf_dir).coalesce(1), path)
    return files.read_messages_split(spark, path)


@query
def samples_json(spark, sf_dir):
    path = fresh_path(spark, "samples")
    files.write_samples(mining.mine(D.linear_graph(spark, sf_dir)), path)
    return files.read_samples(spark, path).select(*sample_columns())


@query
def chains_csv(spark, sf_dir):
    path = fresh_path(spark, "chains")
    files.write_chains(fan_in.mine_fan_in(D.diamonds(spark, sf_dir)), path)
    chains = files.read_chains(spark, path)
    return chains.select(*flat("sender", "context", sep=","), "response", "author_id")


@query
def corpus_text(spark, sf_dir):
    path = fresh_path(spark, "corpus")
    messages = D.linear_graph(spark, sf_dir)
    files.write_corpus(prepare.clean_corpus(messages, list(D.ACCOUNTS)), path)
    return files.read_corpus(spark, path)


@query
def author_file(spark, sf_dir):
    """Account names written as a list file and read back with their codes."""
    path = fresh_path(spark, "authors")
    small_authors(spark, sf_dir).orderBy("code").select("author_id").coalesce(1).write.text(path)
    return files.read_authors(spark, path)


@query
def vocab_file(spark, sf_dir):
    path = fresh_path(spark, "vocab")
    counts = stats.char_frequency(D.table(spark, sf_dir, "documents"))
    visible = counts.filter(F.col("character").rlike(r"^[\p{L}\p{N}]$"))
    visible.select("character").coalesce(1).write.text(path)
    return files.read_vocab(spark, path)


@query
def vocab_file_all(spark, sf_dir):
    """Every character of the documents as a vocabulary file; a blank is read as an empty entry."""
    path = fresh_path(spark, "vocab")
    counts = stats.char_frequency(D.table(spark, sf_dir, "documents"))
    counts.filter("character <> '\\n'").select("character").coalesce(1).write.text(path)
    return files.read_vocab(spark, path)


@query
def split_sink(spark, sf_dir):
    path = fresh_path(spark, "split")
    events = D.table(spark, sf_dir, "events").select("event_id", "event_type")
    files.write_split(packing.assign_split(events, "event_id"), path)
    return spark.read.parquet(path).select("event_id", "event_type", "split")


@query
def embeddings_sink(spark, sf_dir):
    path = fresh_path(spark, "embeddings")
    files.write_embeddings(_vector_table(spark, sf_dir), path)
    back = files.read_embeddings(spark, path)
    return back.select("id", _millionths("vector").alias("vector"))


@query
def sql_view(spark, sf_dir):
    files.register(D.linear_graph(spark, sf_dir), "message_data")
    return spark.sql("select author_id, count(*) as n from message_data group by author_id")
