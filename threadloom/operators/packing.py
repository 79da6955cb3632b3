"""Fixed-length training rows: validity, packing, split, batches."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom import fixed_values as V
from threadloom.functions import arrays as A
from threadloom.functions import text as X
from threadloom.operators.authors import speaker_classes
from threadloom.operators.embeddings import _shelves as shelf_numbers
from threadloom.operators.gates import reject_reason
from threadloom.operators.subwords import TurnEncoder
from threadloom.session import Scratch

FEED_BUCKETS = 1_024
#: Turns of the samples that meet the ids of their turns together.
SHELF_TURNS = 65_536
ROW_PARTS = ("context", "sender_ids", "response_ids", "author_ids")


def valid_samples(samples: DataFrame) -> DataFrame:
    """Samples whose turns and response all pass; one bad turn drops the sample."""
    bad = F.exists("tweets", X.is_bad_turn) | X.is_bad_turn("response")
    return samples.filter(~bad)


def with_reject_reason(samples: DataFrame) -> DataFrame:
    return samples.withColumn("reject_reason", reject_reason("tweets", "response"))


def encode_samples(
    samples: DataFrame,
    encoder: TurnEncoder,
    accounts: list[str],
    signature: str = "strict",
    max_response: int | None = V.MAX_RESPONSE_IDS,
) -> DataFrame:
    """Clean and encode every turn and the response; add ``turns`` and ``answer``.

    Responses of more than ``max_response`` ids are dropped; contexts of any
    length stay. With None all stay, to be counted or kept by the caller.
    """
    texts = F.concat("tweets", F.array("response"))
    cleaned = F.transform(texts, lambda t: X.clean_text(t, accounts, signature))
    coded = samples.withColumn("coded", encoder.encode_turns(cleaned))
    made = coded.withColumns(
        {
            "turns": F.slice("coded", F.lit(1), F.size("coded") - 1),
            "answer": F.element_at("coded", -1),
        }
    ).drop("coded")
    return made if max_response is None else made.filter(F.size("answer") <= max_response)


def pack_encoded(samples: DataFrame, length: int = V.SEQUENCE_LENGTH) -> DataFrame:
    """The four padded rows of encoded samples with speaker classes."""
    return samples.select(
        "id",
        A.left_pad(F.flatten("turns"), length).alias("context"),
        A.left_pad(A.repeat_over_turns("sender_class", "turns"), length).alias("sender_ids"),
        A.left_pad("answer", length).alias("response_ids"),
        A.left_pad(F.array_repeat("author_class", F.size("answer")), length).alias("author_ids"),
    )


def pack(
    samples: DataFrame,
    encoder: TurnEncoder,
    authors: DataFrame,
    accounts: list[str],
    signature: str = "strict",
    length: int = V.SEQUENCE_LENGTH,
    max_response: int | None = V.MAX_RESPONSE_IDS,
    once: bool = False,
) -> DataFrame:
    """Gate, clean, encode and pad samples to four rows of ``length`` ids.

    With ``once`` each distinct turn is encoded once for the whole table (for samples
    of long walks); otherwise turns are encoded where they stand.
    """
    if once:
        coded = encode_samples_once(samples, encoder, accounts, signature, max_response)
    else:
        coded = encode_samples(valid_samples(samples), encoder, accounts, signature, max_response)
    return pack_encoded(speaker_classes(coded, authors), length)


def _hashes(text: Column) -> list[Column]:
    """128 bits by which a turn is told."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def coded_turns(
    samples: DataFrame, encoder: TurnEncoder, accounts: list[str], signature: str = "strict", tables: Scratch | None = None
) -> DataFrame:
    """``(h1, h2, ids)``, written: each distinct turn or response that passes, cleaned and encoded once.

    A turn stands in every sample below it, so distinct turns are far fewer than
    turns of samples.
    """
    tables = tables or Scratch(samples.sparkSession, "turns")
    raw = F.col("raw")
    texts = samples.select(F.explode(F.concat("tweets", F.array("response"))).alias("raw")).distinct()
    clean = texts.filter(~X.is_bad_turn("raw")).select(*_hashes(raw), X.clean_text("raw", accounts, signature).alias("text"))
    return tables.table(clean.select("h1", "h2", encoder.encode("text").alias("ids")), "coded")


def _split_coded(rows: DataFrame, max_response: int | None) -> DataFrame:
    """``turns`` and ``answer`` out of ``coded``."""
    turns = F.slice("coded", F.lit(1), F.size("coded") - 1)
    made = rows.withColumns({"turns": turns, "answer": F.element_at("coded", -1)}).drop("coded")
    return made if max_response is None else made.filter(F.size("answer") <= max_response)


def _keys(turns: pa.StructArray) -> pa.Array:
    halves = [pc.struct_field(turns, h).to_numpy(zero_copy_only=False).astype(np.int64) for h in ("h1", "h2")]
    return pa.Array.from_buffers(pa.binary(16), len(turns), [None, pa.py_buffer(np.stack(halves, axis=1).tobytes())])


def _met(rows: pa.Table, coded: pa.Table) -> pa.Table:
    """Samples of a shelf with the ids of their turns; one that misses a turn had a bad one."""
    said = rows.column("said").combine_chunks()
    known = pa.StructArray.from_arrays([coded.column(h).combine_chunks() for h in ("h1", "h2")], ["h1", "h2"])
    place = pc.index_in(_keys(said.flatten()), value_set=_keys(known))
    bounds = np.append(0, np.cumsum(pc.list_value_length(said).to_numpy(zero_copy_only=False))).astype(np.int32)
    ids = coded.column("ids").combine_chunks().take(place)
    turns = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), ids)
    missed = np.append(0, np.cumsum(place.is_null().to_numpy(zero_copy_only=False)))
    whole = pa.array(missed[bounds[1:]] == missed[bounds[:-1]])
    return rows.drop_columns(["shelf", "said"]).append_column("coded", turns).filter(whole)


def encode_by_shelf(
    samples: DataFrame, coded: DataFrame, max_response: int | None = V.MAX_RESPONSE_IDS, tables: Scratch | None = None
) -> DataFrame:
    """``encode_samples`` of ``valid_samples`` from the turns of ``coded_turns``, written.

    Samples that stand together form a shelf, which asks once for each of its turns by
    their hashes, so what moves is the hashes of a sample, once, and a turn's ids for
    each shelf that has it. Texts do not move. Samples need no key.
    """
    tables = tables or Scratch(samples.sparkSession, "shelves")
    every = F.concat("tweets", F.array("response"))
    said = F.transform(every, lambda t: F.struct(*_hashes(t)))
    rest = [c for c in samples.columns if c not in ("tweets", "response")]
    asked = samples.filter(every.isNotNull()).select(*rest, said.alias("said"))
    rows = tables.table(asked.withColumn("shelf", shelf_numbers(F.size("said"), SHELF_TURNS)), "shelves")
    turn = F.explode(F.array_distinct("said")).alias("turn")
    wanted = rows.select(F.col("shelf").alias("to_shelf"), turn).select("to_shelf", "turn.h1", "turn.h2").distinct()
    answers = wanted.join(coded, ["h1", "h2"]).select("to_shelf", "h1", "h2", "ids")
    schema = T.StructType([*samples.select(*rest).schema.fields, T.StructField("coded", T._parse_datatype_string("array<array<int>>"))])
    met = rows.groupBy("shelf").cogroup(answers.groupBy("to_shelf")).applyInArrow(_met, schema)
    return _split_coded(tables.table(met, "encoded"), max_response)


def encode_by_id(samples: DataFrame, coded: DataFrame, max_response: int | None = V.MAX_RESPONSE_IDS) -> DataFrame:
    """The same by ``id``, whose turns are put together over all rows that have it.

    A sample that misses one of its turns had a bad one, and so has one whose id
    brings more turns than its own.
    """
    every = F.concat("tweets", F.array("response"))
    said = samples.select("id", F.posexplode(every).alias("pos", "raw"))
    met = said.select("id", "pos", *_hashes(F.col("raw"))).join(coded, ["h1", "h2"])
    ordered = F.array_sort(F.collect_list(F.struct("pos", "ids")))
    turns = met.groupBy("id").agg(F.transform(ordered, lambda p: p["ids"]).alias("coded"))
    known = samples.withColumn("said", F.size("tweets") + 1).drop("tweets", "response")
    whole = known.join(turns, "id").filter(F.size("coded") == F.col("said")).drop("said")
    return _split_coded(whole, max_response)


def encode_samples_once(
    samples: DataFrame,
    encoder: TurnEncoder,
    accounts: list[str],
    signature: str = "strict",
    max_response: int | None = V.MAX_RESPONSE_IDS,
    tables: Scratch | None = None,
) -> DataFrame:
    """``encode_samples`` of ``valid_samples``, each distinct turn cleaned and encoded once; every row is kept."""
    tables = tables or Scratch(samples.sparkSession, "turns")
    coded = coded_turns(samples, encoder, accounts, signature, tables)
    return encode_by_shelf(samples, coded, max_response, tables)


def packed_lines(packed: DataFrame) -> DataFrame:
    """Export form: one line of comma-separated ids per sample."""
    return packed.select("id", A.packed_line(*ROW_PARTS).alias("line"))


def unpack_lines(lines: DataFrame, length: int = V.SEQUENCE_LENGTH) -> DataFrame:
    """Lines back to four arrays; a line of another length is marked as bad."""
    # a cast of the whole array runs in compiled code, and each column below once
    with_ids = lines.withColumn("all_ids", F.split("line", ",").try_cast("array<int>"))
    whole = (F.size("all_ids") == len(ROW_PARTS) * length) & ~F.exists("all_ids", lambda x: x.isNull())
    told = with_ids.withColumn("good", F.coalesce(whole, F.lit(False)))
    parts = {
        name: F.when(F.col("good"), F.slice("all_ids", i * length + 1, length))
        for i, name in enumerate(ROW_PARTS)
    }
    bad = F.when(~F.col("good"), F.col("line"))
    return told.withColumns(parts).withColumn("bad_record", bad).drop("all_ids", "good", "line")


def order_digest(seed: int, *key: Column | str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[X._col(k).cast("string") for k in key]))


def is_test(key: Column | str, rate: float = V.TEST_RATE, seed: int = V.SPLIT_SEED) -> Column:
    """True for about ``rate`` of the keys, always the same ones."""
    bar = format(math.ceil(rate * 2**32), "08x")
    return F.substring(order_digest(seed, key), 1, 8) < F.lit(bar)


def assign_split(
    rows: DataFrame, key: str = "id", rate: float = V.TEST_RATE, seed: int = V.SPLIT_SEED
) -> DataFrame:
    """Add ``split``; drawn after rejection, so call it on packed rows."""
    return rows.withColumn("split", F.when(is_test(key, rate, seed), "test").otherwise("train"))


def batch_feed(
    rows: DataFrame,
    key: str = "id",
    batch_size: int = V.BATCH_SIZE,
    seed: int = V.SPLIT_SEED,
    epoch: int = 0,
    buckets: int = FEED_BUCKETS,
) -> DataFrame:
    """Rows in a repeatable random order, in batches of ``batch_size``.

    Rows fall into buckets by the digest of their unique key and are numbered
    inside their bucket, so no window sees the whole table; only the last
    batch of a bucket may be short. Another ``epoch`` gives another order, and
    so does another number of ``buckets``, which never follows the row count.
    """
    digest = order_digest(seed, F.lit(epoch), key)
    bucket = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets).alias("bucket")
    order = Window.partitionBy("bucket").orderBy("digest", key)
    numbered = rows.withColumns({"digest": digest, "bucket": bucket}).withColumn(
        "place", F.row_number().over(order) - 1
    )
    return numbered.withColumns(
        {
            "batch_no": F.floor(F.col("place") / batch_size),
            "slot": F.col("place") % batch_size,
        }
    ).drop("digest", "place")
