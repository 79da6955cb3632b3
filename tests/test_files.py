"""Files written and read back."""

import random

from threadloom.operators import fan_in
from threadloom.plans import prepare
from threadloom.sources import files
from tests.test_fan_in import FANS
from tests.test_mining import graph


def test_messages_csv(spark, tmp_path):
    rows = [
        (1, "u", True, 'says "hi",\nthen leaves', "2,3", None),
        (2, "B", False, "plain", None, 1),
        (3, None, None, "back\\slash", None, 1),
    ]
    columns = (
        "tweet_id long, author_id string, inbound boolean, text string, "
        "response_tweet_id string, in_response_to_tweet_id long"
    )
    messages = spark.createDataFrame(rows, columns)
    files.write_messages(messages, str(tmp_path / "m"))
    got = sorted(files.read_messages(spark, str(tmp_path / "m")).collect())
    assert [tuple(r) for r in got] == rows


def test_messages_csv_by_header_name(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        "tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n"
        '7,u,True,today,"a, b",,\n'
    )
    row = files.read_messages(spark, str(tmp_path / "m.csv")).first()
    assert tuple(row) == (7, "u", True, "a, b", None, None)


def test_split_messages_equal_the_whole_file_reader(spark, tmp_path):
    rng = random.Random(5)
    bits = ["a", "two words", 'say ""hi""', "line\nend", "", "x,y", "\n", 'one ""quote', "é"]
    lines = ["tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id"]
    for k in range(800):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 5)))
        lines.append(f'{k},u{k % 7},{k % 2 == 0},now,"{text}",{k + 1 if k % 3 else ""},')
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.csv").write_text("\n".join([lines[0], '900,z,True,x,"no line end at the end"']) + ",,")
    wanted = sorted(map(tuple, files.read_messages(spark, str(tmp_path)).collect()), key=str)
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        for size in ("700b", "128m"):
            spark.conf.set(name, size)
            got = files.read_messages_split(spark, str(tmp_path))
            assert sorted(map(tuple, got.collect()), key=str) == wanted
            if size == "700b":
                assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set(name, before)


def test_lists_keep_line_numbers(spark, tmp_path):
    (tmp_path / "names").write_text("b \na\nb\nc\n", encoding="utf-8")
    codes = {r.author_id: r.code for r in files.read_authors(spark, str(tmp_path / "names")).collect()}
    assert codes == {"a": 2, "b": 3, "c": 4}
    (tmp_path / "vocab").write_text("<unk>\n▁é\nx", encoding="utf-8")
    ids = {r.subword: r.id for r in files.read_vocab(spark, str(tmp_path / "vocab")).collect()}
    assert ids == {"<unk>": 0, "▁é": 1, "x": 2}


def test_samples_json(spark, tmp_path):
    (tmp_path / "s.json").write_text(
        '{"sender":["u"],"tweets":["a\\nb"],"response":"r","author_id":"B","id":8589934592}\n'
    )
    samples = files.read_samples(spark, str(tmp_path / "s.json"))
    assert tuple(samples.first()) == ("8589934592", ["u"], ["a\nb"], "r", "B")
    files.write_samples(samples, str(tmp_path / "out"))
    assert files.read_samples(spark, str(tmp_path / "out")).collect() == samples.collect()


def test_chains_csv(spark, tmp_path):
    paths = fan_in.mine_fan_in(graph(spark, FANS), gate_english=False)
    files.write_chains(paths, str(tmp_path / "c"))
    got = {(tuple(r.sender), tuple(r.context), r.response)
           for r in files.read_chains(spark, str(tmp_path / "c")).collect()}
    assert (("u",), (1, 2), 3) in got and len(got) == 6


def test_corpus_has_one_text_per_line(spark, tmp_path):
    rows = spark.createDataFrame([("a\nb",), ("c",)], "text string")
    files.write_corpus(rows, str(tmp_path / "t"))
    got = sorted(r.text for r in files.read_corpus(spark, str(tmp_path / "t")).collect())
    assert got == ["a b", "c"]


def test_prepare_end_to_end(spark, tmp_path):
    messages = graph(spark, [r for r in FANS if r[0] != 5])
    authors = spark.createDataFrame([("B", 1)], "author_id string, code int")
    made = prepare.prepare(messages, authors, vocab_size=60, path=str(tmp_path / "mined"))
    rows = made.rows.collect()
    # Roots 1, 2 and 6 each give the answer and, after it, the thanks.
    assert len(rows) == 6
    assert all(len(r.context) == 128 and len(r.author_ids) == 128 for r in rows)
    for form in ("parquet", "text"):
        files.write_split(made.rows, str(tmp_path / form), form)
        files.write_split(made.rows, str(tmp_path / form), form)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 6
    lines = files.read_packed(spark, str(tmp_path / "text"))
    assert lines.count() == 6 and lines.filter("bad_record is not null").count() == 0


def test_prepared_rows_move_no_turns(spark):
    """Samples are encoded where they stand."""
    authors = spark.createDataFrame([("B", 1)], "author_id string, code int")
    rows = prepare.prepare(graph(spark, FANS), authors, vocab_size=60, gate_english=False).rows
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
