import models
import pytest
from brevia.operators import encoding, vocabulary
from brevia.operators.numbering import rank_rows, running_total
from brevia.sources.vocabulary import read_vocab, write_vocab
from pyspark.sql import functions as F

DOCUMENTS = [
    "b a c a", "", "c b <unk> d", "e f g h i j k", "a <unk> <unk> <unk> z", "k j i h", "d d d d", "solo", "c",
]


@pytest.fixture(scope="module")
def tokens(spark):
    rows = [(i, t.split()) for i, t in enumerate(DOCUMENTS)]
    return spark.createDataFrame(rows, "doc_id BIGINT, tokens ARRAY<STRING>").repartition(3)


def ids_of(vocab):
    return {r.token: r.token_id for r in vocab.collect()}


@pytest.mark.parametrize("cap", [None, 2, 3, 5, 8, 500])
@pytest.mark.parametrize("wide", [False, True])
def test_rank_like_python(tokens, cap, wide):
    stats = vocabulary.word_stats(tokens, wide=wide)
    expected = models.vocabulary([t.split() for t in DOCUMENTS], cap)
    assert ids_of(vocabulary.rank_vocab(stats, cap or -1)) == expected


def test_large_cap_is_ranked_in_parallel(tokens, monkeypatch):
    monkeypatch.setattr(vocabulary, "ONE_TASK_WORDS", 3)
    for cap in (2, 4, 7, 300):
        expected = models.vocabulary([t.split() for t in DOCUMENTS], cap)
        assert ids_of(vocabulary.rank_vocab(vocabulary.word_stats(tokens), cap)) == expected


def test_rare_words_are_left_out_before_ranking(spark):
    rows = [(f"w{i}", 1 + 1000 // i, 1, i) for i in range(1, 500)]
    words = spark.createDataFrame(rows, "token STRING, n BIGINT, df BIGINT, first BIGINT")
    kept = vocabulary._frequent(words, 20)
    assert 20 <= kept.count() <= 30
    assert {r[0] for r in sorted(rows, key=lambda r: (-r[1], r[3]))[:20]} <= {r.token for r in kept.collect()}


def test_counts(tokens):
    rows = {r.token: r for r in vocabulary.word_stats(tokens).collect()}
    assert (rows["a"].n, rows["a"].df, rows["a"].first) == (3, 2, 1)
    assert (rows["d"].n, rows["d"].df, rows["d"].first) == (5, 2, (2 << 24) + 3)


def test_stats_use_hash_aggregation_and_one_shuffle(tokens):
    plan = vocabulary.word_stats(tokens)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert plan.count("Exchange hashpartitioning(token") == 1


def test_ids_too_large_to_pack(spark):
    far = spark.createDataFrame([(1 << 40, ["a"])], "doc_id BIGINT, tokens ARRAY<STRING>")
    with pytest.raises(Exception, match="wide=True"):
        vocabulary.word_stats(far).collect()
    assert vocabulary.word_stats(far, wide=True).count() == 1


def test_vocab_size(tokens):
    vocab = vocabulary.fit_vocab(tokens)
    words = len(models.vocabulary([t.split() for t in DOCUMENTS]))
    assert vocabulary.vocab_size(vocab).first().vocab_size == words + 2
    assert vocabulary.vocab_size(vocab, 5).first().vocab_size == 5
    assert vocabulary.vocab_size(vocab, 5000).first().vocab_size == 5000


def test_save_and_load_prunes(spark, tokens, tmp_path):
    path = str(tmp_path / "v")
    vocab = vocabulary.fit_vocab(tokens)
    write_vocab(vocab, path, "document", -1)
    write_vocab(vocab.filter("token_id < 5"), path, "summary", 5)
    assert ids_of(read_vocab(spark, path, "document", -1)) == ids_of(vocab)
    small = read_vocab(spark, path, "summary", 5)
    assert small.count() == 3
    assert "PartitionFilters: [isnotnull(side" in small._jdf.queryExecution().executedPlan().toString()
    write_vocab(vocab.filter("token_id < 4"), path, "summary", 5)
    assert read_vocab(spark, path, "summary", 5).count() == 2


@pytest.mark.parametrize("path", ["broadcast", "two parts"])
@pytest.mark.parametrize("cap", [None, 4, 5, 6])
@pytest.mark.parametrize("length", [None, 4])
def test_encode_and_decode_like_python(tokens, monkeypatch, path, cap, length):
    if path == "two parts":
        monkeypatch.setattr(encoding, "BROADCAST_WORDS", 4)
    vocab = vocabulary.fit_vocab(tokens)
    found = encoding.encode(tokens, vocab, length, cap or -1)
    model = models.vocabulary([t.split() for t in DOCUMENTS], cap)
    expected = {i: models.encode(t.split(), model)[:length] for i, t in enumerate(DOCUMENTS)}
    assert dict(found.collect()) == expected
    texts = dict(encoding.decode(found, vocab, cap or -1).collect())
    back = {i: w for w, i in model.items()}
    assert texts == {d: " ".join(back.get(i, "<unk>") for i in ids) for d, ids in expected.items()}
    counts = {r.doc_id: (r.kept, r.unknown) for r in encoding.encode_lengthwise(tokens, vocab, length, cap or -1).collect()}
    assert counts == {d: (len(ids), ids.count(1)) for d, ids in expected.items()}


def test_decode_reserved_and_foreign_ids(spark, tokens):
    vocab = vocabulary.fit_vocab(tokens)
    ids = spark.createDataFrame([(1, [0, 1, 2, 999]), (2, [])], "doc_id BIGINT, ids ARRAY<INT>")
    top = vocab.filter("token_id = 2").first().token
    assert dict(encoding.decode(ids, vocab).collect()) == {1: f"<unk> <unk> {top} <unk>", 2: ""}


def test_head_is_bounded_in_bytes(spark, monkeypatch):
    vocab = spark.createDataFrame([(f"{'x' * 10}{i}", i) for i in range(2, 9)], "token STRING, token_id INT")
    monkeypatch.setattr(encoding, "BROADCAST_BYTES", 33)
    monkeypatch.setattr(encoding, "BROADCAST_WORD_BYTES", 100)
    assert sorted(r.token_id for r in encoding._head(vocab).collect()) == [2, 3, 4]


def test_encoding_partitioned_input_needs_no_shuffle_by_key(spark, tokens):
    vocab = vocabulary.fit_vocab(tokens)
    plan = encoding.encode(tokens.repartition(4, "doc_id"), vocab, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and "BroadcastHashJoin" in plan


def test_unknown_totals(spark):
    rows = spark.createDataFrame([(1, [1, 2, 1], [0]), (2, [0], [1])], "doc_id BIGINT, inputs ARRAY<INT>, targets ARRAY<INT>")
    assert tuple(encoding.unknown_totals(rows, ["inputs", "targets"]).first()) == (2, 1)


def test_rank_rows_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    ranked = rank_rows(df, [F.col("v").desc()], "num", start=5).collect()
    assert all(r.num == 999 - r.v + 5 for r in ranked) and len(ranked) == 1000


def test_running_total_in_chunks(spark):
    rows = [(g, i, float(i + g)) for g in (0, 1) for i in range(23)]
    df = spark.createDataFrame(rows, "g INT, i BIGINT, v DOUBLE").repartition(5)
    for row in running_total(df, ["g"], "i", "v", "total", chunk=4).collect():
        assert row.total == sum(i + row.g for i in range(row.i + 1))


def test_frequent_word_new_to_the_vocabulary(spark, tokens, monkeypatch):
    monkeypatch.setattr(encoding, "BROADCAST_WORDS", 4)
    split = encoding.skew_join
    monkeypatch.setattr(encoding, "skew_join", lambda *a: split(*a, hot_rows=5))
    vocab = vocabulary.fit_vocab(tokens)
    model = models.vocabulary([t.split() for t in DOCUMENTS])
    texts = {i: ["new"] * 9 + ["c", "solo", "k"] for i in range(6)}
    fresh = spark.createDataFrame(list(texts.items()), "doc_id BIGINT, tokens ARRAY<STRING>")
    found = dict(encoding.encode(fresh, vocab).collect())
    assert found == {i: models.encode(t, model) for i, t in texts.items()}


def test_rows_keep_their_number_in_another_layout(spark):
    """A large vocabulary reads the rows more than once. Their layout differs each time here: a row must stay one row."""
    from brevia.operators import encoding
    from pyspark.sql import functions as F

    rows = spark.range(400).select((F.col("id") % 100).alias("doc_id"), F.expr(
        "array('common', concat('rare', id), 'common', concat('rare', id + 1))").alias("tokens"))
    vocab = spark.range(500).select(F.when(F.col("id") == 0, "common").otherwise(F.concat(F.lit("rare"), F.col("id"))).alias(
        "token"), (F.col("id") + 2).cast("int").alias("token_id"))
    moved = rows.withColumn("_r", F.rand()).repartition(7, "_r").drop("_r")  # another layout each time it is read
    found = encoding.encode(moved, vocab, most_words=10).collect()
    assert len(found) == 400 and all(len(r.ids) == 4 and r.ids[0] == r.ids[2] == 2 for r in found)


@pytest.mark.parametrize("cast", ["string", "bigint"])
def test_wide_ids_keep_the_hash_aggregation_and_the_order(spark, cast):
    texts = [("b", ["y", "x"]), ("b", ["z"]), ("a", ["x", "w", "w"]), ("c", ["v"]), (None, ["u"])]
    order = {"a": -5, "b": 7, "c": 1 << 50, None: None}
    rows = [(i if cast == "string" else order[i], words) for i, words in texts]
    df = spark.createDataFrame(rows, f"doc_id {cast}, tokens ARRAY<STRING>")
    stats = vocabulary.word_stats(df, wide=True)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    ids = ids_of(vocabulary.rank_vocab(stats))
    assert [w for w, _ in sorted(ids.items(), key=lambda x: x[1]) if w not in "yz"] == ["x", "w", "u", "v"]
    assert ids["u"] < min(ids["y"], ids["z"]) and max(ids["y"], ids["z"]) < ids["v"]
    assert {r.token: (r.n, r.df) for r in stats.collect()}["x"] == (2, 2)


def test_a_short_vocabulary_decodes_without_a_shuffle(spark, tokens, monkeypatch):
    vocab = vocabulary.fit_vocab(tokens)
    ids = spark.createDataFrame(
        [(1, [0, 1, 2, 999, 3]), (2, []), (3, None), (4, [-1, None, 4])], "doc_id BIGINT, ids ARRAY<INT>")
    short = encoding.decode(ids, vocab)
    plan = short._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Generate" not in plan
    monkeypatch.setattr(encoding, "ARRAY_WORDS", 3)
    long = encoding.decode(ids, vocab)
    assert "Generate" in long._jdf.queryExecution().executedPlan().toString()
    assert dict(short.collect()) == dict(long.collect()) and short.count() == 4


def test_rows_staged_for_a_large_vocabulary_are_packed_well(spark, tokens):
    import glob

    from brevia import session

    folder = session.shared_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/brevia/*/*"))
    encoding.encode(tokens, vocabulary.fit_vocab(tokens), most_words=4).count()
    new = [f for f in set(glob.glob(f"{folder}/brevia/*/*")) - before if "/numbered-" in f or "/rare-" in f]
    assert len(new) == 2 and all(glob.glob(f"{f}/*.zstd.parquet") or glob.glob(f"{f}/*.zst*") for f in new)
