import pytest
from brevia import session
from brevia.operators.metrics import epoch_loss
from brevia.operators.vocabulary import fit_vocab
from brevia.operators.encoding import encode
from brevia.functions.sequences import pad_truncate
from brevia.functions.text import tokenise
from brevia.plans import summaries, training
from brevia.sources import results
from brevia.streaming.incremental import encode_stream
from pyspark.sql import functions as F


def test_padded_number_is_never_cut(spark):
    df = spark.createDataFrame([(7,), (999999,), (1234567,)], "num BIGINT")
    names = [r[0] for r in df.select(results.padded_number(F.col("num"))).collect()]
    assert names == ["000007", "999999", "1234567"]


def test_pairs_and_restart(spark, tmp_path):
    path = str(tmp_path / "pairs")
    docs = spark.createDataFrame([(n, f"g{n}", f"s{n}") for n in range(4)], "num INT, gold STRING, generated STRING")
    results.write_pairs(docs.filter("num < 2"), path)
    spark.createDataFrame([(2, "encoder", "g2", "x")], "num INT, tag STRING, text STRING, name STRING").write.partitionBy(
        "tag").parquet(f"{path}/{results.RUN}=other")
    done = spark.read.parquet(path)
    assert sorted(r.num for r in results.pending(docs, done).collect()) == [2, 3]
    texts = {(r.num, r.tag): (r.text, r.name) for r in done.collect()}
    assert texts[1, "decoder"] == ("s1", "000001_decoder.txt") and texts[1, "encoder"] == ("g1", "000001_encoder.txt")


def test_failures(spark):
    df = spark.createDataFrame([(1, "d", "g", None), (2, "e", "h", "bad")], "num INT, articles STRING, gold STRING, error STRING")
    good, bad = results.split_failures(df)
    assert [r.num for r in good.collect()] == [1]
    assert tuple(results.failure_rows(bad).first()) == (2, "000002", "e", "h", "bad")


def test_metrics_are_appended(spark, tmp_path):
    path = str(tmp_path / "report")
    for epoch in (1, 2):
        results.write_metrics(epoch_loss(spark.createDataFrame([(epoch, 1.0)], "epoch INT, loss DOUBLE")), path)
    assert spark.read.parquet(path).count() == 2


def test_shared_folder(spark):
    folder = session.shared_folder(spark)
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert folder == configured if configured else folder
    staged = session.stage(spark.range(5).withColumn("x", F.array(F.lit(1))), "t")
    assert staged.count() == 5 and folder.removeprefix("file:") in staged.inputFiles()[0]


def test_shared_folder_must_be_set_on_a_cluster():
    class Conf:
        def get(self, name):
            return None

    class Context:
        master, applicationId = "yarn", "a"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_spread_leaves_wide_scans_alone(spark):
    wide = spark.range(0, 100, 1, 64)
    assert session.spread(wide, "id") is wide
    narrow = session.spread(spark.range(0, 100, 1, 1), "id")
    assert narrow.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


TEXTS = {1: "a b c", 2: None, 3: "", 4: "c c d!", 5: "a a a a a", 6: "z"}


def test_stream_equals_batch_also_after_restart_and_replay(spark, tmp_path):
    source, sink, failed = (str(tmp_path / d) for d in ("in", "out", "bad"))
    schema = "doc_id BIGINT, articles STRING"

    def arrive(*docs):
        spark.createDataFrame([(d, TEXTS[d]) for d in docs], schema).coalesce(1).write.mode("append").parquet(source)

    def run(progress):
        stream = spark.readStream.schema(schema).parquet(source)
        encode_stream(stream, vocab, sink, failed, str(tmp_path / progress), 4).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(sink).select("doc_id", "ids").collect()))

    known = spark.createDataFrame([(d, t) for d, t in TEXTS.items() if t is not None], schema)
    tokens = known.select("doc_id", tokenise(F.col("articles")).alias("tokens"))
    vocab = fit_vocab(tokens)
    batch = encode(tokens, vocab, 4).select("doc_id", pad_truncate(F.col("ids"), 4).alias("ids"))
    expected = sorted(map(tuple, batch.collect()))

    arrive(1, 2, 3)
    assert run("p") == [r for r in expected if r[0] in (1, 3)]
    arrive(3, 4)
    arrive(5, 6, 2)
    assert run("p") == expected
    assert run("p") == expected
    # A lost checkpoint replays everything: nothing is written twice.
    assert run("new") == expected
    assert {(r.doc_id, r.error) for r in spark.read.parquet(failed).collect()} == {(2, "missing text")}


PAIRS = [(i, f"word{i % 5} common text\nline {i}", f"common word{i % 3}") for i in range(40)]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "doc_id BIGINT, articles STRING, abstracts STRING")


def test_training_set_fitted_and_continued(spark, pairs, tmp_path):
    settings = training.Settings(
        document_length=8, summary_length=6, document_cap=12, summary_cap=8, batch_size=16, epochs=2
    )
    path = str(tmp_path / "v")
    first = training.training_set(pairs, path, settings).collect()
    assert len(first) == 80 and {len(r.input) for r in first} == {8} and {len(r.target) for r in first} == {6}
    assert {(r.epoch, r.batch) for r in first} == {(e, b) for e in (1, 2) for b in range(3)}
    again = training.training_set(pairs, path, settings, fit=False).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_cap_must_keep_the_markers(pairs, tmp_path):
    with pytest.raises(ValueError, match="leaves out"):
        training.fit_vocabularies(pairs, str(tmp_path / "v"), training.Settings(summary_cap=3))


def test_summarise_pending(spark, tmp_path):
    vocab = spark.createDataFrame(
        [(w, i) for i, w in enumerate(["<go>", "<stop>", "a", "b", "c"], start=2)], "token STRING, token_id INT"
    )
    scores = [("x", p, t, 0.3 - t / 100) for p in (2, 3, 4, 5, 6) for t in (3, 4, 5, 6) if t != p]
    scores = spark.createDataFrame(scores, "key STRING, prev INT, token_id INT, prob DOUBLE")
    documents = spark.createDataFrame(
        [(i, i + 10, f"doc{i}", f"gold{i}") for i in range(4)], "doc_id BIGINT, num BIGINT, articles STRING, gold STRING"
    )
    seeds = spark.createDataFrame([(0, "x", 2), (1, "x", 2), (2, "y", 2), (3, "x", 2)], "doc_id BIGINT, key STRING, prev INT")
    done = spark.createDataFrame([(10, "encoder"), (10, "decoder"), (11, "encoder")], "num BIGINT, tag STRING")
    path, failures = str(tmp_path / "out"), str(tmp_path / "bad")
    settings = summaries.Decoding(length=6, k=2, ngram_size=2)
    repeated = summaries.summarise_pending(documents, seeds, scores, vocab, path, failures, done, settings)
    assert sorted(r.num for r in repeated.collect()) == [11, 13]
    written = {(r.num, r.tag) for r in spark.read.parquet(path).collect()}
    assert written == {(n, t) for n in (11, 13) for t in ("encoder", "decoder")}
    assert [r.num for r in spark.read.parquet(failures).collect()] == [12]


def test_summaries_written_again_replace_the_earlier_ones(spark, tmp_path):
    path, failures = str(tmp_path / "pairs"), str(tmp_path / "bad")
    docs = spark.createDataFrame([(n, f"g{n}", f"s{n}") for n in range(3)], "num INT, gold STRING, generated STRING")
    half = spark.createDataFrame([(1, "encoder", "half", "x")], "num INT, tag STRING, text STRING, name STRING")
    results.write_texts(half, path)
    results.write_pairs(docs, path)
    results.write_pairs(docs.filter("num = 2").withColumn("generated", F.lit("again")), path)
    found = {(r.num, r.tag): r.text for r in results.read_pairs(spark, path).collect()}
    assert results.read_pairs(spark, path).count() == 6
    assert found[1, "encoder"] == "g1" and found[2, "decoder"] == "again" and found[0, "decoder"] == "s0"
    bad = spark.createDataFrame([(7, "000007", "d", "g", "first"), (2, "000002", "d", "g", "first")],
                                "num INT, name STRING, doc STRING, gold STRING, error STRING")
    for cause in ("first", "second"):
        results.write_failures(bad.withColumn("error", F.lit(cause)), failures)
    assert {(r.num, r.error) for r in results.read_failures(spark, failures).collect()} == {(7, "second"), (2, "second")}
    still = results.read_failures(spark, failures, results.read_pairs(spark, path)).collect()
    assert [(r.num, r.error) for r in still] == [(7, "second")]


def test_only_a_missing_manifest_counts_as_empty(spark, tmp_path):
    rows = spark.createDataFrame([(1, "encoder", "t", "n")], "num INT, tag STRING, text STRING, name STRING")
    (tmp_path / "empty").mkdir()
    results.write_texts(rows, str(tmp_path / "empty"))
    assert results.read_pairs(spark, str(tmp_path / "empty")).count() == 1
    broken = tmp_path / "broken" / "_runs"
    broken.mkdir(parents=True)
    (broken / "part.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception, match="part.parquet"):
        results.read_pairs(spark, str(broken.parent))


def test_streams_with_checkpoints_of_their_own_share_a_sink(spark, tmp_path):
    sink, failed = str(tmp_path / "out"), str(tmp_path / "bad")
    schema = "doc_id BIGINT, articles STRING"
    vocab = fit_vocab(spark.createDataFrame([(0, ["a", "b", "c"])], "doc_id BIGINT, tokens ARRAY<STRING>"))

    def run(name, *batches):
        for docs in batches:
            spark.createDataFrame(docs, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / name))
            encode_stream(stream, vocab, sink, failed, str(tmp_path / f"{name}-progress"), 3).awaitTermination()

    run("first", [(1, "a"), (2, "b b")], [(4, "c"), (4, "a")])
    run("second", [(3, "c"), (1, "a")], [(5, None), (2, "b b")])
    found = sorted((r.doc_id, tuple(r.ids)) for r in spark.read.parquet(sink).collect())
    assert found == [(1, (2, 0, 0)), (2, (3, 3, 0)), (3, (4, 0, 0)), (4, (2, 0, 0))]
    assert _failed(spark, failed) == [(4, "c", "repeated id"), (5, "", "missing text")]


def _failed(spark, path):
    return sorted((r.doc_id or 0, r.articles or "", r.error) for r in spark.read.parquet(path).collect())


def test_every_row_of_a_stream_is_in_the_sink_or_fails(spark, tmp_path):
    sink, failed, source = (str(tmp_path / d) for d in ("out", "bad", "in"))
    schema = "doc_id STRING, articles STRING"
    vocab = fit_vocab(spark.createDataFrame([(0, ["a", "b", "c"])], "doc_id BIGINT, tokens ARRAY<STRING>"))
    batches = [
        [("x", "b"), ("x", "a"), ("x", "a"), (None, "c"), (None, None), ("y", None), ("", "c")],
        [("x", "a"), ("x", "c"), ("y", "b"), ("y", "c"), ("z", "a"), (None, "c")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        encode_stream(stream, vocab, sink, failed, str(tmp_path / "progress"), 2).awaitTermination()
    found = sorted((r.doc_id, r.ids[0]) for r in spark.read.parquet(sink).collect())
    assert found == [("", 4), ("x", 2), ("y", 3), ("z", 2)]
    assert sorted((r.doc_id or "-", r.articles or "", r.error) for r in spark.read.parquet(failed).collect()) == sorted([
        ("x", "b", "repeated id"), ("x", "c", "repeated id"), ("y", "c", "repeated id"), ("-", "c", "missing id"),
        ("-", "c", "missing id"), ("-", "", "missing text"), ("y", "", "missing text")])


def test_an_id_with_many_texts_in_one_micro_batch(spark, tmp_path, monkeypatch):
    from brevia.streaming import incremental

    monkeypatch.setattr(incremental, "HELD", 5)
    sink, failed, source = (str(tmp_path / d) for d in ("out", "bad", "in"))
    schema = "doc_id BIGINT, articles STRING"
    vocab = fit_vocab(spark.createDataFrame([(0, ["a"])], "doc_id BIGINT, tokens ARRAY<STRING>"))
    spark.createDataFrame([(1, f"text{i:03}") for i in range(200)] * 2, schema).write.parquet(source)
    encode_stream(spark.readStream.schema(schema).parquet(source), vocab, sink, failed, str(tmp_path / "p"), 2).awaitTermination()
    assert spark.read.parquet(sink).count() == 1
    assert {text for _, text, _ in _failed(spark, failed)} == {f"text{i:03}" for i in range(1, 200)}


def test_a_later_micro_batch_reads_no_more_than_the_second(spark, tmp_path):
    """Rows that come out of the sources of each micro-batch: the arriving ones, and of the sink what was not read before."""
    sink, failed, source = (str(tmp_path / d) for d in ("out", "bad", "in"))
    schema = "doc_id BIGINT, articles STRING"
    vocab = fit_vocab(spark.createDataFrame([(0, ["a"])], "doc_id BIGINT, tokens ARRAY<STRING>"))
    rows = []
    for n in range(5):
        spark.createDataFrame([(20 * n + i, "a") for i in range(20)], schema).coalesce(1).write.mode("append").parquet(source)
        query = encode_stream(
            spark.readStream.schema(schema).parquet(source), vocab, sink, failed, str(tmp_path / "p"), 2)
        query.awaitTermination()
        rows.append(sum(p.numInputRows for p in query.recentProgress))
        assert sum(s.numRowsTotal for s in query.lastProgress.stateOperators) == 20 * (n + 1)
    assert spark.read.parquet(sink).count() == 100
    assert rows[0] == 20 and max(rows[1:]) <= 40


def test_rows_of_one_id_stay_apart(spark, tmp_path):
    pairs = spark.createDataFrame(
        [("x", "a b c", "one"), ("x", "x y z", "two"), ("y", "a", "one")], "doc_id STRING, articles STRING, abstracts STRING")
    settings = training.Settings(document_length=4, summary_length=4, document_cap=20, summary_cap=20, batch_size=2)
    encoded = training.prepare(pairs, str(tmp_path / "v"), settings)
    assert sorted(r.doc_id for r in encoded.collect()) == ["x", "x", "y"]
    assert {len({i for i in r.input if i}) for r in encoded.collect()} == {3, 1}
    batches = training.batches_of(encoded, settings).collect()
    assert len(batches) == 3 and {(r.batch, r.place) for r in batches} == {(0, 0), (0, 1), (1, 0)}
    texts = spark.createDataFrame([(1, ["a", "b"]), (1, ["c"]), (None, ["a"]), (None, [])], "doc_id BIGINT, tokens ARRAY<STRING>")
    vocab = fit_vocab(texts.filter("doc_id = 1"))
    found = sorted((r.doc_id or 0, len(r.ids)) for r in encode(texts, vocab).collect())
    assert found == [(0, 0), (0, 1), (1, 1), (1, 2)]


def test_training_reads_the_pairs_once_for_the_fit_and_once_for_the_encoding(spark, pairs, tmp_path):
    path = str(tmp_path / "pairs")
    pairs.write.parquet(path)
    stored = spark.read.parquet(path)
    settings = training.Settings(document_length=8, summary_length=6, document_cap=12, summary_cap=8)
    training.fit_vocabularies(stored, str(tmp_path / "v"), settings)
    vocabularies = training.load_vocabularies(spark, str(tmp_path / "v"), settings)
    plan = training.encode_pairs(stored, vocabularies, settings)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("articles#") and plan.count("Relation [doc_id") == 1


def test_sliced_and_curriculum_rows(spark, pairs, tmp_path):
    settings = training.Settings(document_length=8, summary_length=6, document_cap=12, summary_cap=8, batch_size=16)
    encoded = training.prepare(pairs, str(tmp_path / "v"), settings)
    rows = training.sliced(encoded, settings, 4).collect()
    assert {len(r.inputs) for r in rows} == {4} and {len(s) for r in rows for s in r.inputs} == {2}
    assert all(m == (1.0 if i == 0 else 0.0) for r in rows for s, k in zip(r.inputs, r.masks) for i, m in zip(s, k))
    steps = training.curriculum_set(encoded, settings, epochs=2, steps=3, both=True).collect()
    assert len(steps) == 40 * 6
    orders = {(e, s): tuple(r.doc_id for r in sorted(
        (r for r in steps if (r.epoch, r.step) == (e, s)), key=lambda r: (r.batch, r.place))) for e in (1, 2) for s in (1, 2, 3)}
    assert len(set(orders.values())) == 6
    assert all(not any(r.target[2 * r.step:]) for r in steps) and all(not any(r.input[3 * r.step:]) for r in steps)


def _texts(spark, rows):
    return spark.createDataFrame([(*r, "n") for r in rows], "num INT, tag STRING, text STRING, name STRING")


def test_runs_count_once_committed_and_stay_right_when_compacted(spark, tmp_path):
    path = str(tmp_path / "pairs")
    assert results.read_pairs(spark, path).collect() == [] and results.compact_pairs(spark, path) == 0
    _texts(spark, [(1, "encoder", "stopped")]).write.partitionBy("tag").parquet(f"{path}/{results.RUN}=z")
    assert results.read_pairs(spark, path).collect() == []
    results.write_texts(_texts(spark, []), path)
    assert results.read_pairs(spark, path).collect() == []
    for text, nums in (("first", (1, 2, 3)), ("second", (2, 3)), ("third", (3,))):
        results.write_texts(_texts(spark, [(n, "encoder", text) for n in nums]), path)

    def found():
        return sorted((r.num, r.text) for r in results.read_pairs(spark, path).collect())

    expected = [(1, "first"), (2, "second"), (3, "third")]
    assert found() == expected
    assert results.compact_pairs(spark, path) == 4 and found() == expected
    assert len(results._committed(spark, path)) == 1
    results.write_texts(_texts(spark, [(1, "encoder", "fourth")]), path)
    assert found() == [(1, "fourth"), *expected[1:]]
    assert results.compact_pairs(spark, path) == 2 and found() == [(1, "fourth"), *expected[1:]]


def test_a_run_committed_during_a_compaction_stays(spark, tmp_path):
    path = str(tmp_path / "pairs")
    for text in ("a", "b"):
        results.write_texts(_texts(spark, [(1, "encoder", text), (2, "encoder", text)]), path)
    runs = results._committed(spark, path)
    results.write_texts(_texts(spark, [(1, "encoder", "c")]), path)
    last = results._latest(results._stored(spark, path, runs), ["num", "tag"])
    results._write_run(last, path, ("tag",), runs)
    assert sorted((r.num, r.text) for r in results.read_pairs(spark, path).collect()) == [(1, "c"), (2, "b")]


def test_runs_with_new_columns_and_with_other_types(spark, tmp_path):
    path = str(tmp_path / "report")
    results.write_metrics(spark.createDataFrame([(1, 0.5), (2, 0.4)], "epoch INT, loss DOUBLE"), path)
    results.write_metrics(spark.createDataFrame([(2, 0.3, 90.0)], "epoch INT, loss DOUBLE, accuracy DOUBLE"), path)
    rows = results.read_metrics(spark, path).orderBy("epoch").collect()
    assert list(map(tuple, rows)) == [(1, 0.5, None), (2, 0.3, 90.0)]
    results.write_metrics(spark.createDataFrame([("3", 0.1)], "epoch STRING, loss DOUBLE"), path)
    with pytest.raises(ValueError, match="type of epoch"):
        results.read_metrics(spark, path)
    with pytest.raises(ValueError, match="names the run"):
        results.write_metrics(spark.createDataFrame([(1, "x")], "epoch INT, run_id STRING"), path)


def test_a_stream_reads_a_table_that_is_a_folder_of_files(spark, tmp_path):
    from brevia.plans import queries

    rows = [(i, f"one two three word{i}", "en" if i % 3 else "de") for i in range(40)]
    documents = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    documents.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for query in (queries.incremental_encode, queries.incremental_encode_restarted):
        found = {r.doc_id: r.ids for r in query(spark, str(tmp_path)).collect()}
        assert set(found) == set(range(40))
        assert found == {r.doc_id: r.ids for r in queries.encode_documents(spark, str(tmp_path)).collect()}
