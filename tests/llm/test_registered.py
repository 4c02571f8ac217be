"""The registered queries over whole tables of the smallest data, against plain versions."""

import hashlib
import os
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import regex
from brevia.llm import byte_bpe, line_dedup, mixing
from brevia.llm.queries import QUERIES, TRAP, bpe_settings

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()


def rows(spark, name, key="doc_id"):
    return {r[key]: r for r in QUERIES[name](spark, SF_DIR).collect()}


def held_out(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_language_id(spark, docs):
    found = rows(spark, "op2_language_id")
    assert len(found) == len(docs) and all(r.held_out == (held_out(d, 4) == 2) for d, r in found.items())
    right = [found[r.doc_id].lang_pred == r.lang for r in docs if found[r.doc_id].held_out]
    assert np.mean(right) > 0.9


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    codec = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    codec.encode_special_tokens = True
    found, start = rows(spark, "op3_token_files"), 0
    for r in sorted(docs, key=lambda r: r.doc_id):
        ids = codec.encode(r.text or "", add_special_tokens=False).ids + [1]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert tuple(found[r.doc_id])[1:] == (start, len(ids), crc)
        start += len(ids)


def test_quality_rules(spark, docs):
    found = rows(spark, "op4_quality_rules")
    for r in docs:
        words, lines = brute.words(r.text), [x for x in (r.text or "").split("\n") if brute.words(x)]
        repeated = brute.repeated_words(r.text)
        failed = len(words) < 20 or 100 * repeated > 30 * len(words)
        got = found[r.doc_id]
        assert tuple(got)[1:7] == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)),
            repeated, failed)
        assert not (got.kept and failed)


def test_simhash(spark, docs):
    found = rows(spark, "op5_simhash")
    prints = {r.doc_id: brute.fingerprint(r.text) for r in docs}
    classes = brute.classes(sorted(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 4)
    assert {d: (r.fingerprint, r.component_id) for d, r in found.items()} == {
        d: (f"{p:016x}", classes[d]) for d, p in prints.items()}


def test_byte_bpe(spark, docs):
    path, pattern = bpe_settings()
    codec, found = byte_bpe.encoding(path, pattern), rows(spark, "op7_byte_bpe")
    for r in docs:
        ids = [i for match in regex.findall(pattern, r.text or "") for i in codec.encode_ordinary(match)]
        sha = [hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), (r.text or "").encode())]
        assert tuple(found[r.doc_id])[1:] == (len(ids), *sha)


def test_nn_descent(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    found = rows(spark, "op8_nn_descent", "vec_id")
    expected = brute.embedding_links(vectors)
    assert {v: (r.n_links, r.component_id, r.kept) for v, r in found.items()} == {
        v: (n, c, v == c) for v, (n, c) in expected.items()}


def test_quality_model(spark, docs):
    found = rows(spark, "op9_quality_model")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    assert len(found) == len(docs) and all(r.held_out == (held_out(d, 5) == 0) for d, r in found.items())
    assert all(r.predicted == (r.score >= 0.3) for r in found.values())
    right = [found[d].predicted == q for d, q in labels.items() if d in found and found[d].held_out]
    assert np.mean(right) > 0.85


def test_chat_format(spark):
    found = rows(spark, "op10_chat_format", "conv_id")
    by = {-7: [("user", TRAP), ("assistant", TRAP)]}
    turns = spark.read.parquet(f"{SF_DIR}/conversations.parquet").collect()
    for r in sorted(turns, key=lambda r: (r.conv_id, r.turn, r.role, r.text or "")):
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert set(found) == set(by)
    for conv_id, said in by.items():
        learnt = "".join(text for role, text in said if role == "assistant")
        assert tuple(found[conv_id])[1:5] == (
            len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(),
            len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_pipeline_stage_by_stage(spark, docs):
    import corpus_pipeline
    from brevia.llm import language_id

    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language ID", "line dedup", "SimHash near-dedup", "mixing sources to target weights",
        "byte-level BPE encoding and decoding"]
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stages = [work for _, work in corpus_pipeline.STAGES]
    work = stages[0](spark, table, SF_DIR)
    accepted = {r.doc_id for r in language_id.identify(table, language_id.fit(table)).filter("accepted").collect()}
    assert {r.doc_id for r in work.collect()} == accepted and len(accepted) > 0.95 * len(docs)
    before = {r.doc_id: r for r in work.collect()}

    work = stages[1](spark, work, SF_DIR)
    after = {r.doc_id: r for r in work.collect()}
    cut = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(
        spark.createDataFrame(list(before.values()), table.schema)).collect()}
    assert {d: r.text for d, r in after.items()} == cut and after.keys() == before.keys()

    work = stages[2](spark, work, SF_DIR)
    prints = {d: brute.fingerprint(r.text) for d, r in after.items()}
    classes = brute.classes(sorted(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 4)
    single = {r.doc_id: r for r in work.collect()}
    assert set(single) == set(classes.values()) and work.count() == len(single)
    assert all(single[d].text == after[d].text for d in single)

    planned = {r.doc_id: r.copies for r in mixing.with_copies(work).collect()}
    work = stages[3](spark, work, SF_DIR)
    emitted = [r.doc_id for r in work.collect()]
    assert {d: emitted.count(d) for d in planned} == planned
    assert work.columns == table.columns

    last = stages[4](spark, work, SF_DIR).collect()
    codec = byte_bpe.encoding(*bpe_settings())
    assert len(last) == len(emitted) and all(
        r.ids == codec.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() for r in last)
    run = corpus_pipeline.run(spark, SF_DIR)
    assert sorted((r.doc_id, r.n_tokens) for r in run.collect()) == sorted((r.doc_id, r.n_tokens) for r in last)


def test_stages_on_an_empty_table(spark):
    import corpus_pipeline

    work = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        work = stage(spark, work, SF_DIR)
    assert work.count() == 0
