import json
import random

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from brevia.llm import huffman, token_files
from brevia.llm.word_tokenizer import WordTokenizer
from brevia.session import staged_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("counts", [[], [5], [0, 3, 1], [1] * 7, [2**i for i in range(30)], list(range(300))])
def test_lengths_fill_the_code_and_respect_the_limit(counts):
    lengths = huffman.code_lengths(np.array(counts, np.int64), 12)
    used = lengths[lengths > 0]
    assert len(used) == np.count_nonzero(counts) and (len(used) == 0 or used.max() <= 12)
    if len(used) > 1:
        assert sum(2.0 ** -used) == 1


def test_unlimited_lengths_cost_as_much_as_huffman():
    import heapq

    counts = np.array(random.Random(1).choices(range(1, 500), k=80))
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        cost += pair
        heapq.heappush(heap, pair)
    assert (huffman.code_lengths(counts) * counts).sum() == cost


def encoded(codec, texts):
    ids, sizes = codec.encode(pa.array(texts, pa.string()))
    return [some.tolist() for some in np.split(ids, sizes.cumsum()[:-1])] if len(sizes) else []


def test_a_slice_of_a_batch_and_no_end_id():
    texts = pa.array(["left out", "Hello there", None, "", " a  b ", "left out"])
    with_end, bare = WordTokenizer(PATH, 7), WordTokenizer(PATH)
    ids, sizes = with_end.encode(texts[1:5])
    assert sizes.tolist()[1:3] == [1, 1] and ids[sizes.cumsum() - 1].tolist() == [7] * 4
    plain, lengths = bare.encode(texts[1:5])
    assert (lengths + 1 == sizes).all() and plain.tolist() == [i for i in ids.tolist() if i != 7]
    assert encoded(with_end, []) == [] and bare.encode(pa.array([None], pa.string()))[1].tolist() == [0]


def test_other_files_go_through_the_library(tmp_path):
    from tokenizers import Tokenizer

    with open(PATH, encoding="utf-8") as file:
        said = json.load(file)
    said["normalizer"]["normalizers"].pop()  # no lower case
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(said, file)
    texts = ["Hello WORLD été", "", None, "a  B"]
    library = Tokenizer.from_file(path)
    expected = [library.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    codec = WordTokenizer(path, 1)
    assert encoded(codec, texts) == expected != encoded(WordTokenizer(PATH, 1), texts) and not codec.by_words


def test_counts_of_the_encoding_pass_are_those_of_all_ids(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} common {i}") for i in range(500)] + [(None, None)], "doc_id BIGINT, text STRING")
    found = token_files.token_ids(docs, PATH, 1, counted=True).cache()
    counts = token_files.unpacked_counts(found.select("counts").filter("counts IS NOT NULL"))
    rows = found.filter("counts IS NULL").select("doc_id", "ids")
    assert rows.count() == 501
    assert {tuple(r) for r in counts.collect()} == {tuple(r) for r in token_files.id_counts(rows).collect()}
    found.unpersist()


def test_too_many_symbols():
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, np.int64), 3)


def test_pack_and_unpack():
    pick = np.random.default_rng(0)
    ids = np.concatenate([pick.geometric(0.02, 5000), np.arange(700)])
    ids[ids > 900] = 0
    code = huffman.Code(huffman.code_lengths(np.bincount(ids)))
    ends = np.sort(np.r_[0, pick.integers(0, len(ids), 12), 7, 7, len(ids)])
    payloads, points = huffman.pack(code, ids, ends)
    sizes = np.diff(ends, prepend=0)
    assert (huffman.unpack(code.table(), code.bits, payloads, points, sizes) == ids).all()
    one = [k for k, n in enumerate(sizes) if n > 300][0]  # one sequence, from its second block on
    start = ends[one] - sizes[one]
    tail = huffman.unpack(code.table(), code.bits, [payloads[one]], [points[one][1:]], sizes[one:one + 1] - huffman.BLOCK_IDS)
    assert (tail == ids[start + huffman.BLOCK_IDS:ends[one]]).all()
    with pytest.raises(ValueError):
        huffman.pack(huffman.Code(np.array([1, 0])), np.array([1]), np.array([1]))


TEXTS = [
    "Hello, World's <|endoftext|> don't\x1cstop\x85now", "", None, "\t \n", "İstanbul ΣΑΣ J̌ é ﬁ ½", "a" * 3000,
    " ́x 漢字  テスト", "same text", "same text", "word " * 40_000,
]


def whole(texts):
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(PATH)
    one.encode_special_tokens = True
    return [one.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def test_words_give_the_ids_of_the_whole_text(monkeypatch):
    from brevia.llm import word_tokenizer

    monkeypatch.setattr(word_tokenizer, "KEPT_WORDS", 5)
    monkeypatch.setattr(word_tokenizer, "KEPT_PIECES", 3)
    codec = WordTokenizer(PATH, 1)
    every = ["".join(chr(c) for c in range(32, 256)), *(f"a{chr(c)}B'{chr(c)}S" for c in range(1, 256))]
    assert encoded(codec, every) == whole(every)
    for _ in range(3):
        assert encoded(codec, TEXTS) == whole(TEXTS)


def test_files_round_trip(spark):
    rows = [(i * 3 - 4, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (5, "tie"), (5, "tie"), (5, "other tie")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3).selectExpr("*", "1 AS part", "2 AS ids")
    path = staged_path(spark, "files")
    token_files.write_documents(df, path, PATH, 1)
    found = token_files.read_tokens(spark, path).collect()
    ids = whole([t for _, t in rows])
    expected = sorted(((d is not None, d or 0, tuple(x)) for (d, _), x in zip(rows, ids)))
    got = sorted(found, key=lambda r: r.start)
    assert sorted((r.doc_id is not None, r.doc_id or 0, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == expected
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [e[:2] for e in expected]
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])


def test_empty_table(spark):
    path = staged_path(spark, "files")
    token_files.write_documents(spark.createDataFrame([], "doc_id BIGINT, text STRING"), path, PATH, 1)
    assert token_files.read_tokens(spark, path).count() == 0
