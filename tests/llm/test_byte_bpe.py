import hashlib

import public_tokenizers
import pytest
import regex
from brevia.llm import byte_bpe
from pyspark.sql import functions as F

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [
    "Hello  world, it's 12.5 été\n\n next", "", None, "   ", "x" * 5000, "😀 <|endoftext|> 漢字", "a\u00a0b\x1cc \x85 d",
    "it's all we've  got.\n\t It isn't 3pm yet!!  \n" * 4000, "\n" * 3000 + "end", "!?" * 4000 + "'s" * 3000, " 'll  'll\n'll",
]


def plain(text):
    codec = byte_bpe.encoding(PATH, PATTERN)
    return [i for match in regex.findall(PATTERN, text or "") for i in codec.encode_ordinary(match)]


@pytest.mark.parametrize("size", [1, 5, 64, 1 << 16])
def test_chunks_give_the_ids_of_the_whole_text(size):
    codec = byte_bpe.encoding(PATH, PATTERN)
    for text in TEXTS:
        text = (text or "")[:20_000]
        assert "".join(byte_bpe.chunks(text, size)) == text
        assert byte_bpe.ids_of(codec, text, size).tolist() == plain(text)


@pytest.mark.parametrize("group", [1, 10_000, 1 << 22])
def test_encode_and_decode(spark, monkeypatch, group):
    monkeypatch.setattr(byte_bpe, "GROUP", group)
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "same"), (None, "same")], "doc_id BIGINT, text STRING")
    df = df.withColumns({"IDS": F.lit("mine"), "found_": F.lit(1)})
    for found in (
        byte_bpe.encode_and_decode(df, PATH, PATTERN), byte_bpe.decode(byte_bpe.encode(df, PATH, PATTERN), PATH, PATTERN)
    ):
        assert {"found_", "raw"} <= set(found.columns)
        for r in found.collect():
            assert r["ids"] == plain(r.text) and bytes(r["raw"]) == (r.text or "").encode()
    digest = found.filter("doc_id = 0").select(F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256)).first()[0]
    assert digest == hashlib.sha256(",".join(map(str, plain(TEXTS[0]))).encode()).hexdigest()
    assert byte_bpe.encode_and_decode(df.limit(0), PATH, PATTERN).count() == 0


def test_decoding_part_of_a_character_and_nulls(spark):
    ids = plain("😀")
    df = spark.createDataFrame([(ids[:1],), (None,), ([],)], "ids ARRAY<INT>")
    got = [r.raw if r.raw is None else bytes(r.raw) for r in byte_bpe.decode(df, PATH, PATTERN).collect()]
    assert got[1:] == [None, b""] and "😀".encode().startswith(got[0])


LONG = 5_000_000


@pytest.mark.parametrize("run", [" " * LONG, "\n" * LONG, "\t" * LONG, " \n\t\u2003" * (LONG // 4)])
@pytest.mark.parametrize("before, after", [("", ""), ("", "end"), ("a", ""), ("it's", "b c"), ("!", "1")])
def test_very_long_white_space(run, before, after):
    """The run is one match, without its last character if a word follows; the rest is as in a text with a short run."""
    codec = byte_bpe.encoding(PATH, PATTERN)
    text = before + run + after
    found = byte_bpe.ids_of(codec, text)
    assert codec.decode_bytes(found.tolist()) == text.encode()
    piece, rest = (run[:-1], run[-1] + after) if after else (run, "")
    expected = codec.encode_ordinary(before) + codec._encode_single_piece(piece) + codec.encode_ordinary(rest)
    assert found.tolist() == expected


@pytest.mark.parametrize("n", [4095, 4096, 4097, 5000])
def test_runs_near_the_limit_equal_the_pattern(n):
    codec = byte_bpe.encoding(PATH, PATTERN)
    for text in (" " * n + "a", "a" + "\n" * n, "a" + " \n" * n + "b" + "\u3000" * n + "!" + "\x1c" * n + "c", " " * n + "\x1c"):
        assert byte_bpe.ids_of(codec, text).tolist() == plain(text)


@pytest.mark.parametrize("text", ["x" * 2_000_000, "!" * 2_000_000, "\u6f22" * 1_000_000])
def test_very_long_words(text):
    codec = byte_bpe.encoding(PATH, PATTERN)
    assert codec.decode_bytes(byte_bpe.ids_of(codec, text).tolist()) == text.encode()
