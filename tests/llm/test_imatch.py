"""I-Match fingerprints against a plain version."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from brevia.llm import imatch
from brevia.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string"


def plain_terms(text):
    spaced = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in (text or "").lower())
    return sorted({word for word in spaced.split(" ") if word}, key=str.encode)


def plain_lexicon(texts, most=imatch.MOST_SHARE, least=imatch.LEAST_SHARE):
    found = Counter(term for text in texts for term in plain_terms(text))
    return {term for term, n in found.items() if least * len(texts) <= n <= most * len(texts)}


def plain_fingerprint(text, lexicon):
    """Subset by subset, by the same numbers for a term as the operator draws."""
    words = plain_terms(text)
    words = [w for w in words if w in lexicon] or words
    keys = {w: np.array([xxhash.xxh3_64_intdigest(w.encode())], np.uint64) for w in words}
    levels = {w: imatch._levels(keys[w])[:, 0] for w in words}
    subsets = [words] + [
        [w for w in words if levels[w][draw] > level] for draw in range(imatch.DRAWS) for level in range(len(imatch.SHARES))]
    digests = [
        xxhash.xxh3_64_intdigest(b"".join(keys[w].tobytes() for w in some)) % 0xFFFF + 1 if some else 0 for some in subsets]
    return "".join(f"{d:04x}" for d in digests)


def plain_likeness(one, other):
    if one == other:
        return 1.0
    a, b = ([f[i:i + 4] for i in range(0, len(f), 4)] for f in (one, other))
    per = len(imatch.SHARES)
    some = equal = 0
    for level in range(per):
        at = range(1 + level, len(a), per)
        held = [i for i in at if a[i] != "0000" or b[i] != "0000"]
        weight = imatch.DRAWS - len(held)
        some += weight * len(held)
        equal += weight * sum(a[i] == b[i] for i in held)
    if some:
        return equal / some
    held = [i for i in range(len(a)) if a[i] != "0000" or b[i] != "0000"]
    return sum(a[i] == b[i] for i in held) / max(1, len(held))


def expected(rows):
    """What the query gives for distinct ids: rows (doc_id, text)."""
    rows = sorted(rows, key=lambda r: r[0])
    lexicon = plain_lexicon([text for _, text in rows])
    out = {}
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        text, following = text or "", following or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        marks = [plain_fingerprint(t, lexicon) for t in (text, edited, following)]
        out[doc_id] = (
            len(text), hashlib.sha256(edited.encode()).hexdigest(), marks[0], marks[1],
            pytest.approx(plain_likeness(marks[0], marks[1])), pytest.approx(plain_likeness(marks[0], marks[2])))
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.doc_id: tuple(r)[1:] for r in imatch.compare_edited(df, imatch.fit_lexicon(df)).collect()}


def test_registered_query_equals_the_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_imatch"](spark, SF_DIR).collect()}
    assert got == expected(docs)
    near = np.array([(row[4], row[5]) for row in got.values()])
    assert (near[:, 0] >= near[:, 1]).mean() > 0.95 and near[:, 0].mean() > 0.15 > near[:, 1].mean()


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "Grün, grün! ärger"), (5, "one"), (6, "x" * 3_000_000 + " tail"), (7, "one")]
    got = found(spark, rows)
    assert got == expected(rows)
    assert got[1][2] == got[2][2] == got[3][2] == "0" * len(got[1][2])
    assert got[5][2] == got[7][2] != got[4][2]


def test_copies_ties_and_unknown_ids(spark):
    rows = [(None, "alpha beta"), (3, "beta gamma"), (3, "alpha beta"), (3, "alpha beta"), (9, "delta")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = imatch.compare_edited(df, imatch.fit_lexicon(df)).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [3, 3, 3, 9] and len(got) == 5
    marks = imatch.fingerprints(df, imatch.fit_lexicon(df)).collect()
    assert len({r.fingerprint for r in marks if r.text == "alpha beta"}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_single_row_follows_itself_and_empty_table_is_empty(spark):
    assert found(spark, [(5, "one two three")])[5][5] == 1.0
    assert found(spark, []) == {}


def test_clashing_names_pass_through(spark):
    df = spark.createDataFrame([("a b", 1, "old")], "text string, key int, fingerprint string")
    row = imatch.fingerprints(df, np.zeros(0, np.uint64)).first()
    assert row.key == 1 and row.fingerprint == plain_fingerprint("a b", set())


def test_many_partitions_keep_the_order(spark):
    rows = [(i, f"word{i} word{i + 1} word{i + 2} common") for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark, rows) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_subsets_have_their_shares():
    levels = imatch._levels(np.arange(1, 100_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for at, share in enumerate(imatch.SHARES[:6]):
        assert (levels > at).mean() == pytest.approx(share, rel=0.05)
