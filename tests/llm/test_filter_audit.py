"""The filter audit against its definition, order by order."""

import itertools
import math
import re
from fractions import Fraction

import pytest
from brevia.llm import filter_audit as audit
from brevia.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
DOCS, LABELS = "doc_id bigint, text string, lang string", "doc_id bigint, quality int, toxic int"


def fails(rows):
    """For each row the set of failed filters."""
    texts = [(i, text or "") for i, text, _ in rows]
    for doc_id, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
               "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
               "E": doc_id is not None and any(i is not None and i < doc_id and t == text for i, t in texts)}
        yield {f for f, failed in bad.items() if failed}


def plain(rows, labels):
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failed, out = list(fails(rows)), {}
    for part in {lang or "" for _, _, lang in rows}:
        own = [(r[0], f) for r, f in zip(rows, failed) if (r[2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, start=1):
                gone = [(i, fs) for i, fs in left if f in fs]
                left = [(i, fs) for i, fs in left if f not in fs]
                total[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in fs for _, fs in own) - len(gone), sum(fs == {f} for _, fs in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (name, order, step), row in out.items():
            if name == part:
                row.append(total[order[step - 1]])
    return out


def collected(df):
    return {(r.part, r.filter_order, r.step): list(r)[3:] for r in df.collect()}


def test_registered_query_equals_the_definition(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()]
    assert collected(QUERIES["op13_filter_audit"](spark, SF_DIR)) == plain(docs, labels)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [
        (1, None, "en"), (2, "", None), (3, "", ""), (4, long, "en"), (5, long, "de"), (5, long, "de"), (6, long + " #", None),
        (7, "ABC " * 300, "en"), (None, long, "en"), (None, None, "fr"), (8, "x" * 2_000_000, "fr"), (9, " \t\r\n\x0b\x0c", "fr"),
        (10, "a b c " * 150, "fr"),
    ]
    labels = [(4, 1, 0), (4, 0, 1), (5, 1, None), (None, 1, 1), (99, 1, 1), (7, None, 1)]
    found = audit.audit(
        spark.createDataFrame([(*d, 1) for d in docs], DOCS + ", mask int"), spark.createDataFrame(labels, LABELS))
    assert collected(found) == plain(docs, labels)


def test_empty_table(spark):
    assert audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []


def test_hot_text_is_split(spark, monkeypatch):
    """A text that most documents share, joined as if nothing could be broadcast."""
    monkeypatch.setattr(audit, "fits_broadcast", lambda *args: False)
    docs = [(i, "same", "en") for i in range(60)] + [(100 + i, f"other {i}", "de") for i in range(30)]
    labels = [(i, i % 2, 0) for i in range(0, 90, 3)]
    found = audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert collected(found) == plain(docs, labels)


def test_least_squares_gives_the_mean_over_orders():
    counts = [(7 * i * i + 3 * i) % 23 for i in range(32)]
    removed = audit.removed_by(counts)
    for bit, value in enumerate(audit.shapley_values(removed)):
        total = 0
        for order in itertools.permutations(range(5)):
            before = sum(1 << i for i in order[:order.index(bit)])
            total += removed[before | 1 << bit] - removed[before]
        assert value == Fraction(total, math.factorial(5))


def test_a_part_without_failures_has_zeros():
    rows = list(audit.audit_part([4] + [0] * 31, [1] + [0] * 31, [0] * 32))
    assert len(rows) == 600 and all(row[2:] == (4, 0, 0, 0, 0, 0, 0) for row in rows)


@pytest.mark.parametrize("text,bits", [("", 1), ("a " * 300, 2), ("#", 1 + 8), ("A", 1 + 4)])
def test_bits(spark, text, bits):
    from pyspark.sql import functions as F

    assert spark.range(1).select(audit.failures(F.lit(text)).alias("m")).first().m == bits
