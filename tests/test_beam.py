import math
import random

import models
import pytest
from brevia.operators import beam, joins
from pyspark.sql import functions as F

STATE = "doc_id BIGINT, key STRING, beams ARRAY<STRUCT<slot INT, tokens ARRAY<INT>, score DOUBLE>>, memory ARRAY<ARRAY<STRING>>"


def table(seed, words=9, keys=("x", "y")):
    """Random followers: some words have few of them, some equal probabilities."""
    rng = random.Random(seed)
    scores = {}
    for key in keys:
        for prev in range(2, 2 + words):
            followers = rng.sample(range(2, 2 + words), rng.randint(3 * words // 4, words) if rng.random() > 0.1 else 2)
            weights = [rng.choice([1, 1, 2, 3, 5]) for _ in followers]
            scores[key, prev] = {t: w / sum(weights) for t, w in zip(followers, weights)}
    return scores


def frames(spark, scores, words=9):
    rows = [(k, p, t, prob) for (k, p), f in scores.items() for t, prob in f.items()]
    seeds = [(i, k, 2 + i % words) for i, k in enumerate(["x", "y"] * words)]
    return (
        spark.createDataFrame(seeds, "doc_id BIGINT, key STRING, prev INT"),
        spark.createDataFrame(rows, "key STRING, prev INT, token_id INT, prob DOUBLE"),
        seeds,
    )


def check(state, scores, seeds, length, k, n, lineage=False):
    found = {}
    for row in state.collect():
        assert [b.slot for b in row.beams] == list(range(k))
        found[row.doc_id] = [(tuple(b.tokens), round(b.score, 6)) for b in row.beams]
    expected = {}
    for doc, key, start in seeds:
        beams = models.beam(scores, key, start, length, k, n, lineage)
        if beams is not None:
            expected[doc] = [(t, round(s, 6)) for t, s in beams]
    assert found == expected
    return len(expected)


@pytest.mark.parametrize("k, n, length", [(2, 2, 7), (3, 2, 6), (2, 3, 8), (2, 1, 6), (1, 2, 6)])
def test_decode_like_python(spark, k, n, length):
    scores = table(k * 10 + n, words=12)
    seeds, rows, plain = frames(spark, scores, 12)
    state = beam.beam_decode(seeds, rows, length, k, n, cut_every=2)
    assert check(state, scores, plain, length, k, n) > 0


class Backed(dict):
    """Scores of every context, known or not: the greater one of its own and the discounted tail's."""

    def __init__(self, scores, tail, discount=0.4):
        super().__init__(scores)
        self.tail = {t: discount * p for t, p in tail.items()}

    def get(self, context, default=None):
        own = super().get(context, {})
        return {t: max(own.get(t, 0.0), self.tail.get(t, 0.0)) for t in {*own, *self.tail}}


@pytest.mark.parametrize("k, n, length, memory, broadcast_rows", [
    (2, 2, 16, "slot", None), (3, 2, 14, "lineage", None), (3, 3, 9, "slot", None), (2, 1, 6, "slot", None), (2, 2, 5, "slot", 0)])
def test_a_tail_backs_off_the_scores(spark, k, n, length, memory, broadcast_rows):
    scores = {c: f for c, f in table(k + n, words=12).items() if c[1] % 4}  # some contexts are unknown
    tail = {t: w / 100 for t, w in zip(range(2, 26), [9, 9, 9, 8, 30] * 5)}
    seeds, rows, plain = frames(spark, scores, 12)
    tail_rows = spark.createDataFrame(list(tail.items()), "token_id INT, prob DOUBLE")
    state = beam.beam_decode(
        seeds, rows, length, k, n, memory=memory, cut_every=3, broadcast_rows=broadcast_rows, tail=tail_rows)
    backed = Backed(scores, tail)
    assert check(state, backed, plain, length, k, n, lineage=memory == "lineage") == len(plain)


def test_the_tail_is_cut_to_what_can_be_reached(spark):
    tail = spark.range(2, 5000).select(F.col("id").cast("int").alias("token_id"), (1 / F.col("id")).alias("prob"))
    row = beam.rank_tail(tail, 3, 20).collect()
    assert len(row) == 1 and [c.token_id for c in row[0].tail] == list(range(2, 2 + 3 * 20 + 4))


def test_a_document_fails_where_tail_and_followers_are_too_few(spark):
    seeds = spark.createDataFrame([(1, "x", 2), (2, "x", 3)], "doc_id BIGINT, key STRING, prev INT")
    rows = spark.createDataFrame([("x", 2, 5, 0.5), ("x", 3, 6, 0.5)], "key STRING, prev INT, token_id INT, prob DOUBLE")
    tail = spark.createDataFrame([(5, 0.1), (9, 0.0)], "token_id INT, prob DOUBLE")
    assert [r.doc_id for r in beam.beam_decode(seeds, rows, 2, 2, 2, tail=tail).collect()] == [2]


def test_lineage_memory(spark):
    scores = table(5, words=12)
    seeds, rows, plain = frames(spark, scores, 12)
    check(beam.beam_decode(seeds, rows, 8, 3, 2, memory="lineage"), scores, plain, 8, 3, 2, lineage=True)
    with pytest.raises(ValueError):
        beam.beam_decode(seeds, rows, 8, 3, 2, memory="other")


def test_large_candidate_table_and_hot_words(spark, monkeypatch):
    """Neither the shuffle join nor the splitting of hot words changes the result."""
    scores = table(3, words=12)
    seeds, rows, plain = frames(spark, scores, 12)
    monkeypatch.setattr(beam, "fits_broadcast", lambda *_: False)
    split = joins.skew_join
    monkeypatch.setattr(beam, "skew_join", lambda *a: split(*a, hot_rows=2))
    assert check(beam.beam_decode(seeds, rows, 5, 2, 2), scores, plain, 5, 2, 2) > 0


def test_many_blocked_candidates_need_further_pages(spark):
    """The best 20 followers are blocked: the allowed ones lie pages away."""
    followers = {t: (60 - t) / 2000 for t in range(10, 50)}
    scores = {("x", t): followers for t in [2, *range(10, 50)]}
    tokens = [2, 10]
    seen = [10 << 32 | t for t in range(11, 31)]
    state = spark.createDataFrame(
        [(1, "x", [(0, tokens, -1.0), (1, tokens, -2.0)], [seen, []])], STATE.replace("ARRAY<ARRAY<STRING>>", "ARRAY<ARRAY<BIGINT>>"))
    rows = spark.createDataFrame(
        [(k, p, t, prob) for (k, p), f in scores.items() for t, prob in f.items()],
        "key STRING, prev INT, token_id INT, prob DOUBLE",
    )
    pages = beam.page_candidates(rows, 2)
    state = state.withColumn("beams", F.transform("beams", lambda b: F.struct(
        b["slot"].alias("slot"), F.concat(F.lit([2]), b["tokens"]).alias("tokens"), b["score"].alias("score"),
        F.array(F.lit(2 << 32 | 2), F.lit(2 << 32 | 10)).alias("grams"), b["slot"].alias("parent"))))
    best = beam.topk_per_hypothesis(beam.extend(state, pages, 3, 2, 2, True, "slot"), 2).collect()
    assert {(r.slot, r.col): r.token_id for r in best} == {(0, 0): 31, (0, 1): 32, (1, 0): 11, (1, 1): 12}


def test_zero_probability_is_no_candidate(spark):
    seeds = spark.createDataFrame([(1, "x", 2), (2, "x", 3), (3, "x", 4)], "doc_id BIGINT, key STRING, prev INT")
    rows = spark.createDataFrame(
        [("x", 2, 5, 0.5), ("x", 2, 6, 0.5), ("x", 3, 5, 1.0), ("x", 3, 6, 0.0)],
        "key STRING, prev INT, token_id INT, prob DOUBLE",
    )
    state = beam.beam_decode(seeds, rows, 2, 2, 2)
    assert [r.doc_id for r in state.collect()] == [1]
    texts = state.select("doc_id", F.lit("t").alias("text"))
    errors = {r.doc_id: r.error for r in beam.beam_failures(seeds, texts, "text").collect()}
    assert errors == {1: None, 2: beam.FAILED, 3: beam.FAILED}


STOP = 7
HYPOTHESES = {
    1: [([9, 3, 7, 4], -1.0), ([9, 3, 4, 7], -1.1)],  # all stopped: the longer one wins by normalised score
    2: [([9, 3, 4, 5], -1.0), ([9, 7, 3, 7], -2.0)],  # one stopped
    3: [([9, 3, 4, 5], -1.0), ([9, 4, 3, 5], -2.0)],  # none stopped
    4: [([9, 3, 7, 7], -1.0), ([9, 4, 7, 3], -1.0)],  # equal
    5: [([9, 7, 3, 4], -1.0), ([9, 7, 4, 3], -0.5 - 0.5)],  # stop at position 1
}


@pytest.fixture(scope="module")
def hypotheses(spark):
    rows = [(d, "x", [(i, t, s) for i, (t, s) in enumerate(h)], [[], []]) for d, h in HYPOTHESES.items()]
    return spark.createDataFrame(rows, STATE)


def test_pick_best(hypotheses):
    norm = {r.doc_id: (r.slot, r.finished) for r in beam.pick_best(hypotheses, STOP).collect()}
    assert norm == {1: (1, 2), 2: (1, 1), 3: (0, 0), 4: (0, 2), 5: (0, 2)}
    assert -1.1 / 3**0.8 > -1.0 / 2**0.8
    raw = {r.doc_id: r.slot for r in beam.pick_best(hypotheses, STOP, "raw").collect()}
    assert raw == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0}
    with pytest.raises(ValueError):
        beam.pick_best(hypotheses, STOP, "other")


def test_stops(hypotheses):
    hyps = beam.hypotheses(hypotheses)
    stops = {(r.doc_id, r.slot): r.stop_at for r in beam.first_stop(hyps, STOP).collect()}
    assert stops[1, 0] == 2 and stops[2, 0] is None and stops[2, 1] == 1 and stops[5, 0] == 1
    assert dict(beam.finished_count(hyps, STOP).collect()) == {1: 2, 2: 1, 3: 0, 4: 2, 5: 2}


def test_steps_after_the_spread_need_no_shuffle(spark):
    seeds, rows, _ = frames(spark, table(1))
    state = beam.beam_decode(seeds, rows, 6, 2, 2)
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert math.isclose(plan.count("BroadcastHashJoin"), 5)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_equals_plain_join(spark, how):
    left = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 11).alias("k"))
    right = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (99, "z")], "k BIGINT, v STRING")
    plain = sorted(map(str, left.join(right, "k", how).select("id", "k", "v").collect()))
    found = joins.skew_join(left, right, ["k"], ["id"], False, how, hot_rows=20).select("id", "k", "v")
    assert sorted(map(str, found.collect())) == plain


def test_fits_broadcast(spark):
    df = spark.createDataFrame([("abc",), (None,)], "t STRING")
    assert joins.fits_broadcast(df, ("t",), rows=2, size=3)
    assert not joins.fits_broadcast(df, ("t",), rows=1) and not joins.fits_broadcast(df, ("t",), size=2)


def test_a_scorer_of_the_whole_prefix(spark):
    """The scorer forbids what the prefix holds already, which no table of the last word could."""
    words = spark.createDataFrame([(t, 0.5 - t / 100) for t in range(2, 9)], "token_id INT, prob DOUBLE")

    def scorer(hyps):
        every = F.expr("explode(sequence(2, 8))")
        rows = hyps.select("doc_id", "slot", "tokens", every.alias("token_id")).join(words, "token_id")
        return rows.filter(~F.array_contains("tokens", F.col("token_id"))).select("doc_id", "slot", "token_id", "prob")

    seeds = spark.createDataFrame([(1, "k", 2), (2, "k", 5)], "doc_id BIGINT, key STRING, prev INT")
    state = beam.beam_decode(seeds, scorer, 5, 2, 2)
    found = beam.hypotheses(state).collect()
    assert len(found) == 4 and all(len(set(r.tokens)) == 5 for r in found)
    assert {tuple(r.tokens) for r in found if r.doc_id == 1 and r.slot == 0} == {(2, 3, 4, 5, 6)}
    # Nothing is left to three of the words: the document fails and is named.
    assert beam.beam_decode(seeds, scorer, 9, 2, 2).count() == 0
    documents = spark.createDataFrame([(1,), (2,), (3,)], "doc_id BIGINT")
    lost = beam.beam_failures(documents, state.filter("doc_id = 1").select("doc_id", F.lit("t").alias("text")), "text", seeds)
    assert {r.doc_id: r.error for r in lost.collect()} == {1: None, 2: beam.FAILED, 3: beam.NOT_SEEDED}


def test_scored_and_tabled_decoding_agree(spark):
    scores = [("x", p, t, 0.3 - t / 100) for p in range(2, 8) for t in range(2, 8) if t != p]
    table = spark.createDataFrame(scores, "key STRING, prev INT, token_id INT, prob DOUBLE")

    def scorer(hyps):
        at = hyps.withColumn("prev", F.element_at("tokens", -1))
        return at.join(table, ["key", "prev"]).select("doc_id", "slot", "token_id", "prob")

    seeds = spark.createDataFrame([(i, "x", 2 + i % 4) for i in range(6)], "doc_id BIGINT, key STRING, prev INT")
    tabled, scored, large = (
        sorted(map(tuple, beam.hypotheses(beam.beam_decode(seeds, source, 6, 3, 2, **more)).collect()))
        for source, more in ((table, {}), (scorer, {}), (table, {"broadcast_rows": 0})))
    assert tabled == scored == large and tabled


def test_staged_states_replace_each_other(spark, monkeypatch):
    import glob

    from brevia import session

    folder = session.shared_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/brevia/*/beams-*"))
    scores = [("x", p, t, 0.3 - t / 100) for p in range(2, 8) for t in range(2, 8) if t != p]
    table = spark.createDataFrame(scores, "key STRING, prev INT, token_id INT, prob DOUBLE")
    seeds = spark.createDataFrame([(i, "x", 2 + i % 4) for i in range(6)], "doc_id BIGINT, key STRING, prev INT")
    state = beam.beam_decode(seeds, table, 12, 2, 3, cut_every=2)
    assert len(set(glob.glob(f"{folder}/brevia/*/beams-*")) - before) == 1
    assert beam.hypotheses(state).count() == 12


def test_documents_of_one_start_are_decoded_once(spark):
    """A scorer of key and tokens, and a table, see each start once; a scorer of documents sees every document."""
    scores = [(key, p, t, 0.3 - t / 100) for key in ("x", "y") for p in range(2, 8) for t in range(2, 8) if t != p]
    table = spark.createDataFrame(scores, "key STRING, prev INT, token_id INT, prob DOUBLE")
    seen = []

    def scorer(hyps):
        seen.append(hyps.select("doc_id").distinct().count())
        at = hyps.withColumn("prev", F.element_at("tokens", -1))
        return at.join(table, ["key", "prev"]).select("doc_id", "slot", "token_id", "prob")

    plain = [(i, "xy"[i % 2], 2 + i % 4) for i in range(40)] + [(99, None, 3), (98, None, 3)]
    seeds = spark.createDataFrame(plain, "doc_id BIGINT, key STRING, prev INT")
    tail = spark.createDataFrame([(t, 0.2) for t in range(2, 8)], "token_id INT, prob DOUBLE")

    def rows(source, **more):
        return sorted(map(tuple, beam.hypotheses(beam.beam_decode(seeds, source, 5, 3, 2, **more)).collect()))

    each = rows(scorer)
    assert len(each) == 3 * 40 and set(seen) == {40, 42}
    seen.clear()
    assert rows(beam.KeyedScorer(scorer)) == each and set(seen) == {4, 5}
    assert rows(table) == each
    # A missing key is a start of its own: the tail alone decodes it, for both of its documents.
    backed = rows(table, tail=tail)
    assert {r[0] for r in backed} == {r[0] for r in plain}
    assert [r[1:] for r in backed if r[0] == 98] == [r[1:] for r in backed if r[0] == 99]


@pytest.mark.parametrize("k, length, memory, backed", [
    (2, 16, "slot", True), (3, 14, "lineage", True), (3, 9, "slot", False), (2, 9, "lineage", False), (6, 40, "slot", True), (1, 12, "slot", True)])
def test_decoding_inside_tasks(spark, monkeypatch, k, length, memory, backed):
    """Long decodes take no Spark job for each position, and give what the steps give: beams, n-grams and memory."""
    from brevia.operators import beam_tasks

    scores = {c: f for c, f in table(k + length, words=12).items() if not backed or c[1] % 4}
    words = {t: w / 100 for t, w in zip(range(2, 26 + 4 * k), [9, 9, 9, 8, 30] * 10)}
    seeds, rows, plain = frames(spark, scores, 12)
    more = {"memory": memory}
    if backed:
        more["tail"] = spark.createDataFrame(list(words.items()), "token_id INT, prob DOUBLE")
        seeds, plain = seeds.union(spark.createDataFrame([(90, None, 3)], seeds.schema)), [*plain, (90, None, 3)]
    monkeypatch.setattr(beam_tasks, "TOGETHER", 5)
    monkeypatch.setattr(beam_tasks, "LEAST_STARTS", 4)

    def step(*_, **__):
        raise AssertionError("a step of its own")

    def known(state):
        return sorted((
            r.doc_id, r.key or "", [(b.slot, b.tokens, round(b.score, 6), b.grams, b.parent) for b in r.beams],
            [sorted(m) for m in r.memory]) for r in state.collect())

    steps = known(beam.beam_decode(seeds, rows, length, k, 2, **more)) if length < 20 else None
    with monkeypatch.context() as patch:
        patch.setattr(beam, "STEPS", 3)
        patch.setattr(beam, "beam_step", step)
        state = beam.beam_decode(seeds, rows, length, k, 2, **more)
        found = known(state)
    expected = Backed(scores, words) if backed else scores
    assert check(state, expected, plain, length, k, 2, lineage=memory == "lineage") > 0
    assert steps is None or found == steps


def test_a_key_with_too_many_candidates_is_decoded_by_steps(spark, monkeypatch):
    from brevia.operators import beam_tasks

    scores = table(3, words=12)
    seeds, rows, plain = frames(spark, scores, 12)
    monkeypatch.setattr(beam, "STEPS", 3)
    monkeypatch.setattr(beam_tasks, "TASK_CANDIDATES", 10)
    monkeypatch.setattr(beam_tasks, "decode", None)  # no depth is so small
    assert check(beam.beam_decode(seeds, rows, 6, 2, 2), scores, plain, 6, 2, 2) > 0


@pytest.mark.parametrize("whole", [10_000, 0])
def test_starts_that_need_more_candidates_than_a_cut_list_holds(spark, monkeypatch, whole):
    """With 6 of 12 candidates at hand, starts that look further are decoded again: by whole lists, or by steps."""
    from brevia.operators import beam_tasks

    scores = table(5, words=12, keys=("x",))
    seeds, rows, plain = frames(spark, scores, 12)
    seeds, plain = seeds.filter("key = 'x'"), [p for p in plain if p[1] == "x"]
    cuts, decode = [], beam_tasks.decode

    def counted(*args):
        state, cut = decode(*args)
        cuts.append((args[2], cut.count()))
        return state, cut

    monkeypatch.setattr(beam, "STEPS", 3)
    monkeypatch.setattr(beam_tasks, "TASK_CANDIDATES", 12 * 6)
    monkeypatch.setattr(beam_tasks, "WHOLE_CANDIDATES", whole)
    monkeypatch.setattr(beam_tasks, "decode", counted)
    tail = {t: 0.002 / t for t in range(2, 42)}
    tail_rows = spark.createDataFrame(list(tail.items()), "token_id INT, prob DOUBLE")
    state = beam.beam_decode(seeds, rows, 26, 2, 2, tail=tail_rows)
    assert check(state, Backed(scores, tail), plain, 26, 2, 2) == len(plain)
    assert cuts[0][0] == 6 and cuts[0][1] > 0 and len(cuts) == (2 if whole else 1)
