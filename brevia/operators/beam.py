"""Beam decoding of many documents together over a table of scored candidates.

``scores(key, prev, token_id, prob)`` holds the probability of each word after ``prev`` for a document or for any group
of documents. It may be filled by any job. A scorer that needs more than the last word is given as a function instead: it
gets ``doc_id, key, slot, tokens`` of all open hypotheses and returns ``doc_id, slot, token_id, prob``. One that looks at
key and tokens only is given as a ``KeyedScorer``. By such a scorer, and by a table, documents with the same key and start
word have the same beams: each start is decoded once, however many documents share it.

A table of one shared distribution, the tail, may back it off: then each word's probability is the greater one of its own
after ``prev`` and the discounted one of the tail, and no hypothesis runs out of words.

State between steps is one row per document: ``beams``, its k hypotheses in slot order, and ``memory``, the n-grams seen
in each slot. A hypothesis carries its own n-grams and the slot that it comes from, so a step adds one n-gram to a slot
whose hypothesis goes on, and takes those of another one as they are. All are bounded by k and the summary length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from brevia.constants import BEAM_WIDTH, LENGTH_ALPHA, NGRAM_SIZE, SUMMARY_LENGTH
from brevia.functions.scoring import SCORE_DIGITS, length_norm, log_prob, rank_score
from brevia.functions.sequences import first_position
from brevia.operators import beam_tasks
from brevia.operators.joins import BROADCAST_BYTES, BROADCAST_ROWS, fits_broadcast, skew_join
from brevia.session import restage, stage

# Documents per task: the state of a document grows with every step, so tasks are cut by documents and not by bytes.
TASK_DOCUMENTS = 20_000

# Decodes of more positions are run to the end inside tasks: Spark plans and runs each step of the others.
STEPS = 32

# What the tail's probabilities count for beside those after a word.
DISCOUNT = 0.4

FAILED = "fewer than k candidates"
NOT_SEEDED = "no start word"


Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class KeyedScorer:
    """A scorer that gives hypotheses of the same key and tokens the same probabilities, whatever their document."""

    score: Scorer

    def __call__(self, hyps: DataFrame) -> DataFrame:
        return self.score(hyps)


def page_rows(k: int) -> int:
    """Candidates per page: enough for k and a few blocked ones."""
    return 2 * (k + 1)


def rank_candidates(scores: DataFrame) -> DataFrame:
    """Candidates of each (key, prev) ranked by falling probability, ties to the lower id.

    A group holds each word of the vocabulary at most once.
    """
    group = Window.partitionBy("key", "prev").orderBy(F.col("prob").desc(), "token_id")
    return scores.filter(F.col("prob") > 0).select(
        "key", "prev", F.row_number().over(group).alias("rank"), "token_id", log_prob(F.col("prob")).alias("log_prob"), "prob"
    )


def page_candidates(scores: DataFrame, k: int) -> DataFrame:
    """Ranked candidates in numbered pages, one row per (key, prev, page) with at most ``page_rows(k)`` of them.

    A hypothesis reads as many pages as it can need, which is nearly always one.
    """
    page = F.floor((F.col("rank") - 1) / F.lit(page_rows(k))).cast("int")
    entries = F.sort_array(F.collect_list(F.struct("rank", "token_id", "log_prob", "prob")))
    return rank_candidates(scores).groupBy("key", "prev", page.alias("page")).agg(entries.alias("cands"))


def rank_tail(tail: DataFrame, k: int, length: int, discount: float = DISCOUNT) -> DataFrame:
    """One row with the first words of the tail (``token_id, prob``), ranked and discounted, in ``tail``.

    All hypotheses of a document together gain k n-grams a step, so no slot can block more than k times the length: that many
    words and k more are all that a hypothesis can ever reach, however large the vocabulary is.
    """
    prob = F.col("prob") * F.lit(discount)
    first = tail.filter(F.col("prob") > 0).orderBy(F.col("prob").desc(), "token_id").limit(k * length + k + 1)
    entry = F.struct((-prob).alias("order"), "token_id", log_prob(prob).alias("log_prob"), prob.alias("prob"))
    return first.agg(F.sort_array(F.collect_list(entry)).alias("tail"))


def candidate_join(hyps: DataFrame, pages: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """Hypotheses with their candidate pages. Many documents may stand at the same word of the same key."""
    return skew_join(hyps, pages, ["key", "prev", "page"], ["doc_id"], small, how)


def _gram_type(n: int) -> str:
    return "bigint" if n == 2 else "string"


def _gram(n: int, words: str, last: str) -> str:
    """SQL for the n-gram of the last n - 1 of ``words`` and ``last``: two ids make one number, more of them a text."""
    return f"({_gram_prefix(n, words)} | cast({last} AS bigint))" if n == 2 else (
        f"concat({_gram_prefix(n, words)}, cast({last} AS string))")


def _gram_prefix(n: int, words: str) -> str:
    if n == 2:
        return f"shiftleft(cast(element_at({words}, -1) AS bigint), 32)"
    return f"concat(array_join(cast(slice({words}, -{n - 1}, {n - 1}) AS array<string>), ' '), ' ')"


def gram_texts(grams: str, n: int) -> Column:
    """The n-grams of a column as ids joined by spaces."""
    if n != 2:
        return F.col(grams)
    return F.expr(f"transform({grams}, g -> concat(shiftright(g, 32), ' ', g & 4294967295))")


def _first_beam(n: int, slot: str, start: str, token: str, score: str) -> str:
    """SQL for a hypothesis of a start word and its first follower."""
    grams = f"array({_gram(n, f'array({start})', token)})" if n == 2 else "array()"
    return f"""named_struct('slot', cast({slot} AS int), 'tokens', array({start}, {token}), 'score', {score},
                            'grams', cast({grams} AS array<{_gram_type(n)}>), 'parent', cast({slot} AS int))"""


def _with_memory(state: DataFrame, k: int, n: int) -> DataFrame:
    return state.withColumn("memory", F.array_repeat(F.array().cast(f"array<{_gram_type(n)}>"), k))


def _backed(own: str, k: int) -> str:
    """SQL for the k best of the ``own`` candidates and those of ``tail``, each word once with its better probability; ties
    go to the lower id."""
    entries = f"""sort_array(concat(transform({own}, c -> named_struct(
        'order', -c.prob, 'token_id', c.token_id, 'log_prob', c.log_prob, 'prob', c.prob)), tail))"""
    return f"""aggregate({entries}, slice(tail, 1, 0), (found, c) -> if(
        size(found) >= {k} OR exists(found, f -> f.token_id = c.token_id), found, array_append(found, c)))"""


def beam_seed(
    seeds: DataFrame, pages: DataFrame, k: int = BEAM_WIDTH, small: bool = True, n: int = NGRAM_SIZE,
    tail: DataFrame | None = None,
) -> DataFrame:
    """The k best first words of each document (``doc_id``, ``key``, ``prev`` = its start word), slot = rank.

    Nothing is blocked here. A document with fewer than k candidates is left out.
    """
    starts = seeds.select("doc_id", "key", "prev", F.lit(0).alias("page"))
    if tail is None:
        firsts = candidate_join(starts, pages, small).withColumn("first", F.slice("cands", 1, k))
    else:
        firsts = candidate_join(starts, pages, small, "left").join(F.broadcast(tail))
        own = f"coalesce(slice(cands, 1, {k}), array())"
        firsts = firsts.withColumn("tail", F.slice("tail", 1, k)).withColumn("first", F.expr(_backed(own, k)))
    beams = f"transform(first, (c, place) -> {_first_beam(n, 'place', 'prev', 'c.token_id', 'c.log_prob')})"
    state = firsts.filter(F.size("first") >= k).selectExpr("doc_id", "key", f"{beams} AS beams")
    return _with_memory(state, k, n)


def open_slots(state: DataFrame, position: int, n: int, memory: str = "slot") -> DataFrame:
    """One row per hypothesis about to be extended at ``position``, with its slot's n-gram memory.

    From position n + 1 on, and only for n > 1, the n-grams of the hypothesis now in a slot are in that slot's memory: the
    new one is added where it goes on from this slot, and all it has where it comes from another. The memory stays with
    the slot when hypotheses move (``slot``) or is that of the hypothesis (``lineage``).
    """
    if memory not in ("slot", "lineage"):
        raise ValueError("memory must be slot or lineage")
    seen = "b.memory"
    if n > 1 and position >= n + 1:
        last = "element_at(b.beams.grams, -1)"
        follows = f"b.beams.parent = slot AND {position} > {n + 1}"
        added = f"if(array_contains(b.memory, {last}), b.memory, array_append(b.memory, {last}))"
        seen = "b.beams.grams" if memory == "lineage" else f"if({follows}, {added}, array_union(b.memory, b.beams.grams))"
    return state.selectExpr("doc_id", "key", "posexplode(arrays_zip(beams, memory)) AS (slot, b)").selectExpr(
        "doc_id", "key", "slot", "b.beams.tokens AS tokens", "b.beams.score AS score", "b.beams.grams AS grams",
        f"{seen} AS seen", "element_at(b.beams.tokens, -1) AS prev",
    )


def blocked_ids(n: int) -> str:
    """SQL for the ids that would complete an n-gram of a slot's memory after the ``prefix`` of its hypothesis."""
    if n == 2:
        return "transform(filter(seen, g -> shiftright(g, 32) = prev), g -> cast(g & 4294967295 AS int))"
    return "transform(filter(seen, g -> startswith(g, prefix)), g -> cast(substring(g, length(prefix) + 1) AS int))"


def _opened(state: DataFrame, position: int, n: int, memory: str) -> tuple[DataFrame, str, str]:
    """``open_slots``, the number of candidates that are blocked at most, and the filter of the allowed ones: those that
    neither repeat the last word nor complete a seen n-gram. The memory is gone through once for each hypothesis."""
    hyps = open_slots(state, position, n, memory)
    if n < 2 or position < n + 1:
        return hyps, "0", "{}"
    hyps = hyps.selectExpr("*", f"{_gram_prefix(n, 'tokens')} AS prefix").selectExpr("*", f"{blocked_ids(n)} AS banned")
    return hyps, "1 + size(banned)", "filter({}, c -> c.token_id <> prev AND NOT array_contains(banned, c.token_id))"


_PAGE = "array<struct<rank:int,token_id:int,log_prob:double,prob:double>>"
_TAIL = "array<struct<order:double,token_id:int,log_prob:double,prob:double>>"


def extend(
    state: DataFrame, pages: DataFrame, position: int, k: int, n: int, small: bool, memory: str,
    tail: DataFrame | None = None,
) -> DataFrame:
    """Per hypothesis and page read: the allowed candidates among which its k best are, in ``best``, and of the tail in
    ``tail``.

    Blocked candidates are at most the last word and the seen n-grams that start with the hypothesis's last n - 1 words,
    so that many more than k are read and the k best allowed ones are always among them. The tail goes with the first page.
    """
    hyps, blocked, allowed = _opened(state, position, n, memory)
    last_page = f"cast(floor(({blocked} + {k - 1}) / {page_rows(k)}) AS int)"
    hyps = hyps.selectExpr("*", f"explode(sequence(0, {last_page})) AS page")
    read = candidate_join(hyps, pages, small, "inner" if tail is None else "left")
    columns = ["doc_id", "key", "slot", "page", "tokens", "score", "grams", "seen"]
    if tail is None:
        return read.selectExpr(*columns, f"slice({allowed.format('cands')}, 1, {k}) AS best", f"cast(array() AS {_TAIL}) AS tail")
    own = f"coalesce(slice({allowed.format('cands')}, 1, {k}), cast(array() AS {_PAGE}))"
    ahead = allowed.format(f"slice(tail, 1, {blocked} + {k})")
    return read.join(F.broadcast(tail)).selectExpr(
        *columns, f"{own} AS best", f"if(page = 0, slice({ahead}, 1, {k}), cast(array() AS {_TAIL})) AS tail")


def _best_scored(hyps: DataFrame, scorer: Scorer, k: int, allowed: Column | None = None) -> DataFrame:
    """The hypotheses with their k best allowed candidates in ``best``; ties go to the lower id."""
    scored = scorer(hyps.select("doc_id", "key", "slot", "tokens")).filter(F.col("prob") > 0)
    rows = hyps.join(scored, ["doc_id", "slot"])
    rows = rows if allowed is None else rows.filter(allowed)
    order = Window.partitionBy("doc_id", "slot").orderBy(F.col("prob").desc(), "token_id")
    top = rows.select("doc_id", "slot", "token_id", "prob", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= k)
    entry = F.struct("rank", "token_id", log_prob(F.col("prob")).alias("log_prob"), "prob")
    best = top.groupBy("doc_id", "slot").agg(F.sort_array(F.collect_list(entry)).alias("best"))
    return hyps.join(best, ["doc_id", "slot"], "left")


def extend_scored(state: DataFrame, scorer: Scorer, position: int, k: int, n: int, memory: str) -> DataFrame:
    """``extend`` with a scorer: all candidates of a hypothesis are at hand, so none is read in pages."""
    hyps, _, allowed = _opened(state, position, n, memory)
    if allowed != "{}":
        word = "named_struct('token_id', token_id)"
        allowed = F.expr(f"size({allowed.format(f'array({word})')}) > 0")
    found = _best_scored(hyps, scorer, k, None if isinstance(allowed, str) else allowed)
    return found.select(
        "doc_id", "key", "slot", F.lit(0).alias("page"), "tokens", "score", "grams", "seen",
        F.coalesce("best", F.expr(f"cast(array() AS {_PAGE})")).alias("best"), F.expr(f"cast(array() AS {_TAIL})").alias("tail"),
    )


def _decode_scored(seeds: DataFrame, scorer: Scorer, length: int, k: int, n: int, memory: str) -> DataFrame:
    """Decode with a scorer. It reads the state as well as the step, so the state is staged after each one."""
    first = seeds.select("doc_id", "key", F.lit(0).alias("slot"), F.array("prev").alias("tokens"))
    beams = f"transform(best, c -> {_first_beam(n, 'c.rank - 1', 'tokens[0]', 'c.token_id', 'c.log_prob')})"
    state = _best_scored(first, scorer, k).filter(F.size("best") >= k).selectExpr("doc_id", "key", f"{beams} AS beams")
    state = restage(_with_memory(state, k, n), "beams")
    for position in range(2, length):
        state = restage(merge_topk(extend_scored(state, scorer, position, k, n, memory), k, n), "beams", state)
    return state


def _hypothesis_pages(extended: DataFrame) -> DataFrame:
    """One row per document with its hypotheses' pages in slot and page order: ``rows``; and the first ones: ``heads``.

    A document has k hypotheses of mostly one page, each with at most k candidates.
    """
    row = F.expr("sort_array(collect_list(struct(slot, page, tokens, score, grams, seen, best, tail)))")
    documents = extended.groupBy("doc_id", "key").agg(row.alias("rows"))
    return documents.selectExpr("doc_id", "key", "rows", "filter(rows, r -> r.page = 0) AS heads")


def _topk_of_head(k: int) -> str:
    """SQL for the k best allowed candidates of hypothesis ``h`` over all its pages."""
    return f"slice(flatten(transform(filter(rows, r -> r.slot = h.slot), r -> r.best)), 1, {k})"


def topk_per_hypothesis(extended: DataFrame, k: int) -> DataFrame:
    """The k best allowed candidates of each hypothesis, numbered by ``col`` from 0."""
    tops = f"inline(transform(heads, h -> named_struct('slot', h.slot, 'top', {_topk_of_head(k)})))"
    hyps = _hypothesis_pages(extended).selectExpr("doc_id", tops)
    return hyps.selectExpr("doc_id", "slot", "posexplode(top) AS (col, c)").selectExpr(
        "doc_id", "slot", "col", "c.token_id", "c.log_prob"
    )


def merge_topk(extended: DataFrame, k: int, n: int = NGRAM_SIZE, backed: bool = False) -> DataFrame:
    """Best k of each document's candidates, k for each hypothesis; ties go to the lower slot, then the better candidate.

    Totals are ranked rounded: sums of logarithms may differ in the last bit between orders of addition. A document in
    which some hypothesis has fewer than k candidates is left out: it has failed. With ``backed`` a word may be both a
    hypothesis's own candidate and one of the tail: its better probability counts.
    """
    own = f"transform(heads, h -> transform({_topk_of_head(k)}, (c, col) -> named_struct({{}})))"
    total = f"'order', -round(h.score + c.log_prob, {SCORE_DIGITS}), 'slot', h.slot, "
    rest = "'token_id', c.token_id, 'total', h.score + c.log_prob"
    enough = f"size(merged) = {k * k}"
    if backed:
        fields = f"{total}'col', -c.prob, {rest}"
        words = "transform(filter(merged, m -> m.slot = h.slot), m -> m.token_id)"
        merged = f"sort_array(flatten(concat({own.format(fields)}, transform(heads, h -> transform(h.tail, c -> named_struct({fields}))))))"
        enough = f"forall(heads, h -> size(h.tail) >= {k} OR size(array_distinct({words})) >= {k})"
        best = f"""aggregate(merged, slice(merged, 1, 0), (found, c) -> if(size(found) >= {k} OR exists(
            found, f -> f.slot = c.slot AND f.token_id = c.token_id), found, array_append(found, c)))"""
    else:
        merged = f"sort_array(flatten({own.format(f'{total}{chr(39)}col{chr(39)}, col, {rest}')}))"
        best = f"slice(merged, 1, {k})"
    gram = _gram(n, "heads[m.slot].tokens", "m.token_id")
    grams = "heads[m.slot].grams"
    if n > 1:
        # Later on a hypothesis has no n-gram twice.
        grams = f"""if(size(heads[m.slot].tokens) + 1 < {n} OR (
            size(heads[m.slot].tokens) <= {n} AND array_contains({grams}, {gram})), {grams}, array_append({grams}, {gram}))"""
    beams = f"""transform({best}, (m, place) -> named_struct(
        'slot', place, 'tokens', array_append(heads[m.slot].tokens, m.token_id), 'score', m.total, 'grams', {grams},
        'parent', m.slot))"""
    documents = _hypothesis_pages(extended).selectExpr("doc_id", "key", "heads", f"{merged} AS merged")
    return documents.filter(enough).selectExpr(
        "doc_id", "key", f"{beams} AS beams", "transform(heads, h -> h.seen) AS memory"
    )


def beam_step(
    state: DataFrame, pages: DataFrame, position: int, k: int = BEAM_WIDTH, n: int = NGRAM_SIZE, small: bool = True,
    memory: str = "slot", tail: DataFrame | None = None,
) -> DataFrame:
    """Extend every document's hypotheses by one word at ``position``."""
    return merge_topk(extend(state, pages, position, k, n, small, memory, tail), k, n, tail is not None)


def beam_decode(
    seeds: DataFrame, scores: DataFrame | Scorer, length: int = SUMMARY_LENGTH, k: int = BEAM_WIDTH, n: int = NGRAM_SIZE,
    memory: str = "slot", cut_every: int = 4, broadcast_rows: int | None = None, tail: DataFrame | None = None,
    discount: float = DISCOUNT,
) -> DataFrame:
    """Decode every document to ``length`` positions. Finished hypotheses keep growing past their stop.

    Candidates are ranked once. Documents are spread once by their number; with broadcast candidates the following steps
    need no shuffle. Every ``cut_every`` steps, or after every one when the candidates are too many to broadcast, the
    state is staged in place of the one before, so the plan stays short. ``scores`` may be a function, see above. ``tail``
    (``token_id, prob``) backs the scores of a table off, see above; it is never joined with the contexts. Documents that
    fail are absent from the result; ``beam_failures`` names them and their cause.
    """
    seeds = stage(seeds.select("doc_id", "key", "prev"), "seeds")
    if not callable(scores) or isinstance(scores, KeyedScorer):
        number = F.monotonically_increasing_id().alias("doc_id")
        starts = stage(seeds.select("key", "prev").distinct().select(number, "key", "prev"), "starts")
        found = starts.count()
        if found < seeds.count():
            return _shared(seeds, starts, found, _decode(
                starts, scores, length, k, n, memory, cut_every, broadcast_rows, tail, discount), length, k)
    return _decode(seeds, scores, length, k, n, memory, cut_every, broadcast_rows, tail, discount)


def _shared(seeds: DataFrame, starts: DataFrame, found: int, state: DataFrame, length: int, k: int) -> DataFrame:
    """The beams of every start for each of its documents. A start that very many documents share is split.

    A key may be null, so starts are met as structs, which are equal where both are null.
    """
    start = F.struct("key", "prev").alias("start")
    beams = state.drop("key").join(starts.select("doc_id", start), "doc_id").drop("doc_id")
    # Tokens, n-grams and memory of k hypotheses, at 16 bytes an entry.
    small = found * 16 * k * length * (k + 1) <= BROADCAST_BYTES
    return skew_join(seeds.select("doc_id", "key", start), beams, ["start"], ["doc_id"], small).select(
        "doc_id", "key", "beams", "memory")


def _decode(
    seeds: DataFrame, scores: DataFrame | Scorer, length: int, k: int, n: int, memory: str, cut_every: int,
    broadcast_rows: int | None, tail: DataFrame | None, discount: float,
) -> DataFrame:
    """``beam_decode`` of staged seeds, each for itself."""
    if callable(scores):
        return _decode_scored(seeds, scores, length, k, n, memory)
    tail = None if tail is None else stage(rank_tail(tail, k, length, discount), "tail")
    if n == 2 and length > STEPS and broadcast_rows is None:
        reach = k * length + k + 1
        contexts = stage(beam_tasks.contexts_of(rank_candidates(scores), reach), "contexts", "zstd")
        depth, found, again = beam_tasks.depth_of(contexts, reach, page_rows(k))
        if depth is not None:
            state, cut = beam_tasks.decode(seeds, contexts, depth, found, tail, length, k, memory)
            if depth == reach or cut.isEmpty():
                return state
            rest = stage(seeds.join(cut, "doc_id", "left_semi"), "rest")
            if again:
                return state.unionByName(beam_tasks.decode(rest, contexts, reach, found, tail, length, k, memory)[0])
            return state.unionByName(_steps(rest, scores, length, k, n, memory, cut_every, broadcast_rows, tail))
    return _steps(seeds, scores, length, k, n, memory, cut_every, broadcast_rows, tail)


def _steps(
    seeds: DataFrame, scores: DataFrame, length: int, k: int, n: int, memory: str, cut_every: int, broadcast_rows: int | None,
    tail: DataFrame | None,
) -> DataFrame:
    """``_decode`` over a table of scores, each position by a step of its own; ``tail`` is ranked."""
    pages = stage(page_candidates(scores, k), "candidates")
    limit = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    small = fits_broadcast(pages, ("key",), limit // page_rows(k))
    cores = seeds.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-seeds.count() // TASK_DOCUMENTS))
    state, staged = beam_seed(seeds.repartition(tasks, "doc_id"), pages, k, small, n, tail), None
    for step, position in enumerate(range(2, length), start=1):
        state = beam_step(state, pages, position, k, n, small, memory, tail)
        if position < length - 1 and (not small or step % cut_every == 0):
            staged = restage(state, "beams", staged)
            state = staged.repartition(tasks, "doc_id")
    return state


def hypotheses(state: DataFrame) -> DataFrame:
    """One row per hypothesis."""
    return state.select("doc_id", F.explode("beams").alias("b")).select("doc_id", "b.slot", "b.tokens", "b.score")


def first_stop(hyps: DataFrame, stop: Column | int) -> DataFrame:
    """Position of the first stop of each hypothesis, NULL where it has none."""
    return hyps.withColumn("stop_at", first_position(F.col("tokens"), stop))


def finished_count(hyps: DataFrame, stop: Column | int) -> DataFrame:
    """Hypotheses of each document that hold a stop."""
    return first_stop(hyps, stop).groupBy("doc_id").agg(F.count("stop_at").alias("finished"))


def pick_best(
    state: DataFrame, stop: Column | int, mode: str = "length_norm", alpha: float = LENGTH_ALPHA
) -> DataFrame:
    """One hypothesis per document, chosen inside its row.

    When all have a stop: the highest length-normalised score (``length_norm``, ties to the lower slot) or slot 0
    (``raw``). Otherwise the lowest slot with a stop, else slot 0.
    """
    if mode not in ("length_norm", "raw"):
        raise ValueError("mode must be length_norm or raw")
    ends = F.transform("beams", lambda b: F.struct(
        b["slot"].alias("slot"), b["tokens"].alias("tokens"), b["score"].alias("score"),
        first_position(b["tokens"], stop).alias("stop_at"),
    ))
    rows = state.withColumn("_ends", ends)
    stopped = F.filter("_ends", lambda b: b["stop_at"].isNotNull())
    rows = rows.withColumn("finished", F.size(stopped))
    all_done = F.col("finished") == F.size("_ends")
    by_norm = F.array_sort(F.transform("_ends", lambda b: F.struct(
        (-rank_score(length_norm(b["score"], b["stop_at"], alpha))).alias("rank"), b["slot"].alias("slot")
    )))
    best = F.get(by_norm, 0)["slot"] if mode == "length_norm" else F.lit(0)
    fallback = F.coalesce(F.get(stopped, 0)["slot"], F.lit(0))
    slot = F.when(all_done, best).otherwise(fallback)
    chosen = rows.withColumn("slot", slot.cast("int")).withColumn("_best", F.get("_ends", F.col("slot")))
    return chosen.select(
        "doc_id", "slot", F.col("_best.tokens").alias("tokens"), F.col("_best.score").alias("score"),
        F.col("_best.stop_at").alias("stop_at"), "finished",
    )


def beam_failures(documents: DataFrame, results: DataFrame, text: str, seeds: DataFrame | None = None) -> DataFrame:
    """All documents with their result text, and an ``error`` with the cause for those that have none."""
    found = documents.join(results.select("doc_id", text), "doc_id", "left")
    if seeds is None:
        return found.withColumn("error", F.when(F.col(text).isNull(), F.lit(FAILED)))
    started = seeds.select("doc_id", F.lit(True).alias("_started"))
    cause = F.when(F.col("_started"), F.lit(FAILED)).otherwise(F.lit(NOT_SEEDED))
    found = found.join(started, "doc_id", "left")
    return found.withColumn("error", F.when(F.col(text).isNull(), cause)).drop("_started")
