"""Beam decoding to the end inside tasks, for decodes of many positions.

Step by step Spark plans and runs each position as joins of its own, some hundred times over. Here starts and the candidates
of their keys are dealt to the same tasks once, and a task decodes its starts side by side, position by position, by the rules
of ``beam.beam_step`` with n-grams of two words.

A word that was added to a hypothesis is a node. ``held`` says in which hypotheses a node's n-gram now is, ``seen`` in the
memories of which slots. A node knows its place among the candidates of the word before it and among the tail, so what is
blocked is looked up by place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from brevia.functions.scoring import SCORE_DIGITS
from brevia.session import ship_modules, stage

# Starts that a task decodes at once; their state stays in the processor's caches.
TOGETHER = 256
# Starts of a key below which it is not split, as each part reads all candidates of the key; and starts of a task at most,
# unless keys fall together.
LEAST_STARTS = 256
TASK_STARTS = 4_000
# Candidates of a task, 20 bytes each. Where a key has more, its lists are cut to a depth at which it has not; starts that
# need to look further are decoded again with whole lists of at most so many candidates, beyond that step by step.
TASK_CANDIDATES = 6_000_000
WHOLE_CANDIDATES = 24_000_000

# Lists gone through at once.
FOUND_TOGETHER = 10_000

NOWHERE = np.iinfo(np.int32).max


class Lists:
    """Words with their probabilities in lists, each list by falling probability."""

    def __init__(self, sizes, token_id, log_prob, prob):
        self.sizes = np.asarray(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        # One more entry stands for what lies behind the last list.
        self.token_id = np.append(token_id, 0).astype(np.int32)
        self.log_prob = np.append(log_prob, 0.0)
        self.prob = np.append(prob, 0.0)

    def at(self, which, places):
        """The entries at ``places``, a row for each list of ``which``; what lies behind a list is any entry."""
        index = np.minimum(self.starts[which][:, None] + places, len(self.token_id) - 1)
        return self.token_id[index], self.log_prob[index], self.prob[index]

    def find(self, which, token_id):
        """The place of a word in a list, ``NOWHERE`` where it is not in it."""
        sizes = self.sizes[which]
        row = np.repeat(np.arange(len(which)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        hit = self.token_id[self.starts[which][row] + place] == token_id[row]
        found = np.full(len(which), NOWHERE, np.int32)
        found[row[hit]] = place[hit]
        return found


def allowed_places(sizes, blocked, places, width: int, k: int):
    """Places in lists of ``sizes``, one row for each, and which of them are allowed: the k first allowed ones are among them
    where there are as many. ``blocked`` and ``places`` are rows and places in them."""
    found = np.tile(np.arange(width, dtype=np.int32), (len(sizes), 1))
    allowed = found < sizes[:, None]
    near = places < width
    allowed[blocked[near], places[near]] = False
    short = np.flatnonzero((allowed.sum(axis=1) < k) & (sizes > width))
    if len(short):
        number = np.full(len(sizes), -1)
        number[short] = np.arange(len(short))
        own = number[blocked] >= 0
        further, free = allowed_places(sizes[short], number[blocked[own]], places[own], 4 * width, k)
        first = np.argsort(~free, axis=1, kind="stable")[:, :k]
        allowed[short] = False
        allowed[short, :k] = np.take_along_axis(free, first, axis=1)
        found[short, :k] = np.take_along_axis(further, first, axis=1)
    return found, allowed


def k_best(score, token_id, log_prob, prob, allowed, k: int):
    """Slot, column and total of the k best continuations of each start, a word once for each slot: totals are ranked
    rounded, ties go to the lower slot, then the greater probability, then the lower id."""
    rows = np.arange(len(token_id))
    totals = score[:, :, None] + log_prob
    order = np.where(allowed, np.rint(totals * 10.0**SCORE_DIGITS), -np.inf)
    best = order.max(axis=2)
    slots, columns = (np.empty((len(rows), k), np.int64) for _ in range(2))
    for place in range(k):
        slot = best.argmax(axis=1)
        line, words = order[rows, slot], token_id[rows, slot]
        likely = np.where(line == best[rows, slot][:, None], prob[rows, slot], -1.0)
        column = np.where(likely == likely.max(axis=1)[:, None], words, NOWHERE).argmin(axis=1)
        line[words == words[rows, column][:, None]] = -np.inf
        order[rows, slot], best[rows, slot] = line, line.max(axis=1)
        slots[:, place], columns[:, place] = slot, column
    return slots, columns, totals[rows[:, None], slots, columns]


def enough(token_id, allowed, k: int, width: int):
    """Whether a hypothesis has k different allowed words; the first ``width`` columns are its own candidates."""
    own, tail = allowed[:, :, :width].sum(axis=2), allowed[:, :, width:].sum(axis=2)
    found = np.maximum(own, tail) >= k
    for at in zip(*np.nonzero(~found & (own + tail >= k))):
        found[at] = len(set(token_id[at][allowed[at]])) >= k
    return found


class Decoder:
    """Decodes starts over the candidates of their contexts: lists by the code of key and word before."""

    def __init__(self, codes, own: Lists, is_cut, tail: Lists | None, length: int, k: int, lineage: bool):
        self.codes, self.own, self.is_cut, self.tail = codes, own, is_cut, tail
        self.length, self.k, self.lineage = length, k, lineage
        self.width = 2 * (k + 1)
        contexts = np.arange(len(codes))
        words = (codes & 0xFFFFFFFF).astype(np.int32)
        self.self_place = np.concatenate([
            own.find(contexts[at:at + FOUND_TOGETHER], words[at:at + FOUND_TOGETHER]) for at in range(0, len(codes), FOUND_TOGETHER)])
        if tail is not None:
            self.by_id = np.argsort(tail.token_id[:-1])
            self.tail_ids = tail.token_id[self.by_id]

    def context(self, key, prev):
        """The list of each context; the last one, which is empty, where it has no candidates."""
        code = (key << 32) | prev
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, at, len(self.codes) - 1)

    def tail_place(self, token_id):
        if not len(self.tail_ids):
            return np.full(np.shape(token_id), NOWHERE, np.int32)
        at = np.minimum(np.searchsorted(self.tail_ids, token_id), len(self.tail_ids) - 1)
        return np.where(self.tail_ids[at] == token_id, self.by_id[at], NOWHERE).astype(np.int32)

    def continuations(self, context, shape, blocked, own_places, tail_places):
        """Words, logarithms, probabilities, whether allowed, and own places, by start, slot and column."""
        places, allowed = allowed_places(self.own.sizes[context], blocked, own_places, self.width, self.k)
        found = [*self.own.at(context, places), allowed, places]
        if self.tail is not None:
            sizes = np.full(len(context), self.tail.sizes[0])
            ranks, free = allowed_places(sizes, blocked, tail_places, self.width, self.k)
            more = [*self.tail.at(np.zeros(len(context), np.int64), ranks), free, np.full_like(ranks, -1)]
            found = [np.concatenate(both, axis=1) for both in zip(found, more)]
        return [column.reshape(*shape, -1) for column in found]

    def decode(self, key, start):
        """Tokens, scores, parents, n-grams and the slots that have seen them, which of the starts have not failed, and which
        need more candidates than their lists hold."""
        count, k, length = len(start), self.k, self.length
        rows, nodes = np.arange(count)[:, None], k * (length - 1)
        first, last, own_place, tail_place = (np.full((count, nodes), NOWHERE, np.int32) for _ in range(4))
        held, seen = (np.zeros((count, k, nodes), bool) for _ in range(2))
        words, parents = [], []
        prev, score, alive, none = start[:, None].astype(np.int64), np.zeros((count, 1)), np.ones(count, bool), np.zeros(0, np.int64)
        cut = np.zeros(count, bool)
        for position in range(1, length):
            shape, size = prev.shape, k * (position - 1)
            context = self.context(np.broadcast_to(key[:, None], shape).ravel(), prev.ravel())
            blocked, own_places, tail_places = none, none, none
            if position > 2:
                if self.lineage:
                    seen[:, :, :size] = held[:, :, :size]
                else:
                    seen[:, :, :size] |= held[:, :, :size]
                hits = np.flatnonzero(seen[:, :, :size] & (first[:, None, :size] == prev[:, :, None]))
                hyps, node = np.divmod(hits, size)
                # The last word is blocked too.
                blocked = np.concatenate([hyps, np.arange(count * k)])
                own_places = np.concatenate([own_place[hyps // k, node], self.self_place[context]])
                if self.tail is not None:
                    tail_places = np.concatenate([tail_place[hyps // k, node], self.tail_place(prev.ravel())])
            token_id, log_prob, prob, allowed, places = self.continuations(context, shape, blocked, own_places, tail_places)
            own = allowed[:, :, :self.width].sum(axis=2)
            cut |= alive & ((own < k) & self.is_cut[context].reshape(shape)).any(axis=1)
            alive &= ~cut & enough(token_id, allowed, k, self.width).all(axis=1)
            if not alive.any():
                break
            slot, column, score = k_best(score, token_id, log_prob, prob, allowed, k)
            word, place, new = token_id[rows, slot, column], places[rows, slot, column], slice(size, size + k)
            lost = place < 0
            place[lost] = self.own.find(context.reshape(shape)[rows, slot][lost], word[lost])
            first[:, new], last[:, new], own_place[:, new] = prev[rows, slot], word, place
            if self.tail is not None:
                tail_place[:, new] = self.tail_place(word)
            if position > 1:
                held[:, :, :size] = held[rows, slot, :size]
            held[:, np.arange(k), np.arange(size, size + k)] = True
            words.append(word)
            parents.append(slot if position > 1 else np.tile(np.arange(k), (count, 1)))
            prev = word.astype(np.int64)
        if not alive.any():
            return None, None, None, None, None, alive, cut
        tokens, at = np.empty((count, k, length), np.int32), np.tile(np.arange(k), (count, 1))
        for position in range(length - 1, 0, -1):
            tokens[:, :, position] = words[position - 1][rows, at]
            at = parents[position - 1][rows, at]
        tokens[:, :, 0] = start[:, None]
        size = k * (length - 2)
        grams = (first[:, :size].astype(np.int64) << 32) | last[:, :size]
        slots = (seen[:, :, :size] * (1 << np.arange(k, dtype=np.int64))[None, :, None]).sum(axis=1)
        return tokens, score, parents[-1], grams, slots, alive, cut


def _flat(column):
    """Values of a column of lists, and their sizes."""
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False)


def _lists(values) -> pa.Array:
    flat = values.reshape(len(values), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))


def decode_table(starts: pa.Table, contexts: pa.Table, tail, length: int, k: int, lineage: bool, schema: pa.Schema) -> pa.Table:
    """The beams of one task's starts over its contexts (``key, prev, token_id, log_prob, prob, whole``, the size of
    the whole list). Starts that need more candidates than there are have no lists, and ``cut`` is true."""
    names = contexts["key"].unique()
    key, prev = (pc.index_in(t["key"], value_set=names).fill_null(-1).to_numpy() for t in (contexts, starts))
    own_code = (key.astype(np.int64) << 32) | contexts["prev"].to_numpy()
    contexts = contexts.take(np.argsort(own_code))
    token_id, sizes = _flat(contexts["token_id"])
    own = Lists(np.append(sizes, 0), token_id, _flat(contexts["log_prob"])[0], _flat(contexts["prob"])[0])
    is_cut = np.append(contexts["whole"].to_numpy() > sizes, False)
    decoder = Decoder(
        np.append(np.sort(own_code), np.iinfo(np.int64).max), own, is_cut, tail and Lists(*tail), length, k, lineage)
    del contexts, token_id
    start, found = starts["prev"].to_numpy(), []
    for at in range(0, len(start), TOGETHER):
        part = slice(at, at + TOGETHER)
        *values, alive, cut = decoder.decode(prev[part].astype(np.int64), start[part])
        for which, lists in ((alive, values), (cut, None)):
            some = starts.select(["doc_id", "key"]).slice(at, len(which)).filter(pa.array(which)).combine_chunks()
            if len(some):
                lists = [pa.nulls(len(some), f.type) for f in schema][2:-1] if lists is None else [_lists(v[which]) for v in lists]
                columns = [*some.columns, *lists, pa.array(np.full(len(some), which is cut))]
                found.append(pa.table(columns, names=schema.names).cast(schema))
    return pa.concat_tables(found) if found else schema.empty_table()


def contexts_of(ranked: DataFrame, reach: int) -> DataFrame:
    """Candidates of each context in lists, down to the rank that a hypothesis can ever reach. A missing key has none."""
    kept = ranked.filter((F.col("rank") <= reach) & F.col("key").isNotNull() & F.col("prev").isNotNull())
    entries = F.sort_array(F.collect_list(F.struct("rank", "token_id", "log_prob", "prob"))).alias("c")
    return kept.groupBy("key", "prev").agg(entries).select("key", "prev", "c.token_id", "c.log_prob", "c.prob")


def depth_of(contexts: DataFrame, reach: int, least: int) -> tuple[int | None, int, bool]:
    """The depth to which lists are cut so that no key has too many candidates, None where there is none of at least
    ``least``; all candidates at that depth; and whether no key has too many for being decoded again with whole lists."""
    depths = [reach]
    while depths[-1] // 2 >= least:
        depths.append(depths[-1] // 2)
    sums = [F.sum(F.least(F.size("token_id"), F.lit(d))).alias(f"s{d}") for d in depths]
    found = contexts.groupBy("key").agg(*sums).agg(*(
        F.coalesce(of(f"s{d}"), F.lit(0)).alias(f"{name}{d}") for d in depths for name, of in (("most", F.max), ("all", F.sum)))).first()
    depth = next((d for d in depths if found[f"most{d}"] <= TASK_CANDIDATES), None)
    return depth, found[f"all{depth or reach}"], found[f"most{reach}"] <= WHOLE_CANDIDATES


def deal(starts: DataFrame, contexts: DataFrame, tasks: int, share: int) -> tuple[DataFrame, DataFrame]:
    """Both with the number of their task. A key with more starts than a share is split, its contexts copied to each part."""
    counts = starts.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(share)).alias("_parts"))
    # A share is no less than the starts over the tasks, so parts of a key are in different tasks.
    parts = F.least(F.col("_parts"), F.lit(tasks)).cast("int")
    first = F.xxhash64("key")
    hot = counts.filter(F.col("_parts") > 1).select(F.col("key").alias("_key"), parts.alias("_parts"))

    def with_parts(df):
        return df.join(F.broadcast(hot), F.col("key").eqNullSafe(F.col("_key")), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))

    placed = with_parts(starts).withColumn("_part", F.pmod(F.xxhash64("doc_id"), "_parts"))
    copied = with_parts(contexts).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    task = F.pmod(first + F.col("_part"), F.lit(tasks)).cast("int").alias("task")
    return placed.select("doc_id", "key", "prev", task), copied.select(*contexts.columns, task)


def decode(
    starts: DataFrame, contexts: DataFrame, depth: int, candidates: int, tail: DataFrame | None, length: int, k: int, memory: str
) -> tuple[DataFrame, DataFrame]:
    """State of every start (``doc_id, key, prev``) that does not fail, as of ``beam.beam_decode`` with n-grams of two words;
    and the ids of those that need candidates beyond the depth.

    ``contexts`` as of ``contexts_of``, ``candidates`` in all down to the depth; ``tail`` as of ``beam.rank_tail``.
    """
    spark = starts.sparkSession
    ship_modules(spark)
    number = starts.count()
    tasks = max(spark.sparkContext.defaultParallelism, -(-number // TASK_STARTS), -(-candidates // TASK_CANDIDATES))
    lists = (F.slice(name, 1, depth).alias(name) for name in ("token_id", "log_prob", "prob"))
    contexts = contexts.select("key", "prev", *lists, F.size("token_id").alias("whole"))
    placed, copied = deal(starts, contexts, tasks, max(LEAST_STARTS, -(-number // tasks)))
    # The tail is as long as a hypothesis can ever reach, whatever the vocabulary.
    words = None if tail is None else tail.first()["tail"]
    ranked = words if words is None else (
        [len(words)], *(np.array([w[c] for w in words], t) for c, t in (("token_id", "i4"), ("log_prob", "f8"), ("prob", "f8"))))
    key = StructField("key", starts.schema["key"].dataType)
    lists = {"tokens": IntegerType(), "scores": DoubleType(), "parents": IntegerType(), "grams": LongType(), "slots": LongType()}
    schema = StructType([starts.schema["doc_id"], key, *(StructField(name, ArrayType(kind)) for name, kind in lists.items()),
                         StructField("cut", BooleanType())])

    def work(some: pa.Table, own: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        return decode_table(some, own, ranked, length, k, memory == "lineage", to_arrow_schema(schema))

    found = stage(
        placed.repartitionById(tasks, "task").groupby("task").cogroup(copied.repartitionById(tasks, "task").groupby("task"))
        .applyInArrow(work, schema), "beams")
    grams = f"array_distinct(transform(sequence(1, {length - 1}), i -> shiftleft(cast(get(b, i - 1) AS bigint), 32) | cast(get(b, i) AS bigint)))"
    tokens = f"transform(sequence(0, {k - 1}), s -> slice(tokens, s * {length} + 1, {length}))"
    beams = f"""transform({tokens}, (b, s) -> named_struct(
        'slot', s, 'tokens', b, 'score', scores[s], 'grams', {grams}, 'parent', parents[s]))"""
    seen = f"transform(sequence(0, {k - 1}), s -> array_distinct(filter(grams, (g, i) -> getbit(slots[i], s) = 1)))"
    state = found.filter("NOT cut").selectExpr("doc_id", "key", f"{beams} AS beams", f"{seen} AS memory")
    return state, found.filter("cut").select("doc_id")
