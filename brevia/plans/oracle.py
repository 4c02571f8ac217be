"""The same queries in DuckDB SQL, put together from common table expressions."""

from __future__ import annotations

from brevia.constants import BEAM_WIDTH, FILTER_CHARS, SUMMARY_LENGTH, VOCABULARY_CAP
from brevia.operators.beam import DISCOUNT
from brevia.plans import fixtures as fx

ORACLE: dict[str, str] = {}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _strip(expression: str, mode: str = "filters") -> str:
    chars = FILTER_CHARS[mode]
    plain = "".join(c for c in chars if c not in "\t\n")
    return f"translate({expression}, {_text(plain)} || chr(9) || chr(10), repeat(' ', {len(chars)}))"


def _words(expression: str, mode: str = "filters") -> str:
    stripped = _strip(f"lower({expression})", mode)
    return f"list_filter(string_split({stripped}, ' '), lambda x: x <> '')"


def _with(*parts: str, recursive: bool = False) -> str:
    """WITH clause over the named parts and all they need, each once."""
    names: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, ()):
            add(needed)
        if name not in names:
            names.append(name)

    for part in parts:
        add(part)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{name} AS MATERIALIZED ({_PARTS[name]})" for name in names) + "\n"


_PARTS: dict[str, str] = {}
_NEEDS: dict[str, tuple[str, ...]] = {}


def _part(name: str, sql: str, *needs: str) -> None:
    _PARTS[name] = sql
    _NEEDS[name] = needs


_part("corpus", """
  SELECT doc_id, text AS articles, split_part(text, chr(10), 1) AS abstracts, lang FROM documents""")

for _side, _source, _mode in (
    ("doc", "articles", "filters"),
    ("plain", "articles", "no_filters"),
    ("bare", "abstracts", "filters"),
    ("sum", "'<go> ' || abstracts || ' <stop>'", "filters"),
    ("line", "'<go> ' || replace(articles, chr(10), ' <stop> ') || ' <stop>'", "filters"),
):
    _part(f"{_side}_tokens", f"SELECT doc_id, lang, {_words(_source, _mode)} AS tokens FROM corpus", "corpus")
    _part(f"{_side}_rows", f"""
  SELECT doc_id, lang, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos
  FROM {_side}_tokens""", f"{_side}_tokens")
    _part(f"{_side}_stats", f"""
  SELECT token, count(*) AS n, count(DISTINCT doc_id) AS df, min(doc_id * 16777216 + pos) AS first
  FROM {_side}_rows GROUP BY token""", f"{_side}_rows")
    _part(f"{_side}_all", f"""
  SELECT token, CAST(1 + row_number() OVER (ORDER BY n DESC, first) AS INTEGER) AS token_id, n, df
  FROM {_side}_stats WHERE token <> '<unk>'""", f"{_side}_stats")
    _part(f"{_side}_vocab", f"SELECT * FROM {_side}_all WHERE token_id < {fx.CAP}", f"{_side}_all")


def _encoded(name: str, side: str, vocab: str, length: int | None) -> None:
    cut = f"AND pos < {length}" if length else ""
    _part(f"{name}_long", f"""
  SELECT r.doc_id, r.lang, r.pos, coalesce(v.token_id, 1) AS token_id
  FROM {side}_rows r LEFT JOIN {vocab} v ON v.token = r.token WHERE true {cut}""", f"{side}_rows", vocab)
    _part(f"{name}_ids", f"""
  SELECT c.doc_id, c.lang, coalesce(x.ids, []) AS ids FROM corpus c LEFT JOIN
  (SELECT doc_id, list(token_id ORDER BY pos) AS ids FROM {name}_long GROUP BY doc_id) x USING (doc_id)""",
          f"{name}_long", "corpus")


_encoded("doc", "doc", "doc_vocab", fx.DOCUMENT_LENGTH)
_encoded("whole", "doc", "doc_vocab", None)
_encoded("gist", "sum", "sum_vocab", None)
_encoded("lines", "line", "line_vocab", None)
_encoded("full", "doc", "doc_all", None)
_encoded("sum", "sum", "sum_vocab", fx.SUMMARY_LENGTH)
_encoded("target", "sum", "line_vocab", None)
_encoded("start", "bare", "line_vocab", None)

for _name, _length in (("doc", fx.DOCUMENT_LENGTH), ("sum", fx.SUMMARY_LENGTH)):
    _part(f"{_name}_padded", f"""
  SELECT doc_id, lang, list_concat(ids, list_resize(CAST([] AS INTEGER[]), {_length} - len(ids), 0)) AS ids
  FROM {_name}_ids""", f"{_name}_ids")

for _name, _parts in (("whole", fx.CHUNKS), ("gist", 1), ("target", fx.STEPS)):
    _part(f"{_name}_padded", f"""
  SELECT doc_id, lang,
         list_concat(ids, list_resize(CAST([] AS INTEGER[]),
                     CAST(greatest(ceil(len(ids) / {_parts}), 1) * {_parts} - len(ids) AS BIGINT), 0)) AS ids
  FROM {_name}_ids""", f"{_name}_ids")

_JOIN = "array_to_string({}, ' ')".format

ORACLE["corpus_scan"] = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents"
ORACLE["corpus_project"] = _with("corpus") + "SELECT doc_id, articles, abstracts FROM corpus"
ORACLE["null_literal"] = _with("corpus") + """
SELECT doc_id, articles, coalesce(nullif(abstracts, articles), 'nan') AS abstracts FROM corpus"""
ORACLE["null_drop"] = _with("corpus") + """
SELECT doc_id, articles, abstracts FROM corpus WHERE abstracts <> articles"""
ORACLE["null_strict"] = ORACLE["corpus_project"]
ORACLE["shard_number"] = """
SELECT doc_id, 'eval/' || lang || '_' || CAST(length(lang) * 1000 AS VARCHAR) || '_end.xlsx' AS path,
       CAST(length(lang) * 1000 + row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS BIGINT) AS num
FROM documents"""
ORACLE["vocab_round_trip"] = _with("doc_vocab", "sum_vocab") + """
SELECT 'document' AS side, token, token_id, n, df FROM doc_vocab
UNION ALL SELECT 'summary', token, token_id, n, df FROM sum_vocab"""
ORACLE["wrap_target"] = _with("corpus") + "SELECT doc_id, '<go> ' || abstracts || ' <stop>' AS target FROM corpus"
for _name, _side in (("tokenise_filters", "doc"), ("tokenise_no_filters", "plain")):
    ORACLE[_name] = _with(f"{_side}_tokens") + f"""
SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens, {_JOIN('tokens')} AS words FROM {_side}_tokens"""
ORACLE["strip_chars"] = _with("corpus") + f"SELECT doc_id, {_strip('articles')} AS stripped FROM corpus"
ORACLE["char_length"] = _with("corpus") + """
SELECT doc_id, CAST(length(articles) AS INTEGER) AS article_chars,
       CAST(length(abstracts) AS INTEGER) AS abstract_chars FROM corpus"""
ORACLE["length_stats"] = _with("corpus") + """
SELECT side, count(*) AS documents, min(length) AS shortest, max(length) AS longest,
       round(avg(length), 6) AS mean_length, quantile_cont(CAST(length AS DOUBLE), 0.5) AS median_length
FROM (SELECT 'articles' AS side, length(articles) AS length FROM corpus
      UNION ALL SELECT 'abstracts', length(abstracts) FROM corpus) GROUP BY side"""
ORACLE["corpus_size"] = "SELECT count(*) AS documents FROM documents"

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
for _name, _n in (("repeated_ngrams", 2), ("repeated_trigrams", 3)):
    ORACLE[_name] = _with("corpus") + f""",
words AS (SELECT doc_id, list_filter(regexp_split_to_array(articles, '{_SPACE}'), lambda x: x <> '') AS w FROM corpus),
grams AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - {_n - 2}),
                                lambda i: array_to_string(w[i:i + {_n - 1}], ' '))) AS gram,
                 unnest(range(1, len(w) - {_n - 2})) AS spot FROM words),
twice AS (SELECT doc_id, gram, min(spot) AS spot FROM grams GROUP BY doc_id, gram HAVING count(*) > 1),
found AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n, string_agg(gram, '|' ORDER BY spot) AS grams
          FROM twice GROUP BY doc_id)
SELECT c.doc_id, coalesce(f.n, 0) AS n_repeated, coalesce(f.grams, '') AS repeated
FROM corpus c LEFT JOIN found f USING (doc_id)"""

ORACLE["word_stats"] = _with("doc_stats") + """
SELECT token, n, df, first // 16777216 AS first_doc, first % 16777216 AS first_pos FROM doc_stats"""
ORACLE["distinct_words"] = _with("doc_rows") + "SELECT DISTINCT doc_id, token FROM doc_rows"
ORACLE["vocab_rank"] = _with("doc_vocab") + "SELECT token, token_id, n, df FROM doc_vocab"
ORACLE["vocab_rank_uncapped"] = _with("doc_all") + "SELECT token, token_id, n, df FROM doc_all"
ORACLE["vocab_size"] = _with("doc_all") + f"""
SELECT CAST({fx.CAP} AS BIGINT) AS vocab_size, 'capped' AS kind
UNION ALL SELECT count(*) + 2, 'uncapped' FROM doc_all"""

ORACLE["encode_documents"] = _with("doc_padded") + f"SELECT doc_id, {_JOIN('ids')} AS ids FROM doc_padded"
ORACLE["encode_summaries"] = _with("sum_padded") + f"SELECT doc_id, {_JOIN('ids')} AS ids FROM sum_padded"
ORACLE["encode_uncapped"] = _with("full_ids") + f"SELECT doc_id, {_JOIN('ids')} AS ids FROM full_ids"
for _name in ("incremental_encode", "incremental_encode_restarted"):
    ORACLE[_name] = ORACLE["encode_documents"]
ORACLE["encode_uncapped_large"] = ORACLE["encode_uncapped"]
ORACLE["corpus_csv"] = _with("corpus") + "SELECT CAST(doc_id AS VARCHAR) AS doc_id, articles, abstracts FROM corpus"
ORACLE["numbered_corpus"] = """
SELECT doc_id, CAST(999000 + row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS num FROM documents"""
_part("eval_tokens", f"""
  SELECT doc_id, lang, {_words("coalesce(nullif(abstracts, articles), 'nan')")} AS tokens FROM corpus""", "corpus")
_part("eval_rows", """
  SELECT doc_id, lang, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM eval_tokens""",
      "eval_tokens")
_encoded("eval", "eval", "sum_vocab", fx.SUMMARY_LENGTH)
_UNKNOWN = "CAST(len(list_filter({}, lambda x: x = 1)) AS INTEGER)".format
ORACLE["evaluation_set"] = _with("doc_padded", "eval_ids") + f"""
SELECT d.doc_id, {_JOIN('d.ids')} AS input,
       {_JOIN(f"list_concat(e.ids, list_resize(CAST([] AS INTEGER[]), {fx.SUMMARY_LENGTH} - len(e.ids), 0))")} AS target,
       {_UNKNOWN('d.ids')} AS unknown_input, {_UNKNOWN('e.ids')} AS unknown_target
FROM doc_padded d JOIN eval_ids e USING (doc_id)"""
ORACLE["evaluation_unknowns"] = _with("doc_long", "eval_long") + """
SELECT (SELECT count(*) FROM doc_long WHERE token_id = 1) AS unknown_input,
       (SELECT count(*) FROM eval_long WHERE token_id = 1) AS unknown_target"""
ORACLE["decode_documents"] = _with("whole_padded", "doc_vocab") + """,
rows AS (SELECT doc_id, unnest(ids) AS token_id, generate_subscripts(ids, 1) AS pos FROM whole_padded)
SELECT doc_id, string_agg(coalesce(token, '<unk>'), ' ' ORDER BY pos) AS text
FROM rows LEFT JOIN doc_vocab USING (token_id) GROUP BY doc_id"""
ORACLE["pair_sides"] = """
SELECT CAST(u.conv_id AS VARCHAR) || '-' || CAST(u.turn AS VARCHAR) AS id, u.text AS articles, a.text AS abstracts
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'"""
ORACLE["unknown_stats"] = _with("doc_ids") + """
SELECT doc_id, CAST(len(ids) AS BIGINT) AS kept, CAST(len(list_filter(ids, lambda x: x = 1)) AS BIGINT) AS unknown,
       CASE WHEN len(ids) > 0 THEN round(len(list_filter(ids, lambda x: x = 1)) / len(ids), 6) END AS unknown_share
FROM doc_ids"""
ORACLE["unknown_totals"] = _with("doc_long", "sum_long") + """
SELECT (SELECT count(*) FROM doc_long WHERE token_id = 1) AS unknown_inputs,
       (SELECT count(*) FROM sum_long WHERE token_id = 1) AS unknown_targets"""

ORACLE["pad_truncate"] = _with("doc_tokens") + f"""
SELECT doc_id, {_JOIN("list_resize(list_transform(tokens, lambda t: length(t)), 300, 0)")} AS ids FROM doc_tokens"""
ORACLE["padding_mask"] = _with("whole_padded") + """
SELECT doc_id, array_to_string(list_transform(ids, lambda x: CASE WHEN x = 0 THEN 1 ELSE 0 END), '') AS mask,
       CAST(len(list_filter(ids, lambda x: x <> 0)) AS INTEGER) AS valid FROM whole_padded"""
ORACLE["next_token_pairs"] = _with("gist_padded") + f"""
SELECT doc_id, {_JOIN('ids[1:len(ids) - 1]')} AS input_ids, {_JOIN('ids[2:]')} AS label_ids FROM gist_padded"""
ORACLE["next_token_rows"] = _with("gist_padded") + """,
rows AS (SELECT doc_id, unnest(ids) AS prev, CAST(generate_subscripts(ids, 1) - 1 AS INTEGER) AS pos FROM gist_padded),
pairs AS (SELECT *, lead(prev) OVER (PARTITION BY doc_id ORDER BY pos) AS real FROM rows)
SELECT doc_id, pos, prev, real FROM pairs WHERE real IS NOT NULL"""
_part("doc_chunks", f"""
  SELECT doc_id, CAST(chunk AS INTEGER) AS chunk,
         ids[chunk * (len(ids) // {fx.CHUNKS}) + 1:(chunk + 1) * (len(ids) // {fx.CHUNKS})] AS ids
  FROM whole_padded, range({fx.CHUNKS}) r(chunk)""", "whole_padded")
ORACLE["split_chunks"] = _with("doc_chunks") + f"SELECT doc_id, chunk, {_JOIN('ids')} AS ids FROM doc_chunks"
ORACLE["chunk_mask"] = _with("doc_chunks") + """
SELECT doc_id, chunk,
       array_to_string(list_transform(ids, lambda x: CASE WHEN x = 0 THEN 1 ELSE 0 END), '') AS mask FROM doc_chunks"""
ORACLE["chunk_position"] = _with("whole_padded") + f""",
rows AS (SELECT doc_id, len(ids) // {fx.CHUNKS} AS step, unnest(ids) AS token_id,
                CAST(generate_subscripts(ids, 1) - 1 AS INTEGER) AS pos FROM whole_padded)
SELECT doc_id, pos, token_id, CAST(pos // step AS INTEGER) AS chunk, CAST(pos % step AS INTEGER) AS chunk_pos FROM rows"""
ORACLE["concat_chunks"] = _with("whole_padded") + f"SELECT doc_id, {_JOIN('ids')} AS ids FROM whole_padded"
ORACLE["curriculum_step_size"] = _with("corpus") + f"""
SELECT doc_id, CAST(length(articles) AS INTEGER) AS length,
       CAST(round_even(length(articles) / {fx.CURRICULUM_STEPS}, 0) AS INTEGER) AS size FROM corpus"""


def _prefix(column: str, cut: bool) -> str:
    if not cut:
        return f"{column}.ids"
    size = f"CAST(round_even(len({column}.ids) / {fx.CURRICULUM_STEPS}, 0) AS BIGINT)"
    return f"list_resize({column}.ids[1:least(step * {size}, len({column}.ids))], len({column}.ids), 0)"


for _name, _both in (("prefix_curriculum", False), ("prefix_curriculum_both", True)):
    ORACLE[_name] = _with("whole_padded", "gist_padded") + f"""
SELECT d.doc_id, 1 AS epoch, CAST(step AS INTEGER) AS step,
       {_JOIN(_prefix('d', _both))} AS input, {_JOIN(_prefix('s', True))} AS target
FROM whole_padded d JOIN gist_padded s USING (doc_id), range(1, {fx.CURRICULUM_STEPS + 1}) r(step)"""

_part("batches", f"""
  SELECT epoch, doc_id, row_number() OVER (PARTITION BY epoch ORDER BY k, doc_id) - 1 AS spot
  FROM (SELECT CAST(e AS INTEGER) AS epoch, doc_id,
               md5(CAST(doc_id AS VARCHAR) || '-' || CAST(e AS VARCHAR) || '-{fx.SEED}') AS k
        FROM documents, range(1, {fx.EPOCHS + 1}) r(e))""")
ORACLE["batch_assign"] = _with("batches") + f"""
SELECT epoch, doc_id, CAST(spot // {fx.BATCH_SIZE} AS BIGINT) AS batch, CAST(spot % {fx.BATCH_SIZE} AS INTEGER) AS place
FROM batches"""

_part("passes", f"""
  SELECT p, doc_id, row_number() OVER (PARTITION BY p ORDER BY k, doc_id) - 1 AS spot
  FROM (SELECT p, doc_id, md5(CAST(doc_id AS VARCHAR) || '-' || CAST(p AS VARCHAR) || '-{fx.SEED}') AS k
        FROM documents, range(1, {fx.EPOCHS * fx.STEPS + 1}) r(p))""")
ORACLE["curriculum_set"] = _with("passes", "sum_padded") + f"""
SELECT CAST((p - 1) // {fx.STEPS} + 1 AS INTEGER) AS epoch, CAST((p - 1) % {fx.STEPS} + 1 AS INTEGER) AS step,
       CAST(spot // {fx.BATCH_SIZE} AS BIGINT) AS batch, CAST(spot % {fx.BATCH_SIZE} AS INTEGER) AS place, doc_id,
       {_JOIN(f"list_resize(ids[1:((p - 1) % {fx.STEPS} + 1) * {round(fx.SUMMARY_LENGTH / fx.STEPS)}], {fx.SUMMARY_LENGTH}, 0)")} AS target
FROM passes JOIN sum_padded USING (doc_id)"""
ORACLE["training_set_sliced"] = _with("batches", "doc_padded") + f"""
SELECT epoch, CAST(spot // {fx.BATCH_SIZE} AS BIGINT) AS batch, CAST(spot % {fx.BATCH_SIZE} AS INTEGER) AS place, doc_id,
       CAST(e AS INTEGER) AS encoder, {_JOIN("part")} AS input,
       array_to_string(list_transform(part, lambda x: CASE WHEN x = 0 THEN 1 ELSE 0 END), '') AS mask
FROM (SELECT b.*, e, ids[e * {fx.DOCUMENT_LENGTH // fx.CHUNKS} + 1:(e + 1) * {fx.DOCUMENT_LENGTH // fx.CHUNKS}] AS part
      FROM batches b JOIN doc_padded USING (doc_id), range({fx.CHUNKS}) r(e) WHERE epoch = 1)"""
for _side, _length in (("doc", fx.DOCUMENT_LENGTH), ("sum", fx.SUMMARY_LENGTH)):
    _part(f"named_{_side}_vocab", f"""
  SELECT token, token_id FROM
  (SELECT token, CAST(1 + row_number() OVER (ORDER BY n DESC, first) AS INTEGER) AS token_id FROM
   (SELECT token, count(*) AS n, min(row('PMC' || CAST(doc_id AS VARCHAR), pos)) AS first FROM {_side}_rows
    WHERE token <> '<unk>' GROUP BY token)) WHERE token_id < {fx.CAP}""", f"{_side}_rows")
    _encoded(f"named_{_side}", _side, f"named_{_side}_vocab", _length)
    _part(f"named_{_side}_padded", f"""
  SELECT doc_id, list_concat(ids, list_resize(CAST([] AS INTEGER[]), {_length} - len(ids), 0)) AS ids
  FROM named_{_side}_ids""", f"named_{_side}_ids")
ORACLE["training_set_string_ids"] = _with("named_doc_padded", "named_sum_padded") + f"""
SELECT 'PMC' || CAST(doc_id AS VARCHAR) AS doc_id, {_JOIN('d.ids')} AS input, {_JOIN('s.ids')} AS target
FROM named_doc_padded d JOIN named_sum_padded s USING (doc_id), range(2)"""

# Scores
_part("counts", """
  SELECT lang AS key, prev, token_id, count(*) AS n FROM
  (SELECT lang, token_id AS prev, lead(token_id) OVER (PARTITION BY doc_id ORDER BY pos) AS token_id FROM lines_long)
  WHERE token_id IS NOT NULL GROUP BY ALL""", "lines_long")
_part("scores", """
  SELECT key, prev, token_id, n / sum(n) OVER (PARTITION BY key, prev) AS prob FROM counts""", "counts")
_part("ranked", """
  SELECT *, row_number() OVER (PARTITION BY key, prev ORDER BY prob DESC, token_id) AS rank FROM scores""", "scores")
ORACLE["softmax"] = _with("scores") + "SELECT key, prev, token_id, round(prob, 9) AS prob FROM scores"
ORACLE["token_loss"] = _with("counts") + """
SELECT key, prev, round(ln(CAST(sum(n) AS DOUBLE)) - ln(arg_max(n, token_id)), 6) AS loss
FROM counts GROUP BY key, prev"""

# Predictions
_part("targets", f"""
  SELECT doc_id, lang AS key, size, pos, prev, real FROM
  (SELECT doc_id, lang, size, pos, prev, lead(prev) OVER (PARTITION BY doc_id ORDER BY pos) AS real FROM
   (SELECT doc_id, lang, len(ids) // {fx.STEPS} AS size, unnest(ids) AS prev,
           generate_subscripts(ids, 1) - 1 AS pos FROM target_padded))
  WHERE real IS NOT NULL""", "target_padded")
_part("preds", f"""
  SELECT epoch, step, spot // {fx.BATCH_SIZE} AS batch,
         CASE WHEN pos + 1 < step * size THEN real ELSE 0 END AS real,
         CASE WHEN pos >= step * size OR t.prev = 0 THEN 0 ELSE coalesce(best, 1) END AS pred,
         -ln(greatest(coalesce(prob, 0), {fx.LOSS_FLOOR})) AS loss
  FROM targets t
  LEFT JOIN (SELECT key, prev, token_id, prob FROM scores) s ON s.key = t.key AND s.prev = t.prev AND s.token_id = real
  LEFT JOIN (SELECT key, prev, token_id AS best FROM ranked WHERE rank = 1) b ON b.key = t.key AND b.prev = t.prev
  JOIN batches USING (doc_id), range(1, {fx.STEPS + 1}) r(step)""", "targets", "scores", "ranked", "batches")
_part("losses", """
  SELECT epoch, step, batch, sum(loss) FILTER (real <> 0) / count(*) FILTER (real <> 0) AS loss
  FROM preds GROUP BY ALL""", "preds")
_part("running", """
  SELECT epoch, step, batch, loss, sum(loss) OVER (PARTITION BY epoch, step ORDER BY batch) AS running_loss
  FROM losses""", "losses")
_part("hits", """
  SELECT epoch, step, count(*) FILTER (pred = real) AS correct, count(*) AS positions FROM preds GROUP BY ALL""", "preds")
ORACLE["batch_loss"] = _with("losses") + """
SELECT epoch, CAST(step AS INTEGER) AS step, CAST(batch AS BIGINT) AS batch, round(loss, 6) AS loss FROM losses"""
ORACLE["token_accuracy"] = _with("hits") + """
SELECT epoch, round(sum(correct) / sum(positions), 6) AS accuracy FROM hits GROUP BY epoch"""
ORACLE["token_accuracy_masked"] = _with("preds") + """
SELECT epoch, CAST(step AS INTEGER) AS step,
       round(count(*) FILTER (pred = real AND real <> 0) / count(*) FILTER (real <> 0), 6) AS accuracy
FROM preds GROUP BY epoch, step"""
ORACLE["running_accuracy"] = _with("hits") + """
SELECT epoch, CAST(step AS INTEGER) AS step,
       round(sum(correct) OVER (ORDER BY epoch, step) / sum(positions) OVER (ORDER BY epoch, step), 6) AS accuracy
FROM hits"""
ORACLE["epoch_loss"] = _with("losses") + """
SELECT epoch, round(avg(loss), 6) AS loss, count(*) AS batches FROM losses GROUP BY epoch"""
ORACLE["running_loss"] = _with("running") + """
SELECT epoch, CAST(step AS INTEGER) AS step, CAST(batch AS BIGINT) AS batch, round(running_loss, 5) AS running_loss
FROM running"""
ORACLE["curriculum_loss"] = _with("running") + """
SELECT epoch, round(sum(running_loss) / count(*), 4) AS loss, count(*) AS batches FROM running GROUP BY epoch"""
ORACLE["curriculum_loss_mean"] = ORACLE["epoch_loss"]
ORACLE["metrics_sink"] = _with("losses", "hits") + """
SELECT l.epoch, CAST(l.step AS INTEGER) AS step, l.loss, l.batches, a.accuracy
FROM (SELECT epoch, step, round(avg(loss), 6) AS loss, count(*) AS batches FROM losses GROUP BY ALL) l
JOIN (SELECT epoch, step, round(100 * sum(correct) OVER (ORDER BY epoch, step)
                                / sum(positions) OVER (ORDER BY epoch, step), 4) AS accuracy FROM hits) a
USING (epoch, step)"""

ORACLE["metrics_rewritten"] = ORACLE["metrics_sink"]

ORACLE["epoch_report"] = _with("losses", "hits") + """
SELECT l.epoch, l.loss, l.batches, a.accuracy
FROM (SELECT epoch, round(avg(loss), 6) AS loss, count(*) AS batches FROM losses GROUP BY epoch) l
JOIN (SELECT epoch, round(100 * sum(correct) / sum(positions), 4) AS accuracy FROM hits GROUP BY epoch) a USING (epoch)"""
ORACLE["curriculum_epoch_report"] = _with("running", "hits") + """
SELECT l.epoch, l.loss, l.batches, a.accuracy
FROM (SELECT epoch, round(sum(running_loss) / count(*), 4) AS loss, count(*) AS batches FROM running GROUP BY epoch) l
JOIN (SELECT epoch, round(100 * max_by(share, step), 4) AS accuracy FROM
      (SELECT epoch, step, sum(correct) OVER (ORDER BY epoch, step) / sum(positions) OVER (ORDER BY epoch, step) AS share
       FROM hits) GROUP BY epoch) a USING (epoch)"""

# Decoding, one set of expressions per position
_K, _N = fx.BEAM_WIDTH, fx.NGRAM_SIZE
_part("seeds", """
  SELECT doc_id, lang AS key, ids[-1] AS prev FROM start_ids WHERE len(ids) > 0""", "start_ids")
_part("trigrams", """
  SELECT lang AS key, p.first AS first, p.prev AS prev, token_id, count(*) AS n FROM
  (SELECT lang, token_id, unnest([{'first': first, 'prev': prev}, {'first': 0, 'prev': prev}]) AS p FROM
   (SELECT lang, token_id, lag(token_id) OVER w AS prev, coalesce(lag(token_id, 2) OVER w, -1) AS first FROM lines_long
    WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE prev IS NOT NULL)
  WHERE p.first >= 0 GROUP BY ALL""", "lines_long")
_part("ranked_trigrams", """
  SELECT *, row_number() OVER (PARTITION BY key, first, prev ORDER BY prob DESC, token_id) AS rank FROM
  (SELECT *, n / sum(n) OVER (PARTITION BY key, first, prev) AS prob FROM trigrams)""", "trigrams")


def _beam_parts(prefix: str, length: int, ranked: str, at_start: str = "", at_step: str = "") -> None:
    """The parts of each position, named by a prefix, for candidates joined by the last word and a further condition."""
    _part(f"{prefix}beams_2", f"""
  SELECT doc_id, key, rank - 1 AS slot, [prev, token_id] AS tokens, ln(prob) AS score, CAST([] AS VARCHAR[]) AS seen
  FROM (SELECT s.doc_id, s.key, s.prev, r.token_id, r.prob, r.rank, count(*) OVER (PARTITION BY doc_id) AS found
        FROM seeds s JOIN {ranked} r ON r.key = s.key AND r.prev = s.prev {at_start} WHERE rank <= {_K})
  WHERE found = {_K}""", "seeds", ranked)
    for i in range(2, length):
        blocking = i >= _N + 1
        grams = f"list_transform(range(1, len(tokens) - {_N - 2}), lambda i: array_to_string(tokens[i:i + {_N - 1}], ' '))"
        seen = f"list_distinct(list_concat(seen, {grams}))" if blocking else "seen"
        now, opened, best = (f"{prefix}{kind}_{i}" for kind in ("beams", "open", "best"))
        _part(opened, f"SELECT doc_id, key, slot, tokens, score, {seen} AS seen FROM {now}", now)
        allowed = (
            f"r.token_id <> o.tokens[-1] AND NOT list_contains(o.seen, "
            f"array_to_string(list_append(o.tokens[-{_N - 1}:], r.token_id), ' '))" if blocking else "true"
        )
        _part(best, f"""
  SELECT * FROM (
    SELECT o.doc_id, o.key, o.slot, o.tokens, o.score, r.token_id, ln(r.prob) AS log_prob,
           row_number() OVER (PARTITION BY o.doc_id, o.slot ORDER BY r.rank) - 1 AS col
    FROM {opened} o JOIN {ranked} r ON r.key = o.key AND r.prev = o.tokens[-1] {at_step} WHERE {allowed})
  WHERE col < {_K}""", opened, ranked)
        _part(f"{prefix}beams_{i + 1}", f"""
  SELECT p.doc_id, p.key, p.place AS slot, list_append(p.tokens, p.token_id) AS tokens, p.total AS score, o.seen
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(total, 9) DESC, slot, col) - 1 AS place
        FROM (SELECT *, score + log_prob AS total, count(*) OVER (PARTITION BY doc_id) AS found FROM {best})
        WHERE found = {_K * _K}) p
  JOIN {opened} o ON o.doc_id = p.doc_id AND o.slot = p.place WHERE p.place < {_K}""", best, opened)


_beam_parts("", fx.BEAM_LENGTH, "ranked")
_beam_parts("scored_", fx.SCORED_LENGTH, "ranked_trigrams", "AND r.first = 0", "AND r.first = o.tokens[-2]")
# Decoding at the defaults by recursion over positions; a row holds one hypothesis and its slot's n-grams.
_part("wide_vocab", f"SELECT * FROM line_all WHERE token_id < {VOCABULARY_CAP}", "line_all")
_encoded("wide_lines", "line", "wide_vocab", None)
_encoded("wide_start", "bare", "wide_vocab", None)
_part("wide_ranked", """
  SELECT key, prev, token_id, prob, row_number() OVER (PARTITION BY key, prev ORDER BY prob DESC, token_id) AS rank FROM
  (SELECT key, prev, token_id, n / sum(n) OVER (PARTITION BY key, prev) AS prob FROM
   (SELECT lang AS key, prev, token_id, count(*) AS n FROM
    (SELECT lang, token_id AS prev, lead(token_id) OVER (PARTITION BY doc_id ORDER BY pos) AS token_id FROM wide_lines_long)
    WHERE token_id IS NOT NULL GROUP BY ALL))""", "wide_lines_long")
_part("wide_tail", f"""
  SELECT token_id, n / sum(n) OVER () * CAST({DISCOUNT} AS DOUBLE) AS prob,
         row_number() OVER (ORDER BY n DESC, token_id) AS rank FROM wide_vocab""", "wide_vocab")


def _candidates(hyps: str, reach: str) -> str:
    """Candidates of each hypothesis of a table up to a rank: its own ones and those of the tail, each once."""
    return f"""
    SELECT doc_id, slot, token_id, max(prob) AS prob FROM (
      SELECT h.doc_id, h.slot, r.token_id, r.prob FROM {hyps} h JOIN wide_ranked r ON r.key = h.key AND r.prev = h.prev
      WHERE r.rank <= {reach}
      UNION ALL SELECT h.doc_id, h.slot, t.token_id, t.prob FROM {hyps} h JOIN wide_tail t ON t.rank <= {reach})
    GROUP BY doc_id, slot, token_id"""


def _recursion(k: int, length: int) -> str:
    """Decoding with n-grams of two words, written as prev * 2^32 + next."""
    return f"""
first AS MATERIALIZED (
  SELECT doc_id, lang AS key, ids[-1] AS prev, 0 AS slot FROM wide_start_ids WHERE len(ids) > 0),
begun AS MATERIALIZED (
  SELECT f.doc_id, f.key, c.token_id, c.prob, f.prev,
         row_number() OVER (PARTITION BY f.doc_id ORDER BY c.prob DESC, c.token_id) - 1 AS place
  FROM first f JOIN ({_candidates('first', str(k))}) c USING (doc_id) QUALIFY place < {k}),
decoded(doc_id, slot, parent, key, position, prev, tokens, score, grams, seen) USING KEY (doc_id, slot) AS (
  SELECT doc_id, place, place, key, 2, token_id, [prev, token_id], ln(prob), [prev::BIGINT * 4294967296 + token_id],
         CAST([] AS BIGINT[])
  FROM begun
  UNION
  (WITH opened AS MATERIALIZED (
    SELECT *, list_transform(list_filter(met, lambda g: g >> 32 = prev AND position > 2), lambda g: g & 4294967295) AS banned,
           CASE WHEN position > 2 THEN 1 + len(list_filter(met, lambda g: g >> 32 = prev)) ELSE 0 END AS blocked FROM
    (SELECT *, CASE WHEN position <= 2 THEN seen
                    WHEN position > 3 AND parent = slot THEN list_append(seen, grams[-1])
                    ELSE list_distinct(list_concat(seen, grams)) END AS met
     FROM decoded WHERE position < {length})),
  found AS ({_candidates('opened', f'h.blocked + {k}')}),
  best AS (
    SELECT o.doc_id, o.slot, f.token_id, o.score + ln(f.prob) AS total,
           row_number() OVER (PARTITION BY o.doc_id, o.slot ORDER BY f.prob DESC, f.token_id) AS col
    FROM found f JOIN (SELECT doc_id, slot, score, prev, blocked, banned FROM opened) o
    ON o.doc_id = f.doc_id AND o.slot = f.slot
    WHERE o.blocked = 0 OR (f.token_id <> o.prev AND NOT list_contains(o.banned, f.token_id))
    QUALIFY col <= {k}),
  merged AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(total, 9) DESC, slot, col) - 1 AS place FROM best
    QUALIFY place < {k})
  SELECT m.doc_id, m.place, m.slot, p.key, p.position + 1, m.token_id, list_append(p.tokens, m.token_id), m.total,
         list_append(p.grams, p.prev::BIGINT * 4294967296 + m.token_id), o.met
  FROM merged m JOIN opened p ON p.doc_id = m.doc_id AND p.slot = m.slot
  JOIN opened o ON o.doc_id = m.doc_id AND o.slot = m.place))"""


_BEAM = "SELECT doc_id, CAST(slot AS INTEGER) AS slot, {} AS tokens, round(score, 6) AS score FROM {}".format
ORACLE["beam_seed"] = _with("beams_2") + _BEAM(_JOIN("tokens"), "beams_2")
ORACLE["beam_step"] = _with("beams_3") + _BEAM(_JOIN("tokens"), "beams_3")
ORACLE["beam_decode_large"] = _with("beams_4") + _BEAM(_JOIN("tokens"), "beams_4")
_SCORED = f"scored_beams_{fx.SCORED_LENGTH}"
ORACLE["beam_decode_scored"] = _with(_SCORED, "seeds", "corpus") + f"""
SELECT doc_id, CAST(slot AS INTEGER) AS slot, {_JOIN("tokens")} AS tokens, round(score, 6) AS score,
       CAST(NULL AS VARCHAR) AS error FROM {_SCORED}
UNION ALL SELECT c.doc_id, NULL, NULL, NULL,
       CASE WHEN s.doc_id IS NULL THEN 'no start word' ELSE 'fewer than k candidates' END
FROM corpus c LEFT JOIN seeds s USING (doc_id) WHERE c.doc_id NOT IN (SELECT doc_id FROM {_SCORED})"""
_LAST = f"beams_{fx.BEAM_LENGTH}"
ORACLE["beam_decode"] = _with(_LAST) + _BEAM(_JOIN("tokens"), _LAST)
ORACLE["beam_decode_default"] = _with("wide_start_ids", "wide_ranked", "wide_tail", recursive=True).rstrip() + "," + _recursion(
    BEAM_WIDTH, SUMMARY_LENGTH) + f"""
SELECT doc_id, CAST(slot AS INTEGER) AS slot, {_JOIN('tokens')} AS tokens, round(score, 5) AS score FROM decoded"""
ORACLE["ngram_memory"] = _with("open_4") + """
SELECT doc_id, CAST(slot AS INTEGER) AS slot, array_to_string(list_sort(seen), '|') AS seen FROM open_4"""
ORACLE["topk_per_hypothesis"] = _with("best_4") + """
SELECT doc_id, CAST(slot AS INTEGER) AS slot, CAST(col AS INTEGER) AS col, token_id, round(log_prob, 6) AS log_prob
FROM best_4"""
_part("stops", f"""
  SELECT doc_id, slot, tokens, score, nullif(list_position(tokens, (SELECT token_id FROM line_vocab
         WHERE token = '<stop>')), 0) - 1 AS stop_at FROM {_LAST}""", _LAST, "line_vocab")
_part("picked", f"""
  SELECT doc_id, count(stop_at) AS finished,
         CASE WHEN count(stop_at) = {_K} THEN arg_min(slot, (-round(score / pow(stop_at, 0.8), 9), slot))
              ELSE coalesce(min(slot) FILTER (stop_at IS NOT NULL), 0) END AS slot,
         CASE WHEN count(stop_at) = {_K} THEN 0
              ELSE coalesce(min(slot) FILTER (stop_at IS NOT NULL), 0) END AS raw_slot
  FROM stops GROUP BY doc_id""", "stops")
ORACLE["first_stop"] = _with("stops") + """
SELECT doc_id, CAST(slot AS INTEGER) AS slot, CAST(stop_at AS INTEGER) AS stop_at FROM stops"""
ORACLE["finished_count"] = _with("stops") + "SELECT doc_id, count(stop_at) AS finished FROM stops GROUP BY doc_id"
ORACLE["length_penalty"] = _with("stops") + """
SELECT doc_id, CAST(slot AS INTEGER) AS slot, round(score / pow(stop_at, 0.8), 6) AS normalised
FROM stops WHERE stop_at IS NOT NULL"""
for _name, _slot in (("pick_best_length_norm", "slot"), ("pick_best_raw", "raw_slot")):
    ORACLE[_name] = _with("picked", "stops") + f"""
SELECT p.doc_id, CAST(s.slot AS INTEGER) AS slot, {_JOIN('s.tokens')} AS tokens, CAST(p.finished AS INTEGER) AS finished
FROM picked p JOIN stops s ON s.doc_id = p.doc_id AND s.slot = p.{_slot}"""
ORACLE["cut_summary"] = _with("stops") + f"""
SELECT doc_id, CAST(slot AS INTEGER) AS slot, {_JOIN('tokens[2:coalesce(stop_at, len(tokens))]')} AS summary FROM stops"""
_part("summaries", """
  SELECT c.doc_id + 999000 AS num, articles, abstracts AS gold,
         CASE WHEN p.doc_id IS NULL AND d.doc_id IS NULL THEN 'no start word'
              WHEN p.doc_id IS NULL THEN 'fewer than k candidates' END AS error,
         CASE WHEN p.doc_id IS NOT NULL THEN coalesce((
           SELECT string_agg(coalesce(token, '<unk>'), ' ' ORDER BY i) FROM
           (SELECT unnest(s.tokens[2:coalesce(s.stop_at, len(s.tokens))]) AS token_id,
                   unnest(range(len(s.tokens[2:coalesce(s.stop_at, len(s.tokens))]))) AS i)
           LEFT JOIN line_vocab USING (token_id)), '') END AS generated
  FROM corpus c LEFT JOIN picked p USING (doc_id) LEFT JOIN stops s ON s.doc_id = p.doc_id AND s.slot = p.slot
  LEFT JOIN seeds d ON d.doc_id = c.doc_id""", "corpus", "picked", "stops", "line_vocab", "seeds")
_NAME = "CASE WHEN num > 999999 THEN CAST(num AS VARCHAR) ELSE lpad(CAST(num AS VARCHAR), 6, '0') END"
ORACLE["summarise"] = _with("summaries") + "SELECT num, generated, error FROM summaries"
ORACLE["write_pairs"] = _with("summaries") + f"""
SELECT num, tag, {_NAME} || '_' || tag || '.txt' AS name, CASE WHEN tag = 'encoder' THEN gold ELSE generated END AS text
FROM summaries, (VALUES ('encoder'), ('decoder')) t(tag) WHERE error IS NULL"""
ORACLE["committed_runs"] = _with("corpus") + f"""
SELECT num, tag, {_NAME} || '_' || tag || '.txt' AS name, CASE WHEN tag = 'encoder' THEN gold ELSE generated END AS text
FROM (SELECT doc_id + 999000 AS num, abstracts AS gold,
             CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'again ' ELSE '' END || lang AS generated
      FROM corpus), (VALUES ('encoder'), ('decoder')) t(tag)"""
ORACLE["route_failures"] = _with(_SCORED, "seeds", "corpus") + f"""
SELECT num, {_NAME} AS name, doc, gold, error FROM
(SELECT c.doc_id + 999000 AS num, articles AS doc, abstracts AS gold,
        CASE WHEN s.doc_id IS NULL THEN 'no start word' ELSE 'fewer than k candidates' END AS error
 FROM corpus c LEFT JOIN seeds s USING (doc_id) WHERE c.doc_id NOT IN (SELECT doc_id FROM {_SCORED}))"""
ORACLE["resume_skip"] = _with("corpus") + """
SELECT doc_id AS num, abstracts FROM corpus WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"""
ORACLE["summarise_resumed"] = _with("summaries") + f""",
todo AS (SELECT * FROM summaries WHERE num - 999000 NOT IN (SELECT doc_id FROM labels WHERE quality = 1)),
words AS (SELECT num, list_filter(string_split(generated, ' '), lambda x: x <> '') AS w FROM todo WHERE error IS NULL),
grams AS (SELECT num, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram,
                 unnest(range(1, len(w))) AS spot FROM words),
twice AS (SELECT num, gram, min(spot) AS spot FROM grams GROUP BY num, gram HAVING count(*) > 1),
repeats AS (SELECT num, string_agg(gram, '|' ORDER BY spot) AS repeated FROM twice GROUP BY num),
fresh AS (SELECT t.num, tag, CASE WHEN tag = 'encoder' THEN gold ELSE generated END AS text,
                 coalesce(repeated, '') AS repeated
          FROM todo t CROSS JOIN (VALUES ('encoder'), ('decoder')) k(tag) LEFT JOIN repeats USING (num)
          WHERE error IS NULL),
earlier AS (SELECT DISTINCT doc_id + 999000 AS num, tag, 'earlier ' || tag AS text
            FROM labels, (VALUES ('encoder'), ('decoder')) k(tag) WHERE tag = 'encoder' OR quality = 1)
SELECT * FROM fresh
UNION ALL SELECT num, tag, text, NULL FROM earlier e
WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.num = e.num AND f.tag = e.tag)
UNION ALL SELECT num, 'failure', error, NULL FROM todo WHERE error IS NOT NULL"""
ORACLE["training_set"] = _with("batches", "doc_padded", "sum_padded") + f"""
SELECT epoch, CAST(spot // {fx.BATCH_SIZE} AS BIGINT) AS batch, CAST(spot % {fx.BATCH_SIZE} AS INTEGER) AS place,
       b.doc_id, {_JOIN('d.ids')} AS input, {_JOIN('s.ids')} AS target
FROM batches b JOIN doc_padded d USING (doc_id) JOIN sum_padded s USING (doc_id)"""
ORACLE["batches_laid_out"] = ORACLE["training_set"]

# Files that arrive, and what is left out of them
ORACLE["corpus_rejected"] = _with("corpus") + """,
rows AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id % 7 AS kind, articles, abstracts, format
         FROM corpus, (VALUES ('json'), ('csv')) f(format))
SELECT CASE WHEN kind NOT IN (3, 5) THEN doc_id END AS doc_id, CASE WHEN kind NOT IN (3, 5) THEN articles END AS articles,
       CASE WHEN kind NOT IN (3, 4, 5) THEN abstracts END AS abstracts, format,
       CASE WHEN kind IN (3, 5) THEN 'malformed record' WHEN kind = 4 THEN 'missing text in column abstracts' END AS error,
       CASE WHEN kind = 3 AND format = 'json' THEN '{"doc_id": "' || doc_id || '", "articles": "cut'
            WHEN kind IN (3, 5) THEN doc_id || CASE WHEN kind = 5 AND format = 'csv' THEN ',one,two,three' ELSE '' END END AS raw
FROM rows"""
ORACLE["incremental_encode_repeats"] = _with("doc_padded", "corpus") + f""",
arriving AS (SELECT doc_id // 3 AS id, doc_id % 2 AS half, articles, doc_id FROM corpus),
least AS (SELECT id, half, min(articles) AS articles FROM arriving GROUP BY id, half),
taken AS (SELECT id, arg_min(articles, half) AS articles FROM least GROUP BY id),
source AS (SELECT t.id, t.articles, min(doc_id) AS doc_id FROM taken t JOIN arriving a ON a.id = t.id AND a.articles = t.articles
           GROUP BY ALL)
SELECT s.id AS doc_id, {_JOIN('ids')} AS ids, NULL AS articles, NULL AS error FROM source s JOIN doc_padded USING (doc_id)
UNION ALL SELECT id, NULL, articles, 'repeated id' FROM
(SELECT DISTINCT a.id, a.half, a.articles FROM arriving a JOIN taken t ON t.id = a.id WHERE t.articles <> a.articles)"""
for _name in ("numbered_shards", "numbered_shards_csv"):
    ORACLE[_name] = """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(999000 + 100000 * (doc_id % 8)
       + row_number() OVER (PARTITION BY doc_id % 8 ORDER BY md5(CAST(doc_id AS VARCHAR))) - 1 AS BIGINT) AS num
FROM documents"""
