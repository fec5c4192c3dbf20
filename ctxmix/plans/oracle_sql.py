"""DuckDB oracle SQL for every registered query (brute force, written independently).

The driver runs each string against the same parquet tables (pre-registered views)
and compares rows, schema and values with our Spark result. Column names and types
are aliased/cast to match the Spark output.
"""

from __future__ import annotations

from ..functions.hashing import sql_keyed_hash
from ..functions.text import PUNCTUATION

# Python str.strip() whitespace set, as a RE2 character class for DuckDB.
_WS = ("[\\t\n\x0b\x0c\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
       "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]")


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_normalize(expr: str) -> str:
    stripped = f"regexp_replace(lower(coalesce({expr}, '')), '^{_WS}+|{_WS}+$', '', 'g')"
    return f"translate({stripped}, {sql_str(PUNCTUATION)}, '')"


def sql_ranked(k: int, exclude_self: bool = True, floor_nan: bool = True) -> str:
    """CTE body: exact cosine top-k over embeddings x embeddings -> (qid, doc_id, score, rank)."""
    cos = "list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[])"
    score = f"CASE WHEN isnan({cos}) THEN -1.0 ELSE {cos} END" if floor_nan else cos
    where = "WHERE q.vec_id <> d.vec_id" if exclude_self else ""
    return f"""
      SELECT qid, doc_id, score, rank FROM (
        SELECT qid, doc_id, score,
               CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC) AS INTEGER) AS rank
        FROM (SELECT q.vec_id AS qid, d.vec_id AS doc_id, {score} AS score
              FROM embeddings q CROSS JOIN embeddings d {where}) s
      ) r WHERE rank <= {k}"""


def sql_ratio_variants(ratios, total: int, min_quotas=(0,)) -> str:
    vals = ", ".join(f"({float(r)!r}::DOUBLE, {int(m)})" for r in ratios for m in min_quotas)
    return f"""
      SELECT CAST(round(ratio * 100) AS INTEGER) * 10 + min_quota AS variant_id, ratio, min_quota,
             CAST(trunc({total} * ratio) AS INTEGER) AS n_noise,
             {total} - CAST(trunc({total} * ratio) AS INTEGER) AS n_keep
      FROM (VALUES {vals}) t(ratio, min_quota)"""


def hash_sql(*parts: str) -> str:
    return sql_keyed_hash(*parts)


RATIOS = (0.0, 0.25, 0.5, 0.75, 1.0)


def _labelled(k: int) -> str:
    return f"""
      ranked AS ({sql_ranked(k)}),
      labelled AS (
        SELECT r.*, coalesce(q.label = d.label, false) AS is_gold
        FROM ranked r JOIN embeddings q ON q.vec_id = r.qid JOIN embeddings d ON d.vec_id = r.doc_id),
      ordered AS (
        SELECT *, row_number() OVER (PARTITION BY qid, is_gold ORDER BY rank, doc_id) AS ord
        FROM labelled)"""


ORACLE: dict[str, str] = {}

ORACLE["topk_cosine"] = f"""
  SELECT qid, doc_id, round(score, 6) AS score, rank FROM ({sql_ranked(10)}) x"""

ORACLE["topk_with_self"] = f"""
  SELECT qid, doc_id, round(score, 6) AS score, rank FROM ({sql_ranked(11, exclude_self=False, floor_nan=False)}) x"""

ORACLE["centroids"] = """
  SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS value
  FROM embeddings, range(1, 65) t(i)
  WHERE i <= len(embedding)
  GROUP BY label, i"""

ORACLE["hard_negative_sweep"] = f"""
  WITH {_labelled(100)},
  variants AS ({sql_ratio_variants(RATIOS, 5, (0, 1))})
  SELECT v.variant_id, v.ratio, v.min_quota, o.qid, o.doc_id,
         CASE WHEN o.is_gold THEN 'gold' ELSE 'hard_negative' END AS role,
         o.rank, round(o.score, 6) AS score
  FROM ordered o JOIN variants v
    ON o.ord <= greatest(CASE WHEN o.is_gold THEN v.n_keep ELSE v.n_noise END, v.min_quota)"""

ORACLE["hard_negative_counts"] = f"""
  WITH {_labelled(100)},
  variants AS ({sql_ratio_variants(RATIOS, 5, (0, 1))}),
  picked AS (
    SELECT v.variant_id, o.qid, o.is_gold
    FROM ordered o JOIN variants v
      ON o.ord <= greatest(CASE WHEN o.is_gold THEN v.n_keep ELSE v.n_noise END, v.min_quota)),
  counts AS (
    SELECT variant_id, qid, CAST(count(*) FILTER (WHERE is_gold) AS INTEGER) AS num_gold,
           CAST(count(*) FILTER (WHERE NOT is_gold) AS INTEGER) AS num_hard_negative
    FROM picked GROUP BY variant_id, qid)
  SELECT v.variant_id, q.vec_id AS qid, coalesce(c.num_gold, 0) AS num_gold,
         coalesce(c.num_hard_negative, 0) AS num_hard_negative
  FROM variants v CROSS JOIN embeddings q
  LEFT JOIN counts c ON c.variant_id = v.variant_id AND c.qid = q.vec_id"""

ORACLE["normalize"] = f"""
  SELECT doc_id, {sql_normalize('text')} AS normalized FROM documents"""

ORACLE["passage_text"] = f"""
  WITH p AS (SELECT p_partkey AS doc_id, CASE WHEN p_size < 10 THEN '' ELSE coalesce(p_name, '') END AS title,
                    coalesce(p_brand, '') AS body FROM part)
  SELECT doc_id,
         regexp_replace(CASE WHEN length(title) > 0 THEN title || '[SEP]' || body ELSE body END,
                        '^{_WS}+|{_WS}+$', '', 'g') AS passage_text
  FROM p"""

_CONV_PRED = """
  preds AS (SELECT conv_id, turn, role, text AS prediction FROM conversations),
  gold AS (SELECT conv_id, turn,
                  CASE WHEN role = 'user' THEN text || '.' ELSE split_part(text, ' ', 1) END AS gold_answer
           FROM conversations WHERE role <> 'system'),
  joined AS (SELECT p.*, g.gold_answer IS NOT NULL AS has_gold, coalesce(g.gold_answer, '') AS gold_answer
             FROM preds p LEFT JOIN gold g ON g.conv_id = p.conv_id AND g.turn = p.turn),
  scored AS (SELECT *, CAST({n_p} = {n_g} AS INTEGER) AS exact_match,
                    CAST(contains({n_p}, {n_g}) AS INTEGER) AS cover_exact_match FROM joined)"""
_CONV_PRED = _CONV_PRED.format(n_p=sql_normalize("prediction"), n_g=sql_normalize("gold_answer"))

ORACLE["score_answers"] = f"""
  WITH {_CONV_PRED}
  SELECT conv_id, turn, role, has_gold, exact_match, cover_exact_match FROM scored"""

ORACLE["evaluate"] = f"""
  WITH {_CONV_PRED},
  runs AS (SELECT 'conversations' AS experiment, v AS variant
           FROM (VALUES ('assistant'), ('system'), ('tool'), ('user')) t(v)),
  m AS (SELECT role AS variant, count(*) AS num_samples, avg(exact_match) AS em, avg(cover_exact_match) AS cem,
               count(*) FILTER (WHERE NOT has_gold) AS n_missing_gold
        FROM scored GROUP BY role)
  SELECT r.experiment, r.variant, coalesce(m.num_samples, 0) AS num_samples,
         round(coalesce(m.em, 0.0), 6) AS exact_match, round(coalesce(m.cem, 0.0), 6) AS cover_exact_match,
         coalesce(m.n_missing_gold, 0) AS n_missing_gold
  FROM runs r LEFT JOIN m ON m.variant = r.variant"""

ORACLE["duplicate_answers"] = f"""
  WITH n AS (SELECT doc_id, {sql_normalize('text')} AS t FROM documents),
  g AS (SELECT t, min(doc_id) AS dup_of, count(*) AS group_size FROM n GROUP BY t HAVING count(*) > 1)
  SELECT n.doc_id, g.dup_of, g.group_size FROM n JOIN g ON n.t = g.t"""

ORACLE["benchmark_cover"] = f"""
  WITH d AS (SELECT doc_id, {sql_normalize('text')} AS t FROM documents),
  b AS (SELECT item_id, {sql_normalize('text')} AS t FROM benchmark)
  SELECT d.doc_id, b.item_id FROM d JOIN b ON contains(d.t, b.t)"""

ORACLE["gold_substring"] = """
  WITH g AS (SELECT DISTINCT gold_title FROM (
               SELECT lower(split_part(p_name, ' ', -1)) AS gold_title FROM part
               UNION ALL SELECT lower(concat_ws(' ', p_name, p_type)) FROM part) x),
  p AS (SELECT p_partkey AS doc_id, lower(coalesce(p_name, '')) AS t FROM part)
  SELECT DISTINCT g.gold_title, p.doc_id FROM g JOIN p ON contains(p.t, g.gold_title) OR contains(g.gold_title, p.t)"""

ORACLE["oracle_contexts"] = """
  WITH ctx AS (SELECT conv_id AS qid, turn AS ctx_pos, role AS title, string_split(text, chr(10)) AS sentences
               FROM conversations),
  last AS (SELECT qid, title, arg_max(sentences, ctx_pos) AS sentences FROM ctx GROUP BY qid, title),
  facts AS (SELECT conv_id AS qid, turn AS fact_pos,
                   CASE WHEN role = 'system' THEN upper(role) ELSE role END AS title,
                   CAST(turn - 2 AS INTEGER) AS sent_idx FROM conversations),
  hits AS (SELECT f.qid, f.fact_pos, f.title, f.sent_idx,
                  l.sentences[CASE WHEN f.sent_idx >= 0 THEN f.sent_idx + 1 ELSE f.sent_idx END] AS text
           FROM facts f JOIN last l ON l.qid = f.qid AND l.title = f.title
           WHERE f.sent_idx < len(l.sentences) AND f.sent_idx >= -len(l.sentences)),
  firsts AS (SELECT qid, title, text, min(fact_pos) AS position FROM hits GROUP BY qid, title, text)
  SELECT x.qid, x.position, 'oracle_' || x.title || '_' || CAST(h.sent_idx AS VARCHAR) AS doc_id,
         x.title, x.text, 1.0::DOUBLE AS score
  FROM firsts x JOIN hits h ON h.qid = x.qid AND h.fact_pos = x.position"""

SEED = 42


def sql_permuted(source: str, *keys: str) -> str:
    """Rows of ``source`` with ``x`` permuted once: four rounds on a x b places, a = ceil(sqrt(n)), b = ceil(n / a)."""
    out = (f"SELECT *, (x // b)::BIGINT AS l, (x % b)::BIGINT AS r FROM (SELECT *, ((n + a - 1) // a)::BIGINT AS b FROM "
           f"(SELECT *, ceil(sqrt(n))::BIGINT AS a FROM ({source}) s0) s1) s2")
    for i, (side, other, m) in enumerate([("l", "r", "a"), ("r", "l", "b")] * 2):
        out = f"SELECT * REPLACE (({side} + {hash_sql(str(SEED), *keys, str(i), other)}) % {m} AS {side}) FROM ({out}) f{i}"
    return f"SELECT * EXCLUDE (l, r, a, b) REPLACE (l * b + r AS x) FROM ({out}) f"


def _sample_sql(requests: str, pool: str, exclude_pred: str, group: str, vcol: str = "variant_id", by_variant: bool = True) -> str:
    """Every request against every pool row: what is left is numbered in the order of (group, idx), and the draws'
    numbers are permuted until they are below its count. Where exclusions are those of a question whatever the
    variant (not ``by_variant``), questions stand for their requests. Needs WITH RECURSIVE."""
    keys = f"{vcol}, qid" if by_variant else "qid"
    same = f"l.{vcol} = w.{vcol} AND l.qid = w.qid" if by_variant else "l.qid = w.qid"
    return f"""
      requests AS MATERIALIZED ({requests}),
      left_over AS MATERIALIZED (SELECT {keys}, p.idx,
                      row_number() OVER (PARTITION BY {keys} ORDER BY p.{group} NULLS FIRST, p.idx) - 1 AS place
                    FROM (SELECT DISTINCT {keys}, q_key FROM requests WHERE need > 0) f JOIN {pool} p ON NOT ({exclude_pred})),
      counted AS MATERIALIZED (SELECT {keys}, count(*) AS n FROM left_over GROUP BY {keys}),
      walk AS ({sql_permuted(f"SELECT {vcol}, qid, n, t.j, t.j::BIGINT AS x FROM requests JOIN counted USING ({keys}) JOIN range(0, 100) t(j) ON t.j < least(need, n)", vcol, "qid")}
               UNION ALL {sql_permuted("SELECT * FROM walk WHERE x >= n", vcol, "qid")}),
      picked AS MATERIALIZED (SELECT w.{vcol}, w.qid, p.*, w.j + 1 AS draw FROM (SELECT * FROM walk WHERE x < n) w
                 JOIN left_over l ON {same} AND l.place = w.x JOIN {pool} p ON p.idx = l.idx)"""


ORACLE["random_negatives"] = f"""
  WITH RECURSIVE ranked AS ({sql_ranked(100)}),
  variants AS ({sql_ratio_variants(RATIOS, 5)}),
  relevant AS (SELECT v.variant_id, r.qid, r.doc_id, r.score, r.rank AS ord
               FROM ranked r JOIN variants v ON r.rank <= v.n_keep JOIN documents d ON d.doc_id = r.doc_id),
  pool AS MATERIALIZED (SELECT d.doc_id, e.label AS d_label, row_number() OVER (ORDER BY d.doc_id) - 1 AS idx
           FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
  {_sample_sql(
      "SELECT v.variant_id, q.vec_id AS qid, q.label AS q_key, v.n_noise AS need FROM variants v CROSS JOIN embeddings q",
      "pool",
      "coalesce(f.q_key = p.d_label, false) OR EXISTS (SELECT 1 FROM relevant x WHERE x.variant_id = f.variant_id"
      " AND x.qid = f.qid AND x.doc_id = p.doc_id)", "d_label")}
  SELECT variant_id, qid, doc_id, 'relevant' AS role, CAST(ord AS INTEGER) AS ord, round(score, 6) AS score FROM relevant
  UNION ALL
  SELECT variant_id, qid, doc_id, 'random' AS role, CAST(draw AS INTEGER) AS ord, 0.0::DOUBLE AS score FROM picked"""

ORACLE["random_from_run"] = f"""
  WITH RECURSIVE ranked AS ({sql_ranked(100)}),
  variants AS ({sql_ratio_variants((0.0, 0.5, 1.0), 5)}),
  relevant AS (SELECT v.variant_id, r.qid, r.doc_id, r.score, r.rank AS ord
               FROM ranked r JOIN variants v ON r.rank <= v.n_keep),
  pool AS MATERIALIZED (SELECT qid AS owner, rank AS owner_rank, doc_id,
                  row_number() OVER (ORDER BY qid, rank) - 1 AS idx
           FROM ranked WHERE rank > 50 AND rank <= 100),
  {_sample_sql(
      "SELECT v.variant_id, q.qid, q.qid AS q_key, v.n_noise AS need FROM variants v "
      "CROSS JOIN (SELECT DISTINCT qid FROM ranked) q",
      "pool", "p.owner = f.qid", "owner", by_variant=False)}
  SELECT variant_id, qid, doc_id, 'relevant' AS role, CAST(ord AS INTEGER) AS ord, round(score, 6) AS score FROM relevant
  UNION ALL
  SELECT variant_id, qid, doc_id, 'random' AS role, CAST(draw AS INTEGER) AS ord, 0.0::DOUBLE AS score FROM picked"""

ORACLE["shuffle_contexts"] = f"""
  WITH {_labelled(100)},
  variants AS ({sql_ratio_variants(RATIOS, 5, (0, 1))}),
  sel AS (SELECT v.variant_id, o.qid, o.doc_id, o.ord,
                 CASE WHEN o.is_gold THEN 'gold' ELSE 'hard_negative' END AS role
          FROM ordered o JOIN variants v
            ON o.ord <= greatest(CASE WHEN o.is_gold THEN v.n_keep ELSE v.n_noise END, v.min_quota))
  SELECT variant_id, qid,
         CAST(row_number() OVER (PARTITION BY variant_id, qid
              ORDER BY {hash_sql(str(SEED), 'variant_id', 'qid', 'role', 'ord')}, role, ord) AS INTEGER) AS position,
         doc_id, role
  FROM sel"""

ORACLE["first_n_questions"] = """
  SELECT vec_id AS qid FROM embeddings ORDER BY vec_id LIMIT 200"""

ORACLE["baseline_sweep"] = f"""
  WITH ranked AS ({sql_ranked(5)}),
  ks AS (SELECT * FROM (VALUES (1), (3), (5)) t(k))
  SELECT ks.k, r.qid, r.rank, r.doc_id, round(r.score, 6) AS score, coalesce(d.source, '') AS title
  FROM ranked r JOIN ks ON r.rank <= ks.k JOIN documents d ON d.doc_id = r.doc_id"""

_CONFIG_VALUES = ", ".join(f"({g * 100 + h * 10 + m}, {g}, {h}, {m})"
                           for g, h, m in [(5, 0, 0), (4, 1, 0), (3, 2, 0), (0, 5, 0), (3, 2, 5)])

ORACLE["hard_negative_configs"] = f"""
  WITH ranked AS ({sql_ranked(100)}),
  run AS (SELECT r.qid, r.doc_id, coalesce(p.p_name, '') AS title,
                 row_number() OVER (PARTITION BY r.qid ORDER BY r.rank) AS pos
          FROM ranked r JOIN part p ON p.p_partkey = r.doc_id),
  lab AS (SELECT run.*, coalesce(lower(run.title) = lower(g.p_name), false) AS is_gold
          FROM run LEFT JOIN part g ON g.p_partkey = run.qid),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY qid, is_gold ORDER BY pos, doc_id) AS ord FROM lab),
  configs AS (SELECT * FROM (VALUES {_CONFIG_VALUES}) t(config_id, k_gold, k_hard, mix_topk))
  SELECT c.config_id, c.k_gold, c.k_hard, c.mix_topk, o.qid, o.doc_id,
         CASE WHEN o.is_gold THEN 'gold' ELSE 'hard_negative' END AS role, CAST(o.ord AS INTEGER) AS ord, o.title
  FROM ordered o JOIN configs c ON o.ord <= CASE WHEN o.is_gold THEN c.k_gold ELSE c.k_hard END
  UNION ALL
  SELECT c.config_id, c.k_gold, c.k_hard, c.mix_topk, o.qid, o.doc_id, 'topk' AS role,
         CAST(o.pos AS INTEGER) AS ord, o.title
  FROM ordered o JOIN configs c ON o.pos <= c.mix_topk"""

# A question per turn; evidence from the last four turns: last paragraph of a title, first fact of a sentence.
_ORACLE_CTX_CTE = """
  ask AS (SELECT conv_id, turn AS t, conv_id || '-' || turn AS qid, text AS question FROM conversations),
  near AS (SELECT a.qid, c.turn, c.role, string_split(c.text, chr(10)) AS sentences
           FROM ask a JOIN conversations c ON c.conv_id = a.conv_id AND c.turn BETWEEN a.t - 3 AND a.t),
  last AS (SELECT qid, role AS title, arg_max(sentences, turn) AS sentences FROM near GROUP BY qid, role),
  facts AS (SELECT qid, turn AS fact_pos, CASE WHEN role = 'system' THEN upper(role) ELSE role END AS title,
                   CAST(turn - 2 AS INTEGER) AS sent_idx FROM near),
  hits AS (SELECT f.qid, f.fact_pos, f.title,
                  l.sentences[CASE WHEN f.sent_idx >= 0 THEN f.sent_idx + 1 ELSE f.sent_idx END] AS text
           FROM facts f JOIN last l ON l.qid = f.qid AND l.title = f.title
           WHERE f.sent_idx < len(l.sentences) AND f.sent_idx >= -len(l.sentences)),
  oc AS (SELECT qid, title, text, min(fact_pos) AS position FROM hits GROUP BY qid, title, text)"""


def sql_prompt(question: str, block: str) -> str:
    return f"""('You are a QA system. Answer questions based on the provided documents.' || chr(10) || chr(10) ||
         'Question: ' || coalesce({question}, '') || chr(10) || chr(10) || 'Relevant documents:' || chr(10) ||
         coalesce({block}, '') || chr(10) || chr(10) ||
         'Answer the question as concisely as possible. Provide only the answer, no explanation needed.')"""


ORACLE["build_prompt"] = f"""
  WITH {_ORACLE_CTX_CTE},
  blocks AS (SELECT qid, string_agg('[DOC ' || CAST(rn AS VARCHAR) || '] ' || title || chr(10) || text,
                                    chr(10) || chr(10) ORDER BY position) AS block
             FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY position) AS rn FROM oc) x
             GROUP BY qid)
  SELECT q.qid, {sql_prompt('q.question', 'b.block')} AS prompt FROM ask q LEFT JOIN blocks b ON b.qid = q.qid"""


def sql_finish(counts: tuple[str, ...], extra: str = "") -> str:
    """From ``pos`` (variant, qid, position, role, title, text), ``recs`` (variant, qid, question) and
    ``gold`` (qid, gold_answer): whole prompts, the stand-in's answers and their scores, as CTE ``scored``."""
    num = "".join(f", CAST(count(*) FILTER (WHERE role = '{c}') AS INTEGER) AS num_{c}" for c in counts)
    got = "".join(f", coalesce(b.num_{c}, 0) AS num_{c}" for c in counts)
    return f"""
  numbered AS (SELECT *, row_number() OVER (PARTITION BY variant, qid ORDER BY position) AS rn FROM pos),
  blocks AS (SELECT variant, qid, string_agg('[DOC ' || rn || '] ' || title || chr(10) || text, chr(10) || chr(10) ORDER BY rn) AS block,
                    string_agg(split_part(text, chr(10), 1), ' | ' ORDER BY rn) AS lines{num}
             FROM numbered GROUP BY variant, qid),
  answered AS (SELECT r.variant, r.qid, regexp_replace(coalesce(b.lines, ''), '^{_WS}+|{_WS}+$', '', 'g') AS prediction,
                      sha256({sql_prompt('r.question', 'b.block')}) AS prompt_hash,
                      g.gold_answer IS NOT NULL AS has_gold, coalesce(g.gold_answer, '') AS gold_answer{got}
               FROM recs r LEFT JOIN blocks b ON b.variant = r.variant AND b.qid = r.qid LEFT JOIN gold g ON g.qid = r.qid),
  scored AS (SELECT *, CAST({sql_normalize('prediction')} = {sql_normalize('gold_answer')} AS INTEGER) AS exact_match,
                    CAST(contains({sql_normalize('prediction')}, {sql_normalize('gold_answer')}) AS INTEGER) AS cover_exact_match
             FROM answered)"""


_E2E = "variant, qid, prediction, prompt_hash, has_gold, exact_match, cover_exact_match"

_GEN = f"""
  {_ORACLE_CTX_CTE},
  pos AS (SELECT 'oracle_gold_only' AS variant, qid, position, 'oracle' AS role, title, text FROM oc),
  recs AS (SELECT 'oracle_gold_only' AS variant, qid, question FROM ask),
  gold AS (SELECT qid, split_part(question, chr(10), 1) AS gold_answer FROM ask WHERE t % 2 = 0),
  {sql_finish(('oracle',))}"""

ORACLE["generate_score"] = f"""
  WITH {_GEN}
  SELECT {_E2E}, num_oracle, gold_answer, CAST(NULL AS VARCHAR) AS error FROM scored"""

ORACLE["summary"] = f"""
  WITH gen AS (WITH {_GEN} SELECT * FROM scored), {_CONV_PRED},
  m AS (SELECT 'oracle' AS experiment, variant, count(*) AS num_samples, avg(exact_match) AS em,
               avg(cover_exact_match) AS cem FROM gen GROUP BY variant
        UNION ALL
        SELECT 'conversations', role, count(*), avg(exact_match), avg(cover_exact_match)
        FROM scored GROUP BY role)
  SELECT CASE experiment WHEN 'oracle' THEN 0 WHEN 'baseline' THEN 1 WHEN 'random_negatives' THEN 2
              WHEN 'hard_negatives' THEN 3 ELSE 4 END AS experiment_order,
         experiment, variant, num_samples, round(em * 100, 2) AS em_pct, round(cem * 100, 2) AS cem_pct
  FROM m"""

ORACLE["read_write_roundtrip"] = f"""
  SELECT qid, doc_id, round(score, 6) AS score, rank FROM ({sql_ranked(5)}) x"""

# Half of the vectors' ids are unknown to these passages.
_SPARSE = "sparse AS (SELECT doc_id * 2 AS doc_id, coalesce(source, '') AS title, coalesce(text, '') AS text FROM documents)"
_PARTS = "parts AS (SELECT p_partkey AS doc_id, coalesce(p_name, '') AS title, concat_ws(' ', p_brand, p_type) AS text FROM part)"


def sql_asked(variants: str) -> str:
    """Every vector asks in every variant; its question is the part name under its id."""
    return f"""recs AS (SELECT v.variant, e.vec_id AS qid, p.p_name AS question
           FROM (SELECT DISTINCT variant FROM {variants}) v CROSS JOIN embeddings e LEFT JOIN part p ON p.p_partkey = e.vec_id)"""


def sql_best_line(run: str) -> str:
    return f"""gold AS (SELECT qid, arg_min(split_part(text, chr(10), 1), rank) AS gold_answer FROM {run} WHERE qid % 2 = 0 GROUP BY qid)"""


def sql_shuffled(source: str) -> str:
    order = hash_sql(str(SEED), "variant", "qid", "role", "ord")
    return f"pos AS (SELECT *, row_number() OVER (PARTITION BY variant, qid ORDER BY {order}, role, ord) AS position FROM {source})"


ORACLE["baseline_generate"] = f"""
  WITH ranked AS ({sql_ranked(5)}), {_SPARSE},
  known AS (SELECT r.qid, r.rank, d.title, d.text FROM ranked r JOIN sparse d ON d.doc_id = r.doc_id),
  ks AS (SELECT * FROM (VALUES ('top1', 1), ('top3', 3), ('top5', 5)) t(variant, k)),
  pos AS (SELECT ks.variant, k.qid, k.rank AS position, 'topk' AS role, k.title, k.text FROM known k JOIN ks ON k.rank <= ks.k),
  {sql_asked('ks')}, {sql_best_line('known')}, {sql_finish(('topk',))}
  SELECT {_E2E}, num_topk FROM scored"""

ORACLE["rescore_generate"] = f"""
  WITH ranked AS ({sql_ranked(6)}), {_SPARSE},
  known AS (SELECT r.qid, row_number() OVER (PARTITION BY r.qid ORDER BY r.rank) AS rank, d.title, d.text
            FROM ranked r JOIN sparse d ON d.doc_id = r.doc_id),
  ks AS (SELECT * FROM (VALUES ('baseline_top1', 1), ('baseline_top3', 3), ('baseline_top5', 5)) t(variant, k)),
  pos AS (SELECT ks.variant, k.qid, k.rank AS position, 'topk' AS role, k.title, k.text FROM known k JOIN ks ON k.rank <= ks.k),
  {sql_asked('ks')}, {sql_best_line('known')}, {sql_finish(('topk',))}
  SELECT {_E2E}, num_topk FROM scored"""

_HN_VARIANTS = ", ".join(
    f"('hard_neg_{int(r * 100)}pct', {int(5 * r)}, {5 - int(5 * r)})" for r in RATIOS)

ORACLE["hard_negative_generate"] = f"""
  WITH ranked AS ({sql_ranked(100)}), {_PARTS},
  run AS (SELECT r.qid, r.doc_id, r.rank, p.title, p.text FROM ranked r JOIN parts p ON p.doc_id = r.doc_id),
  gt AS (SELECT p_partkey AS qid, lower(split_part(p_name, ' ', -1)) AS g FROM part),
  lab AS (SELECT run.*, coalesce(contains(lower(run.title), gt.g) OR contains(gt.g, lower(run.title)), false) AS is_gold
          FROM run LEFT JOIN gt ON gt.qid = run.qid),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY qid, is_gold ORDER BY rank, doc_id) AS ord FROM lab),
  variants AS (SELECT * FROM (VALUES {_HN_VARIANTS}) t(variant, n_noise, n_keep)),
  sel AS (SELECT v.variant, o.qid, o.title, o.text, o.ord, CASE WHEN o.is_gold THEN 'gold' ELSE 'hard_negative' END AS role
          FROM ordered o JOIN variants v
            ON o.ord <= greatest(CASE WHEN o.is_gold THEN v.n_keep ELSE v.n_noise END, 1)),
  {sql_shuffled('sel')}, {sql_asked('variants')}, {sql_best_line('(SELECT * FROM run WHERE rank >= 4)')}, {sql_finish(('gold', 'hard_negative'))}
  SELECT {_E2E}, num_gold, num_hard_negative FROM scored"""

_RN_VARIANTS = ", ".join(
    f"('random_noise_{int(r * 100)}pct', {int(5 * r)}, {5 - int(5 * r)})" for r in RATIOS)

ORACLE["random_negative_generate"] = f"""
  WITH RECURSIVE ranked AS ({sql_ranked(100)}), {_SPARSE},
  run AS (SELECT r.qid, r.doc_id, r.rank, d.title, d.text FROM ranked r JOIN sparse d ON d.doc_id = r.doc_id),
  variants AS (SELECT * FROM (VALUES {_RN_VARIANTS}) t(variant, n_noise, n_keep)),
  relevant AS (SELECT v.variant, r.qid, r.doc_id, r.title, r.text, r.rank AS ord FROM run r JOIN variants v ON r.rank <= v.n_keep),
  pool AS MATERIALIZED (SELECT doc_id, title, lower(coalesce(title, '')) AS ltitle, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM sparse),
  {_sample_sql(
      "SELECT v.variant, a.vec_id AS qid, lower(g.title) AS q_key, v.n_noise AS need FROM variants v "
      "CROSS JOIN embeddings a LEFT JOIN sparse g ON g.doc_id = a.vec_id",
      "pool",
      "coalesce(contains(lower(p.title), f.q_key) OR contains(f.q_key, lower(p.title)), false)"
      " OR EXISTS (SELECT 1 FROM relevant x WHERE x.variant = f.variant AND x.qid = f.qid"
      " AND x.doc_id = p.doc_id)", "ltitle", vcol="variant")},
  ctx AS (SELECT variant, qid, title, text, 'relevant' AS role, ord FROM relevant
          UNION ALL
          SELECT k.variant, k.qid, d.title, d.text, 'random' AS role, k.draw AS ord
          FROM picked k JOIN sparse d ON d.doc_id = k.doc_id),
  {sql_shuffled('ctx')}, {sql_asked('variants')}, {sql_best_line('run')}, {sql_finish(('relevant', 'random'))}
  SELECT {_E2E}, num_relevant, num_random FROM scored"""

_CFG_VARIANTS = ", ".join(
    f"('gold{g}_hard{h}{f'_top{m}' if m else ''}', {g}, {h}, {m})"
    for g, h, m in [(5, 0, 0), (4, 1, 0), (3, 2, 0), (0, 5, 0), (3, 2, 5)])

ORACLE["config_mix_generate"] = f"""
  WITH ranked AS ({sql_ranked(100)}), {_PARTS},
  run AS (SELECT r.qid, r.doc_id, p.title, p.text, row_number() OVER (PARTITION BY r.qid ORDER BY r.rank) AS pos
          FROM ranked r JOIN parts p ON p.doc_id = r.doc_id),
  lab AS (SELECT run.*, coalesce(lower(run.title) = lower(g.p_name), false) AS is_gold
          FROM run LEFT JOIN part g ON g.p_partkey = run.qid),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY qid, is_gold ORDER BY pos, doc_id) AS ord FROM lab),
  configs AS (SELECT * FROM (VALUES {_CFG_VARIANTS}) t(variant, k_gold, k_hard, mix_topk)),
  sel AS (SELECT c.variant, o.qid, o.title, o.text, CASE WHEN o.is_gold THEN 'gold' ELSE 'hard_negative' END AS role, o.ord
          FROM ordered o JOIN configs c ON o.ord <= CASE WHEN o.is_gold THEN c.k_gold ELSE c.k_hard END
          UNION ALL
          SELECT c.variant, o.qid, o.title, o.text, 'topk' AS role, o.pos AS ord
          FROM ordered o JOIN configs c ON o.pos <= c.mix_topk),
  gold AS (SELECT qid, arg_min(text, pos) AS gold_answer FROM lab WHERE is_gold GROUP BY qid),
  {sql_shuffled('sel')}, {sql_asked('configs')}, {sql_finish(('gold', 'hard_negative', 'topk'))}
  SELECT {_E2E}, num_gold, num_hard_negative, num_topk FROM scored"""

_RR_VARIANTS = ", ".join(
    f"('random_noise_{int(r * 100)}pct', {int(5 * r)}, {5 - int(5 * r)})" for r in (0.0, 0.5, 1.0))

ORACLE["random_run_generate"] = f"""
  WITH RECURSIVE ranked AS ({sql_ranked(100)}), {_SPARSE},
  run AS (SELECT r.qid, r.doc_id, d.title, d.text, row_number() OVER (PARTITION BY r.qid ORDER BY r.rank) AS rank
          FROM ranked r JOIN sparse d ON d.doc_id = r.doc_id),
  variants AS (SELECT * FROM (VALUES {_RR_VARIANTS}) t(variant, n_noise, n_keep)),
  relevant AS (SELECT v.variant, run.qid, run.title, run.text, run.rank AS ord
               FROM run JOIN variants v ON run.rank <= v.n_keep),
  pool AS MATERIALIZED (SELECT qid AS owner, rank AS owner_rank, doc_id, title, text,
                  row_number() OVER (ORDER BY qid, rank) - 1 AS idx
           FROM run WHERE rank > 30 AND rank <= 60),
  {_sample_sql(
      "SELECT v.variant, a.vec_id AS qid, a.vec_id AS q_key, v.n_noise AS need FROM variants v CROSS JOIN embeddings a",
      "pool", "p.owner = f.qid", "owner", vcol="variant", by_variant=False)},
  ctx AS (SELECT variant, qid, title, text, 'relevant' AS role, ord FROM relevant
          UNION ALL
          SELECT variant, qid, title, text, 'random' AS role, draw AS ord FROM picked),
  {sql_shuffled('ctx')}, {sql_asked('variants')}, {sql_best_line('run')}, {sql_finish(('relevant', 'random'))}
  SELECT {_E2E}, num_relevant, num_random FROM scored"""

_ENCODED = f"""
  WITH inputs AS (
    SELECT 'd' AS side, doc_id::VARCHAR AS id, CASE WHEN coalesce(source, '') <> '' THEN source || '[SEP]' || coalesce(text, '')
                                           ELSE coalesce(text, '') END AS input FROM documents
    UNION ALL SELECT 'q', conv_id || '-' || turn, coalesce(text, '') FROM conversations),
  tokens AS (SELECT side, id, unnest(regexp_extract_all(lower(input), '[^ \t\n\x0b\x0c\r]+')) AS tok FROM inputs),
  hashed AS (SELECT side, id, ('0x' || substr(md5(tok), 1, 15))::BIGINT AS h FROM tokens),
  slots AS (SELECT side, id, h % 64 AS slot, sum(CASE WHEN (h // 64) % 2 = 1 THEN -1.0 ELSE 1.0 END) AS x FROM hashed GROUP BY ALL),
  dense AS (SELECT i.side, i.id, list(coalesce(s.x, 0.0)::DOUBLE ORDER BY t.slot) AS v
            FROM inputs i CROSS JOIN range(0, 64) t(slot) LEFT JOIN slots s ON s.side = i.side AND s.id = i.id AND s.slot = t.slot
            GROUP BY i.side, i.id)"""

ORACLE["encode_topk"] = f"""{_ENCODED},
  scores AS (SELECT q.id AS qid, d.id::BIGINT AS doc_id, list_dot_product(q.v, q.v) * list_dot_product(d.v, d.v) AS n,
                    list_dot_product(q.v, d.v) AS dot FROM dense q JOIN dense d ON q.side = 'q' AND d.side = 'd'),
  ranked AS (SELECT qid, doc_id, CASE WHEN n = 0 THEN -1.0 ELSE dot / sqrt(n) END AS score FROM scores)
  SELECT qid, doc_id, round(score, 6) AS score, rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC) AS INTEGER) AS rank FROM ranked) x
  WHERE rank <= 5"""

ORACLE["encode_documents"] = f"""{_ENCODED}
  SELECT id::BIGINT AS doc_id, list_dot_product(v, v) AS norm2, list_dot_product(v, range(1, 65)::DOUBLE[]) AS weighted FROM dense WHERE side = 'd'"""

ORACLE["gold_titles"] = f"""
  WITH {_ORACLE_CTX_CTE}
  SELECT DISTINCT qid, lower(title) AS gold_title FROM facts"""

ORACLE["variant_quotas"] = """
  SELECT label, count(*) AS vectors, CAST(trunc(7 * (label / 10.0)) AS INTEGER) AS n_noise,
         7 - CAST(trunc(7 * (label / 10.0)) AS INTEGER) AS n_keep FROM embeddings GROUP BY label"""

ORACLE["exclude_used"] = f"""
  WITH ranked AS ({sql_ranked(10)})
  SELECT r.qid, r.doc_id, r.rank FROM ranked r JOIN embeddings q ON q.vec_id = r.qid JOIN embeddings d ON d.vec_id = r.doc_id
  WHERE r.rank <> 1 AND q.label <> d.label"""

ORACLE["masked_centroids"] = """
  WITH m AS (SELECT label, CAST(i - 1 AS INTEGER) AS dim, avg(CAST(embedding[i] AS DOUBLE)) AS value
             FROM embeddings, range(1, 65) t(i) WHERE vec_id % 2 = 1 AND label <> 3 GROUP BY label, i)
  SELECT l.label, m.dim, round(m.value, 6) AS value FROM (SELECT DISTINCT label FROM embeddings) l LEFT JOIN m ON m.label = l.label"""

ORACLE["row_similarity"] = """
  WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN vec_id % 9 = 0 THEN 0.0::DOUBLE ELSE x::DOUBLE END) AS v FROM embeddings)
  SELECT a.vec_id, round(CASE WHEN a.vec_id % 9 = 0 OR b.vec_id % 9 = 0 THEN -1.0 ELSE list_cosine_similarity(a.v, b.v) END, 6) AS cosine,
         round(list_dot_product(a.v, b.v), 6) AS dot
  FROM e a JOIN e b ON b.vec_id = a.vec_id + 7"""

ORACLE["topk_ties"] = """
  WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN vec_id % 50 = 0 THEN 0.0 ELSE sign(x) END::DOUBLE) AS v FROM embeddings),
  c AS (SELECT printf('d%06d-%d', vec_id, i) AS doc_id, v FROM e, range(0, 3) t(i)),
  q AS (SELECT printf('d%06d-1', vec_id) AS qid, v FROM e),
  s AS (SELECT qid, doc_id, list_dot_product(q.v, q.v) * list_dot_product(c.v, c.v) AS n, list_dot_product(q.v, c.v) AS dot
        FROM q JOIN c ON qid <> doc_id),
  r AS (SELECT qid, doc_id, CASE WHEN n = 0 THEN -1.0 ELSE dot / sqrt(n) END AS score FROM s)
  SELECT qid, doc_id, round(score, 9) AS score, rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC) AS INTEGER) AS rank FROM r) x WHERE rank <= 5"""

ORACLE["random_negatives_scarce"] = """
  SELECT q.label AS qid, e.vec_id AS doc_id FROM (SELECT DISTINCT label FROM embeddings) q JOIN embeddings e ON e.label > q.label"""

ORACLE["questions_roundtrip"] = """
  SELECT conv_id || '-' || turn AS qid, text AS question, role AS gold_answer, 3 AS n_facts, role AS first_title,
         CAST(turn AS INTEGER) AS second_index, true AS third_unknown, 1 AS n_paragraphs, text AS sentences FROM conversations"""

ORACLE["passages_roundtrip"] = """
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 3 > 0 THEN coalesce(source, '') ELSE '' END AS title,
         sha256(coalesce(text, '')) AS text_sha256 FROM documents"""

ORACLE["predictions_roundtrip"] = f"""
  WITH {_CONV_PRED}
  SELECT 'conversations' AS experiment, role AS variant, conv_id || '-' || turn AS qid, prediction,
         CASE WHEN has_gold THEN gold_answer END AS gold_answer, turn / 4.0::DOUBLE AS noise_ratio, role AS context_id,
         turn % 2 = 0 AS is_random FROM joined"""

ORACLE["evaluate_folder"] = f"""
  WITH {_CONV_PRED},
  firsts AS (SELECT role, min({{'conv_id': conv_id, 'turn': turn}}) AS k FROM scored GROUP BY role),
  runs AS (SELECT role AS variant, exact_match, cover_exact_match FROM scored
           UNION ALL
           SELECT 'single', exact_match, cover_exact_match FROM scored s JOIN firsts f ON f.role = s.role AND f.k.conv_id = s.conv_id AND f.k.turn = s.turn)
  SELECT r.variant, count(s.variant) AS num_samples, round(coalesce(avg(s.exact_match), 0.0) * 100, 2) AS em_pct,
         round(coalesce(avg(s.cover_exact_match), 0.0) * 100, 2) AS cem_pct
  FROM (SELECT DISTINCT variant FROM runs UNION ALL SELECT 'empty') r LEFT JOIN runs s ON s.variant = r.variant
  GROUP BY r.variant"""

ORACLE["report_roundtrip"] = f"""
  WITH {_CONV_PRED}
  SELECT role AS variant, count(*) AS num_samples, round(avg(exact_match), 6) AS exact_match, sum(exact_match)::BIGINT AS hits,
         CASE WHEN role = 'user' THEN '["conv_id", "turn", "again"]' ELSE '["conv_id", "turn"]' END AS config_keys FROM scored GROUP BY role"""

ORACLE["generate_resumed"] = ORACLE["rescore_generate"]

ORACLE["topk_pruned"] = ORACLE["topk_cosine"]
