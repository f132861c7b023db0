"""DuckDB texts of the fixtures and core operators, used by ``oracle_sql()``.

Each builder returns CTE definitions (``name AS (...)``) that later oracle
queries chain.  They read the driver's pre-registered views (``documents``...).
"""

from __future__ import annotations

from tagflow.functions.text import BASIC_PATTERN, CONTROL_PATTERN, duck_word_tokens
from tagflow.schema import entity_types_sql

LAB = entity_types_sql()


def fa_spans_ctes() -> str:
    """F-A spans in long form: spans(doc_id, j, text, label)."""
    return f"""
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '') AS w
      FROM documents),
spans AS (SELECT doc_id, CAST(j AS INT) AS j,
      array_to_string(w[((doc_id*7 + j*11) % len(w)) + 1 : ((doc_id*7 + j*11) % len(w)) + 1 + (doc_id + j) % 3], ' ') AS text,
      {LAB}[((doc_id + j) % 14) + 1] AS label
    FROM w, range(3) r(j) WHERE len(w) > 0)"""


def tokens_ctes(max_len: int | None = None, src: str = "documents") -> str:
    tk = duck_word_tokens("text")
    if max_len is not None:
        tk = f"({tk})[1:{int(max_len)}]"
    return f"""
t AS MATERIALIZED (SELECT doc_id, unnest(tk) AS tok, CAST(generate_subscripts(tk, 1) - 1 AS INT) AS pos
      FROM (SELECT doc_id, {tk} AS tk FROM {src}))"""


def entity_ctes() -> str:
    return f"""
e0 AS (SELECT doc_id, j, label, {duck_word_tokens('text')} AS et FROM spans),
e AS MATERIALIZED (SELECT doc_id, j, label, len(et) AS n, unnest(et) AS tok, generate_subscripts(et, 1) - 1 AS k FROM e0)"""


def locate_ctes() -> str:
    return """
c AS (SELECT e.doc_id, j, label, n, pos - k AS s FROM e JOIN t ON e.doc_id = t.doc_id AND e.tok = t.tok
      GROUP BY e.doc_id, j, label, n, pos - k HAVING count(*) = n),
f AS MATERIALIZED (SELECT doc_id, j, label, n, CAST(min(s) AS INT) AS s FROM c GROUP BY doc_id, j, label, n)"""


def bio_rows() -> list[str]:
    return [f"""
p AS (SELECT doc_id, j, label, s, unnest(range(s, s + n)) AS pos FROM f),
g AS MATERIALIZED (SELECT doc_id, pos,
        arg_max(CASE WHEN pos = s THEN 'B-' ELSE 'I-' END || label, j) AS tag,
        arg_max(CASE WHEN pos = s THEN 1 ELSE 15 END + list_position({LAB}, label) - 1, j) AS tag_id
      FROM p GROUP BY doc_id, pos),
bio AS (SELECT t.doc_id, CAST(t.pos AS INT) AS pos, t.tok, coalesce(g.tag, 'O') AS tag,
          CAST(coalesce(g.tag_id, 0) AS INT) AS tag_id
        FROM t LEFT JOIN g ON t.doc_id = g.doc_id AND t.pos = g.pos)"""]


def bio_ctes(max_len: int | None = None) -> str:
    """F-A spans aligned on documents: bio(doc_id, pos, tok, tag, tag_id)."""
    return ",".join([fa_spans_ctes(), tokens_ctes(max_len), entity_ctes(), locate_ctes(), *bio_rows()])


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def fc_spans_ctes() -> str:
    """F-C after parsing: spans of documents not multiple of 17; span 0 of multiples of 29 relabelled."""
    return fa_spans_ctes() + """,
fc AS (SELECT doc_id, j, text,
         CASE WHEN doc_id % 29 = 0 AND j = 0 THEN 'NOT_A_LABEL' ELSE label END AS label
       FROM spans WHERE doc_id % 17 <> 0)"""


def section_numbers() -> str:
    """num(doc_id, split, section, n, part_id): numbers over all sections and within each."""
    return """
parts AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'dev' ELSE 'train' END AS split, CASE WHEN lang = 'en' THEN 'judgement' ELSE 'preamble' END AS section FROM documents),
num AS (SELECT *, row_number() OVER (ORDER BY split DESC, section, doc_id) - 1 AS n, row_number() OVER (PARTITION BY split, section ORDER BY doc_id) - 1 AS part_id FROM parts)"""


def section_ctes() -> str:
    """bio of the documents that pass P4 under F-C spans, and their numbers over the sections."""
    spans = fa_spans_ctes().replace("spans AS", "own AS", 1) + """,
spans AS (SELECT * FROM own WHERE doc_id % 17 <> 0),
kept AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM spans WHERE doc_id % 29 = 0))"""
    return ",".join([spans, section_numbers(), tokens_ctes(src="kept"), entity_ctes(), locate_ctes(), *bio_rows()])


PRED_SQL = """CAST(CASE WHEN (doc_id*31 + pos) % 7 = 0 THEN (tag_id + 1) % 29
                  WHEN (doc_id + pos) % 13 = 0 THEN 0 ELSE tag_id END AS INT)"""


def fb_ctes(max_len: int | None = None) -> str:
    """F-B: pred(doc_id, pos, true_id, pred_id)."""
    return bio_ctes(max_len) + f""",
pred AS (SELECT doc_id, pos, tag_id AS true_id, {PRED_SQL} AS pred_id FROM bio)"""


def padded_ctes() -> str:
    """The bio table as one array per document, padded to the corpus maximum (token '<PAD>', label 29)."""
    return bio_ctes() + """,
seqs AS (SELECT doc_id, list(tok ORDER BY pos) AS toks, list(tag_id ORDER BY pos) AS labels, len(list(tok)) AS n FROM bio GROUP BY doc_id),
mx AS (SELECT max(n) AS m FROM seqs),
padded AS (SELECT doc_id, toks || list_transform(range(m - n), lambda x: '<PAD>') AS toks,
                  labels || list_transform(range(m - n), lambda x: 29) AS labels FROM seqs, mx)"""


SHAPE_SQL = r"""CASE WHEN regexp_full_match(tok, '\p{N}+') THEN 'NUM'
     WHEN NOT regexp_matches(tok, '[\p{L}\p{N}_]') THEN 'PUNCT'
     WHEN regexp_matches(tok, '^\p{Lu}') THEN 'CAP' ELSE 'LOW' END"""


def features_ctes() -> str:
    """Tagged tokens tt and per-token features ft (six slots)."""
    return bio_ctes() + f""",
tt AS (SELECT doc_id, pos, tok, tag_id, {SHAPE_SQL} AS pos_tag,
         CASE WHEN doc_id % 5 = 0 THEN 'dev' ELSE 'train' END AS split FROM bio),
ft AS (SELECT doc_id, pos, split, tag_id,
         'word=' || tok AS f_word,
         'prev_word=' || lag(tok, 1, '<unk>') OVER w AS f_prev_word,
         'next_word=' || lead(tok, 1, '<unk>') OVER w AS f_next_word,
         'pos=' || pos_tag AS f_pos,
         coalesce('prev_pos=' || lag(pos_tag) OVER w,
                  'prev_pos=pos=' || last_value(pos_tag) OVER (PARTITION BY doc_id ORDER BY pos
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS f_prev_pos,
         coalesce('next_pos=' || lead(pos_tag) OVER w, 'next_pos=pos=' || pos_tag) AS f_next_pos
       FROM tt WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
fl AS (SELECT doc_id, pos, split, CAST(generate_subscripts(fs, 1) - 1 AS INT) AS slot, unnest(fs) AS feature
       FROM (SELECT doc_id, pos, split, [f_word, f_prev_word, f_next_word, f_pos, f_prev_pos, f_next_pos] AS fs FROM ft)),
fdict AS (SELECT feature, row_number() OVER (ORDER BY feature) + 1 AS feature_id
          FROM (SELECT DISTINCT feature FROM fl WHERE split = 'train' AND feature NOT IN ('<PAD>', '<UNK>'))
          UNION ALL SELECT '<PAD>', 0 UNION ALL SELECT '<UNK>', 1)"""


def vocab_sql(where: str = "") -> str:
    return f"""
 SELECT word, word_id FROM (
   SELECT tok AS word, row_number() OVER (ORDER BY tok) + 1 AS word_id
   FROM (SELECT DISTINCT tok FROM tt WHERE tok NOT IN ('<UNK>', '<PAD>') {where})
   UNION ALL SELECT '<UNK>', 0 UNION ALL SELECT '<PAD>', 1)"""


# ---------------------------------------------------------------- subwords (F-F vocabulary, greedy segmentation)
BASIC_SQL = "'" + BASIC_PATTERN + "'"


def basic_sql(text: str = "text") -> str:
    """Basic words: control characters gone, lower case, CJK characters and marks apart."""
    return f"regexp_extract_all(lower(regexp_replace({text}, '{CONTROL_PATTERN}', '', 'g')), {BASIC_SQL})"


def wp_vocab_ctes() -> str:
    return rf"""
bw AS (SELECT unnest({basic_sql()}) AS word FROM documents),
sw AS (SELECT strip_accents(word) AS w FROM bw),
ch AS (SELECT DISTINCT unnest(string_split(w, '')) AS c FROM sw),
tw AS (SELECT w FROM (SELECT w, count(*) AS n FROM sw GROUP BY w) ORDER BY n DESC, w LIMIT 500),
pc AS (SELECT DISTINCT piece FROM (SELECT c AS piece FROM ch WHERE c <> '' UNION ALL SELECT '##' || c FROM ch WHERE c <> ''
                                   UNION ALL SELECT w FROM tw)
       WHERE piece NOT IN ('[PAD]', '[UNK]', '[CLS]', '[SEP]')),
v AS (SELECT piece, CAST(row_number() OVER (ORDER BY piece) + 3 AS INT) AS piece_id FROM pc
      UNION ALL SELECT * FROM (VALUES ('[PAD]', 0), ('[UNK]', 1), ('[CLS]', 2), ('[SEP]', 3)) s(piece, piece_id))"""


def wp_segment_ctes(words_cte: str, pre: str) -> str:
    """{pre}wseg(word, pieces): greedy longest match (recursive CTE); uncovered or >100 chars -> [UNK]."""
    return rf""",
{pre}ww AS (SELECT DISTINCT word, strip_accents(word) AS w FROM {words_cte}),
{pre}seg AS (
  WITH RECURSIVE s(word, w, pos, i, piece) AS (
    SELECT word, w, 1, 0, ''::VARCHAR FROM {pre}ww WHERE length(w) <= 100
    UNION ALL
    SELECT s.word, s.w, s.pos + length(m.p) - CASE WHEN s.pos > 1 THEN 2 ELSE 0 END, s.i + 1, m.p
    FROM s, LATERAL (SELECT arg_max(v.piece, length(v.piece)) AS p FROM v
                     WHERE (s.pos = 1 AND v.piece NOT LIKE '##%' AND starts_with(s.w, v.piece))
                        OR (s.pos > 1 AND v.piece LIKE '##%' AND starts_with(substr(s.w, s.pos), substr(v.piece, 3)))) m
    WHERE s.pos <= length(s.w) AND m.p IS NOT NULL)
  SELECT word, list(piece ORDER BY i) FILTER (WHERE i > 0) AS pieces, max(pos) > length(w) AS ok FROM s GROUP BY word, w),
{pre}wseg AS (SELECT x.word, CASE WHEN y.ok THEN y.pieces ELSE ['[UNK]'] END AS pieces
              FROM {pre}ww x LEFT JOIN {pre}seg y ON x.word = y.word)"""


def wp_doc_ctes(max_len: int = 512) -> str:
    """dpi(doc_id, pos, piece, piece_id): [CLS] pieces [SEP] cut to max_len; dpad: padded to max_len."""
    return rf""",
dw AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS wpos
       FROM (SELECT doc_id, {basic_sql()} AS ws FROM documents))""" + \
        wp_segment_ctes("dw", "d_") + f""",
dl AS (SELECT doc_id, list(piece ORDER BY wpos, k) AS ps FROM (
         SELECT doc_id, wpos, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM dw JOIN d_wseg USING (word))
       GROUP BY doc_id),
dq AS (SELECT d.doc_id, ['[CLS]'] || coalesce(dl.ps[1:{max_len - 2}], []) || ['[SEP]'] AS ps
       FROM documents d LEFT JOIN dl ON d.doc_id = dl.doc_id),
dp AS (SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INT) AS pos, unnest(ps) AS piece FROM dq),
dpi AS (SELECT doc_id, pos, dp.piece, CAST(coalesce(v.piece_id, 1) AS INT) AS piece_id FROM dp LEFT JOIN v USING (piece)),
dlen AS (SELECT doc_id, max(pos) + 1 AS n FROM dpi GROUP BY doc_id),
dpad AS (SELECT doc_id, pos, piece, piece_id FROM dpi
         UNION ALL SELECT doc_id, CAST(unnest(range(n, {max_len})) AS INT) AS pos, '[PAD]' AS piece, 0 AS piece_id FROM dlen)"""


def wp_entity_ctes() -> str:
    """epi(doc_id, j, label, pos, piece_id): F-A span texts as pieces, no specials, no cut (needs spans)."""
    return rf""",
ew AS (SELECT doc_id, j, label, unnest(ws) AS word, generate_subscripts(ws, 1) AS wpos
       FROM (SELECT doc_id, j, label, {basic_sql()} AS ws FROM spans))""" + \
        wp_segment_ctes("ew", "e_") + """,
ep0 AS (SELECT doc_id, j, label, list(piece ORDER BY wpos, k) AS ps FROM (
          SELECT doc_id, j, label, wpos, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k
          FROM ew JOIN e_wseg USING (word))
        GROUP BY doc_id, j, label),
ep AS (SELECT doc_id, j, label, CAST(generate_subscripts(ps, 1) - 1 AS INT) AS pos, unnest(ps) AS piece FROM ep0),
epi AS (SELECT doc_id, j, label, pos, CAST(coalesce(v.piece_id, 1) AS INT) AS piece_id FROM ep LEFT JOIN v USING (piece))"""


def chain_sql(best: bool) -> str:
    """One step of the forward recursion over the fixed chain as a lambda (s, e) for list_reduce.

    The score from tag a to tag b depends only on (7a + 3b) mod 11, so eleven sums over the previous tags serve all tags.
    ``best``: highest score (whole numbers, times 64); else the scaled probability vector, its log scale as element 31.
    """
    from math import exp
    step = lambda q, a: ((7 * a + q) % 11 - 5) * 8
    if best:
        into = [f"greatest({', '.join(f's[{a + 1}] + ({step(q, a)})' for a in range(30))})" for q in range(11)]
        tags = ", ".join(f"e[{b + 1}] + v[{3 * b % 11 + 1}]" for b in range(30))
        return f"lambda s, e: list_transform([[{', '.join(into)}]], lambda v: [{tags}])[1]"
    into = [" + ".join(f"s[{a + 1}] * {exp(step(q, a) / 64)!r}" for a in range(30)) for q in range(11)]
    total = " + ".join(f"s[{a + 1}]" for a in range(30))
    tags = ", ".join(f"exp(e[{b + 1}]) * v[{3 * b % 11 + 1}] / v[12]" for b in range(30))
    return f"lambda s, e: list_transform([[{', '.join(into)}, {total}, s[31]]], lambda v: [{tags}, v[13] + ln(v[12])])[1]"


# ---------------------------------------------------------------- softmax on sparse features, full-batch gradient descent
def softmax_ctes(steps: int, lr: float, tags: int = 30) -> str:
    """sm0 .. sm{steps}: every token with its scores under the weights after so many steps from zero (em, top, z, ll of its own tag)."""
    out = [features_ctes(), """
tn AS (SELECT count(DISTINCT doc_id) AS n FROM ft WHERE split = 'train'),
dn AS (SELECT count(DISTINCT doc_id) AS n FROM ft WHERE split = 'dev'),
fx AS MATERIALIZED (SELECT fl.doc_id, fl.pos, fl.split, ft.tag_id, coalesce(d.feature_id, 1) AS fid
                    FROM fl JOIN ft USING (doc_id, pos) LEFT JOIN fdict d ON fl.feature = d.feature),
em0 AS (SELECT DISTINCT doc_id, pos, split, tag_id, """ + f"list_transform(range({tags}), lambda t: 0.0::DOUBLE) AS em FROM fx)"]
    for k in range(steps + 1):
        if k:
            out.append(f"""
gd{k} AS (SELECT fx.fid, {', '.join(f"sum(exp(em[{t + 1}] - top) / z - CASE WHEN sm{k - 1}.tag_id = {t} THEN 1 ELSE 0 END) AS g{t}" for t in range(tags))}
         FROM fx JOIN sm{k - 1} USING (doc_id, pos) WHERE fx.split = 'train' GROUP BY fx.fid),
wg{k} AS MATERIALIZED (SELECT gd{k}.fid, {', '.join((f"wg{k - 1}.w{t}" if k > 1 else "0") + f" - {lr}::DOUBLE / n * g{t} AS w{t}" for t in range(tags))}
         FROM gd{k}{f" JOIN wg{k - 1} ON wg{k - 1}.fid = gd{k}.fid" if k > 1 else ""}, tn),
em{k} AS (SELECT doc_id, pos, any_value(fx.split) AS split, any_value(tag_id) AS tag_id, [{', '.join(f"coalesce(sum(w{t}), 0)" for t in range(tags))}] AS em
         FROM fx LEFT JOIN wg{k} ON wg{k}.fid = fx.fid GROUP BY doc_id, pos)""")
        out.append(f"""
tp{k} AS (SELECT *, list_max(em) AS top FROM em{k}),
sm{k} AS MATERIALIZED (SELECT *, list_sum(list_transform(em, lambda x: exp(x - top))) AS z FROM tp{k})""")
    return ",".join(out)


def softmax_history(epochs: int, lr: float) -> str:
    """h(epoch, loss, n_batches, val_loss, dev_f1) of full-batch training."""
    loss = lambda k, split, n: f"(SELECT -sum(em[tag_id + 1] - top - ln(z)) FROM sm{k} WHERE split = '{split}') / {n}.n"
    pred = "list_position(em, top) - 1"
    rows = [f"""SELECT {k} AS epoch, {loss(k, 'train', 'tn')} AS loss, 1 AS n_batches, {loss(k + 1, 'dev', 'dn')} AS val_loss,
  (SELECT count(*) FILTER (WHERE p = tag_id AND p <> 0) AS tp FROM (SELECT tag_id, {pred} AS p FROM sm{k + 1} WHERE split = 'dev')) AS tp,
  (SELECT count(*) FILTER (WHERE {pred} <> 0) FROM sm{k + 1} WHERE split = 'dev') AS n_pred, (SELECT count(*) FILTER (WHERE tag_id <> 0) FROM sm{k + 1} WHERE split = 'dev') AS n_true
 FROM tn, dn""" for k in range(epochs)]
    return softmax_ctes(epochs, lr) + ",\nh0 AS (" + "\n UNION ALL ".join(rows) + """),
h1 AS (SELECT *, tp / greatest(n_pred, 1) AS p, tp / greatest(n_true, 1) AS r FROM h0),
h AS (SELECT CAST(epoch AS INT) AS epoch, round(loss, 6) AS loss, n_batches, round(val_loss, 6) AS val_loss,
             round(CASE WHEN p + r = 0 THEN -1.0::DOUBLE ELSE 2 * p * r / (p + r) END, 6) AS dev_f1 FROM h1)"""
