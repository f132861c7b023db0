"""DuckDB SQL for the registered queries that SQL can express: quality rules, sharding, mixing, PII.

The others need a tokenizer, XXH64, coin tossing, HTML parsing or a fitted linear model; tests/llm compare those with brute force.
"""

from __future__ import annotations

from tagflow.llm import mixing as m
from tagflow.llm import pii
from tagflow.llm import quality_rules as q

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"



def quality_sql() -> str:
    rules = list(q.RULES)
    functions = ", ".join("'" + w + "'" for w in sorted(set(q.FUNCTION_WORDS)))
    votes = ",\n        ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS {r}" for r, (good, bad) in q.RULES.items())
    odds = " + ".join(f"{r} * ln(acc[{k + 1}] / (1 - acc[{k + 1}]))" for k, r in enumerate(rules))
    rate = ", ".join(f"""least(greatest((sum(CASE {r} WHEN 1 THEN n * p WHEN -1 THEN n - n * p ELSE 0 END) + {q.PSEUDO * q.FIRST})
            / (sum(CASE WHEN {r} <> 0 THEN n ELSE 0 END) + {q.PSEUDO}), {q.LOW}), {q.HIGH})""" for r in rules)
    post = f"1 / (1 + exp(-(ln(prior / (1 - prior)) + {odds})))"
    return rf"""WITH RECURSIVE
 d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w,
              list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
 g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
 rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
           SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
 c AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
              length(text) - length(translate(text, '{q.SYMBOLS}', '')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
              coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_upper,
              len(list_filter(w, lambda x: x IN ({functions}))) AS n_function, len(list_filter(w, lambda x: suffix(x, '!'))) AS n_shouts,
              len(list_filter(w, lambda x: length(x) > 25)) AS n_long
       FROM d LEFT JOIN rep USING (doc_id)),
 v AS MATERIALIZED (SELECT *,
        {votes} FROM c),
 pat AS MATERIALIZED (SELECT {', '.join(rules)}, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY ALL),
 em AS (SELECT 0 AS i, CAST({q.PRIOR} AS DOUBLE) AS prior, [{', '.join(['CAST(' + str(q.FIRST) + ' AS DOUBLE)'] * len(rules))}] AS acc
        UNION ALL
        SELECT i + 1, (sum(n * p) + {q.PSEUDO * q.PRIOR}) / (sum(n) + {q.PSEUDO}), [{rate}]
        FROM (SELECT em.i, pat.*, {post} AS p FROM em, pat WHERE em.i < {q.ROUNDS}) GROUP BY i),
 s AS (SELECT v.*, {q.BASE_FAILED} AS base_failed, {post} AS p FROM v, em WHERE em.i = {q.ROUNDS})
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, round(p, 4) AS quality,
       NOT base_failed AND p >= 0.5 AS kept FROM s"""


def crc32_sql(text: str) -> str:
    """CRC-32 (the reflected polynomial EDB88320) of a string's UTF-8 bytes; the byte table is built by its rule."""
    table = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ 0xEDB88320 * (x & 1)
        table.append(x)
    digit = "(instr('0123456789ABCDEF', {}) - 1)"
    byte = f"CAST({digit.format('h[1]')} * 16 + {digit.format('h[2]')} AS BIGINT)"
    step = f"xor(s >> 8, {table}[xor(s, b) & 255 + 1])".replace("xor(s, b) & 255 + 1", "(xor(s, b) & 255) + 1")
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex({text}), '..'), lambda h: {byte})), "
            f"lambda s, b: {step}), 4294967295)")


SHARD_SQL = f"""WITH d AS (SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS src, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size,
          {crc32_sql("coalesce(text, '')")} AS text_crc32, md5('11:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
 r AS (SELECT *, (row_number() OVER (PARTITION BY none, src ORDER BY k, doc_id, text_crc32, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY none, src) AS frac FROM d),
 o AS (SELECT *, row_number() OVER (ORDER BY frac, none, src, k, doc_id, text_crc32, size) - 1 AS g, count(*) OVER () AS n FROM r),
 s AS (SELECT *, g * 40 // n AS shard FROM o)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard, CAST(g - (shard * n + 39) // 40 AS BIGINT) AS slot,
       CAST(NULL AS INT) AS grown_shard FROM s"""

MIX_SQL = f"""WITH d AS (SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS src, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
 s AS (SELECT none, src, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY none, src) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY none, src),
 a AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
 l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, none, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(w) OVER (ORDER BY cap / w, none, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM a),
 t AS (SELECT none, src, source_size, least(cap, coalesce((SELECT arg_min(level, (cap / w, level)) FROM l WHERE level * w <= cap) * w, cap)) AS target FROM l),
 e AS (SELECT row_number() OVER () AS id, d.*, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS quota,
              sum(size) OVER (PARTITION BY none, src ORDER BY md5('17:' || CAST(doc_id AS VARCHAR)), doc_id) - size AS b1,
              source_size + sum(size) OVER (PARTITION BY none, src ORDER BY md5('19:' || CAST(doc_id AS VARCHAR)), doc_id) - size AS b2
       FROM d JOIN t USING (none, src)),
 span AS (SELECT id, none, src, b1 AS lo, least(b1 + size, quota) AS hi FROM e UNION ALL SELECT id, none, src, b2, least(b2 + size, quota) FROM e),
 cut AS (SELECT id, none, src, unnest(range(CAST(lo // {m.BLOCK_WORDS} AS BIGINT), CAST((hi - 1) // {m.BLOCK_WORDS} + 1 AS BIGINT))) AS block FROM span WHERE hi > lo),
 need AS (SELECT none, src, (CAST(floor(target + 0.5) AS BIGINT) + {m.BLOCK_WORDS - 1}) // {m.BLOCK_WORDS} AS blocks FROM t WHERE floor(target + 0.5) > 0),
 range_of AS (SELECT *, (sum(blocks) OVER w - blocks) / sum(blocks) OVER () AS lo, sum(blocks) OVER w / sum(blocks) OVER () AS hi FROM need
              WINDOW w AS (ORDER BY none, src)),
 n AS (SELECT CAST(coalesce(sum(blocks), 0) AS BIGINT) AS n FROM need),
 slots AS (SELECT k AS slot, CAST('0b' || reverse(lpad(bin(k), 48, '0')) AS BIGINT) / 281474976710656.0::DOUBLE AS u FROM (SELECT unnest(range(n)) AS k FROM n)),
 ranked AS (SELECT none, src, blocks, slot, row_number() OVER (PARTITION BY none, src ORDER BY slot) - 1 AS block FROM slots JOIN range_of ON lo <= u AND u < hi),
 late AS (SELECT none, src, blocks, least(blocks, (SELECT count(*) FROM ranked WHERE ranked.none = need.none AND ranked.src = need.src)) AS had FROM need),
 place AS (SELECT none, src, block, slot FROM ranked WHERE block < blocks
           UNION ALL SELECT none, src, had + i, n + before + i FROM (SELECT none, src, had, n, before, unnest(range(blocks - had)) AS i
             FROM (SELECT *, CAST(sum(blocks - had) OVER (ORDER BY none, src) - (blocks - had) AS BIGINT) AS before FROM late), n))
SELECT e.doc_id, size, source_size, target, CAST(greatest(0, least(b1 + size, quota) - b1) + greatest(0, least(b2 + size, quota) - b2) AS BIGINT) AS taken,
       CAST(coalesce(s.first_slot, -1) AS BIGINT) AS first_slot, CAST(coalesce(s.n_slots, 0) AS BIGINT) AS n_slots
FROM e LEFT JOIN (SELECT id, min(slot) AS first_slot, count(DISTINCT slot) AS n_slots FROM cut JOIN place USING (none, src, block) GROUP BY id) AS s ON s.id = e.id"""


def pii_sql(window: int = 5, alpha: float = 1.5, min_docs: int = 2) -> str:
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    term = r"\p{L}[\p{L}\p{M}''’]*"
    # matches as rows: the i-th match stands behind i + 1 gaps and i matches
    hits = "\n UNION ALL ".join(
        f"SELECT doc_id, {k} AS kind, unnest(regexp_extract_all(text, '{plain[kind]}')) AS m, unnest(string_split_regex(text, '{plain[kind]}')[:-2]) AS gap, "
        f"generate_subscripts(regexp_extract_all(text, '{plain[kind]}'), 1) AS i FROM d WHERE regexp_matches(text, '{plain[kind]}')"
        for k, kind in enumerate(pii.KINDS))
    luhn = ("list_sum(list_transform(range(1, length(digits) + 1), lambda i: (CASE WHEN i % 2 = 1 THEN CAST(digits[length(digits) + 1 - i] AS INT) "
            "WHEN CAST(digits[length(digits) + 1 - i] AS INT) > 4 THEN 2 * CAST(digits[length(digits) + 1 - i] AS INT) - 9 "
            "ELSE 2 * CAST(digits[length(digits) + 1 - i] AS INT) END))) % 10 = 0")

    def near(side: str, piece: str) -> str:
        return (f"SELECT doc_id, e, lo, hi, '{side}' AS side, x, n, unnest(regexp_extract_all({piece}, '{term}')) AS t, unnest(string_split_regex({piece}, '{term}')[:-2]) AS gap, "
                f"generate_subscripts(regexp_extract_all({piece}, '{term}'), 1) AS i FROM ctx WHERE regexp_matches({piece}, '{term}')")

    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 raw AS ({hits}),
 loc AS (SELECT doc_id, kind, m, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) - length(m) AS BIGINT) AS s,
               regexp_replace(m, '[^0-9]', '', 'g') AS digits FROM raw),
 b AS MATERIALIZED (SELECT doc_id, kind, m, s, s + length(m) AS f FROM loc WHERE kind = 0
        OR kind = 1 AND len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INT), 0) > 255)) = 0
        OR kind = 2 AND length(digits) BETWEEN 12 AND 19 AND {luhn} OR kind = 3 AND length(digits) BETWEEN 9 AND 15),
 ctx AS (SELECT doc_id, kind || ':' || lower(m) AS e, s AS lo, f AS hi, substr(text, 1, s) AS x, substr(text, f + 1) AS n FROM b JOIN d USING (doc_id)),
 sides AS ({near("l", "x")} UNION ALL {near("r", "n")}),
 pos AS (SELECT *, CAST(sum(length(gap) + length(t)) OVER (PARTITION BY doc_id, e, lo, side ORDER BY i) - length(t) AS BIGINT) AS p FROM sides),
 whole AS (SELECT *, p + length(t) AS q FROM pos),
 best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, e, lo, side ORDER BY CASE WHEN side = 'l' THEN -p ELSE p END) AS k FROM whole),
 nb AS MATERIALIZED (SELECT doc_id, e, lower(t) AS t, CASE WHEN side = 'l' THEN p ELSE hi + p END AS s, CASE WHEN side = 'l' THEN q ELSE hi + q END AS f FROM best WHERE k <= {window}),
 clear AS (SELECT * FROM nb WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = nb.doc_id AND b.s < nb.f AND b.f > nb.s)),
 net AS (SELECT e, t, count(DISTINCT doc_id) AS n_et FROM clear GROUP BY e, t HAVING count(DISTINCT doc_id) >= {min_docs}),
 ne AS (SELECT kind || ':' || lower(m) AS e, count(DISTINCT doc_id) AS n_e FROM b GROUP BY 1),
 nt AS (SELECT t, count(*) AS n_t FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{term}')) AS t FROM d) GROUP BY t),
 told AS (SELECT e, t FROM net JOIN ne USING (e) JOIN nt USING (t), (SELECT CAST(count(*) AS DOUBLE) AS n FROM d)
          WHERE log2(n / n_e) > 0 AND log2(n * n_et / (CAST(n_e AS DOUBLE) * n_t)) + 1e-9 >= log2(n / n_e) / {alpha}),
 terms AS (SELECT DISTINCT doc_id, s, 4 AS kind, f FROM clear JOIN told USING (e, t)),
 names AS (SELECT doc_id, s, kind, f, ['email', 'ip', 'card', 'phone', 'term'][kind + 1] || ':' || s || ':' || f AS line
           FROM (SELECT doc_id, s, kind, f FROM b UNION ALL SELECT doc_id, s, kind, f FROM terms)),
 per AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_email, count(*) FILTER (WHERE kind = 1) AS n_ip, count(*) FILTER (WHERE kind = 2) AS n_card,
                count(*) FILTER (WHERE kind = 3) AS n_phone, string_agg(line, ',' ORDER BY s, kind, f) FILTER (WHERE kind < 4) AS base, string_agg(line, ',' ORDER BY s, kind, f) AS spans
         FROM names GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (doc_id)"""


def repair_sql() -> str:
    """Cheapest edits and repaired lines from the end to the start, for the four states of the automaton (start, after s, after u, after a)."""
    role = {2: "user", 3: "assistant"}
    follows = {0: 2, 1: 2, 2: 3, 3: 2}
    keep = {0: "CASE c WHEN 's' THEN 2 WHEN 'u' THEN 3 END", 1: "CASE c WHEN 'u' THEN 3 END", 2: "CASE c WHEN 'a' THEN 4 END", 3: "CASE c WHEN 'u' THEN 3 END"}
    best = lambda *x: f"list_min(list_filter([{', '.join(x)}], lambda z: z IS NOT NULL))"
    step = lambda cost, letter, line, to: f"{{'c': {cost} + ({to}).c, 'a': '{letter}' || ({to}).a, 't': {line} || ({to}).t}}"
    own, stays = "chr(10) || role || ':' || text", "fault IN ('', 'truncated')"
    passed = [best(step(4, "D", "''", f"v[{q + 1}]"),
                   f"CASE WHEN {stays} AND ({keep[q]}) IS NOT NULL THEN {step('late', 'K', own, f'v[{keep[q]}]')} END",
                   f"CASE WHEN {stays} THEN {step('3 + late', 'R', f"chr(10) || '{role[follows[q]]}:' || text", f'v[{follows[q] + 1}]')} END") for q in range(4)]
    empty = lambda q: f"chr(10) || '{role[follows[q]]}:'"
    put = lambda q: step(3, "I", empty(q), f"w[{follows[q] + 1}]")
    closed = [best(f"w[{q + 1}]", put(q), step(3, "I", empty(q), f"({put(follows[q])})")) for q in range(4)]
    end = ("[{'c': 0, 'a': '', 't': ''}, {'c': 6, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}, "
           "{'c': 3, 'a': 'I', 't': chr(10) || 'assistant:'}, {'c': 0, 'a': '', 't': ''}]")
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    return rf"""WITH RECURSIVE
 k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql(key)} % 20 AS f FROM conversations),
 d AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
              unnest(CASE f WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE f <> 0),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_replace(text, '[ 	-
]+$', '') AS bare FROM d),
 f AS (SELECT conv_id, i, role, text, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '' END AS c,
              CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                   WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
 g AS (SELECT *, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS late, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM f),
 s AS (SELECT conv_id, max(i) + 1 AS i, {end} AS v FROM g GROUP BY conv_id
       UNION ALL
       SELECT conv_id, i, [{', '.join(closed)}] FROM (
         SELECT g.conv_id, g.i, [{', '.join(passed)}] AS w FROM s JOIN g ON g.conv_id IS NOT DISTINCT FROM s.conv_id AND g.i = s.i - 1)),
 a AS (SELECT conv_id, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
              count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
 t AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps FROM d GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(t.gaps, 0) AS BIGINT) AS gaps, coalesce(a.blank, 0) AS blank, coalesce(a.duplicate, 0) AS duplicate, coalesce(a.truncated, 0) AS truncated,
       coalesce(a.illegal, 0) AS illegal, CAST(coalesce(s.v[1].c, 0) AS BIGINT) AS cost, coalesce(s.v[1].a, '') AS audit, sha256(coalesce(substr(s.v[1].t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
     LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.i = 1"""


NEGATIVES_SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
          list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score
       FROM e AS a, e WHERE a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
       QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5"""


ORACLES: dict[str, str] = {"op2_quality_rules": quality_sql(), "op5_sharding": SHARD_SQL, "op6_mixing_sources": MIX_SQL, "op7_pii": pii_sql(), "op11_conversation_repair": repair_sql(), "op12_hard_negatives": NEGATIVES_SQL}
