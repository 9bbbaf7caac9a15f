"""DuckDB SQL for the operators here that SQL can express."""

from __future__ import annotations

from fragweave.llm import divergence as d


def op1() -> str:
    """The base counts by unnested windows, the distances by unnested histogram bins."""
    values = lambda rows: ", ".join(f"({', '.join(map(str, r))})" for r in rows)
    text = lambda s: "'" + s.replace("'", "''") + "'"
    lists = values((text(lang), text(w)) for lang, ws in d.COMMON.items() for w in ws)
    mark = text(d.CLASSES["mark"].replace("[", "[^", 1))
    return f"""
WITH common(lang, word) AS (VALUES {lists}),
vocab AS (SELECT DISTINCT word FROM common),
t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM t),
pos AS (SELECT doc_id, ws, unnest(range(len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5),
win AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 5], ' ') AS g FROM pos),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
odd AS (SELECT *, regexp_replace(text, '[\\p{{L}}\\x20\\x09-\\x0D]+', '', 'g') AS rest, len(array_to_string(ws, '')) AS wc FROM w),
cls AS (
  SELECT doc_id, lang, len(ws) AS n_words, wc AS word_chars, len(text) AS n_chars,
    len(regexp_replace(rest, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(regexp_replace(text, '\\P{{Lu}}+', '', 'g')) AS up, len(rest) AS n_odd,
    len(regexp_replace(rest, '\\P{{Nd}}+', '', 'g')) AS digits, len(regexp_replace(rest, {mark} || '+', '', 'g')) AS marks
  FROM odd),
bins AS (SELECT doc_id, lang, n_chars, unnest([up, word_chars - n_odd - up, n_chars - word_chars, n_symbols, digits, marks, n_odd - n_symbols - digits - marks]) AS c, unnest(range(7)) AS b FROM cls),
uses AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, lower(unnest(ws)) AS word FROM w) JOIN vocab USING (word) GROUP BY ALL),
ref AS (SELECT lang, sum(n_words) AS n FROM cls WHERE lang IS NOT NULL GROUP BY lang HAVING sum(n_words) >= {d.MIN_REFERENCE}),
ref_c AS (SELECT lang, b, sum(c) / sum(sum(c)) OVER (PARTITION BY lang) AS q FROM bins JOIN ref USING (lang) GROUP BY lang, b),
own AS (SELECT ref.lang, ref.n, vocab.word FROM ref, vocab WHERE ref.lang NOT IN (SELECT lang FROM common) OR EXISTS (SELECT 1 FROM common c WHERE c.lang = ref.lang AND c.word = vocab.word)),
sums AS (SELECT c.lang, u.word, sum(u.n) AS s FROM uses u JOIN cls c USING (doc_id) WHERE c.lang IS NOT NULL GROUP BY ALL),
ref_w AS (SELECT own.lang, own.word, least(1.0, coalesce(s, 0) / own.n) AS q FROM own LEFT JOIN sums ON sums.lang = own.lang AND sums.word = own.word),
ref_o AS (SELECT lang, greatest(0.0, 1 - sum(q)) AS q FROM ref_w GROUP BY lang),
pq AS (
  SELECT doc_id, r.lang, 'c' AS kind, c / greatest(n_chars, 1) AS p, q FROM bins JOIN ref_c r USING (b)
  UNION ALL
  SELECT cls.doc_id, r.lang, 'w', coalesce(u.n, 0) / greatest(n_words, 1), r.q
    FROM cls CROSS JOIN ref_w r LEFT JOIN uses u ON u.doc_id = cls.doc_id AND u.word = r.word
  UNION ALL
  SELECT cls.doc_id, o.lang, 'w', greatest(0.0, 1 - coalesce(x.n, 0) / greatest(n_words, 1)), o.q
    FROM cls CROSS JOIN ref_o o LEFT JOIN (
      SELECT u.doc_id, r.lang, sum(u.n) AS n FROM uses u JOIN ref_w r USING (word) GROUP BY ALL) x ON x.doc_id = cls.doc_id AND x.lang = o.lang),
js AS (
  SELECT doc_id, lang, kind, sqrt(greatest(0.0, sum(
    CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS d
  FROM pq GROUP BY ALL),
near AS (SELECT doc_id, min(d) FILTER (kind = 'c') AS dc, min(d) FILTER (kind = 'w') AS dw FROM js GROUP BY doc_id),
base AS (
  SELECT cls.*, coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, dc, dw
  FROM cls LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN near USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND NOT (n_words >= {d.MIN_WORDS} AND (coalesce(dc > {d.CHARS_LIMIT[0]} + {d.CHARS_LIMIT[1]} / sqrt(greatest(n_words, 1)), false)
      OR coalesce(dw > {d.WORDS_LIMIT[0]} + {d.WORDS_LIMIT[1]} / sqrt(greatest(n_words, 1)), false))) AS kept
FROM base"""


def op6() -> str:
    """Messages only: the tables hold no tool markup, so every turn is one."""
    return """
SELECT conv_id, turn, 0::INTEGER AS idx, 'message' AS kind, '' AS call_id, -2::INTEGER AS level, 'message' AS status,
  0::BIGINT AS n_calls, 0::BIGINT AS n_results, true AS valid, '' AS errors,
  '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' AS json
FROM conversations"""
