"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from . import mixing
from .quality import RULES, STOP_WORDS


def _rules() -> str:
    lines = []
    for r in RULES:
        sides = [f"{r.metric} {op} {x}" for op, x in ((">=", r.low), ("<=", r.high)) if x is not None]
        lines.append(f"(({' AND '.join(sides)}) OR n_words < {r.min_words})")
    return " AND ".join(lines)


def _polynomial() -> str:
    value = str(mixing.COEFFICIENTS[0])
    for c in mixing.COEFFICIENTS[1:]:
        value = f"(({value}::BIGINT * (a % {mixing.FIELD}) + {c}) % {mixing.FIELD})"
    return value


OP1 = rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS b FROM documents
), parts AS (
  SELECT rid, doc_id, b, regexp_extract_all(b, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(b, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM base
), windows AS (
  SELECT rid, unnest(range(0, len(ws) - 4)) AS i, ws FROM parts WHERE len(ws) > 4
), keyed AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i+1], ws[i+2], ws[i+3], ws[i+4], ws[i+5]) AS n FROM windows
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT rid, i, unnest(range(0, 5)) AS k FROM keyed WHERE n > 1) GROUP BY rid
), counts AS (
  SELECT rid, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    len(regexp_extract_all(b, '[#*$%&|<>]')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
    len(regexp_extract_all(b, '[!?~^=_+@{{}}\[\]\\]')) AS n_marks,
    len(list_filter(ws, lambda w: lower(w) IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}))) AS n_stop,
    len(list_filter(ls, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) AS n_ell
  FROM parts
), metrics AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbol_ratio,
    n_marks / greatest(n_words, 1) AS mark_ratio, n_stop / greatest(n_words, 1) AS stop_ratio,
    n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_ell / greatest(n_lines, 1) AS ellipsis_line_ratio
  FROM counts LEFT JOIN covered USING (rid)
), judged AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM metrics
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  (NOT base_failed AND {_rules()}) AS kept
FROM judged
"""

OP10 = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS b, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, [{", ".join(map(str, mixing.WEIGHTS))}][1 + (place % {len(mixing.WEIGHTS)})::INT] AS weight FROM sources
), rated AS (
  SELECT *, {mixing.MOST} * source_size / weight AS ratio FROM weighed
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum({mixing.MOST} * source_size) OVER below, 0))::BIGINT
    / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0))::BIGINT AS level
  FROM rated WINDOW below AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), free AS (
  SELECT ratio AS free_ratio, place AS free_place, level AS free_level FROM levels WHERE level <= ratio
  ORDER BY ratio, place LIMIT 1
), aimed AS (
  SELECT source, place, source_size,
    CASE WHEN free_ratio IS NULL OR ratio < free_ratio OR (ratio = free_ratio AND place < free_place)
      THEN ({mixing.MOST} * source_size)::DOUBLE ELSE free_level * weight END AS target
  FROM levels LEFT JOIN free ON true
), blocked AS (
  SELECT *, ceil(source_size / {mixing.BLOCK})::BIGINT AS n_blocks FROM aimed
), plan AS (
  SELECT *, CASE WHEN source_size > 0
    THEN least(floor(target * n_blocks / source_size + 0.5)::BIGINT, {mixing.MOST} * n_blocks) ELSE 0 END AS n_slots
  FROM blocked
), line AS (
  SELECT place, n_blocks, n_slots, (sum(n_slots) OVER (ORDER BY place))::BIGINT - n_slots AS start_at,
    greatest(1, round_even((sum(n_slots) OVER ())::BIGINT / {mixing.SHARD}, 0))::BIGINT AS shards
  FROM plan WHERE n_slots > 0
), slots AS (
  SELECT place, n_blocks, shards, start_at + unnest(range(0, n_slots)) AS a FROM line
), cubed AS (
  SELECT *, {_polynomial()} AS h FROM slots
), counts AS (
  SELECT place, n_blocks, floor(((h + a // {mixing.FIELD} * 7919) % {mixing.FIELD}) * shards / {mixing.FIELD})::BIGINT AS shard, count(*) AS n
  FROM cubed GROUP BY ALL
), ranks AS (
  SELECT place, n_blocks, shard, before + unnest(range(0, n)) AS r
  FROM (SELECT *, (sum(n) OVER (PARTITION BY place ORDER BY shard))::BIGINT - n AS before FROM counts)
), keyed AS (
  SELECT *, r // n_blocks AS turn, [{", ".join(map(str, mixing.PRIMES))}][1 + ((place * 3 + r // n_blocks) % {len(mixing.PRIMES)})::INT] AS prime
  FROM ranks
), used AS (
  SELECT shard, place, ((prime % n_blocks) * (r % n_blocks) + (place * 7919 + turn * 104729) % n_blocks) % n_blocks AS block
  FROM keyed
), hashed AS (
  SELECT s.doc_id, s.size, p.place, p.source_size, p.target,
    CASE WHEN s.doc_id IS NULL THEN ('0x' || substr(md5(s.b), 1, 7))::BIGINT
      ELSE (floor((s.doc_id % {mixing.FIELD}) * 1597334677 / 65536)::BIGINT % 1073741824 + 1073741824) % 1073741824 END AS h
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
), placed AS (
  SELECT *, (sum(size) OVER (PARTITION BY place ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS start,
    row_number() OVER () AS rid
  FROM hashed
), parts AS (
  SELECT rid, place, start, size, unnest(range(start // {mixing.BLOCK}, (start + size - 1) // {mixing.BLOCK} + 1)) AS block
  FROM placed WHERE size > 0
), taken AS (
  SELECT rid, sum(least(start + size, (block + 1) * {mixing.BLOCK}) - greatest(start, block * {mixing.BLOCK}))::BIGINT AS taken
  FROM parts JOIN used USING (place, block) GROUP BY rid
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM placed LEFT JOIN taken USING (rid)
"""

ORACLES = {
    "op1_quality_rules": OP1,
    "op10_mixing": OP10,
}
