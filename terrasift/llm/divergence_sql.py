"""SQL twin of the divergence rules, for DuckDB."""

from terrasift.llm.divergence import CLASSES, COMMON

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LISTED = ", ".join(f"('{w}', {i})" for i, w in enumerate(COMMON))


def _count(pattern: str) -> str:
    return f"length(regexp_replace(text, '{pattern}', '', 'g'))"


def judge_sql(most: float = 0.39, slack: float = 1.0, least_words: int = 80, least_docs: int = 50) -> str:
    """The rows of ``divergence.judge`` over ``documents``, without the language."""
    other, first = len(COMMON), len(CLASSES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
listed(word, bin) AS (VALUES {_LISTED}),
words AS (
  SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
  FROM (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d)),
windows AS (
  SELECT r, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS win
  FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows WHERE win IS NOT NULL) WHERE n > 1),
repeated AS (
  SELECT r, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) s(k) GROUP BY r),
doubled AS (
  SELECT r, count(*) - count(DISTINCT line) AS n
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
counted AS (
  SELECT r, 0 AS bin, {_count("[^a-z]")} AS n FROM d UNION ALL
  SELECT r, 1, {_count("[^A-Z]")} FROM d UNION ALL
  SELECT r, 2, {_count("[^0-9]")} FROM d UNION ALL
  SELECT r, 3, {_count("[^ \\x09-\\x0D]")} FROM d UNION ALL
  SELECT r, 4, {_count("[^.,;:?!''\"()-]")} FROM d UNION ALL
  SELECT r, 5, {_count("[a-zA-Z0-9 \\x09-\\x0D.,;:?!''\"()-]|[^\\x00-\\x7F]")} FROM d UNION ALL
  SELECT r, 6, {_count("[\\x00-\\x7F]")} FROM d UNION ALL
  SELECT r, {first} + coalesce(bin, {other}), count(*)
  FROM words LEFT JOIN listed
    ON listed.word = regexp_replace(translate(words.word, '{_UPPER}', '{_LOWER}'), '[.,;:!?]+$', '')
  GROUP BY ALL),
base AS (
  SELECT d.r, doc_id, lang, coalesce(n_words, 0)::BIGINT AS n_words,
    {_count("[ \\x09-\\x0D]")} AS word_chars, {_count("[^#*$%&|<>]")} AS n_symbols,
    coalesce(doubled.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN (SELECT r, count(*) AS n_words FROM words GROUP BY r) USING (r)
  LEFT JOIN doubled ON doubled.r = d.r LEFT JOIN repeated ON repeated.r = d.r),
ruled AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
shares AS (
  SELECT r, bin, bin >= {first} AS kind, n, sum(n) OVER (PARTITION BY r, bin >= {first}) AS whole FROM counted),
usable AS (SELECT r, lang FROM ruled WHERE n_words >= {least_words} AND NOT base_failed),
sums AS (
  SELECT lang, bin, kind, sum(1000000 * n // whole) AS total FROM shares JOIN usable USING (r) WHERE whole > 0 GROUP BY ALL),
known AS (SELECT lang FROM usable GROUP BY lang HAVING count(*) >= {least_docs}),
refs AS (SELECT lang, bin, kind, total / sum(total) OVER (PARTITION BY lang, kind) AS q FROM sums JOIN known USING (lang)),
pairs AS (
  SELECT ruled.r, refs.kind, coalesce(s.n / s.whole, 0) AS p, q
  FROM ruled JOIN refs USING (lang) LEFT JOIN shares s ON s.r = ruled.r AND s.bin = refs.bin
  WHERE n_words >= {least_words}
  UNION ALL
  SELECT s.r, s.kind, s.n / s.whole, 0
  FROM shares s JOIN ruled USING (r) JOIN known USING (lang) LEFT JOIN refs ON refs.lang = ruled.lang AND refs.bin = s.bin
  WHERE n_words >= {least_words} AND refs.bin IS NULL AND s.n > 0),
apart AS (
  SELECT r, kind, round(sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
    + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)), 6) AS x
  FROM pairs GROUP BY r, kind),
final AS (
  SELECT ruled.*, c.x AS class_distance, w.x AS word_distance
  FROM ruled LEFT JOIN apart c ON c.r = ruled.r AND NOT c.kind LEFT JOIN apart w ON w.r = ruled.r AND w.kind)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance,
  NOT base_failed AND NOT coalesce(class_distance + word_distance > {most} + {slack} / sqrt(n_words), false) AS kept
FROM final"""
