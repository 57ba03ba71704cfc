"""DuckDB SQL for the queries of the text operators that SQL can express."""

from __future__ import annotations

from . import line_dedup, quality_rules, substring_dedup

_BLANK = r"[\x20\x09-\x0D]"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _count(text: str, parts) -> str:
    """How often these characters stand in a text."""
    return " + ".join(f"(length({text}) - length(replace({text}, {_quoted(p)}, '')))" for p in parts)


def _line_fails(line: str, words: str) -> str:
    bare = f"regexp_replace(regexp_replace({line}, '^{_BLANK}+', ''), '{_BLANK}+$', '')"
    ended = "(" + " OR ".join(f"ends_with({bare}, {_quoted(t)})" for t in quality_rules.TERMINAL) + ")"
    low = f"lower(array_to_string({words}, ' '))"
    symbols = f"10 * ({_count(line, quality_rules.SYMBOLS)}) > length(array_to_string({words}, ''))"
    navigation = "[" + ", ".join(map(_quoted, quality_rules.NAVIGATION)) + "]"
    phrases = " OR ".join(f"contains({low}, {_quoted(p)})" for p in quality_rules.BOILERPLATE)
    return f"({symbols} OR (len({words}) < {quality_rules.SHORT_LINE} AND NOT {ended}) OR (({_count(line, quality_rules.SEPARATORS)}) >= 2 AND NOT {ended}) OR list_has_all({navigation}, string_split({low}, ' ')) OR {phrases})"


OP5 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
lines AS (SELECT doc_id, x.line AS line, x.i AS i, {_WORDS.format("x.line")} AS lw FROM (SELECT doc_id, unnest(list_transform(string_split(t, chr(10)), lambda l, k: {{'line': l, 'i': k}})) AS x FROM d)),
judged AS (SELECT *, {_line_fails("line", "lw")} AS fails, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth FROM lines WHERE len(lw) > 0),
by_line AS (SELECT doc_id, count(*) FILTER (WHERE nth > 1) AS n_dup_lines, coalesce(sum(length(array_to_string(lw, ''))) FILTER (WHERE fails), 0) AS lost FROM judged GROUP BY doc_id),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM d WHERE len(w) >= 3),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM again) GROUP BY doc_id),
base AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {_count("t", quality_rules.SYMBOLS)} AS n_symbols,
coalesce(b.n_dup_lines, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(b.lost, 0) AS lost FROM d LEFT JOIN by_line b USING (doc_id) LEFT JOIN repeats r USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
NOT (n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND lost <= {quality_rules.MAX_LOST} * word_chars AS kept, CAST(lost AS BIGINT) AS lost_chars FROM base"""

_KEY = f"regexp_replace(regexp_replace(l, '^{_BLANK}+', ''), '{_BLANK}+$', '')"

OP9 = f"""WITH d AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls, coalesce(text, '') AS t FROM documents),
sites AS (SELECT source, count(*) AS n FROM d GROUP BY source),
ks AS (SELECT source, unnest(list_distinct(list_filter(list_transform(ls, lambda l: {_KEY}), lambda l: l <> ''))) AS k FROM d),
bad AS (SELECT source, list(k) AS bad FROM (SELECT source, k, count(*) AS c FROM ks GROUP BY source, k) JOIN sites USING (source) WHERE c >= {line_dedup.MIN_DOCS} AND c > {line_dedup.MAX_RATIO} * n GROUP BY source),
cleaned AS (SELECT doc_id, t, ls, list_filter(ls, lambda l: NOT coalesce(list_contains(bad, {_KEY}), FALSE)) AS stay FROM d LEFT JOIN bad USING (source))
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(stay) AS BIGINT) AS n_dropped, sha256(CASE WHEN len(stay) = len(ls) THEN t ELSE array_to_string(stay, chr(10)) END) AS text_sha256 FROM cleaned"""

_N = substring_dedup.WINDOW

OP10 = f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - {_N} + 2)) AS p, w FROM d WHERE len(w) >= {_N}),
windows AS (SELECT doc_id, p, md5(array_to_string(w[p : p + {_N - 1}], ' ')) AS h FROM starts),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
covered AS (SELECT DISTINCT doc_id, unnest(range(p, p + {_N})) AS q FROM windows JOIN firsts USING (h) WHERE doc_id > first),
gone AS (SELECT doc_id, list(q) AS qs FROM covered GROUP BY doc_id),
kept AS (SELECT doc_id, w, coalesce(len(qs), 0) AS n, CASE WHEN qs IS NULL THEN w ELSE list_transform(list_filter(list_transform(w, lambda x, i: {{'x': x, 'i': i}}), lambda s: NOT list_contains(qs, s.i)), lambda s: s.x) END AS stay FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_removed, sha256(array_to_string(stay, ' ')) AS kept_sha256 FROM kept"""

ORACLE_SQL = {"op5_quality_rules": OP5, "op9_line_dedup": OP9, "op10_substring_dedup": OP10}
