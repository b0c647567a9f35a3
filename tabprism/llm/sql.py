"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from tabprism.llm import multiset_hash as m
from tabprism.llm.common import ASCII_LOWER, ASCII_UPPER
from tabprism.llm.url_rules import compile_pattern


def _lower(x: str) -> str:
    return f"translate({x}, '{ASCII_UPPER}', '{ASCII_LOWER}')"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[ \\t-\\r]+'), lambda s: s <> '')"


def op1(max_docs_per_host: int, min_kept_share: float) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, {_words('t')} AS ws FROM d),
grams AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g AS (SELECT rid, i, list_slice(ws, i, i + 2) AS win FROM grams),
rep AS (SELECT rid, unnest([i, i + 1, i + 2]) AS pos FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM g) WHERE c > 1),
repw AS (SELECT rid, count(DISTINCT pos) AS n FROM rep GROUP BY rid),
lines AS (SELECT rid, source, t, unnest(string_split(t, chr(10))) AS line FROM w),
l AS (SELECT rid, source, t, line, {_words('line')} AS lw FROM lines),
ll AS (SELECT rid, source, t, line, {_lower("array_to_string(lw, ' ')")} AS norm, len(lw) AS n FROM l WHERE len(lw) > 0),
dup AS (SELECT rid, sum(c - 1) AS n FROM (SELECT rid, line, count(*) AS c FROM ll GROUP BY rid, line) GROUP BY rid),
freq AS (SELECT coalesce('=' || source, '-') AS h, norm FROM ll GROUP BY 1, 2 HAVING count(DISTINCT t) > {max_docs_per_host}),
gone AS (SELECT rid, sum(n) AS n FROM ll JOIN freq ON coalesce('=' || ll.source, '-') = freq.h AND ll.norm = freq.norm GROUP BY rid),
j AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
  (length(t) - length(regexp_replace(t, '[^ \\t-\\r]', '', 'g')))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(repw.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN dup USING (rid) LEFT JOIN repw USING (rid) LEFT JOIN gone USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
  AND n_words - removed_words >= {min_kept_share}::DOUBLE * n_words AS kept
FROM j
"""


def op5(min_revisit_bytes: int = 1000) -> str:
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
q AS (SELECT page_id, strlen(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest, max(page_id) OVER (PARTITION BY b) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {min_revisit_bytes} AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {min_revisit_bytes} AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM q
"""


def op8() -> str:
    def prints(source: str, text: str) -> str:
        units = (f"list_filter(list_transform(string_split(regexp_replace({text}, '([.!?])[ \\t\\r\\f\\x0b]+', '\\1' || chr(10), 'g'), chr(10)), "
                 "lambda s: trim(s, ' ' || chr(9) || chr(13) || chr(12) || chr(11))), lambda s: s <> '')")
        words = ", ".join(
            f"list_transform(a{k // 4}, lambda h: ('0x' || substr(h, {1 + 15 * (k % 4)}, 15))::BIGINT) AS w{k}" for k in range(m.WORDS))
        hashes = ", ".join(f"list_transform(u, lambda s: sha256('{salt}' || s)) AS a{k}" for k, salt in enumerate(m.SALTS))
        level = (f"(SELECT *, {words} FROM (SELECT *, len(u)::BIGINT % {m.COUNT_MOD} AS n, "
                 f"{hashes} FROM (SELECT *, {units} AS u FROM {source})))")
        names = [f"c{k}" for k in range(m.PER_LEVEL)]
        level = f"(SELECT *, {', '.join(f'w{k // 2} AS c{k}' for k in range(m.PER_LEVEL))} FROM {level})"
        for j in range(m.LEVELS):
            sums = ", ".join(f"coalesce(list_sum(list_transform({c}, lambda x: ((x >> {2 * m.LEVELS}) & {(1 << m.VALUE_BITS) - 1})::BIGINT)), 0)::BIGINT "
                             f"% {m.LANE_MOD}" for c in names)
            left = ", ".join(f"list_filter({c}, lambda x: x & {1 << m.place(k, j)} = 0) AS {c}" for k, c in enumerate(names))
            level = f"(SELECT * REPLACE ({left}), [{sums}] AS l{j} FROM {level})"
        own = [f"list_transform(list_zip(l{j}, l{j + 1}), lambda z: (z[1] - z[2] + {m.LANE_MOD}) % {m.LANE_MOD})" for j in range(m.LEVELS - 1)]
        return f"SELECT *, [n] || {' || '.join([*own, f'l{m.LEVELS - 1}'])} AS fp FROM {level}"

    def shown(fp: str) -> str:
        return f"printf('%08x', {fp}[1]) || array_to_string(list_transform({fp}[2:], lambda v: printf('%04x', v)), '')"

    def near(a: str, b: str) -> str:
        table = "[" + ", ".join(f"{d!r}::DOUBLE" for d in m.difference_table()) + "]"
        equal = f"len(list_filter(list_zip({a}[2:], {b}[2:]), lambda z: z[1] = z[2]))"
        d = f"greatest({table}[{equal} + 1], abs({a}[1] - {b}[1])::DOUBLE)"
        return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - {d} / greatest({a}[1] + {b}[1], 1)::DOUBLE) END"

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id, t), first_value(t) OVER (ORDER BY doc_id, t)) AS nt FROM d),
e AS (SELECT doc_id, length(t)::BIGINT AS n_chars, t, nt, left(t, length(t) - length(t) // 2) || left(nt, length(t) // 2) AS ed FROM o),
x AS (SELECT doc_id, n_chars, t, nt, ed, fp AS own FROM ({prints('e', 't')})),
y AS (SELECT doc_id, n_chars, nt, ed, own, fp AS edited FROM ({prints('x', 'ed')})),
z AS (SELECT doc_id, n_chars, ed, own, edited, fp AS following FROM ({prints('y', 'nt')}))
SELECT doc_id, n_chars, sha256(ed) AS edited_sha256, {shown('own')} AS fingerprint, {shown('edited')} AS edited_fingerprint,
  {near('own', 'edited')} AS near_edited, {near('own', 'following')} AS near_next
FROM z
"""


def op10(host_rules: list[tuple[str, str, str]], patterns: list[str]) -> str:
    rules = sorted(host_rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1], r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in rules]
    compiled = [compile_pattern(p) for p in patterns]

    def any_of(exception: bool) -> str:
        tests = [f"coalesce(regexp_matches({_lower('url')}, '{rx}'), false)" for rx, _, ex in compiled if ex == exception]
        return "(" + " OR ".join(tests or ["false"]) + ")"

    return f"""
WITH r AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, url, coalesce({_lower("regexp_extract(rest, '^[^/?#]*', 0)")}, '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r)
SELECT page_id, host, path, CASE {' '.join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits)} END AS rule,
  CASE {' '.join(f"WHEN {c} THEN '{v}'" for c, _, v in fits)}
  WHEN {any_of(True)} THEN 'allow' WHEN {any_of(False)} THEN 'block' ELSE 'allow' END AS verdict
FROM h
"""


def op13() -> str:
    return """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
