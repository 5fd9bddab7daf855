"""Garbled documents by plain SQL: an independent statement for problem 9.

It goes the other way round than the operator: what stands in a text is read back
through the character sets, where the operator makes garbled forms of clean words.
"""

from __future__ import annotations

from plexora.llm.encoding import CROSS, SINGLE

_REFERENCE = r"&#(?:[0-9]{2,7}|[xX][0-9A-Fa-f]{2,6});"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _upper_half(name: str) -> str:
    """The characters of the bytes from 128 on; undefined ones as control characters."""
    return "".join([bytes([b]).decode(name, "ignore") or chr(b) for b in range(128, 256)])


_SETS = ", ".join(f"({_quoted(n)}, {_quoted(_upper_half(n))}, {str(n in CROSS).upper()})" for n in SINGLE)


def _level(src: str, n: str) -> str:
    """Runs of ``src`` of which all characters are bytes of a set and these bytes
    are UTF-8, with the characters that they stand for."""
    return f"""rv{n} AS MATERIALIZED (SELECT r, name, string_agg(h, '' ORDER BY i) AS h FROM (SELECT DISTINCT r FROM {src} WHERE length(r) BETWEEN 2 AND 200) x, range(1, 201) g(i) JOIN bt ON c = r[i] WHERE i <= length(r) GROUP BY r, name HAVING count(*) = length(r)),
ok{n} AS MATERIALIZED (SELECT *, regexp_extract_all(h, '[CDEF][0-9A-F] (?:[89AB][0-9A-F] )+') AS u FROM rv{n} WHERE regexp_full_match(h, '(?:(?:C[2-9A-F]|D[0-9A-F]) [89AB][0-9A-F] |E[0-9A-F] [89AB][0-9A-F] [89AB][0-9A-F] |F[0-4] [89AB][0-9A-F] [89AB][0-9A-F] [89AB][0-9A-F] )+')),
un{n} AS MATERIALIZED (SELECT r, name, list_transform(u, lambda x: CASE length(x) WHEN 6 THEN chr(((CAST('0x' || x[1:2] AS INTEGER) & 31) << 6) | (CAST('0x' || x[4:5] AS INTEGER) & 63))
  WHEN 9 THEN chr(((CAST('0x' || x[1:2] AS INTEGER) & 15) << 12) | ((CAST('0x' || x[4:5] AS INTEGER) & 63) << 6) | (CAST('0x' || x[7:8] AS INTEGER) & 63)) ELSE '?' END) AS cl FROM ok{n}),
"""


FOUND = f"""
WITH cs(name, chars, wide) AS (VALUES {_SETS}),
bt AS MATERIALIZED (SELECT name, chars[b + 1] AS c, printf('%02X ', 128 + b) AS h FROM cs, range(128) t(b)),
parts AS MATERIALIZED (SELECT doc_id, regexp_extract_all(text, '{_REFERENCE}|[^&]+|&') AS p FROM documents WHERE text IS NOT NULL),
d AS MATERIALIZED (SELECT doc_id, array_to_string(list_transform(p, lambda x: CASE WHEN regexp_full_match(x, '&#[0-9]{{2,7}};') THEN chr(CAST(x[3:-2] AS INTEGER)) WHEN regexp_full_match(x, '&#[xX][0-9A-Fa-f]{{2,6}};') THEN chr(CAST('0x' || x[4:-2] AS INTEGER)) ELSE x END), '') AS t FROM parts),
-- a character that no text is written with
odd AS MATERIALIZED (SELECT doc_id FROM d WHERE regexp_matches(t, '[\\x{{80}}-\\x{{84}}\\x{{86}}-\\x{{9F}}\\x{{FFFD}}]')),
-- runs of non-ASCII characters whose bytes in some set are UTF-8
rn AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(regexp_extract_all(t, '[^\\x00-\\x7F]+')) AS r FROM d),
{_level('rn', '')}-- what was decoded wrongly twice
rz AS MATERIALIZED (SELECT r AS r0, array_to_string(cl, '') AS r FROM un),
{_level('rz', '2')}-- characters that single runs of several texts consist of
ch AS MATERIALIZED (SELECT unnest(list_distinct(string_split(r, ''))) AS c, doc_id FROM rn WHERE NOT EXISTS (SELECT 1 FROM un WHERE un.r = rn.r)),
kn AS MATERIALIZED (SELECT c FROM ch GROUP BY c HAVING count(DISTINCT doc_id) >= 3),
u8 AS MATERIALIZED (SELECT DISTINCT r FROM (SELECT r, name, unnest(cl) AS c FROM un UNION ALL SELECT r0, un2.name || r, unnest(cl) FROM un2 JOIN rz USING (r)) LEFT JOIN kn USING (c) GROUP BY r, name HAVING count(*) = count(kn.c)),
-- words that are another word of more texts, read in another single-byte set
wo AS MATERIALIZED (SELECT DISTINCT doc_id, hash(t) AS th, unnest(regexp_extract_all(t, '[A-Za-z]*[^\\x00-\\x7F](?:[A-Za-z]|[^\\x00-\\x7F])*')) AS w FROM d),
vo AS MATERIALIZED (SELECT w, count(DISTINCT th) AS n FROM wo GROUP BY w),
tr AS MATERIALIZED (SELECT f.w, f.n, a.name AS a, b.name AS b, translate(f.w, b.chars, a.chars) AS o FROM vo f, cs a, cs b WHERE a.name <> b.name AND a.wide AND b.wide AND length(f.w) > 1),
cv AS MATERIALIZED (SELECT tr.w, a, b, tr.n FROM tr JOIN vo ON vo.w = o WHERE o <> tr.w AND vo.n >= 2 * tr.n),
sb AS MATERIALIZED (SELECT doc_id FROM wo JOIN cv USING (w) GROUP BY doc_id, a, b HAVING count(DISTINCT w) >= 2),
sl AS MATERIALIZED (SELECT doc_id FROM wo JOIN cv USING (w) WHERE length(regexp_replace(w, '[\\x00-\\x7F]', '', 'g')) >= 3),
-- kana as pairs of Latin letters and signs
ja AS MATERIALIZED (SELECT doc_id FROM d WHERE regexp_matches(t, '(?:[¤¥][¡-ö]){{3}}'))
SELECT doc_id FROM odd UNION SELECT doc_id FROM rn JOIN u8 USING (r) UNION SELECT doc_id FROM sb UNION SELECT doc_id FROM sl UNION SELECT doc_id FROM ja
"""
