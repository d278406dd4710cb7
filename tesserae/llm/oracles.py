"""DuckDB SQL for the queries whose rows SQL can tell."""

from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"

#: Brute force but for the prefix filter, which is exact in any order of words; here by their numbers of lines.
LINE_DEDUP = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS p FROM documents),
t AS (SELECT doc_id, p, doc_id * 1000000 + p AS spot, list_sort(list_distinct(regexp_extract_all(line, {WORDS}))) AS s FROM l),
k AS (SELECT * FROM t WHERE len(s) >= 1),
c AS MATERIALIZED (SELECT s, min(spot) AS o FROM k GROUP BY s),
tok AS (SELECT o, len(s) AS n, unnest(s) AS w FROM c),
df AS (SELECT w, count(*) AS d FROM tok GROUP BY w),
r AS (SELECT o, n, w, row_number() OVER (PARTITION BY o ORDER BY d, w) AS k FROM tok JOIN df USING (w)),
pre AS MATERIALIZED (SELECT o, n, w FROM r WHERE k <= n - ceil(0.8 * n - 1e-9) + 1),
cand AS (SELECT DISTINCT a.o AS x, b.o AS y FROM pre a JOIN pre b USING (w) WHERE b.o < a.o AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
m AS (SELECT DISTINCT x FROM cand JOIN c cx ON cx.o = x JOIN c cy ON cy.o = y
  WHERE 9 * len(list_intersect(cx.s, cy.s)) >= 4 * (len(cx.s) + len(cy.s))),
gone AS (SELECT doc_id, p FROM k JOIN c USING (s) WHERE spot > o OR o IN (SELECT x FROM m)),
per AS (SELECT doc_id, count(*) AS n, string_agg(p::varchar, ',' ORDER BY p) AS said FROM gone GROUP BY doc_id)
SELECT doc_id, len(string_split(coalesce(text, ''), chr(10)))::bigint AS n_lines, coalesce(n, 0)::bigint AS n_removed, coalesce(said, '') AS removed_lines
FROM documents LEFT JOIN per USING (doc_id)
"""

#: All pairs of documents that share a shingle; classes by walking the links.
NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
near AS MATERIALIZED (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 9 * c >= 4 * (nx.n + ny.n)
  UNION ALL SELECT a.doc_id, b.doc_id FROM w a JOIN w b ON a.doc_id < b.doc_id AND len(a.w) = 0 AND len(b.w) = 0),
links AS MATERIALIZED (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
walk AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT walk.doc_id, links.y FROM walk JOIN links ON links.x = walk.seen),
classes AS (SELECT doc_id, min(seen) AS class_id FROM walk GROUP BY doc_id),
counts AS (SELECT x AS doc_id, count(*) AS n FROM links GROUP BY x)
SELECT doc_id, class_id, coalesce(n, 0)::bigint AS n_links FROM classes LEFT JOIN counts USING (doc_id)
"""

_PARAGRAPHS = "list_transform(string_split({t}, chr(10)), lambda x, i: CASE WHEN i < len(string_split({t}, chr(10))) THEN x || chr(10) ELSE x END)"
_SENTENCES = "string_split(regexp_replace({x}, '([.!?;:] )', '\\1' || chr(1), 'g'), chr(1))"
#: Pieces of a long sentence: after units (words with their space, or characters) whose MD5 starts with 0, and each 256th.
_UNITS = "CASE WHEN contains(rtrim({s}, ' ' || chr(10)), ' ') THEN string_split(regexp_replace({s}, ' ', ' ' || chr(1), 'g'), chr(1)) ELSE string_split({s}, '') END"
_PIECES = "string_split(array_to_string(list_transform({u}, lambda y, i: CASE WHEN md5(y)[1] = '0' OR i % 256 = 0 THEN y || chr(10) ELSE y END), ''), chr(10))"
_TREE = "list_transform({p}, lambda x: flatten(list_transform(" + _SENTENCES.format(x="x") + ", lambda s: CASE WHEN length(s) > 256 THEN " + _PIECES.format(u="(" + _UNITS.format(s="s") + ")") + " ELSE [s] END).list_transform(lambda z: list_transform(z, lambda q: sha256(q)))))"


def _steps(name: str, source: str, text: str) -> str:
    """Relations that end in ``name``: doc_id and ``mark``, root, sections and leaves of a text."""
    return f"""
{name}_p AS (SELECT doc_id, {_PARAGRAPHS.format(t=text)} AS p FROM {source}),
{name}_t AS (SELECT doc_id, {_TREE.format(p='p')} AS t FROM {name}_p),
{name}_n AS (SELECT doc_id, t, list_transform(t, lambda x: sha256(array_to_string(x, ','))) AS n FROM {name}_t),
{name}_s AS (SELECT doc_id, t, list_transform(range(0, ceil(len(n) / 16)::bigint), lambda i: sha256(array_to_string(n[i * 16 + 1:i * 16 + 16], ','))) AS s FROM {name}_n),
{name} AS MATERIALIZED (SELECT doc_id, sha256(array_to_string(s, ',')) AS root, list_transform(s, lambda x: x[1:12]) AS secs, list_transform(flatten(t), lambda x: x[1:12]) AS leaves FROM {name}_s)"""


_MARK = "{m}.root || ':' || array_to_string({m}.secs, '.') || ':' || array_to_string({m}.leaves, '.')"
_LIKE = "CASE WHEN {a}.root = {b}.root THEN 1.0::double ELSE 2.0::double * len(list_intersect(list_distinct({a}.leaves), list_distinct({b}.leaves))) / (len(list_distinct({a}.leaves)) + len(list_distinct({b}.leaves))) END"

FINGERPRINTS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
nx AS (SELECT *, coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), first_value(doc_id) OVER (ORDER BY doc_id DESC)) AS next_id FROM d),
e AS MATERIALIZED (SELECT a.doc_id, a.n, a.next_id, substr(a.t, 1, a.n - a.n // 3) || substr(b.t, 1, a.n // 3) AS e FROM nx a JOIN d b ON b.doc_id = a.next_id),
{_steps('own', 'd', 't').strip()},
{_steps('edit', 'e', 'e').strip()}
SELECT e.doc_id, e.n::bigint AS n_chars, sha256(e.e) AS edited_sha256, {_MARK.format(m='own')} AS fingerprint, {_MARK.format(m='edit')} AS edited_fingerprint,
{_LIKE.format(a='own', b='edit')} AS near_edited, {_LIKE.format(a='own', b='other')} AS near_next,
array_to_string(list_filter(list_transform(own.secs, lambda h, i: CASE WHEN coalesce(edit.secs[i] <> h, true) THEN i - 1 END), lambda i: i IS NOT NULL), ',') AS edited_sections
FROM e JOIN own ON own.doc_id = e.doc_id JOIN edit ON edit.doc_id = e.doc_id JOIN own other ON other.doc_id = e.next_id
"""

_PART = "(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END)"

QUALITY = f"""
WITH d AS MATERIALIZED (SELECT doc_id, lang AS l, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w,
  list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}]+'), lambda x: x <> '') AS a FROM documents),
tri AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS k, w FROM d WHERE len(w) >= 4),
win AS (SELECT doc_id, k, w[k] || chr(1) || w[k + 1] || chr(1) || w[k + 2] AS x FROM tri),
twice AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS j FROM twice) GROUP BY doc_id),
base AS (SELECT doc_id, l, t, w, a, len(w)::bigint AS n_words, length(array_to_string(w, ''))::bigint AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint AS n_symbols,
  (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {WORDS}))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {WORDS})))))::bigint AS n_dup_lines,
  coalesce(rep.n, 0)::bigint AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
sized AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, length(t) - word_chars AS c1, len(regexp_extract_all(t, '\\p{{Lu}}')) AS c2, length(array_to_string(a, '')) AS letters,
  length(t) - length(translate(t, '0123456789', '')) AS c4, length(t) - length(translate(t, '.,;:''"()-!?', '')) AS c5 FROM base),
cls AS MATERIALIZED (SELECT *, list_transform([c1, c2, letters - c2, c4, c5, word_chars - letters - c4 - c5], lambda x: x::double / greatest(1.0, length(t))) AS c FROM sized),
ref AS MATERIALIZED (SELECT l, [avg(c[1]), avg(c[2]), avg(c[3]), avg(c[4]), avg(c[5]), avg(c[6])] AS r FROM cls WHERE NOT base_failed AND l IS NOT NULL GROUP BY l),
spoken AS (SELECT l, unnest(a) AS w FROM d WHERE l IS NOT NULL),
counted AS (SELECT l, w, count(*) AS n FROM spoken GROUP BY l, w),
best AS (SELECT l, w, n::double / sum(n) OVER (PARTITION BY l) AS q, row_number() OVER (PARTITION BY l ORDER BY n DESC, w) AS k FROM counted),
top AS MATERIALIZED (SELECT l, w, q FROM best WHERE k <= 40),
alls AS (SELECT l, sum(q) AS all_of FROM top GROUP BY l),
known AS MATERIALIZED (SELECT l, r, all_of FROM ref JOIN alls USING (l)),
held AS MATERIALIZED (SELECT doc_id, c, known.* FROM cls JOIN known ON known.l = cls.l OR NOT EXISTS (SELECT 1 FROM known k WHERE k.l = cls.l)),
own AS (SELECT doc_id, w, count(*) / greatest(1.0::double, max(m)) AS p FROM (SELECT doc_id, unnest(a) AS w, len(a) AS m FROM d) GROUP BY doc_id, w),
met AS (SELECT doc_id, l, sum(p) AS said, sum(q) AS there, sum({_PART.format(p='p', q='q')}) AS parts FROM own JOIN held USING (doc_id) JOIN top USING (l, w) GROUP BY doc_id, l),
near AS (SELECT held.doc_id, sqrt(greatest(0, list_sum(list_transform(range(1, 7), lambda k: {_PART.format(p='c[k]', q='r[k]')})) / 2)) AS cd,
  sqrt(greatest(0, (coalesce(parts, 0) + {_PART.format(p='(1 - coalesce(said, 0))', q='(1 - all_of)')} + all_of - coalesce(there, 0)) / 2)) AS wd
  FROM held LEFT JOIN met ON met.doc_id = held.doc_id AND met.l = held.l),
best_of AS (SELECT doc_id, arg_min(cd, cd + wd) AS cd, arg_min(wd, cd + wd) AS wd FROM near GROUP BY doc_id),
dist AS (SELECT cls.*, cd, wd FROM cls LEFT JOIN best_of USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
NOT base_failed AND NOT coalesce(cd > 0.12 + 2.5 / sqrt(greatest(word_chars, 1)) OR wd > 0.25 + 2.0 / sqrt(greatest(n_words, 1)), false) AS kept, round(cd, 6) AS class_distance, round(wd, 6) AS word_distance FROM dist
"""

_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_VALID = {
    "email": "true",
    "ip": "list_max(list_transform(string_split(v, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) > 3 THEN 999 ELSE coalesce(try_cast(x AS int), 0) END)) <= 255",
    "card": f"length({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN CASE WHEN reverse({_DIGITS})[i]::int > 4 THEN 2 * reverse({_DIGITS})[i]::int - 9 ELSE 2 * reverse({_DIGITS})[i]::int END ELSE reverse({_DIGITS})[i]::int END)) % 10 = 0",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}


def _spans(name: str, source: str) -> str:
    """A relation: id, start, rank, stop, kind, v of every match in ``source`` (id, t)."""
    parts = []
    for rank, (kind, pattern) in enumerate(_KINDS.items()):
        runs = f"SELECT id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM {source} WHERE regexp_matches(t, '{pattern}')"
        each = f"SELECT id, unnest(range(1, len(m) + 1)) AS i, m, list_transform(m, lambda x: length(x)) AS lm, list_transform(g, lambda x: length(x)) AS lg FROM ({runs})"
        placed = f"SELECT id, (list_sum(lg[1:i]) + coalesce(list_sum(lm[1:i - 1]), 0))::int AS start, m[i] AS v FROM ({each})"
        parts.append(f"SELECT id, start, {rank} AS rank, (start + length(v))::int AS stop, '{kind}' AS kind, v FROM ({placed}) WHERE {_VALID[kind]}")
    return f"{name} AS MATERIALIZED ({' UNION ALL '.join(parts)})"


_TERMS = "list_filter(list_distinct(string_split_regex(lower({t}), '[^\\p{{L}}]+')), lambda w: w <> '')"
_SAID = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop), '')"

PII = f"""
WITH d AS MATERIALIZED (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents),
{_spans('base', 'd')},
near AS MATERIALIZED (SELECT t AS whole, list_distinct(list(kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN {_DIGITS} ELSE lower(v) END)) AS entities, any_value({_TERMS.format(t=f"regexp_replace(t, '{_KINDS['email']}', ' ', 'g')")}) AS w
  FROM base JOIN d USING (id) GROUP BY t),
pairs AS (SELECT DISTINCT whole, entity, unnest(w) AS term FROM (SELECT whole, w, unnest(entities) AS entity FROM near)),
joint AS (SELECT entity, term, count(*)::double AS n FROM pairs GROUP BY ALL HAVING count(*) >= 3),
own AS (SELECT entity, count(DISTINCT whole)::double AS n FROM (SELECT whole, unnest(entities) AS entity FROM near) GROUP BY entity),
has AS MATERIALIZED (SELECT id, t, term FROM (SELECT id, t, unnest({_TERMS.format(t='t')}) AS term FROM d) WHERE term IN (SELECT term FROM joint)),
freq AS (SELECT term, count(DISTINCT t)::double AS n FROM has GROUP BY term),
size AS (SELECT count(DISTINCT t)::double AS n FROM d),
told AS (SELECT DISTINCT term FROM joint JOIN own USING (entity) JOIN freq USING (term) CROSS JOIN size WHERE own.n < size.n AND log2(joint.n * size.n / (freq.n * own.n)) >= 0.9 * log2(size.n / own.n)),
hit AS (SELECT id, t, list(term) AS terms FROM has WHERE term IN (SELECT term FROM told) GROUP BY id, t),
runs AS (SELECT id, terms, unnest(regexp_extract_all(t, '\\p{{L}}+')) AS v, unnest(string_split_regex(t, '\\p{{L}}+')[1:len(regexp_extract_all(t, '\\p{{L}}+'))]) AS g, generate_subscripts(regexp_extract_all(t, '\\p{{L}}+'), 1) AS i FROM hit),
found AS (SELECT id, terms, v, (sum(length(g) + length(v)) OVER (PARTITION BY id ORDER BY i))::int AS stop FROM runs),
extra AS (SELECT id, stop - length(v) AS start, 4 AS rank, stop, 'term' AS kind, v FROM found WHERE list_contains(terms, lower(v))
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.id = found.id AND b.start < found.stop AND found.stop - length(found.v) < b.stop)),
counts AS (SELECT id, count(*) FILTER (kind = 'email') AS e, count(*) FILTER (kind = 'ip') AS i, count(*) FILTER (kind = 'card') AS c, count(*) FILTER (kind = 'phone') AS p, {_SAID} AS said FROM base GROUP BY id),
whole AS (SELECT id, {_SAID} AS said, count(*) FILTER (kind = 'term') AS n FROM (SELECT id, start, rank, stop, kind FROM base UNION ALL SELECT id, start, rank, stop, kind FROM extra) GROUP BY id)
SELECT d.id AS doc_id, coalesce(e, 0)::bigint AS n_email, coalesce(i, 0)::bigint AS n_ip, coalesce(c, 0)::bigint AS n_card, coalesce(p, 0)::bigint AS n_phone, sha256(coalesce(counts.said, '')) AS base_sha256, coalesce(whole.said, '') AS spans, coalesce(n, 0)::bigint AS n_term
FROM d LEFT JOIN counts USING (id) LEFT JOIN whole USING (id)
"""
