"""SQL for DuckDB that must give the rows of the core queries."""

from __future__ import annotations

from .functions.kinds import EXTENSIONS, LABELS, VOICE_HINTS, VOICE_ONLY
from .functions.names import COPY_SUFFIX, GENERIC_WORDS, MACHINE_NAMES, SMALL_WORDS, SUFFIX_ROUNDS, VAGUE_WORDS
from .functions.titles import JUNK_LINE, LINES, WORDS
from .functions.topics import HEAD, rules
from .queries import BULLET, CHECK, FIELD, KEYWORD, MISREAD_BULLET, ORDERED, SEARCH


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


FILES = "(SELECT DISTINCT ON (file_id) * FROM file_facts)"
_EXT = "CASE WHEN regexp_matches(rel_path, '\\.[^./]*$') THEN lower(regexp_extract(rel_path, '\\.([^./]*)$', 1)) ELSE '' END"
_PLAIN = "CASE " + " ".join(f"WHEN xt IN {_list(v.split())} THEN {q(k)}" for k, v in EXTENSIONS.items()) + " ELSE 'OTHER' END"
_LABEL = "CASE kind " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in LABELS.items()) + " ELSE 'File' END"
_NORM = "regexp_replace(lower(%s), '[^a-z0-9]', '', 'g')"
_SIZE = (
    "CASE WHEN {n} < 1024 THEN {n}::VARCHAR || ' B' WHEN {n} < 1048576 THEN (({n} + 512) // 1024)::VARCHAR || ' KB' "
    "WHEN {n} < 1073741824 THEN printf('%.1f MB', {n} / 1048576.0) ELSE printf('%.2f GB', {n} / 1073741824.0) END"
)
_S = "[\\s\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+"


def _strip(name: str) -> str:
    base = f"trim({name})"
    for _ in range(SUFFIX_ROUNDS):
        base = f"coalesce(nullif(trim(regexp_replace({base}, {q(COPY_SUFFIX)}, '')), ''), {base})"
    return base


_WORDS = "list_filter(string_split_regex(regexp_replace(base, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[^\\p{L}\\p{N}'']+'), lambda w: trim(w) <> '')"
_REAL = (
    f"list_filter({_WORDS}, lambda w: length(w) >= 3 AND regexp_matches(w, '\\p{{L}}') AND lower(w) NOT IN {_list(GENERIC_WORDS)} AND "
    "(regexp_matches(regexp_replace(lower(w), '[^\\p{L}]', '', 'g'), '[^\\x{00}-\\x{24f}]') OR regexp_matches(lower(w), '[aeiouyàáâãäåèéêëìíîïòóôõöùúûüý]') "
    "AND length(regexp_replace(w, '[^0-9]', '', 'g')) <= length(regexp_replace(lower(w), '[^\\p{L}]', '', 'g'))))"
)
_CLEAR = (
    "coalesce(base <> '' AND NOT (" + " OR ".join(f"regexp_matches(base, {q(p)})" for p in MACHINE_NAMES) + f") AND len(list_filter(rw, lambda w: lower(w) NOT IN {_list(VAGUE_WORDS)})) > 0 "
    "AND (len(rw) >= 2 OR len(rw) = 1 AND length(rw[1]) >= 4 AND length(regexp_replace(base, '[^\\p{L}]', '', 'g')) >= length(regexp_replace(base, '[^0-9]', '', 'g'))), FALSE)"
)
_POINTS = []
for _t in SEARCH.lower().split():
    _POINTS.append(
        f"CASE WHEN contains(lower(regexp_extract(path, '[^/]*$')), {q(_t)}) THEN 10 WHEN contains(lower(regexp_replace(path, '/[^/]*$', '')), {q(_t)}) THEN 6 "
        f"WHEN contains(lower(description || ' ' || preview || ' ' || note), {q(_t)}) THEN 4 WHEN contains(lower(search_text), {q(_t)}) THEN 2 WHEN contains(lower(original_path), {q(_t)}) THEN 1 END"
    )
CATALOG = (
    f"(SELECT coalesce(topic, 'Other') || '/' || file_id || ' ' || regexp_extract(rel_path, '[^/]*$') AS path, rel_path AS original_path, kind, strftime(modified AT TIME ZONE 'UTC', '%Y-%m-%d %H.%M') AS date, "
    f"n_bytes AS size, coalesce(doc_label, '') AS description, coalesce(title, '') AS preview, '' AS note, coalesce(left(text, 1500), '') AS search_text FROM {FILES})"
)
EMAIL = r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}\b"
PHONE = r"(?:\+\d{1,3}[\s.-]?)?(?:\(\d{3}\)\s?|\b\d{3}[\s.-])\d{3}[\s.-]\d{4}\b"
_DETAIL = "SELECT section_id, value, count(DISTINCT block_no)::INT AS sources FROM (SELECT section_id, block_no, lower(trim(unnest(regexp_extract_all(text, {p})))) AS value FROM (SELECT DISTINCT section_id, block_no, block_id, text FROM blocks WHERE text IS NOT NULL)) GROUP BY ALL"
_BIGRAMS = "CASE WHEN length({c}) >= 2 THEN list_transform(range(1, length({c})), lambda i: substring({c}, i, 2)) ELSE [] END"

_LINE_WORDS = "list_filter(string_split_regex(regexp_replace({x}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[^\\p{{L}}\\p{{N}}'']+'), lambda w: trim(w, ' ') <> '')"


def _first(w: str) -> str:
    return f"upper(left({w}, 1)) || substring({w}, 2)"


def _good_line() -> str:
    """The first line of a text that reads like a title."""
    tidy = "trim(trim(trim(trim(regexp_replace(raw, '[\\t ]+', ' ', 'g'), ' '), '•*-#|\"“”:=_'), ' '), ' ')"
    lettered = "len(list_filter(ws, lambda w: length(regexp_replace(w, '[^\\p{L}]', '', 'g')) >= 2))"
    odd = "length(regexp_replace(line, '[\\p{L}\\p{N} .,''&\\-()/:!?$€£%+#]', '', 'g'))"
    good = f"length(line) >= 3 AND NOT regexp_matches(line, {q(JUNK_LINE)}) AND {lettered} > 0 AND NOT ({lettered} = 1 AND (length(ws[1]) < 4 OR length(line) < 4)) AND {odd} * 4 <= length(line)"
    loud = "length(regexp_replace(s, '[^\\p{L}]', '', 'g')) >= 4 AND NOT regexp_matches(s, '\\p{Ll}')"
    title = f"array_to_string(list_transform(string_split(lower(s), ' '), lambda w: CASE WHEN w IN {_list(SMALL_WORDS)} THEN w ELSE {_first('w')} END), ' ')"
    return (
        f"WITH l AS (SELECT doc_id, string_split_regex(text, '\\r\\n|\\n|\\r')[1:{LINES}] AS ls FROM documents WHERE text IS NOT NULL), "
        f"e AS (SELECT doc_id, unnest(ls) AS raw, unnest(range(1, len(ls) + 1)) AS k FROM l), t AS (SELECT *, {tidy} AS line FROM e), w AS (SELECT *, {_LINE_WORDS.format(x='line')} AS ws FROM t), "
        f"g AS (SELECT doc_id, arg_min(line, k) AS line, arg_min(ws, k) AS ws FROM w WHERE {good} GROUP BY doc_id), "
        f"s AS (SELECT doc_id, rtrim(CASE WHEN len(ws) > {WORDS} THEN rtrim(array_to_string(string_split(line, ' ')[1:{WORDS}], ' '), ',;:-') ELSE line END, '.,;:') AS s FROM g) "
        f"SELECT d.doc_id, CASE WHEN {loud} THEN {_first('(' + title + ')')} ELSE s END AS title FROM documents d LEFT JOIN s USING (doc_id)"
    )


def _topics() -> str:
    """Scores of all phrases in all files.  Signs are doubled in texts and phrases,
    so that two phrases can share the sign between them."""
    import re

    rows = []
    for i, (topic, phrases) in enumerate(rules()):
        for k, (phrase, weight, label, _) in enumerate(phrases):
            body = r"\s+".join("".join(c if c.isalnum() else re.escape(c) * 2 for c in w) for w in phrase.split())
            end = r"(?:[^\p{L}\p{N}]|$)" if phrase[-1].isalnum() else ""
            pattern = r"(?i)(?:^|[^\p{L}\p{N}])" + body + end
            rows.append(f"({i}, {q(topic)}, {k}, {weight}, {q(label) if label else 'NULL'}, {q(pattern)})")
    double = "regexp_replace(coalesce({c}, ''), '([^\\p{{L}}\\p{{N}}])', '\\1\\1', 'g')"
    return (
        f"WITH r(i, topic, k, weight, label, pat) AS (VALUES {', '.join(rows)}), f AS (SELECT file_id, {double.format(c='title')} AS t, {double.format(c=f'left(text, {HEAD})')} AS x FROM {FILES}), "
        "m AS (SELECT file_id, i, topic, k, weight, label, regexp_matches(t, pat) AS hit, least(3, len(regexp_extract_all(x, pat))) AS n FROM f, r), "
        "s AS (SELECT file_id, i, topic, sum(weight * (CASE WHEN hit THEN 3 ELSE 0 END + n)) AS score, count(*) AS clues, arg_max(label, weight * (CASE WHEN hit THEN 10 ELSE 1 END) * 1000 - k) FILTER (label IS NOT NULL) AS label FROM m WHERE hit OR n > 0 GROUP BY file_id, i, topic), "
        "b AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, i) AS rank FROM s WHERE clues >= 2 AND score >= 5 OR score >= 12) SELECT file_id, topic, label, score::INT AS score FROM b WHERE rank = 1"
    )


def _name_dates() -> str:
    """Moments in names, with a character around instead of a look around."""
    compact = r"(?:^|[^0-9])((?:19|20)[0-9]{2})(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])(?:[-_ T.]?([01][0-9]|2[0-3])([0-5][0-9])([0-5][0-9])?)?(?:[^0-9]|$)"
    apart = r"(?:^|[^0-9])((?:19|20)[0-9]{2})[-_.]([01]?[0-9])[-_.]([0-3]?[0-9])(?:[-_ T.at]+([01]?[0-9]|2[0-3])[-_.:h]([0-5][0-9])(?:[-_.:m]([0-5][0-9]))?)?(?:[^0-9]|$)"
    millis = r"(?:^|[^0-9])(1[3-9][0-9]{11})(?:[^0-9]|$)"
    fields = "['y', 'm', 'd', 'h', 'i', 's']"
    part = lambda c: f"TRY_CAST(nullif(p.{c}, '') AS BIGINT)"
    hour = f"CASE WHEN p.i <> '' THEN {part('h')} ELSE 12 END"
    rest = lambda c: f"CASE WHEN p.i <> '' AND p.h <> '' THEN coalesce({part(c)}, 0) ELSE 0 END"
    moment = f"TRY(make_timestamp({part('y')}, {part('m')}, {part('d')}, {hour}, {rest('i')}, ({rest('s')})::DOUBLE))"
    return (
        f"WITH n AS (SELECT DISTINCT offer_id, date_text AS t FROM date_offers WHERE date_text IS NOT NULL), p AS (SELECT offer_id, t, CASE WHEN regexp_matches(t, {q(compact)}) THEN regexp_extract(t, {q(compact)}, {fields}) WHEN regexp_matches(t, {q(apart)}) THEN regexp_extract(t, {q(apart)}, {fields}) END AS p, "
        f"TRY_CAST(nullif(regexp_extract(t, {q(millis)}, 1), '') AS BIGINT) AS ms FROM n), d AS (SELECT offer_id, CASE WHEN p IS NOT NULL THEN CASE WHEN {part('y')} >= 1990 AND ({moment})::DATE <= current_date + 1 THEN {moment} END "
        "WHEN year(epoch_ms(ms)) BETWEEN 2010 AND year(current_date) THEN epoch_ms(ms) END AS moment FROM p) SELECT offer_id, moment::TIMESTAMP AS moment FROM d WHERE moment IS NOT NULL"
    )


_INDEX_BITS = (
    "list_filter([nullif(split_part(date, ' ', 1), ''), nullif(description, ''), CASE WHEN preview <> '' THEN '\"' || left(preview, 80) || '\"' END, "
    "CASE WHEN original_path <> '' AND regexp_extract(original_path, '[^/]*$') <> name THEN 'was ' || regexp_extract(original_path, '[^/]*$') END], lambda b: b IS NOT NULL)"
)

SQL = {
    "dup_groups": "SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS kept, (sum(length(text)) - max(length(text)))::BIGINT AS wasted FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
    "dup_extras": "SELECT d.doc_id AS extra, k.kept FROM documents d JOIN (SELECT text, min(doc_id) AS kept FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1) k ON d.text = k.text WHERE d.doc_id <> k.kept",
    "norm_text": f"SELECT item_id, {_NORM % 'text'} AS norm, length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g'))::INT AS alnum, len(list_filter(string_split_regex(text, {q(_S)}), lambda w: w <> ''))::INT AS words FROM benchmark",
    "clean_titles": f"SELECT file_id, regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(title, '[\\x{{200b}}-\\x{{200d}}\\x{{feff}}]', '', 'g'), '“”‘’', '\"\"''''' ), '''{{2,}}', '''', 'g'), {q(_S)}, ' ', 'g'), '^{_S}|{_S}$', '', 'g') AS clean FROM {FILES} WHERE title IS NOT NULL",
    "previews": f"WITH t AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^{_S}|{_S}$', '', 'g') AS t FROM documents) SELECT doc_id, CASE WHEN t = '' THEN NULL WHEN length(t) <= 160 THEN t ELSE regexp_replace(left(t, 160), ' [^ ]*$', '') || '…' END AS preview, CASE WHEN length(text) > 70 THEN regexp_replace(left(text, 69), '^{_S}|{_S}$', '', 'g') || '…' ELSE text END AS cut FROM t",
    "size_labels": f"SELECT file_id, {_SIZE.format(n='n_bytes')} AS size, {_SIZE.format(n='(n_bytes * 4000)')} AS size_4000, CASE WHEN s < 60 THEN s || ' sec' WHEN s < 3600 THEN ((s + 30) // 60) || ' min' ELSE (s // 3600) || ' hr ' || (s % 3600 // 60) || ' min' END AS length FROM (SELECT *, n_bytes // 100 AS s FROM {FILES})",
    "escapes": "SELECT item_id, regexp_replace(text, '([\\\\`*_{}\\[\\]<>|])', '\\\\\\1', 'g') AS md, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html, "
    "'sec-' || (item_id + 1) || '-' || left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 40) AS slug, "
    "coalesce(nullif(regexp_replace(left(trim(regexp_replace(regexp_replace(regexp_replace(text, '[\\\\/:*?\"<>|…]+', '', 'g'), '[^ -~\\x{a0}-\\x{24f}]', '', 'g'), '[\\s\\x{a0}]+', ' ', 'g')), 80), '[.\\s]+$', ''), ''), 'screenshot-notes') || '.md' AS file_name, replace(text, chr(13), '') AS back FROM benchmark",
    "similar_neighbours": f"WITH t AS (SELECT DISTINCT section_id, left({_NORM % 'title'}, 40) AS n FROM sections WHERE title IS NOT NULL), p AS (SELECT x.section_id, x.n AS a, y.n AS b FROM t x JOIN t y ON y.section_id = x.section_id + 1), "
    f"g AS (SELECT *, {_BIGRAMS.format(c='a')} AS ga, {_BIGRAMS.format(c='b')} AS gb FROM p) SELECT section_id, round(CASE WHEN a = b THEN 1.0 WHEN length(a) < 2 OR length(b) < 2 THEN 0.0 ELSE 2.0 * list_sum(list_transform(list_distinct(ga), lambda k: least(len(list_filter(ga, lambda z: z = k)), len(list_filter(gb, lambda z: z = k))))) / (length(a) + length(b) - 2) END, 6)::DOUBLE AS dice FROM g",
    "natural_order": f"SELECT file_id, array_to_string(list_transform(regexp_extract_all(lower(regexp_extract(rel_path, '[^/]*$')), '\\d+|\\D+'), lambda p: CASE WHEN regexp_matches(p, '^\\d') THEN right(lpad(p, greatest(12, length(p))::INT, '0'), 12) ELSE p END), '') AS sort_key FROM {FILES}",
    "joined_lines": "WITH t AS (SELECT *, lead(text) OVER (PARTITION BY file_id, page ORDER BY line_no, line_id) AS b FROM (SELECT DISTINCT line_id, file_id, page, line_no, text FROM ocr_line)) SELECT line_id, CASE WHEN regexp_matches(text, '[\\p{L}\\d]-$') AND regexp_matches(b, '^[\\p{L}\\d]') THEN text || b ELSE text || ' ' || b END AS joined FROM t WHERE b IS NOT NULL",
    "emails_found": _DETAIL.format(p=q(EMAIL)),
    "phones_found": _DETAIL.format(p=q(PHONE)),
    "links_minus_email_domains": "WITH t AS (SELECT DISTINCT section_id, lower(hl_key) AS k, lower(hl_value) AS v FROM highlights WHERE hl_value IS NOT NULL) SELECT section_id, v AS link FROM t l WHERE k = 'links' AND NOT EXISTS (SELECT 1 FROM t e WHERE e.k = 'emails' AND e.section_id = l.section_id AND (e.v = l.v OR ends_with(e.v, '@' || l.v)))",
    "highlight_values": "SELECT section_id, lower(hl_key) AS hl_key, lower(hl_value) AS low, arg_min(hl_value, highlight_id) AS value, count(*) AS times FROM (SELECT DISTINCT highlight_id, section_id, hl_key, hl_value FROM highlights WHERE hl_value <> '') GROUP BY section_id, lower(hl_key), lower(hl_value)",
    "keyword_mentions": f"SELECT doc_id FROM documents WHERE regexp_matches(text, {q('(?i)' + (chr(92) + 's+').join(KEYWORD.split()))})",
    "keyword_dedup": f"WITH h AS (SELECT DISTINCT section_id, block_no, text FROM blocks WHERE text IS NOT NULL AND regexp_matches(text, '(?i)the')), n AS (SELECT section_id, block_no, {_NORM % 'text'} AS norm FROM h) SELECT section_id, block_no FROM n l WHERE NOT EXISTS (SELECT 1 FROM n e WHERE e.section_id = l.section_id AND e.block_no < l.block_no AND contains(e.norm, l.norm))",
    "kind_counts": f"WITH e AS (SELECT *, {_EXT} AS xt, lower(rel_path) AS low FROM {FILES}), p AS (SELECT *, {_PLAIN} AS plain FROM e), k AS (SELECT CASE WHEN plain = 'PHOTO' AND regexp_matches(low, 'screenshot|screen_shot|screen shot') THEN 'SCREENSHOT' "
    f"WHEN plain = 'MUSIC' AND (xt IN {_list(VOICE_ONLY)} OR len(list_filter(string_split(low, '/'), lambda x: regexp_matches(x, {q(VOICE_HINTS)}))) > 0) THEN 'VOICE_RECORDING' ELSE plain END AS kind FROM p) SELECT kind, {_LABEL} AS label, count(*) AS files FROM k GROUP BY ALL",
    "name_meaningful": f"WITH b AS (SELECT file_id, {_strip('title')} AS base FROM {FILES} WHERE title IS NOT NULL), r AS (SELECT *, {_REAL} AS rw FROM b) SELECT file_id, {_CLEAR} AS clear FROM r",
    "dup_files": f"WITH b AS (SELECT file_id, title, modified, rel_path || '#' || file_id AS g, base AS own, {_strip('base')} AS base FROM {FILES} WHERE title <> ''), r AS (SELECT *, {_REAL} AS rw FROM b), "
    f"o AS (SELECT *, {{'c': (NOT {_CLEAR})::INT, 'd': (base <> own)::INT, 'e': modified, 'f': length(g) - length(replace(g, '/', '')), 'g': g}} AS ord FROM r) SELECT sha256(title) AS hash, count(*) AS copies, arg_min(file_id, ord) AS kept, ((count(*) - 1) * length(title))::BIGINT AS wasted FROM o GROUP BY title HAVING count(*) > 1",
    "best_date": "SELECT file_id, arg_min(date_text, date_source * 1000000000000 + offer_id) AS date_text, min(date_source) AS date_source FROM (SELECT DISTINCT offer_id, file_id, date_text, date_source FROM date_offers WHERE date_text <> '') GROUP BY file_id",
    "file_descriptions": f"SELECT file_id, array_to_string(list_filter(list_concat([coalesce(doc_label, {_LABEL}), CASE WHEN pages = 1 THEN '1 page' ELSE pages || ' pages' END, width || '×' || height, CASE WHEN len(tags) > 0 THEN 'shows: ' || array_to_string(tags, ', ') END, 'taken in ' || place], coalesce(details, [])), lambda x: x IS NOT NULL), ' · ') AS about FROM {FILES}",
    "folder_counts": f"SELECT split_part(rel_path, '/', 1) AS folder, count(*) AS files FROM {FILES} GROUP BY ALL",
    "folder_rollup": f"WITH p AS (SELECT string_split(rel_path, '/') AS parts, n_bytes FROM {FILES}), a AS (SELECT unnest(list_transform(range(0, len(parts)), lambda i: array_to_string(parts[1:i], '/'))) AS folder, n_bytes FROM p) SELECT folder, count(*) AS files, coalesce(sum(n_bytes), 0)::BIGINT AS bytes FROM a GROUP BY folder",
    "catalog_search": f"SELECT path, ({' + '.join(_POINTS)})::INT AS score, date FROM {CATALOG} WHERE ({' + '.join(_POINTS)}) IS NOT NULL ORDER BY score DESC, date DESC, path LIMIT 300",
    "catalog_upsert": f"WITH c AS {CATALOG}, n AS (SELECT *, '2' AS run_id FROM c WHERE kind IN ('PHOTO', 'SCREENSHOT')), o AS (SELECT *, '1' AS run_id FROM c WHERE preview <> '' AND lower(path) NOT IN (SELECT lower(path) FROM n)) SELECT run_id, count(*) AS entries, sum(size)::BIGINT AS bytes FROM (FROM n UNION ALL FROM o) GROUP BY run_id",
    "catalog_join": "SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, quality, toxic FROM labels) l ON d.doc_id = l.doc_id",
    "catalog_prune": "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "catalog_untracked": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "unique_names": f"WITH f AS (SELECT file_id, regexp_replace(rel_path, '/[^/]*$', '') AS folder, regexp_extract(rel_path, '[^/]*$') AS name FROM {FILES}), r AS (SELECT *, row_number() OVER (PARTITION BY lower(folder), lower(name) ORDER BY file_id) AS n FROM f) "
    "SELECT file_id, folder, CASE WHEN n = 1 THEN name ELSE regexp_replace(name, '(\\.[^.]*)?$', ' (' || n || ')\\1') END AS claimed FROM r",
    "line_gaps": "WITH l AS (SELECT DISTINCT line_id, file_id, page, line_no, bbox.y0 AS y0, bbox.y1 AS y1 FROM ocr_line), g AS (SELECT file_id, y0 - lag(y1) OVER (PARTITION BY file_id, page ORDER BY line_no) AS gap FROM l) SELECT file_id, median(gap) AS typical, count(*) AS gaps FROM g WHERE gap >= 0 GROUP BY file_id",
    "weighted_body_size": "WITH l AS (SELECT DISTINCT line_id, file_id, text, (bbox.y1 - bbox.y0) * 0.72 AS size FROM ocr_line), w AS (SELECT file_id, size, unnest(range(0, greatest(1, round(length(text) / 10.0))::BIGINT)) FROM l) SELECT file_id, median(size) AS body FROM w GROUP BY file_id",
    "line_classes": f"WITH l AS (SELECT block_id, unnest(string_split(text, chr(10))) AS x FROM (SELECT DISTINCT block_id, text FROM blocks WHERE text IS NOT NULL)) SELECT block_id, CASE WHEN regexp_matches(x, {q(CHECK)}) THEN 'check' WHEN regexp_matches(x, {q(ORDERED)}) THEN 'ordered' WHEN regexp_matches(x, {q(BULLET)}) OR regexp_matches(x, {q(MISREAD_BULLET)}) THEN 'bullet' WHEN regexp_matches(x, {q(FIELD)}) AND NOT regexp_matches(x, '(?i)^https?:') THEN 'field' ELSE 'text' END AS kind, count(*) AS lines FROM l GROUP BY ALL",
    "reading_order": "SELECT file_id, page, string_agg(text, chr(10) ORDER BY floor(bbox.y0 / 40), bbox.x0, line_id) AS page_text FROM (SELECT DISTINCT line_id, file_id, page, text, bbox FROM ocr_line) GROUP BY file_id, page",
    "block_runs": "WITH b AS (SELECT DISTINCT block_id, section_id, block_no, block_type FROM blocks), n AS (SELECT *, CASE WHEN block_type IS NOT DISTINCT FROM lag(block_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY section_id ORDER BY block_no, block_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY section_id ORDER BY block_no, block_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM n) SELECT section_id, run, block_type, count(*) AS blocks, min(block_no) AS first_no FROM r GROUP BY ALL",
    "section_stats": f"SELECT section_id, len(list_filter(string_split_regex(coalesce(text, ''), {q(_S)}), lambda w: w <> ''))::INT AS words, coalesce(floor(confidence + 0.5)::INT, 0) AS confidence, coalesce(confidence < 70, FALSE) AS unsure, coalesce(len(source_files), 0)::INT AS files FROM (SELECT DISTINCT ON (section_id) * FROM sections)",
    "section_sources": "SELECT file, count(*) AS sections, min(section_id) AS first_section FROM (SELECT section_id, unnest(list_distinct(source_files)) AS file FROM (SELECT DISTINCT ON (section_id) * FROM sections)) GROUP BY file",
    "section_components": "WITH RECURSIVE s AS (SELECT DISTINCT section_id, source_files FROM sections), f AS (SELECT DISTINCT section_id, unnest(source_files) AS file FROM s), e AS (SELECT DISTINCT a.section_id AS i, b.section_id AS j FROM f a JOIN f b ON a.file = b.file AND a.section_id <> b.section_id), r(node, to_node) AS (SELECT section_id, section_id FROM s UNION SELECT r.node, e.j FROM r JOIN e ON r.to_node = e.i) SELECT node, min(to_node) AS component FROM r GROUP BY node",
    "section_bubbles": "WITH b AS (SELECT DISTINCT block_id, section_id, block_no, block_type, text FROM blocks), n AS (SELECT *, CASE WHEN block_type IS NOT DISTINCT FROM lag(block_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY section_id ORDER BY block_no, block_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY section_id ORDER BY block_no, block_id)::BIGINT AS bubble FROM n) SELECT section_id, bubble, block_type, coalesce(string_agg(text, ' ' ORDER BY block_no, block_id), '') AS said FROM r GROUP BY section_id, bubble, block_type",
    "catalog_upsert_rows": f"WITH c AS {CATALOG}, n AS (SELECT *, '2' AS run_id FROM c WHERE kind IN ('PHOTO', 'SCREENSHOT')), o AS (SELECT *, '1' AS run_id FROM c WHERE preview <> '' AND lower(path) NOT IN (SELECT lower(path) FROM n)) SELECT path, run_id, size, date FROM (FROM n UNION ALL FROM o)",
    "markup_roundtrip": "SELECT DISTINCT section_id, TRUE AS same FROM sections WHERE text IS NOT NULL",
    "sanitized": "WITH s AS (SELECT item_id, trim(trim(regexp_replace(regexp_replace(text, '[\\\\/:*?\"<>|\\x{0}-\\x{1f}\\x{7f}-\\x{a0}]', ' ', 'g'), '\\s+', ' ', 'g')), '. -_,') AS s FROM benchmark), h AS (SELECT *, left(s, 60) AS h FROM s), b AS (SELECT *, length(h) - strpos(reverse(h), ' ') AS blank FROM h) SELECT item_id, CASE WHEN length(s) <= 60 THEN s ELSE trim(CASE WHEN contains(h, ' ') AND blank > 30 THEN left(h, blank) ELSE h END, '. -_,') END AS name FROM b",
    "first_good_lines": _good_line(),
    "topic_classify": _topics(),
    "file_name_dates": _name_dates(),
    "index_lines": f"WITH c AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM {CATALOG}), b AS (SELECT *, {_INDEX_BITS} AS bits FROM c) SELECT regexp_replace(path, '/[^/]*$', '') AS folder, name, '• ' || name || CASE WHEN len(bits) > 0 THEN '  (' || array_to_string(bits, ' · ') || ')' ELSE '' END AS line FROM b",
}
