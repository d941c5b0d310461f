"""SQL of what takes several steps: outline texts with template heads, narrative units, chunks, snippets. Written from the results
they must give, step by step over lines, so that it shares no code with the operators."""

from __future__ import annotations

from marginalia.functions import text
from marginalia.operators import chunking
from marginalia.plans.scalars import OUTLINE_SQL, SHARED_SQL, TOP_SQL, sql_lines, sql_pattern, sql_plain, sql_replaced, sql_trimmed

NL = "chr(10)"
HEADING = f"regexp_matches(line, {sql_pattern(chr(92) + 'A' + chr(92) + 's*#+[ ' + chr(92) + 't]')})"
IS_OUTLINE = "regexp_matches(rel_path, '^(pages|journals)/')"


def lines_of(source: str, c: str, keys: str) -> str:
    """Numbered lines of a column: keys, pos, line."""
    return f"SELECT {keys}, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT {keys}, {sql_lines(c)} AS l FROM {source})"


def outlined(source: str) -> str:
    """``source`` (content and others) with id, plain (its outline text) and bullets (its units that aren't stubs, one below the other)."""
    head = f"{TOP_SQL} AND lower({sql_trimmed(sql_replaced('line', chr(92) + 'A[-*' + chr(92) + 's]+'))}) IN ('{text.TEMPLATE_HEADS[0]}')"
    child = f"NOT head AND {sql_trimmed('line')} <> ''"
    return f"""(
WITH src AS MATERIALIZED (SELECT *, row_number() OVER () AS id FROM {source}),
  bare AS (SELECT id, {OUTLINE_SQL} AS bare FROM src),
  marked AS (SELECT *, {TOP_SQL} AS top, {head} AS head FROM ({lines_of('bare', 'bare', 'id')})),
  blocks AS (SELECT *, max(CASE WHEN top THEN pos END) OVER (PARTITION BY id ORDER BY pos) AS block FROM marked),
  levels AS (SELECT *, bool_or(head) OVER w AS moved, min(CASE WHEN {child} THEN pos END) OVER w AS first,
    arg_min(CASE WHEN {child} THEN length(regexp_extract(line, '^[ \\t]*')) END, CASE WHEN {child} THEN pos END) OVER w AS level FROM blocks WINDOW w AS (PARTITION BY id, block)),
  left_over AS (SELECT id, pos, CASE WHEN moved AND pos >= first THEN substr(line, least(level, length(regexp_extract(line, '^[ \\t]*'))) + 1) ELSE line END AS line FROM levels WHERE NOT head),
  plains AS (SELECT id, string_agg(line || {NL}, '' ORDER BY pos) AS plain FROM left_over GROUP BY id),
  units AS (SELECT id, unit, string_agg(line, {NL} ORDER BY pos) AS unit_text, bool_and({sql_trimmed('line')} IN ('', '-', '*')) AS stub
    FROM (SELECT *, sum({TOP_SQL}::INT) OVER (PARTITION BY id ORDER BY pos) AS unit FROM ({lines_of('plains', 'plain', 'id')})) WHERE unit > 0 GROUP BY ALL),
  kept AS (SELECT id, string_agg(unit_text, {NL} ORDER BY unit) AS bullets, list(unit_text ORDER BY unit) AS unit_texts FROM units WHERE NOT stub GROUP BY id)
SELECT src.*, CASE WHEN content IS NOT NULL THEN coalesce(plain, '') END AS plain, CASE WHEN content IS NOT NULL THEN coalesce(bullets, '') END AS bullets, unit_texts
FROM src LEFT JOIN plains USING (id) LEFT JOIN kept USING (id))"""


def narrative() -> str:
    """Code points of the prose of a row of ``outlined``."""
    return f"length(CASE WHEN {IS_OUTLINE} THEN {sql_plain('bullets')} ELSE {sql_plain(SHARED_SQL)} END)::INTEGER"


def size(c: str) -> str:
    return f"(length({c}) // {text.TOKEN_CHARS})"


def right_trimmed(c: str) -> str:
    return sql_replaced(c, r"\s+\z")


def stripped_ends(c: str) -> str:
    return f"trim({c}, {NL})"


def chunks_sql(latest: str) -> str:
    """Chunks of ``latest`` (rel_path, mtime, content): rel_path, ord, text. Lists are folded into {{out, held, tokens, …}} as they go."""
    cap, target = chunking.CAP, chunking.TARGET
    title = "url_decode(CASE WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN regexp_extract(name, '(?s)^(.+)\\.[^.]*$', 1) ELSE name END)"
    state = "'out': {out}, 'held': {held}, 'tokens': {tokens}, 'n': 0, 'body': '', 'parts': []::VARCHAR[], 'rows': {rows}, 'para': 0, 'head': a.head, 'starts': false, 'single': false"
    made = lambda **k: "{" + state.format(**{"rows": "0", **k}) + "}"
    item = lambda **k: "{" + ", ".join(f"'{n}': {v}" for n, v in {"out": "[]::VARCHAR[]", "held": "NULL::VARCHAR", "tokens": "0::BIGINT", "n": "0::BIGINT", "body": "''", "parts": "[]::VARCHAR[]", "rows": "0", "para": "0::BIGINT", "head": "NULL::VARCHAR", "starts": "false", "single": "false", **k}.items()) + "}"
    flushed = "CASE WHEN a.held IS NULL THEN a.out ELSE list_append(a.out, a.held) END"
    # long bullets: the first line heads every part
    bullet_fold = (
        f"CASE WHEN a.rows > 1 AND a.tokens + x.n >= {target} THEN " + made(out="list_append(a.out, a.held)", held=f"a.head || {NL} || x.body", tokens=f"{size('a.head')} + x.n", rows="2")
        + " ELSE " + made(out="a.out", held=f"a.held || {NL} || x.body", tokens="a.tokens + x.n", rows="a.rows + 1") + " END"
    )
    outline_fold = (
        f"CASE WHEN x.n > {cap} THEN " + made(out=f"list_concat({flushed}, x.parts)", held="NULL::VARCHAR", tokens="0::BIGINT")
        + f" WHEN a.held IS NOT NULL AND a.tokens > 0 AND a.tokens + x.n > {cap} THEN " + made(out="list_append(a.out, a.held)", held="x.body", tokens="x.n")
        + " ELSE " + made(out="a.out", held=f"coalesce(a.held || {NL}, '') || x.body", tokens="a.tokens + x.n") + " END"
    )
    headed = lambda c: f"CASE WHEN a.head IS NULL THEN {right_trimmed(c)} ELSE a.head || {NL} || {NL} || {right_trimmed(c)} END"
    full = f"(CASE WHEN x.starts THEN a.tokens > 0 AND a.tokens + x.para > {cap} ELSE false END)"
    line_full = f"(x.single AND a.held <> '' AND NOT {full} AND a.tokens + {size('coalesce(a.head, ' + chr(39) * 2 + ')')} + x.n > {cap})"
    section_fold = (
        f"CASE WHEN {full} OR {line_full} THEN " + made(out=f"list_append(a.out, {headed('a.held')})", held="x.body", tokens="x.n")
        + " ELSE " + made(out="a.out", held="a.held || x.body", tokens="a.tokens + x.n") + " END"
    )
    kept = f"CASE WHEN {sql_trimmed('coalesce(a.held, ' + chr(39) * 2 + ')')} <> '' THEN list_append(a.out, {right_trimmed('a.held')}) ELSE a.out END"
    note_fold = (
        f"CASE WHEN x.n > {cap} THEN " + made(out=f"list_concat({kept}, x.parts)", held="''", tokens="0::BIGINT")
        + f" WHEN a.tokens > 0 AND a.tokens + x.n > {cap} THEN " + made(out=kept, held=f"x.body || {NL}", tokens="x.n")
        + f" ELSE " + made(out="a.out", held=f"CASE WHEN a.held = '' THEN x.body ELSE a.held || {NL} || {NL} || x.body END", tokens="a.tokens + x.n") + " END"
    )
    fold = lambda items, first, step: f"list_reduce(list_prepend({first}, {items}), lambda a, x: {step})"
    last = lambda c, ok: f"CASE WHEN {ok} THEN list_append({c}.out, {c}.held) ELSE {c}.out END"
    return f"""
WITH notes_read AS MATERIALIZED (SELECT * FROM {outlined(f"(SELECT * FROM ({latest}))")}),
  titles AS (SELECT rel_path, {title} AS title FROM (SELECT rel_path, regexp_extract(rel_path, '([^/]*)$', 1) AS name FROM notes_read)),
  bullet_units AS (SELECT rel_path, unnest(unit_texts) AS body, generate_subscripts(unit_texts, 1) AS pos FROM notes_read WHERE {IS_OUTLINE} AND unit_texts IS NOT NULL),
  long_units AS (SELECT rel_path, pos, string_split(body, {NL}) AS rows FROM bullet_units WHERE {size('body')} > {cap}),
  long_parts AS (SELECT rel_path, pos, CASE WHEN s.rows > 1 OR len(s.out) = 0 THEN list_append(s.out, s.held) ELSE s.out END AS parts FROM (
    SELECT rel_path, pos, {fold(f"list_transform(rows[2:], lambda r: {item(body='r', n=size('r'))})", item(held='rows[1]', tokens=size('rows[1]'), rows='1', head='rows[1]'), bullet_fold)} AS s FROM long_units)),
  outline_bodies AS (SELECT rel_path, {last('s', 's.held IS NOT NULL')} AS bodies FROM (
    SELECT rel_path, {fold('items', item(), outline_fold)} AS s FROM (
      SELECT rel_path, list({item(body='body', n=size('body'), parts='coalesce(parts, []::VARCHAR[])')} ORDER BY pos) AS items FROM bullet_units LEFT JOIN long_parts USING (rel_path, pos) GROUP BY rel_path))),
  prose AS (SELECT rel_path, {SHARED_SQL} AS note FROM notes_read WHERE NOT {IS_OUTLINE}),
  short AS (SELECT rel_path, [{sql_trimmed('note')}] AS bodies FROM prose WHERE {sql_trimmed('note')} <> '' AND {size(sql_trimmed('note'))} <= {cap}),
  long AS (SELECT * FROM prose WHERE {size(sql_trimmed('note'))} > {cap}),
  section_lines AS (SELECT *, sum(({HEADING})::INT) OVER (PARTITION BY rel_path ORDER BY pos) AS section FROM ({lines_of('long', 'note', 'rel_path')})),
  sections AS (SELECT rel_path, section, {stripped_ends(f"string_agg(line, {NL} ORDER BY pos)")} AS body FROM section_lines GROUP BY ALL HAVING bool_or({sql_trimmed('line')} <> '')),
  cut_lines AS (SELECT *, pos = 1 AND {HEADING} AS heads FROM ({lines_of(f"(SELECT * FROM sections WHERE {size('body')} > {cap})", 'body', 'rel_path, section')})),
  heads AS (SELECT rel_path, section, max(CASE WHEN heads THEN line END) AS head FROM cut_lines GROUP BY ALL),
  paragraph_lines AS (SELECT *, sum(({sql_trimmed('line')} = '')::INT) OVER (PARTITION BY rel_path, section ORDER BY pos) AS paragraph FROM cut_lines WHERE NOT heads),
  paragraphs AS (SELECT *, sum(length(line) + 1) OVER p // {text.TOKEN_CHARS} AS para, pos = min(pos) OVER p AS starts FROM paragraph_lines
    WHERE {sql_trimmed('line')} <> '' WINDOW p AS (PARTITION BY rel_path, section, paragraph)),
  pieces AS (
    SELECT rel_path, section, pos, {item(body=f'line || {NL}', n=size('line'), para='para', starts='starts', single='true')} AS x FROM paragraphs WHERE para > {cap}
    UNION ALL
    SELECT rel_path, section, min(pos), {item(body=f"string_agg(line || {NL}, '' ORDER BY pos)", n='any_value(para)', para='any_value(para)', starts='true')} FROM paragraphs WHERE para <= {cap} GROUP BY rel_path, section, paragraph),
  section_parts AS (SELECT rel_path, section, CASE WHEN {sql_trimmed('a.held')} <> '' THEN list_append(a.out, {headed('a.held')}) ELSE a.out END AS parts FROM (
    SELECT rel_path, section, {fold('xs', item(held="''", head='head'), section_fold)} AS a FROM (SELECT rel_path, section, list(x ORDER BY pos) AS xs FROM pieces GROUP BY ALL) JOIN heads USING (rel_path, section))),
  long_bodies AS (SELECT rel_path, {kept} AS bodies FROM (
    SELECT rel_path, {fold('xs', item(held="''"), note_fold)} AS a FROM (
      SELECT rel_path, list({item(body='body', n=size('body'), parts='CASE WHEN parts IS NOT NULL THEN parts WHEN head IS NOT NULL THEN [head] ELSE []::VARCHAR[] END')} ORDER BY section) AS xs
      FROM sections LEFT JOIN section_parts USING (rel_path, section) LEFT JOIN heads USING (rel_path, section) GROUP BY rel_path)))
SELECT rel_path, (generate_subscripts(bodies, 1) - 1)::INTEGER AS ord, '# ' || title || {NL} || {NL} || unnest(bodies) AS text
FROM (SELECT * FROM outline_bodies UNION ALL SELECT * FROM short UNION ALL SELECT * FROM long_bodies) JOIN titles USING (rel_path)"""


def snippets_sql(hits: str, digits: int, width: int, shown: int) -> str:
    """For ``hits`` (term, rank, note_id, title, chunk_id, summary, text, body): term, rank, note_id, chunk_id, unit, unit_score, snippet."""
    bullet = f"({TOP_SQL})"
    words = lambda c: f"regexp_extract_all(lower({c}), '[\\pL\\pN]+')"
    cell = f"('0x' || left(md5(word), 8))::BIGINT % {width}"
    return f"""
WITH hits AS MATERIALIZED ({hits}),
  raw_lines AS (SELECT term, note_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT term, note_id, string_split(body, {NL}) AS l FROM hits WHERE text IS NOT NULL)),
  bullet_lines AS (SELECT *, sum({bullet}::INT) OVER (PARTITION BY term, note_id ORDER BY pos) AS piece FROM ({lines_of('(SELECT * FROM hits WHERE text IS NOT NULL)', 'body', 'term, note_id')})),
  bullets AS (SELECT term, note_id, piece, string_agg(line, {NL} ORDER BY pos) AS display FROM bullet_lines WHERE piece > 0 GROUP BY ALL HAVING NOT bool_and({sql_trimmed('line')} IN ('', '-', '*'))),
  headed AS (SELECT *, {HEADING} AS heads, {sql_trimmed('line')} = '' AS blank FROM raw_lines),
  ahead AS (SELECT *, arg_min(CASE WHEN NOT blank THEN heads END, CASE WHEN NOT blank THEN pos END) OVER (PARTITION BY term, note_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_heads,
    max(pos) OVER (PARTITION BY term, note_id) AS final FROM headed),
  section_lines AS (SELECT *, sum((heads OR blank AND coalesce(next_heads, false))::INT) OVER (PARTITION BY term, note_id ORDER BY pos) AS piece FROM ahead),
  sections AS (SELECT term, note_id, piece, string_agg(line || CASE WHEN pos < final THEN {NL} ELSE '' END, '' ORDER BY pos) AS display
    FROM section_lines WHERE (term, note_id) NOT IN (SELECT (term, note_id) FROM bullets) GROUP BY ALL),
  pieces AS (SELECT * FROM (SELECT * FROM bullets UNION ALL SELECT * FROM sections) WHERE {sql_trimmed('display')} <> ''),
  filled AS (SELECT term, note_id, piece, count(*) = 1 AND bool_and({HEADING}) AS only_heading FROM ({lines_of('pieces', 'display', 'term, note_id, piece')}) WHERE {sql_trimmed('line')} <> '' GROUP BY ALL),
  units AS (SELECT *, (row_number() OVER (PARTITION BY term, note_id ORDER BY piece) - 1)::INTEGER AS unit FROM pieces JOIN filled USING (term, note_id, piece) WHERE NOT only_heading),
  unit_cells AS (SELECT term, note_id, unit, {cell} AS cell, count(*) AS n FROM (SELECT term, note_id, unit, unnest({words("'# ' || coalesce(title, '') || chr(10) || chr(10) || display")}) AS word FROM units JOIN (SELECT term, note_id, title FROM hits) USING (term, note_id)) GROUP BY ALL),
  term_cells AS (SELECT term, {cell} AS cell, count(*) AS n FROM (SELECT DISTINCT term, unnest(list_transform({words('term')}, lambda w, i: {{'w': w, 'i': i}})) AS e FROM hits), LATERAL (SELECT e.w AS word) GROUP BY ALL),
  lengths AS (SELECT term, note_id, unit, sqrt(sum(n * n)) AS length FROM unit_cells GROUP BY ALL),
  term_lengths AS (SELECT term, sqrt(sum(n * n)) AS term_length FROM term_cells GROUP BY ALL),
  products AS (SELECT term, note_id, unit, sum(u.n * t.n) AS product FROM unit_cells u JOIN term_cells t USING (term, cell) GROUP BY ALL),
  scored AS (SELECT term, note_id, unit, display, round(coalesce(product / (length * term_length), 0), {digits}) AS score
    FROM units LEFT JOIN products USING (term, note_id, unit) LEFT JOIN lengths USING (term, note_id, unit) LEFT JOIN term_lengths USING (term)),
  best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY term, note_id ORDER BY score DESC, unit) = 1),
  first_lines AS (SELECT term, note_id, arg_min(line, pos) AS first_line FROM ({lines_of('(SELECT * FROM hits WHERE text IS NOT NULL)', 'text', 'term, note_id, title')})
    WHERE {sql_trimmed('line')} <> '' AND {sql_trimmed('line')} IS DISTINCT FROM '# ' || title GROUP BY ALL)
SELECT term, rank, note_id, chunk_id, unit, score AS unit_score, CASE WHEN length(shown) > {shown} THEN left(shown, {shown}) || '…' ELSE shown END AS snippet
FROM (SELECT h.* EXCLUDE (score), unit, b.score, CASE WHEN text IS NOT NULL THEN coalesce(display, first_line, '') ELSE coalesce(({sql_lines('summary')})[1], '') END AS shown
  FROM hits h LEFT JOIN (SELECT term, note_id, unit, score, display FROM best) b USING (term, note_id) LEFT JOIN first_lines USING (term, note_id))"""


#: The scalar functions of whole notes, over every version in the scan feed.
SQL = {
    "preprocess_outline": f"SELECT rel_path, mtime, plain AS result FROM {outlined('raw_notes')}",
    "narrative_chars": f"SELECT rel_path, mtime, {narrative()} AS result FROM {outlined('raw_notes')}",
    "is_summarizable": f"SELECT rel_path, mtime, {narrative()} >= {text.SUMMARY_CHARS} AS result FROM {outlined('raw_notes')}",
}
