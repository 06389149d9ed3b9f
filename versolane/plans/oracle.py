"""For each query the SQL that says the same, for DuckDB over the same tables. Snippets that several share come first."""

from __future__ import annotations

import string
from html.entities import html5

from ..functions import html as H
from ..functions import text as T
from ..operators import language, translate
from ..sources import catalog


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SPACE = T.SPACE
#: What Python calls white space, digits and ASCII punctuation, character by character: the SQL shares no pattern with the code.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
SILENT = WHITE + string.punctuation + "".join(c for c in map(chr, range(0x110000)) if c.isdigit())
trim = lambda x: f"trim({x}, {q(WHITE)})"
letter = lambda x: f"regexp_matches({x}, '\\p{{L}}')"
sendable = lambda x: f"CASE WHEN regexp_matches({x}, '[A-Za-z]') THEN true ELSE length(trim({x}, {q(SILENT)})) > 0 END"
tokens = lambda n: f"CASE WHEN {n} = 0 THEN 0 ELSE greatest(1, {n} // 4) END"
scaled = lambda n: f"(CASE WHEN {n} > 50000 THEN floor(12500.0::DOUBLE * ({n} / 50000.0::DOUBLE)) ELSE {tokens(n)} END)::BIGINT"
words = lambda x: f"len(regexp_extract_all({x}, {q(f'[^{SPACE}]+')}))::BIGINT"


#: The references that the given pages hold, and a few more.
NAMED = {"nbsp": "\u00a0", "copy": "©", "middot": "·", "mdash": "—", "quot": '"', "lt": "<", "gt": ">", "amp": "&"}


def unescape(x: str) -> str:
    for name, char in NAMED.items():
        x = f"replace({x}, {q(f'&{name};')}, {q(char)})"
    return x


HOST = "regexp_extract(url, '^https?://([^/:?#]+)', 1)"
CHAPTERS = f"chapters AS (SELECT page_id, {HOST} AS book_id, row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) - 1 AS doc_idx, 'page_' || page_id || '.xhtml' AS name, html FROM pages)"
LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)"
PAGED = LINES + ", paged AS (SELECT doc_id AS book_id, i // 8 AS page_no, string_agg(t, chr(10) ORDER BY i) AS text FROM lines GROUP BY doc_id, i // 8)"
LONG = "texts AS (SELECT conv_id AS text_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"
MODELS = "models(model, provider, display_name, input_cost, output_cost, quality, speed, cost_indicator, quality_badge, description) AS (VALUES " + ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else f"{v}::DOUBLE" for v in m) + ")" for m in catalog.MODELS) + ")"
MANIFEST = (
    "manifest AS (SELECT doc_id AS job_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'Doc.' || doc_id || ['.epub', '.epub', '.epub', '.PDF', '.PDF', '.txt', ''][doc_id % 7 + 1] END AS original_filename, n_chars AS length, "
    "CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' END AS source_lang, ['Italian', 'English', 'Spanish'][doc_id % 3 + 1] AS target_lang, "
    f"CASE WHEN doc_id % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS provider, [{', '.join([q(m[0]) for m in catalog.MODELS] + [q('no-such-model')])}][(doc_id // 3) % 14 + 1] AS model FROM documents)"
)
BLOCKS = f"blocks AS (SELECT doc_id AS book_id, i // 8 AS page_no, i AS block_no, t AS text, (72 + 30 * ((doc_id * 7 + i * 3) % 4))::DOUBLE AS x0, (50 + 14 * (i % 8) + 6 * ((doc_id + i) % 3))::DOUBLE AS y0 FROM lines WHERE {letter('t')})"
SPANS = (
    f"words AS (SELECT doc_id, i, unnest(string_split(t, ' ')) AS w, unnest(range(len(string_split(t, ' ')))) AS k FROM lines WHERE {letter('t')}), "
    "spans AS (SELECT doc_id AS book_id, i // 8 AS page_no, i AS block_no, k // 6 AS line_no, k AS span_no, w || ' ' AS text, 'F' || (k % 3) AS font, (9 + k % 4)::DOUBLE AS size, ((doc_id * 65793 + i * 257) % 16777216) AS color FROM words WHERE i % 17 <> 16), "
    "line_text AS (SELECT book_id, page_no, block_no, line_no, string_agg(text, '' ORDER BY span_no) AS t FROM spans GROUP BY ALL), "
    f"block_text AS (SELECT book_id, page_no, block_no, {trim('string_agg(t, chr(10) ORDER BY line_no)')} AS text FROM line_text GROUP BY ALL)"
)
PAGED_BOOKS = (
    f"pb AS (SELECT source AS book_id, sum(length(text))::BIGINT AS total_chars, sum({words('text')})::BIGINT AS total_words, count(*) AS num_pages, sum(CASE WHEN length(text) > 0 THEN length(text) + 1 ELSE 0 END)::BIGINT AS n FROM documents GROUP BY source), "
    f"panalysis AS (SELECT book_id, total_chars, total_words, num_pages, {scaled('n')} AS estimated_tokens FROM pb)"
)


def fold(parts: str, fits: str, glue: str) -> str:
    """Greedy packing as a reduction over structs; s is the state, p.cur the part."""
    empty = lambda x: f"length({trim(x)}) = 0"
    start = "[{'out': []::VARCHAR[], 'cur': ''}]"
    state = f"list_reduce(list_concat({start}, list_transform({parts}, lambda x: {{'out': []::VARCHAR[], 'cur': x}})), lambda s, p: CASE WHEN NOT ({fits}) AND NOT {empty('s.cur')} THEN {{'out': list_append(s.out, s.cur), 'cur': p.cur}} ELSE {{'out': s.out, 'cur': {glue}}} END)"
    return f"(SELECT CASE WHEN {empty('z.cur')} THEN z.out ELSE list_append(z.out, z.cur) END FROM (SELECT {state} AS z))"


def chunked(source: str) -> str:
    """CTEs from `source` (text_id, text) to chunks (text_id, pos, chunk)."""
    gap = f"(\\n[{SPACE}]*\\n)"
    mark = "chr(1)"
    parts = f"string_split(regexp_replace(text, {q(gap)}, concat({mark}, '\\1', {mark}), 'g'), {mark})"
    first = fold(parts, "length(s.cur) + length(p.cur) <= 2500", "s.cur || p.cur")
    second = fold("string_split(c, chr(10))", "length(s.cur) + length(p.cur) + 1 <= 2500", "CASE WHEN length(s.cur) > 0 THEN s.cur || chr(10) || p.cur ELSE p.cur END")
    return (
        f"c1 AS (SELECT text_id, text, CASE WHEN length(text) <= 2500 THEN [text] ELSE {first} END AS cs FROM {source}), "
        "c2 AS (SELECT text_id, text, unnest(cs) AS c, unnest(range(len(cs))) AS i FROM c1), "
        f"c3 AS (SELECT text_id, text, i, CASE WHEN length(text) <= 2500 OR length(c) * 2 <= 7500 THEN [c] ELSE {second} END AS cs FROM c2), "
        "c4 AS (SELECT text_id, any_value(text) AS text, flatten(list(cs ORDER BY i)) AS cs FROM c3 GROUP BY text_id), "
        "c5 AS (SELECT text_id, text, coalesce(cs, []) AS cs FROM (SELECT text_id, text FROM c1) LEFT JOIN (SELECT text_id, cs FROM c4) USING (text_id)), "
        "c6 AS (SELECT text_id, CASE WHEN len(cs) > 0 THEN cs ELSE [text] END AS cs FROM c5), "
        "chunks AS (SELECT text_id, unnest(cs) AS chunk, unnest(range(len(cs))) AS pos FROM c6)"
    )


CONTEXT = "with_context AS (SELECT *, coalesce(right(lag(chunk) OVER (PARTITION BY text_id ORDER BY pos), 800), '') AS context FROM chunks)"
EVENTS = (
    "ev AS (SELECT event_id, user_id AS job_id, ts, CASE event_type " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in {"signup": "started", "view": "progress", "click": "progress", "purchase": "completed", "error": "error"}.items()) + " END AS kind, value, props FROM events), "
    "je AS (SELECT *, CASE WHEN kind = 'completed' THEN 1.0::DOUBLE WHEN kind = 'progress' THEN least(value / 100, 0.99::DOUBLE) END AS progress FROM ev), "
    "state AS (SELECT job_id, CASE arg_max(kind, (ts, event_id)) WHEN 'started' THEN 'processing' WHEN 'progress' THEN 'processing' WHEN 'completed' THEN 'completed' ELSE 'error' END AS status, "
    "coalesce(arg_max(progress, (ts, event_id)) FILTER (progress IS NOT NULL), 0.0) AS progress, arg_max(props, (ts, event_id)) AS text, count(*) AS logs FROM je GROUP BY job_id)"
)
GROUPS = (
    LINES + ", " + BLOCKS + ", "
    "b2 AS (SELECT *, x0 + 400 AS x1, y0 + 12 AS y1, row_number() OVER (PARTITION BY book_id, page_no ORDER BY y0, x0, block_no) AS k FROM blocks), "
    "walk AS (SELECT book_id, page_no, k, 0::BIGINT AS gid, x0, y0, x1, y1, text FROM b2 WHERE k = 1 UNION ALL "
    "SELECT b.book_id, b.page_no, b.k, CASE WHEN n THEN w.gid ELSE w.gid + 1 END, CASE WHEN n THEN least(w.x0, b.x0) ELSE b.x0 END, CASE WHEN n THEN least(w.y0, b.y0) ELSE b.y0 END, CASE WHEN n THEN greatest(w.x1, b.x1) ELSE b.x1 END, CASE WHEN n THEN greatest(w.y1, b.y1) ELSE b.y1 END, b.text "
    "FROM walk w JOIN b2 b ON b.book_id = w.book_id AND b.page_no = w.page_no AND b.k = w.k + 1, LATERAL (SELECT abs(b.x0 - w.x0) < 50 AND abs(b.x1 - w.x1) < 50 AND b.y0 - w.y1 < 5 AS n)), "
    "groups AS (SELECT book_id, page_no, gid, count(*) AS n_blocks, string_agg(text, chr(10) ORDER BY k) AS text, min(x0) FILTER (true) AS x0, max(k) AS last FROM walk GROUP BY book_id, page_no, gid), "
    "boxes AS (SELECT g.book_id, g.page_no, g.gid, g.n_blocks, g.text, w.x0, w.y0, w.x1, w.y1 FROM groups g JOIN walk w ON w.book_id = g.book_id AND w.page_no = g.page_no AND w.k = g.last)"
)
CHAIN = (
    "u AS (SELECT conv_id AS seq_key, turn AS pos, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations), "
    f"chain AS (SELECT seq_key, pos, k, {trim('''concat('[', right(md5(''), 4), '] ', text)''')} AS translated FROM u WHERE k = 1 UNION ALL "
    f"SELECT u.seq_key, u.pos, u.k, {trim('''concat('[', right(md5(right(c.translated, 800)), 4), '] ', u.text)''')} FROM chain c JOIN u ON u.seq_key = c.seq_key AND u.k = c.k + 1)"
)
FAILING = (
    "u AS (SELECT conv_id AS seq_key, turn AS pos, text, turn % 7 = 3 AS bad, (turn % 7) || '|' || text AS source, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations), "
    f"chain AS (SELECT seq_key, pos, k, bad, source, {trim('''concat('[', right(md5(''), 4), '] ', text)''')} AS translated, CASE WHEN bad THEN '' ELSE {trim('''concat('[', right(md5(''), 4), '] ', text)''')} END AS ctx FROM u WHERE k = 1 UNION ALL "
    f"SELECT u.seq_key, u.pos, u.k, u.bad, u.source, {trim('''concat('[', right(md5(right(c.ctx, 800)), 4), '] ', u.text)''')}, CASE WHEN u.bad THEN c.ctx ELSE {trim('''concat('[', right(md5(right(c.ctx, 800)), 4), '] ', u.text)''')} END FROM chain c JOIN u ON u.seq_key = c.seq_key AND u.k = c.k + 1)"
)
#: The tree rule as a walk over tokens with a stack of open elements: an end tag closes up to the nearest open one of its name, or nothing; the end closes all. A script or style is one token.
TOKEN = "(?is)<!--.*?-->|<![a-z][^>]*>|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|</?[a-z][^>]*>|[^<]+|<"
among = lambda tags: "[" + ", ".join(map(q, tags)) + "]"
TREE = (
    f"t AS (SELECT page_id, unnest(regexp_extract_all(html, {q(TOKEN)})) AS tok, unnest(range(len(regexp_extract_all(html, {q(TOKEN)})))) AS i FROM pages), "
    f"k AS (SELECT *, lower(regexp_extract(tok, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, CASE WHEN NOT regexp_matches(tok, '^</?[a-zA-Z]') THEN 'text' WHEN starts_with(tok, '</') THEN 'end' "
    f"WHEN regexp_matches(tok, '(?is)^<(script|style)\\b.*</') OR ends_with(tok, '/>') OR contains({among(H.VOID)}, tag) THEN 'whole' ELSE 'start' END AS kind FROM t), "
    "p AS (SELECT *, sum(length(tok)) OVER (PARTITION BY page_id ORDER BY i)::BIGINT AS upto FROM k), "
    "walk AS (SELECT page_id, -1::BIGINT AS i, []::VARCHAR[] AS tags, []::BIGINT[] AS ids, []::BIGINT[] AS closed, 0::BIGINT AS clock FROM pages UNION ALL "
    "SELECT p.page_id, p.i, CASE WHEN kind = 'start' THEN list_append(tags, tag) WHEN spot > 0 THEN tags[:spot - 1] ELSE tags END, CASE WHEN kind = 'start' THEN list_append(ids, p.i) WHEN spot > 0 THEN ids[:spot - 1] ELSE ids END, "
    "CASE WHEN spot > 0 THEN list_reverse(ids[spot:]) ELSE []::BIGINT[] END, clock + CASE WHEN kind = 'start' THEN 1 WHEN kind = 'whole' THEN 2 WHEN spot > 0 THEN len(ids) - spot + 1 ELSE 0 END "
    "FROM walk w JOIN p ON p.page_id = w.page_id AND p.i = w.i + 1, LATERAL (SELECT CASE WHEN kind = 'end' AND contains(tags, tag) THEN len(tags) + 1 - list_position(list_reverse(tags), tag) ELSE 0 END AS spot)), "
    "ended AS (SELECT page_id, max(i) AS i FROM walk GROUP BY page_id), "
    "shut AS (SELECT w.page_id, unnest(closed) AS first, clock - len(closed) + unnest(range(1, len(closed) + 1)) AS post, upto - length(tok) AS e FROM walk w JOIN p ON p.page_id = w.page_id AND p.i = w.i WHERE len(closed) > 0 UNION ALL "
    "SELECT page_id, unnest(list_reverse(ids)), clock + unnest(range(1, len(ids) + 1)), length(html) FROM walk JOIN ended USING (page_id, i) JOIN pages USING (page_id)), "
    "born AS (SELECT w.page_id, w.i AS first, w.clock AS pre, p.upto AS b, p.tag, p.kind, w.tags, CASE kind WHEN 'start' THEN ids[len(ids) - 1] ELSE ids[len(ids)] END AS parent FROM walk w JOIN p ON p.page_id = w.page_id AND p.i = w.i WHERE kind IN ('start', 'whole')), "
    f"mixed AS (SELECT DISTINCT page_id, parent AS first FROM born WHERE NOT contains({among(H.INLINE + H.SKIP)}, tag) AND parent IS NOT NULL), "
    f"cand AS (SELECT n.*, s.post, s.e, substr(html, n.b + 1, s.e - n.b) AS inner_html FROM born n JOIN shut s USING (page_id, first) JOIN pages USING (page_id) ANTI JOIN mixed USING (page_id, first) WHERE contains({among(H.BLOCK)}, n.tag) AND NOT list_has_any(n.tags, {among(H.SKIP)}) AND {letter('substr(html, n.b + 1, s.e - n.b)')}), "
    "blk AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pre) - 1 AS block_no FROM cand), "
    "holds AS (SELECT DISTINCT x.page_id, x.pre FROM blk x JOIN blk y ON y.page_id = x.page_id AND y.pre > x.pre AND y.post < x.post), "
    "leaf AS (SELECT * FROM blk ANTI JOIN holds USING (page_id, pre))"
)


#: Text nodes of the tree with the elements they stand in; a page's text; its first heading.
NODES = TREE + f", node AS (SELECT page_id, i, {trim(unescape('tok'))} AS x, tags, ids FROM walk JOIN p USING (page_id, i) WHERE kind = 'text' AND NOT regexp_matches(tok, '(?is)^<[!?].*>$'))"


def shown(skip: tuple[str, ...] = H.SKIP) -> str:
    """shown (page_id, text, n): nodes outside `skip` joined by a space, and how many hold a letter."""
    own = f"x <> '' AND NOT list_has_any(tags, {among(skip)})"
    return f"shown AS (SELECT page_id, coalesce(string_agg(x, ' ' ORDER BY i) FILTER ({own}), '') AS text, count(x) FILTER ({own} AND {letter('x')}) AS n FROM pages LEFT JOIN node USING (page_id) GROUP BY page_id)"


HEADS = (
    "top AS (SELECT page_id, min(first) AS first FROM born WHERE tag IN ('h1', 'h2', 'h3') AND kind = 'start' GROUP BY page_id), "
    "head AS (SELECT page_id, nullif(left(coalesce(string_agg(x, '' ORDER BY i), ''), 80), '') AS title FROM top LEFT JOIN node USING (page_id) WHERE contains(ids, first) GROUP BY page_id)"
)
BOOKS = (
    f"{NODES}, {shown()}, {HEADS}, {CHAPTERS}, titled AS (SELECT book_id, doc_idx, text, coalesce(title, name) AS title FROM chapters JOIN shown USING (page_id) LEFT JOIN head USING (page_id)), "
    f"counted AS (SELECT *, length({trim('text')}) > 10 AS ok FROM titled), "
    f"books AS (SELECT book_id, coalesce(sum(length(text)) FILTER (ok), 0)::BIGINT AS total_chars, coalesce(sum({words('text')}) FILTER (ok), 0)::BIGINT AS total_words, count(*) FILTER (ok) AS num_chapters, "
    "coalesce(list_slice(list(title ORDER BY doc_idx) FILTER (ok), 1, 30), []) AS chapter_names FROM counted GROUP BY book_id), "
    f"analysis AS (SELECT *, {scaled('(total_chars + num_chapters)')} AS estimated_tokens FROM books)"
)


#: References as HTML reads them: a known name ends with a semicolon, an old one also without, and then the longest that the text begins with counts. Names of the given pages are looked up first.
CHARACTERS = "MAP {" + ", ".join(f"{q('&' + k)}: {q(v)}" for k, v in html5.items()) + "}"
PIECE = "(?s)&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)|[^&]+|&"
OLD = "^&(?:" + "|".join(sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True)) + ")"
ODD = "MAP {0: chr(65533), 13: chr(13), " + ", ".join(f"{c}: {q(bytes([c]).decode('cp1252', 'ignore') or chr(c))}" for c in range(128, 160)) + "}"


def decoded(x: str) -> str:
    code = "CASE WHEN regexp_matches(p, '^&#[xX]') THEN coalesce(try_cast('0x' || regexp_extract(p, '^&#[xX]([0-9a-fA-F]+)', 1) AS BIGINT), 1114112) ELSE coalesce(try_cast(regexp_extract(p, '^&#([0-9]+)', 1) AS BIGINT), 1114112) END"
    silent = "c BETWEEN 1 AND 8 OR c = 11 OR c BETWEEN 14 AND 31 OR c = 127 OR c BETWEEN 64976 AND 65007 OR c % 65536 >= 65534"
    number = f"list_transform([{code}], lambda c: CASE WHEN c IN (0, 13) OR c BETWEEN 128 AND 159 THEN {ODD}[c] WHEN c BETWEEN 55296 AND 57343 OR c > 1114111 THEN chr(65533) WHEN {silent} THEN '' ELSE chr(c::INTEGER) END)[1]"
    given = " ".join(f"WHEN {q(f'&{name};')} THEN {q(char)}" for name, char in NAMED.items())
    name = f"CASE p WHEN '&' THEN p {given} ELSE coalesce({CHARACTERS}[p], {CHARACTERS}[regexp_extract(p, {q(OLD)})] || substr(p, length(regexp_extract(p, {q(OLD)})) + 1), p) END"
    return f"array_to_string(list_transform(regexp_extract_all({x}, {q(PIECE)}), lambda p: CASE WHEN NOT starts_with(p, '&') THEN p WHEN regexp_matches(p, '^&#[xX]?[0-9a-fA-F]') AND regexp_matches(p, '^&#([0-9]|[xX])') THEN {number} ELSE {name} END), '')"


def bare(x: str) -> str:
    return decoded(f"regexp_replace({x}, '<[^>]*>', '', 'g')")


PAGE_CHAIN = (
    "lu AS (SELECT page_id, b, e, inner_html, row_number() OVER (PARTITION BY page_id ORDER BY block_no) AS k FROM leaf), "
    f"lc AS (SELECT page_id, k, b, e, {trim('''concat('[', right(md5(''), 4), '] ', inner_html)''')} AS tr FROM lu WHERE k = 1 UNION ALL "
    f"SELECT u.page_id, u.k, u.b, u.e, {trim(f"""concat('[', right(md5({bare('right(c.tr, 800)')}), 4), '] ', u.inner_html)""")} FROM lc c JOIN lu u ON u.page_id = c.page_id AND u.k = c.k + 1), "
    "lp AS (SELECT page_id, k, e, substr(html, coalesce(lag(e) OVER w, 0)::BIGINT + 1, (b - coalesce(lag(e) OVER w, 0))::BIGINT) || tr AS part FROM lc JOIN pages USING (page_id) WINDOW w AS (PARTITION BY page_id ORDER BY k))"
)
PROMPT_MODEL = f"[{', '.join(q(m[0]) for m in catalog.MODELS)}][(text_id % {len(catalog.MODELS)}) + 1]"

ORACLE: dict[str, str] = {
    "src_chapters": f"WITH {CHAPTERS} SELECT book_id, doc_idx, name, length(html) AS n FROM chapters",
    "src_pages": f"WITH {PAGED} SELECT book_id, page_no, text FROM paged",
    "html_text": f"WITH RECURSIVE {NODES}, {shown()} SELECT page_id, text FROM shown",
    "chapter_names": f"WITH RECURSIVE {NODES}, {HEADS}, {CHAPTERS} SELECT book_id, doc_idx, coalesce(title, name) AS title FROM chapters LEFT JOIN head USING (page_id)",
    "chapter_gate": f"WITH RECURSIVE {NODES}, {shown()} SELECT page_id, {letter('left(text, 1000)')} AS translated FROM shown",
    "word_char_counts": f"SELECT doc_id, length(text) AS chars, {words('text')} AS words FROM documents",
    "token_estimate": f"SELECT doc_id, ({tokens('length(text)')})::BIGINT AS tokens FROM documents",
    "token_estimate_scaled": f"WITH b AS (SELECT source AS book_id, sum(length(text) + 1)::BIGINT AS n FROM documents WHERE length(text) > 0 GROUP BY source) SELECT book_id, {scaled('n')} AS tokens FROM b",
    "filter_translatable": f"WITH {LINES} SELECT doc_id, count(*) AS lines, sum(length(t))::BIGINT AS chars FROM lines WHERE {letter('t')} GROUP BY doc_id",
    "filter_sendable": f"WITH w AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents) SELECT doc_id, sum(({sendable('w')})::INT)::BIGINT AS sendable, sum(({letter('w')})::INT)::BIGINT AS translatable, count(*) AS words FROM w GROUP BY doc_id",
    "file_allowlist": f"WITH {MANIFEST}, e AS (SELECT job_id, CASE WHEN contains(original_filename, '.') THEN lower(regexp_extract(original_filename, '([^.]*)$', 1)) ELSE '' END AS ext FROM manifest) SELECT job_id, ext, ext IN ('epub', 'pdf') AS allowed FROM e",
    "output_naming": f"WITH {MANIFEST}, e AS (SELECT *, regexp_extract(original_filename, '^\\.*[^.].*(\\.[^.]*)$', 1) AS ext FROM manifest) SELECT job_id, left(original_filename, length(original_filename) - length(ext)) || '_tradotto_' || target_lang || ext AS output, lower(left(target_lang, 2)) AS code FROM e",
    "model_catalog": f"WITH {MODELS}, {MANIFEST} SELECT m.*, count(*) AS jobs, sum(length)::BIGINT AS chars, m.model = 'gpt-4o' AS is_default FROM models m JOIN manifest j ON j.model = m.model WHERE m.provider = 'openai' GROUP BY ALL",
    "job_validation": f"""WITH {MODELS}, {MANIFEST}, j AS (SELECT j.*, m.provider AS own, CASE WHEN contains(original_filename, '.') THEN lower(regexp_extract(original_filename, '([^.]*)$', 1)) ELSE '' END AS ext FROM manifest j LEFT JOIN models m ON m.model = j.model)
SELECT job_id, original_filename, ext, source_lang, target_lang, model, coalesce(own, provider) AS provider,
  CASE WHEN original_filename = '' THEN 'no file name' WHEN ext NOT IN ('epub', 'pdf') THEN 'bad extension' WHEN length > 104857600 THEN 'too large' WHEN source_lang = target_lang THEN 'same language'
    WHEN own IS NULL THEN 'unknown model' WHEN own <> 'openai' THEN 'provider not available' END AS error FROM j""",
    "analyze_books": f"WITH RECURSIVE {BOOKS} SELECT * FROM analysis",
    "analyze_paged": f"WITH {PAGED_BOOKS} SELECT * FROM panalysis",
    "analyze_all": f"WITH RECURSIVE {BOOKS}, {PAGED_BOOKS} SELECT book_id, 'epub' AS file_type, total_chars, total_words, num_chapters, NULL::BIGINT AS num_pages, chapter_names, estimated_tokens FROM analysis UNION ALL SELECT book_id, 'pdf', total_chars, total_words, NULL, num_pages, NULL, estimated_tokens FROM panalysis",
    "analysis_json": f"WITH RECURSIVE {BOOKS} SELECT book_id, total_chars, total_words, num_chapters, estimated_tokens, chapter_names[1] AS first_name FROM analysis",
    "cost_by_model": f"WITH RECURSIVE {BOOKS}, {MODELS}, costs AS (SELECT book_id, model, estimated_tokens / 1e6 * input_cost AS input_usd, estimated_tokens / 1e6 * 1.0::DOUBLE * output_cost AS output_usd FROM analysis, models) SELECT *, input_usd + output_usd AS total_usd FROM costs",
    "chunk_paragraphs": f"WITH {LONG}, everything AS (SELECT 'c' || text_id AS text_id, text FROM texts UNION ALL SELECT 'd' || doc_id, text FROM documents), {chunked('everything')} SELECT text_id, pos, chunk FROM chunks",
    "chunk_context": f"WITH {LONG}, {chunked('texts')}, {CONTEXT} SELECT text_id, pos, length(chunk) AS n, context FROM with_context",
    "reassemble_text": f"WITH {LONG}, {chunked('texts')} SELECT text_id, string_agg(chunk, chr(10) ORDER BY pos) AS text FROM chunks GROUP BY text_id",
    "layout_block_text": f"WITH {LINES}, {SPANS}, n AS (SELECT book_id, page_no, block_no, count(*) FILTER ({letter('text')}) AS n FROM spans GROUP BY ALL) SELECT book_id, page_no, block_no, text, n AS n_spans FROM block_text JOIN n USING (book_id, page_no, block_no) WHERE {letter('text')}",
    "layout_groups": f"WITH RECURSIVE {GROUPS} SELECT * FROM boxes",
    "layout_style": f"WITH {LINES}, {SPANS}, s AS (SELECT * FROM spans WHERE {letter('text')}), f AS (SELECT book_id, page_no, block_no, arg_max({{'font': font, 'size': size}}, (length(text), -span_no)) AS f, arg_min(color, span_no) AS c FROM s GROUP BY ALL) SELECT book_id, page_no, block_no, coalesce(f.font, 'helv') AS font, coalesce(f.size, 11.0) AS size, ((coalesce(c, 0)::BIGINT >> 16) & 255) / 255.0::DOUBLE AS r, ((coalesce(c, 0)::BIGINT >> 8) & 255) / 255.0::DOUBLE AS g, (coalesce(c, 0)::BIGINT & 255) / 255.0::DOUBLE AS b FROM block_text LEFT JOIN f USING (book_id, page_no, block_no) WHERE {letter('text')}",
    "layout_group_style": f"WITH RECURSIVE {GROUPS}, {SPANS.replace('block_text AS', 'unused AS')}, member AS (SELECT w.book_id, w.page_no, w.gid, b.block_no, b.k FROM walk w JOIN b2 b ON b.book_id = w.book_id AND b.page_no = w.page_no AND b.k = w.k), "
    f"s AS (SELECT m.book_id, m.page_no, m.gid, m.k, s.span_no, s.text, s.font, s.size, s.color FROM member m JOIN spans s ON s.book_id = m.book_id AND s.page_no = m.page_no AND s.block_no = m.block_no WHERE {letter('s.text')}), "
    "f AS (SELECT book_id, page_no, gid, arg_max({'font': font, 'size': size}, (length(text), -k, -span_no)) AS f, arg_min(color, (k, span_no)) AS c FROM s GROUP BY ALL) "
    "SELECT x.book_id, x.page_no, x.gid, coalesce(f.font, 'helv') AS font, coalesce(f.size, 11.0) AS size, ((coalesce(c, 0)::BIGINT >> 16) & 255) / 255.0::DOUBLE AS r, ((coalesce(c, 0)::BIGINT >> 8) & 255) / 255.0::DOUBLE AS g, (coalesce(c, 0)::BIGINT & 255) / 255.0::DOUBLE AS b FROM boxes x LEFT JOIN f ON f.book_id = x.book_id AND f.page_no = x.page_no AND f.gid = x.gid",
    "html_blocks": f"WITH RECURSIVE {TREE} SELECT page_id, block_no, tag, pre, post, inner_html FROM blk",
    "html_leaf_blocks": f"WITH RECURSIVE {TREE} SELECT page_id, block_no, tag, inner_html FROM leaf",
    "reassemble_html": f"WITH RECURSIVE {TREE}, {PAGE_CHAIN} SELECT page_id, coalesce(any_value(x.body) || substr(any_value(html), any_value(x.tail)::BIGINT + 1), any_value(html)) AS html FROM pages LEFT JOIN (SELECT page_id, string_agg(part, '' ORDER BY k) AS body, max(e) AS tail FROM lp GROUP BY page_id) x USING (page_id) GROUP BY page_id",
    "prompt_requests": f"""WITH {LONG}, {chunked('texts')}, {CONTEXT}, {MODELS}, r AS (SELECT text_id, pos, chunk AS text, context, CASE WHEN text_id % 2 = 0 THEN 'Italian' ELSE 'French' END AS target_lang, {PROMPT_MODEL} AS model FROM with_context WHERE {sendable('chunk')}),
u AS (SELECT *, CASE WHEN length(context) > 0 THEN replace({q(translate.BEFORE)}, '{{context}}', right(context, 800)) || chr(10) || chr(10) || text ELSE text END AS message FROM r)
SELECT text_id, pos, u.model, m.provider, md5(replace(replace({q(translate.SYSTEM)}, '{{source}}', 'English'), '{{target}}', target_lang)) AS system_md5, md5(message) AS user_md5, length(message) AS user_chars, 0.3::DOUBLE AS temperature,
  CASE WHEN m.provider = 'openai' AND u.model IN ({', '.join(map(q, catalog.COMPLETION_CAP))}) THEN 'max_completion_tokens' ELSE 'max_tokens' END AS token_param, 8192::BIGINT AS max_out FROM u JOIN models m ON m.model = u.model""",
    "response_clean": f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN {trim('''concat(' ', chr(10), text, chr(9), ' ')''')} WHEN doc_id % 5 = 2 THEN '' WHEN doc_id % 5 = 3 THEN {trim('text')} ELSE text END AS translated FROM documents",
    "translate_units": f"WITH RECURSIVE {CHAIN} SELECT seq_key, pos, translated FROM chain",
    "translate_attempts": "SELECT conv_id AS seq_key, turn AS pos, least(turn % 4 + 1, 3) AS attempts, (2 ** (least(turn % 4 + 1, 3) - 1) - 1)::BIGINT AS waited, CASE WHEN turn % 4 = 3 THEN 'failed' ELSE 'ok' END AS outcome FROM conversations",
    "failure_fallback": f"WITH RECURSIVE {FAILING}, n AS (SELECT *, sum(bad::INT) OVER (PARTITION BY seq_key)::BIGINT AS n_failed FROM chain) SELECT seq_key, pos, n_failed, CASE WHEN n_failed > 0 THEN source ELSE translated END AS as_chapter, CASE WHEN bad THEN source ELSE translated END AS as_group FROM n",
    "lang_sample": f"WITH RECURSIVE {NODES}, {shown(H.SAMPLE_SKIP)}, {CHAPTERS}, {PAGED}, early AS (SELECT book_id, doc_idx, text FROM chapters JOIN shown USING (page_id) WHERE doc_idx < 3), f AS (SELECT book_id, left(arg_min(text, doc_idx), 1000) AS sample, 'epub' AS file_type FROM early WHERE length(text) > 50 GROUP BY book_id UNION ALL SELECT book_id::VARCHAR, left(text, 1000), 'pdf' FROM paged WHERE page_no = 0) SELECT * FROM f WHERE length({trim('sample')}) >= 20",
    "detect_requests": f"""WITH {PAGED}, {MANIFEST}, s AS (SELECT book_id AS job_id, left(text, 1000) AS sample FROM paged WHERE page_no = 0 AND length({trim('left(text, 1000)')}) >= 20),
r AS (SELECT job_id, sample, CASE WHEN job_id % 3 = 0 THEN 'openai' ELSE provider END AS provider, CASE WHEN job_id % 4 = 0 THEN model ELSE '' END AS model FROM s JOIN manifest USING (job_id))
SELECT job_id, provider, coalesce(nullif(model, ''), CASE WHEN provider = 'anthropic' THEN {q(catalog.DETECTION['anthropic'])} ELSE {q(catalog.DETECTION['openai'])} END) AS model, md5({q(language.ASK)} || sample) AS prompt_md5 FROM r""",
    "lang_answer_clean": f"WITH {MANIFEST} SELECT job_id AS doc_id, CASE WHEN job_id % 4 = 3 THEN 'Unknown' ELSE source_lang END AS language FROM manifest",
    "lang_function_words": "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS w FROM documents), p(code, w) AS (VALUES "
    + ", ".join(f"({q(c)}, {q(w)})" for c, own in language.PROFILE.items() for w in own)
    + "), n AS (SELECT doc_id, code, count(*) AS n FROM w JOIN p USING (w) GROUP BY ALL), b AS (SELECT doc_id, arg_max(code, (n, code)) AS language FROM n GROUP BY doc_id) SELECT d.doc_id, coalesce(language, 'Unknown') AS language FROM documents d LEFT JOIN b USING (doc_id)",
    "progress_chapters": f"""WITH RECURSIVE {NODES}, {shown()}, {CHAPTERS}, c AS (SELECT book_id, doc_idx, CASE WHEN doc_idx % 5 = 4 THEN 0 ELSE n END AS n, count(*) OVER (PARTITION BY book_id)::DOUBLE AS d FROM chapters JOIN shown USING (page_id)),
u AS (SELECT *, unnest(CASE WHEN n = 0 THEN [NULL] ELSE range(n) END) AS block_no FROM c)
SELECT book_id, doc_idx, block_no, round(CASE WHEN block_no IS NULL THEN (doc_idx + 1) / d ELSE least(doc_idx / d + (block_no + 1) / n / d, 0.99::DOUBLE) END, 9) AS progress FROM u""",
    "progress_pages": f"WITH RECURSIVE {GROUPS}, tot AS (SELECT doc_id AS book_id, count(DISTINCT i // 8)::DOUBLE AS p FROM lines GROUP BY doc_id), n AS (SELECT book_id, page_no, gid, count(*) OVER (PARTITION BY book_id, page_no) AS n FROM boxes) SELECT book_id, page_no, gid, round(page_no / p, 9) AS started, round(page_no / p + 0.3::DOUBLE / p, 9) AS grouped, round(least((page_no + (gid + 1) / n) / p, 0.99::DOUBLE), 9) AS progress FROM n JOIN tot USING (book_id)",
    "job_status": f"WITH {EVENTS} SELECT * FROM state",
    "job_lookup": f"WITH {EVENTS} SELECT d.doc_id AS job_id, (CASE WHEN status IS NULL THEN 404 WHEN status <> 'completed' THEN 400 ELSE 200 END)::BIGINT AS code FROM documents d LEFT JOIN state ON state.job_id = d.doc_id",
    "job_status_stream": f"WITH {EVENTS} SELECT * FROM state",
    "job_state_ttl": """WITH g AS (SELECT user_id AS job_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY job_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT job_id, epoch_us(min(ts)) AS first_ts, epoch_us(max(ts)) AS last_ts, count(*) AS events FROM s GROUP BY job_id, k""",
    "job_eviction_stream": """WITH g AS (SELECT user_id AS job_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY job_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT job_id, epoch_us(min(ts)) AS first_ts, epoch_us(max(ts)) AS last_ts, count(*) AS events FROM s GROUP BY job_id, k
HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    "job_download": f"WITH {EVENTS} SELECT d.doc_id AS job_id, (CASE WHEN status IS NULL THEN 404 WHEN status <> 'completed' THEN 400 WHEN d.doc_id % 11 = 0 THEN 404 ELSE 200 END)::BIGINT AS code FROM documents d LEFT JOIN state ON state.job_id = d.doc_id",
    "upload_stream": f"""WITH {MODELS}, {MANIFEST}, j AS (SELECT j.*, d.text, m.provider AS own, CASE WHEN contains(original_filename, '.') THEN lower(regexp_extract(original_filename, '([^.]*)$', 1)) ELSE '' END AS ext FROM manifest j JOIN documents d ON d.doc_id = j.job_id LEFT JOIN models m ON m.model = j.model),
e AS (SELECT *, CASE WHEN original_filename = '' THEN 'no file name' WHEN ext NOT IN ('epub', 'pdf') THEN 'bad extension' WHEN length > 104857600 THEN 'too large' WHEN source_lang = target_lang THEN 'same language'
  WHEN own IS NULL THEN 'unknown model' WHEN own <> 'openai' THEN 'provider not available' END AS error FROM j)
SELECT job_id, ext, coalesce(own, provider) AS provider, error, CASE WHEN error IS NULL THEN coalesce(length(text), 0) END AS chars, CASE WHEN error IS NULL THEN {words('text')} END AS words, CASE WHEN error IS NULL THEN ({tokens('length(text)')})::BIGINT END AS tokens FROM e""",
    "publish_books": f"WITH {CHAPTERS} SELECT book_id, doc_idx, name, ['it', 'en', 'sp'][length(book_id) % 3 + 1] AS language, md5(html) AS html_md5 FROM chapters",
    "ingest_stream": f"SELECT doc_id, {letter('text')} AS translatable, ({tokens('length(text)')})::BIGINT AS tokens FROM documents",
    "read_epub_chapters": "SELECT 'book-' || (page_id // 8) || '.epub' AS path, row_number() OVER (PARTITION BY page_id // 8 ORDER BY page_id DESC) - 1 AS doc_idx, 'page%20' || page_id || '.xhtml' AS name, md5(html) AS html_md5 FROM pages",
}
