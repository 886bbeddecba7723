"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from waymark.operators import markdown as md
from waymark.operators.cells import CALIBRATION, CENTROID_DECIMALS, MAX_CELLS, ROUNDS, ROWS_PER_CELL, SAMPLE_BYTES, SAMPLE_ROWS, TARGET
from waymark.operators.html import BLOCKS, CONTAINERS, HEADINGS, LISTS, TOKEN
from workload.languages import LANGUAGES, LONG_BYTES, LONG_EVERY, NESTED, UNSAFE
from workload.tables import EXTENSIONS, MARKDOWN_STEPS

NL = "chr(10)"
BLANKS = "(' ' || chr(9) || chr(13) || chr(10))"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def names(values: list[str]) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


# --- corpora as common table expressions: path, content, mtime -----------------------------

DOC_PATH = "'/' || source || '/' || lang || '/doc_' || doc_id || '.prose'"
DOCS = f"SELECT {DOC_PATH} AS path, text AS content, 1700000000 + doc_id AS mtime FROM documents"
SPACED = (
    f"SELECT {DOC_PATH} AS path, replace(text, {NL}, {NL} || {NL}) AS content, "
    "1700000000 + doc_id AS mtime FROM documents"
)
CHANGED = f"""
  SELECT '/' || CASE WHEN doc_id % 13 = 0 THEN 'old' ELSE source END || '/' || lang || '/doc_'
         || doc_id || '.prose' AS path,
         CASE WHEN doc_id % 10 = 0 THEN text || ' edited' ELSE text END AS content,
         1700000000 + doc_id AS mtime
  FROM documents WHERE doc_id % 17 <> 0"""
PAGES = "SELECT '/page_' || page_id || '.html' AS path, html AS content FROM pages"


def _markdown() -> str:
    value = "html"
    for pattern, replacement in MARKDOWN_STEPS:
        made = text(replacement).replace("\n", f"' || {NL} || '")
        value = f"regexp_replace({value}, {text(pattern)}, {made}, 'g')"
    return f"SELECT '/page_' || page_id || '.md' AS path, {value} AS content FROM pages"


_QUOTED = r"""replace(replace(x, '\', '\\'), '"', '\"')"""
SOURCES = f"""
  SELECT '/src/doc_' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.rs' ELSE '.py' END AS path,
    doc_id, string_split(text, {NL}) AS l,
    CASE WHEN doc_id % 2 = 0 THEN
      list_transform(string_split(text, {NL}), lambda x, i:
        '    /// ' || x || {NL} || '    pub fn f' || (i - 1) || '(x: &str) -> usize {{' || {NL}
        || '        let s = "' || {_QUOTED} || ' }} {{";' || {NL} || '        if x.len() > ' || (i - 1)
        || ' {{ return ''{{''.len(); }}' || {NL} || '        0' || {NL} || '    }}')
    ELSE
      list_transform(string_split(text, {NL}), lambda x, i:
        '# ' || x || {NL} || 'def f' || (i - 1) || '(a,' || {NL} || '  b="' || {_QUOTED} || '"):'
        || {NL} || '    \"\"\"' || {NL} || 'def fake(): ' || replace(x, '"', '') || {NL}
        || '    \"\"\"' || {NL} || '    return a')
    END AS functions
  FROM documents""".replace('\\"\\"\\"', '"""')
# The whole file: every function, a newline after it and a blank line between.
_BODY = f"array_to_string(list_transform(functions, lambda f: f || {NL} || {NL}), '')"
SOURCE_TEXT = (
    f"CASE WHEN doc_id % 2 = 0 THEN 'impl D {{' || {NL} || {_BODY} || '}}' || {NL} ELSE {_BODY} END"
)


def prose(corpus: str, prefix: str = "") -> str:
    """CTEs ending in `{prefix}units`: the chunk table of a prose corpus."""
    p = prefix
    return f"""
{p}corpus AS ({corpus}),
{p}raw AS (SELECT *, string_split(content, {NL}) AS l FROM {p}corpus
        WHERE strlen(content) > 0),
{p}lines AS (SELECT path, i AS n, l[i] AS piece, NOT regexp_matches(l[i], '^\\s*$') AS solid
          FROM {p}raw, unnest(range(1, len(l) + 1)) AS u(i)),
{p}islands AS (
  SELECT *, sum(CASE WHEN solid THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY n) AS gap
  FROM {p}lines),
{p}blocks AS (
  SELECT path, min(n) AS start_line, max(n) AS end_line,
         trim(string_agg(piece, {NL} ORDER BY n), {BLANKS}) AS content
  FROM {p}islands WHERE solid GROUP BY path, gap),
{p}units AS (
  SELECT md5(concat_ws(':', b.path, start_line - 1, end_line - 1, md5(c.content), md5(b.content))) AS id,
         b.path, 'paragraph' AS kind, start_line, end_line, md5(c.content) AS file_hash,
         md5(b.content) AS chunk_hash, c.mtime, b.content
  FROM {p}blocks b JOIN {p}corpus c USING (path))"""


FILE_NAME = """CASE doc_id % 5 WHEN 1 THEN 'plain/_' WHEN 2 THEN '.git/' WHEN 3 THEN '_x/y/' ELSE 'plain/' END
    || 'doc_' || doc_id || '.md'"""
LONG = f"""
  SELECT {DOC_PATH} AS path, CASE WHEN doc_id % {LONG_EVERY} = 0 THEN repeat(text || {NL} || {NL},
         floor({LONG_BYTES} / (length(text) + 2))::INT + 1) ELSE text END AS content, 1700000000 + doc_id AS mtime FROM documents"""


def _language_units(languages: dict) -> str:
    parts = []
    for n, (extension, (template, units)) in enumerate(languages.items()):
        made = text(template).replace("\n", f"' || {NL} || '").replace("§", "' || q || '").replace("¤", "' || (i - 1) || '")
        height = template.count("\n")
        for kind, first, last, lead in units:
            parts.append(f"""
SELECT '/src/doc_' || doc_id || '.{extension}' AS path, '{kind}' AS kind, {height} * (i - 1) + {first} AS start_line,
  {height} * (i - 1) + {last} AS end_line, md5(trim(array_to_string(string_split({made}, {NL})[{lead}:{last}], {NL}), {BLANKS})) AS chunk_hash
FROM pieces WHERE doc_id % {len(languages)} = {n}""")
    unsafe = text(UNSAFE.replace("\r", "")) + " || chr(13)"
    return f"""
WITH lines AS (SELECT doc_id, string_split(text, {NL}) AS l FROM documents),
pieces AS (SELECT doc_id, i, translate(l[i], {unsafe}, '') AS q FROM lines, unnest(range(1, len(l) + 1)) AS u(i))
{" UNION ALL ".join(parts)}"""


LOCAL_INDEX = f"WITH {prose(DOCS, 'l_')}, {prose(CHANGED, 'i_')}"


# --- pages -------------------------------------------------------------------------------

_TAG = "lower(regexp_extract(piece, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1))"
PAGE_BLOCKS = f"""
corpus AS ({PAGES}),
pieces AS (SELECT path, i AS n, t[i] AS piece
  FROM (SELECT path, regexp_extract_all(content, {text(TOKEN)}) AS t FROM corpus),
       unnest(range(1, len(t) + 1)) AS u(i)),
tags AS (SELECT *, {_TAG} AS tag, starts_with(piece, '</') AS closes,
    starts_with(piece, '<!--') AS comment, trim(piece, {BLANKS}) = '' AS blank,
    length(piece) - length(replace(piece, {NL}, '')) AS newlines FROM pieces),
placed AS (SELECT *,
    (1 + sum(newlines) OVER w)::BIGINT AS last_line, (1 + sum(newlines) OVER w)::BIGINT - newlines AS first_line,
    sum(CASE WHEN tag IN {names(LISTS)} THEN CASE WHEN closes THEN -1 ELSE 1 END ELSE 0 END)
      OVER w AS s
  FROM tags WINDOW w AS (PARTITION BY path ORDER BY n)),
deep AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY path ORDER BY n)) AS depth FROM placed),
stepped AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY path ORDER BY n), 0) AS above FROM deep),
marked AS (SELECT *,
    above = 0 AND (depth = 1 OR (NOT closes AND tag IN {names(BLOCKS)})) AS opens,
    above = 0 AND tag IN {names(CONTAINERS)} AS gap,
    closes AND ((above = 0 AND tag IN {names(BLOCKS)}) OR (depth = 0 AND above = 1)) AS ends,
    above > 0 AND NOT closes AND tag = 'pre' AS inner_open,
    above > 0 AND closes AND tag = 'pre' AS inner_close FROM stepped),
numbered AS (SELECT *, sum(CASE WHEN opens OR gap OR after_end THEN 1 ELSE 0 END) OVER w AS block,
    sum(inner_open::INT) OVER w AS inner_no,
    coalesce(sum(inner_close::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inner_done
  FROM (SELECT *, coalesce(lag(ends) OVER (PARTITION BY path ORDER BY n), false) AS after_end FROM marked)
  WINDOW w AS (PARTITION BY path ORDER BY n)),
members AS (
  SELECT *, 'outer' AS layer, block AS no FROM numbered
  UNION ALL SELECT *, 'inner', inner_no FROM numbered WHERE inner_no > inner_done),
blocks AS (SELECT path, layer, no, min(n) AS first_n,
    arg_min(CASE WHEN layer = 'inner' THEN 'code' WHEN NOT opens THEN '' WHEN tag IN {names(HEADINGS)}
      THEN 'heading' WHEN tag IN {names(LISTS)} THEN 'list' WHEN tag = 'pre' THEN 'code'
      ELSE 'paragraph' END, n) AS kind,
    min(first_line) AS start_line, max(CASE WHEN NOT blank THEN last_line END) AS end_line,
    trim(string_agg(piece, '' ORDER BY n), {BLANKS}) AS content
  FROM members GROUP BY path, layer, no)"""

_UNIT = "path, kind, start_line, end_line, md5(content) AS chunk_hash"


def under_heading(kinds: str) -> str:
    return f"""
SELECT path, kind, start_line, end_line,
       md5(concat_ws({NL}, CASE WHEN kind <> 'code' THEN heading END, content)) AS chunk_hash
FROM (SELECT *, last_value(CASE WHEN kind = 'heading' THEN content END IGNORE NULLS) OVER (
        PARTITION BY path ORDER BY first_n, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading
      FROM blocks) WHERE kind IN {kinds}"""


# Comments are one-line runs or not; a run of comments goes on while no other token and no
# gap of more than two lines lies between.
PAGE_COMMENTS = f"""
WITH {PAGE_BLOCKS},
solid AS (SELECT *, lag(comment) OVER w AS after_comment, lag(last_line) OVER w AS previous_line
  FROM placed WHERE NOT blank WINDOW w AS (PARTITION BY path ORDER BY n)),
runs AS (SELECT path, n, last_line, max(CASE WHEN NOT coalesce(after_comment, false)
    OR first_line - previous_line > 2 THEN n END) OVER (PARTITION BY path ORDER BY n) AS run_n
  FROM solid WHERE comment),
led AS (SELECT b.*, r.run_n FROM blocks b ASOF LEFT JOIN runs r ON b.path = r.path AND b.first_n > r.n),
near AS (SELECT led.*, r.last_line AS comment_line FROM led
  ASOF LEFT JOIN runs r ON led.path = r.path AND led.first_n > r.n),
attached AS (SELECT *, CASE WHEN start_line - comment_line <= 2 THEN run_n END AS from_n FROM near
  WHERE kind <> '')
SELECT a.path, a.kind, a.start_line, a.end_line, md5(trim(coalesce((
    SELECT string_agg(p.piece, '' ORDER BY p.n) FROM pieces p
    WHERE p.path = a.path AND p.n >= a.from_n AND p.n < a.first_n), '') || a.content, {BLANKS})) AS chunk_hash
FROM attached a"""


# --- markdown ----------------------------------------------------------------------------


def _like(pattern: str) -> str:
    return f"regexp_matches(piece, {text(pattern)})"


MARKDOWN = f"""
WITH corpus AS ({_markdown()}),
raw AS (SELECT path, string_split(content, {NL}) AS l FROM corpus
        WHERE strlen(content) BETWEEN 1 AND 1000000),
lines AS (SELECT path, i AS n, l[i] AS piece FROM raw, unnest(range(1, len(l) + 1)) AS u(i)),
flags AS (SELECT *, {_like(md.BLANK)} AS blank, {_like(md.FENCE)} AS mark, {_like(md.ATX_HEADING)} AS hash_line,
    {_like(md.RULE)} AS line_rule, {_like(md.UNDERLINE)} AS underlining, {_like(md.LIST_ITEM)} AS bullet,
    {_like(md.INDENTED)} AS indented, {_like("^ {0,3}>")} AS quote, {_like(md.TABLE_RULE)} AS is_table,
    {_like(md.CODE_INDENT)} OR {_like(md.MARKUP_OPEN)} AS strange FROM lines),
fences AS (SELECT *, sum(mark::INT) OVER w AS f, coalesce(lag(blank) OVER w, true) AS after_blank
  FROM flags WINDOW w AS (PARTITION BY path ORDER BY n)),
classes AS (SELECT *, mark OR f % 2 = 1 AS fenced, NOT (mark OR f % 2 = 1) AND NOT blank AS plain FROM fences),
kinds AS (SELECT *, plain AND line_rule AS rule, plain AND hash_line AS heading,
    plain AND bullet AND NOT line_rule AS item FROM classes),
states AS (SELECT *, CASE WHEN item THEN true
    WHEN NOT indented AND ((plain AND after_blank) OR heading OR rule OR (mark AND f % 2 = 1)) THEN false END AS state
  FROM kinds),
listed AS (SELECT *, coalesce(last_value(state IGNORE NULLS) OVER (PARTITION BY path ORDER BY n
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS in_list FROM states),
loose0 AS (SELECT *, plain AND NOT in_list AND NOT heading AS l0,
    in_list AND NOT coalesce(lag(in_list) OVER w, false) AS new_list
  FROM listed WINDOW w AS (PARTITION BY path ORDER BY n)),
loose1 AS (SELECT *, coalesce(lag(l0) OVER w, false) AS was_l0, coalesce(lag(quote) OVER w, false) AS was_quote,
    coalesce(lag(rule) OVER w, false) AS was_rule, sum(new_list::INT) OVER w AS list_no
  FROM loose0 WINDOW w AS (PARTITION BY path ORDER BY n)),
loose2 AS (SELECT *, l0 AND was_l0 AND underlining AS under FROM loose1),
loose3 AS (SELECT *, l0 AND (under OR NOT rule) AS loose,
    coalesce(lag(under) OVER (PARTITION BY path ORDER BY n), false) AS was_under FROM loose2),
runs AS (SELECT *, sum((loose AND (NOT was_l0 OR was_under OR (quote AND NOT was_quote)
    OR (was_rule AND NOT was_under)))::INT) OVER (PARTITION BY path ORDER BY n) AS run_no FROM loose3),
members AS (
  SELECT *, 'code' AS k, CAST(ceil(f / 2) AS BIGINT) AS no FROM runs WHERE fenced
  UNION ALL SELECT *, 'list', list_no FROM runs WHERE in_list
  UNION ALL SELECT *, 'heading', n FROM runs WHERE heading
  UNION ALL SELECT *, 'run', run_no FROM runs WHERE loose),
blocks AS (SELECT path, min(n) AS first_n,
    CASE WHEN k <> 'run' THEN k WHEN bool_or(under) THEN 'heading'
         WHEN arg_min(strange, n) OR bool_or(is_table) THEN 'other' ELSE 'paragraph' END AS kind,
    min(n) AS start_line, max(CASE WHEN NOT blank OR fenced THEN n END) AS end_line,
    trim(string_agg(piece, {NL} ORDER BY n), {BLANKS}) AS content
  FROM members GROUP BY path, k, no)
{under_heading("('paragraph', 'list', 'code')")}"""


# --- embedding ---------------------------------------------------------------------------


def hashed(prefix: str, rows: str) -> str:
    """CTE `{prefix}w`: key, bucket, weight of each row's hashed embedding (64 wide)."""
    return f"""
{prefix}tokens AS (SELECT key, unnest(regexp_extract_all(lower(body), '\\p{{L}}+')) AS t FROM ({rows})),
{prefix}counts AS (SELECT key, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS bucket, count(*) AS c
  FROM {prefix}tokens GROUP BY ALL),
{prefix}w AS (SELECT key, bucket,
    (c / sqrt(sum(c * c) OVER (PARTITION BY key)))::FLOAT::DOUBLE AS w FROM {prefix}counts)"""


def knn(k: int, where: str = "true") -> str:
    return f"""
WITH pairs AS (SELECT q.vec_id AS query_id, i.vec_id AS id,
    round(list_cosine_distance(i.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) + 0.0 AS distance
  FROM embeddings q, embeddings i WHERE {where}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pairs)
SELECT query_id, rank, id, round(distance, 6) + 0.0 AS distance FROM ranked WHERE rank <= {k}"""


def cells(k: int) -> str:
    """CTEs ending in `found`: top-k of every vector among the rows of its nearest cells.

    Cells are those of k-means on the sampled rows, unrolled; the probes those that the sampled
    rows' exact neighbours need.
    """
    near = "round(list_dot_product(v.unit, c.unit), 9) + 0.0"
    steps = [f"""
rows AS (SELECT vec_id AS id, md5(vec_id::VARCHAR) AS mark,
    list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS unit
  FROM embeddings WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
sample AS (SELECT id, unit, row_number() OVER (ORDER BY mark, id) AS n FROM rows
  QUALIFY n <= least({SAMPLE_ROWS}, {SAMPLE_BYTES} // (8 * len(unit)))),
sized AS (SELECT greatest(1, least({MAX_CELLS}, ceil(sqrt((SELECT count(*) FROM rows)))::BIGINT, count(*) // {ROWS_PER_CELL})) AS cells FROM sample),
c0 AS (SELECT n - 1 AS cell, list_transform(unit, lambda x: round(x, {CENTROID_DECIMALS})) AS unit FROM sample WHERE n <= (SELECT cells FROM sized))"""]
    for i in range(ROUNDS):
        steps.append(f"""
a{i} AS (SELECT id, arg_max(cell, ({near}, -cell)) AS cell, any_value(v.unit) AS unit FROM sample v, c{i} c GROUP BY id),
s{i} AS (SELECT cell, list(x ORDER BY d) AS total FROM (
    SELECT cell, d, sum(unit[d]) AS x FROM a{i}, unnest(range(1, len(unit) + 1)) AS u(d) GROUP BY cell, d) GROUP BY cell),
c{i + 1} AS (SELECT cell, CASE WHEN list_dot_product(total, total) > 0 THEN list_transform(total, lambda x:
    round(x / sqrt(list_dot_product(total, total)), {CENTROID_DECIMALS})) ELSE unit END AS unit FROM c{i} LEFT JOIN s{i} USING (cell))""")
    steps.append(f"""
ordered AS (SELECT id, cell, row_number() OVER (PARTITION BY id ORDER BY {near} DESC, cell) AS probe
  FROM rows v, c{ROUNDS} c),
placed AS (SELECT id, cell FROM ordered WHERE probe = 1),
pairs AS (SELECT q.vec_id AS query_id, i.vec_id AS id,
    round(list_cosine_distance(i.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) + 0.0 AS distance
  FROM embeddings q, embeddings i),
exact AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pairs),
neighbours AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM exact
  WHERE rank <= {k + 1} AND query_id <> id AND query_id IN (SELECT id FROM sample WHERE n > (SELECT count(*) FROM sample) - {CALIBRATION})),
needed AS (SELECT probe, row_number() OVER (ORDER BY probe) AS n, count(*) OVER () AS total
  FROM neighbours JOIN placed USING (id) JOIN ordered ON ordered.id = query_id AND ordered.cell = placed.cell WHERE place <= {k}),
probed AS (SELECT coalesce((SELECT probe FROM needed WHERE n = ceil({TARGET} * total)), 1) AS probes),
found AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, pairs.id) AS rank
  FROM pairs JOIN placed USING (id) JOIN ordered ON ordered.id = query_id AND ordered.cell = placed.cell, probed
  WHERE probe <= probes QUALIFY rank <= {k})""")
    return ",".join(steps)


_REL = lambda root: (
    f"CASE WHEN starts_with(path, '{root}/') THEN substr(path, {len(root) + 2}) ELSE path END"
)

ORACLES: dict[str, str] = {
    "corpus_filter": f"""
SELECT path, strlen(content) AS size FROM ({DOCS}) WHERE strlen(content) BETWEEN 1 AND 5000""",
    "type_assignment": f"""
WITH p AS (
  SELECT '/' || source || '/f' || doc_id || '.' || ({EXTENSIONS!r})[doc_id % {len(EXTENSIONS)} + 1] AS path
  FROM documents UNION ALL SELECT url FROM pages),
typed AS (SELECT path, CASE regexp_extract(path, '\\.([^./]+)$', 1)
    WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'js' THEN 'js' WHEN 'ts' THEN 'ts' WHEN 'go' THEN 'go'
    WHEN 'java' THEN 'java' WHEN 'c' THEN 'c' WHEN 'hpp' THEN 'cpp' WHEN 'rb' THEN 'ruby' WHEN 'sh' THEN 'bash'
    WHEN 'md' THEN 'markdown' WHEN 'html' THEN 'html' END AS type FROM p)
SELECT path, type FROM typed WHERE type IS NOT NULL""",
    "utf8_filter": "SELECT doc_id, md5(text) AS text_hash FROM documents WHERE doc_id % 7 <> 0",
    "fingerprint": f"""
SELECT path, md5(content) AS file_hash, mtime, 0::BIGINT AS ctime FROM ({DOCS})""",
    "content_hashes": "SELECT doc_id, md5(text) AS chunk_hash FROM documents",
    "latest_versions": f"""
SELECT path, md5(content) AS file_hash FROM ({DOCS})
UNION ALL SELECT path, md5(content) FROM ({CHANGED}) WHERE path NOT IN (SELECT path FROM ({DOCS}))""",
    "namespaces": """
SELECT DISTINCT '/' || source AS root, 'ix_hashed64_' || md5('/' || source) AS namespace FROM documents""",
    "project_roots": f"""
WITH files AS (SELECT page_id, '/' || regexp_replace(url, '^https?://|\\?.*$', '', 'g') AS path FROM pages),
marks AS (SELECT DISTINCT CASE WHEN page_id % 3 = 0 THEN regexp_extract(path, '^/[^/]*')
    ELSE regexp_replace(path, '/[^/]*$', '') END AS dir FROM files WHERE page_id % 3 < 2),
placed AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir, string_split(path, '/') AS steps FROM files),
climbs AS (SELECT page_id, array_to_string(steps[1:i], '/') AS up
  FROM placed, unnest(range(1, len(steps))) AS u(i)),
found AS (SELECT page_id, arg_max(up, length(up)) AS root FROM climbs JOIN marks ON up = marks.dir GROUP BY page_id)
SELECT page_id, path, coalesce(root, dir) AS root FROM placed LEFT JOIN found USING (page_id)
""",
    "prose_blocks": f"WITH {prose(SPACED)} SELECT {_UNIT.replace('md5(content) AS ', '')} FROM units",
    "chunk_ids": f"WITH {prose(SPACED)} SELECT id, path, file_hash, chunk_hash, mtime FROM units",
    "page_blocks": f"WITH {PAGE_BLOCKS} SELECT {_UNIT} FROM blocks WHERE kind <> ''",
    "page_heading_context": f"WITH {PAGE_BLOCKS} {under_heading(names(['paragraph', 'list', 'code']))}",
    "page_comment_attach": PAGE_COMMENTS,
    "markdown_blocks": MARKDOWN,
    "source_units": f"""
WITH files AS ({SOURCES})
SELECT path, 'impl' AS kind, 1::BIGINT AS start_line, 7 * len(functions) + 2 AS end_line,
       md5(trim({SOURCE_TEXT}, {BLANKS})) AS chunk_hash FROM files WHERE doc_id % 2 = 0
UNION ALL
SELECT path, 'function', CASE WHEN doc_id % 2 = 0 THEN 7 * (i - 1) + 3 ELSE 8 * (i - 1) + 2 END,
       CASE WHEN doc_id % 2 = 0 THEN 7 * (i - 1) + 7 ELSE 8 * (i - 1) + 7 END,
       md5(trim(functions[i], {BLANKS}))
FROM files, unnest(range(1, len(functions) + 1)) AS u(i)""",
    "language_units": _language_units(LANGUAGES),
    "nested_units": _language_units(NESTED),
    "long_units": f"WITH {prose(LONG)} SELECT path, start_line, end_line, chunk_hash FROM units",
    "left_out_files": f"""
WITH {prose(LONG)} SELECT count(DISTINCT path) FILTER (strlen(f.content) <= 1000000 AND regexp_matches(lower(units.content), '\\p{{L}}')) AS n_paths,
  (SELECT count(*) FROM l0 WHERE strlen(content) > 1000000) AS n_too_large, 0::BIGINT AS n_broken
FROM units JOIN l0 f USING (path)""".replace("WITH ", f"WITH l0 AS ({LONG}), ", 1),
    "chunk_checks": f"""
WITH {prose(SPACED)}
SELECT count(*) AS n_chunks, count(*) FILTER (path = '') AS bad_path,
       count(*) FILTER (start_line < 1) AS bad_start, count(*) FILTER (end_line < start_line) AS bad_end,
       count(*) FILTER (content = '') AS bad_content, count(*) FILTER (file_hash = '' OR chunk_hash = '') AS bad_hash,
       count(*) FILTER (id = '') AS bad_id FROM units""",
    "corpus_statistics": f"""
WITH files AS ({SOURCES})
SELECT CASE WHEN doc_id % 2 = 0 THEN 'rs' ELSE 'py' END AS extension, count(*) AS n_files,
       sum(len(functions) + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_chunks,
       sum(strlen({SOURCE_TEXT}))::BIGINT AS n_bytes FROM files GROUP BY ALL""",
    "sampled_chunks": f"""
WITH {prose(DOCS)} SELECT path, id FROM units ORDER BY md5(concat_ws(':', '/src0', id)), id LIMIT 100""",
    "diff_upload": f"{LOCAL_INDEX} SELECT id, path FROM l_units WHERE id NOT IN (SELECT id FROM i_units)",
    "diff_delete": f"{LOCAL_INDEX} SELECT id, path FROM i_units WHERE id NOT IN (SELECT id FROM l_units)",
    "stale_path_list": f"""
{LOCAL_INDEX} SELECT DISTINCT path FROM i_units WHERE id NOT IN (SELECT id FROM l_units)""",
    "delete_by_path": f"""
{LOCAL_INDEX} SELECT id, path FROM i_units WHERE path NOT IN (
  SELECT path FROM i_units WHERE id NOT IN (SELECT id FROM l_units))""",
    "applied_diff": f"WITH {prose(DOCS)} SELECT id, path, chunk_hash FROM units",
    "sync_report": f"""
{LOCAL_INDEX} SELECT up AS n_upload, gone AS n_delete, up + gone > 0 AS changed FROM (
  SELECT (SELECT count(*) FROM l_units WHERE id NOT IN (SELECT id FROM i_units)) AS up,
         (SELECT count(*) FROM i_units WHERE id NOT IN (SELECT id FROM l_units)) AS gone)""",
    "sync_unchanged": "SELECT 0::BIGINT AS n_upload, 0::BIGINT AS n_delete, false AS changed",
    "sync_twice": f"""
WITH {prose(DOCS)} SELECT count(*) AS n_rows, false AS changed, true AS same_version FROM units
WHERE regexp_matches(lower(content), '\\p{{L}}')""",
    "stream_two_checkpoints": f"""
WITH {prose(DOCS)} SELECT id, path, start_line, file_hash FROM units
WHERE regexp_matches(lower(content), '\\p{{L}}')""",
    "stream_late_rows": f"""
WITH {prose(f"{DOCS} UNION ALL SELECT * FROM ({CHANGED}) WHERE path NOT IN (SELECT path FROM ({DOCS}))")}
SELECT id, path, start_line, file_hash FROM units WHERE regexp_matches(lower(content), '\\p{{L}}')""",
    "duplicate_upserts": f"""
WITH {prose(DOCS)} SELECT id, path, start_line, file_hash FROM units
WHERE regexp_matches(lower(content), '\\p{{L}}')""",
    "broken_chunks": f"""
WITH {prose(SPACED)}, u AS (SELECT *, (('0x' || substr(id, 1, 8))::BIGINT) % 7 AS k FROM units)
SELECT count(*) AS n_chunks, count(*) FILTER (k = 0) AS bad_path, count(*) FILTER (k = 1) AS bad_start,
       count(*) FILTER (k = 2) AS bad_end, count(*) FILTER (k = 3 OR content = '') AS bad_content,
       count(*) FILTER (k = 4) AS bad_hash, count(*) FILTER (k = 5) AS bad_id FROM u""",
    "scanned_files": f"""
SELECT {FILE_NAME} AS name, strlen(text) AS size, md5(text) AS text_hash FROM documents WHERE strlen(text) > 0""",
    "scanned_links": f"""
SELECT {FILE_NAME} AS name, md5(text) AS text_hash, NULL AS reason FROM documents WHERE strlen(text) BETWEEN 1 AND 1000000
UNION ALL SELECT 'links/doc_' || doc_id || '.md', NULL, 'link' FROM documents WHERE doc_id % 10 = 0
UNION ALL SELECT 'links/loop_' || doc_id, NULL, 'link' FROM documents WHERE doc_id % 50 = 0""",
    "stream_removed": f"""
WITH {prose(DOCS + " WHERE (1700000000 + doc_id) % 3 <> 0")} SELECT id, path, start_line, file_hash FROM units
WHERE regexp_matches(lower(content), '\\p{{L}}')""",
    "sampled_lines": """
WITH l AS (SELECT l_orderkey || '-' || l_linenumber AS id, l_partkey FROM lineitem)
SELECT id, l_partkey FROM l ORDER BY md5('lines:' || id), id LIMIT 55000""",
    "short_responses": """
SELECT unnest(['ok', 'short_response']) AS status, 0::BIGINT AS n_wrong, true AS seen""",
    "embedding_kinds": """
SELECT doc_id, kind, length(text) AS n_chars, (kind = 'query')::BIGINT AS as_query
FROM documents, (SELECT unnest(['query', 'document']) AS kind) WHERE doc_id % 4 <> 0""",
    "stored_sync": f"""
WITH {prose(DOCS)} SELECT id, path, start_line, file_hash FROM units
WHERE regexp_matches(lower(content), '\\p{{L}}')""",
    "reset_index": f"""
WITH {prose(DOCS)} SELECT id, path, start_line, file_hash FROM units
WHERE regexp_matches(lower(content), '\\p{{L}}')""",
    "stream_sync": f"""
{LOCAL_INDEX}, final AS (SELECT * FROM l_units UNION ALL
  SELECT * FROM i_units WHERE path NOT IN (SELECT path FROM l_corpus))
SELECT id, path, start_line, file_hash FROM final WHERE regexp_matches(lower(content), '\\p{{L}}')""",
    "hashed_embedding": f"""
WITH {hashed('d_', 'SELECT doc_id AS key, text AS body FROM documents')}
SELECT g.key AS doc_id, g.b AS bucket, round(coalesce(d_w.w, 0), 5) AS weight
FROM (SELECT key, unnest(range(64)) AS b FROM (SELECT DISTINCT key FROM d_counts)) g
LEFT JOIN d_w ON d_w.key = g.key AND d_w.bucket = g.b""",
    "tokens_billed": """
SELECT sum(len(regexp_extract_all(lower(text), '\\p{L}+')))::BIGINT AS n_tokens FROM documents""",
    "embed_batches": """
SELECT status, count(*) AS n, sum(size) AS total FROM (
  SELECT CASE WHEN length(text) > 6000 THEN 'failed' WHEN text NOT LIKE '%e%' THEN 'no_vector' ELSE 'ok' END AS status,
         CASE WHEN length(text) <= 6000 AND text LIKE '%e%' THEN length(text)::DOUBLE END AS size
  FROM documents) GROUP BY status""",
    "embed_token_total": """
SELECT sum(length(text))::BIGINT AS n_tokens FROM documents WHERE length(text) <= 6000""",
    "index_projection": f"""
WITH {prose(DOCS)} SELECT id, path, file_hash, chunk_hash, mtime, 0::BIGINT AS ctime, true AS no_vector,
  start_line, end_line FROM units""",
    "next_page": """
SELECT vec_id AS id, label::BIGINT AS label FROM embeddings WHERE vec_id > 99 ORDER BY vec_id LIMIT 150""",
    "attribute_predicates": """
SELECT vec_id AS id, label::BIGINT AS label FROM embeddings WHERE label = 1 OR label = 4 OR vec_id > 400""",
    "knn_exact": knn(20),
    "knn_filtered": knn(5, "i.label = 3"),
    "knn_blocks": knn(5),
    # A query looks into further cells until they hold k rows; none of these needs to.
    "ann_search": f"""
WITH {cells(5)}
SELECT query_id, rank, id, round(distance, 6) + 0.0 AS distance FROM found""",
    "ann_recall": f"""
WITH {cells(5)}
SELECT count(*) AS n_exact, count(f.id) AS n_found, count(f.id) / count(*) AS recall
FROM exact e LEFT JOIN found f ON e.query_id = f.query_id AND e.id = f.id WHERE e.rank <= 5""",
    "blank_queries": """
SELECT conv_id, turn, CASE WHEN q IS NULL OR trim(q, ' ' || chr(9) || chr(10)) = '' THEN 'empty_query'
       ELSE 'ok' END AS status, md5(q) AS query_hash
FROM (SELECT conv_id, turn, text AS q FROM conversations
  UNION ALL SELECT conv_id, -1 - turn, ' ' || chr(9) || ' ' FROM conversations WHERE turn % 2 = 1)""",
    "hydrated_hits": f"""
WITH hits AS ({DOCS}), now AS ({CHANGED})
SELECT hits.path, CASE WHEN len(string_split(now.content, {NL})) >= 2
         THEN md5(array_to_string(string_split(now.content, {NL})[2:4], {NL})) END AS lines_hash,
       coalesce(md5(now.content) <> md5(hits.content), true) AS stale
FROM hits LEFT JOIN now USING (path)""",
    "formatted_results": f"""
WITH hits AS (
  SELECT {DOC_PATH} AS path, doc_id % 50 + 1 AS start_line,
         CASE WHEN doc_id % 5 <> 0 THEN n_chars / 7.0 END AS distance,
         CASE WHEN doc_id % 7 <> 0 THEN string_split(text, {NL})[1] ELSE '[no content]' END AS preview
  FROM documents)
SELECT path, md5({_REL('/src0')} || ':' || start_line || ':' || preview) AS plain,
       md5({_REL('/src1')} || ':' || start_line || ':'
           || coalesce(distance::DECIMAL(18, 6)::DECIMAL(18, 4)::VARCHAR, 'n/a') || ':' || preview) AS scored
FROM hits""",
    "search_documents": f"""
WITH {prose(DOCS)},
{hashed('u_', 'SELECT id AS key, content AS body FROM units')},
{hashed('q_', 'SELECT item_id AS key, text AS body FROM benchmark')},
dots AS (SELECT q_w.key AS query_id, u_w.key AS id, sum(q_w.w * u_w.w) AS dot
  FROM q_w JOIN u_w USING (bucket) GROUP BY ALL),
q_n AS (SELECT key, sum(w * w) AS n FROM q_w GROUP BY key),
u_n AS (SELECT key, sum(w * w) AS n FROM u_w GROUP BY key),
scored AS (SELECT query_id, id, round(1 - dot / sqrt(q_n.n * u_n.n), 12) + 0.0 AS distance
  FROM dots JOIN q_n ON q_n.key = query_id JOIN u_n ON u_n.key = id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM scored)
SELECT query_id, rank, path, round(distance, 6) + 0.0 AS distance, md5({_REL('/src0')} || ':' || start_line || ':'
    || round(distance, 6)::DECIMAL(18, 6)::DECIMAL(18, 4)::VARCHAR || ':' || string_split(content, {NL})[1]) AS line_hash,
  'ok' AS status
FROM ranked JOIN units USING (id) WHERE rank <= 5""",
}
