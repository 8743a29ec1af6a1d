"""DuckDB SQL that gives the rows of the queries."""

from __future__ import annotations

from ..functions.globs import glob_regex
from ..functions.text import STOPWORDS
from ..operators.verify import PROFILES
from .bindings import AS_OF, SYMBOL_QUERIES


def _name(k: str) -> str:
    return (
        f"(CASE {k} % 8 WHEN 0 THEN 'mod_' || {k} || '.rs' WHEN 1 THEN 'test_' || {k} || '.py' WHEN 2 THEN 'w_' || {k} || '.spec.ts' WHEN 3 THEN 'CHANGELOG.' || {k} || '.md' "
        f"WHEN 4 THEN 'notes_' || {k} || '.md' WHEN 5 THEN 'tests/' || {k} || '.go' WHEN 6 THEN 'main_' || {k} || '.js' ELSE {k} || '.txt' END)"
    )


def _language(p: str) -> str:
    e = f"regexp_extract({p}, '[^.]*$')"
    return (
        f"(CASE WHEN {e} = 'rs' THEN 'rust' WHEN {e} = 'py' THEN 'python' WHEN {e} IN ('ts', 'tsx') THEN 'typescript' "
        f"WHEN {e} IN ('js', 'jsx', 'mjs', 'cjs') THEN 'javascript' WHEN {e} = 'go' THEN 'go' ELSE 'other' END)"
    )


def _test(p: str) -> str:
    return (
        f"(contains(lower({p}), '/tests/') OR contains(lower({p}), '/test/') OR contains(lower({p}), '/__tests__/') OR starts_with(lower({p}), 'tests/') OR starts_with(lower({p}), 'test/') "
        f"OR regexp_matches(lower({p}), '(_test\\.(rs|go|py)|\\.test\\.(ts|tsx|js)|\\.spec\\.(ts|js))$') OR starts_with(regexp_extract(lower({p}), '[^/]*$'), 'test_'))"
    )


def _class(p: str) -> str:
    name = f"regexp_extract({p}, '[^/]*$')"
    return f"(CASE WHEN upper(string_split({name}, '.')[1]) IN ('CHANGES', 'CHANGELOG', 'HISTORY', 'NEWS') THEN 'changelog' WHEN regexp_matches({name}, '\\.(md|markdown|txt|rst|adoc)$') THEN 'doc' ELSE 'code' END)"


_DOC_PATH = "source || '/' || lang || '/' || " + _name("doc_id")
_DOCS = f"docs AS (SELECT doc_id AS doc, {_DOC_PATH} AS path, text AS body, n_chars AS size_bytes, source FROM documents)"
_PART_FILES = f"part_files AS (SELECT 'part/' || {_name('p_partkey')} AS path, p_brand FROM part)"
_ADMITTED = f"({_language('path')} <> 'other' OR regexp_matches(path, '\\.(md|toml|json)$'))"


def _files(file: str, name: str = "files") -> str:
    return f"{name} AS (SELECT DISTINCT o_orderdate, o_orderkey, epoch(o_orderdate)::BIGINT AS ts, {file} AS file FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def _edges(cap: int = 30, files: str = "files") -> str:
    return f"""small AS (SELECT o_orderkey, file FROM {files} WHERE o_orderkey IN (SELECT o_orderkey FROM {files} GROUP BY 1 HAVING count(*) <= {cap})),
totals AS (SELECT file AS path_a, count(*) AS total FROM small GROUP BY 1),
counts AS (SELECT a.file AS path_a, b.file AS path_b, count(*) AS n FROM small a JOIN small b ON a.o_orderkey = b.o_orderkey AND a.file <> b.file GROUP BY ALL HAVING count(*) >= 2),
edges AS (SELECT path_a, path_b, n, total, n / total AS strength FROM counts JOIN totals USING (path_a))"""


_OLDER = """ordered AS (SELECT DISTINCT o_orderdate, o_orderkey FROM files ORDER BY 1 DESC, 2 DESC LIMIT 2200),
newest AS (SELECT * FROM ordered ORDER BY 1 DESC, 2 DESC LIMIT 200),
older AS (SELECT f.* FROM files f JOIN ordered USING (o_orderkey) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM newest))"""

_PART_EDGES = f"{_files('\'part/\' || ' + _name('l_partkey'))}, {_edges()}"

_REASON = "'changes with ' || {seed} || ' in ' || floor((n / total)::FLOAT * 100::FLOAT)::BIGINT || '% of its commits'"

_PAGES = """site AS (SELECT 'site/p' || page_id || '/' || coalesce(nullif(w, ''), 'page') || '.html' AS path, html FROM (SELECT page_id, html, lower(regexp_extract(regexp_extract(html, '<title>([^<]*)</title>', 1), '([A-Za-z]{3,})', 1)) AS w FROM pages)),
links AS (SELECT path, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM site),
targets AS (SELECT path, target, array_to_string(list_filter(string_split(regexp_replace(replace(regexp_replace(lower(trim(target)), '\\.(ts|tsx|js|jsx|mjs|cjs|json)$', ''), '::', '/'), '[.\\\\]', '/', 'g'), '/'),
  lambda s: s NOT IN ('', '.', '..', 'crate', 'self', 'super')), '/') AS normalized FROM links)"""

_NEEDLES = """import_keys AS (SELECT path, unnest(list_concat(list_transform(range(1, len(s)), lambda i: s[i] || '/' || s[i + 1]), s)) AS key FROM (SELECT path, list_filter(string_split(normalized, '/'), lambda x: x <> '') AS s FROM targets)),
needles AS (SELECT path, unnest(CASE WHEN len(s[-1]) >= 3 THEN [s[-2] || '/' || s[-1], s[-1]] ELSE [] END) AS key FROM (SELECT path, string_split(regexp_replace(lower(path), '\\.[^./]*$', ''), '/') AS s FROM site))"""

_IMPORTS = f"{_PAGES}, {_NEEDLES}, imports AS (SELECT DISTINCT k.path AS src, n.path AS dst FROM import_keys k JOIN needles n USING (key) WHERE k.path <> n.path)"

_DEPENDENTS = """hop1 AS (SELECT DISTINCT s.path AS seed, i.src AS path, 1 AS hops FROM site s JOIN imports i ON i.dst = s.path),
hop2 AS (SELECT DISTINCT h.seed, i.src AS path, 2 AS hops FROM hop1 h JOIN imports i ON i.dst = h.path),
dependents AS (SELECT seed, path, min(hops)::BIGINT AS hops FROM (SELECT * FROM hop1 UNION ALL SELECT * FROM hop2) WHERE path <> seed GROUP BY ALL)"""

_TOKENS = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '' AND strlen(t) <= 40)"


def _postings(rows: str, key: str, text: str, name: str) -> str:
    return f"{name} AS (SELECT {key}, term, count(*) AS tf, any_value(len) AS len FROM (SELECT {key}, len(ts) AS len, unnest(ts) AS term FROM (SELECT {key}, {_TOKENS.format(text)} AS ts FROM {rows})) GROUP BY {key}, term)"


def _bm25(*fields: str) -> str:
    posts = " UNION ALL ".join(f"SELECT '{f}' AS field, doc, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc, len(ts) AS len, unnest(ts) AS term FROM (SELECT doc, {_TOKENS.format(f)} AS ts FROM docs)) GROUP BY doc, term" for f in fields)
    sizes = " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS n_docs, avg(coalesce(len({_TOKENS.format(f)}), 0)) AS avg_len FROM docs" for f in fields)
    return f"""postings AS ({posts}),
sizes AS ({sizes}),
terms AS (SELECT field, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM postings GROUP BY ALL),
asked AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
bm25_scores AS (SELECT query_id, doc, round(sum(times * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))), 6) AS score
  FROM asked JOIN postings USING (term) JOIN terms USING (field, term) JOIN sizes USING (field) GROUP BY ALL),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM bm25_scores)"""


_BM25 = _bm25("body")

_BUCKET = "list_reduce(list_prepend(293, list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: ('0x' || x)::INT)), lambda h, x: (xor(h, x) * 435) & 511)"


def _vectors(rows: str, key: str, text: str, name: str) -> str:
    return f"""{_postings(rows, key, text, name + '_tokens')},
{name}_features AS (SELECT {key}, term AS f, 2.0 * tf AS w FROM {name}_tokens UNION ALL SELECT {key}, unnest(list_transform(range(1, len(term) - 1), lambda i: term[i : i + 2])), 1.0 * tf FROM {name}_tokens),
{name}_distinct AS (SELECT {key}, f, sum(w)::DOUBLE AS w FROM {name}_features GROUP BY ALL),
{name}_hashes AS (SELECT f, {_BUCKET.format('f')}::INT AS bucket FROM (SELECT DISTINCT f FROM {name}_distinct)),
{name}_sums AS (SELECT {key}, bucket, sum(w) AS w FROM {name}_distinct JOIN {name}_hashes USING (f) GROUP BY ALL),
{name} AS (SELECT {key}, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM {name}_sums)"""


def _cosine(a: str, key: str) -> str:
    return f"""cosine_scores AS (SELECT q.item_id AS query_id, v.{key}, round(sum(q.weight * v.weight), 6) AS score FROM qv q JOIN {a} v USING (bucket) GROUP BY ALL),
cosine AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank FROM cosine_scores)"""


_CHUNKS = """split AS (SELECT doc, body, string_split(body, chr(10)) AS ls FROM docs),
chunks AS (SELECT doc, 0 AS chunk, NULL AS symbol, 0 AS start_line, substr(body, 1, 4000) AS t FROM split
  UNION ALL SELECT doc, k, name, a, substr(array_to_string(ls[a : least(b, len(ls))], chr(10)), 1, 4000) FROM split, (VALUES (1, 'first', 1, 2), (2, 'rest', 3, 9999), (3, 'far', 900, 950), (4, 'backwards', 5, 2), (5, 'none', 0, 0)) s(k, name, a, b) WHERE a >= 1 AND b >= a AND a <= len(ls)),
keyed AS (SELECT *, doc * 8 + chunk AS ck FROM chunks)"""


def _by_unit(units: str) -> str:
    """Cosine of all documents, by their best unit (ck, doc, chunk), those without a bucket in common too."""
    return f"""unit_scores AS (SELECT item_id, ck, sum(q.weight * v.weight) AS dot FROM qv q JOIN dv v USING (bucket) GROUP BY ALL),
cosine_scores AS (SELECT q.item_id AS query_id, u.doc, u.chunk AS best, round(coalesce(dot, 0), 6) AS score FROM benchmark q CROSS JOIN {units} u LEFT JOIN unit_scores s ON s.item_id = q.item_id AND s.ck = u.ck
  QUALIFY row_number() OVER (PARTITION BY q.item_id, u.doc ORDER BY round(coalesce(dot, 0), 6) DESC, u.chunk) = 1),
cosine AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM cosine_scores)"""


_CHUNK_COSINE = f"{_CHUNKS}, {_vectors('keyed', 'ck', 't', 'dv')}, {_vectors('benchmark', 'item_id', 'text', 'qv')}, {_by_unit('keyed')}"
_WHOLE_COSINE = f"whole AS (SELECT doc AS ck, doc, 0 AS chunk, body FROM docs), {_vectors('whole', 'ck', 'body', 'dv')}, {_vectors('benchmark', 'item_id', 'text', 'qv')}, {_by_unit('whole')}"

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
_QUERY_TOKENS = f"list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) > 2 AND NOT list_contains({_STOP}, t))"

_FUSED = f"""{_DOCS}, {_bm25('path', 'body')}, {_CHUNK_COSINE},
lists AS (
  SELECT query_id, doc, score / greatest(max(score) OVER (PARTITION BY query_id), 1e-6) AS b, NULL::DOUBLE AS v, NULL AS best_chunk FROM bm25 WHERE rank <= 50
  UNION ALL SELECT query_id, doc, NULL, score / greatest(max(score) OVER (PARTITION BY query_id), 1e-6), best FROM cosine WHERE rank <= 50
), candidates AS (
  SELECT query_id, doc, max(b) AS b, max(v) AS v, max(best_chunk) AS best_chunk FROM lists GROUP BY ALL
), seen AS (
  SELECT c.*, d.path, {_test('d.path')} AS test, {_class('d.path')} AS class, contains(lower(benchmark.text), 'test') AS about,
    coalesce(len(list_filter({_QUERY_TOKENS.replace('lower(text)', 'lower(benchmark.text)')}, lambda t: contains(lower(d.path), t))), 0) > 0 AS on_path,
    CASE WHEN o_orderdate IS NULL THEN 0.0 ELSE 0.4 * pow(0.5, greatest({AS_OF} - epoch(o_orderdate)::BIGINT, 0) / 86400.0 / 90.0) END AS recent
  FROM candidates c JOIN docs d USING (doc) JOIN benchmark ON item_id = query_id LEFT JOIN orders ON o_orderkey = doc
), added AS (
  SELECT *, coalesce(b, 0) * 1.0 + coalesce(v, 0) * 1.2 + CASE WHEN on_path THEN 0.6 ELSE 0 END + recent AS s FROM seen
), fused AS (
  SELECT query_id, doc, path, test, best_chunk, round((CASE WHEN test AND about THEN s + 0.5 WHEN test THEN s * 0.8 ELSE s END) * CASE class WHEN 'changelog' THEN 0.35 WHEN 'doc' THEN 0.6 ELSE 1.0 END, 6) AS score,
    array_to_string(list_filter([CASE WHEN b IS NOT NULL THEN 'bm25' END, CASE WHEN v IS NOT NULL THEN 'vector' END, CASE WHEN on_path THEN 'path' END, CASE WHEN recent > 1e-4 THEN 'recent' END,
      CASE class WHEN 'changelog' THEN 'changelog_demoted' WHEN 'doc' THEN 'doc_demoted' END], lambda x: x IS NOT NULL), '+') AS signals
  FROM added
), best AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM fused QUALIFY rank <= 8
)"""

_SYMBOLS = "symbols AS (SELECT replace(p_name, ' ', '_') AS name, p_type AS kind, p_brand AS path, p_partkey AS start_line FROM part)"
_SYMBOL_QUERIES = "symbol_queries AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in SYMBOL_QUERIES) + ") t(query_id, text))"

_DOT = "round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)), 6)"
_DENSE = f"scores AS (SELECT a.vec_id AS query_id, a.label AS query_label, b.vec_id AS id, b.label AS grp, {_DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)"

_COMMENTS = """prs AS (SELECT conv_id AS pr_number, arg_min(text, turn) AS pr_title, bool_or(role = 'assistant') AS pr_merged FROM conversations WHERE conv_id % 5 <> 0 GROUP BY 1),
comments AS (SELECT conv_id AS pr_number, 'conv/' || conv_id AS path, turn AS line, text AS body, pr_title, pr_merged, NULL::VARCHAR AS diff_hunk FROM conversations JOIN prs ON pr_number = conv_id WHERE role = 'user')"""


def _profile_rows() -> str:
    rows = [f"('{p.name}', {i}, '{'|'.join(glob_regex(g) for g in p.detect)}')" for i, p in enumerate(PROFILES)]
    checks = ["({}, {}, '{}')".format(i, j, c.replace("'", "''")) for i, p in enumerate(PROFILES) for j, c in enumerate(p.checks)]
    return f"profiles AS (SELECT * FROM (VALUES {', '.join(rows)}) t(name, a, rx)), checks AS (SELECT * FROM (VALUES {', '.join(checks)}) t(a, b, text))"


def _fnv(text: str) -> str:
    limbs = "lambda h, x: ((xor(h, x::HUGEINT) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
    return f"list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, len({text}) + 1), lambda i: ascii(({text})[i])::HUGEINT)), {limbs})"


_EXPLAIN = f"""near AS (SELECT *, row_number() OVER (PARTITION BY path_a ORDER BY strength DESC, path_b) AS r FROM edges QUALIFY r <= 5),
cochange AS (SELECT path_a AS seed, path_b AS path, n, total, strength FROM near WHERE path_b IN (SELECT path FROM part_files)),
importing AS (SELECT seed, path, CASE WHEN hops <= 1 THEN 0.6 ELSE 0.35 END AS weight, row_number() OVER (PARTITION BY seed ORDER BY hops, path) AS r FROM dependents QUALIFY r <= 8),
pairs AS (SELECT path_a AS source, path_b AS target FROM edges UNION SELECT src, dst FROM imports)"""

ORACLE_SQL: dict[str, str] = {
    "path_classify": f"WITH {_DOCS} SELECT path, {_language('path')} AS language, {_test('path')} AS is_test, {_class('path')} AS doc_class, {_language('path')} IN ('rust', 'python', 'typescript', 'javascript') AS supported, {_ADMITTED} AS admitted FROM docs",
    "inventory_summary": f"WITH {_DOCS} SELECT {_language('path')} AS language, {_class('path')} AS doc_class, {_test('path')} AS is_test, count(*) AS files, sum(size_bytes)::BIGINT AS size_bytes FROM docs WHERE {_ADMITTED} AND size_bytes <= 1500000 GROUP BY ALL",
    "chunk_plan": f"WITH {_DOCS}, {_CHUNKS} SELECT doc, symbol, start_line, length(t)::INT AS chars, md5(t) AS text_md5 FROM chunks",
    "commit_recency": f"WITH {_files('l_partkey')} SELECT file, arg_max(ts, (o_orderdate, o_orderkey)) AS ts FROM files GROUP BY file",
    "cochange_edges": f"WITH {_files('l_partkey')}, {_edges()} SELECT path_a, path_b, n, total, round(strength, 6) AS strength FROM edges",
    "cochange_capped": f"WITH {_files('l_partkey')}, {_edges(6)} SELECT path_a, path_b, n, total, round(strength, 6) AS strength FROM edges",
    "cochange_topn": f"WITH {_files('l_suppkey')}, {_edges()} SELECT path_a, path_b, n, round(strength, 6) AS strength, row_number() OVER (PARTITION BY path_a ORDER BY edges.strength DESC, path_b)::INT AS rank FROM edges QUALIFY rank <= 5",
    "cochange_holdout": f"WITH {_files('l_suppkey')}, {_OLDER}, {_edges(files='older')} SELECT path_a, path_b, n, total, round(strength, 6) AS strength FROM edges",
    "expand_cochange": f"""WITH {_PART_FILES}, {_PART_EDGES}, near AS (SELECT *, row_number() OVER (PARTITION BY path_a ORDER BY strength DESC, path_b) AS r FROM edges QUALIFY r <= 5)
SELECT path_a AS seed, path_b AS path, round(strength, 6) AS confidence, {_REASON.format(seed='path_a')} AS reason, row_number() OVER (PARTITION BY path_a ORDER BY strength DESC, path_b)::INT AS rank
FROM near WHERE path_a IN (SELECT path FROM part_files) AND path_b IN (SELECT path FROM part_files)""",
    "co_failing": f"""WITH {_PART_FILES}, {_PART_EDGES}, near AS (SELECT *, row_number() OVER (PARTITION BY path_a ORDER BY strength DESC, path_b) AS r FROM edges QUALIFY r <= 10)
SELECT DISTINCT p_brand AS change_set, path_b AS path FROM part_files JOIN near ON path = path_a WHERE {_test('path_b')}""",
    "import_targets": f"WITH {_PAGES} SELECT path, target, normalized FROM targets",
    "module_needles": f"WITH {_PAGES}, {_NEEDLES} SELECT path, 'needle' AS kind, key FROM needles UNION ALL SELECT path, 'import', key FROM import_keys",
    "import_edges": f"WITH {_IMPORTS} SELECT src, dst FROM imports",
    "dependents_2hop": f"WITH {_IMPORTS}, {_DEPENDENTS} SELECT seed, path, hops FROM dependents",
    "graph_stats": f"""WITH {_IMPORTS}, {_PART_FILES}, {_PART_EDGES}, every AS (SELECT src, dst, 'imports' AS kind FROM imports UNION ALL SELECT path_a, path_b, 'cochange' FROM edges WHERE path_a IN (SELECT path FROM part_files) AND path_b IN (SELECT path FROM part_files))
SELECT (SELECT count(DISTINCT node) FROM (SELECT src AS node FROM every UNION ALL SELECT dst FROM every)) AS nodes, count(*) AS edges, count(*) FILTER (kind = 'imports') AS import_edges, count(*) FILTER (kind = 'cochange') AS cochange_edges FROM every""",
    "explain_pair": f"""WITH {_IMPORTS}, {_DEPENDENTS}, {_PART_FILES}, {_PART_EDGES}, {_EXPLAIN}
SELECT source, target, 'historical_cochange' AS type, {_REASON.format(seed='source')} AS detail, round(strength, 6) AS weight FROM pairs JOIN cochange ON seed = source AND path = target
UNION ALL SELECT source, target, 'import_edge', target || ' imports ' || source, weight FROM pairs JOIN importing ON seed = source AND path = target
UNION ALL SELECT source, target, 'import_edge', source || ' imports ' || target, weight FROM pairs JOIN importing ON seed = target AND path = source""",
    "stopword_filter": f"SELECT query_id, (pos - 1)::INT AS pos, ts[pos] AS token FROM (SELECT item_id AS query_id, ts, unnest(range(1, len(ts) + 1)) AS pos FROM (SELECT item_id, {_QUERY_TOKENS} AS ts FROM benchmark))",
    "embed_buckets": f"WITH {_DOCS}, {_vectors('docs', 'doc', 'body', 'dv')} SELECT doc, bucket, round(weight, 6) AS weight FROM dv",
    "hashed_cosine_topk": f"WITH {_DOCS}, {_WHOLE_COSINE} SELECT query_id, doc, score, rank::INT AS rank FROM cosine WHERE rank <= 10",
    "search_chunks": f"WITH {_DOCS}, {_CHUNK_COSINE} SELECT query_id, c.doc, symbol, start_line, md5(t) AS text_md5, score, rank::INT AS rank FROM cosine c JOIN keyed k ON k.doc = c.doc AND k.chunk = c.best WHERE rank <= 10",
    "bm25_stats": f"WITH {_DOCS}, {_BM25} SELECT term, df, cf, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 6) AS idf FROM terms, sizes",
    "bm25_topk": f"WITH {_DOCS}, {_BM25} SELECT query_id, doc, score, rank::INT AS rank FROM bm25 WHERE rank <= 10",
    "fused_search": f"WITH {_FUSED} SELECT query_id, doc, path, score, signals, rank::INT AS rank FROM best",
    "predict_impact": f"""WITH {_FUSED}, direct AS (SELECT query_id, CASE WHEN test THEN 'test' ELSE 'file' END AS section, path, least(score / max(score) OVER (PARTITION BY query_id), 1.0) AS confidence, 'matches the task' AS reason FROM best),
raw AS (SELECT DISTINCT o_orderkey, path AS file FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN docs ON doc = l_partkey), {_edges(files='raw')},
near AS (SELECT *, row_number() OVER (PARTITION BY path_a ORDER BY strength DESC, path_b) AS r FROM edges QUALIFY r <= 5),
found AS (SELECT d.query_id, path_b AS path, path_a, n, total, strength, row_number() OVER (PARTITION BY d.query_id, path_b ORDER BY strength DESC, path_a) AS pick
  FROM direct d JOIN near ON path = path_a WHERE section = 'file' AND (d.query_id, path_b) NOT IN (SELECT (query_id, path) FROM direct WHERE section = 'file') QUALIFY pick = 1),
more AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY strength DESC, path) AS place FROM found QUALIFY place <= 8)
SELECT query_id, section, path, round(confidence, 6) AS confidence, reason FROM direct
UNION ALL SELECT query_id, 'cochange', path, round(strength, 6), {_REASON.format(seed='path_a')} FROM more""",
    "payload_tokens": f"""WITH {_DOCS}, {_BM25}, returned AS (SELECT query_id, floor(sum(length(substr(body, 1, 400))) / 4)::BIGINT AS returned_tokens FROM bm25 JOIN docs USING (doc) WHERE rank <= 8 GROUP BY 1),
hits AS (SELECT DISTINCT query_id, doc FROM asked JOIN postings USING (term)), reading AS (SELECT query_id, floor(sum(size_bytes) / 4)::BIGINT AS read_tokens FROM hits JOIN docs USING (doc) GROUP BY 1)
SELECT query_id, returned_tokens, read_tokens FROM returned JOIN reading USING (query_id)""",
    "rank_random": f"""WITH {_DOCS}, asked AS (SELECT * FROM (VALUES (1, 'retry webhook'), (2, 'cancel refund')) t(query_id, text)), hashed AS (SELECT query_id, path, {_fnv('text || path')} AS h FROM docs, asked)
SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY h, path)::INT AS rank FROM hashed QUALIFY rank <= 20""",
    "symbol_exact": f"""WITH {_SYMBOLS}, {_SYMBOL_QUERIES}, words AS (SELECT query_id, unnest(ws) AS w, unnest(range(len(ws))) AS k FROM (SELECT query_id, string_split_regex(text, '[^a-zA-Z0-9_.]+') AS ws FROM symbol_queries)),
spellings AS (SELECT query_id, k * 2 AS k, w FROM words UNION ALL SELECT query_id, k * 2 + 1, string_split(w, '.')[-1] FROM words),
names AS (SELECT query_id, lower(w) AS name, min(k) AS k FROM spellings WHERE len(w) >= 3 AND (contains(w, '_') OR w <> lower(w)) GROUP BY ALL),
placed AS (SELECT query_id, name, (row_number() OVER (PARTITION BY query_id ORDER BY k) - 1)::INT AS seq FROM names)
SELECT query_id, seq, p.name, kind, path, start_line, row_number() OVER (PARTITION BY query_id, seq ORDER BY s.name, path, start_line)::INT AS rank FROM placed p JOIN symbols s ON lower(s.name) = p.name QUALIFY rank <= 5""",
    "symbol_substring": f"""WITH {_SYMBOLS}, {_SYMBOL_QUERIES}, tokens AS (SELECT DISTINCT query_id, unnest({_QUERY_TOKENS}) AS token FROM symbol_queries)
SELECT query_id, token, name, kind, path, start_line, row_number() OVER (PARTITION BY query_id, token ORDER BY name, path, start_line)::INT AS rank FROM tokens JOIN symbols ON contains(lower(name), token) QUALIFY rank <= 3""",
    "evidence_packets": f"""WITH {_SYMBOLS}, {_SYMBOL_QUERIES}, benchmark AS (SELECT query_id::BIGINT AS item_id, text FROM symbol_queries), {_FUSED},
tokens AS (SELECT query_id, token, min(k) AS seq FROM (SELECT query_id, unnest(ts) AS token, unnest(range(len(ts))) AS k FROM (SELECT query_id, {_QUERY_TOKENS} AS ts FROM symbol_queries)) GROUP BY ALL),
by_token AS (SELECT t.query_id, seq, s.name, path, start_line, row_number() OVER (PARTITION BY t.query_id, seq ORDER BY s.name, path, start_line) AS r FROM tokens t JOIN symbols s ON contains(lower(s.name), token) QUALIFY r <= 5),
own AS (SELECT query_id, path, arg_min(name, (seq, r)) AS symbol FROM by_token GROUP BY ALL),
words AS (SELECT query_id, unnest(ws) AS w, unnest(range(len(ws))) AS k FROM (SELECT query_id, string_split_regex(text, '[^a-zA-Z0-9_.]+') AS ws FROM symbol_queries)),
spellings AS (SELECT query_id, k * 2 AS k, w FROM words UNION ALL SELECT query_id, k * 2 + 1, string_split(w, '.')[-1] FROM words),
names AS (SELECT query_id, lower(w) AS name, min(k) AS k FROM spellings WHERE len(w) >= 3 AND (contains(w, '_') OR w <> lower(w)) GROUP BY ALL),
exact AS (SELECT n.query_id, k, s.name, path, row_number() OVER (PARTITION BY n.query_id, k ORDER BY s.name, path, start_line) AS r FROM names n JOIN symbols s ON lower(s.name) = n.name QUALIFY r <= 5),
first AS (
  SELECT b.query_id, 0 AS stage, b.rank AS a, 0 AS b, b.path, coalesce(k.symbol, o.symbol) AS symbol,
    CASE WHEN k.symbol IS NOT NULL THEN k.symbol || ' in ' || b.path || ':' || k.start_line WHEN o.symbol IS NOT NULL THEN o.symbol || ' in ' || b.path ELSE b.path END AS title,
    md5(coalesce(CASE WHEN k.symbol IS NOT NULL THEN k.t WHEN o.symbol IS NOT NULL THEN NULL ELSE substr(d.body, 1, 400) END, '')) AS snippet_md5, b.score, b.signals AS signal,
    CASE WHEN b.test THEN 'test' WHEN coalesce(k.symbol, o.symbol) IS NOT NULL THEN 'symbol' ELSE 'existing_code' END AS type
  FROM best b JOIN docs d USING (doc) LEFT JOIN own o ON o.query_id = b.query_id AND o.path = b.path LEFT JOIN keyed k ON k.doc = b.doc AND k.chunk = b.best_chunk AND k.symbol IS NOT NULL
), later AS (
  SELECT e.query_id, 1 AS stage, k AS a, r AS b, path, name AS symbol, coalesce(top, 0) + 1.5 AS score, 'symbol_exact' AS signal FROM exact e LEFT JOIN (SELECT query_id, max(score) AS top FROM first GROUP BY 1) t USING (query_id)
  UNION ALL SELECT query_id, 2, seq, r, path, name, 1.5, 'symbol' FROM by_token WHERE r <= 3
), once AS (
  SELECT l.* FROM later l LEFT JOIN first f ON f.query_id = l.query_id AND f.symbol = l.symbol WHERE f.query_id IS NULL QUALIFY row_number() OVER (PARTITION BY l.query_id, l.symbol ORDER BY l.stage, l.a, l.b) = 1
), every AS (
  SELECT * FROM first UNION ALL SELECT query_id, stage, a, b, path, symbol, symbol || ' in ' || path, md5(''), score, signal, 'symbol' FROM once
)
SELECT query_id::BIGINT AS query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, stage, a, b)::INT AS rank, type, path, symbol, title, snippet_md5, round(score, 6) AS score, signal FROM every QUALIFY rank <= 11""",
    "dense_vector_topk": f"WITH {_DENSE} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM scores WHERE id <> query_id QUALIFY rank <= 10",
    "vector_maxpool": f"WITH {_DENSE} SELECT query_id, grp, score, id AS best FROM scores QUALIFY row_number() OVER (PARTITION BY query_id, grp ORDER BY score DESC, id) = 1",
    "vector_cache_reuse": f"SELECT {_DOC_PATH} AS path, md5(text) AS hash, coalesce(quality = 1, false) AS reused FROM documents LEFT JOIN labels USING (doc_id)",
    "recall_mrr_vector": f"""WITH {_DENSE}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scores WHERE id <> query_id),
per AS (SELECT query_id, count(*) FILTER (grp = query_label) AS n, count(*) FILTER (grp = query_label AND rank <= 5) AS h5, count(*) FILTER (grp = query_label AND rank <= 10) AS h10, count(*) FILTER (grp = query_label AND rank <= 20) AS h20, min(rank) FILTER (grp = query_label AND rank <= 20) AS first FROM ranked GROUP BY 1)
SELECT count(*) AS queries, round(avg(h5 / n), 6) AS recall_5, round(avg(h10 / n), 6) AS recall_10, round(avg(h20 / n), 6) AS recall_20, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM per WHERE n > 0""",
    "recall_by_mode": f"""WITH asked_docs AS (SELECT doc_id AS item_id, coalesce(regexp_extract(text, '^[^.!?\\n]*'), '') AS text FROM documents WHERE doc_id % 20 = 0),
{_FUSED.replace('benchmark', 'asked_docs').replace('rank <= 8', 'rank <= 20')},
same AS (SELECT doc, md5(coalesce(body, '')) AS digest FROM docs), relevant AS (SELECT q.doc AS query_id, d.doc FROM same q JOIN same d USING (digest) WHERE q.doc % 20 = 0),
rankings AS (SELECT 'bm25' AS mode, query_id, doc, rank FROM bm25 WHERE rank <= 20 UNION ALL SELECT 'vector', query_id, doc, rank FROM cosine WHERE rank <= 20 UNION ALL SELECT 'hybrid', query_id, doc, rank FROM best),
per AS (SELECT m.mode, r.query_id, count(*) AS n, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, count(*) FILTER (rank <= 20) AS h20, min(rank) AS first
  FROM relevant r CROSS JOIN (VALUES ('bm25'), ('vector'), ('hybrid')) m(mode) LEFT JOIN rankings k ON k.mode = m.mode AND k.query_id = r.query_id AND k.doc = r.doc GROUP BY ALL)
SELECT mode, count(*) AS queries, round(avg(h5 / n), 6) AS recall_5, round(avg(h10 / n), 6) AS recall_10, round(avg(h20 / n), 6) AS recall_20, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM per GROUP BY mode""",
    "recall_combined": f"""WITH {_files('l_suppkey')}, {_OLDER}, {_edges(files='older')},
near AS (SELECT *, row_number() OVER (PARTITION BY path_a ORDER BY strength DESC, path_b) AS r FROM edges QUALIFY r <= 5),
sizes AS (SELECT o_orderkey, min(file) AS anchor FROM files WHERE o_orderkey IN (SELECT o_orderkey FROM newest) GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8),
samples AS (SELECT o_orderkey, anchor, file FROM sizes JOIN files USING (o_orderkey) WHERE file <> anchor),
imports AS (SELECT s_suppkey AS src, s_nationkey + 1 AS dst FROM supplier WHERE s_suppkey <> s_nationkey + 1),
hop1 AS (SELECT DISTINCT dst AS seed, src AS item FROM imports), hop2 AS (SELECT DISTINCT h.seed, i.src AS item FROM hop1 h JOIN imports i ON i.dst = h.item),
dep AS (SELECT seed, item, min(hops) AS hops FROM (SELECT *, 1 AS hops FROM hop1 UNION ALL SELECT *, 2 FROM hop2) WHERE item <> seed GROUP BY ALL),
imp AS (SELECT d.seed, d.item, row_number() OVER (PARTITION BY d.seed ORDER BY hops, d.item) AS place FROM dep d LEFT JOIN near n ON n.path_a = d.seed AND n.path_b = d.item WHERE n.path_a IS NULL QUALIFY place <= 8),
lists AS (SELECT path_a AS seed, path_b AS item, r, r AS place, 'co' AS kind FROM near UNION ALL SELECT i.seed, i.item, i.place, i.place + coalesce(c.n, 0), 'imp' FROM imp i LEFT JOIN (SELECT path_a, count(*) AS n FROM near GROUP BY 1) c ON c.path_a = i.seed),
per AS (SELECT s.o_orderkey, s.anchor, count(DISTINCT s.file) AS n, count(*) FILTER (kind = 'co' AND r <= 5) AS co, count(*) FILTER (kind = 'imp' AND r <= 5) AS imp, count(*) FILTER (place <= 10) AS both_lists, count(l.item) AS hits
  FROM samples s LEFT JOIN lists l ON l.seed = s.anchor AND l.item = s.file GROUP BY ALL),
given AS (SELECT seed, count(*) AS c FROM lists GROUP BY 1)
SELECT count(*) AS samples, round(avg(co / n), 6) AS cochange_recall_5, round(avg(imp / n), 6) AS import_recall_5, round(avg(both_lists / n), 6) AS combined_recall_10,
  round(avg((hits > 0)::INT), 6) AS hit_rate, round(avg(n), 6) AS mean_targets, round(avg(coalesce(c, 0)), 6) AS mean_candidates FROM per LEFT JOIN given ON seed = anchor""",
    "recall_cochange": f"""WITH {_files('l_suppkey')}, {_OLDER}, {_edges(files='older')},
near AS (SELECT *, row_number() OVER (PARTITION BY path_a ORDER BY strength DESC, path_b) AS r FROM edges QUALIFY r <= 10),
sizes AS (SELECT o_orderkey, min(file) AS anchor FROM files WHERE o_orderkey IN (SELECT o_orderkey FROM newest) GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8),
samples AS (SELECT o_orderkey, anchor, file FROM sizes JOIN files USING (o_orderkey) WHERE file <> anchor),
per AS (SELECT s.o_orderkey, count(*) AS n, count(*) FILTER (r <= 5) AS h5, count(r) AS h10, min(r) AS first FROM samples s LEFT JOIN near ON path_a = anchor AND path_b = file GROUP BY 1),
cands AS (SELECT o_orderkey, count(*) AS c FROM sizes JOIN near ON path_a = anchor GROUP BY 1)
SELECT count(*) AS samples, round(avg(h5 / n), 6) AS recall_5, round(avg(h10 / n), 6) AS recall_10, round(avg((first IS NOT NULL)::INT), 6) AS hit_rate, round(avg(n), 6) AS mean_targets, round(avg(coalesce(c, 0)), 6) AS mean_candidates FROM per LEFT JOIN cands USING (o_orderkey)""",
    "review_join": f"WITH {_COMMENTS} SELECT * FROM comments",
    "review_rank": f"""WITH {_COMMENTS}, history AS (SELECT pr_number * 1000 + line AS id, body FROM comments), {_vectors('history', 'id', 'body', 'dv')}, {_vectors('benchmark', 'item_id', 'text', 'qv')}, {_cosine('dv', 'id')}
SELECT query_id, id, score, rank::INT AS rank FROM cosine WHERE rank <= 10""",
    "correction_attribution": """SELECT u.conv_id AS pr_number, u.turn AS id, u.turn AS created_at, coalesce('c' || min(a.turn), '') AS next_sha, coalesce(min(a.turn), -1) AS next_at
FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.role = 'assistant' AND a.turn > u.turn WHERE u.role = 'user' GROUP BY u.conv_id, u.turn""",
    "json_ingest": "SELECT event_id, event_type, (props ->> '$.k')::BIGINT AS k FROM events",
    "payload_ingest": "SELECT conv_id AS pr_number, 'conv/' || conv_id AS path, turn AS line, text AS body, role AS author, '' AS created_at, '' AS diff_hunk, '' AS commit_id FROM conversations",
    "verification_plan": f"""WITH {_DOCS}, {_profile_rows()}, matched AS (SELECT DISTINCT source AS change_set, name, a FROM docs JOIN profiles ON regexp_matches(path, rx)),
listed AS (SELECT change_set, c.text, c.a, c.b FROM matched JOIN checks c USING (a) QUALIFY row_number() OVER (PARTITION BY change_set, c.text ORDER BY c.a, c.b) = 1)
SELECT change_set, 'profile' AS kind, name AS text, a::BIGINT AS a, 0::BIGINT AS b FROM matched UNION ALL SELECT change_set, 'check', text, a, b FROM listed""",
    "upsert_latest": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id",
    "upsert_merge": """WITH fresh AS (SELECT doc_id + 7 AS doc_id FROM labels)
SELECT coalesce(f.doc_id, d.doc_id) AS doc_id, CASE WHEN f.doc_id IS NOT NULL THEN 'new' ELSE source END AS source, d.doc_id IS NOT NULL AS done, CASE WHEN f.doc_id IS NOT NULL THEN 0 ELSE n_chars END AS n_chars FROM documents d FULL JOIN fresh f ON d.doc_id = f.doc_id""",
    "prune_missing": "SELECT source, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS kept, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS pruned FROM documents GROUP BY source",
    "replace_rows": "WITH good AS (SELECT doc_id FROM labels WHERE quality = 1) SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM good) UNION ALL SELECT doc_id, 'labelled' FROM good",
    "recency_update": "SELECT doc_id, coalesce(epoch(o_orderdate)::BIGINT, 0) AS ts FROM documents LEFT JOIN orders ON o_orderkey = doc_id",
    "schema_migration": "SELECT doc_id, quality::BIGINT AS quality, false AS reviewed, '' AS note FROM labels",
    "event_routing": f"""WITH placed AS (SELECT event_id, CASE event_type WHEN 'click' THEN '.git/HEAD' WHEN 'view' THEN '.git/objects/a1' WHEN 'purchase' THEN 'node_modules/x.js' ELSE 'src/' || {_name('user_id')} END AS path,
  ['create', 'modify', 'remove', 'access'][event_id % 4 + 1] AS kind FROM events)
SELECT event_id, path, kind, CASE WHEN path = '.git/HEAD' THEN 'head' ELSE 'file' END AS route FROM placed WHERE kind <> 'access' AND (path = '.git/HEAD' OR starts_with(path, 'src/'))""",
    "request_payloads": """WITH made AS (SELECT *, 't' || turn AS sha, CASE WHEN role = 'assistant' THEN 't' || turn ELSE '' END AS m FROM conversations)
SELECT 'request' AS kind, conv_id::VARCHAR AS c0, coalesce(text, '') AS c1, (m <> '')::VARCHAR AS c2, coalesce(role, '') AS c3, m AS c4 FROM made
UNION ALL SELECT 'file', conv_id::VARCHAR, 'f/' || sha, turn::VARCHAR, '0', m FROM made
UNION ALL SELECT 'commit', conv_id::VARCHAR, sha, coalesce(text, ''), m, '0' FROM made""",
    "stream_latest": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "stream_change_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS kind, count(*) AS n FROM events GROUP BY ALL",
}
