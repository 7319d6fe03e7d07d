"""DuckDB oracle SQL for the registered queries.

``regexp_split_to_array`` + parallel ``unnest``, the function state machine as running
window sums, ``arg_min``/``arg_max`` over list positions for first/last wins.
The driver tables are views named ``part``, ``pages``, ... .
"""
from __future__ import annotations

F1 = """f1 AS (
 WITH p AS (
  SELECT p_partkey, p_size, lower(replace(p_brand,'#','')) AS repo_id,
   CASE WHEN p_partkey % 40 = 0 THEN concat('pkg_', cast(p_partkey AS varchar(20)), '/__init__.py')
        WHEN p_partkey % 40 = 1 THEN concat('pkg_', cast(p_partkey AS varchar(20)), '/main.py')
        ELSE concat(lower(p_type), '/mod_', cast(p_partkey AS varchar(20)), '.py') END AS path
  FROM part),
 q AS (SELECT *, lead(path) OVER (PARTITION BY repo_id ORDER BY p_partkey) AS nxt FROM p)
 SELECT p_partkey, repo_id, path,
  concat('import os', chr(10),
    'import lib', cast(p_size % 7 AS varchar(20)), chr(10),
    CASE WHEN nxt IS NULL THEN 'import json'
         ELSE concat('import ', replace(replace(nxt,'.py',''),'/','.')) END, chr(10),
    'class C', cast(p_partkey % 9 AS varchar(20)), '(Base', cast(p_size % 5 AS varchar(20)), ', object):', chr(10),
    '    def run(self): pass', chr(10),
    '    def load_', cast(p_size AS varchar(20)), '(self, x):', chr(10),
    repeat(concat('        if x and helper_', cast(p_size % 4 AS varchar(20)), '(x):', chr(10)), p_size),
    'def helper_', cast(p_size % 4 AS varchar(20)), '(x):', chr(10),
    '    return run(x)', chr(10)) AS content
 FROM q)"""

# Lines: split on the splitlines() break set, drop one trailing empty piece, strip.
LINES = """sl_parts AS (
 SELECT repo_id, path, regexp_split_to_array(content, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS a
 FROM f1 WHERE suffix(path, '.py')),
sl_trim AS (
 SELECT repo_id, path, CASE WHEN a[len(a)] = '' THEN a[1:len(a)-1] ELSE a END AS a FROM sl_parts),
lines AS (
 SELECT repo_id, path, unnest(generate_series(1, len(a))) AS n, unnest(a) AS raw FROM sl_trim),
sl AS (
 SELECT repo_id, path, cast(n AS integer) AS n, raw,
        regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line FROM lines)"""

# Per-line classification and extracted names.
FEATS = """ft0 AS (
 SELECT *, CASE WHEN starts_with(line, 'class ') THEN 'class'
                WHEN starts_with(line, 'def ') THEN 'def'
                WHEN starts_with(line, 'import ') THEN 'import'
                WHEN starts_with(line, 'from ') THEN 'from'
                ELSE 'body' END AS kind,
        split_part(line, 'class ', 2) AS cpart,
        CASE WHEN instr(line, '):') > 0 THEN trim(substr(line, instr(line, '):') + 2)) ELSE '' END AS rest
 FROM sl),
ft AS (
 SELECT repo_id, path, n, kind, line,
  CASE WHEN kind = 'class' THEN (CASE WHEN contains(cpart, '(') THEN split_part(cpart, '(', 1)
                                      ELSE split_part(cpart, ':', 1) END) END AS cname,
  CASE WHEN kind = 'class' AND contains(cpart, '(') THEN
     list_filter(list_transform(string_split(split_part(split_part(cpart, '(', 2), ')', 1), ','), lambda x: trim(x)),
                 lambda x: x <> '' AND x <> 'object') END AS bases,
  CASE WHEN kind = 'def' THEN split_part(split_part(line, 'def ', 2), '(', 1) END AS dname,
  CASE WHEN kind = 'import' THEN coalesce(regexp_extract(split_part(line, 'import ', 2), '^\\s*(\\S+)', 1), '')
       WHEN kind = 'from' THEN trim(split_part(split_part(line, 'from ', 2), ' import', 1)) END AS module,
  CASE WHEN kind = 'def' THEN rest <> '' ELSE kind = 'body' END AS cand,
  CASE WHEN kind = 'def' THEN regexp_matches(rest, 'if |elif |for |while | and | or | except ')
       ELSE kind = 'body' AND regexp_matches(line, 'if |elif |for |while | and | or | except ') END AS br
 FROM ft0)"""

# The function state machine: segments start at def lines; a class line closes the open
# function when the segment already has a body line.
FUNCS = """w1 AS (
 SELECT *, sum(CASE WHEN kind = 'def' THEN 1 ELSE 0 END) OVER fw AS seg FROM ft
 WINDOW fw AS (PARTITION BY repo_id, path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
w2 AS (
 SELECT *, sum(CASE WHEN seg > 0 AND cand THEN 1 ELSE 0 END)
            OVER (PARTITION BY repo_id, path, seg ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nb
 FROM w1),
w3 AS (
 SELECT *, kind = 'class' AND seg > 0 AND nb > 0 AS closer FROM w2),
w4 AS (
 SELECT *, coalesce(bool_or(closer) OVER (PARTITION BY repo_id, path, seg ORDER BY n
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS closed FROM w3),
fseg AS (
 SELECT repo_id, path, seg, max(dname) AS name,
        count(*) FILTER (WHERE cand AND NOT closed) AS body_lines,
        1 + count(*) FILTER (WHERE cand AND NOT closed AND br) AS complexity,
        min(n) FILTER (WHERE closer) AS close_n, max(n) AS last_n
 FROM w4 WHERE seg > 0 GROUP BY repo_id, path, seg),
funcs AS (
 SELECT repo_id, path, name, cast(complexity AS integer) AS complexity, body_lines,
        CASE WHEN close_n IS NOT NULL THEN [close_n, 0, 0, 0] ELSE [last_n, 2, 0, 0] END AS pos
 FROM fseg WHERE body_lines > 0 AND name <> '')"""

SYMS = """imps AS (
 SELECT repo_id, path, n, module FROM ft WHERE kind = 'from' OR (kind = 'import' AND module <> '')),
bases AS (
 SELECT repo_id, path, n, cname, unnest(generate_series(1, len(bases))) - 1 AS i, unnest(bases) AS base
 FROM ft WHERE kind = 'class'),
syms AS (
 SELECT repo_id, path, pos, name, 'function' AS kind, complexity FROM funcs
 UNION ALL SELECT repo_id, path, [n, 1, 0, 0], cname, 'class', 1 FROM ft WHERE kind = 'class'
 UNION ALL SELECT repo_id, path, [n, 1, 0, 0], split_part(module, '.', 1), 'module', 1 FROM imps),
ends AS (
 SELECT repo_id, path, [2147483647, 1, n, 2 * i] AS pos, cname AS name, 'class' AS kind, cast(NULL AS integer) AS complexity FROM bases
 UNION ALL SELECT repo_id, path, [2147483647, 1, n, 2 * i + 1], base, 'class', cast(NULL AS integer) FROM bases),
nodes AS (
 SELECT repo_id, path AS file, name, arg_min(kind, pos) AS kind,
        coalesce(arg_max(complexity, pos) FILTER (WHERE complexity IS NOT NULL), 1) AS complexity,
        min(pos) AS pos
 FROM (SELECT * FROM syms UNION ALL SELECT * FROM ends) GROUP BY repo_id, path, name),
edges AS (
 SELECT repo_id, path AS file, concat(path, ':', cname) AS source, concat(path, ':', base) AS target, 'inherits' AS type FROM bases
 UNION ALL SELECT repo_id, path, path, module, 'imports' FROM imps)"""

BASE = [F1, LINES, FEATS, FUNCS, SYMS]


# the files of F1 strung together, read as whole files.
LONG = F1.replace("f1 AS (", "short AS (", 1) + """,
f1 AS (SELECT repo_id, concat('long/m', cast(p_partkey // 1000 AS varchar(20)), '.py') AS path,
              string_agg(content, '' ORDER BY p_partkey) AS content FROM short GROUP BY repo_id, p_partkey // 1000)"""


def q(body: str, *extra: str) -> str:
    return "WITH " + ",\n".join(BASE + list(extra)) + "\n" + body



F3 = """f3r AS (SELECT DISTINCT lower(replace(p_brand,'#','')) AS repo_id,
                  cast(replace(p_brand,'Brand#','') AS int) AS k FROM part),
f3 AS (
 SELECT repo_id, path FROM f1
 UNION ALL SELECT repo_id, 'README.md' AS path FROM f3r WHERE k % 2 = 0
 UNION ALL SELECT repo_id, 'README.rst' FROM f3r WHERE k % 3 = 0
 UNION ALL SELECT repo_id, 'README.txt' FROM f3r WHERE k % 5 = 0
 UNION ALL SELECT repo_id, 'requirements.txt' FROM f3r WHERE k % 4 = 0
 UNION ALL SELECT repo_id, 'setup.py' FROM f3r WHERE k % 3 = 0
 UNION ALL SELECT repo_id, 'pyproject.toml' FROM f3r WHERE k % 2 = 1
 UNION ALL SELECT repo_id, 'docs/setup.py' FROM f3r
 UNION ALL SELECT repo_id, 'venv/lib/app.py' FROM f3r
 UNION ALL SELECT repo_id, 'tools/cli.py' FROM f3r WHERE k % 6 = 0)"""

F5 = """f5 AS (
 SELECT 'tpch' AS repo_id, 'supplier' AS file, concat('supplier:', cast(l_suppkey AS varchar)) AS source,
        concat('part:', cast(l_partkey AS varchar)) AS target, 'calls' AS type FROM lineitem
 UNION ALL SELECT 'tpch', 'customer', concat('customer:', cast(c_custkey AS varchar)),
        concat('nation:', cast(c_nationkey AS varchar)), 'inherits' FROM customer
 UNION ALL SELECT 'tpch', 'nation', concat('nation:', cast(n_nationkey AS varchar)),
        concat('region:', cast(n_regionkey AS varchar)), 'imports' FROM nation)"""

IGN = "['.git', '__pycache__', 'node_modules', '.venv', 'venv', '.mypy_cache']"
EPN = "('main.py', 'app.py', '__main__.py', '__init__.py', 'cli.py', 'server.py', 'run.py', 'manage.py')"
STD = ("('os', 'sys', 're', 'json', 'time', 'datetime', 'collections', 'itertools', 'functools', "
       "'pathlib', 'typing', 'abc', 'enum', 'logging', 'argparse', 'configparser', 'io', 'shutil', "
       "'subprocess', 'threading', 'multiprocessing', 'asyncio', 'contextlib', 'traceback', "
       "'unittest', 'pytest', 'math', 'random', 'string', 'copy', 'pickle')")

TREE = f"""tr0 AS (
 SELECT repo_id, path, string_split(path, '/') AS s FROM f3),
tr1 AS (
 SELECT * FROM tr0 WHERE NOT list_has_any(s[1:len(s)-1], {IGN})),
tr2 AS (
 SELECT DISTINCT repo_id, array_to_string(s[1:i], '/') AS path, i AS depth, i = len(s) AS is_file
 FROM (SELECT repo_id, s, unnest(generate_series(1, len(s))) AS i FROM tr1)),
tr3 AS (
 SELECT repo_id, path, is_file, depth, string_split(path, '/') AS s FROM tr2),
tree AS (
 SELECT repo_id, path, CASE WHEN is_file THEN 'file' ELSE 'dir' END AS type, cast(depth AS integer) AS depth,
  array_to_string(list_transform(generate_series(1, len(s)), lambda j: concat(
     CASE WHEN j = len(s) AND is_file THEN '1' ELSE '0' END, lower(s[j]), chr(1), s[j], chr(1))), '') AS sort_key
 FROM tr3
 UNION ALL SELECT DISTINCT repo_id, '.', 'dir', 0, '' FROM f3),
ep AS (
 SELECT repo_id, path, sort_key FROM tree WHERE type = 'file' AND string_split(path, '/')[-1] IN {EPN})"""

# seeds: entry points, or all pruned .py files of repos without one; graph parts of all files
SEED = f"""seed AS (
 SELECT repo_id, path, true AS from_entry FROM ep
 UNION ALL
 SELECT repo_id, path, false FROM f1
 WHERE suffix(path, '.py') AND NOT list_has_any(string_split(path,'/')[1:len(string_split(path,'/'))-1], {IGN})
   AND repo_id NOT IN (SELECT repo_id FROM ep)),
snodes AS (SELECT * FROM nodes WHERE (repo_id, file) IN (SELECT repo_id, path FROM seed)),
sedges AS (SELECT * FROM edges WHERE (repo_id, file) IN (SELECT repo_id, path FROM seed)),
amod AS (
 SELECT DISTINCT repo_id, replace(regexp_replace(file, '\\.py$', ''), '/', '.') AS module FROM snodes WHERE file <> ''),
imod AS (
 SELECT DISTINCT repo_id, split_part(target, ':', 1) AS module FROM sedges
 WHERE type = 'imports' AND split_part(target, ':', 1) <> ''),
cls0 AS (
 SELECT i.repo_id, i.module, ltrim(i.module, '.') AS base,
   EXISTS (SELECT 1 FROM amod a WHERE a.repo_id = i.repo_id AND
           (a.module = i.module OR a.module = ltrim(i.module, '.') OR ends_with(a.module, '.' || ltrim(i.module, '.')))) AS done,
   EXISTS (SELECT 1 FROM f3 f WHERE f.repo_id = i.repo_id AND f.path = replace(ltrim(i.module, '.'), '.', '/') || '.py') AS has_py,
   EXISTS (SELECT 1 FROM f3 f WHERE f.repo_id = i.repo_id AND f.path = replace(ltrim(i.module, '.'), '.', '/') || '/__init__.py') AS has_init
 FROM imod i),
cls AS (
 SELECT repo_id, module,
  CASE WHEN base = '' THEN 'skipped' WHEN done THEN 'analyzed'
       WHEN split_part(module, '.', 1) IN {STD} THEN 'stdlib'
       WHEN starts_with(module, '.') OR starts_with(module, repo_id) OR has_py OR has_init THEN 'internal'
       ELSE 'external' END AS class,
  CASE WHEN NOT (base = '' OR done OR split_part(module, '.', 1) IN {STD})
            AND (starts_with(module, '.') OR starts_with(module, repo_id) OR has_py OR has_init)
       THEN (CASE WHEN has_py THEN replace(base, '.', '/') || '.py'
                  WHEN has_init THEN replace(base, '.', '/') || '/__init__.py' END) END AS potential_file
 FROM cls0)"""


def _round(k: int) -> str:
    prev = f"r{k-1}"
    front = f"fr{k-1}"
    return f"""a{k} AS (
 SELECT DISTINCT r.repo_id, replace(regexp_replace(r.path, '\\.py$', ''), '/', '.') AS module
 FROM {prev} r WHERE (r.repo_id, r.path) IN (SELECT repo_id, file FROM nodes)),
m{k} AS (
 SELECT DISTINCT f.repo_id, i.module, ltrim(i.module, '.') AS base
 FROM {front} f JOIN imps2 i ON f.repo_id = i.repo_id AND f.path = i.path),
c{k} AS (
 SELECT m.repo_id,
   CASE WHEN EXISTS (SELECT 1 FROM f3 x WHERE x.repo_id = m.repo_id AND x.path = replace(m.base, '.', '/') || '.py')
        THEN replace(m.base, '.', '/') || '.py'
        WHEN EXISTS (SELECT 1 FROM f3 x WHERE x.repo_id = m.repo_id AND x.path = replace(m.base, '.', '/') || '/__init__.py')
        THEN replace(m.base, '.', '/') || '/__init__.py' END AS path
 FROM m{k} m
 WHERE m.base <> ''
   AND NOT EXISTS (SELECT 1 FROM a{k} a WHERE a.repo_id = m.repo_id AND
        (a.module = m.module OR a.module = m.base OR ends_with(a.module, '.' || m.base)))
   AND split_part(m.module, '.', 1) NOT IN {STD}),
fr{k} AS (
 SELECT DISTINCT repo_id, path FROM c{k} c WHERE path IS NOT NULL
   AND NOT EXISTS (SELECT 1 FROM {prev} r WHERE r.repo_id = c.repo_id AND r.path = c.path)),
r{k} AS (
 SELECT repo_id, path, rnd FROM {prev} UNION ALL SELECT repo_id, path, {k} FROM fr{k})"""


DISC = ("""imps2 AS (
 SELECT DISTINCT repo_id, file AS path, split_part(target, ':', 1) AS module FROM edges
 WHERE type = 'imports' AND split_part(target, ':', 1) <> ''),
r0 AS (SELECT DISTINCT repo_id, path, 0 AS rnd FROM seed),
fr0 AS (SELECT repo_id, path FROM r0),
""" + ",\n".join(_round(k) for k in (1, 2, 3)))


def q2(body: str, *extra: str) -> str:
    return "WITH " + ",\n".join(BASE + [F3, TREE, SEED] + list(extra)) + "\n" + body


def more_oracles() -> dict[str, str]:
    o = {}
    o["graph_stats"] = q(
        "SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(total_symbols, 0) AS total_symbols,"
        " coalesce(classes, 0) AS classes, coalesce(functions, 0) AS functions, coalesce(modules, 0) AS modules,"
        " coalesce(total_edges, 0) AS total_edges, coalesce(inheritance_edges, 0) AS inheritance_edges,"
        " coalesce(call_edges, 0) AS call_edges, coalesce(import_edges, 0) AS import_edges FROM"
        " (SELECT repo_id, count(*) AS total_symbols, count(*) FILTER (WHERE kind = 'class') AS classes,"
        "  count(*) FILTER (WHERE kind = 'function') AS functions, count(*) FILTER (WHERE kind = 'module') AS modules"
        "  FROM nodes GROUP BY repo_id) a FULL OUTER JOIN"
        " (SELECT repo_id, count(*) AS total_edges, count(*) FILTER (WHERE type = 'inherits') AS inheritance_edges,"
        "  count(*) FILTER (WHERE type = 'calls') AS call_edges, count(*) FILTER (WHERE type = 'imports') AS import_edges"
        "  FROM edges GROUP BY repo_id) b ON a.repo_id = b.repo_id")
    o["doc_stats"] = q(
        "SELECT n.repo_id, total_nodes, total_edges, classes, functions, modules, call_edges, inherit_edges, import_edges FROM"
        " (SELECT repo_id, count(*) AS total_nodes, count(*) FILTER (WHERE kind = 'class') AS classes,"
        "  count(*) FILTER (WHERE kind = 'function') AS functions, count(*) FILTER (WHERE kind = 'module') AS modules"
        "  FROM nodes GROUP BY repo_id) n JOIN"
        " (SELECT repo_id, count(*) AS total_edges, count(*) FILTER (WHERE type = 'inherits') AS inherit_edges,"
        "  count(*) FILTER (WHERE type = 'calls') AS call_edges, count(*) FILTER (WHERE type = 'imports') AS import_edges"
        "  FROM edges GROUP BY repo_id) e ON n.repo_id = e.repo_id")
    o["call_hotspots"] = "WITH " + F5 + """
SELECT repo_id, rank, target, split_part(target, ':', -1) AS func_name, calls FROM (
 SELECT repo_id, target, count(*) AS calls,
        row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, target) AS rank
 FROM f5 WHERE type = 'calls' GROUP BY repo_id, target) WHERE rank <= 10"""
    o["base_classes"] = q("SELECT DISTINCT repo_id, target AS base FROM edges WHERE type = 'inherits'")
    o["distinct_imports"] = q(
        "SELECT DISTINCT repo_id, split_part(target, ':', 1) AS module FROM edges"
        " WHERE type = 'imports' AND split_part(target, ':', 1) <> ''")
    o["analyzed_modules"] = q(
        "SELECT DISTINCT repo_id, replace(regexp_replace(file, '\\.py$', ''), '/', '.') AS module FROM nodes WHERE file <> ''")
    o["classes_per_file"] = q(
        "SELECT repo_id, file_rank, file, class_rank, name FROM ("
        " SELECT repo_id, file, name, dense_rank() OVER (PARTITION BY repo_id ORDER BY file) AS file_rank,"
        "  row_number() OVER (PARTITION BY repo_id, file ORDER BY pos, name) AS class_rank"
        " FROM nodes WHERE kind = 'class') WHERE file_rank <= 10 AND class_rank <= 5")
    o["cap_nodes"] = q(
        "SELECT repo_id, rank, file, name, kind, complexity FROM ("
        " SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY file, pos, name) AS rank FROM nodes) WHERE rank <= 40")
    o["sort_by_complexity"] = q("SELECT repo_id, file, name, complexity FROM nodes WHERE kind = 'function'")
    o["calls_to"] = "WITH " + F5 + "\nSELECT repo_id, source FROM f5 WHERE type = 'calls' AND contains(target, 'part:7')"
    o["inherits_from"] = "WITH " + F5 + "\nSELECT repo_id, source FROM f5 WHERE type = 'inherits' AND contains(target, 'nation:1')"
    o["pattern_lookup"] = "WITH " + F5 + """
SELECT p.pattern, p.type, e.repo_id, e.source
FROM (SELECT DISTINCT concat('nation:', cast(n_nationkey AS varchar)) AS pattern, 'inherits' AS type FROM nation) p
JOIN f5 e ON e.type = p.type AND contains(e.target, p.pattern)"""
    o["file_tree"] = q2("SELECT repo_id, path, type, depth FROM tree")
    o["tree_order"] = q2("SELECT repo_id, path, sort_key FROM tree")
    o["tree_lines"] = q2(
        "SELECT repo_id, sort_key, concat(repeat('  ', depth), path, CASE WHEN type = 'dir' THEN '/' ELSE '' END) AS text FROM tree")
    o["entry_point_files"] = q2("SELECT repo_id, path FROM ep")
    o["entry_point_count"] = q2(
        "SELECT r.repo_id, cast(coalesce(c.n, 0) AS bigint) AS entry_points FROM (SELECT DISTINCT repo_id FROM tree) r"
        " LEFT JOIN (SELECT repo_id, count(*) AS n FROM ep GROUP BY repo_id) c ON r.repo_id = c.repo_id")
    o["package_flags"] = q2(
        "SELECT repo_id, bool_or(path = 'requirements.txt') AS has_requirements, bool_or(path = 'setup.py') AS has_setup_py,"
        " bool_or(path = 'pyproject.toml') AS has_pyproject FROM tree GROUP BY repo_id")
    o["package_manager"] = q2(
        "SELECT repo_id, CASE WHEN bool_or(path = 'requirements.txt') THEN 'requirements'"
        " WHEN bool_or(path = 'setup.py') THEN 'setup' WHEN bool_or(path = 'pyproject.toml') THEN 'pyproject'"
        " ELSE 'none' END AS package_manager FROM tree GROUP BY repo_id")
    o["readme_pick"] = q2(
        "SELECT repo_id, arg_min(path, CASE path WHEN 'README.md' THEN 1 WHEN 'README.rst' THEN 2 ELSE 3 END) AS readme"
        " FROM tree WHERE path IN ('README.md', 'README.rst', 'README.txt') GROUP BY repo_id")
    o["first_n_rows"] = q2(
        "SELECT repo_id, rank, path FROM (SELECT repo_id, path,"
        " row_number() OVER (PARTITION BY repo_id ORDER BY sort_key) AS rank FROM ep) WHERE rank <= 5")
    o["module_name_of_file"] = q2(
        "SELECT repo_id, path, replace(regexp_replace(path, '\\.py$', ''), '/', '.') AS module FROM f3")
    o["import_target_module"] = q("SELECT repo_id, file, split_part(target, ':', 1) AS module FROM edges WHERE type = 'imports'")
    di = "(SELECT DISTINCT repo_id, split_part(target, ':', 1) AS module FROM edges WHERE type = 'imports' AND split_part(target, ':', 1) <> '')"
    o["relative_import_base"] = q(f"SELECT repo_id, module, ltrim(module, '.') AS base FROM {di}")
    o["candidate_paths"] = q(
        f"SELECT repo_id, module, replace(ltrim(module, '.'), '.', '/') || '.py' AS cand_py,"
        f" replace(ltrim(module, '.'), '.', '/') || '/__init__.py' AS cand_init FROM {di} WHERE ltrim(module, '.') <> ''")
    o["discover_modules"] = q2("SELECT repo_id, path, rnd AS round FROM r3", DISC)
    o["discovery_rounds"] = q2(
        "SELECT repo_id, cast(least(max(rnd) + 1, 3) AS integer) AS discovery_rounds, count(*) AS files_reached"
        " FROM r3 GROUP BY repo_id", DISC)
    o["seed_choice"] = q2("SELECT repo_id, bool_or(from_entry) AS seeded_with_entry_points, count(*) AS seed_files"
                          " FROM seed GROUP BY repo_id")
    o["new_files_only"] = q2("SELECT repo_id, path, rnd AS round FROM r3 WHERE rnd >= 1", DISC)
    o["analyzed_update"] = q2("SELECT repo_id, path FROM r3", DISC)
    return o


F2 = """f2 AS (
 SELECT page_id AS req_id,
  CASE page_id % 12
   WHEN 0 THEN concat('https://github.com/org', cast(page_id % 7 AS varchar(20)), '/repo', cast(page_id AS varchar(20)), '.git')
   WHEN 1 THEN concat('  https://github.com/org1/repo', cast(page_id AS varchar(20)), '/tree/main//  ')
   WHEN 2 THEN 'https://github.com/onlyowner'
   WHEN 3 THEN concat('https://gitlab.com/g/sub/p', cast(page_id AS varchar(20)), '/')
   WHEN 4 THEN 'https://bitbucket.org'
   WHEN 5 THEN 'https://www.github.com/o/r'
   WHEN 6 THEN 'https://github.com/o!/r'
   WHEN 7 THEN ''
   WHEN 8 THEN NULL
   WHEN 9 THEN 'github.com/o/r'
   WHEN 10 THEN concat('https://github.com/me/my.github', cast(page_id AS varchar(20)))
   ELSE url END AS repo_url
 FROM pages),
u0 AS (
 SELECT req_id, repo_url, regexp_replace(regexp_replace(repo_url, '^\\s+|\\s+$', '', 'g'), '/+$', '') AS url FROM f2),
u1 AS (
 SELECT *, regexp_replace(regexp_replace(url, '[\\t\\r\\n]', '', 'g'), '^[A-Za-z][A-Za-z0-9+.-]*:', '') AS rest FROM u0),
u2 AS (
 SELECT *, regexp_extract(rest, '^//([^/?#]*)', 1) AS host FROM u1),
u3 AS (
 SELECT *, list_filter(string_split(regexp_extract(
           CASE WHEN starts_with(rest, '//') THEN substr(rest, length(host) + 3) ELSE rest END, '^([^?#]*)', 1), '/'),
           lambda x: x <> '') AS pieces FROM u2),
uc AS (
 SELECT req_id, url,
  CASE WHEN repo_url IS NULL OR repo_url = '' THEN 'empty'
       WHEN contains(host, '[') <> contains(host, ']') THEN 'format'
       WHEN host NOT IN ('github.com', 'gitlab.com', 'bitbucket.org') THEN 'host'
       WHEN host <> 'github.com' THEN 'ok_other'
       WHEN len(pieces) < 2 THEN 'form'
       WHEN NOT regexp_matches(pieces[1], '^[A-Za-z0-9_.-]+$')
         OR NOT regexp_matches(replace(pieces[2], '.git', ''), '^[A-Za-z0-9_.-]+$') THEN 'name'
       ELSE 'ok_github' END AS outcome, host, pieces
 FROM u3),
urls AS (
 SELECT req_id, outcome IN ('ok_other', 'ok_github') AS valid,
  CASE outcome WHEN 'empty' THEN 'URL must be a non-empty string'
               WHEN 'format' THEN 'Invalid URL format: Invalid IPv6 URL'
               WHEN 'host' THEN 'Unsupported host: ' || host || '. Supported: github.com, gitlab.com, bitbucket.org'
               WHEN 'form' THEN 'GitHub URL must be in format: https://github.com/owner/repo'
               WHEN 'name' THEN 'Invalid owner/repo name: ' || pieces[1] || '/' || pieces[2] END AS error,
  CASE outcome WHEN 'ok_other' THEN url
               WHEN 'ok_github' THEN 'https://github.com/' || pieces[1] || '/' || replace(pieces[2], '.git', '') END AS normalized_url
 FROM uc)"""


def url_oracles() -> dict[str, str]:
    o = {}
    w = "WITH " + F2 + "\n"
    o["validate_repo_url"] = w + "SELECT req_id, valid, error, normalized_url FROM urls"
    o["normalize_repo_url"] = w + "SELECT req_id, normalized_url FROM urls WHERE valid"
    o["url_error_message"] = w + "SELECT req_id, error FROM urls WHERE NOT valid"
    o["repo_name_from_url"] = w + ("SELECT req_id, replace(string_split(regexp_replace(normalized_url, '/+$', ''), '/')[-1],"
                                   " '.git', '') AS repo_name FROM urls WHERE valid")
    ws = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1c}-\\x{1f}\\x{0b}]"
    o["summarize_text"] = f"""WITH d AS (
 SELECT doc_id, source AS repo_id, text,
   regexp_replace(regexp_replace(text, '^{ws}+|{ws}+$', '', 'g'), '{ws}+', ' ', 'g') AS c FROM documents)
SELECT doc_id, repo_id, CASE WHEN text IS NULL OR text = '' THEN 'No README content found.'
  ELSE substring(c, 1, 500) || CASE WHEN length(c) > 500 THEN '...' ELSE '' END END AS summary FROM d"""
    o["escape_key"] = q("SELECT repo_id, replace(concat(file, ':', name), ':', '_COLON_') AS key FROM nodes")
    o["display_name"] = "WITH " + F5 + "\nSELECT repo_id, target, string_split(target, ':')[-1] AS name FROM f5"
    o["file_label"] = q2("SELECT repo_id, path, string_split(path, '/')[-1] AS label FROM f3")
    chk = ("checkout AS (SELECT f3.repo_id, f3.path, coalesce(f1.content, '') AS content FROM f3 "
           "LEFT JOIN f1 ON f3.repo_id = f1.repo_id AND f3.path = f1.path)")
    py = "regexp_matches(string_split(path, '/')[-1], '^.+\\.py$')"
    ign = f"list_has_any(string_split(path, '/')[1:len(string_split(path, '/'))-1], {IGN})"
    o["scan_source_files"] = q2(f"SELECT repo_id, path, length(content) AS chars FROM checkout WHERE {py} AND NOT {ign}", chk)
    o["scan_directory"] = o["scan_source_files"]
    # an invalid byte appended to the UTF-8 text is dropped by the tolerant decode
    o["decode_tolerant"] = "SELECT doc_id, replace(text, chr(65533), '') AS content FROM documents"
    o["prune_ignored_dirs"] = q2(f"SELECT repo_id, path FROM f3 WHERE NOT {ign}")
    o["scan_unpruned"] = q2(f"SELECT repo_id, path, length(content) AS chars FROM checkout WHERE {py}", chk)
    o["scan_file_list"] = q2(
        f"SELECT c.repo_id, c.path, length(c.content) AS chars FROM checkout c WHERE {py} "
        "AND (c.repo_id, c.path) IN (SELECT repo_id, path FROM ep)", chk)
    o["extension_filter"] = q2(f"SELECT repo_id, path FROM f3 WHERE {py}")
    o["graph_to_json"] = q("SELECT repo_id, 'node' AS list, to_json({'file': file, 'name': name, 'kind': kind, 'complexity': complexity})::VARCHAR AS json FROM nodes"
                           " UNION ALL SELECT repo_id, 'edge', to_json({'source': source, 'target': target, 'type': type})::VARCHAR FROM edges")
    o["load_base_graph"] = q("SELECT repo_id, file, name, kind, complexity FROM nodes")
    o["complexity_band"] = q(
        "SELECT repo_id, file, name, complexity, CASE WHEN complexity > 10 THEN 'red' WHEN complexity > 5 THEN 'yellow'"
        " ELSE 'lightgreen' END AS color FROM nodes WHERE kind = 'function'")
    o["node_style"] = q(
        "SELECT repo_id, replace(file || ':' || name, ':', '_COLON_') AS key, name || chr(10) || '(' || string_split(file, '/')[-1] || ')' AS label,"
        " CASE kind WHEN 'class' THEN 'box' WHEN 'function' THEN 'ellipse' ELSE 'note' END AS shape,"
        " CASE WHEN kind IN ('class', 'function') THEN 'filled' END AS style,"
        " CASE kind WHEN 'class' THEN 'lightblue' WHEN 'function' THEN 'lightgreen' END AS fillcolor FROM nodes")
    o["edge_style"] = q(
        "SELECT repo_id, replace(source, ':', '_COLON_') AS source, replace(target, ':', '_COLON_') AS target, type AS label,"
        " CASE type WHEN 'inherits' THEN 'blue' WHEN 'calls' THEN 'green' END AS color,"
        " CASE type WHEN 'inherits' THEN 'dashed' END AS style FROM edges")
    o["usage_entry_modules"] = q(
        "SELECT repo_id, rank, string_split(file, '/')[-1] AS file_label, name FROM (SELECT *, row_number() OVER"
        " (PARTITION BY repo_id ORDER BY file, pos, name) AS rank FROM nodes WHERE kind = 'module' AND"
        " (contains(lower(name), 'main') OR contains(lower(name), 'app'))) WHERE rank <= 3")
    o["depth_switch"] = q2(
        "SELECT f.repo_id, f.analyze, coalesce(s.total_symbols, 0) AS total_symbols, coalesce(s.classes, 0) AS classes,"
        " coalesce(s.functions, 0) AS functions, coalesce(s.modules, 0) AS modules, coalesce(e.total_edges, 0) AS total_edges,"
        " coalesce(e.inheritance_edges, 0) AS inheritance_edges, coalesce(e.call_edges, 0) AS call_edges,"
        " coalesce(e.import_edges, 0) AS import_edges FROM"
        " (SELECT repo_id, k % 2 = 1 AS analyze FROM f3r) f"
        " LEFT JOIN (SELECT repo_id, count(*) AS total_symbols, count(*) FILTER (WHERE kind = 'class') AS classes,"
        "  count(*) FILTER (WHERE kind = 'function') AS functions, count(*) FILTER (WHERE kind = 'module') AS modules"
        "  FROM nodes GROUP BY repo_id) s ON f.repo_id = s.repo_id AND f.analyze"
        " LEFT JOIN (SELECT repo_id, count(*) AS total_edges, count(*) FILTER (WHERE type = 'inherits') AS inheritance_edges,"
        "  count(*) FILTER (WHERE type = 'calls') AS call_edges, count(*) FILTER (WHERE type = 'imports') AS import_edges"
        "  FROM edges GROUP BY repo_id) e ON f.repo_id = e.repo_id AND f.analyze")
    return o


def oracle_sql() -> dict[str, str]:
    o = {}
    o["source_lines"] = q("SELECT repo_id, path, n, raw, line FROM sl")
    o["class_symbols"] = q("SELECT repo_id, path, n, cname AS name FROM ft WHERE kind = 'class'")
    o["class_bases"] = q("SELECT repo_id, path, n, cname AS class_name, base FROM bases")
    o["function_scopes"] = q("SELECT repo_id, path, name, body_lines, pos[1] AS close_line, pos[2] AS close_kind FROM funcs")
    o["estimate_complexity"] = q("SELECT repo_id, path, name, complexity FROM funcs")
    o["import_lines"] = q("SELECT repo_id, path, n, module FROM imps")
    o["module_symbols"] = q("SELECT repo_id, path, n, split_part(module, '.', 1) AS name FROM imps")
    o["symbol_order"] = q("SELECT repo_id, path, name, kind, complexity, pos[1] AS pos_n, pos[2] AS pos_sub FROM syms")
    o["function_segments"] = q(
        "SELECT repo_id, path, n, cast(seg AS bigint) AS seg FROM w1")
    o["node_key"] = q("SELECT repo_id, concat(file, ':', name) AS key FROM nodes")
    o["dedupe_nodes"] = q("SELECT repo_id, file, name, kind FROM nodes")
    o["last_complexity"] = q("SELECT repo_id, file, name, complexity FROM nodes")
    o["inherit_edges"] = q("SELECT repo_id, file, source, target, type FROM edges WHERE type = 'inherits'")
    o["import_edges"] = q("SELECT repo_id, file, source, target, type FROM edges WHERE type = 'imports'")
    o["complete_endpoints"] = q(
        "SELECT n.repo_id, n.file, n.name, n.kind, n.complexity FROM nodes n "
        "WHERE n.pos[1] = 2147483647")
    o["append_edges"] = q("SELECT repo_id, file, source, target, type FROM edges")
    o["build_graph"] = q("SELECT repo_id, file, name, kind, complexity FROM nodes")
    o["high_complexity"] = q(
        "SELECT repo_id, rank, file, name, complexity FROM ("
        " SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY complexity DESC, file, name) AS rank"
        " FROM nodes WHERE kind = 'function' AND complexity > 10) WHERE rank <= 10")
    long_ = "WITH " + ",\n".join([LONG, LINES, FEATS, FUNCS, SYMS]) + "\n"
    o["chunked_lines"] = long_ + ("SELECT repo_id, path, n, kind, cast(seg AS bigint) AS seg, closer, "
                                  "cand AND seg > 0 AND NOT closed AS body FROM w4")
    o["chunked_graph"] = long_ + ("SELECT repo_id, file, kind AS what, name AS a, '' AS b, complexity FROM nodes "
                                  "UNION ALL SELECT repo_id, file, type, source, target, 0 FROM edges")
    o.update(more_oracles())
    o.update(url_oracles())
    import oracle_scoped
    o.update(oracle_scoped.scoped_oracles())
    import oracle_report
    o.update(oracle_report.report_oracles())
    o.update(oracle_report.text_oracles())
    return o
