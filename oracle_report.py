"""DuckDB oracle SQL for the incremental merge (F6) and the run summary."""
from __future__ import annotations

import oracle_sql as O
from srcgraph.functions import constants as C

MERGE = """stp AS (SELECT repo_id, path FROM f1 WHERE p_partkey % 2 = 0),
nwp AS (SELECT repo_id, path FROM f1 WHERE p_partkey % 2 = 1 OR p_partkey % 10 = 0),
allrows AS (SELECT * FROM syms UNION ALL SELECT * FROM ends),
stored AS (
 SELECT repo_id, path, name, arg_min(kind, pos) AS kind,
        coalesce(arg_max(complexity, pos) FILTER (WHERE complexity IS NOT NULL), 1) AS complexity
 FROM allrows WHERE (repo_id, path) IN (SELECT repo_id, path FROM stp) GROUP BY repo_id, path, name),
mrows AS (
 SELECT repo_id, path, [-1, 0, 0, 0] AS pos, name, kind, complexity FROM stored
 UNION ALL SELECT repo_id, path, pos, name, kind, complexity FROM allrows
 WHERE (repo_id, path) IN (SELECT repo_id, path FROM nwp)),
mgd AS (
 SELECT repo_id, path AS file, name, arg_min(kind, pos) AS kind,
        coalesce(arg_max(complexity, pos) FILTER (WHERE complexity IS NOT NULL), 1) AS complexity
 FROM mrows GROUP BY repo_id, path, name),
mge AS (
 SELECT * FROM edges WHERE (repo_id, file) IN (SELECT repo_id, path FROM stp)
 UNION ALL SELECT * FROM edges WHERE (repo_id, file) IN (SELECT repo_id, path FROM nwp))"""

STD = O.STD

FINAL = f"""fnodes AS (SELECT * FROM nodes WHERE (repo_id, file) IN (SELECT repo_id, path FROM r3)),
fedges AS (SELECT * FROM edges WHERE (repo_id, file) IN (SELECT repo_id, path FROM r3)),
famod AS (
 SELECT DISTINCT repo_id, replace(regexp_replace(file, '\\.py$', ''), '/', '.') AS module FROM fnodes WHERE file <> ''),
fimod AS (
 SELECT DISTINCT repo_id, split_part(target, ':', 1) AS module FROM fedges
 WHERE type = 'imports' AND split_part(target, ':', 1) <> ''),
fc0 AS (
 SELECT i.repo_id, i.module, ltrim(i.module, '.') AS base,
   EXISTS (SELECT 1 FROM famod a WHERE a.repo_id = i.repo_id AND
           (a.module = i.module OR a.module = ltrim(i.module, '.') OR ends_with(a.module, '.' || ltrim(i.module, '.')))) AS done,
   EXISTS (SELECT 1 FROM f3 f WHERE f.repo_id = i.repo_id AND f.path = replace(ltrim(i.module, '.'), '.', '/') || '.py') AS has_py,
   EXISTS (SELECT 1 FROM f3 f WHERE f.repo_id = i.repo_id AND f.path = replace(ltrim(i.module, '.'), '.', '/') || '/__init__.py') AS has_init
 FROM fimod i),
fcls AS (
 SELECT repo_id, module,
  CASE WHEN base = '' THEN 'skipped' WHEN done THEN 'analyzed'
       WHEN split_part(module, '.', 1) IN {STD} THEN 'stdlib'
       WHEN starts_with(module, '.') OR starts_with(module, repo_id) OR has_py OR has_init THEN 'internal'
       ELSE 'external' END AS class, base, has_py, has_init
 FROM fc0),
fpot AS (
 SELECT *, CASE WHEN class = 'internal' AND has_py THEN replace(base, '.', '/') || '.py'
                WHEN class = 'internal' AND has_init THEN replace(base, '.', '/') || '/__init__.py' END AS potential_file FROM fcls),
flist AS (
 SELECT repo_id, class, string_agg(module, '|' ORDER BY module) AS l FROM (
  SELECT repo_id, class, module, row_number() OVER (PARTITION BY repo_id, class ORDER BY module) AS k FROM fcls)
 WHERE k <= 20 GROUP BY repo_id, class)"""


# what its files import follows from p_partkey; prefixes are found by comparing every module of the repository.
PACKAGES = f"""x AS (SELECT p_partkey AS k, p_partkey // 8 AS g, p_partkey % 8 AS j, 'p' || (p_partkey // 8) || '/' AS p FROM part WHERE p_partkey % 16 <> 11),
f10 AS (SELECT k, 'repo' || (g % 25) AS repo_id, CASE j WHEN 0 THEN p || '__init__.py' WHEN 1 THEN p || 'core.py' WHEN 2 THEN p || 'sub/__init__.py'
  WHEN 3 THEN p || 'sub/leaf.py' WHEN 4 THEN p || 'sub/deep/inner.py' WHEN 5 THEN p || 'main.py' WHEN 6 THEN p || 'sub/util_' || k || '.py'
  ELSE 'top_' || k || '.py' END AS path, g FROM x),
named AS (SELECT k, repo_id, path, replace(regexp_replace(regexp_replace(path, '[.]py$', ''), '(^|/)__init__$', ''), '/', '.') AS name FROM f10),
i0 AS (SELECT k, repo_id, path AS file, unnest(['os', '.', '.core', '..sub.leaf', '...top', 'p' || g || '.sub.leaf.name', 'App' || (k % 3) || '.y']) AS module FROM f10),
i1 AS (SELECT *, length(module) - length(ltrim(module, '.')) AS level, ltrim(module, '.') AS rest, string_split(file, '/') AS segs FROM i0),
i2 AS (SELECT *, CASE WHEN level = 0 THEN module WHEN level > len(segs) THEN NULL
  ELSE array_to_string(list_concat(segs[1:len(segs) - level], CASE WHEN rest = '' THEN [] ELSE [rest] END), '.') END AS resolved FROM i1),
i3 AS (SELECT i.k, i.repo_id, file, module, level, resolved, arg_max(n.path, length(n.name)) AS path FROM i2 i LEFT JOIN named n
  ON n.repo_id = i.repo_id AND n.name <> '' AND (resolved = n.name OR starts_with(resolved, n.name || '.')) GROUP BY ALL)"""


def report_oracles() -> dict[str, str]:
    o = {}
    o["package_imports"] = f"""WITH {PACKAGES},
seen AS (SELECT * FROM named WHERE k % 3 <> 0),
c AS (SELECT *, EXISTS (SELECT 1 FROM seen s WHERE s.repo_id = i3.repo_id AND (s.path = i3.path OR level = 0 AND (s.name = resolved
  OR ends_with(s.name, '.' || resolved)))) AS done FROM i3 WHERE k % 3 <> 0),
d AS (SELECT *, CASE WHEN resolved = '' THEN 'skipped' WHEN done THEN 'analyzed' WHEN level = 0 AND split_part(module, '.', 1) IN {STD} THEN 'stdlib'
  WHEN level > 0 OR starts_with(module, repo_id) OR path IS NOT NULL THEN 'internal' ELSE 'external' END AS class FROM c)
SELECT repo_id, file, module, resolved, class, CASE WHEN class = 'internal' THEN path END AS potential_file FROM d"""
    entries = """e AS (SELECT repo_id, path, k, 'App' || (k % 3) AS name, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS rank FROM f10)"""
    o["package_entry_modules"] = f"""WITH {PACKAGES}, {entries}
SELECT repo_id, cast(rank AS integer) AS rank, string_split(path, '/')[-1] AS file_label, name FROM e WHERE rank <= 3"""
    o["package_report_usage"] = f"""WITH {PACKAGES}, {entries},
r AS (SELECT DISTINCT repo_id FROM f10)
SELECT repo_id, 3 AS section, cast(rank + 1 AS integer) AS sub, '' AS key, '- `' || string_split(path, '/')[-1] || '`: ' || name AS text FROM e WHERE rank <= 3
UNION ALL SELECT repo_id, 3, -1, '', '## Usage' || chr(10) FROM r
UNION ALL SELECT repo_id, 3, 0, '', 'Here are the entry points we spotted:' || chr(10) FROM r
UNION ALL SELECT repo_id, 3, 100, '', '' FROM r"""
    o["package_discovery"] = f"""WITH RECURSIVE {PACKAGES},
walk(repo_id, path, round) AS (SELECT repo_id, path, 0 FROM f10 WHERE regexp_matches(path, '/(main|__init__)[.]py$')
  UNION SELECT w.repo_id, i.path, w.round + 1 FROM walk w JOIN i3 i ON i.repo_id = w.repo_id AND i.file = w.path AND i.path IS NOT NULL WHERE w.round < 3)
SELECT repo_id, path, cast(min(round) AS integer) AS round FROM walk GROUP BY repo_id, path"""
    o["merge_graph"] = O.q("SELECT repo_id, file, name, kind, complexity FROM mgd", MERGE)
    o["stream_merge"] = o["merge_graph"]
    o["merge_edges"] = O.q("SELECT repo_id, file, source, target, type FROM mge", MERGE)
    o["stream_edges"] = o["merge_edges"]
    o["merge_order"] = O.q("SELECT repo_id, file, name, cast(row_number() OVER (PARTITION BY repo_id, file ORDER BY pos, name) AS integer) AS place FROM nodes")
    # both graphs hold the re-analysed files with the same nodes, so the union's nodes are those of all files
    o["graph_union"] = O.q("SELECT repo_id, file, 'node' AS row, name, kind, complexity, NULL::VARCHAR AS source, NULL::VARCHAR AS target FROM nodes"
                           " UNION ALL SELECT repo_id, file, 'edge', NULL, type, NULL, source, target FROM mge", MERGE)
    fin = lambda body: O.q2(body, O.DISC, FINAL)
    o["unanalyzed_imports"] = fin("SELECT repo_id, module FROM fpot WHERE class NOT IN ('analyzed', 'skipped')")
    o["resolve_module_files"] = fin("SELECT repo_id, module, potential_file FROM fpot WHERE potential_file IS NOT NULL")
    o["stdlib_imports"] = fin("SELECT repo_id, module FROM fpot WHERE class = 'stdlib'")
    o["internal_imports"] = fin("SELECT repo_id, module, potential_file FROM fpot WHERE class = 'internal'")
    o["external_imports"] = fin("SELECT repo_id, module FROM fpot WHERE class = 'external'")
    o["potential_files"] = fin("SELECT DISTINCT repo_id, potential_file AS path FROM fpot WHERE potential_file IS NOT NULL")
    o["dependency_lists"] = fin("""SELECT repo_id, CASE class WHEN 'internal' THEN 'unanalyzed_internal' WHEN 'external' THEN 'external_dependencies'
  ELSE 'stdlib_imports' END AS list, module AS item FROM fpot WHERE class IN ('internal', 'external', 'stdlib')
UNION ALL SELECT DISTINCT repo_id, 'potential_files_to_analyze', potential_file FROM fpot WHERE potential_file IS NOT NULL""")
    rep = """SELECT repo_id, cast(coalesce(c.total_imports, 0) AS bigint) AS total_imports, cast(coalesce(am.n, 0) AS bigint) AS analyzed_modules,
  cast(coalesce(c.internal, 0) AS bigint) AS unanalyzed_internal, cast(coalesce(c.ext, 0) AS bigint) AS external_dependencies,
  cast(coalesce(c.std, 0) AS bigint) AS stdlib_imports, cast(coalesce(c.pot, 0) AS bigint) AS potential_files_to_analyze,
  coalesce(c.internal, 0) = 0 AS discovery_complete
FROM (SELECT repo_id, count(*) AS total_imports, count(*) FILTER (WHERE class = 'internal') AS internal, count(*) FILTER (WHERE class = 'external') AS ext,
   count(*) FILTER (WHERE class = 'stdlib') AS std, count(DISTINCT potential_file) AS pot FROM fpot GROUP BY repo_id) c
FULL JOIN (SELECT repo_id, count(*) AS n FROM famod GROUP BY repo_id) am USING (repo_id)"""
    o["dependency_report"] = fin(rep)
    o["discovery_complete"] = fin("SELECT repo_id, discovery_complete FROM (" + rep + ")")
    o["cap_import_lists"] = fin("""SELECT repo_id, coalesce(max(l) FILTER (WHERE class = 'external'), '') AS first_external,
  coalesce(max(l) FILTER (WHERE class = 'stdlib'), '') AS first_stdlib FROM flist WHERE class IN ('external', 'stdlib') GROUP BY repo_id""")
    o["run_summary"] = fin("""SELECT q.repo_id, CASE WHEN ok THEN 'ok' ELSE 'error' END AS status, CASE WHEN NOT ok THEN 'invalid_url' END AS error_code,
  CASE WHEN NOT ok THEN 'Unsupported host: example.org. Supported: github.com, gitlab.com, bitbucket.org' END AS message,
  CASE WHEN ok THEN coalesce(n.total_symbols, 0) END AS symbol_count, CASE WHEN ok THEN coalesce(n.total_symbols, 0) END AS total_symbols,
  CASE WHEN ok THEN coalesce(n.classes, 0) END AS classes, CASE WHEN ok THEN coalesce(n.functions, 0) END AS functions,
  CASE WHEN ok THEN coalesce(n.modules, 0) END AS modules, CASE WHEN ok THEN coalesce(e.total_edges, 0) END AS total_edges,
  CASE WHEN ok THEN coalesce(e.inheritance_edges, 0) END AS inheritance_edges, CASE WHEN ok THEN coalesce(e.call_edges, 0) END AS call_edges,
  CASE WHEN ok THEN coalesce(e.import_edges, 0) END AS import_edges, CASE WHEN ok THEN coalesce(c.total_imports, 0) END AS total_imports,
  CASE WHEN ok THEN coalesce(c.ext, 0) END AS external_count, CASE WHEN ok THEN coalesce(le.l, '') END AS external_dependencies,
  CASE WHEN ok THEN coalesce(ls.l, '') END AS stdlib_imports, CASE WHEN ok THEN coalesce(c.internal, 0) END AS unanalyzed_internal_count,
  CASE WHEN ok THEN coalesce(c.internal, 0) = 0 END AS discovery_complete, CASE WHEN ok THEN r.discovery_iterations END AS discovery_iterations,
  CASE WHEN ok THEN coalesce(p.n, 0) END AS priority_files_count
FROM (SELECT DISTINCT repo_id, k % 7 <> 0 AS ok FROM f3r) q
LEFT JOIN (SELECT repo_id, cast(least(max(rnd) + 1, 3) AS integer) AS discovery_iterations FROM r3 GROUP BY repo_id) r ON q.repo_id = r.repo_id
LEFT JOIN (SELECT repo_id, count(*) AS total_symbols, count(*) FILTER (WHERE kind = 'class') AS classes,
   count(*) FILTER (WHERE kind = 'function') AS functions, count(*) FILTER (WHERE kind = 'module') AS modules
   FROM fnodes GROUP BY repo_id) n ON q.repo_id = n.repo_id
LEFT JOIN (SELECT repo_id, count(*) AS total_edges, count(*) FILTER (WHERE type = 'inherits') AS inheritance_edges,
   count(*) FILTER (WHERE type = 'calls') AS call_edges, count(*) FILTER (WHERE type = 'imports') AS import_edges
   FROM fedges GROUP BY repo_id) e ON q.repo_id = e.repo_id
LEFT JOIN (SELECT repo_id, count(*) AS total_imports, count(*) FILTER (WHERE class = 'external') AS ext,
   count(*) FILTER (WHERE class = 'internal') AS internal FROM fcls GROUP BY repo_id) c ON q.repo_id = c.repo_id
LEFT JOIN (SELECT * FROM flist WHERE class = 'external') le ON q.repo_id = le.repo_id
LEFT JOIN (SELECT * FROM flist WHERE class = 'stdlib') ls ON q.repo_id = ls.repo_id
LEFT JOIN (SELECT repo_id, count(*) AS n FROM ep GROUP BY repo_id) p ON q.repo_id = p.repo_id""")
    return o


REPOS = """rp0 AS (
 SELECT DISTINCT lower(replace(p_brand, '#', '')) AS repo_id, cast(replace(p_brand, 'Brand#', '') AS int) AS k FROM part),
rpall AS (
 SELECT repo_id, k, CASE WHEN k % 7 = 0 THEN 'https://example.org/' || repo_id
                         ELSE 'https://github.com/srcgraph-fixtures/' || repo_id END AS repo_url FROM rp0),
rp AS (SELECT * FROM rpall WHERE k % 7 <> 0),
rpick AS (
 SELECT repo_id, arg_min(path, CASE path WHEN 'README.md' THEN 1 WHEN 'README.rst' THEN 2 ELSE 3 END) AS readme
 FROM tree WHERE path IN ('README.md', 'README.rst', 'README.txt') GROUP BY repo_id),
rdocs AS (SELECT source, arg_min(text, doc_id) AS text FROM documents GROUP BY source),
rtext AS (
 SELECT p.repo_id, coalesce(d.text, '') AS text FROM rpick p JOIN rpall r ON p.repo_id = r.repo_id
 LEFT JOIN rdocs d ON d.source = 'src' || cast(r.k % 20 AS varchar)),
rsum AS (
 SELECT r.repo_id, r.repo_url, t.text,
  CASE WHEN t.text IS NULL OR t.text = '' THEN 'No README content found.'
       ELSE substring(c, 1, 500) || CASE WHEN length(c) > 500 THEN '...' ELSE '' END END AS summary
 FROM rpall r LEFT JOIN (SELECT repo_id, text, regexp_replace(regexp_replace(text, '^{ws}+|{ws}+$', '', 'g'), '{ws}+', ' ', 'g') AS c
                      FROM rtext) t ON r.repo_id = t.repo_id),
rpm AS (
 SELECT repo_id, CASE WHEN bool_or(path = 'requirements.txt') THEN 'requirements' WHEN bool_or(path = 'setup.py') THEN 'setup'
                      WHEN bool_or(path = 'pyproject.toml') THEN 'pyproject' ELSE 'none' END AS pm FROM tree GROUP BY repo_id)"""
WS = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1c}-\\x{1f}\\x{0b}]"
REPOS = REPOS.replace("{ws}", WS)
NL = "chr(10)"


def _lines(rows: list[tuple[int, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS sub, {t} AS text" for i, t in rows)


def text_oracles() -> dict[str, str]:
    import oracle_scoped as OS
    o = {}
    bodies = []

    class Q:
        @staticmethod
        def q2(body, *extra):
            body = f"SELECT * FROM ({body}) WHERE repo_id IN (SELECT repo_id FROM rp)"
            bodies.append(body)
            return O.q2(body, *extra)
    name = "replace(string_split(regexp_replace(r.repo_url, '/+$', ''), '/')[-1], '.git', '')"
    o["report_overview"] = Q.q2(f"""SELECT r.repo_id, 1 AS section, x.sub, '' AS key, x.text FROM rsum r, LATERAL (
  SELECT 0 AS sub, '# ' || {name} || ' – Documentation' || {NL} AS text
  UNION ALL SELECT 1, '*Auto-generated for [' || r.repo_url || '](' || r.repo_url || ')*' || {NL}
  UNION ALL SELECT 2, '---' || {NL} UNION ALL SELECT 3, '## Overview' || {NL}
  UNION ALL SELECT 4, r.summary || {NL}) x""", REPOS)
    inst = C.REPORT_INSTALL
    lit = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    extra = " UNION ALL ".join(
        f"SELECT repo_id, {6 + i} AS sub, {lit(t)} AS text FROM rpm WHERE pm = '{pm}'"
        for pm, ls in inst.items() for i, t in enumerate(ls))
    cd = "'cd ' || replace(string_split(r.repo_url, '/')[-1], '.git', '')"
    o["report_installation"] = Q.q2(f"""SELECT repo_id, 2 AS section, sub, '' AS key, text FROM (
  SELECT r.repo_id, x.sub, x.text FROM rp r, LATERAL (
   SELECT 0 AS sub, '## Installation' || {NL} AS text UNION ALL SELECT 1, 'Clone the repository:' || {NL}
   UNION ALL SELECT 2, '```bash' UNION ALL SELECT 3, 'git clone ' || r.repo_url UNION ALL SELECT 4, {cd}
   UNION ALL SELECT 5, '```' || {NL}) x
  UNION ALL {extra})""", REPOS)
    fallback = lit(C.REPORT_NO_USAGE[1])
    o["report_usage"] = Q.q2(f"""SELECT repo_id, 3 AS section, sub, '' AS key, text FROM (
  SELECT repo_id, rank + 1 AS sub, '- `' || string_split(file, '/')[-1] || '`: ' || name AS text FROM (
   SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY file, pos, name) AS rank FROM mnodes
   WHERE kind = 'module' AND (contains(lower(name), 'main') OR contains(lower(name), 'app'))) WHERE rank <= 3
  UNION ALL SELECT repo_id, -1, '## Usage' || {NL} FROM rp WHERE repo_id IN (SELECT repo_id FROM ent)
  UNION ALL SELECT repo_id, 0, 'Here are the entry points we spotted:' || {NL} FROM rp WHERE repo_id IN (SELECT repo_id FROM ent)
  UNION ALL SELECT repo_id, 100, '' FROM rp WHERE repo_id IN (SELECT repo_id FROM ent)
  UNION ALL SELECT repo_id, 0, '## Usage' || {NL} FROM rp WHERE repo_id NOT IN (SELECT repo_id FROM ent)
  UNION ALL SELECT repo_id, 1, {fallback} FROM rp WHERE repo_id NOT IN (SELECT repo_id FROM ent))""",
        REPOS, OS.SCOPED, """ent AS (SELECT DISTINCT repo_id FROM mnodes WHERE kind = 'module'
 AND (contains(lower(name), 'main') OR contains(lower(name), 'app')))""")
    o["report_join"] = O.q2(f"""SELECT r.repo_id,
  CASE WHEN ok THEN r.repo_url END AS normalized_url,
  CASE WHEN ok THEN r.summary ELSE '' END AS readme_summary,
  CASE WHEN ok THEN p.pm END AS package_manager,
  CASE WHEN ok THEN coalesce(e.n, 0) ELSE 0 END AS priority_files,
  CASE WHEN ok THEN coalesce(s.n, 0) ELSE 0 END AS symbol_count,
  CASE WHEN NOT ok THEN 'repo_map_failed: Unsupported host: example.org. Supported: github.com, gitlab.com, bitbucket.org' END AS error
FROM (SELECT *, NOT starts_with(repo_url, 'https://example.org/') AS ok FROM rsum) r
LEFT JOIN rpm p ON r.repo_id = p.repo_id
LEFT JOIN (SELECT repo_id, count(*) AS n FROM ep GROUP BY repo_id) e ON r.repo_id = e.repo_id
LEFT JOIN (SELECT repo_id, count(*) AS n FROM mnodes GROUP BY repo_id) s ON r.repo_id = s.repo_id""", REPOS, OS.SCOPED)
    o["report_structure"] = Q.q2(f"""SELECT repo_id, 7 AS section, 0 AS sub, '' AS key, '## Project Structure' || {NL} AS text FROM rp
  UNION ALL SELECT repo_id, 7, 1, '', '```' FROM rp
  UNION ALL SELECT repo_id, 7, 2, sort_key, concat(repeat('  ', depth), path, CASE WHEN type = 'dir' THEN '/' ELSE '' END) FROM tree
  UNION ALL SELECT repo_id, 7, 2, '', '<empty>' FROM rp WHERE repo_id NOT IN (SELECT repo_id FROM tree)
  UNION ALL SELECT repo_id, 7, 3, '', '```' || {NL} FROM rp
  UNION ALL SELECT repo_id, 8, 0, '', '---' || {NL} FROM rp
  UNION ALL SELECT repo_id, 8, 1, '', '*Generated with srcgraph.*' FROM rp""", REPOS)
    o["report_architecture"] = Q.q2(f"""SELECT repo_id, 4 AS section, sub, key, text FROM (
  SELECT r.repo_id, x.sub, '' AS key, x.text FROM (
    SELECT rp.repo_id, coalesce(n.total, 0) AS total, coalesce(n.classes, 0) AS classes, coalesce(n.functions, 0) AS functions,
      coalesce(n.modules, 0) AS modules, coalesce(e.calls, 0) AS calls, coalesce(e.inh, 0) AS inh
    FROM rp LEFT JOIN (SELECT repo_id, count(*) AS total, count(*) FILTER (WHERE kind = 'class') AS classes,
        count(*) FILTER (WHERE kind = 'function') AS functions, count(*) FILTER (WHERE kind = 'module') AS modules
        FROM mnodes GROUP BY repo_id) n ON rp.repo_id = n.repo_id
    LEFT JOIN (SELECT repo_id, count(*) FILTER (WHERE type = 'calls') AS calls,
        count(*) FILTER (WHERE type = 'inherits') AS inh FROM medges GROUP BY repo_id) e ON rp.repo_id = e.repo_id) r,
  LATERAL (SELECT 0 AS sub, '## Architecture' || {NL} AS text
    UNION ALL SELECT 1, '- **Total Symbols**: ' || cast(r.total AS varchar)
    UNION ALL SELECT 2, '- **Classes**: ' || cast(r.classes AS varchar)
    UNION ALL SELECT 3, '- **Functions**: ' || cast(r.functions AS varchar)
    UNION ALL SELECT 4, '- **Modules**: ' || cast(r.modules AS varchar)
    UNION ALL SELECT 5, '- **Call Relationships**: ' || cast(r.calls AS varchar)
    UNION ALL SELECT 6, '- **Inheritance Relationships**: ' || cast(r.inh AS varchar)
    UNION ALL SELECT 7, '') x
  UNION ALL SELECT repo_id, 20, lpad(cast(k AS varchar), 5, '0'), '- `' || string_split(base, ':')[-1] || '`' FROM (
    SELECT repo_id, base, row_number() OVER (PARTITION BY repo_id ORDER BY base) AS k
    FROM (SELECT DISTINCT repo_id, target AS base FROM medges WHERE type = 'inherits')) WHERE k <= 10
  UNION ALL SELECT DISTINCT repo_id, 10, '', '### Base Classes' || {NL} FROM medges WHERE type = 'inherits'
  UNION ALL SELECT DISTINCT repo_id, 11, '', 'Classes that other classes build on:' || {NL} FROM medges WHERE type = 'inherits'
  UNION ALL SELECT DISTINCT repo_id, 30, '', '' FROM medges WHERE type = 'inherits')""", REPOS, OS.SCOPED)
    lp = lambda c: f"lpad(cast({c} AS varchar), 5, '0')"
    bn = "string_split(file, '/')[-1]"
    o["report_api"] = Q.q2(f"""SELECT repo_id, 6 AS section, sub, key, text FROM (
  SELECT repo_id, 0 AS sub, '' AS key, '## API Reference' || {NL} AS text FROM rp
  UNION ALL SELECT DISTINCT repo_id, 1, '', '### Classes' || {NL} FROM cpf
  UNION ALL SELECT repo_id, 2, {lp('file_rank')} || '.0', '#### ' || {bn} || {NL} FROM cpf WHERE class_rank = 1
  UNION ALL SELECT repo_id, 2, {lp('file_rank')} || '.' || cast(class_rank AS varchar), '- **`' || name || '`**' FROM cpf
  UNION ALL SELECT repo_id, 2, {lp('file_rank')} || '.9', '' FROM cpf WHERE class_rank = 1
  UNION ALL SELECT DISTINCT repo_id, 3, '', '### High-Complexity Functions' || {NL} FROM hc
  UNION ALL SELECT DISTINCT repo_id, 4, '', 'These functions carry a lot of logic (estimated complexity above 10) and may be worth splitting up:' || {NL} FROM hc
  UNION ALL SELECT repo_id, 5, {lp('rank')}, '- `' || name || '` in `' || {bn} || '` (complexity: ' || cast(complexity AS varchar) || ')' FROM hc
  UNION ALL SELECT DISTINCT repo_id, 6, '', '' FROM hc
  UNION ALL SELECT DISTINCT repo_id, 7, '', '### Most-Called Functions (Hotspots)' || {NL} FROM hs
  UNION ALL SELECT DISTINCT repo_id, 8, '', 'These are the functions the rest of the code leans on the most:' || {NL} FROM hs
  UNION ALL SELECT repo_id, 9, {lp('rank')}, '- `' || string_split(target, ':')[-1] || '` (called ' || cast(calls AS varchar) || ' times)' FROM hs
  UNION ALL SELECT DISTINCT repo_id, 10, '', '' FROM hs)""", REPOS, OS.SCOPED,
        """cpf AS (
 SELECT * FROM (SELECT repo_id, file, name, dense_rank() OVER (PARTITION BY repo_id ORDER BY file) AS file_rank,
   row_number() OVER (PARTITION BY repo_id, file ORDER BY pos, name) AS class_rank FROM mnodes WHERE kind = 'class')
 WHERE file_rank <= 10 AND class_rank <= 5),
hc AS (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY complexity DESC, file, name) AS rank
   FROM mnodes WHERE kind = 'function' AND complexity > 10) WHERE rank <= 10),
hs AS (
 SELECT * FROM (SELECT repo_id, target, count(*) AS calls,
   row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, target) AS rank
   FROM medges WHERE type = 'calls' GROUP BY repo_id, target) WHERE rank <= 10)""")
    diagram_body = f"""SELECT repo_id, 5 AS section, 0 AS sub, '' AS key, '### Code Diagrams' || {NL} AS text FROM rp
  UNION ALL SELECT n.repo_id, 5, CASE n.diagram WHEN 'class_hierarchy' THEN 1 WHEN 'call_graph' THEN 2 ELSE 3 END, '',
    '#### ' || CASE n.diagram WHEN 'class_hierarchy' THEN 'Class Hierarchy' WHEN 'call_graph' THEN 'Call Graph'
                 ELSE 'Full Code Context Graph' END || {NL} || {NL} || 'Diagram table `' || n.diagram || '`: '
    || cast(n.c AS varchar) || ' nodes, ' || cast(coalesce(e.c, 0) AS varchar) || ' edges.' || {NL}
  FROM (SELECT repo_id, diagram, count(*) AS c FROM (SELECT * FROM ccgnodes UNION ALL SELECT * FROM chnodes
        UNION ALL SELECT * FROM cnodes) GROUP BY repo_id, diagram) n
  LEFT JOIN (
    SELECT repo_id, 'ccg' AS diagram, count(*) AS c FROM medges
     WHERE (repo_id, source) IN (SELECT repo_id, file || ':' || name FROM cap40)
       AND (repo_id, target) IN (SELECT repo_id, file || ':' || name FROM cap40) GROUP BY repo_id
    UNION ALL SELECT repo_id, 'class_hierarchy', count(*) FROM medges WHERE type = 'inherits'
     AND (repo_id, source) IN (SELECT repo_id, key FROM chnodes) AND (repo_id, target) IN (SELECT repo_id, key FROM chnodes)
     GROUP BY repo_id
    UNION ALL SELECT repo_id, 'call_graph', count(*) FROM medges WHERE type = 'calls'
     AND (repo_id, replace(source, ':', '_COLON_')) IN (SELECT repo_id, key FROM ckept)
     AND (repo_id, replace(target, ':', '_COLON_')) IN (SELECT repo_id, key FROM ckept) GROUP BY repo_id) e
  ON n.repo_id = e.repo_id AND n.diagram = e.diagram"""
    bodies.append(f"SELECT * FROM ({diagram_body}) WHERE repo_id IN (SELECT repo_id FROM rp)")
    union = " UNION ALL ".join(f"SELECT repo_id, text FROM ({b})" for b in bodies)
    o["write_markdown"] = O.q2(f"SELECT repo_id, unnest(string_split(text, chr(10))) AS text FROM ({union})",
                               REPOS, OS.SCOPED, """ent AS (SELECT DISTINCT repo_id FROM mnodes WHERE kind = 'module'
 AND (contains(lower(name), 'main') OR contains(lower(name), 'app')))""", """cpf AS (
 SELECT * FROM (SELECT repo_id, file, name, dense_rank() OVER (PARTITION BY repo_id ORDER BY file) AS file_rank,
   row_number() OVER (PARTITION BY repo_id, file ORDER BY pos, name) AS class_rank FROM mnodes WHERE kind = 'class')
 WHERE file_rank <= 10 AND class_rank <= 5),
hc AS (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY complexity DESC, file, name) AS rank
   FROM mnodes WHERE kind = 'function' AND complexity > 10) WHERE rank <= 10),
hs AS (
 SELECT * FROM (SELECT repo_id, target, count(*) AS calls,
   row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, target) AS rank
   FROM medges WHERE type = 'calls' GROUP BY repo_id, target) WHERE rank <= 10)""")
    return o
