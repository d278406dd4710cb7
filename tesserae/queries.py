"""The registered queries over whole tables, and the DuckDB SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import bindings as B
from tesserae.functions import fixed
from tesserae.functions import scalars as S
from tesserae.operators import budget, graphs, incremental, rank, stats, traverse
from tesserae.sources import listing

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# SQL of the inputs that bindings.py makes
EDGES = """edges AS (
  SELECT 'o:' || o_orderkey AS src, 'c:' || o_custkey AS dst FROM orders UNION
  SELECT 'o:' || l_orderkey, 'p:' || l_partkey FROM lineitem UNION
  SELECT 'p:' || l_partkey, 's:' || l_suppkey FROM lineitem UNION
  SELECT 'c:' || c_custkey, 'n:' || c_nationkey FROM customer UNION
  SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier UNION
  SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation)"""
TYPES = """edges AS (SELECT DISTINCT src, dst FROM (
  SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src, event_type AS dst FROM events) WHERE src IS NOT NULL)"""
RING = "edges AS (SELECT DISTINCT 'u:' || (user_id % 97) AS src, 'u:' || ((user_id * 3 + 1) % 97) AS dst FROM events)"
BRANDS = "brands AS (SELECT path, row_number() OVER (ORDER BY path) AS rank FROM (SELECT DISTINCT p_brand AS path FROM part))"
IMPORTS = f"""{BRANDS}, imports AS (SELECT DISTINCT a.path AS path, b.rank AS ord, b.path AS module FROM brands a JOIN brands b
  ON (b.rank = a.rank + 1 OR b.rank = 2 * a.rank) WHERE a.path <> b.path)"""
CALLS = """calls AS (SELECT DISTINCT p_brand AS path, p_type AS caller, p_name AS callee FROM part),
  symbols AS (SELECT DISTINCT p_brand AS path, p_name AS name FROM part UNION SELECT DISTINCT p_brand, p_type FROM part)"""
FILES = """files AS (SELECT coalesce(source, 'none') || '/d' || (doc_id % 7) || '/' || doc_id || '.' || coalesce(lang, 'md') AS path, doc_id AS ord,
  lang AS language, n_chars AS size, coalesce(lang, '') <> 'en' AS listed_only, lang IS NULL AS markdown FROM documents)"""
TAILS = "['/index.html', '/test_main.py', '/settings.json', '/model.ts', '/notes.md', '/util.sh', '/build/out.js']"
PAGES = f"""paths AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '\\?.*$', '') || list_extract({TAILS}, (page_id % 7 + 1)::int) AS path, page_id AS ord, html FROM pages)"""
SNAPSHOTS = """now AS (SELECT 'r' AS root, 'd' || doc_id AS path, doc_id::double AS mtime, n_chars AS size, sha256(text) AS content_hash FROM documents),
  cached AS (SELECT 'r' AS root, 'd' || doc_id AS path, doc_id::double - CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 1 ELSE 0 END AS mtime, n_chars AS size,
    sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS content_hash FROM documents WHERE doc_id % 11 <> 0
    UNION ALL SELECT 'r', 'd' || doc_id || '-old', doc_id::double, n_chars, sha256(text) FROM documents WHERE doc_id % 13 = 0)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        REGISTERED[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def walk_sql(inputs: str, seed: str, depth: int, a: str, b: str, out: str) -> str:
    return f"""WITH RECURSIVE {inputs}, walk AS (SELECT '{seed}' AS node, 0 AS depth
  UNION SELECT e.{b}, w.depth + 1 FROM walk w JOIN edges e ON e.{a} = w.node WHERE w.depth < {depth})
SELECT node AS {out}, min(depth)::int AS depth FROM walk GROUP BY node HAVING min(depth) > 0 AND node <> '{seed}'"""


def reach_sql(inputs: str, seed: str, depth: int) -> str:
    return f"""WITH RECURSIVE {inputs}, walk AS (SELECT '{seed}' AS node, 0 AS depth
  UNION SELECT e.src, w.depth + 1 FROM walk w JOIN edges e ON e.dst = w.node WHERE w.depth < {depth})
SELECT DISTINCT node AS symbol FROM walk WHERE depth > 0"""


def pagerank_sql(tail: str) -> str:
    steps = "".join(
        f""", r{k + 1} AS MATERIALIZED (SELECT node, 0.15::double / n + 0.85::double * lost / n + 0.85::double * coalesce(given, 0) AS r FROM r{k} CROSS JOIN size
  CROSS JOIN (SELECT coalesce(sum(r), 0)::double AS lost FROM r{k} WHERE node NOT IN (SELECT src FROM outs))
  LEFT JOIN (SELECT dst AS node, sum(r / o) AS given FROM edges JOIN outs USING (src) JOIN r{k} ON r{k}.node = src GROUP BY dst) USING (node))"""
        for k in range(20)
    )
    return f"""WITH {EDGES.replace('edges AS (', 'edges AS MATERIALIZED (')}, outs AS MATERIALIZED (SELECT src, count(*)::double AS o FROM edges GROUP BY src),
nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), size AS (SELECT count(*)::double AS n FROM nodes),
r0 AS MATERIALIZED (SELECT node, 1.0::double / n AS r FROM nodes CROSS JOIN size){steps}
{tail}"""


@query(reach_sql(EDGES, "r:0", 2))
def who_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.who_calls(B.call_edges(spark, sf_dir), "r:0", 2)


@query(reach_sql(TYPES, "click", 1))
def who_calls_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.who_calls(B.event_edges(spark, sf_dir), "click", 1)


@query(reach_sql(RING, "u:5", 8))
def who_calls_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.who_calls(B.ring_edges(spark, sf_dir), "u:5", 8)


@query(walk_sql(EDGES, "r:0", 3, "dst", "src", "symbol"))
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.blast_radius(B.call_edges(spark, sf_dir), "r:0", 3)


@query(walk_sql(EDGES, "r:0", 4, "dst", "src", "symbol"))
def blast_radius_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.blast_radius(B.call_edges(spark, sf_dir), "r:0", 4)


@query(walk_sql(f"{IMPORTS}, edges AS (SELECT path AS src, module AS dst FROM imports)", "Brand#1", 5, "src", "dst", "target"))
def dependency_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    imports = B.brand_imports(spark, sf_dir)
    return traverse.dependency_chain(imports.select(F.col("path").alias("src"), F.col("module").alias("dst")), "Brand#1", 5)


@query(f"WITH {EDGES} SELECT 'o' || ':' || o_orderkey AS symbol FROM orders WHERE ('o:' || o_orderkey) NOT IN (SELECT dst FROM edges) UNION ALL SELECT 'c' || ':' || c_custkey FROM customer WHERE ('c:' || c_custkey) NOT IN (SELECT dst FROM edges)".replace("'o' || ':'", "'orders:o:'").replace("'c' || ':'", "'customer:c:'"))
def dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = B.table(spark, sf_dir, "orders").select(F.lit("orders").alias("path"), F.lit("function").alias("kind"), F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("name"))
    customers = B.table(spark, sf_dir, "customer").select(F.lit("customer").alias("path"), F.lit("function").alias("kind"), F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("name"))
    return graphs.dead_symbols(orders.unionByName(customers), B.call_edges(spark, sf_dir))


@query(
    """SELECT file, name, type, line FROM (SELECT p_brand AS file, p_name AS name, CASE WHEN p_size <= 5 THEN 'class' ELSE 'function' END AS type, p_size::varchar AS line,
  coalesce(try_cast(regexp_extract(p_brand, '([0-9]+)', 1) AS int), 0) AS fo, p_partkey AS ord FROM part WHERE regexp_matches(p_name, 'GEAR|^hot', 'i'))
  ORDER BY fo, CASE WHEN type = 'function' THEN 0 ELSE 1 END, ord, name LIMIT 50"""
)
def search_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.search(B.part_symbols(spark, sf_dir), "GEAR|^hot", 50)


@query(
    f"""WITH {IMPORTS}, named AS (SELECT p_brand AS path, string_agg(p_name, ',' ORDER BY p_partkey, p_name) FILTER (p_size > 5) AS functions, string_agg(p_name, ',' ORDER BY p_partkey, p_name) FILTER (p_size <= 5) AS classes FROM part GROUP BY 1),
brought AS (SELECT path, string_agg(module, ',' ORDER BY ord, module) AS imports FROM imports GROUP BY 1)
SELECT path, 'brand' AS language, coalesce(functions, '') AS functions, coalesce(classes, '') AS classes, coalesce(imports, '') AS imports, '' AS purpose, true AS parsed FROM brands LEFT JOIN named USING (path) LEFT JOIN brought USING (path)"""
)
def file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = B.brands(spark, sf_dir).select("path", F.lit("brand").alias("language"), F.lit(None).cast("string").alias("purpose"), F.lit(True).alias("parsed"))
    out = graphs.file_summaries(files, B.part_symbols(spark, sf_dir), B.brand_imports(spark, sf_dir))
    return out.select("path", "language", *[F.array_join(c, ",").alias(c) for c in ("functions", "classes", "imports")], "purpose", "parsed")


@query(pagerank_sql("SELECT node AS symbol, round(r / (SELECT max(r) FROM r20), 4) AS score FROM r20"))
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.pagerank(B.call_edges(spark, sf_dir)).select("symbol", F.round("score", 4).alias("score"))


@query(pagerank_sql("SELECT node AS symbol, round(r / (SELECT max(r) FROM r20), 4) AS score FROM r20 ORDER BY r DESC, node LIMIT 50"))
def top_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.top_symbols(rank.pagerank(B.call_edges(spark, sf_dir)))


@query(f"WITH {CALLS} SELECT callee AS symbol, string_agg(DISTINCT caller, ',' ORDER BY caller) AS called_by FROM calls GROUP BY callee")
def called_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graphs.callers_of(graphs.call_edges(B.brand_symbols(spark, sf_dir)))
    return out.select("symbol", F.array_join("called_by", ",").alias("called_by"))


@query(f"WITH {CALLS} SELECT s.path, s.name, coalesce(string_agg(DISTINCT c.caller, ',' ORDER BY c.caller), '') AS called_by FROM symbols s LEFT JOIN calls c ON c.callee = s.name GROUP BY 1, 2")
def symbols_with_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = B.brand_symbols(spark, sf_dir)
    out = graphs.with_callers(symbols, graphs.call_edges(symbols))
    return out.select("path", "name", F.array_join("called_by", ",").alias("called_by"))


@query(f"WITH {EDGES}, merged AS (SELECT src, dst FROM edges UNION SELECT 'b:' || p_brand, 'p:' || p_partkey FROM part) SELECT src, dst FROM merged")
def edge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = B.table(spark, sf_dir, "part").select(F.concat(F.lit("b:"), "p_brand").alias("src"), F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("dst"))
    return graphs.edge_union(B.call_edges(spark, sf_dir), more)


@query(f"WITH {IMPORTS} SELECT path, module AS target FROM imports WHERE module IN (SELECT path FROM brands)")
def import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = B.brands(spark, sf_dir).select("path")
    return graphs.import_targets(B.brand_imports(spark, sf_dir), files.select(F.col("path").alias("module"), "path"), files)


@query(f"""WITH {IMPORTS}, {CALLS} SELECT c.path || ':' || c.caller AS src, i.module || ':' || c.callee AS dst, 'call' AS rel FROM calls c JOIN imports i ON i.path = c.path JOIN symbols s ON s.path = i.module AND s.name = c.callee""")
def xfile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = B.brands(spark, sf_dir).select("path")
    targets = graphs.import_targets(B.brand_imports(spark, sf_dir), files.select(F.col("path").alias("module"), "path"), files)
    return graphs.xfile_edges(B.brand_symbols(spark, sf_dir), targets)


@query(f"WITH {FILES} SELECT CASE WHEN listed_only THEN 'listed_only' ELSE 'fully_parsed' END AS status, language, count(*) AS n FROM files GROUP BY ALL")
def language_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.language_stats(B.document_files(spark, sf_dir))


@query(f"""WITH {FILES}, dirs AS (SELECT split_part(path, '/', 1) AS dir FROM files UNION SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM files)
SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM files WHERE markdown) AS markdown, count(*) AS directories FROM dirs""")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.totals(B.document_files(spark, sf_dir))


@query(f"""WITH {PAGES}, parts AS (SELECT string_split(path, '/') AS p FROM paths), dirs AS (SELECT array_to_string(list_slice(p, 1, k), '/') AS dir FROM (SELECT p, unnest(range(1, len(p))) AS k FROM parts))
SELECT dir, count(*) AS files FROM dirs GROUP BY dir""")
def dir_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.directory_counts(B.page_files(spark, sf_dir))


@query(f"""WITH {PAGES}, named AS (SELECT path, lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]+$', '')) AS s FROM paths)
SELECT path, CASE WHEN s IN ('index', 'main', 'app') THEN 'Application entry point' WHEN s LIKE '%test%' OR s LIKE '%spec%' THEN 'Test file' WHEN s LIKE '%config%' OR s LIKE '%settings%' THEN 'Configuration'
WHEN s LIKE '%route%' THEN 'Route definitions' WHEN s LIKE '%model%' THEN 'Data model' WHEN s LIKE '%util%' OR s LIKE '%helper%' THEN 'Utility functions' WHEN s LIKE '%middleware%' THEN 'Middleware' END AS purpose FROM named""")
def file_purpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.page_files(spark, sf_dir).select("path", S.file_purpose(F.col("path")).alias("purpose"))


def _dir_case() -> str:
    exact = " ".join(f"WHEN n = '{k}' THEN '{v}'" for k, v in fixed.DIRECTORY_PURPOSES.items())
    part = " ".join(f"WHEN contains(n, '{k}') THEN '{v}'" for k, v in fixed.DIRECTORY_PURPOSES.items())
    inside = " ".join("WHEN " + " OR ".join(f"bool_or(contains(f, '{p}'))" for p in parts) + f" THEN '{v}'" for parts, v in fixed.CONTENT_PURPOSES)
    return f"CASE {exact} {part} {inside} END"


@query(f"""WITH {PAGES}, each AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, lower(regexp_extract(path, '[^/]*$')) AS f FROM paths), named AS (SELECT dir, lower(regexp_extract(dir, '[^/]*$')) AS n, f FROM each)
SELECT dir, purpose FROM (SELECT dir, {_dir_case()} AS purpose FROM named GROUP BY dir, n) WHERE purpose IS NOT NULL""")
def dir_purpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.directory_purposes(B.page_files(spark, sf_dir))


@query("SELECT p_brand AS path, count(*) FILTER (p_size > 5) + CASE WHEN count(*) FILTER (p_size <= 5) > 0 THEN 5 ELSE 0 END AS importance FROM part GROUP BY 1")
def file_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.file_importance(B.part_symbols(spark, sf_dir))


@query("""SELECT event_id, kind, count(*) AS n FROM (SELECT event_id, unnest(['props', 'value', 'type', 'quoted']) AS what, unnest([props, value::decimal(18, 2)::varchar, event_type, '''' || event_type]) AS v FROM events)
CROSS JOIN LATERAL (SELECT CASE WHEN v[1] IN ('{', '[') THEN 'collection' WHEN v[1] IN ('''', '"', '`') THEN 'str' WHEN regexp_full_match(replace(replace(v, '.', ''), '-', ''), '[0-9]+') THEN 'number' ELSE 'value' END AS kind) GROUP BY 1, 2""")
def const_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = B.table(spark, sf_dir, "events").select("event_id", F.explode(F.array("props", F.col("value").cast("decimal(18,2)").cast("string"), "event_type", F.concat(F.lit("'"), "event_type"))).alias("v"))
    return values.groupBy("event_id", S.constant_type(F.col("v")).alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN length(d) > 80 THEN substr(d, 1, 77) || '...' ELSE d END AS doc FROM (SELECT doc_id, replace(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)), chr(10), ' ') AS d FROM documents)""")
def truncate_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "documents").select("doc_id", S.truncate_doc(F.col("text")).alias("doc"))


@query(f"WITH {FILES} SELECT ord, replace(replace(replace('scripts/' || path || '/tests/src/x', 'scripts/', 's/'), 'src/', 'sr/'), 'tests/', 't/') AS path FROM files")
def path_abbrev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.document_files(spark, sf_dir).select("ord", S.abbreviate_path(F.concat(F.lit("scripts/"), "path", F.lit("/tests/src/x"))).alias("path"))


@query(f"""WITH {PAGES} SELECT path, CASE regexp_extract(path, '\\.[^./]+$') WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.sh' THEN 'shell' WHEN '.json' THEN 'json' WHEN '.html' THEN 'html' WHEN '.md' THEN 'md' ELSE 'unknown' END AS language,
CASE regexp_extract(path, '\\.[^./]+$') WHEN '.py' THEN 'p' WHEN '.js' THEN 'j' WHEN '.ts' THEN 't' WHEN '.sh' THEN 's' WHEN '.json' THEN 'n' ELSE 'u' END AS letter FROM paths""")
def language_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    language = S.language_name(S.extension(F.col("path")))
    return B.page_files(spark, sf_dir).select("path", language.alias("language"), S.language_letter(language).alias("letter"))


@query(f"""WITH {PAGES}, mods AS (SELECT path, replace(regexp_replace(path, '\\.py$', ''), '/', '.') AS module FROM paths WHERE path LIKE '%.py') SELECT module, path FROM mods
UNION ALL SELECT replace(split_part(path, '/', 1), '/', '.') || '.pkg', split_part(path, '/', 1) || '/pkg/__init__.py' FROM mods UNION ALL SELECT replace(split_part(path, '/', 1), '/', '.') || '.pkg.__init__', split_part(path, '/', 1) || '/pkg/__init__.py' FROM mods""")
def module_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = B.page_files(spark, sf_dir).where("path like '%.py' or path like '%.ts'")
    packages = files.where("path like '%.py'").select(F.concat(F.split("path", "/")[0], F.lit("/pkg/__init__.py")).alias("path"))
    return graphs.module_map(files.select("path").unionByName(packages))


@query(f"""WITH {PAGES}, src AS (SELECT path, ord, regexp_replace(path, '/[^/]*$', '') AS dir FROM paths),
tried AS (SELECT path, ord, dir || '/test_main' AS base, 0 AS way FROM src UNION ALL SELECT path, ord, regexp_replace(dir, '/[^/]*$', '') || '/' || regexp_extract(dir, '[^/]*$') || '/model', 1 FROM src),
hit AS (SELECT t.path AS src, t.way, t.base || s.x AS dst, s.k FROM tried t CROSS JOIN (SELECT unnest(['.py', '.js', '.ts', '.jsx', '.tsx', '']) AS x, unnest(range(6)) AS k) s WHERE t.base || s.x IN (SELECT path FROM paths))
SELECT DISTINCT src, way::int AS ord, arg_min(dst, k) OVER (PARTITION BY src, way) AS dst FROM hit UNION ALL SELECT DISTINCT path, 2, 'os.path' FROM paths""")
def resolve_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = B.page_files(spark, sf_dir).select("path").distinct()
    own = F.regexp_extract(S.directory(F.col("path")), "[^/]*$", 0)
    imports = files.select("path", F.posexplode(F.array(F.lit("./test_main"), F.concat(F.lit("../"), own, F.lit("/model")), F.lit("os.path"))).alias("ord", "module"))
    return graphs.resolve_imports(imports, files)


@query(f"""WITH {PAGES} SELECT path FROM paths WHERE NOT (list_contains(string_split(path, '/'), 'build') OR list_contains(string_split(path, '/'), 'node_modules') OR len(list_filter(string_split(path, '/'), lambda p: p LIKE '%.sh')) > 0 OR regexp_full_match(path, '(?s).*/de/.*/index.*') OR regexp_extract(path, '[^/]*$') LIKE 'settings.____' )""")
def gitignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.not_ignored(B.page_files(spark, sf_dir), ["# made", "build/", "node_modules/", "*.sh", "*/de/*/index*", "settings.????", "!keep.sh"]).select("path")


@query(f"""WITH {PAGES} SELECT path FROM paths WHERE regexp_extract(path, '\\.[^./]+$') IN ('.html', '.py', '.json', '.ts', '.md', '.sh', '.js') AND NOT list_contains(string_split(path, '/'), 'build')""")
def should_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.indexable(B.page_files(spark, sf_dir)).select("path")


@query("""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '\\b(\\w+)\\s*\\(', 1))), ',') AS calls FROM pages""")
def extract_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(F.array_distinct(S.raw_calls(F.col("html")))), ",").alias("calls"))


@query("""SELECT page_id, array_to_string(list_sort(list_intersect(list_distinct(regexp_extract_all(html, '\\b(\\w+)\\s*\\(', 1)), ['track', 'print', 'load'])), ',') AS calls FROM pages""")
def known_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    defined = F.array(F.lit("track"), F.lit("print"), F.lit("load"))
    return B.table(spark, sf_dir, "pages").select("page_id", F.array_join(S.known_calls(F.col("html"), defined, fixed.SCRIPT_EXCLUDED), ",").alias("calls"))


@query("""SELECT page_id, array_to_string(list_slice(regexp_extract_all(substr(html, 1, 5000), '(?m)^#{1,3}\\s+(.+)$', 1), 1, 10), '|') AS sections FROM (SELECT page_id, '# ' || url || chr(10) || '#### deep' || chr(10) || '## ' || page_id || chr(10) || html AS html FROM pages)""")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("# "), "url", F.lit("\n#### deep\n## "), F.col("page_id").cast("string"), F.lit("\n"), "html")
    return B.table(spark, sf_dir, "pages").select("page_id", F.array_join(S.sections(text), "|").alias("sections"))


@query(f"""WITH {SNAPSHOTS} SELECT n.path, NOT coalesce(n.mtime = c.mtime AND n.size = c.size, false) AND NOT coalesce(n.content_hash = c.content_hash, false) AS dirty,
NOT coalesce(n.mtime = c.mtime AND n.size = c.size, false) AND coalesce(n.content_hash = c.content_hash, false) AS refresh FROM now n LEFT JOIN cached c USING (root, path)""")
def dirty_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, cached = B.snapshots(spark, sf_dir)
    return incremental.dirty_files(now, cached, "1").select("path", "dirty", "refresh")


@query(f"""WITH {SNAPSHOTS}, s AS (SELECT NOT coalesce(n.mtime = c.mtime AND n.size = c.size, false) AND NOT coalesce(n.content_hash = c.content_hash, false) AS dirty FROM now n LEFT JOIN cached c USING (root, path))
SELECT count(*) AS files, count(*) FILTER (dirty) AS dirty, count(*) FILTER (dirty) > 0.5 * count(*) AS rebuild FROM s""")
def dirty_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, cached = B.snapshots(spark, sf_dir)
    return incremental.dirty_fraction(incremental.dirty_files(now, cached, "1"))


@query(f"WITH {SNAPSHOTS} SELECT path FROM cached WHERE path NOT IN (SELECT path FROM now)")
def purge_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, cached = B.snapshots(spark, sf_dir)
    return incremental.removed_files(cached, now).select("path")


@query(f"WITH {SNAPSHOTS} SELECT path, content_hash FROM now UNION ALL SELECT path, content_hash FROM cached WHERE path NOT IN (SELECT path FROM now)")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, cached = B.snapshots(spark, sf_dir)
    return incremental.upsert(cached, now.withColumn("tool_version", F.lit("1"))).select("path", "content_hash")


@query("SELECT substr(sha256(string_agg(p || ':' || p, '' ORDER BY p)), 1, 16) AS files_hash FROM (SELECT doc_id::varchar AS p FROM documents)")
def files_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("doc_id").cast("string")
    return incremental.files_hash(B.table(spark, sf_dir, "documents").select(path.alias("path"), path.alias("mtime")))


@query("""WITH f AS (SELECT doc_id, n_chars % 13 AS importance, n_chars AS size FROM documents), t AS (SELECT greatest(10, floor(count(*) * (200000 / sum(size)) * 0.9))::bigint AS keep, sum(size) AS s FROM f)
SELECT doc_id, importance FROM (SELECT *, row_number() OVER (ORDER BY importance DESC, doc_id) AS k FROM f) WHERE k <= (SELECT CASE WHEN s <= 200000 THEN 1000000000 ELSE keep END FROM t)""")
def budget_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = B.table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 13).alias("importance"), F.col("doc_id").alias("ord"), F.col("n_chars").alias("size"))
    return budget.top_files(files, 200_000).select("doc_id", "importance")


@query("""SELECT doc_id, (n_chars // 4) // 1000 AS tokens_k, sha256(coalesce(text, '')) AS content_hash FROM documents""")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "documents").select("doc_id", S.token_estimate(F.col("n_chars")).alias("tokens_k"), S.content_hash(F.coalesce("text", F.lit("")).cast("binary")).alias("content_hash"))


@query("""SELECT p_partkey, p_name || ':' || p_size || ':' || replace(replace('(x: ' || p_type || ') -> ' || p_brand, ' -> ', '>'), ': ', ':') || ':' || p_brand || ',' || p_type || ':' || p_name AS dense, p_name AS name, p_size::varchar AS line FROM part""")
def dense_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    signature = F.concat(F.lit("(x: "), "p_type", F.lit(") -> "), "p_brand")
    dense = S.dense_function(F.col("p_name"), F.col("p_size"), signature, F.array("p_brand", "p_type"), F.col("p_name"))
    return B.table(spark, sf_dir, "part").select("p_partkey", dense.alias("dense"), S.dense_name(dense).alias("name"), S.dense_line(dense).alias("line"))


@query("SELECT DISTINCT 'd' || doc_id AS path FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"))
    return incremental.changed(docs.where("doc_id % 3 = 0"), docs.where("doc_id % 5 = 0"))


@query(f"WITH {FILES} SELECT path FROM (SELECT path, row_number() OVER (ORDER BY ord) AS k FROM files) WHERE k <= 10000")
def max_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.first_files(B.document_files(spark, sf_dir)).select("path")
