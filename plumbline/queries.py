"""Queries over the tables, each with SQL that must return the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import names as N
from .functions import text as X
from .model import ordered, violations
from .operators import duplicates as D
from .operators import graphs as G
from .operators import relational as R
from .storage import written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NORMAL = r"regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\n(?:[ \t]*\n)+', E'\n\n', 'g')"
LINES = "len(list_filter(string_split({0}, chr(10)), lambda x: trim(x, E' \\t\\r\\n\\v\\f') <> ''))"
TOKENS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> ''))"
CHUNKS = f"n AS (SELECT doc_id, {NORMAL} AS t FROM documents), c AS (SELECT doc_id, t, sha256(t) AS hash, {LINES.format('t')} AS loc FROM n WHERE {LINES.format('t')} >= 5 AND {TOKENS.format('t')} >= 20)"


@query(f"SELECT doc_id, {NORMAL} AS text FROM documents")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.normalized(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {LINES.format('text')} AS n_lines, {TOKENS.format('text')} AS n_tokens, {LINES.format('text')} >= 5 AND {TOKENS.format('text')} >= 20 AS eligible FROM documents")
def chunk_gate(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select("doc_id", X.filled_lines(text).alias("n_lines"), X.token_count(text).alias("n_tokens"), X.eligible(text).alias("eligible"))


@query(f"WITH {CHUNKS}, g AS (SELECT hash, min(doc_id) AS representative, count(*) AS members FROM c GROUP BY hash HAVING count(*) > 1) SELECT doc_id, representative, members FROM c JOIN g USING (hash)")
def exact_duplicates(spark, sf):
    return D.copies(table(spark, sf, "documents"), "doc_id")


@query(f"WITH {CHUNKS}, b AS (SELECT DISTINCT hash FROM c WHERE doc_id % 2 = 0) SELECT doc_id, c.hash, b.hash IS NOT NULL AS hit FROM c LEFT JOIN b ON b.hash = c.hash")
def cache_miss_split(spark, sf):
    """Which chunks a cache filled by the even documents holds."""
    found = D.chunks(table(spark, sf, "documents"), "doc_id").select("doc_id", "hash")
    return D.cache_split(found, found.where("doc_id % 2 = 0"))


WINDOWS = "l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \\t\\r\\n\\v\\f')), lambda x: x <> '') AS w FROM documents), v AS (SELECT doc_id, CAST(i AS INT) AS line, sha256(array_to_string(w[i + 1 : i + 3], chr(10))) AS window_ FROM l, unnest(range(0, len(w) - 2)) AS u(i) WHERE len(w) >= 3)"


@query(f"WITH {WINDOWS}, o AS (SELECT window_, count(*) AS members FROM v GROUP BY window_ HAVING count(*) >= 4) SELECT doc_id, line, window_ AS \"window\", members FROM v JOIN o USING (window_)")
def window_clones(spark, sf):
    return D.window_clones(table(spark, sf, "documents"), "doc_id").select("doc_id", "line", "window", "members")


@query(f"WITH {CHUNKS} SELECT hash, count(*) AS members, min(loc) AS min_loc, min(loc) * count(*) >= 20 OR count(*) >= 4 AS reported FROM c GROUP BY hash HAVING count(*) > 1")
def report_gate(spark, sf):
    groups = D.chunks(table(spark, sf, "documents"), "doc_id").groupBy("hash").agg(F.count("*").alias("members"), F.min("loc").alias("min_loc")).where("members > 1")
    return D.gate(groups)


#: The test vectors reach no higher than about 0.6; the rule's default is 0.9.
COSINE = 0.4
PAIRS = f"p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= {COSINE})"
COMPONENTS = f"{PAIRS}, e AS (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p), r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v), k AS (SELECT u AS vec_id, least(u, min(v)) AS primary_id FROM r GROUP BY u)"


def _similar(spark, sf):
    return D.similar_vectors(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), COSINE)


@query(f"WITH {PAIRS} SELECT a, b, round(cosine, 6) AS cosine FROM p")
def cosine_pairs(spark, sf):
    return _similar(spark, sf).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query(f"WITH RECURSIVE {COMPONENTS} SELECT vec_id, primary_id FROM k")
def cosine_clusters(spark, sf):
    return D.clusters(_similar(spark, sf)).select(F.col("id").alias("vec_id"), F.col("primary").alias("primary_id"))


@query(f"WITH RECURSIVE {COMPONENTS} SELECT primary_id, count(*) AS members, CAST(primary_id AS VARCHAR) || ' is similar to ' || array_to_string(list_sort(list(vec_id) FILTER (vec_id <> primary_id)), ', ') AS message FROM k GROUP BY primary_id")
def cluster_primary(spark, sf):
    """One report a cluster, which lists the others."""
    found = D.clusters(_similar(spark, sf)).groupBy("primary").agg(F.count("*").alias("members"), F.sort_array(F.collect_list(F.when(F.col("id") != F.col("primary"), F.col("id")))).alias("others"))
    return found.select(F.col("primary").alias("primary_id"), "members", F.concat(F.col("primary").cast("string"), F.lit(" is similar to "), F.array_join(F.col("others").cast("array<string>"), ", ")).alias("message"))


@query(
    "WITH n AS (SELECT DISTINCT p_name, list_distinct(string_split(upper(replace(p_name, ' ', '_')), '_')) AS t FROM part) SELECT a.p_name AS a, b.p_name AS b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard FROM n a JOIN n b ON a.p_name < b.p_name WHERE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.3"
)
def jaccard_pairs(spark, sf):
    found = table(spark, sf, "part").select(F.col("p_name").alias("key")).distinct().withColumn("tokens", N.tokens(F.regexp_replace("key", " ", "_")))
    return D.similar_sets(found, 0.3).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


NAME = "regexp_replace(regexp_replace({0}, '^(?:DEFAULT_|LEGACY_|CFG_|CONFIG_)(.)', '\\1'), '(.)(?:_SECONDS|_STEPS|_COUNT|_SEC|_MS|_S|_N)$', '\\1')"


@query(f"WITH t AS (SELECT DISTINCT p_type FROM part), n AS (SELECT 'Default_' || replace(p_type, ' ', '_') || '_ms' AS name FROM t UNION ALL SELECT 'cfgMax' || replace(p_type, ' ', '') FROM t) SELECT name, {NAME.format(chr(39).join(['upper(regexp_replace(name, ', '([a-z0-9])([A-Z])', ', ', chr(92) + '1_' + chr(92) + '2', ', ', 'g', '))']))} AS normal FROM n")
def name_normalize(spark, sf):
    kinds = table(spark, sf, "part").select("p_type").distinct()
    snake = kinds.select(F.concat(F.lit("Default_"), F.regexp_replace("p_type", " ", "_"), F.lit("_ms")).alias("name"))
    camel = kinds.select(F.concat(F.lit("cfgMax"), F.regexp_replace("p_type", " ", "")).alias("name"))
    return snake.unionByName(camel).select("name", N.normal(F.col("name")).alias("normal"))


@query("WITH w AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT p_name || '_LIMIT' FROM part WHERE p_size < 10 UNION SELECT DISTINCT 'FORCE_' || p_brand FROM part) SELECT name, name LIKE 'FORCE#_%' ESCAPE '#' OR name LIKE '%#_LIMIT' ESCAPE '#' OR regexp_matches(lower(name), 'cap|budget|threshold|timeout|tolerance|deadline|limit|max_steps|min_steps') AS gated FROM w")
def lexicon_gate(spark, sf):
    part = table(spark, sf, "part")
    found = part.select(F.col("p_name").alias("name")).union(part.where("p_size < 10").select(F.concat("p_name", F.lit("_LIMIT")))).union(part.select(F.concat(F.lit("FORCE_"), "p_brand"))).distinct()
    return found.select("name", N.gated(F.col("name")).alias("gated"))


@query(
    "WITH p(prefix) AS (VALUES ('Brand'), ('Brand#'), ('Brand#1'), ('Brand#2'), ('Brand#12'), ('Bran')), b AS (SELECT DISTINCT p_brand FROM part) SELECT p_brand, arg_max(prefix, length(prefix)) AS prefix FROM b LEFT JOIN p ON starts_with(p_brand, prefix) AND regexp_matches(substr(p_brand, length(prefix) + 1), '^[0-9]*$') GROUP BY p_brand"
)
def longest_prefix(spark, sf):
    prefixes = spark.createDataFrame([("Brand",), ("Brand#",), ("Brand#1",), ("Brand#2",), ("Brand#12",), ("Bran",)], "prefix string")
    return R.longest_prefix(table(spark, sf, "part").select("p_brand").distinct(), "p_brand", prefixes, r"^[0-9]*\z")


@query("SELECT o_orderkey FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey")
def untested_exports(spark, sf):
    """What is exported and never referred to."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_anti")


@query("SELECT c_custkey, count(o_orderkey) AS n_uses FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) <= 1")
def single_use(spark, sf):
    return R.uses(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def docs_honesty(spark, sf):
    """What only the code side, or only the documented side, has."""
    return R.outer_difference(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("WITH s AS (SELECT conv_id, list_distinct(list(role)) AS seen FROM conversations GROUP BY conv_id) SELECT conv_id, list_sort(list_filter(['system', 'user', 'assistant'], lambda x: NOT list_contains(seen, x))) AS missing FROM s WHERE len(list_filter(['system', 'user', 'assistant'], lambda x: NOT list_contains(seen, x))) > 0")
def missing_fields(spark, sf):
    return R.missing(table(spark, sf, "conversations"), "conv_id", "role", F.array(F.lit("system"), F.lit("user"), F.lit("assistant")))


@query(
    "WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), f AS (SELECT *, min(CASE WHEN event_type = 'error' THEN k END) OVER w AS e, min(CASE WHEN event_type = 'purchase' THEN k END) OVER w AS p FROM o WINDOW w AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) SELECT event_id, user_id FROM f WHERE event_type = 'view' AND e IS NOT NULL AND (p IS NULL OR e < p)"
)
def sequence_violation(spark, sf):
    """A view that an error follows before the next purchase."""
    return R.followed_before(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type", "view", "error", "purchase").select("event_id", "user_id")


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def first_by_position(spark, sf):
    return R.first_by(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], "event_id")


@query(
    f"WITH {CHUNKS}, h AS (SELECT doc_id, 0 AS rank, min(doc_id) OVER (PARTITION BY hash) AS canonical, count(*) OVER (PARTITION BY hash) AS n FROM c UNION ALL SELECT doc_id, 1, min(doc_id) OVER (PARTITION BY regexp_replace(text, '[ \t\n]+', '', 'g')), count(*) OVER (PARTITION BY regexp_replace(text, '[ \t\n]+', '', 'g')) FROM documents), b AS (SELECT doc_id, min(rank) AS rank FROM h WHERE n > 1 AND doc_id > canonical GROUP BY doc_id) SELECT b.doc_id, CASE rank WHEN 0 THEN 'exact' ELSE 'spacing' END AS arm, canonical FROM b JOIN h USING (doc_id, rank)"
)
def arm_dedupe(spark, sf):
    """One hit a document, of the exact arm before that of texts that differ in spacing only."""
    docs = table(spark, sf, "documents")
    exact = D.copies(docs, "doc_id").select("doc_id", F.lit(0).alias("rank"), F.lit("exact").alias("arm"), F.col("representative").alias("canonical"))
    spacing = written(docs.select("doc_id", F.sha2(F.translate("text", " \t\n", ""), 256).alias("bare")), "bare")
    groups = spacing.groupBy("bare").agg(F.min("doc_id").alias("canonical"), F.count("*").alias("n")).where("n > 1")
    near = spacing.join(groups, "bare").select("doc_id", F.lit(1).alias("rank"), F.lit("spacing").alias("arm"), "canonical")
    return D.first_arm(exact.unionByName(near).where("doc_id > canonical"), ["doc_id"], F.col("rank"), [F.col("canonical")]).select("doc_id", "arm", "canonical")


@query("SELECT event_id, CAST(props AS JSON)->>'k' AS k, CASE WHEN event_id % 97 = 0 THEN false ELSE try_cast(props AS JSON) IS NOT NULL END AS valid FROM events")
def schema_validate(spark, sf):
    """Whether props are JSON; every 97th is spoilt first, so that there are bad rows."""
    events = table(spark, sf, "events")
    spoilt = F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.try_parse_json(spoilt).isNotNull().alias("valid"))


@query(f"WITH RECURSIVE {PAIRS}, e AS (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p), r AS (SELECT vec_id FROM embeddings WHERE vec_id % 25 = 0 UNION SELECT e.v FROM r JOIN e ON e.u = r.vec_id) SELECT vec_id FROM r")
def import_closure(spark, sf):
    """What undirected edges reach from seeds, the seeds included."""
    edges = _similar(spark, sf).select(F.col("a").alias("u"), F.col("b").alias("v"))
    seeds = table(spark, sf, "embeddings").where("vec_id % 25 = 0").select(F.col("vec_id").alias("node"))
    return G.closure(edges, seeds).select(F.col("node").alias("vec_id"))


@query("WITH s AS (SELECT p_brand AS rule, 0 AS layer, 'error' AS severity FROM part UNION ALL SELECT p_brand, 1, 'warn' FROM part WHERE p_size = 7 UNION ALL SELECT p_brand, 2, 'off' FROM part WHERE p_size = 11 AND p_brand LIKE '%3') SELECT rule, arg_max(severity, layer) AS severity FROM s GROUP BY rule HAVING arg_max(severity, layer) <> 'off'")
def severity_overlay(spark, sf):
    part = table(spark, sf, "part")
    layers = [part.where(where).select(F.col("p_brand").alias("rule"), F.lit(k).alias("layer"), F.lit(s).alias("severity")) for k, s, where in ((0, "error", "true"), (1, "warn", "p_size = 7"), (2, "off", "p_size = 11 AND p_brand LIKE '%3'"))]
    return R.overlay(layers[0].unionByName(layers[1]).unionByName(layers[2]), ["rule"], "layer", "severity").where("severity <> 'off'")


@query(
    f"WITH {CHUNKS}, g AS (SELECT hash, min(doc_id) AS r, count(*) AS n, min(loc) AS l FROM c GROUP BY hash HAVING count(*) > 1 AND (min(loc) * count(*) >= 20 OR count(*) >= 4)) "
    "SELECT 'exact-copy' AS rule_id, 'error' AS severity, 'doc/' || c.doc_id AS file, 1 AS start_line, 1 AS start_col, CAST(loc AS INT) AS end_line, 1 AS end_col, 'copy of doc/' || r AS message, 'Keep doc/' || r || ' only.' AS suggestion FROM c JOIN g USING (hash) WHERE doc_id <> r "
    "UNION ALL SELECT 'unlabelled', 'warn', 'doc/' || doc_id, 1, 1, 1, 1, 'no label', 'No suggestion available for this rule.' FROM documents ANTI JOIN labels USING (doc_id)"
)
def violation_sort(spark, sf):
    """Reports of two rules as one relation in the global order."""
    docs = table(spark, sf, "documents")
    found = D.hashes(docs, "doc_id")
    groups = D.gate(found.groupBy("hash").agg(F.min("doc_id").alias("r"), F.count("*").alias("members"), F.min("loc").alias("min_loc"))).where("reported")
    file = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    rep = F.concat(F.lit("doc/"), F.col("r").cast("string"))
    copies = violations(found.join(groups, "hash").where("doc_id <> r"), "exact-copy", F.concat(F.lit("copy of "), rep), F.concat(F.lit("Keep "), rep, F.lit(" only.")), file=file, line=F.lit(1), col=F.lit(1), end_line="loc", end_col=F.lit(1))
    bare = violations(docs.join(table(spark, sf, "labels"), "doc_id", "left_anti"), "unlabelled", "no label", severity="warn", file=file, line=F.lit(1), col=F.lit(1), end_line=F.lit(1), end_col=F.lit(1))
    return ordered(copies.unionByName(bare))


@query(r"SELECT page_id, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_matches(url, '(?:^|/)(?:en|fr)/') AS skipped FROM pages")
def path_skip(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1).alias("path"), F.col("url").rlike(r"(?:^|/)(?:en|fr)/").alias("skipped"))


@query("""SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links, len(regexp_extract_all(html, '<[a-zA-Z][^>]*>')) AS n_tags FROM pages""")
def html_scan(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1).alias("links"), F.size(F.regexp_extract_all("html", F.lit("<[a-zA-Z][^>]*>"), 0)).cast("long").alias("n_tags"))


@query("SELECT conv_id, turn, role, lead(role) OVER w AS next_role, lead(turn) OVER w - turn AS gap FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def turn_nesting(spark, sf):
    """Each turn with the next of its conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.lead("role").over(w).alias("next_role"), (F.lead("turn").over(w) - F.col("turn")).alias("gap"))


@query("SELECT DISTINCT p_brand AS rule FROM part WHERE p_size = 7 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 11)")
def unknown_rules(spark, sf):
    part = table(spark, sf, "part").withColumnRenamed("p_brand", "rule")
    return R.unknown(part.where("p_size = 7"), part.where("p_size = 11"), "rule")


@query("SELECT DISTINCT p_type AS plugin, p_brand AS rule FROM part WHERE p_type IN (SELECT p_type FROM part WHERE p_size = 3) AND p_brand <> 'Brand#12'")
def rule_selection(spark, sf):
    part = table(spark, sf, "part")
    rules = part.select(F.col("p_type").alias("plugin"), F.col("p_brand").alias("rule")).distinct()
    # The plugins that a configuration names are a short list.
    plugins = [r["p_type"] for r in part.where("p_size = 3").select("p_type").distinct().collect()]
    return R.selected(rules, plugins).where("rule <> 'Brand#12'").select("plugin", "rule")


@query("SELECT CAST(u.user_id AS VARCHAR) AS rule, event_type AS artifact FROM (SELECT DISTINCT user_id, event_type FROM events) u WHERE false UNION ALL SELECT array_to_string(list_sort(list(DISTINCT CAST(user_id AS VARCHAR))), ','), event_type FROM events GROUP BY event_type")
def artifact_demand(spark, sf):
    """For each artifact the rules that ask for it."""
    rules = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("rule")).agg(F.collect_set("event_type").alias("requires"))
    return R.demand(rules).select(F.array_join("rules", ",").alias("rule"), "artifact")


@query("SELECT CAST(doc_id AS VARCHAR) AS path, bool_or(quality = 0) AS dirty, bool_or(toxic = 1) AS untracked, bool_or(tracked) AS tracked FROM (SELECT doc_id, quality, toxic, false AS tracked FROM labels WHERE quality = 0 OR toxic = 1 UNION ALL SELECT doc_id, 1, 0, true FROM documents WHERE lang = 'fr') x GROUP BY doc_id")
def git_flags(spark, sf):
    """Three lists of paths as one row of flags for each path."""
    labels, docs = table(spark, sf, "labels"), table(spark, sf, "documents")
    path = F.col("doc_id").cast("string").alias("path")
    return R.flags_of(("dirty", labels.where("quality = 0").select(path)), ("untracked", labels.where("toxic = 1").select(path)), ("tracked", docs.where("lang = 'fr'").select(path)))


@query("WITH p AS (SELECT doc_id AS a, doc_id + 1 AS b FROM documents WHERE doc_id % 3 = 0), c AS (SELECT doc_id FROM documents WHERE doc_id % 12 = 0) SELECT doc_id FROM c UNION SELECT b FROM p WHERE a IN (SELECT doc_id FROM c) AND b IN (SELECT doc_id FROM documents) UNION SELECT a FROM p WHERE b IN (SELECT doc_id FROM c)")
def companion_closure(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("path"))
    pairs = docs.where("path % 3 = 0").select(F.col("path").alias("a"), (F.col("path") + 1).alias("b"))
    return G.with_companions(docs.where("path % 12 = 0"), pairs, docs).select(F.col("path").alias("doc_id"))


@query()
def overlap_suppression(spark, sf):
    """Greedy, so beyond SQL; tests hold it against a plain loop."""
    found = D.window_clones(table(spark, sf, "documents"), "doc_id", 3, 2)
    rows = found.select(F.col("doc_id").alias("file"), F.when(F.col("members") >= 4, "F").otherwise("W").alias("arm"), F.col("line").alias("start_line"), F.lit(1).alias("start_col"), (F.col("line") + F.col("members") % 5).cast("int").alias("end_line"))
    return D.without_overlaps(rows)


@query(
    "WITH c AS (SELECT p_brand AS package_dir, p_type AS file, p_name AS name, min(p_size) AS value FROM part GROUP BY ALL HAVING count(*) = 1), r AS (SELECT *, row_number() OVER w AS k, first_value(file) OVER w AS canonical, first_value(value) OVER w AS c_value FROM c WINDOW w AS (PARTITION BY package_dir, name ORDER BY file)) SELECT package_dir, file, name, canonical, value <> c_value AS disagrees FROM r WHERE k > 1 AND NOT (length(name) % 2 = 0 AND file LIKE 'PROMO%')"
)
def exact_arm(spark, sf):
    """Names defined once in a file and again in another file of the package; some files import the canonical one and are silent."""
    cards = table(spark, sf, "part").groupBy(F.col("p_brand").alias("package_dir"), F.col("p_type").alias("file"), F.col("p_name").alias("name")).agg(F.count("*").alias("n"), F.min("p_size").alias("value")).where("n = 1")
    first = cards.groupBy("package_dir", "name").agg(F.min(F.struct("file", "value")).alias("c"))
    extra = cards.join(first, ["package_dir", "name"]).where(F.col("file") != F.col("c.file"))
    imports = cards.where("length(name) % 2 = 0 AND file LIKE 'PROMO%'").select("package_dir", "file", "name")
    silent = extra.join(imports, ["package_dir", "file", "name"], "left_anti")
    return silent.select("package_dir", "file", "name", F.col("c.file").alias("canonical"), (F.col("value") != F.col("c.value")).alias("disagrees"))


@query(
    "WITH f AS (SELECT DISTINCT regexp_extract(url, '^https?://([^?#]*)', 1) AS file FROM pages), r AS (SELECT DISTINCT regexp_replace(file, '/?[^/]*$', '') AS package_dir FROM f WHERE length(file) % 3 = 0) SELECT file, coalesce(arg_max(package_dir, length(package_dir)), '') AS package_dir FROM f LEFT JOIN r ON package_dir = '' OR starts_with(file, package_dir || '/') GROUP BY file"
)
def package_root(spark, sf):
    """The nearest folder above each path that holds a project file."""
    from .sources.python_ast import package_roots

    paths = table(spark, sf, "pages").select(F.regexp_extract("url", "^https?://([^?#]*)", 1).alias("path")).distinct()
    return package_roots(paths, paths.where("length(path) % 3 = 0"))


@query("SELECT 'pkg/nation_' || c_nationkey || '.py' AS file, count(*) AS n_defs, count(*) FILTER (c_acctbal < 0) AS n_untyped, count(*) FILTER (c_acctbal >= 9000) AS n_mutable FROM customer GROUP BY c_nationkey")
def python_scan(spark, sf):
    """Python files made of rows, parsed, and checked by two rules through the engine."""
    from .plans import engine, python_rules  # noqa: F401
    from .sources.python_ast import python_nodes

    default = F.when(F.col("c_acctbal") >= 9000, " = []").otherwise("")
    line = F.concat(F.lit("def f_"), F.col("c_custkey").cast("string"), F.when(F.col("c_acctbal") < 0, "(a").otherwise("(a: int"), default, F.lit(") -> int:\n    return a\n"))
    files = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_join(F.collect_list(line), "").alias("text")).select(F.concat(F.lit("pkg/nation_"), F.col("c_nationkey").cast("string"), F.lit(".py")).alias("path"), "text")
    nodes = python_nodes(files)
    rules = ("python/require-typed-public", "python/no-mutable-default")
    found = engine.check(spark, {r: ("error", {}) for r in rules}, engine.Inputs({"python": lambda _: nodes}))
    defs = nodes.where("type = 'FunctionDef'").groupBy("file").agg(F.count("*").alias("n_defs"))
    by_rule = found.groupBy("file").agg(*[F.count_if(F.col("rule_id") == r).alias(n) for r, n in zip(rules, ("n_untyped", "n_mutable"), strict=True)])
    return defs.join(by_rule, "file", "left").select("file", "n_defs", F.coalesce("n_untyped", F.lit(0)).alias("n_untyped"), F.coalesce("n_mutable", F.lit(0)).alias("n_mutable"))


@query("SELECT 'src/nation_' || s_nationkey || '.ts' AS file, count(*) FILTER (s_acctbal < 0) AS n_empty, count(*) FILTER (s_acctbal >= 5000) AS n_bang FROM supplier GROUP BY s_nationkey")
def typescript_scan(spark, sf):
    """TypeScript files made of rows, cut into tokens, and checked by two rules through the engine."""
    from .plans import engine, typescript_rules  # noqa: F401
    from .sources.typescript import typescript_tokens

    body = F.when(F.col("s_acctbal") < 0, "{ /* none */ }").when(F.col("s_acctbal") >= 5000, "{ g(e!) }").otherwise("{ g(`e!`) }")
    line = F.concat(F.lit("try { f() } catch (e) "), body, F.lit("\n"))
    files = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(line), "").alias("text")).select(F.concat(F.lit("src/nation_"), F.col("s_nationkey").cast("string"), F.lit(".ts")).alias("path"), "text")
    tokens = typescript_tokens(files)
    rules = ("ts/no-empty-catch", "ts/no-non-null-assertion")
    found = engine.check(spark, {r: ("error", {}) for r in rules}, engine.Inputs({"typescript": lambda _: tokens}))
    by_rule = found.groupBy("file").agg(*[F.count_if(F.col("rule_id") == r).alias(n) for r, n in zip(rules, ("n_empty", "n_bang"), strict=True)])
    return files.select(F.col("path").alias("file")).join(by_rule, "file", "left").select("file", F.coalesce("n_empty", F.lit(0)).alias("n_empty"), F.coalesce("n_bang", F.lit(0)).alias("n_bang"))

from . import rule_queries  # noqa: E402, F401  registers its queries
