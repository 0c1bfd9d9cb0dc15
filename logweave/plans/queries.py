"""The queries of the log operators over the driver's tables, and their SQL in DuckDB's dialect.

The tables hold no logs, so views stand in: statements from part (a binary tree), log lines and messages from events,
source lines from documents, hunks from pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions import edits
from logweave.functions import text as t
from logweave.operators import diff, dominators, graph, logs, sequences
from logweave.operators import templates as template_parser
from logweave.sources import java, tables
from logweave.streaming import logs as streaming
from logweave.streaming import sequences as streams

DAY = 86_400_000_000
PARENTS = {"purchase": "click", "click": "view", "error": "view"}
TEMPLATE_ROWS = [
    (0, "{Type0} value {Value1} by user {UserId2}"),
    (1, "purchase value {Value0} by user {UserId1}"),
    (2, "view value {Value0} by {Rest1}"),
    (3, "error value {Value0} by user {UserId1}"),
    (4, "{Any0}"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- views


def raw_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine columns as an extractor gives them."""
    id_ = F.col("p_partkey") + 1
    name = F.element_at(F.array(*[F.lit(x) for x in ("UserId", "Count", "HostName", "Ship")]), (id_ % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.when(id_ == 1, -1).otherwise(F.floor(id_ / 2)).cast("int").alias("idom_id"),
        id_.cast("int").alias("event_id"),
        F.concat(F.lit("src/main/"), F.col("p_brand"), F.lit(".java")).alias("path"),
        F.lit("app").alias("package"), F.col("p_brand").alias("class"), F.lit("run").alias("method"), F.col("p_size").alias("line_number"),
        F.lower(F.element_at(F.array(F.lit("Info"), F.lit("Warn"), F.lit("Error")), (id_ % 3 + 1).cast("int"))).alias("level"),
        F.concat(F.col("p_name"), F.lit(' "{'), name, F.lit('0}" \\{x\\}')).alias("template"),
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.project_statements(raw_statements(spark, sf_dir))


STMT = r"""stmt AS (
  SELECT CASE WHEN p_partkey = 0 THEN NULL ELSE CAST((p_partkey + 1) // 2 AS INTEGER) END AS idom_id, CAST(p_partkey + 1 AS INTEGER) AS event_id,
    p_brand || '.java' AS file_name, p_size AS line_number, ['INFO', 'WARN', 'ERROR'][(p_partkey + 1) % 3 + 1] AS level,
    p_name || ' "{' || ['UserId', 'Count', 'HostName', 'Ship'][(p_partkey + 1) % 4 + 1] || '0}" \{x\}' AS template,
    ['UserId', 'Count', 'HostName', 'Ship'][(p_partkey + 1) % 4 + 1] || '0' AS name, (p_partkey + 1) % 4 <> 1 AS has_id
  FROM part)"""
CHAIN = """chain AS (
  SELECT event_id, idom_id AS ancestor, 1 AS depth FROM stmt WHERE idom_id IS NOT NULL
  UNION ALL SELECT c.event_id, s.idom_id, c.depth + 1 FROM chain c JOIN stmt s ON c.ancestor = s.event_id WHERE s.idom_id IS NOT NULL)"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of events; every seventh has a month 13."""
    e = table(spark, sf_dir, "events")
    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSSSSS")
    ts = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("2024-13-01"), F.substring(ts, 11, 20))).otherwise(ts)
    line = F.concat(ts, F.lit(" INFO  [main] x.Y (Brand#"), (F.col("event_id") % 25).cast("string"), F.lit(".java:run("), (F.col("user_id") % 50).cast("string"), F.lit(")) - "), "event_type")
    return e.select("event_id", F.regexp_replace(line, "#", "").alias("line"))


PARSED = """parsed AS (
  SELECT event_id AS line_id, ts, 'Brand' || event_id % 25 || '.java' AS file_name, CAST(user_id % 50 AS INTEGER) AS line_number FROM events WHERE event_id % 7 <> 0)"""


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("stream"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("seq"), F.col("event_type").alias("item"))


def sequence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.rolling_sequences(event_rows(spark, sf_dir), window_us=DAY)


EVENT = "e AS (SELECT user_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"
SEQ = f"""seqs AS (
  SELECT a.user_id AS stream, a.rn AS seq, list_slice(list(b.event_type ORDER BY b.rn), 1, 16) AS items FROM e a JOIN e b ON a.user_id = b.user_id AND b.rn <= a.rn AND b.us > a.us - {DAY}
  GROUP BY a.user_id, a.rn HAVING count(*) >= 2)"""
TYPES = "types AS (SELECT DISTINCT event_type AS x FROM events)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat("event_type", F.lit(" value "), F.round(F.col("value") * 100).cast("long").cast("string"), F.lit(" by user "), F.col("user_id").cast("string")).alias("message"))


def typed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("stream"), F.row_number().over(order).cast("long").alias("seq"), F.col("event_type").alias("type"), F.round(F.col("value") * 100).cast("long").cast("string").alias("value"))


def hunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a page, tags as parentheses, as the lines of a hunk; their place gives the origin."""
    html = F.replace(F.translate(F.coalesce("html", F.lit("")), "<>", "()"), F.lit("track("), F.lit("logger.info( host,"))
    words = table(spark, sf_dir, "pages").select(F.col("page_id").alias("commit"), F.lit(0).alias("hunk"), F.posexplode(F.split(html, " ")).alias("line_no", "content"))
    return words.withColumn("origin", F.element_at(F.array(F.lit(" "), F.lit("-"), F.lit("+")), F.col("line_no") % 3 + 1))


SPANS = r"""lines AS (
  SELECT page_id, unnest(string_split(replace(translate(coalesce(html, ''), '<>', '()'), 'track(', 'logger.info( host,'), ' ')) AS content,
    generate_subscripts(string_split(replace(translate(coalesce(html, ''), '<>', '()'), 'track(', 'logger.info( host,'), ' '), 1) - 1 AS line_no FROM pages
), sides AS (
  SELECT l.page_id, line_no, content, [' ', '-', '+'][line_no % 3 + 1] AS origin, side FROM lines l, (VALUES ('-'), ('+')) s(side) WHERE line_no % 3 = 0 OR [' ', '-', '+'][line_no % 3 + 1] = side
), sums AS (
  SELECT *, sum(length(regexp_replace(content, '[^(]', '', 'g')) - length(regexp_replace(content, '[^)]', '', 'g'))) OVER (PARTITION BY page_id, side ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS total FROM sides
), numbered AS (
  SELECT *, coalesce(sum(CASE WHEN total = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, side ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span FROM sums
), spans AS (
  SELECT page_id AS commit, side, CAST(span AS INTEGER) AS span, CAST(count(*) AS INTEGER) AS n_lines, string_agg(origin, '' ORDER BY line_no) AS changes, string_agg(trim(content, ' '), ' ' ORDER BY line_no) AS text
  FROM numbered GROUP BY page_id, side, span HAVING arg_max(total, line_no) = 0
), calls AS (
  SELECT commit, side, span, CAST(unnest(generate_series(0, len(c) - 1)) AS INTEGER) AS call_no, unnest(c) AS callee, CASE WHEN length(replace(changes, side, '')) > 0 THEN '~' ELSE side END AS kind, has_id FROM (
    SELECT *, regexp_extract_all(code, '(?:^|[^\w.])((?:\w*[Ll][Oo][Gg]\w*\.)+(?:log|fatal|error|warning|info|debug|trace))\s*\(\s*[^\s)]', 1) AS c,
      regexp_matches(code, '([iI]d|[pP]ath|[aA]ddress|[hH]ost|[iI]p|[nN]ame|[uU]rl|[uU]ri)([^a-z]|$)') AS has_id
    FROM (SELECT *, regexp_replace(regexp_replace(text, '"(?:\\.|[^"\\])*"|''(?:\\.|[^''\\])*''', '""', 'g'), '/\*[\s\S]*?\*/|//.*', ' ', 'g') AS code FROM spans WHERE contains(changes, side)))
)"""


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph per user: all changes of event type between neighbours, from the first type."""
    order = Window.partitionBy("stream").orderBy("us", "seq")
    rows = event_rows(spark, sf_dir).select(F.col("stream").alias("method"), F.lag("item").over(order).alias("src"), F.col("item").alias("dst"), F.first("item").over(order).alias("root"), F.row_number().over(order).alias("rn"))
    return rows.where("rn > 1").select("method", "src", "dst", "root", F.col("src").isin("error", "view").alias("is_log")).distinct()


CFG = """h AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
edges AS (SELECT DISTINCT a.user_id AS method, a.event_type AS src, b.event_type AS dst FROM h a JOIN h b ON a.user_id = b.user_id AND b.rn = a.rn + 1),
heads AS (SELECT user_id AS method, event_type AS root FROM h WHERE rn = 1),
nodes AS (SELECT method, root AS node FROM heads WHERE method IN (SELECT method FROM edges) UNION SELECT method, dst FROM edges),
reach AS (
  SELECT n.method, n.node AS gone, r.root AS node FROM nodes n JOIN heads r USING (method) WHERE n.node <> r.root
  UNION SELECT x.method, x.gone, e.dst FROM reach x JOIN edges e ON e.method = x.method AND e.src = x.node WHERE e.dst <> x.gone),
dom AS (
  SELECT a.method, a.node, b.node AS d FROM nodes a JOIN nodes b USING (method) JOIN heads r USING (method) WHERE a.node <> b.node AND (b.node = r.root OR NOT EXISTS (SELECT 1 FROM reach x WHERE x.method = a.method AND x.gone = b.node AND x.node = a.node))),
deep AS (SELECT method, node, count(*) AS n FROM dom GROUP BY method, node),
ranked AS (SELECT dom.method, dom.node, dom.d, coalesce(deep.n, 0) AS n FROM dom LEFT JOIN deep ON deep.method = dom.method AND deep.node = dom.d)"""

# ---------------------------------------------------------------- queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {STMT} SELECT idom_id, event_id, file_name, line_number, level, template FROM stmt")
def project_statements(spark, sf_dir):
    return statements(spark, sf_dir)


@query(f"WITH {STMT} SELECT idom_id, event_id, file_name, line_number, level, template FROM stmt")
def scan_statements_csv(spark, sf_dir):
    path = tables.scratch(spark, "csv")
    tables.write_statements(raw_statements(spark, sf_dir), path)
    return graph.project_statements(tables.read_statements(spark, path))


@query(f"WITH {STMT} SELECT event_id, template FROM stmt WHERE event_id = 7")
def statement_lookup(spark, sf_dir):
    return graph.lookup(statements(spark, sf_dir), 7).select("event_id", "template")


@query(f"WITH {STMT} SELECT event_id, name AS variables FROM stmt")
def template_variables(spark, sf_dir):
    return statements(spark, sf_dir).select("event_id", F.array_join(t.variables(F.col("template")), ",").alias("variables"))


@query(f"WITH {STMT} SELECT event_id, name FROM stmt WHERE regexp_matches(name, '([iI]d|[pP]ath|[aA]ddress|[hH]ost|[iI]p|[nN]ame|[uU]rl|[uU]ri)([^a-z]|$)')")
def is_id_filter(spark, sf_dir):
    names = statements(spark, sf_dir).select("event_id", F.explode(t.variables(F.col("template"))).alias("name"))
    return names.where(t.is_id(F.col("name")))


@query(f"""WITH RECURSIVE {STMT}, {CHAIN} SELECT count(*) AS stmt_count, count(*) FILTER (WHERE has_id) AS stmt_w_id_count,
  (SELECT count(*) FROM chain c JOIN stmt s ON s.event_id = c.ancestor AND s.has_id) AS stmt_w_injection_count,
  (SELECT count(DISTINCT c.event_id) FROM chain c JOIN stmt s ON s.event_id = c.ancestor AND s.has_id) AS stmt_injectable_count FROM stmt""")
def stmt_stats(spark, sf_dir):
    return graph.statement_stats(statements(spark, sf_dir))


@query(f"WITH {STMT} SELECT event_id FROM stmt WHERE idom_id IS NULL")
def graph_roots(spark, sf_dir):
    return graph.roots(statements(spark, sf_dir)).select("event_id")


@query(f"WITH {STMT} SELECT event_id FROM stmt s WHERE NOT EXISTS (SELECT 1 FROM stmt c WHERE c.idom_id = s.event_id)")
def graph_leaves(spark, sf_dir):
    return graph.leaves(statements(spark, sf_dir)).select("event_id")


@query(f"WITH {STMT} SELECT s.event_id, s.idom_id, p.level AS idom_level, p.template AS idom_template FROM stmt s LEFT JOIN stmt p ON p.event_id = s.idom_id")
def idom_lookup(spark, sf_dir):
    return graph.with_idom(statements(spark, sf_dir), "level", "template").select("event_id", "idom_id", "idom_level", "idom_template")


@query(f"WITH RECURSIVE {STMT}, {CHAIN} SELECT event_id, ancestor, depth FROM chain")
def dominator_chain(spark, sf_dir):
    return graph.dominator_chain(statements(spark, sf_dir))


@query(f"""WITH RECURSIVE {STMT}, {CHAIN} SELECT s.event_id, coalesce(string_agg(CAST(c.ancestor AS VARCHAR), '>' ORDER BY c.depth DESC) || '>', '') || s.event_id AS path
  FROM stmt s LEFT JOIN chain c USING (event_id) WHERE s.event_id NOT IN (SELECT idom_id FROM stmt WHERE idom_id IS NOT NULL) GROUP BY s.event_id""")
def graph_paths(spark, sf_dir):
    return graph.paths(statements(spark, sf_dir)).select("event_id", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"""WITH RECURSIVE {STMT}, {CHAIN} SELECT s.idom_id, s.event_id, any_value(s.name) AS names, coalesce(string_agg(a.name, ',' ORDER BY c.depth), '') AS above
  FROM stmt s LEFT JOIN chain c USING (event_id) LEFT JOIN stmt a ON a.event_id = c.ancestor GROUP BY s.idom_id, s.event_id""")
def template_stat(spark, sf_dir):
    rows = statements(spark, sf_dir)
    named = graph.ancestor_variables(rows).select(F.col("event_id").alias("id"), F.array_join("names", ",").alias("names"), F.array_join("above", ",").alias("above"))
    return rows.join(named, F.col("event_id") == F.col("id")).select("idom_id", "event_id", "names", "above")


@query(f"""WITH RECURSIVE {STMT}, {CHAIN}, first AS (SELECT c.event_id, a.name, min(c.depth) AS depth FROM chain c JOIN stmt a ON a.event_id = c.ancestor JOIN stmt s ON s.event_id = c.event_id WHERE a.name <> s.name GROUP BY ALL)
  SELECT event_id, string_agg(name, ',' ORDER BY depth) AS injected FROM first GROUP BY event_id""")
def injected_variables(spark, sf_dir):
    return graph.injected_variables(statements(spark, sf_dir)).select("event_id", F.array_join("injected", ",").alias("injected"))


@query(f"WITH {PARSED} SELECT line_id, ts, file_name, line_number FROM parsed")
def parse_log_lines(spark, sf_dir):
    return logs.parse_log_lines(log_lines(spark, sf_dir)).select(F.col("event_id").alias("line_id"), "ts", "file_name", "line_number")


@query(f"""WITH {STMT}, {PARSED}, locs AS (SELECT replace(file_name, '#', '') AS file_name, line_number, max(event_id) AS event_id FROM stmt GROUP BY ALL)
  SELECT line_id, file_name, line_number, event_id FROM parsed JOIN locs USING (file_name, line_number)""")
def log_loc_join(spark, sf_dir):
    lines = logs.parse_log_lines(log_lines(spark, sf_dir).withColumnRenamed("event_id", "line_id"))
    at = statements(spark, sf_dir).withColumn("file_name", F.regexp_replace("file_name", "#", ""))
    return logs.log_loc_join(lines, at).select("line_id", "file_name", "line_number", "event_id")


@query(f"WITH {PARSED} SELECT line_id, ts, file_name, line_number FROM parsed")
def stream_parse(spark, sf_dir):
    folder = tables.scratch(spark, "lines")
    log_lines(spark, sf_dir).select(F.concat("line", F.lit(" #"), F.col("event_id").cast("string")).alias("value")).write.text(folder)
    parsed = streaming.drain(streaming.stream_parse(spark, folder))
    return parsed.select(F.regexp_extract("value", r"#(\d+)$", 1).cast("long").alias("line_id"), "ts", "file_name", "line_number")


@query("SELECT event_id % 3 AS part, count(*) AS lines FROM events GROUP BY ALL")
def scan_logs(spark, sf_dir):
    root = tables.scratch(spark, "logs")
    rows = log_lines(spark, sf_dir).withColumn("part", F.col("event_id") % 3)
    for k in range(3):
        rows.where(F.col("part") == k).select(F.concat(F.lit(f"{k} "), "line").alias("value")).write.text(f"{root}/project{k}")
    # Spark names its files part-*.txt.
    found = tables.scan_logs(spark, root, "part-*.txt")
    return found.groupBy(F.substring("line", 1, 1).cast("long").alias("part")).agg(F.count("*").alias("lines"))


@query(f"WITH {EVENT}, {SEQ} SELECT stream, seq, array_to_string(items, '>') AS items FROM seqs")
def rolling_sequences(spark, sf_dir):
    return sequence_rows(spark, sf_dir).select("stream", F.col("seq").cast("long").alias("seq"), F.array_join("items", ">").alias("items"))


@query(f"WITH {EVENT}, {SEQ} SELECT stream, seq, array_to_string(items, '>') AS items FROM seqs WHERE seq <= 10")
def rolling_sequences_limited(spark, sf_dir):
    rows = sequences.rolling_sequences(event_rows(spark, sf_dir), window_us=DAY, limit=10)
    return rows.select("stream", F.col("seq").cast("long").alias("seq"), F.array_join("items", ">").alias("items"))


_PATHS = "paths AS (SELECT a.x || '>' || b.x AS path, a.x || '.*' || b.x AS pattern FROM types a, types b UNION ALL SELECT a.x || '>' || b.x || '>' || c.x, a.x || '.*' || b.x || '.*' || c.x FROM types a, types b, types c)"


@query(f"WITH {EVENT}, {SEQ}, {TYPES}, {_PATHS} SELECT path, count(*) AS support FROM paths JOIN seqs ON regexp_matches(array_to_string(items, '>'), pattern) GROUP BY path HAVING count(*) >= 16")
def path_support(spark, sf_dir):
    types = table(spark, sf_dir, "events").select(F.col("event_type").alias("x")).distinct()
    both = F.collect_set("x")
    every = types.agg(both.alias("all"))
    two = every.select(F.explode(F.flatten(F.transform("all", lambda a: F.transform("all", lambda b: F.array(a, b))))).alias("path"))
    three = every.select(F.explode(F.flatten(F.flatten(F.transform("all", lambda a: F.transform("all", lambda b: F.transform("all", lambda c: F.array(a, b, c))))))).alias("path"))
    found = sequences.path_support(sequence_rows(spark, sf_dir), two.union(three))
    return found.select(F.array_join("path", ">").alias("path"), "support")


@query(f"""WITH RECURSIVE {EVENT}, {SEQ}, {TYPES}, kinds AS (SELECT array_to_string(items, '>') AS items, count(*) AS n FROM seqs GROUP BY 1),
  grown AS (
    SELECT x AS path, x AS pattern, sum(n) AS support, 1 AS size FROM types JOIN kinds ON regexp_matches(items, x) GROUP BY x HAVING sum(n) >= 500
    UNION ALL
    SELECT g.path || '>' || t.x AS path, g.pattern || '.*' || t.x AS pattern, sum(k.n) AS support, any_value(g.size) + 1 AS size
    FROM grown g, types t, kinds k WHERE g.size < 16 AND regexp_matches(k.items, g.pattern || '.*' || t.x) GROUP BY g.path, g.pattern, t.x HAVING sum(k.n) >= 500)
  SELECT path, CAST(support AS BIGINT) AS support FROM grown""")
def frequent_patterns(spark, sf_dir):
    found = sequences.frequent_patterns(tables.stored(sequence_rows(spark, sf_dir), "sequences"), support=500)
    return found.select(F.array_join("path", ">").alias("path"), "support")


@query("SELECT p_partkey, string_agg(upper(w[1:1]) || w[2:], '') AS name FROM (SELECT p_partkey, unnest(list_filter(list_transform(regexp_split_to_array('get ' || p_name || '_id', '[^A-Za-z]+'), lambda x: regexp_replace(x, '^get', '')), lambda x: x <> '')) AS w FROM part) GROUP BY p_partkey")
def normalise_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", t.normalise_name(F.concat(F.lit("get "), "p_name", F.lit("_id"))).alias("name"))


@query(r"SELECT doc_id, md5(replace(replace(replace('{' || text || '}', '{', '\{'), '}', '\}'), chr(10), '\n')) AS escaped FROM documents")
def escape_template(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.escape(F.concat(F.lit("{"), "text", F.lit("}"))).cast("binary")).alias("escaped"))


@query("SELECT c_custkey, '{' || CASE WHEN c_custkey % 3 = 0 THEN 'var' ELSE c_mktsegment END || '0}{' || 'Name1}' AS placeholders FROM customer")
def placeholder_names(spark, sf_dir):
    names = F.array(F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.col("c_mktsegment")), F.lit("Name"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(t.placeholder_names(names), "").alias("placeholders"))


@query("SELECT c_custkey, 'a ' || c_name || ', ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ' and {}' ELSE '' END AS filled FROM customer")
def fill_placeholders(spark, sf_dir):
    text = F.when(F.col("c_custkey") % 2 == 0, F.lit("a {}, {} and {}")).otherwise(F.lit("a {}, {}"))
    return table(spark, sf_dir, "customer").select("c_custkey", t.fill_placeholders(text, F.array("c_name", "c_mktsegment")).alias("filled"))


_KINDS = "kinds AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in TEMPLATE_ROWS) + r") v(template_id, template)), rx AS (SELECT template_id, template, '^\s*' || array_to_string(list_transform(regexp_split_to_array(template, '\{\w*\}'), lambda x: '\Q' || trim(x) || '\E'), '\s*(.*)\s*') || '\s*$' AS pattern FROM kinds)"


def templates(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}, '{x}')" for i, x in TEMPLATE_ROWS) + " AS v(template_id, template)")


@query(f"WITH {_KINDS} SELECT template_id, pattern FROM rx")
def template_regex(spark, sf_dir):
    return templates(spark).select("template_id", t.template_regex(F.col("template")).alias("pattern"))


@query(rf"""WITH {_KINDS}, m AS (SELECT event_id, event_type || ' value ' || CAST(round(value * 100) AS BIGINT) || ' by user ' || user_id AS message FROM events),
  hits AS (SELECT event_id, message, template_id, list_filter([regexp_extract(message, pattern, 1), CASE WHEN template_id <> 4 THEN regexp_extract(message, pattern, 2) END, CASE WHEN template_id = 0 THEN regexp_extract(message, pattern, 3) END], lambda x: x IS NOT NULL) AS v
    FROM m JOIN rx ON regexp_matches(message, pattern)),
  scored AS (SELECT *, (length(message) - list_sum(list_transform(v, lambda x: length(x)))) / length(message) AS score FROM hits)
  SELECT event_id, template_id, array_to_string(v, '|') AS vals, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, template_id) AS k FROM scored) WHERE k = 1""")
def template_match(spark, sf_dir):
    found = logs.template_match(messages(spark, sf_dir), templates(spark))
    return found.select("event_id", "template_id", F.array_join("values", "|").alias("vals"), F.round("score", 6).alias("score"))


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, event_type AS ty, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS v FROM events),
  p AS (SELECT * FROM (VALUES ('purchase', 'click'), ('click', 'view'), ('error', 'view')) p(child, parent)),
  l1 AS (SELECT DISTINCT e.user_id, e.rn, a.rn AS at, a.ty, a.v FROM e JOIN p ON p.child = e.ty JOIN e a ON a.user_id = e.user_id AND a.ty = p.parent AND a.rn BETWEEN e.rn - 10 AND e.rn - 1),
  l2 AS (SELECT DISTINCT l.user_id, l.rn, a.v FROM l1 l JOIN p ON p.child = l.ty JOIN e a ON a.user_id = l.user_id AND a.ty = p.parent AND a.rn BETWEEN l.at - 10 AND l.at - 1),
  u AS (SELECT user_id, rn, v FROM e UNION SELECT user_id, rn, v FROM l1 UNION SELECT user_id, rn, v FROM l2)
  SELECT user_id AS stream, rn AS seq, string_agg(v, ',' ORDER BY v) AS vals FROM u GROUP BY user_id, rn""")
def lookback_values(spark, sf_dir):
    return logs.lookback_values(typed_events(spark, sf_dir), PARENTS).select("stream", "seq", F.array_join("values", ",").alias("vals"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
  i AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[A-Z]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS k FROM l),
  r AS (SELECT doc_id, k, string_agg(line, chr(10) ORDER BY n) AS record FROM i WHERE k > 0 GROUP BY doc_id, k)
  SELECT doc_id, count(*) AS records, md5(string_agg(record, chr(0) ORDER BY k)) AS digest FROM r GROUP BY doc_id""")
def multiline_records(spark, sf_dir):
    rows = logs.multiline_records(table(spark, sf_dir, "documents"), "doc_id", "text")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("record_no", "record"))), lambda x: x["record"]), "\0")
    return rows.groupBy("doc_id").agg(F.count("*").alias("records"), F.md5(joined.cast("binary")).alias("digest"))


@query(f"WITH {SPANS} SELECT commit, side, span, n_lines, changes, md5(text) AS digest FROM spans")
def diff_spans(spark, sf_dir):
    return diff.diff_spans(hunk_lines(spark, sf_dir)).select("commit", "side", "span", "n_lines", "changes", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"WITH {SPANS} SELECT commit, side, span, call_no, callee FROM calls")
def diff_log_calls(spark, sf_dir):
    return diff.diff_log_calls(diff.diff_spans(hunk_lines(spark, sf_dir))).select("commit", "side", "span", "call_no", "callee")


@query(f"WITH {SPANS} SELECT commit, side, span, kind, has_id, count(*) AS calls FROM calls GROUP BY ALL")
def diff_span_classify(spark, sf_dir):
    rows = diff.diff_log_calls(diff.diff_spans(hunk_lines(spark, sf_dir)))
    return rows.groupBy("commit", "side", "span", "kind", "has_id").agg(F.count("*").alias("calls"))


@query(f"""WITH {SPANS} SELECT p.page_id AS commit, count(c.kind) FILTER (WHERE kind = '-') AS numold, count(c.kind) FILTER (WHERE kind = '-' AND has_id) AS numoldid, count(c.kind) FILTER (WHERE kind = '+') AS numnew,
  count(c.kind) FILTER (WHERE kind = '+' AND has_id) AS numnewid, count(c.kind) FILTER (WHERE kind = '~') AS numrev, count(c.kind) FILTER (WHERE kind = '~' AND has_id) AS numrevid FROM pages p LEFT JOIN calls c ON c.commit = p.page_id GROUP BY p.page_id""")
def diff_track(spark, sf_dir):
    commits = table(spark, sf_dir, "pages").select(F.col("page_id").alias("commit"))
    return diff.diff_track(commits, diff.diff_log_calls(diff.diff_spans(hunk_lines(spark, sf_dir))))


@query(f"WITH RECURSIVE {CFG} SELECT method, node, arg_max(d, n) AS idom FROM ranked GROUP BY method, node")
def cfg_dominators(spark, sf_dir):
    return dominators.dominators(transitions(spark, sf_dir)).select("method", "node", "idom")


@query(f"WITH RECURSIVE {CFG} SELECT method, node, arg_max(d, n) FILTER (WHERE d IN ('error', 'view')) AS log_idom FROM ranked GROUP BY method, node")
def cfg_log_idom(spark, sf_dir):
    return dominators.dominators(transitions(spark, sf_dir)).select("method", "node", "log_idom")


@query(r"""WITH c AS (SELECT page_id, unnest(regexp_extract_all(replace(html, 'track(', 'catalog.info('), '([\w.]+)\(([^()]*)', 1)) AS callee, unnest(regexp_extract_all(replace(html, 'track(', 'catalog.info('), '([\w.]+)\(([^()]*)', 2)) AS args FROM pages)
  SELECT page_id, callee, count(*) AS calls FROM c WHERE contains(lower(regexp_extract(callee, '^(.*)\.(\w+)$', 1)), 'log') AND upper(regexp_extract(callee, '^(.*)\.(\w+)$', 2)) IN ('FATAL', 'ERROR', 'WARN', 'INFO', 'DEBUG', 'TRACE', 'LOG') AND length(trim(args, ' ')) > 0 GROUP BY ALL""")
def log_call_filter(spark, sf_dir):
    html, call = F.replace("html", F.lit("track("), F.lit("catalog.info(")), F.lit(r"([\w.]+)\(([^()]*)")
    both = F.arrays_zip(F.regexp_extract_all(html, call, F.lit(1)).alias("callee"), F.regexp_extract_all(html, call, F.lit(2)).alias("args"))
    calls = table(spark, sf_dir, "pages").select("page_id", F.inline(both).alias("callee", "args"))
    return calls.where(logs.log_calls(F.col("callee"), F.col("args"))).groupBy("page_id", "callee").agg(F.count("*").alias("calls"))


@query("""WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line FROM pages) SELECT page_id, CAST(min(length(line) - length(ltrim(line, ' ' || chr(9)))) AS INTEGER) AS indent FROM l WHERE trim(line, ' ' || chr(9)) <> '' GROUP BY page_id""")
def min_indent(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.min_indent(F.col("html")).alias("indent")).where("indent is not null")


@query(f"WITH {STMT} SELECT event_id, row_number() OVER (PARTITION BY file_name ORDER BY line_number, event_id) - 1 AS place FROM stmt")
def assign_ids(spark, sf_dir):
    return graph.assign_ids(statements(spark, sf_dir), "file_name", "line_number", "event_id").select("event_id", "place")


# ---------------------------------------------------------------- sources of Java


def java_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class of two log calls for each part, the second below a condition."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    body = ["package app;\nclass C", key, ' {\n  void run(Logger logger, int userId, int count) {\n    logger.info("', F.col("p_name"), ' {}", userId);\n    if (count > 0) {\n      logger.warn("small " + count);\n    }\n  }\n}\n']
    return p.select(F.concat(F.lit("src/C"), key, F.lit(".java")).alias("path"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in body]).alias("text"))


@query("""WITH f AS (SELECT 'src/C' || p_partkey || '.java' AS path, 'app.C' || p_partkey AS class, p_name, row_number() OVER (ORDER BY 'src/C' || p_partkey || '.java') - 1 AS n FROM part)
  SELECT CAST(NULL AS INTEGER) AS idom_id, CAST(2 * n AS INTEGER) AS event_id, path, 'app' AS package, class, 'run' AS method, 4 AS line_number, 'INFO' AS level, p_name || ' {UserId0}' AS template FROM f
  UNION ALL SELECT CAST(2 * n AS INTEGER), CAST(2 * n + 1 AS INTEGER), path, 'app', class, 'run', 6, 'WARN', 'small {Count0}' FROM f""")
def java_statements(spark, sf_dir):
    return java.extract_statements(java_sources(spark, sf_dir))


@query(r"""SELECT 'src/C' || p_partkey || '.java' AS path, 1 AS no,
  md5('void run(Logger logger, int userId, int count) {' || chr(10) || '  // #LOG ASSOCIATE' || chr(10) || '  logger.info("' || p_name || ' {}", userId);' || chr(10) || '  if (count > 0) {' || chr(10)
    || '    /* #LOG WARN small {Count0}' || chr(10) || '     * UserId0: userId' || chr(10) || '     */' || chr(10) || '    logger.warn("small " + count);' || chr(10) || '  }' || chr(10) || '}') AS digest FROM part""")
def java_injections(spark, sf_dir):
    return java.injection_reports(java_sources(spark, sf_dir)).select("path", "no", F.md5(F.col("source").cast("binary")).alias("digest"))


# ---------------------------------------------------------------- streams, and the template parser


@query(SQL["rolling_sequences"])
def stream_rolling(spark, sf_dir):
    folder = tables.scratch(spark, "events")
    event_rows(spark, sf_dir).write.parquet(folder)
    events = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    found = streaming.drain(streams.stream_rolling_sequences(events, window_us=DAY))
    return found.select("stream", "seq", F.array_join("items", ">").alias("items"))


@query(SQL["lookback_values"])
def stream_lookback(spark, sf_dir):
    folder = tables.scratch(spark, "events")
    typed_events(spark, sf_dir).write.parquet(folder)
    events = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    found = streaming.drain(streams.stream_lookback_values(events, PARENTS))
    return found.select("stream", "seq", F.array_join("values", ",").alias("vals"))


@query(rf"""WITH {_KINDS}, m AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no, event_type || ' value ' || CAST(round(value * 100) AS BIGINT) || ' by user ' || user_id AS message FROM events),
  hits AS (SELECT user_id, line_no, message, template_id, list_filter([regexp_extract(message, pattern, 1), CASE WHEN template_id <> 4 THEN regexp_extract(message, pattern, 2) END, CASE WHEN template_id = 0 THEN regexp_extract(message, pattern, 3) END], lambda x: x IS NOT NULL) AS v
    FROM m JOIN rx ON regexp_matches(message, pattern)),
  scored AS (SELECT *, (length(message) - list_sum(list_transform(v, lambda x: length(x)))) / length(message) AS score FROM hits)
  SELECT user_id AS file, line_no, '{{"' || template_id || '":' || CAST(to_json(list_sort(list_distinct(v))) AS VARCHAR) || '}}' AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, line_no ORDER BY score DESC, template_id) AS k FROM scored) WHERE k = 1""")
def template_parse(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").join(messages(spark, sf_dir), "event_id")
    lines = e.select(F.col("user_id").alias("file"), F.row_number().over(order).cast("long").alias("line_no"), F.col("message").alias("line"))
    return template_parser.as_json(template_parser.parse_logs(lines, templates(spark).withColumn("idom_id", F.lit(None).cast("int"))))


@query("""SELECT page_id, count(*) AS words FROM (SELECT page_id, html, unnest(string_split(html, ' ')) AS w FROM pages) WHERE contains(html, '<table') AND NOT contains(html, '<script') GROUP BY page_id""")
def diff_java_lines(spark, sf_dir):
    path = F.when(F.contains("html", F.lit("<table")), "a/B.java").otherwise("a/b.xml")
    words = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.contains("html", F.lit("<script")).alias("is_binary"), F.explode(F.split("html", " ")).alias("content"))
    return diff.java_lines(words).groupBy("page_id").agg(F.count("*").alias("words"))


# ---------------------------------------------------------------- edits of source text


@query("SELECT p_partkey, '<' || substr(p_name, 1, 2) || '-' || substr(p_name, 5, 2) || '>' || substr(p_name, 7) AS edited FROM part")
def apply_edits(spark, sf_dir):
    new = F.expr("array(struct(6 AS begin, 6 AS end, '>' AS new), struct(2 AS begin, 4 AS end, '-' AS new), struct(0 AS begin, 0 AS end, '<' AS new))")
    return table(spark, sf_dir, "part").select("p_partkey", edits.apply_edits(F.col("p_name"), new).alias("edited"))


@query("SELECT page_id, length(rtrim(substr(html, 1, strpos(html, '<p') - 1), ' ' || chr(9))) AS start FROM pages WHERE strpos(html, '<p') > 0")
def block_start(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("at", F.instr("html", "<p") - 1).where("at >= 0")
    return pages.select("page_id", edits.block_start(F.col("html"), F.col("at")).cast("long").alias("start"))


@query("""WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) AS n FROM pages),
  m AS (SELECT page_id, min(length(line) - length(ltrim(line, ' ' || chr(9)))) AS least FROM l WHERE trim(line, ' ' || chr(9)) <> '' GROUP BY page_id)
  SELECT page_id, md5(string_agg(substr(line, coalesce(least, 0) + 1), chr(10) ORDER BY n)) AS digest FROM l LEFT JOIN m USING (page_id) GROUP BY page_id""")
def deindent(spark, sf_dir):
    return table(spark, sf_dir, "pages").where("html is not null").select("page_id", F.md5(edits.deindent(F.col("html")).cast("binary")).alias("digest"))
