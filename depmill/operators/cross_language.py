"""Edges between languages: HTTP calls to routes and subprocess calls to scripts, from lines of source.

Lines are (file_path, line_no, line). Each rule is one pattern over a line; all rules of a side run in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import basename, language

VERBS = "get|post|put|delete|patch"
SCRIPT = r"[\w./-]+\.(?:py|js|ts|go|rs)"


@dataclass(frozen=True)
class Rule:
    """A pattern with the groups of path and method (0: none, then ``method`` holds)."""

    languages: tuple[str, ...]
    name: str
    pattern: str
    path: int
    verb: int = 0
    method: str = "GET"
    unless: str = ""


JS = ("typescript", "javascript")
CALLS = (
    Rule(JS, "fetch", r"fetch\s*\(\s*(['\"`])(/[^'\"`]*|[^'\"`]+)\1", 2),
    Rule(JS, "axios", rf"(?i)axios\s*\.\s*({VERBS})\s*\(\s*(['\"`])([^'\"`]+)\2", 3, 1),
    Rule(JS, "client", rf"(?i)\w+\s*\.\s*({VERBS})\s*\(\s*(['\"`])([^'\"`]+)\2", 3, 1, unless=r"axios|app\s*\.|router\s*\.|\br\s*\."),
    Rule(("kotlin",), "retrofit", r"@(GET|POST|PUT|DELETE|PATCH)\(\s*\"([^\"]+)\"", 2, 1),
    Rule(("php",), "guzzle", rf"(?i)->({VERBS})\(\s*['\"]([^'\"]+)['\"]", 2, 1, unless=r"Route::|\$app|\$router"),
    Rule(("php",), "guzzle request", r"->request\(\s*['\"](\w+)['\"]\s*,\s*['\"]([^'\"]+)['\"]", 2, 1),
    Rule(("php",), "file_get_contents", r"file_get_contents\(\s*['\"](https?://[^'\"]+)['\"]", 1),
)
ROUTES = (
    Rule(JS, "express", rf"(?i)\b(?:app|router)\s*\.\s*({VERBS})\s*\(\s*['\"`]([^'\"`]+)['\"`]", 2, 1),
    Rule(("python",), "decorator", rf"(?i)@\w+\.({VERBS})\s*\(\s*['\"]([^'\"]+)['\"]", 2, 1),
    Rule(("python",), "route", r"@\w+\.route\s*\(\s*['\"]([^'\"]+)['\"](?:.*methods\s*=\s*\[([^\]]*)\])?", 1, 2),
    Rule(("go",), "gin", r"\b(?:r|router|group|e|g)\s*\.\s*(GET|POST|PUT|DELETE|PATCH)\s*\(\s*\"([^\"]+)\"", 2, 1),
    Rule(("csharp",), "attribute", r"\[Http(Get|Post|Put|Delete|Patch)\s*\(\s*\"([^\"]+)\"", 2, 1),
    Rule(("csharp",), "route attribute", r"\[Route\s*\(\s*\"([^\"]+)\"", 1, method="ANY"),
    Rule(("csharp",), "minimal", r"\.Map(Get|Post|Put|Delete|Patch)\s*\(\s*\"([^\"]+)\"", 2, 1),
    Rule(("java", "kotlin"), "spring", r"@(Get|Post|Put|Delete|Patch)Mapping\s*(?:\(\s*(?:value\s*=\s*|path\s*=\s*)?\[?\s*\"([^\"]*)\")?", 2, 1),
    Rule(("java", "kotlin"), "spring request", r"@RequestMapping\s*\(\s*(?:value\s*=\s*|path\s*=\s*)?\[?\s*\"([^\"]+)\"(?:.*RequestMethod\.(\w+))?", 1, 2, "ANY"),
    Rule(("java",), "jax-rs", r"@Path\s*\(\s*\"([^\"]+)\"", 1, method="ANY"),
    Rule(("java",), "webflux", r"\b(GET|POST|PUT|DELETE|PATCH)\s*\(\s*\"([^\"]+)\"", 2, 1, unless="@"),
    Rule(("kotlin",), "ktor", rf"\b({VERBS})\s*\(\s*\"(/[^\"]*)\"\s*\)\s*\{{", 2, 1),
    Rule(("kotlin",), "ktor block", r"\broute\s*\(\s*\"(/[^\"]*)\"", 1, method="ANY"),
    Rule(("kotlin",), "http4k", r"\"(/[^\"]*)\"\s+bind\s+(?:Method\.)?(GET|POST|PUT|DELETE|PATCH)", 1, 2),
    Rule(("php",), "laravel", rf"(?i)Route::({VERBS})\(\s*['\"]([^'\"]+)['\"]", 2, 1),
    Rule(("php",), "symfony", r"#\[Route\(\s*['\"]([^'\"]+)['\"](?:.*methods:\s*\[([^\]]*)\])?", 1, 2, "ANY"),
    Rule(("php",), "slim", rf"(?i)\$(?:app|group|router)->({VERBS})\(\s*['\"]([^'\"]+)['\"]", 2, 1),
    Rule(("php",), "wordpress", r"register_rest_route\(\s*['\"]([^'\"]+)['\"]\s*,\s*['\"]([^'\"]+)['\"]", 2, method="ANY"),
    Rule(("cpp",), "crow", r"CROW_ROUTE\s*\(\s*\w+\s*,\s*\"([^\"]+)\"", 1, method="ANY"),
    Rule(("cpp",), "drogon", r"(?:ADD_METHOD_TO|METHOD_ADD)\s*\([^,]+,\s*\"([^\"]+)\"\s*,\s*(?:drogon::)?(Get|Post|Put|Delete|Patch)", 1, 2),
    Rule(("cpp",), "pistache", r"Routes::(Get|Post|Put|Delete|Patch)\s*\([^,]+,\s*\"([^\"]+)\"", 2, 1),
    Rule(("cpp",), "httplib", r"\.(Get|Post|Put|Delete|Patch)\s*\(\s*(?:R)?\"([^\"]+)\"", 2, 1),
)
SCRIPTS = (
    (JS, rf"\b(?:exec|execSync)\s*\(\s*['\"`]([^'\"`]*{SCRIPT}[^'\"`]*)['\"`]"), (JS, rf"\b(?:spawn|spawnSync|execFile)\s*\(\s*['\"][^'\"]+['\"]\s*,\s*\[\s*['\"]({SCRIPT})['\"]"),
    (("python",), rf"subprocess\.\w+\(\s*\[[^\]]*['\"]({SCRIPT})['\"]"), (("python",), rf"os\.system\(\s*f?['\"]([^'\"]*{SCRIPT}[^'\"]*)['\"]"), (("python",), rf"subprocess\.\w+\(\s*f?['\"]([^'\"]*{SCRIPT}[^'\"]*)['\"]"),
    (("go",), rf"exec\.Command\(\s*\"[^\"]+\"\s*,\s*\"({SCRIPT})\""),
)


def _hits(lines: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """One row for each rule that a line matches: file_path, line_no, language, rule, method, path."""
    lang = language(F.col("file_path"))
    found = []
    for r in rules:
        ok = lang.isin(*r.languages) & F.col("line").rlike(r.pattern) & (~F.col("line").rlike(r.unless) if r.unless else F.lit(True))
        verb = F.upper(F.regexp_extract("line", r.pattern, r.verb)) if r.verb else F.lit("")
        verb = F.when(verb == "", r.method).otherwise(verb)
        found.append(F.when(ok, F.struct(F.lit(r.name).alias("rule"), verb.alias("method"), F.regexp_extract("line", r.pattern, r.path).alias("path"))))
    return lines.select("file_path", "line_no", lang.alias("language"), F.explode(F.array_compact(F.array(*found))).alias("h")).select("file_path", "line_no", "language", "h.*")


def plain_path(path: Column) -> Column:
    """Without host, template expressions, query and trailing slash."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^https?://[^/]+", ""), r"^\$\{[^}]*\}(?=/)", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\$\{[^}]*\}", ":p"), r"\?.*$", "")
    return F.when(F.length(bare) > 1, F.regexp_replace(bare, "/$", "")).otherwise(bare)


def parameters(path: Column) -> Column:
    """Parameters as one mark."""
    return F.regexp_replace(F.regexp_replace(path, r":[a-zA-Z_]\w*", "*"), r"\{[a-zA-Z_]\w*\}|<[^>]*>", "*")


def http_calls(lines: DataFrame) -> DataFrame:
    return _hits(lines, CALLS).withColumn("path", plain_path(F.col("path"))).where(F.col("path").startswith("/")).dropDuplicates(["file_path", "line_no", "method", "path"])


def routes(lines: DataFrame) -> DataFrame:
    """Route definitions; several methods make several rows, a class's prefix precedes its paths."""
    hits = _hits(lines, ROUTES)
    prefix = hits.where("rule in ('spring request', 'route attribute', 'jax-rs')").groupBy("file_path").agg(F.min_by("path", "line_no").alias("prefix"), F.min("line_no").alias("first"))
    hits = hits.join(prefix, "file_path", "left")
    inner = F.col("rule").isin("spring", "attribute", "jax-rs") & (F.col("line_no") > F.col("first"))
    path = F.when(inner, F.concat(F.regexp_replace(F.col("prefix"), "/$", ""), F.when(F.col("path").startswith("/") | (F.col("path") == ""), F.col("path")).otherwise(F.concat(F.lit("/"), F.col("path"))))).otherwise(F.col("path"))
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    verbs = F.array_distinct(F.regexp_extract_all(F.col("method"), F.lit(r"([A-Z]+)"), 1))
    return hits.select("file_path", "line_no", "language", "rule", F.explode(F.when(F.size(verbs) > 0, verbs).otherwise(F.array(F.lit("ANY")))).alias("method"), plain_path(path).alias("path"))


#: Parts into which the calls of one path are dealt.
SHARES = 32


def rest_edges(lines: DataFrame) -> DataFrame:
    """Calls matched to routes: the call's segments begin the route's, where a parameter stands for any.

    Distinct (method, path) pairs are matched, by an equi-join on the first segment, parameters being routes of any first
    segment, and a test of the rest; what fits is joined to the places. Every place of a call meets every one of a route
    that it fits, so the rows are as many as these pairs: calls are dealt over SHARES of a pair, each to all its routes, and
    the rows are made where they are used, without being sorted or shuffled.
    """
    seg = lambda c: F.split(F.regexp_replace(parameters(F.col(c)), "^/", ""), "/")
    c = http_calls(lines).select(F.col("file_path").alias("source_file"), F.col("line_no").alias("line"), F.col("language").alias("source_language"), F.col("method").alias("call_method"), F.col("path").alias("call_path"))
    r = routes(lines).select(F.col("file_path").alias("target_file"), F.col("line_no").alias("target_line"), F.col("language").alias("target_language"), F.col("method").alias("route_method"), F.col("path").alias("route_path")).distinct()
    cs = c.select("call_method", "call_path").distinct().withColumn("cs", seg("call_path")).withColumn("key", F.explode(F.array_distinct(F.array(F.col("cs")[0], F.lit("*")))))
    rs = r.select("route_method", "route_path").distinct().withColumn("rs", seg("route_path")).withColumn("key", F.col("rs")[0])
    fits = F.forall(F.zip_with("cs", "rs", lambda a, b: a.isNull() | F.coalesce((b == "*") | (a == b) | (a == "*"), F.lit(False))), lambda x: x)
    exact = parameters(F.col("call_path")) == parameters(F.col("route_path"))
    method = (F.col("call_method") == F.col("route_method")) | (F.col("route_method") == "ANY")
    sure = F.when(exact & method, "high").when(exact | method, "medium").otherwise("low")
    fitting = cs.join(rs, "key").where(fits).select("call_method", "call_path", "route_method", "route_path", sure.alias("confidence"))
    share = F.pmod(F.xxhash64("source_file", "line"), F.lit(SHARES)).cast("int")
    # by a number of tasks that is told, as the rows made are many and what they are made from is little
    keys, tasks = ["route_method", "route_path", "share"], 4 * lines.sparkSession.sparkContext.defaultParallelism
    calls = c.join(fitting, ["call_method", "call_path"]).withColumn("share", share).repartition(tasks, *keys)
    dealt = r.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).repartition(tasks, *keys)
    met = calls.join(dealt, keys).where("source_file <> target_file")
    return met.select("source_file", "line", "source_language", "call_method", "call_path", "target_file", "target_line", "target_language", "route_method", "route_path", "confidence")


def script_edges(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Subprocess calls to known files: the exact path, else the base name, paths that end alike first."""
    lang = language(F.col("file_path"))
    hits = [F.when(lang.isin(*ls) & F.col("line").rlike(p), F.regexp_extract(F.regexp_extract("line", p, 1), f"({SCRIPT})", 1)) for ls, p in SCRIPTS]
    calls = lines.select(F.col("file_path").alias("source_file"), F.col("line_no").alias("line"), F.explode(F.array_distinct(F.array_compact(F.array(*hits)))).alias("script")).withColumn("base", basename(F.col("script")))
    known = files.select("file_path").distinct().withColumn("base", basename(F.col("file_path")))
    rank = F.when(F.col("file_path") == F.col("script"), 0).when(F.col("file_path").endswith(F.regexp_replace("script", r"^(\./|\.\./)+", "")), 1).otherwise(2)
    best = F.row_number().over(Window.partitionBy("source_file", "line", "script").orderBy("rank", "file_path"))
    found = calls.join(known, "base").withColumn("rank", rank).withColumn("best", best).where("best = 1 and source_file <> file_path")
    return found.select("source_file", "line", F.col("file_path").alias("target_file"), "script", F.when(F.col("rank") < 2, "high").otherwise("medium").alias("confidence"))


def as_edges(rest: DataFrame, scripts: DataFrame, first_seq: int) -> DataFrame:
    """Both kinds as graph edges between file pseudo-nodes."""
    end = lambda c: F.concat(F.col(c), F.lit("::__file__"))
    a = rest.select(end("source_file").alias("source"), end("target_file").alias("target"), F.lit("rest-api").alias("kind"), F.col("source_file").alias("file_path"), F.col("line").cast("int").alias("line"), F.lit(True).alias("cross_language"), "confidence", F.col("call_method").alias("http_method"), F.col("call_path").alias("path"))
    b = scripts.select(end("source_file").alias("source"), end("target_file").alias("target"), F.lit("subprocess").alias("kind"), F.col("source_file").alias("file_path"), F.col("line").cast("int").alias("line"), F.lit(True).alias("cross_language"), "confidence", F.col("script").alias("called_file"))
    return a.unionByName(b, allowMissingColumns=True).withColumn("seq", F.lit(first_seq).cast("long") + F.pmod(F.xxhash64("source", "target", "line"), F.lit(1 << 40)))
