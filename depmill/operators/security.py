"""Findings of the line rules and of the graph, and severity by reachability.

Lines are matched first, all rules in one pass. What lies around is looked at for hits alone: those of rules with frames
are joined to the lines of their file by line number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import CodeGraph
from ..plans.scratch import written
from . import rules as R
from .rollup import file_stats
from .rules import RULES, Frame, Rule
from .traverse import cycles, reachable_entries, without_auth

#: Lines of a file whose findings are numbered together.
BLOCK = 10_000
RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
__all__ = ["RULES", "Rule", "findings"]


def rule_name(r: Rule) -> str:
    return f"{r.check}/{r.title}".replace(" ", "-")


def _any(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def scanned(path: Column, line: Column, check: str) -> Column:
    """Whether the check reads the line at all."""
    ok = ~_any(path.contains(x) for x in R.SKIPPED_DIRS) & ~_any(F.ltrim(line).startswith(x) for x in R.COMMENTS.get(check, R.OTHER_COMMENTS))
    if check == "injection":
        ok = ok & ~_any(F.lower(path).contains(x) for x in R.TEST_WORDS) & ~line.contains(R.REVIEWED)
    if check == "path-traversal":
        ok = ok & ~path.contains("wasm-init") & ~(line.contains("__dirname") & line.rlike(R.SAFE_ARGUMENTS)) & ~(line.contains("writeFileSync") & line.rlike(R.FIXED_OUTPUT))
    return ok


def severity_of(r: Rule, path: Column, line: Column) -> Column:
    """The rule's severity; medium is raised by input names in the line or by the file's role."""
    raised = {"input": line.rlike(R.INJECTION_INPUT), "route": path.rlike(R.ROUTE_FILES), "crypto": path.rlike(R.CRYPTO_FILES)}
    return F.when(raised[r.worse], "high").otherwise(r.severity) if r.worse and r.severity == "medium" else F.lit(r.severity)


def findings(lines: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(rule, check, class, severity, title, file_path, line, text): one row for each rule that a line matches."""
    line, path = F.col("line"), F.col("file_path")

    def hit(number: int, r: Rule) -> Column:
        tests = [line.rlike(r.pattern), *(line.rlike(p) for p in r.also), *(~line.rlike(p) for p in r.never)] + ([path.rlike(r.files)] if r.files else [])
        ok = reduce(lambda a, b: a & b, tests) & F.col(f"scan_{r.check}")
        return F.when(ok, F.struct(F.lit(number).alias("number"), F.lit(rule_name(r)).alias("rule"), F.lit(r.check).alias("check"), F.lit(r.kind).alias("class"), severity_of(r, path, line).alias("severity"), F.lit(r.title).alias("title")))

    told = ["rule", "check", "class", "severity", "title", "file_path", "line", "text"]
    framed = {i for i, r in enumerate(rules) if r.frames}

    def matched(numbers: list[int]) -> DataFrame:
        read = lines.withColumns({f"scan_{check}": scanned(path, line, check) for check in sorted({rules[i].check for i in numbers})})
        return read.select("file_path", F.col("line_no").alias("line"), F.trim(line).alias("text"), F.explode(F.array_compact(F.array(*(hit(i, rules[i]) for i in numbers)))).alias("h")).select("h.*", "file_path", "line", "text")

    # the rules with frames and those without have a pass each, so that none is tried twice
    passes = [matched([i for i in range(len(rules)) if i not in framed])] if len(framed) < len(rules) else []
    if framed:
        passes.append(_framed(matched(sorted(framed)), lines, rules))
    return reduce(DataFrame.unionByName, (df.select(*told) for df in passes))


def _framed(hits: DataFrame, lines: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Hits whose surroundings do not speak against them."""
    frames: dict[Frame, list[int]] = {}
    for i, r in enumerate(rules):
        for f in r.frames:
            frames.setdefault(f, []).append(i)
    before, after = max(f.before for f in frames), max(f.after for f in frames)
    # lines are gathered by file and block, each also in the blocks whose hits it is near, so a hit meets the one row of
    # its block, of some frames' length whatever the length of its file
    size = before + after + 1
    block = lambda c: F.floor(c / size)
    near = lines.where("line_no is not null").select("file_path", F.col("line_no").alias("near"), F.col("line").alias("near_text"), F.explode(F.sequence(block(F.col("line_no") - after), block(F.col("line_no") + before))).alias("block"))
    blocks = near.groupBy("file_path", "block").agg(F.array_sort(F.collect_list(F.struct("near", "near_text"))).alias("around"))
    inside = F.filter("around", lambda x: x["near"].between(F.col("line") - before, F.col("line") + after))
    around = hits.withColumn("block", block(F.col("line"))).join(blocks, ["file_path", "block"]).withColumn("around", inside)

    def text(f: Frame) -> Column:
        inside = F.filter("around", lambda x: x["near"].between(F.col("line") - f.before, F.col("line") + f.after))
        return F.array_join(F.transform(inside, lambda x: x["near_text"]), "\n")

    ok = F.lit(True)
    for f, own in frames.items():
        present = reduce(lambda a, b: a & b, (text(f).rlike(p) for p in f.patterns))
        ok = ok & (~F.col("number").isin(own) | (present if f.needed else ~present))
    return around.where(ok)


def architecture_findings(g: CodeGraph) -> DataFrame:
    """God files that mix authentication and data, cycles through security files, data access from routes, dead security exports."""
    sec, data, route = F.col("file_path").rlike("(?i)auth|security|crypt|permission"), "(?i)(^|/)(db|database|models?|repositor)", "(?i)route|controller|handler"
    told = lambda rule, kind, severity, title: [F.lit(f"architecture/{rule}").alias("rule"), F.lit("architecture").alias("check"), F.lit(kind).alias("class"), F.lit(severity).alias("severity"), F.lit(title).alias("title"), "file_path", F.lit(1).alias("line"), F.lit("").alias("text")]
    mean = g.edge_degree.agg(F.avg("connections").alias("mean"))
    uses = g.fp.groupBy(F.col("source_file").alias("file_path")).agg(F.max(F.col("target_file").rlike("(?i)auth|session")).alias("auth"), F.max(F.col("target_file").rlike(data)).alias("data"))
    god = file_stats(g).join(uses.where("auth and data"), "file_path").crossJoin(F.broadcast(mean)).where("connections > 3 * mean").select(*told("god-file", "architecture", "medium", "a hub mixes authentication and data"))
    loops = cycles(g.fp).select(F.explode("members").alias("file_path")).distinct().where(sec).select(*told("cycle", "architecture", "high", "a cycle runs through security code"))
    layer = g.fp.where(F.col("source_file").rlike(route) & F.col("target_file").rlike(data)).select(F.col("source_file").alias("file_path")).distinct().select(*told("layer", "architecture", "medium", "a route reaches data directly"))
    dead = g.with_dependents().where(sec & F.col("exported") & (F.col("dependents") == 0)).select("file_path").distinct().select(*told("dead", "architecture", "info", "security code that nothing uses"))
    fan = g.in_degree.join(g.nodes.select("id", "file_path"), "id").groupBy("file_path").agg(F.sum("dependents").alias("n")).join(without_auth(g, g.files.where(F.col("file_path").rlike(route))), "file_path", "left_semi")
    band = F.when(F.col("n") > 10, "high").when(F.col("n") > 5, "medium").otherwise("low")
    fan = fan.withColumn("s", band).select(*[c if not isinstance(c, str) else F.col(c) for c in told("open-route", "architecture", "low", "a route without authentication is widely used")], "s").withColumn("severity", F.col("s")).drop("s")
    return god.unionByName(loops).unionByName(layer).unionByName(dead).unionByName(fan)


def elevated(found: DataFrame, g: CodeGraph) -> DataFrame:
    """Severity raised by the entry points that reach a finding's file; one closure for all files at once."""
    files = found.select("file_path").distinct()
    entries = reachable_entries(g, files)
    open_routes = without_auth(g, entries.where("entry_class = 'http'").select(F.col("entry_file").alias("file_path"))).withColumn("open", F.lit(True)).withColumnRenamed("file_path", "entry_file")
    told = entries.join(open_routes, "entry_file", "left").groupBy("file_path").agg(F.countDistinct("entry_file").alias("reachable_from"), F.max(F.col("entry_class") == "http").alias("http"), F.max(F.col("entry_class") == "mcp").alias("mcp"), F.max(F.coalesce("open", F.lit(False)) & (F.col("entry_class") == "http")).alias("open"), F.array_sort(F.collect_set("entry_file")).alias("entry_points"))
    s = F.col("severity")
    up = F.when((s == "high") & F.col("open"), "critical").when((s == "medium") & (F.col("http") | F.col("mcp")), "high").when((s == "low") & (F.col("reachable_from") > 0), "medium").otherwise(s)
    return found.join(told, "file_path", "left").withColumns({"elevated_from": F.when(up != s, s), "severity": up, "reachable_from": F.coalesce("reachable_from", F.lit(0)), "entry_points": F.coalesce("entry_points", F.array().cast("array<string>"))}).drop("http", "mcp", "open")


def severity_rank(c: Column) -> Column:
    out = F.lit(0)
    for k, v in RANK.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def numbered(found: DataFrame) -> DataFrame:
    """Worst first, with ids: places within a severity are counted apart, so that no task numbers all findings."""
    order = ["file_path", "line", "rule"]
    block = F.coalesce(F.floor(F.col("line") / BLOCK), F.lit(-(1 << 62))).cast("long")
    # written, as the findings are read for the counts and for the rows
    ranked = written(found.withColumn("rank", severity_rank(F.col("severity"))).withColumn("block", block), "found")
    part = ["rank", "file_path", "block"]
    sizes = ranked.groupBy(*part).agg(F.count(F.lit(1)).alias("n"))
    # blocks of lines are numbered by their counts, one row a block; findings only within their block
    first = sizes.withColumn("before", F.sum("n").over(Window.orderBy(F.desc("rank"), "file_path", "block").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy(*part).orderBy(*order)) + F.coalesce("before", F.lit(0))
    return ranked.join(first.select(*part, "before"), part).withColumn("id", F.format_string("SEC-%03d", place)).orderBy(F.desc("rank"), *order).select(*found.columns, "id")


def summary(found: DataFrame) -> DataFrame:
    return found.agg(*[F.count_if(F.col("severity") == k).alias(k) for k in RANK], F.count(F.lit(1)).alias("total"))


def gate(found: DataFrame, threshold: str) -> bool:
    """Whether any finding is at least as severe as the threshold."""
    return bool(found.where(severity_rank(F.col("severity")) >= RANK[threshold]).take(1))
