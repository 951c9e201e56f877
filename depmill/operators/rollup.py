"""File, directory and symbol roll-ups. Every one is a filter, join or aggregation; ties fall by path or id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..plans.graph import PSEUDO, CodeGraph, ranked

one = lambda name: F.count(F.lit(1)).alias(name)


def _zero(*names: str) -> list[Column]:
    return [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names]


def file_summary(g: CodeGraph) -> DataFrame:
    """Symbols and distinct neighbour files of each file."""
    near = g.neighbours.select("file_path", F.col("files_in").alias("incoming"), F.col("files_out").alias("outgoing"))
    return g.files.join(near, "file_path", "left").select("file_path", "symbols", *_zero("incoming", "outgoing"))


def list_files(g: CodeGraph, prefix: str = "") -> DataFrame:
    return file_summary(g).where(F.col("file_path").startswith(prefix))


def architecture_counts(g: CodeGraph) -> DataFrame:
    s = file_summary(g).agg(one("files"), F.coalesce(F.sum("symbols"), F.lit(0)).cast("long").alias("symbols"), F.count_if((F.col("incoming") == 0) & (F.col("outgoing") == 0)).alias("orphans"))
    total = lambda n, name: F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(name)
    e = g.pairs.agg(total(F.col("edges"), "edges"), total(F.when(F.col("source_file") != F.col("target_file"), F.col("edges")), "cross_file_edges"))
    return s.crossJoin(e)  # one row each


def most_connected(g: CodeGraph, k: int = 5) -> DataFrame:
    total = F.col("incoming") + F.col("outgoing")
    return file_summary(g).withColumn("connections", total).orderBy(F.desc("connections"), "file_path").limit(k)


def top_directories(g: CodeGraph, k: int = 10) -> DataFrame:
    return g.nodes.groupBy(X.dirname(F.col("file_path")).alias("dir")).agg(one("symbols")).orderBy(F.desc("symbols"), "dir").limit(k)


def file_stats(g: CodeGraph) -> DataFrame:
    per = g.nodes.groupBy("file_path").agg(one("symbols"), F.count_if("exported").alias("exports"), F.max("end_line").alias("max_line"))
    joined = per.join(g.edge_degree, "file_path", "left")
    return joined.select("file_path", X.language(F.col("file_path")).alias("language"), "symbols", "exports", "max_line", *_zero("incoming", "outgoing", "connections"))


def top_dir_breakdown(g: CodeGraph) -> DataFrame:
    s = file_stats(g).withColumn("top_dir", X.first_dir(F.col("file_path")))
    return s.groupBy("top_dir").agg(one("files"), F.sum("symbols").alias("symbols"), F.min_by("file_path", F.struct(-F.col("connections"), "file_path")).alias("most_connected"))


def largest_files(g: CodeGraph, k: int = 10, smallest: bool = False) -> DataFrame:
    return g.files.select("file_path", "symbols").orderBy(F.asc("symbols") if smallest else F.desc("symbols"), "file_path").limit(k)


def mean_file_size(g: CodeGraph) -> DataFrame:
    return g.files.agg(one("files"), F.round(F.avg("symbols")).cast("long").alias("mean_symbols"))


def orphan_files(g: CodeGraph) -> DataFrame:
    return g.files.select("file_path").join(g.edge_degree, "file_path", "left_anti")


def hub_files_by_degree(g: CodeGraph, k: int = 10) -> DataFrame:
    return g.edge_degree.orderBy(F.desc("connections"), "file_path").limit(k)


def directory_stats(g: CodeGraph) -> DataFrame:
    n = g.nodes.withColumn("dir", X.dirname(F.col("file_path")))
    base = n.where("dir <> '.'").groupBy("dir").agg(one("symbols"), F.countDistinct("file_path").alias("files"), F.count_if(F.col("kind").isin("interface", "type_alias")).alias("types"), F.count_if(F.col("kind").isin("function", "method")).alias("functions"))
    pairs = g.fp.groupBy(X.dirname(F.col("source_file")).alias("s"), X.dirname(F.col("target_file")).alias("t")).agg(F.sum("edges").alias("n")).where("s <> t")
    out, into = pairs.groupBy(F.col("s").alias("dir")).agg(F.sum("n").alias("outgoing")), pairs.groupBy(F.col("t").alias("dir")).agg(F.sum("n").alias("incoming"))
    joined = base.join(out, "dir", "left").join(into, "dir", "left").select("dir", "symbols", "files", "types", "functions", *_zero("outgoing", "incoming"))
    total = F.greatest(F.col("outgoing") + F.col("incoming"), F.lit(1))
    role = F.when(F.col("types") / F.col("symbols") > 0.7, "types").when(F.col("outgoing") / total > 0.7, "orchestration").when(F.col("incoming") / total > 0.7, "foundation").otherwise("core")
    return joined.withColumn("role", role)


def entry_points(g: CodeGraph, k: int = 5) -> DataFrame:
    """Files by references out over references in, infinite without any in."""
    ratio = F.when(F.col("incoming") == 0, F.lit(float("inf"))).otherwise(F.col("outgoing") / (F.col("incoming") + 1))
    return file_summary(g).where("outgoing > 0").withColumn("ratio", ratio).orderBy(F.desc("ratio"), F.desc("outgoing"), "file_path").limit(k)


def hub_files(g: CodeGraph, k: int = 10) -> DataFrame:
    return g.fp.groupBy(F.col("target_file").alias("file_path")).agg(one("dependents")).orderBy(F.desc("dependents"), "file_path").limit(k)


def layers(g: CodeGraph) -> DataFrame:
    s = file_summary(g)
    layer = F.when(F.col("incoming") > 2 * F.col("outgoing"), "foundation").when(F.col("outgoing") > 2 * F.col("incoming"), "orchestration").otherwise("core")
    return s.select("file_path", layer.alias("layer"))


def language_histogram(g: CodeGraph) -> DataFrame:
    n = g.files.groupBy(X.language(F.col("file_path")).alias("language")).agg(one("files"))
    return n.withColumn("percent", F.round(100.0 * F.col("files") / F.sum("files").over(Window.partitionBy()), 4))


def module_matrix(g: CodeGraph, k: int = 15) -> DataFrame:
    """References between module directories, of the k with most outgoing."""
    m = g.fp.withColumnRenamed("edges", "n").select(X.module_dir(F.col("source_file")).alias("source_dir"), X.module_dir(F.col("target_file")).alias("target_dir"), "n").where("source_dir is not null and target_dir is not null and source_dir <> target_dir")
    m = m.groupBy("source_dir", "target_dir").agg(F.sum("n").alias("edges"))
    top = m.groupBy("source_dir").agg(F.sum("edges").alias("total")).orderBy(F.desc("total"), "source_dir").limit(k)
    return m.join(top.select("source_dir"), "source_dir", "left_semi")


def impact_band(n: Column) -> Column:
    return F.when(n > 20, "high").when(n > 10, "medium").otherwise("low")


def high_impact_symbols(g: CodeGraph, k: int = 15) -> DataFrame:
    found = g.nodes.where(F.col("name") != PSEUDO).join(g.in_degree, "id")
    return found.orderBy(F.desc("dependents"), "id").limit(k).select("id", "name", "kind", "file_path", "dependents", impact_band(F.col("dependents")).alias("impact"))


def isolated_files(g: CodeGraph, k: int = 20) -> DataFrame:
    return g.files.select("file_path", "symbols").join(g.fp.select(F.col("target_file").alias("file_path")), "file_path", "left_anti").orderBy("file_path").limit(k)


def connected_pairs(g: CodeGraph, k: int = 10) -> DataFrame:
    """Unordered file pairs by references either way."""
    lo, hi = F.least("source_file", "target_file").alias("file_a"), F.greatest("source_file", "target_file").alias("file_b")
    return g.fp.groupBy(lo, hi).agg(F.sum("edges").alias("edges")).orderBy(F.desc("edges"), "file_a", "file_b").limit(k)


def _exports(g: CodeGraph) -> DataFrame:
    return g.with_dependents().where(F.col("exported") & (F.col("name") != PSEUDO))


def exports_by_file(g: CodeGraph) -> DataFrame:
    return _exports(g).groupBy("file_path").agg(one("exports"), F.sum("dependents").alias("dependents"))


def exports_by_kind(g: CodeGraph, k: int = 20) -> DataFrame:
    return ranked(_exports(g), ["kind"], F.desc("dependents"), F.asc("id")).where(F.col("rank") <= k).select("kind", "id", "dependents", F.col("rank").cast("long").alias("rank"))


def most_used_exports(g: CodeGraph, k: int = 20) -> DataFrame:
    return _exports(g).where("dependents > 0").orderBy(F.desc("dependents"), "id").limit(k).select("id", "name", "kind", "file_path", "dependents")


def unused_exports(g: CodeGraph) -> DataFrame:
    return _exports(g).where("dependents = 0").groupBy("file_path").agg(one("unused"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


def barrel_files(g: CodeGraph) -> DataFrame:
    """Files of whose exports at least half are re-exports (their symbols refer on to other files)."""
    on = g.xf.where("kind in ('exports', 're-exports', 'imports')").select(F.col("source").alias("id"), "target_file")
    ex = _exports(g).select("id", "file_path").join(on, "id", "left")
    per = ex.groupBy("file_path", "id").agg(F.max(F.col("target_file").isNotNull()).alias("re"), F.collect_set("target_file").alias("from"))
    out = per.groupBy("file_path").agg(one("exports"), F.count_if("re").alias("re_exports"), F.array_size(F.array_distinct(F.flatten(F.collect_list("from")))).cast("long").alias("source_files"))
    return out.where(F.col("re_exports") * 2 >= F.col("exports")).where("re_exports > 0")


def file_lengths(g: CodeGraph) -> DataFrame:
    per = g.nodes.groupBy("file_path").agg(F.max("end_line").alias("lines"))
    return per.agg(one("files"), F.round(F.avg("lines")).cast("long").alias("mean_lines"), F.floor(F.percentile("lines", 0.5) + 0.5).cast("long").alias("median_lines"), F.count_if(X.basename(F.col("file_path")).rlike(r"^index\.")).alias("barrels"), F.count_if(X.is_test_path(F.col("file_path"))).alias("tests"))


def naming(g: CodeGraph) -> DataFrame:
    """Counts of (category, style) of file and symbol names."""
    n, kind = F.col("name"), F.col("kind")

    def style(*rules: tuple[str, Column], other: str | None = "other") -> Column:
        return reduce(lambda rest, r: F.when(r[1], r[0]).otherwise(rest), reversed(rules), F.lit(other))

    cp = (("camelCase", X.camel(n)), ("PascalCase", X.pascal(n)))
    category = F.when(kind.isin("function", "method"), "functions").when(kind == "class", "classes").when(kind == "interface", "interfaces").when(kind == "constant", "constants").when(kind == "type_alias", "types")
    styles = (
        F.when(category == "functions", style(*cp, ("snake_case", X.snake(n))))
        .when(category == "classes", style(cp[1]))
        .when(category == "interfaces", style(("IPrefixed", n.startswith("I") & X.pascal(F.expr("substring(name, 2)"))), cp[1]))
        .when(category == "constants", style(("UPPER_SNAKE", X.upper_snake(n))))
        .otherwise(style(cp[1], cp[0]))
    )
    symbols = g.nodes.select(category.alias("category"), styles.alias("style")).where("category is not null")
    files = g.files.select(X.stem(F.col("file_path")).alias("name")).select(F.lit("files").alias("category"), style(*cp, ("kebab-case", X.kebab(n)), ("snake_case", X.snake(n))).alias("style"))
    return symbols.unionByName(files).groupBy("category", "style").agg(one("n"))


def kind_distribution(g: CodeGraph) -> DataFrame:
    n = g.nodes.groupBy("kind").agg(one("n"))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def import_style(g: CodeGraph) -> DataFrame:
    n = lambda of, name: F.coalesce(F.sum(F.when(of, F.col("edges"))), F.lit(0)).cast("long").alias(name)
    i = g.pairs.where("kind = 'imports'")
    return i.agg(n(F.lit(True), "imports"), n(X.basename(F.col("target_file")).rlike(r"^index\."), "barrel"), n(F.col("source_file") == F.col("target_file"), "local"))


def export_patterns(g: CodeGraph) -> DataFrame:
    e = g.nodes.where("exported")
    return e.agg(F.count_if(F.col("name") != "default").alias("named"), F.count_if(F.col("name") == "default").alias("default_exports"), F.count_if(F.col("kind") == "export").alias("re_exports"))


def _unpivot(counts: DataFrame, names: list[str], key: str) -> DataFrame:
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias(key), F.col(n).alias("n")) for n in names])).alias("x")).select("x.*")


def design_patterns(g: CodeGraph) -> DataFrame:
    n, kind = F.col("name"), F.col("kind")
    named = kind.isin("class", "function")
    rules = {
        "service": (kind == "class") & n.endswith("Service"), "factory": (kind == "function") & n.startswith("create"), "hook": (kind == "function") & n.startswith("use") & (F.length(n) > 3),
        "middleware": F.lower("file_path").contains("middleware"), "controller": named & n.endswith("Controller"), "repository": named & n.endswith("Repository"), "handler": named & n.endswith("Handler"),
    }
    return _unpivot(g.nodes.agg(*[F.count_if(c).alias(k) for k, c in rules.items()]), list(rules), "pattern")


#: Parts of names that speak of errors.
ERROR_WORDS = ("error", "err", "exception", "throw", "fail", "invalid", "not_found", "notfound", "unauthorized", "forbidden", "timeout", "retry", "catch", "try")


def error_symbols(g: CodeGraph) -> DataFrame:
    low = F.lower("name")
    has = lambda *w: reduce(lambda a, b: a | b, (low.contains(x) for x in w))
    category = F.when(has("retry", "timeout"), "retry_timeout").when(has("invalid", "validate"), "validation").when(has("unauthorized", "forbidden"), "auth_error").when(has("notfound", "not_found"), "not_found").otherwise("error_handling")
    return g.nodes.where((F.col("name") != PSEUDO) & has(*ERROR_WORDS)).withColumn("category", category)


def error_symbols_top(g: CodeGraph, k: int = 10) -> DataFrame:
    return ranked(error_symbols(g), ["category"], F.asc("seq")).where(F.col("rank") <= k).select("category", "id", "kind", "start_line", F.col("rank").cast("long").alias("rank"))


def error_classes(g: CodeGraph) -> DataFrame:
    """Error classes and whether anything uses them."""
    low = F.lower("name")
    return g.with_dependents().where((F.col("kind") == "class") & (low.contains("error") | low.contains("exception"))).select("id", "file_path", "dependents", (F.col("dependents") == 0).alias("unused"))


def error_prone_files(g: CodeGraph, k: int = 15) -> DataFrame:
    errs = error_symbols(g).groupBy("file_path").agg(one("errors"))
    f = g.edge_degree.where("connections > 5").join(errs, "file_path", "left").select("file_path", "connections", *_zero("errors"))
    return f.withColumn("risk", F.col("connections") * (1 + 0.5 * F.col("errors"))).orderBy(F.desc("risk"), "file_path").limit(k)


def error_patterns(g: CodeGraph) -> DataFrame:
    low = F.lower("name")
    rules = {
        "custom_errors": (F.col("kind") == "class") & (low.contains("error") | low.contains("exception")), "retry": low.contains("retry") | low.contains("attempt"), "timeout": low.contains("timeout"),
        "validation": low.contains("validate") | low.contains("validator") | low.contains("check"), "guard": low.contains("guard") | low.startswith("is") | low.startswith("has"),
    }
    return _unpivot(g.nodes.agg(*[F.count_if(c).alias(k) for k, c in rules.items()]), list(rules), "pattern")


def unguarded_files(g: CodeGraph) -> DataFrame:
    """Busy files without any error handling."""
    return g.edge_degree.where("connections > 10").join(error_symbols(g).select("file_path"), "file_path", "left_anti").select("file_path", "connections")


def test_files(g: CodeGraph) -> DataFrame:
    return g.files.where(X.is_test_path(F.col("file_path"))).select("file_path", "symbols")


def tested_sources(g: CodeGraph) -> DataFrame:
    """Test files with the source file whose path they derive from: the same directory, else the one above."""
    name = F.regexp_replace(X.basename(F.col("file_path")), r"\.(test|spec)\.", ".")
    d = X.dirname(F.col("file_path"))
    up = F.regexp_replace(d, r"/?(__tests__|tests?)$", "")
    tests = g.files.where(X.is_test_path(F.col("file_path"))).select(F.col("file_path").alias("test_file"), F.posexplode(F.array_distinct(F.array(F.concat_ws("/", d, name), F.concat_ws("/", up, name)))).alias("place", "file_path"))
    return tests.join(g.files.select("file_path"), "file_path").where("file_path <> test_file").groupBy("test_file").agg(F.min_by("file_path", "place").alias("source_file"))


def untested_files(g: CodeGraph, k: int = 20) -> DataFrame:
    source = g.files.where(~X.is_test_path(F.col("file_path")))
    rest = source.join(tested_sources(g).select(F.col("source_file").alias("file_path")), "file_path", "left_anti").join(g.edge_degree, "file_path", "left").select("file_path", *_zero("connections"))
    priority = F.when(F.col("connections") > 10, "high").when(F.col("connections") > 5, "medium").otherwise("low")
    return rest.withColumn("priority", priority).orderBy(F.desc("connections"), "file_path").limit(k)


def test_stats(g: CodeGraph) -> DataFrame:
    f = g.files.withColumn("is_test", X.is_test_path(F.col("file_path")))
    return f.groupBy(X.first_dir(F.col("file_path")).alias("top_dir")).agg(F.count_if("is_test").alias("tests"), F.count_if(~F.col("is_test")).alias("sources"))


def feature_clusters(g: CodeGraph) -> DataFrame:
    """Directories of at least two files with at least two file references among them; named by their commonest word."""
    inside = g.fp.where(X.dirname(F.col("source_file")) == X.dirname(F.col("target_file"))).groupBy(X.dirname(F.col("source_file")).alias("dir")).agg(one("internal"))
    files = g.files.groupBy(X.dirname(F.col("file_path")).alias("dir")).agg(one("files"))
    words = g.nodes.select(X.dirname(F.col("file_path")).alias("dir"), F.explode(F.split(F.regexp_replace("name", "([a-z])([A-Z])", "$1 $2"), "[^A-Za-z]+")).alias("w")).select("dir", F.lower("w").alias("w")).where("length(w) > 3")
    name = words.groupBy("dir", "w").agg(one("n")).groupBy("dir").agg(F.min_by("w", F.struct(-F.col("n"), "w")).alias("name"))
    return files.where("files >= 2").join(inside.where("internal >= 2"), "dir").join(name, "dir", "left")


def reading_order(g: CodeGraph) -> DataFrame:
    """Three foundation, five core and three orchestration files, each step leaving out those before."""
    s = file_summary(g).withColumn("total", F.col("incoming") + F.col("outgoing"))
    top = lambda df, n, step, *by: df.orderBy(*by, "file_path").limit(n).select("file_path", F.lit(step).alias("step"))
    first = top(s.where("incoming > outgoing"), 3, "foundation", F.desc("incoming"))
    core = top(s.where("total > 0").join(F.broadcast(first), "file_path", "left_anti"), 5, "core", F.desc("total"))
    seen = first.unionByName(core)
    return seen.unionByName(top(s.where("outgoing > incoming").join(F.broadcast(seen), "file_path", "left_anti"), 3, "orchestration", F.desc("outgoing")))


def heavily_used_files(g: CodeGraph, least: int = 5, k: int = 5) -> DataFrame:
    return g.edge_degree.where(F.col("incoming") >= least).orderBy(F.desc("incoming"), "file_path").limit(k).select("file_path", "incoming")


def file_index(g: CodeGraph) -> DataFrame:
    """Per file its symbols and the files on either side."""
    use = g.fp.groupBy(F.col("source_file").alias("file_path")).agg(F.array_join(F.sort_array(F.collect_set("target_file")), ",").alias("uses"))
    used = g.fp.groupBy(F.col("target_file").alias("file_path")).agg(F.array_join(F.sort_array(F.collect_set("source_file")), ",").alias("used_by"))
    return g.files.select("file_path", "symbols").join(use, "file_path", "left").join(used, "file_path", "left").select("file_path", "symbols", F.coalesce("uses", F.lit("")).alias("uses"), F.coalesce("used_by", F.lit("")).alias("used_by"))


def symbol_index(g: CodeGraph, k: int = 100) -> DataFrame:
    return ranked(g.nodes.where(F.col("name") != PSEUDO), ["kind"], F.asc("name"), F.asc("id")).where(F.col("rank") <= k).select("kind", "name", "file_path", "start_line", F.col("rank").cast("long").alias("rank"))


def connection_matrix(g: CodeGraph) -> DataFrame:
    """Top directories against each other: out, in or both."""
    d = g.fp.select(X.first_dir(F.col("source_file")).alias("s"), X.first_dir(F.col("target_file")).alias("t")).where("s <> t").distinct()
    flip = d.select(F.col("s").alias("t"), F.col("t").alias("s")).withColumn("back", F.lit(True))
    both = d.withColumn("out", F.lit(True)).join(flip, ["s", "t"], "full")
    return both.select(F.col("s").alias("dir_a"), F.col("t").alias("dir_b"), F.when(F.col("out") & F.col("back"), "both").when(F.col("out"), "out").otherwise("in").alias("arrow"))


def viz_arcs(g: CodeGraph) -> DataFrame:
    return g.pairs.where("source_file <> target_file").groupBy("source_file", "target_file").agg(F.sum("edges").alias("edges"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))


def viz_files(g: CodeGraph) -> DataFrame:
    """Files in drawing order with bar widths and places on the line."""
    s = file_summary(g).withColumn("dir", X.dirname(F.col("file_path")))
    w = s.withColumn("width", F.greatest(F.lit(4), F.col("symbols")).cast("long"))
    # one bar for each file: a running sum over all of them, in one task as a drawing is
    return w.withColumn("x", F.coalesce(F.sum("width").over(Window.orderBy("dir", "file_path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))


def viz_layout(g: CodeGraph) -> DataFrame:
    """Arcs with the places of their ends, their span as a share of the longest, and the width of their stroke."""
    at = viz_files(g).select("file_path", (F.col("x") + F.col("width") / 2).alias("centre"))
    end = lambda side: at.select(F.col("file_path").alias(f"{side}_file"), F.col("centre").alias(f"{side}_x"))
    arcs = viz_arcs(g).join(end("source"), "source_file").join(end("target"), "target_file").withColumn("span", F.abs(F.col("target_x") - F.col("source_x")))
    longest = arcs.agg(F.max("span").alias("longest"))
    stroke = F.least(F.lit(4.0), 1 + F.log(F.col("edges").cast("double")))
    return arcs.crossJoin(F.broadcast(longest)).select("source_file", "target_file", "source_x", "target_x", F.round(F.col("span") / F.col("longest"), 6).alias("share"), F.round(stroke, 6).alias("stroke"))  # one row


def viz_search(g: CodeGraph, text: str) -> DataFrame:
    """Arcs at a file whose path holds the text, in any case."""
    hit = lambda side: F.lower(F.col(f"{side}_file")).contains(text.strip().lower())
    return viz_arcs(g).where(hit("source") | hit("target"))


def viz_limited(g: CodeGraph, k: int = 20) -> DataFrame:
    top = most_connected(g, k).select("file_path")
    ends = lambda c: F.broadcast(top.select(F.col("file_path").alias(c)))
    return viz_arcs(g).join(ends("source_file"), "source_file", "left_semi").join(ends("target_file"), "target_file", "left_semi")


def pair_weights(g: CodeGraph) -> DataFrame:
    lo, hi = F.least("source_file", "target_file").alias("file_a"), F.greatest("source_file", "target_file").alias("file_b")
    return g.fp.groupBy(lo, hi).agg(F.sum("edges").alias("weight"))
