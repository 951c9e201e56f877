"""Dead code: candidates without dependents, exclusions, confidence and report."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..plans.graph import CodeGraph

#: Fixed values of the exclusion rules.
KINDS = ("function", "class", "interface", "type", "type_alias", "enum", "const", "constant", "let", "var", "method", "property")
FRAMEWORK_DIRS = ("pages", "routes", "middleware", "commands", "api", "app", "Controllers", "Hubs", "Migrations", "controller", "controllers", "service", "repository", "config", "configuration")
CONFIG_PARTS = (".config.", "config/", "vite.config", "rollup.config", "webpack.config")
KOTLIN_NAMES = (
    "main", "onCreate", "onStart", "onResume", "onPause", "onStop", "onDestroy", "onCreateView", "onViewCreated", "onDestroyView", "onSaveInstanceState", "onRestoreInstanceState",
    "onActivityResult", "onRequestPermissionsResult", "onConfigurationChanged", "onNewIntent", "readObject", "writeObject", "readResolve", "writeReplace",
)
PHP_NAMES = (
    "__construct", "__destruct", "__call", "__callStatic", "__get", "__set", "__isset", "__unset", "__sleep", "__wakeup", "__serialize", "__unserialize", "__toString", "__invoke", "__set_state", "__clone", "__debugInfo",
    "init", "admin_init", "wp_enqueue_scripts", "admin_enqueue_scripts", "widgets_init", "register_activation_hook", "register_deactivation_hook", "add_action", "add_filter", "activate", "deactivate",
    "register", "boot", "handle", "authorize", "rules", "messages", "prepareForValidation", "failed", "broadcastOn", "broadcastAs", "broadcastWith",
    "getSubscribedEvents", "getSubscribedServices", "configureOptions", "buildForm", "load", "getConfigTreeBuilder", "setUp", "tearDown", "setUpBeforeClass", "tearDownAfterClass",
)
RANK = {"high": 3, "medium": 2, "low": 1}


def package_entries(package_json: str) -> list[str]:
    """Paths that a package manifest names as main, module or (anywhere within) exports."""
    found: list[str] = []

    def walk(x: object) -> None:
        if isinstance(x, str):
            found.append(x.removeprefix("./"))
        elif isinstance(x, dict):
            for v in x.values():
                walk(v)

    manifest = json.loads(package_json)
    for key in ("main", "module", "exports"):
        walk(manifest.get(key))
    return sorted({y for x in found for y in (x, x.removesuffix(".js") + ".ts" if x.endswith(".js") else x, x.removesuffix(".ts") + ".js" if x.endswith(".ts") else x)})


def exclusion(include_tests: bool = False, entries: list[str] | None = None) -> Column:
    """Why a symbol is left out; null if it isn't. The first rule that fits counts."""
    path, name = F.col("file_path"), F.col("name")
    any_of = lambda words: reduce(lambda a, b: a | b, (path.contains(w) for w in words))
    implicit = path.rlike(r"\.(h|hpp|hh|hxx|h\+\+|inl|ipp)$") | (name == "main") | name.startswith("operator") | name.startswith("~")
    kotlin = path.rlike(r"\.kts?$") & name.isin(*KOTLIN_NAMES)
    php = path.endswith(".php") & (name.isin(*PHP_NAMES) | name.startswith("test"))
    rules = [
        ("test", X.is_test_path(path) & F.lit(not include_tests)), ("entry", path.isin(entries or [""])), ("config", any_of(CONFIG_PARTS)), ("types", path.endswith(".d.ts")),
        ("default", F.col("kind") == "default"), ("framework", any_of(f"/{d}/" for d in FRAMEWORK_DIRS) | implicit | kotlin | php),
    ]
    return reduce(lambda rest, r: F.when(r[1], r[0]).otherwise(rest), reversed(rules), F.lit(None).cast("string"))


def candidates(g: CodeGraph) -> DataFrame:
    kind = F.col("kind")
    shown = kind.isin(*KINDS) & (~kind.isin("const", "let", "var") | F.col("exported"))
    return g.nodes.where(shown).join(g.in_degree.select("id"), "id", "left_anti")


def dead_symbols(g: CodeGraph, include_tests: bool = False, entries: list[str] | None = None) -> DataFrame:
    barrel = X.basename(F.col("file_path")).isin("index.ts", "index.js")
    confidence = F.when(F.col("exported") & barrel, "medium").otherwise("high")
    reason = F.when(~F.col("exported"), "not exported, no references").when(barrel, "exported from a barrel file, no dependents").otherwise("exported, no dependents")
    return candidates(g).withColumn("excluded", exclusion(include_tests, entries)).where("excluded is null").select("id", "name", "kind", "file_path", "start_line", "exported", confidence.alias("confidence"), reason.alias("reason"))


def exclusion_counts(g: CodeGraph, include_tests: bool = False, entries: list[str] | None = None) -> DataFrame:
    return candidates(g).withColumn("excluded", exclusion(include_tests, entries)).where("excluded is not null").groupBy("excluded").agg(F.count(F.lit(1)).alias("n"))


def at_least(found: DataFrame, confidence: str = "low") -> DataFrame:
    rank = reduce(lambda rest, k: F.when(F.col("confidence") == k, RANK[k]).otherwise(rest), RANK, F.lit(0))
    return found.where(rank >= RANK[confidence])


def report(g: CodeGraph, include_tests: bool = False) -> DataFrame:
    """Counts by confidence over all found, and their share of all symbols."""
    found = dead_symbols(g, include_tests).agg(*[F.count_if(F.col("confidence") == k).alias(k) for k in RANK], F.count(F.lit(1)).alias("dead"))
    total = g.nodes.agg(F.count(F.lit(1)).alias("symbols"))
    return found.crossJoin(total).withColumn("percent", F.round(100.0 * F.col("dead") / F.greatest("symbols", F.lit(1)), 4))  # one row each
