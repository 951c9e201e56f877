"""Column expressions that the operators share: paths, languages, bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extension to language.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "rs": "rust",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "cs": "csharp", "java": "java", "kt": "kotlin", "kts": "kotlin", "php": "php",
}


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Like POSIX: '.' for a bare file name."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"\.([^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def first_dir(path: Column) -> Column:
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise(F.lit("."))


def module_dir(path: Column) -> Column:
    """The directory that stands for a module: two levels, null for files that belong to none."""
    parts = F.split(path, "/")
    n = F.size(parts)
    two = F.concat_ws("/", parts[0], parts[1])
    aside = reduce(lambda a, b: a | b, (parts[0].contains(x) for x in ("test", "fixture", "example")), parts[0].isin("node_modules", "dist", "build"))
    return F.when(n < 2, None).when(parts[0] == "src", F.when(n >= 3, two)).when(aside, None).otherwise(two)


def language(path: Column) -> Column:
    ext = extension(path)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext), F.lit("other"))


def band(value: Column, steps: list[tuple[float, int]], beyond: int, at_most: bool = True) -> Column:
    """Score of the first step that the value stays within (at_most) or reaches."""
    out = F.lit(beyond)
    for edge, score in reversed(steps):
        out = F.when(value <= edge if at_most else value >= edge, score).otherwise(out)
    return out


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def is_test_path(path: Column) -> Column:
    return reduce(lambda a, b: a | b, (path.contains(x) for x in ("__tests__/", ".test.", ".spec.", "/test/", "/tests/")))


def camel(name: Column) -> Column:
    return name.rlike("^[a-z][a-zA-Z0-9]*$") & name.rlike("[A-Z]")


def pascal(name: Column) -> Column:
    return name.rlike("^[A-Z][a-zA-Z0-9]*$")


def kebab(name: Column) -> Column:
    return name.rlike("^[a-z][a-z0-9]*(-[a-z0-9]+)*$")


def snake(name: Column) -> Column:
    return name.rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)*$")


def upper_snake(name: Column) -> Column:
    return name.rlike("^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$")
