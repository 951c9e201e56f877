"""Symbols and references of one source file, by language.

Python is parsed by its own grammar. The other languages are read by tables of declaration patterns over the text without
comments and strings, with brace depth for scopes; what a full parser would also find (overloads by type, macros that
make declarations) stays out. Every extractor yields rows of one shape, so they run as one table function per partition.
"""

from __future__ import annotations

import ast
import bisect
import json
import posixpath
import re
from collections.abc import Callable, Iterator

import pandas as pd

from .aliases import Aliases, expanded

#: (record, seq, id, name, kind, file_path, start_line, end_line, exported, scope, source, target, line, error)
ROW = "rec string, seq long, id string, name string, kind string, file_path string, start_line int, end_line int, exported boolean, scope string, source string, target string, line int, error string"
COLUMNS = [c.split()[0] for c in ROW.split(", ")]
PSEUDO = "__file__"
#: Calls of the languages' own functions, which refer to no symbol of a project.
BUILTINS = {
    "python": {"print", "len", "range", "str", "int", "float", "list", "dict", "set", "tuple", "bool", "isinstance", "super", "open", "type", "enumerate", "zip", "map", "filter", "sorted"},
    "go": {"make", "len", "cap", "append", "copy", "delete", "panic", "recover", "print", "println", "new", "close"},
    "rust": {"Some", "None", "Ok", "Err", "Box", "Vec", "String"},
    "c": {"printf", "scanf", "malloc", "free", "sizeof", "memcpy", "memset", "strlen", "strcmp", "fprintf", "sprintf"},
    "php": {"echo", "print", "isset", "empty", "array", "count", "strlen", "require", "include"},
}
WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "sizeof", "await", "new", "typeof", "else", "do", "match", "when", "using", "lock", "foreach", "elseif", "fn", "func", "def", "class", "super", "this", "require", "import"}


class File:
    """Collects the rows of one file; ids join path and name."""

    def __init__(self, path: str, base: int, aliases: Aliases = ()) -> None:
        self.path, self.base, self.aliases, self.rows = path, base, aliases, []

    def id(self, name: str, path: str | None = None) -> str:
        return f"{path or self.path}::{name}"

    def symbol(self, name: str, kind: str, start: int, end: int, exported: bool, scope: str | None = None) -> str:
        key = self.id(f"{scope}.{name}" if scope else name)
        self.rows.append({"rec": "sym", "id": key, "name": name, "kind": kind, "start_line": start, "end_line": end, "exported": exported, "scope": scope})
        return key

    def ref(self, source: str, target: str, kind: str, line: int) -> None:
        self.rows.append({"rec": "ref", "source": source, "target": target, "kind": kind, "line": line})

    def done(self) -> list[dict]:
        return [{**dict.fromkeys(COLUMNS), **r, "file_path": self.path, "seq": self.base + i} for i, r in enumerate(self.rows)]


Known = Callable[[str], bool]


def resolve_relative(path: str, spec: str, known: Known, extensions: tuple[str, ...]) -> str | None:
    """The first existing file that a relative import may mean."""
    return resolve_base(posixpath.normpath(posixpath.join(posixpath.dirname(path), spec)), known, extensions)


def resolve_import(path: str, spec: str, known: Known, extensions: tuple[str, ...], aliases: Aliases) -> str | None:
    """As resolve_relative; a path from / starts at the project's root, any other where an alias says."""
    if spec.startswith("."):
        return resolve_relative(path, spec, known, extensions)
    base = posixpath.normpath(spec[1:]) if spec.startswith("/") else expanded(spec, aliases)
    return resolve_base(base, known, extensions) if base else None


def resolve_base(base: str, known: Known, extensions: tuple[str, ...]) -> str | None:
    bare = re.sub(r"\.(js|jsx|mjs|cjs)$", "", base)
    for candidate in [base, *(b + e for b in dict.fromkeys((bare, base)) for e in extensions), *(f"{base}/index{e}" for e in extensions)]:
        if known(candidate):
            return candidate
    return None


def python_module(path: str, module: str, level: int, known: Known) -> str | None:
    folder = posixpath.dirname(path)
    for _ in range(level - 1):
        folder = posixpath.dirname(folder)
    bases = [folder] if level else ["", folder]
    for base in bases:
        at = posixpath.join(base, *module.split(".")) if module else base
        for candidate in (f"{at}.py", f"{at}/__init__.py"):
            if known(candidate.lstrip("/")):
                return candidate.lstrip("/")
    return None


def python(f: File, text: str, known: Known) -> None:
    tree = ast.parse(text)
    imports: dict[str, str] = {}
    own: set[str] = set()

    def declare(body: list[ast.stmt], scope: str | None) -> None:
        for node in body:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                f.symbol(node.name, "method" if scope else "function", node.lineno, node.end_lineno or node.lineno, not node.name.startswith("_"), scope)
                own.add(f"{scope}.{node.name}" if scope else node.name)
            elif isinstance(node, ast.ClassDef):
                f.symbol(node.name, "class", node.lineno, node.end_lineno or node.lineno, not node.name.startswith("_"), scope)
                own.add(node.name)
                declare(node.body, node.name)
            elif isinstance(node, ast.Assign | ast.AnnAssign) and scope is None:
                for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(t, ast.Name):
                        f.symbol(t.id, "constant" if t.id.isupper() else "variable", node.lineno, node.end_lineno or node.lineno, not t.id.startswith("_"))
                        own.add(t.id)

    declare(tree.body, None)
    for node in ast.walk(tree):
        if isinstance(node, ast.ImportFrom):
            at = python_module(f.path, node.module or "", node.level, known)
            for a in node.names:
                inner = python_module(f.path, f"{node.module}.{a.name}" if node.module else a.name, node.level, known)
                if inner and inner != at:
                    imports[a.asname or a.name] = f.id(PSEUDO, inner)
                elif at:
                    imports[a.asname or a.name] = f.id(a.name, at)
                else:
                    continue
                f.ref(f.id(PSEUDO), imports[a.asname or a.name], "imports", node.lineno)
        elif isinstance(node, ast.Import):
            for a in node.names:
                if at := python_module(f.path, a.name, 0, known):
                    imports[a.asname or a.name] = f.id(PSEUDO, at)
                    f.ref(f.id(PSEUDO), f.id(PSEUDO, at), "imports", node.lineno)

    def target(name: str, scope: str | None) -> str:
        if name in imports:
            return imports[name]
        return f.id(f"{scope}.{name}" if scope and f"{scope}.{name}" in own and name not in own else name)

    def uses(node: ast.AST, holder: str, scope: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                for b in child.bases:
                    if isinstance(b, ast.Name):
                        f.ref(f.id(child.name), target(b.id, None), "inherits", child.lineno)
                uses(child, f.id(child.name), child.name)
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                inner = f.id(f"{scope}.{child.name}" if scope else child.name)
                for d in child.decorator_list:
                    if isinstance(d, ast.Name):
                        f.ref(inner, target(d.id, None), "decorates", d.lineno)
                uses(child, inner, scope)
            else:
                if isinstance(child, ast.Call):
                    fn = child.func
                    if isinstance(fn, ast.Name) and fn.id not in BUILTINS["python"]:
                        f.ref(holder, target(fn.id, scope), "calls", child.lineno)
                    elif isinstance(fn, ast.Attribute) and isinstance(fn.value, ast.Name):
                        if fn.value.id in ("self", "cls") and scope:
                            f.ref(holder, f.id(f"{scope}.{fn.attr}"), "calls", child.lineno)
                        elif fn.value.id in imports:
                            f.ref(holder, f.id(fn.attr, imports[fn.value.id].rsplit("::", 1)[0]) if imports[fn.value.id].endswith(PSEUDO) else imports[fn.value.id], "calls", child.lineno)
                uses(child, holder, scope)

    uses(tree, f.id(PSEUDO), None)


def blanked(text: str, line_comment: str = "//", hash_comment: bool = False) -> str:
    """The text with comments and the insides of strings as spaces; lines and columns stay."""
    parts = [r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'", r"`(?:\\.|[^`\\])*`", r"/\*.*?\*/", re.escape(line_comment) + r"[^\n]*"] + ([r"#[^\n]*"] if hash_comment else [])
    keep = lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] in "/#" else m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1]
    return re.sub("|".join(parts), keep, text, flags=re.S)


#: Declarations by language: (kind, pattern with the group name; exported where the group x took part or the rule says so).
MOD = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|virtual|override|async|open|data|inline|readonly|unsafe|extern|synchronized|suspend|operator|const|lateinit|enum|annotation|inner|value|companion)\s+)*"
RULES: dict[str, list[tuple[str, str]]] = {
    "typescript": [
        ("class", r"^[ \t]*(?P<x>export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<n>[\w$]+)"), ("function", r"^[ \t]*(?P<x>export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<n>[\w$]+)"),
        ("interface", r"^[ \t]*(?P<x>export\s+)?interface\s+(?P<n>[\w$]+)"), ("type_alias", r"^[ \t]*(?P<x>export\s+)?type\s+(?P<n>[\w$]+)[^=\n]*="), ("enum", r"^[ \t]*(?P<x>export\s+)?(?:const\s+)?enum\s+(?P<n>[\w$]+)"),
        ("function", r"^(?P<x>export\s+)?(?:const|let|var)\s+(?P<n>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)\n]*\)|[\w$]+)\s*(?::[^=\n]+)?=>"), ("variable", r"^(?P<x>export\s+)?(?:const|let|var)\s+(?P<n>[\w$]+)\s*(?::[^=\n]+)?=(?!.*=>)"),
        ("method", r"^[ \t]+(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*(?P<n>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)[\w$]+)\s*\([^;{}]*\)\s*(?::[^{;\n]+)?\{"),
    ],
    "go": [("function", r"^func\s+(?P<n>\w+)\s*[\[(]"), ("method", r"^func\s+\(\s*\w*\s*\*?(?P<s>\w+)[^)]*\)\s*(?P<n>\w+)\s*\("), ("class", r"^(?:type\s+)?\s*(?P<n>\w+)\s+struct\b"), ("interface", r"^(?:type\s+)?\s*(?P<n>\w+)\s+interface\b"), ("type_alias", r"^type\s+(?P<n>\w+)\s+(?!struct|interface)=?\s*[\w\[\]*.]+"), ("constant", r"^const\s+(?P<n>\w+)"), ("variable", r"^var\s+(?P<n>\w+)")],
    "rust": [("function", r"^[ \t]*(?P<x>pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+|extern\s+)*fn\s+(?P<n>\w+)"), ("class", r"^(?P<x>pub(?:\([^)]*\))?\s+)?(?:struct|union)\s+(?P<n>\w+)"), ("enum", r"^(?P<x>pub(?:\([^)]*\))?\s+)?enum\s+(?P<n>\w+)"), ("interface", r"^(?P<x>pub(?:\([^)]*\))?\s+)?trait\s+(?P<n>\w+)"), ("constant", r"^(?P<x>pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?P<n>\w+)\s*:"), ("type_alias", r"^(?P<x>pub(?:\([^)]*\))?\s+)?type\s+(?P<n>\w+)")],
    "c": [("constant", r"^[ \t]*#[ \t]*define\s+(?P<n>\w+)(?!\()"), ("function", r"^[ \t]*#[ \t]*define\s+(?P<n>\w+)\("), ("class", r"^(?:typedef\s+)?(?:struct|union)\s+(?P<n>\w+)\s*\{"), ("enum", r"^(?:typedef\s+)?enum\s+(?P<n>\w+)\s*\{"), ("type_alias", r"^typedef\b[^;{]*?\b(?P<n>\w+)\s*;|^\}\s*(?P<m>\w+)\s*;"), ("function", r"^(?P<static>static\s+)?(?:[\w*]+\s+)+\*?(?P<n>\w+)\s*\([^;{}]*\)\s*\{")],
    "cpp": [("module", r"^[ \t]*namespace\s+(?P<n>[\w:]+)"), ("class", r"^[ \t]*(?:template\s*<[^>]*>\s*)?(?:class|struct|union)\s+(?P<n>\w+)[^;\n(]*\{?\s*$"), ("enum", r"^[ \t]*enum\s+(?:class\s+)?(?P<n>\w+)"), ("type_alias", r"^[ \t]*using\s+(?P<n>\w+)\s*="), ("constant", r"^[ \t]*#[ \t]*define\s+(?P<n>\w+)"), ("function", r"^[ \t]*(?P<static>static\s+)?(?:[\w:<>,*&~]+\s+)+[*&]?(?:(?P<s>\w+)::)?(?P<n>~?\w+|operator\S+)\s*\([^;{}]*\)\s*(?:const|noexcept|override|\s)*\{")],
    "csharp": [("module", r"^[ \t]*namespace\s+(?P<n>[\w.]+)"), ("class", rf"^[ \t]*{MOD}(?:class|struct|record)\s+(?P<n>\w+)"), ("interface", rf"^[ \t]*{MOD}interface\s+(?P<n>\w+)"), ("enum", r"^[ \t]*(?:public\s+|internal\s+)?enum\s+(?P<n>\w+)"), ("type_alias", rf"^[ \t]*{MOD}delegate\s+\S+\s+(?P<n>\w+)"), ("method", rf"^[ \t]+{MOD}(?:[\w<>\[\],.?]+\s+)?(?P<n>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|using\b|lock\b|foreach\b|new\b)\w+)\s*\([^;{{}}]*\)\s*(?:\{{|=>)"), ("property", rf"^[ \t]+{MOD}[\w<>\[\],.?]+\s+(?P<n>\w+)\s*\{{\s*(?:get|set)")],
    "java": [("module", r"^package\s+(?P<n>[\w.]+)"), ("class", rf"^[ \t]*{MOD}(?:class|record)\s+(?P<n>\w+)"), ("interface", rf"^[ \t]*{MOD}@?interface\s+(?P<n>\w+)"), ("enum", r"^[ \t]*(?:(?:public|private|protected|static)\s+)*enum\s+(?P<n>\w+)"), ("method", rf"^[ \t]+{MOD}(?:<[^>]+>\s+)?(?:[\w<>\[\],.?]+\s+)?(?P<n>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|new\b|synchronized\b)\w+)\s*\([^;{{}}]*\)\s*(?:throws [\w., ]+)?\{{"), ("constant", r"^[ \t]+(?:public\s+|private\s+|protected\s+)?static\s+final\s+\S+\s+(?P<n>\w+)\s*="), ("property", r"^[ \t]+(?:public|private|protected)\s+(?!static\s+final)(?:final\s+)?[\w<>\[\],.?]+\s+(?P<n>\w+)\s*[;=]")],
    "kotlin": [("module", r"^package\s+(?P<n>[\w.]+)"), ("class", rf"^[ \t]*{MOD}(?:class|object)\s+(?P<n>\w+)"), ("interface", rf"^[ \t]*{MOD}(?:fun\s+)?interface\s+(?P<n>\w+)"), ("function", rf"^[ \t]*{MOD}fun\s+(?:<[^>]+>\s*)?(?:\w+\.)?(?P<n>\w+)\s*\("), ("property", rf"^[ \t]*{MOD}va[lr]\s+(?P<n>\w+)"), ("type_alias", r"^[ \t]*typealias\s+(?P<n>\w+)")],
    "php": [("module", r"^[ \t]*namespace\s+(?P<n>[\w\\]+)"), ("class", r"^[ \t]*(?:abstract\s+|final\s+|readonly\s+)*class\s+(?P<n>\w+)"), ("interface", r"^[ \t]*(?:interface|trait)\s+(?P<n>\w+)"), ("enum", r"^[ \t]*enum\s+(?P<n>\w+)"), ("function", r"^[ \t]*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?(?P<n>\w+)"), ("property", r"^[ \t]+(?:public|private|protected)\s+(?:static\s+|readonly\s+)*(?:\??[\w\\]+\s+)?\$(?P<n>\w+)"), ("constant", r"^[ \t]*(?:(?:public|private|protected)\s+)?const\s+(?P<n>\w+)\s*=")],
}
RULES["javascript"] = [r for r in RULES["typescript"] if r[0] not in ("interface", "type_alias", "enum")]
HOLDERS = {"class", "interface", "enum"}


def braced(f: File, text: str, known: Known, language: str) -> None:
    bare = blanked(text, hash_comment=language == "php")
    starts = [0, *(m.end() for m in re.finditer("\n", bare))]
    line_of = lambda at: bisect.bisect_right(starts, at)
    depth_end = _block_ends(bare)
    for kind, pattern in RULES[language]:
        for m in re.finditer(pattern, bare, re.M):
            name = m["n"] or (m.groupdict().get("m") or "")
            if not name or name in WORDS:
                continue
            at = m.start("n") if m["n"] else m.start()
            brace = bare.find("{", m.end() - 1)
            stop = bare.find("\n", m.end())
            end = depth_end.get(brace, m.end()) if brace >= 0 and (brace <= stop or stop < 0 or bare[m.end() : brace].strip() == "") else m.end()
            exported = {"go": name[:1].isupper(), "c": not m.groupdict().get("static"), "cpp": not m.groupdict().get("static")}.get(language, bool(m.groupdict().get("x")) if language in ("typescript", "javascript", "rust") else "private" not in m[0])
            f.rows.append((at, end, kind, name, exported, m.groupdict().get("s")))
    taken, f.rows = sorted({(r[0], r[3]): r for r in reversed(f.rows)}.values()), []
    holders = [(a, e, n) for a, e, k, n, _, _ in taken if k in HOLDERS]
    if language == "rust":
        holders += [(m.start(), depth_end.get(bare.find("{", m.end() - 1), m.end()), m["n"]) for m in re.finditer(r"^impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(?P<n>\w+)", bare, re.M)]
    spans = []
    for at, end, kind, name, exported, scope in taken:
        inside = [h for h in holders if h[0] < at < h[1] and h[2] != name]
        scope = scope or (max(inside)[2] if inside else None)
        if kind == "method" and scope is None:
            continue
        kind = "method" if kind == "function" and scope else kind
        spans.append((at, end, f.symbol(name, kind, line_of(at), line_of(end), exported, scope), name, scope))
    if language == "javascript":
        for m in re.finditer(r"module\.exports\s*=\s*\{([^}]*)\}|exports\.(\w+)\s*=", bare):
            names = set(re.findall(r"\w+", m[1] or "")) | {m[2]}
            for r in f.rows:
                r["exported"] = r["exported"] or r["name"] in names
    imports = dict(_imports(f, text, known, language))
    names = {s[3]: s[2] for s in reversed(spans)}
    for m in re.finditer(r"\b(?:class|interface|struct)\s+(\w+)[^{;\n]*?(?:extends|:|<)\s*([\w., ]+)(?:\s+implements\s+([\w., ]+))?", bare):
        for group, kind in ((m[2], "extends"), (m[3], "implements")):
            for base in re.findall(r"\w+", group or ""):
                if (base in names or base in imports) and m[1] in names and base != m[1]:
                    f.ref(names[m[1]], imports.get(base) or names[base], kind, line_of(m.start()))
    stop = BUILTINS.get("c" if language == "cpp" else language, set())
    for m in re.finditer(r"(?:(?P<o>[\w$]+)(?:\.|->|::))?(?P<n>[A-Za-z_$][\w$]*)\s*\(", bare):
        name = m["n"]
        if name in WORDS or name in stop or any(s[0] == m.start("n") for s in spans):
            continue
        holder = max(((s[0], s[2], s[4]) for s in spans if s[0] < m.start() < s[1]), default=(0, f.id(PSEUDO), None))
        goal = imports.get(name)
        if goal is None and m["o"] in imports and imports[m["o"]].endswith(PSEUDO):
            goal = f.id(name, imports[m["o"]].rsplit("::", 1)[0])
        if goal is None and holder[2] and f.id(f"{holder[2]}.{name}") in {s[2] for s in spans} and m["o"] in ("this", "self", "$this", None):
            goal = f.id(f"{holder[2]}.{name}")
        f.ref(holder[1], goal or names.get(name) or f.id(name), "calls", line_of(m.start()))


def _block_ends(text: str) -> dict[int, int]:
    ends, stack = {}, []
    for m in re.finditer("[{}]", text):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            ends[stack.pop()] = m.end()
    return ends


def _imports(f: File, text: str, known: Known, language: str) -> Iterator[tuple[str, str]]:
    """(local name, what it means), with an imports reference for each."""

    def told(at: str, name: str, local: str, pos: int) -> tuple[str, str]:
        goal = f.id(name, at)
        f.ref(f.id(PSEUDO), goal, "imports", text.count("\n", 0, pos) + 1)
        return local, goal

    if language in ("typescript", "javascript"):
        ext = (".ts", ".tsx", ".js", ".jsx") if language == "typescript" else (".js", ".jsx", ".mjs", ".cjs")
        for m in re.finditer(r"(?:import|export)\s+(?:type\s+)?(?P<what>[^'\";]*?)\s*from\s*['\"](?P<p>[^'\"]+)['\"]|import\s*['\"](?P<bare>[^'\"]+)['\"]|(?:const|let|var)\s+(?P<req>\{[^}]*\}|\w+)\s*=\s*require\(\s*['\"](?P<r>[^'\"]+)['\"]", text):
            spec = m["p"] or m["bare"] or m["r"]
            at = resolve_import(f.path, spec, known, ext, f.aliases)
            if not at:
                continue
            what = m["what"] if m["what"] is not None else m["req"]
            if not what:
                yield told(at, PSEUDO, PSEUDO, m.start())
                continue
            for part in re.findall(r"[\w$]+(?:\s*(?:as|:)\s*[\w$]+)?|\*\s*as\s*[\w$]+", what.replace("{", " ").replace("}", " ")):
                name, _, local = re.sub(r"\s*(as|:)\s*", "\x00", part).partition("\x00")
                whole = name.strip() == "*" or (m["r"] and "{" not in what)
                if name not in ("type", "default"):
                    yield told(at, PSEUDO if whole else name, local or name, m.start())
    elif language == "rust":
        for m in re.finditer(r"^\s*(?:pub\s+)?mod\s+(\w+)\s*;", text, re.M):
            folder = posixpath.dirname(f.path)
            for c in (f"{folder}/{m[1]}.rs", f"{folder}/{m[1]}/mod.rs"):
                if known(c.lstrip("/")):
                    yield told(c.lstrip("/"), PSEUDO, m[1], m.start())
                    break
        for m in re.finditer(r"^\s*(?:pub\s+)?use\s+(crate|super|self)::([\w:]+)(?:::\{([^}]*)\})?\s*;", text, re.M):
            parts, root = m[2].split("::"), f.path.split("/src/")[0] + "/src" if "/src/" in f.path else ("src" if f.path.startswith("src/") else posixpath.dirname(f.path))
            base = root if m[1] == "crate" else posixpath.dirname(f.path)
            names = re.findall(r"\w+", m[3] or "") or [parts.pop()]
            for c in (f"{base}/{'/'.join(parts)}.rs", f"{base}/{'/'.join(parts)}/mod.rs"):
                if parts and known(c.lstrip("/")):
                    yield from (told(c.lstrip("/"), n, n, m.start()) for n in names)
                    break
    elif language in ("c", "cpp"):
        for m in re.finditer(r'^[ \t]*#[ \t]*include\s*"([^"]+)"', text, re.M):
            for c in dict.fromkeys(posixpath.normpath(posixpath.join(b, m[1])) for b in (posixpath.dirname(f.path), "", "include", "src")):
                if known(c):
                    yield told(c, PSEUDO, m[1], m.start())
    elif language in ("java", "kotlin"):
        for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+)(?:\s+as\s+(\w+))?\s*;?", text, re.M):
            path, name = m[1].replace(".", "/"), m[1].rsplit(".", 1)[-1]
            for root in ("", "src/", "src/main/java/", "src/main/kotlin/", "app/src/main/java/", "app/src/main/kotlin/"):
                at = next((root + path + e for e in (".kt", ".java") if known(root + path + e)), None)
                if at:
                    yield told(at, name, m[2] or name, m.start())
                    break
    elif language == "php":
        for m in re.finditer(r"^\s*use\s+([\w\\]+?)(?:\s+as\s+(\w+))?\s*;", text, re.M):
            path, name = m[1].strip("\\").replace("\\", "/") + ".php", m[1].rsplit("\\", 1)[-1]
            tail = path.split("/", 1)[-1]
            at = next((r + p for r in ("", "src/", "app/", "lib/") for p in (path, tail) if known(r + p)), None)
            if at:
                yield told(at, name, m[2] or name, m.start())
        for m in re.finditer(r"(?:include|require)(?:_once)?\s*\(?\s*(?:__DIR__\s*\.\s*)?['\"]/?([^'\"]+)['\"]", text):
            at = posixpath.normpath(posixpath.join(posixpath.dirname(f.path), m[1]))
            if known(at):
                yield told(at, PSEUDO, m[1], m.start())
    elif language == "go":
        for m in re.finditer(r'(?:^import\s+|^\s+)(?:(\w+)\s+)?"([^"\n]+)"', text, re.M):
            tail = m[2].split("/")
            for k in range(len(tail)):
                folder = "/".join(tail[k:])
                if known(folder + "/"):
                    yield told(folder + "/", PSEUDO, m[1] or tail[-1], m.start())
                    break


def build_file(f: File, text: str, known: Known) -> None:
    """Dependencies that build files name, as symbols; modules and project references, as references."""
    name = posixpath.basename(f.path)
    line = lambda at: text.count("\n", 0, at) + 1
    dep = lambda n, at: f.ref(f.id(PSEUDO), f.symbol(n, "import", line(at), line(at), False), "imports", line(at))
    to = lambda p, at: f.ref(f.id(PSEUDO), f.id(PSEUDO, posixpath.normpath(posixpath.join(posixpath.dirname(f.path), p))), "imports", line(at))
    if name.endswith(".csproj"):
        for m in re.finditer(r'<(Package|Project)Reference\s+Include="([^"]+)"', text):
            dep(m[2], m.start()) if m[1] == "Package" else to(m[2].replace("\\", "/"), m.start())
    elif name == "pom.xml":
        for m in re.finditer(r"<dependency>.*?<groupId>([^<]+)</groupId>.*?<artifactId>([^<]+)</artifactId>.*?</dependency>", text, re.S):
            dep(f"{m[1].strip()}:{m[2].strip()}", m.start())
        for m in re.finditer(r"<module>([^<]+)</module>", text):
            to(f"{m[1].strip()}/pom.xml", m.start())
    elif "gradle" in name:
        for m in re.finditer(r"(?:implementation|api|compileOnly|runtimeOnly|testImplementation|kapt)\s*\(?\s*(?:project\(\s*)?['\"]([^'\"]+)['\"]", text):
            dep(m[1], m.start())
        for m in re.finditer(r"include\s*\(?\s*((?:['\"][^'\"]+['\"]\s*,?\s*)+)", text):
            for x in re.findall(r"['\"]([^'\"]+)['\"]", m[1]):
                to(x.strip(":").replace(":", "/") + "/build.gradle", m.start())
    elif name == "CMakeLists.txt":
        for m in re.finditer(r"(find_package|target_link_libraries|add_subdirectory|project)\s*\(\s*([^)]+)\)", text):
            args = [a for a in m[2].split() if a not in ("PUBLIC", "PRIVATE", "INTERFACE", "REQUIRED", "COMPONENTS")]
            if m[1] == "add_subdirectory":
                to(f"{args[0]}/CMakeLists.txt", m.start())
            elif m[1] == "project":
                f.symbol(args[0], "module", line(m.start()), line(m.start()), True)
            else:
                for a in args[m[1] == "target_link_libraries" :][: None if m[1] == "target_link_libraries" else 1]:
                    dep(a, m.start())
    elif name == "conanfile.txt":
        section = ""
        for i, x in enumerate(text.split("\n")):
            section = x.strip() if x.strip().startswith("[") else section
            if section == "[requires]" and x.strip() and not x.strip().startswith(("[", "#")):
                f.ref(f.id(PSEUDO), f.symbol(x.strip().split("/")[0], "import", i + 1, i + 1, False), "imports", i + 1)
    elif name == "vcpkg.json":
        for d in json.loads(text).get("dependencies", []):
            f.ref(f.id(PSEUDO), f.symbol(d if isinstance(d, str) else d["name"], "import", 1, 1, False), "imports", 1)


def extract(path: str, text: str, language: str, known: Known, base: int, aliases: Aliases = ()) -> list[dict]:
    """All rows of a file; an error becomes a row of its own."""
    f = File(path, base, aliases)
    try:
        if language == "python":
            python(f, text, known)
        elif language == "build":
            build_file(f, text, known)
        elif language in RULES:
            braced(f, text, known, language)
        return f.done()
    except (SyntaxError, ValueError, KeyError, RecursionError) as e:
        return [{**dict.fromkeys(COLUMNS), "rec": "error", "seq": base, "file_path": path, "error": f"{type(e).__name__}: {e}"[:500]}]


def frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS)
    for c in ("start_line", "end_line", "line"):
        out[c] = out[c].astype("Int32")
    return out
