"""Path aliases of TypeScript projects: what an import that is no relative path may mean."""

from __future__ import annotations

import json
import posixpath
import re
from pathlib import Path

#: (pattern, target): both with at most one *, the target from the project's root.
Aliases = tuple[tuple[str, str], ...]
_PARTS = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.S)


def plain_json(text: str) -> str:
    """JSON with comments and commas before closing brackets as plain JSON; strings stay as they are."""
    bare = _PARTS.sub(lambda m: m[0] if m[0].startswith('"') else " ", text)
    out, at = [], 0
    for m in re.finditer(r'"(?:\\.|[^"\\])*"', bare):
        out += [re.sub(r",(\s*[\]}])", r"\1", bare[at : m.start()]), m[0]]
        at = m.end()
    # a comma and the bracket behind it never have a string between them
    return "".join([*out, re.sub(r",(\s*[\]}])", r"\1", bare[at:])])


def path_aliases(root: str) -> Aliases:
    """The aliases of the nearest tsconfig.json at or above the root; none if it is missing or unreadable."""
    top = Path(root).resolve()
    for folder in (top, *top.parents):
        if (folder / "tsconfig.json").is_file():
            try:
                options = json.loads(plain_json((folder / "tsconfig.json").read_text(errors="replace"))).get("compilerOptions") or {}
                base = (folder / options["baseUrl"]).resolve() if options.get("baseUrl") else top
                at = posixpath.relpath(base.as_posix(), top.as_posix())
                return tuple((pattern, posixpath.normpath(posixpath.join(at, targets[0]))) for pattern, targets in (options.get("paths") or {}).items() if targets)
            except (ValueError, AttributeError, TypeError):
                return ()
    return ()


def expanded(spec: str, aliases: Aliases) -> str | None:
    """The path from the root that the first fitting alias gives, else None."""
    for pattern, target in aliases:
        head, star, tail = pattern.partition("*")
        if not star:
            if spec == pattern:
                return target
        elif spec.startswith(head) and spec.endswith(tail) and len(spec) >= len(head) + len(tail):
            return posixpath.normpath(target.replace("*", spec[len(head) : len(spec) - len(tail)]))
    return None
