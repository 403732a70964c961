"""Path globs and languages as predicates."""

from __future__ import annotations

import fnmatch
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions of each language.
EXTENSIONS = {
    "bash": [".sh", ".bash", ".zsh"],
    "c": [".c", ".h"],
    "clojure": [".clj", ".cljs", ".cljc"],
    "cpp": [".cpp", ".cc", ".cxx", ".hpp", ".hxx", ".h"],
    "csharp": [".cs", ".csx"],
    "css": [".css", ".scss", ".sass", ".less"],
    "dart": [".dart"],
    "elixir": [".ex", ".exs"],
    "erlang": [".erl", ".hrl"],
    "go": [".go"],
    "haskell": [".hs", ".lhs"],
    "html": [".html", ".htm"],
    "java": [".java"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs"],
    "json": [".json", ".jsonc"],
    "kotlin": [".kt", ".kts"],
    "lua": [".lua"],
    "markdown": [".md", ".markdown", ".mdown"],
    "objectivec": [".m", ".mm", ".h"],
    "perl": [".pl", ".pm"],
    "php": [".php", ".phtml"],
    "powershell": [".ps1", ".psm1"],
    "python": [".py", ".pyi", ".pyw"],
    "r": [".r", ".R"],
    "ruby": [".rb", ".rake"],
    "rust": [".rs"],
    "scala": [".scala", ".sc"],
    "sql": [".sql", ".ddl", ".dml"],
    "svelte": [".svelte"],
    "swift": [".swift"],
    "toml": [".toml"],
    "typescript": [".ts", ".tsx", ".mts", ".cts"],
    "vue": [".vue"],
    "xml": [".xml", ".xsd", ".xsl"],
    "yaml": [".yaml", ".yml"],
}


def is_complex(glob: str) -> bool:
    """Character sets, alternatives and a ``**`` that is neither first nor last need a regular expression."""
    return any(c in glob for c in "[{") or "**" in glob[2:-2]


def like_pattern(glob: str) -> str:
    """A simple glob as a LIKE pattern with backslash escapes; stars cross slashes."""
    glob = glob.removeprefix("**/") if glob.startswith("**/*") else glob
    out = "".join("\\" + c if c in "\\%_" else c for c in glob)
    return out.replace("**", "*").replace("*", "%").replace("?", "_")


def matches(path: Column, glob: str) -> Column:
    """Simple globs as LIKE (prefixes and suffixes stay cheap), complex ones as a regular expression."""
    if not is_complex(glob):
        return path.like(like_pattern(glob))
    options = [glob]
    while any("{" in g and "}" in g for g in options):
        options = [g[: g.index("{")] + o + g[g.index("}") + 1 :] for g in options for o in g[g.index("{") + 1 : g.index("}")].split(",")]
    return reduce(lambda a, b: a | b, [path.rlike("^" + fnmatch.translate(g).removesuffix("\\z").removesuffix("\\Z") + "$") for g in options])


def selected(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Any of the included, none of the excluded."""
    keep = reduce(lambda a, b: a | b, [matches(path, g) for g in include]) if include else F.lit(True)
    return keep & ~reduce(lambda a, b: a | b, [matches(path, g) for g in exclude]) if exclude else keep


def of_language(path: Column, languages: list[str]) -> Column:
    """By extension, in any case; no languages select all, only unknown ones select nothing."""
    if not languages:
        return F.lit(True)
    ends = sorted({e.lower() for name in languages for e in EXTENSIONS.get(name.lower(), ())})
    return reduce(lambda a, b: a | b, [F.lower(path).endswith(e) for e in ends]) if ends else F.lit(False)


def owner_of(path: Column, rules: list[tuple[str, str]]) -> Column:
    """The owner of the first rule (glob, owner) that matches."""
    out = F.lit(None).cast("string")
    for glob, owner in reversed(rules):
        out = F.when(matches(path, glob.lstrip("/")) | matches(path, f"{glob.strip('/')}/*"), owner).otherwise(out)
    return out
