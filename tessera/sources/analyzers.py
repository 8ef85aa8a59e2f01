"""Symbols and relationships of source files.

Python is parsed by its own grammar; the other languages by patterns for their
declarations, which find the usual forms and no others. Files run one by one in Arrow
batches.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Declarations: kind by pattern, in each language; group 1 is the name.
PATTERNS = {
    "rust": {"function": r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)", "class": r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum)\s+(\w+)", "interface": r"^[ \t]*(?:pub\s+)?trait\s+(\w+)", "module": r"^[ \t]*(?:pub\s+)?mod\s+(\w+)"},
    "javascript": {"function": r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+(\w+)", "class": r"^[ \t]*(?:export\s+)?(?:default\s+)?class\s+(\w+)"},
    "typescript": {"function": r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+(\w+)", "class": r"^[ \t]*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)", "interface": r"^[ \t]*(?:export\s+)?interface\s+(\w+)"},
    "csharp": {"function": r"^[ \t]*(?:(?:public|private|protected|internal|static|async|override|virtual)\s+)+[\w<>\[\],]+\s+(\w+)\s*\(", "class": r"^[ \t]*(?:(?:public|internal|abstract|sealed|static|partial)\s+)*(?:class|struct|record)\s+(\w+)", "interface": r"^[ \t]*(?:(?:public|internal)\s+)*interface\s+(\w+)", "module": r"^[ \t]*namespace\s+([\w.]+)"},
    "go": {"function": r"^func\s+(?:\([^)]*\)\s*)?(\w+)", "class": r"^type\s+(\w+)\s+struct", "interface": r"^type\s+(\w+)\s+interface", "module": r"^package\s+(\w+)"},
}
IMPORTS = {
    "rust": r"^[ \t]*(?:pub\s+)?use\s+([\w:]+)", "javascript": r"""(?:import[^'"\n]*|require\()\s*['"]([^'"]+)""", "typescript": r"""(?:import[^'"\n]*|require\()\s*['"]([^'"]+)""",
    "csharp": r"^[ \t]*using\s+([\w.]+)\s*;", "go": r"""^[ \t]*(?:import\s+)?(?:\w+\s+)?"([^"]+)"$""",
}
BASES = {"javascript": r"class\s+(\w+)\s+extends\s+([\w.]+)", "typescript": r"(?:class|interface)\s+(\w+)[^{]*?\b(?:extends|implements)\s+([\w., ]+)", "csharp": r"(?:class|struct|record|interface)\s+(\w+)[^{:]*:\s*([\w., <>]+)", "rust": r"impl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\s+(\w+)", "go": r"$^"}
#: What makes a symbol a test: by its name, and by what stands right before it.
TESTS = {"rust": (r"$^", r"#\[(?:\w+::)?test\]\s*$"), "go": (r"^Test[A-Z]", r"$^"), "csharp": (r"$^", r"\[(?:Fact|Theory|Test|TestMethod)[^\]]*\]\s*$"), "python": (r"^test_", r"$^"), "javascript": (r"$^", r"$^"), "typescript": (r"$^", r"$^")}
KEYWORDS = {"if", "for", "while", "switch", "return", "catch", "match", "fn", "function", "func", "new", "sizeof", "using", "lock", "super", "await", "typeof", "def", "class", "not", "and", "or", "in", "print"}
CONFIDENCE = {"imports": 1.0, "depends_on": 1.0, "calls": 0.9, "tests": 0.9, "implements": 1.0, "extends": 1.0, "uses_type": 1.0, "contains": 1.0}

SYMBOL = "path string, stable_key string, name string, qualified_name string, kind string, parent_key string, start long, end long, start_line long, end_line long, is_test boolean"
FACT = "path string, source_key string, edge_type string, target_kind string, target string, confidence double"


def python_symbols(path: str, text: str) -> tuple[list[tuple], list[tuple]]:
    tree = ast.parse(text)
    lines = [0]
    for line in text.splitlines(keepends=True):
        lines.append(lines[-1] + len(line.encode()))
    symbols: list[tuple] = []
    facts: list[tuple] = []

    def fact(key: str, edge: str, kind: str, target: str) -> None:
        facts.append((path, key, edge, kind, target, CONFIDENCE[edge]))

    def walk(node: ast.AST, parents: list[str], key: str, in_class: bool) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.Import):
                for a in n.names:
                    fact(key, "imports", "module", a.name)
                    fact(key, "depends_on", "module", a.name)
            elif isinstance(n, ast.ImportFrom):
                name = "." * n.level + (n.module or "")
                fact(key, "imports", "module", name)
                fact(key, "depends_on", "module", name)
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(n, ast.ClassDef) else "method" if in_class else "function"
                qualified = ".".join([*parents, n.name])
                own = f"python:{qualified}"
                first = min([n.lineno, *(x.lineno for x in n.decorator_list)])
                test = re.match(TESTS["python"][0], n.name) is not None
                symbols.append((path, own, n.name, qualified, kind, key, lines[first - 1], lines[n.end_lineno - 1] + len((text.splitlines()[n.end_lineno - 1]).encode()), first, n.end_lineno, test))
                fact(key, "contains", "local", own)
                for b in getattr(n, "bases", []):
                    fact(own, "extends", "qualified", ast.unparse(b))
                walk(n, [*parents, n.name], own, kind == "class")
                continue
            if isinstance(n, ast.Call):
                target = ast.unparse(n.func)
                if re.fullmatch(r"[\w.]+", target):
                    fact(key, "calls", "qualified", target)
                    if re.search(r"(?:^|[.:])test_\w+$", key):
                        fact(key, "tests", "qualified", target)
            walk(n, parents, key, in_class)

    walk(tree, [], f"file:{path}", False)
    return symbols, facts


def pattern_symbols(path: str, text: str, language: str) -> tuple[list[tuple], list[tuple]]:
    found = []
    for kind, p in PATTERNS[language].items():
        found += [(m.start(), m.end(), kind, m[1]) for m in re.finditer(p, text, re.M)]
    found.sort()
    ends = [*[f[0] for f in found[1:]], len(text)]
    symbols, facts, container = [], [], None
    at = lambda i: len(text[:i].encode())
    file_key = f"file:{path}"
    for (start, _, kind, name), end in zip(found, ends, strict=True):
        indented = text[start:].lstrip("\n")[:1] in " \t"
        if kind in ("class", "interface"):
            container = name
        parent = container if kind == "function" and indented and container else None
        qualified = f"{parent}.{name}" if parent else name
        key = f"{language}:{qualified}"
        by_name, before = TESTS[language]
        test = kind == "function" and (re.search(by_name, name) is not None or re.search(before, text[:start].rstrip() + "\n") is not None or re.search(before, text[max(0, start - 200) : start]) is not None)
        symbols.append((path, key, name, qualified, "method" if parent else kind, f"{language}:{parent}" if parent else file_key, at(start), at(end), 1 + text.count("\n", 0, start), 1 + text.count("\n", 0, end), test))
        facts.append((path, f"{language}:{parent}" if parent else file_key, "contains", "local", key, CONFIDENCE["contains"]))
        if kind == "function":
            body = text[start:end]
            for m in re.finditer(r"\b([A-Za-z_][\w.:]*)\s*\(", body[body.find("(") + 1 :]):
                if m[1] not in KEYWORDS:
                    facts.append((path, key, "calls", "qualified", m[1], CONFIDENCE["calls"]))
                    if test:
                        facts.append((path, key, "tests", "qualified", m[1], CONFIDENCE["tests"]))
    for m in re.finditer(IMPORTS[language], text, re.M):
        for edge in ("imports", "depends_on"):
            facts.append((path, file_key, edge, "module", m[1], CONFIDENCE[edge]))
    for m in re.finditer(BASES[language], text):
        child, bases = (m[2], m[1]) if language == "rust" else (m[1], m[2])
        for b in bases.split(","):
            facts.append((path, f"{language}:{child}", "implements", "qualified", b.strip(), 0.9 if language == "csharp" else CONFIDENCE["implements"]))
    for m in re.finditer(r"""\b(?:test|it)\(\s*['"]([^'"]+)""", text) if language in ("javascript", "typescript") else ():
        symbols.append((path, f"{language}:test:{m[1]}", m[1], m[1], "test", file_key, at(m.start()), at(m.end()), 1 + text.count("\n", 0, m.start()), 1 + text.count("\n", 0, m.end()), True))
    return symbols, facts


def analyzed(path: str, text: str, language: str) -> tuple[list[tuple], list[tuple]]:
    """(symbols, facts) of a file; one whole-file symbol where there is no other."""
    symbols: list[tuple] = []
    facts: list[tuple] = []
    if language == "python":
        try:
            symbols, facts = python_symbols(path, text)
        except (SyntaxError, ValueError, RecursionError):
            symbols, facts = [], []
    elif language in PATTERNS:
        symbols, facts = pattern_symbols(path, text, language)
    if not symbols:
        symbols = [(path, f"file:{path}", path.rsplit("/", 1)[-1], None, "file", None, 0, len(text.encode()), 1, 1 + text.count("\n"), False)]
    return symbols, facts


def _run(files: DataFrame, part: int, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, t, lang in zip(pdf["path"], pdf["content"], pdf["language"], strict=True) for r in analyzed(p, t or "", lang)[part]]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content", "language").mapInPandas(run, schema)


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of files (path, content, language)."""
    return _run(files, 0, SYMBOL)


def facts(files: DataFrame) -> DataFrame:
    """Relationships that files state, before any name is resolved."""
    return _run(files, 1, FACT)


#: How a module's path may end, by language; likeliest first.
ENDS = {"python": (".py", "/__init__.py"), "javascript": (".js", ".jsx", ".mjs", "/index.js"), "typescript": (".ts", ".tsx", "/index.ts", ".d.ts"), "rust": (".rs", "/mod.rs"), "csharp": (".cs",), "go": (".go",)}


def module_paths(target: Column, language: Column, source_path: Column) -> Column:
    """Paths that an import may mean, relative to the workspace, likeliest first."""
    folder = F.filter(F.split(F.regexp_extract(source_path, "^(.*)/[^/]*$", 1), "/"), lambda p: p != "")
    bare = F.ltrim(target, F.lit("."))
    dots = F.length(target) - F.length(bare)
    above = F.slice(folder, F.lit(1), F.greatest(F.size(folder) - dots + 1, F.lit(0)))
    path = lambda parts: F.array_join(F.filter(parts, lambda p: p != ""), "/")
    python = path(F.concat(F.when(dots > 0, above).otherwise(F.array().cast("array<string>")), F.split(bare, r"\.")))
    rust = F.concat(F.lit("src/"), path(F.filter(F.split(target, "::"), lambda p: ~p.isin("crate", "self", "super"))))
    walked = F.aggregate(F.split(target, "/"), folder, lambda at, p: F.when(p == "..", F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0)))).when(p.isin(".", ""), at).otherwise(F.array_append(at, p)))
    base = F.when(language == "python", python).when(language == "rust", rust).when(F.startswith(target, F.lit(".")), path(walked)).otherwise(target)
    ends = F.array(F.lit(""))
    for name, values in ENDS.items():
        ends = F.when(language == name, F.array(*map(F.lit, values))).otherwise(ends)
    return F.transform(ends, lambda e: F.concat(base, e))


def module_candidates(target: str, language: str, source_path: str) -> list[str]:
    """Paths that an import may mean, relative to the workspace, likeliest first."""
    folder = source_path.rsplit("/", 1)[0] if "/" in source_path else ""
    ends = ENDS.get(language, ("",))
    if language == "python":
        dots = len(target) - len(target.lstrip("."))
        base = target.lstrip(".").replace(".", "/")
        if dots:
            parts = folder.split("/") if folder else []
            base = "/".join([*parts[: len(parts) - dots + 1], base]).strip("/")
    elif language == "rust":
        base = "src/" + "/".join(p for p in target.split("::") if p not in ("crate", "self", "super"))
    elif target.startswith("."):
        parts = folder.split("/") if folder else []
        for p in target.split("/"):
            parts = parts[:-1] if p == ".." else parts if p in (".", "") else [*parts, p]
        base = "/".join(parts)
    else:
        base = target
    return [base + e for e in ends]
