"""Symbols and relations of source files, by language."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.runtime import distinct_texts, hot_keys, spread_join

SYMBOL = "text_key string, language string, name string, qualified_name string, kind string, line_start int, line_end int"
EDGE = "text_key string, language string, source_name string, relation string, target_name string, line int, confidence double"

_JS = re.compile(
    r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:(?:abstract\s+)?class\s+(?P<class>[\w$]+)(?:\s+extends\s+(?P<extends>[\w$.]+))?|interface\s+(?P<interface>[\w$]+)|enum\s+(?P<enum>[\w$]+)|type\s+(?P<type>[\w$]+)\s*=|(?:async\s+)?function\s*\*?\s*(?P<function>[\w$]+)|(?:const|let|var)\s+(?P<const>[\w$]+)\s*(?::[^=]+)?=\s*(?P<arrow>(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>)?)",
    re.M,
)
_JS_IMPORT = re.compile(r"^[ \t]*import\s+(?:[\w$*{}\s,]+\s+from\s+)?['\"]([^'\"]+)['\"]|require\(['\"]([^'\"]+)['\"]\)", re.M)
_CALL = re.compile(r"(?<![\w$.])((?:[\w$]+\.)*[\w$]+)\s*\(")
_JS_WORDS = frozenset("if for while switch catch function return typeof new await super import constructor".split())
_JAVA = re.compile(r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(?:(?P<kind>class|interface|enum|record)\s+(?P<type>\w+)(?:\s+extends\s+(?P<extends>[\w.]+))?(?:\s+implements\s+(?P<implements>[\w., ]+))?|(?:[\w.<>\[\]]+\s+)(?P<method>\w+)\s*\((?P<args>[^)]*)\)\s*(?:throws [\w., ]+)?\{)", re.M)
_JAVA_IMPORT = re.compile(r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", re.M)
_JAVA_PACKAGE = re.compile(r"^\s*package\s+([\w.]+)\s*;", re.M)
_SQL = re.compile(r"\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?(?P<kind>TABLE|VIEW|FUNCTION|INDEX)\s+(?:IF\s+NOT\s+EXISTS\s+)?(?P<name>[\w.\"]+)", re.I)
_SQL_USES = (
    ("alters_table", 0.94, re.compile(r"\bALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?([\w.\"]+)", re.I)),
    ("writes_table", 0.85, re.compile(r"\b(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM|MERGE\s+INTO)\s+([\w.\"]+)", re.I)),
    ("reads_table", 0.72, re.compile(r"\b(?:FROM|JOIN)\s+([A-Za-z_][\w.\"]*)", re.I)),
    ("references", 0.9, re.compile(r"\bREFERENCES\s+([\w.\"]+)", re.I)),
)
_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*$", re.M)
_LINK = re.compile(r"\[[^\]]*\]\(([^)\s#]+)")
_SHELL = re.compile(r"^\s*(?:function\s+)?([A-Za-z_]\w*)\s*\(\)\s*\{?", re.M)
_SOURCED = re.compile(r"^\s*(?:source|\.)\s+([^\s;]+)", re.M)
_SELECTOR = re.compile(r"([.#][A-Za-z_][\w-]*)[^{}]*\{")
_YAML_KEY = re.compile(r"^(\s*)(?:-\s+)?([A-Za-z_][\w.-]*)\s*:", re.M)
_TOML_TABLE = re.compile(r"^\s*\[+([^\]]+)\]+\s*$|^\s*([A-Za-z_][\w.-]*)\s*=", re.M)


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def python_symbols(text: str) -> tuple[list, list]:
    """Definitions, imports (1.0), bases (0.85), calls (0.72 plain, 0.62 dotted), exports."""
    symbols, edges = [], []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [], []

    def dotted(node: ast.AST) -> str | None:
        parts = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        return ".".join([node.id, *parts[::-1]]) if isinstance(node, ast.Name) else None

    todo = [(child, "", "module") for child in ast.iter_child_nodes(tree)]
    while todo:
        node, scope, inside = todo.pop()
        here, kind_here = scope, inside
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            here = f"{scope}.{node.name}".lstrip(".")
            kind_here = "class" if isinstance(node, ast.ClassDef) else "function"
            kind = "class" if kind_here == "class" else "method" if inside == "class" else "function"
            symbols.append((node.name, here, kind, node.lineno, node.end_lineno or node.lineno))
            if scope:
                edges.append((scope, "contains", here, node.lineno, 1.0))
            for base in getattr(node, "bases", []):
                if name := dotted(base):
                    edges.append((here, "extends", name, node.lineno, 0.85))
        elif isinstance(node, ast.Import):
            edges += [(scope, "imports", a.name, node.lineno, 1.0) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            edges.append((scope, "imports", "." * node.level + (node.module or ""), node.lineno, 1.0))
        elif isinstance(node, ast.Call):
            if name := dotted(node.func):
                edges.append((scope, "calls", name, node.lineno, 0.62 if "." in name else 0.72))
        elif isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets) and isinstance(node.value, (ast.List, ast.Tuple)):
            edges += [(scope, "exports", e.value, node.lineno, 1.0) for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
        todo += [(child, here, kind_here) for child in ast.iter_child_nodes(node)]
    return symbols, edges


def masked(text: str) -> str:
    """The text with comments and string contents blanked, lines and length kept."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    return re.sub(r"/\*.*?\*/|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", blank, text, flags=re.S)


def script_symbols(text: str) -> tuple[list, list]:
    """Pattern extraction over masked text: types, functions, imports (0.95), extends (0.84), calls (0.65, 0.55)."""
    plain, symbols, edges = masked(text), [], []
    for m in _JS.finditer(plain):
        kind = next((k for k in ("class", "interface", "enum", "type", "function", "const") if m[k]), None)
        if kind is None:
            continue
        line = _line(text, m.start(kind))
        shown = "function" if kind == "const" and m["arrow"] else kind
        symbols.append((m[kind], m[kind], shown, line, line))
        if m["extends"]:
            edges.append((m[kind], "extends", m["extends"], line, 0.84))
    for m in _JS_IMPORT.finditer(text):
        edges.append(("", "imports", m[1] or m[2], _line(text, m.start()), 0.95))
    for m in _CALL.finditer(plain):
        if m[1] not in _JS_WORDS:
            edges.append(("", "calls", m[1], _line(text, m.start()), 0.65 if "." in m[1] else 0.55))
    return symbols, edges


def java_symbols(text: str) -> tuple[list, list]:
    plain, symbols, edges = masked(text), [], []
    package = _JAVA_PACKAGE.search(plain)
    prefix, owner = (package[1] + "." if package else ""), ""
    for m in _JAVA.finditer(plain):
        if m["type"]:
            owner = prefix + m["type"]
            line = _line(text, m.start("type"))
            symbols.append((m["type"], owner, m["kind"], line, line))
            if m["extends"]:
                edges.append((owner, "extends", m["extends"], line, 0.85))
            edges += [(owner, "implements", x.strip(), line, 0.84) for x in (m["implements"] or "").split(",") if x.strip()]
        elif m["method"] not in ("if", "for", "while", "switch", "catch", "synchronized"):
            kinds = ",".join(a.split()[0] for a in m["args"].split(",") if a.split())
            line = _line(text, m.start("method"))
            symbols.append((m["method"], f"{owner}.{m['method']}({kinds})", "method", line, line))
            edges.append((owner, "contains", f"{owner}.{m['method']}({kinds})", line, 0.9))
    edges += [("", "imports", m[1], _line(text, m.start()), 1.0) for m in _JAVA_IMPORT.finditer(plain)]
    return symbols, edges


def sql_symbols(text: str) -> tuple[list, list]:
    plain = re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    symbols, edges = [], []
    for m in _SQL.finditer(plain):
        line = _line(text, m.start())
        symbols.append((m["name"].strip('"'), m["name"].strip('"'), m["kind"].lower(), line, line))
        if m["kind"].upper() == "TABLE":
            edges.append(("", "declares_table", m["name"].strip('"'), line, 0.96))
    for relation, confidence, pattern in _SQL_USES:
        edges += [("", relation, m[1].strip('"'), _line(text, m.start()), confidence) for m in pattern.finditer(plain)]
    return symbols, edges


def structure_symbols(text: str, language: str) -> tuple[list, list]:
    """Headings and links, keys, functions and sourced files, selectors."""
    symbols, edges = [], []
    if language == "markdown":
        symbols = [(m[2], m[2], "heading", _line(text, m.start()), _line(text, m.start())) for m in _HEADING.finditer(text)]
        edges = [("", "references", m[1], _line(text, m.start()), 0.95) for m in _LINK.finditer(text)]
    elif language == "shell":
        symbols = [(m[1], m[1], "function", _line(text, m.start(1)), _line(text, m.start(1))) for m in _SHELL.finditer(text)]
        edges = [("", "imports", m[1], _line(text, m.start(1)), 0.95) for m in _SOURCED.finditer(text)]
    elif language == "css":
        symbols = [(m[1], m[1], "selector", _line(text, m.start()), _line(text, m.start())) for m in _SELECTOR.finditer(text)]
    elif language == "yaml":
        stack: list[tuple[int, str]] = []
        for m in _YAML_KEY.finditer(text):
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            stack.append((len(m[1]), m[2]))
            line = _line(text, m.start(2))
            symbols.append((m[2], ".".join(k for _, k in stack), "config_key", line, line))
    elif language == "toml":
        table = ""
        for m in _TOML_TABLE.finditer(text):
            line = _line(text, m.start())
            if m[1]:
                table = m[1].strip()
                symbols.append((table.rsplit(".", 1)[-1], table, "config_key", line, line))
            else:
                symbols.append((m[2], f"{table}.{m[2]}".lstrip("."), "config_key", line, line))
    return symbols, edges


def extract(text: str, language: str) -> tuple[list, list]:
    if language == "python":
        return python_symbols(text)
    if language in ("javascript", "typescript"):
        return script_symbols(text)
    if language == "java":
        return java_symbols(text)
    if language == "sql":
        return sql_symbols(text)
    return structure_symbols(text, language)


def _run(which: int, columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, language, text in zip(batch["text_key"], batch["language"], batch["text"]):
                rows += [(key, language, *x) for x in dict.fromkeys(extract(text, language)[which])]
            yield pd.DataFrame(rows, columns=columns)

    return run


def _joined(files: DataFrame, which: int, schema: str) -> DataFrame:
    """What each file's text holds; each distinct text is read once, so unchanged files are not extracted again."""
    columns = [c.split()[0] for c in schema.split(", ")]
    salt = ("generation_id", "path")
    rows = files.where("language IS NOT NULL AND text IS NOT NULL").select("generation_id", "path", "language", "text", F.sha2("text", 256).alias("text_key"))
    hot = hot_keys(rows, "text_key")
    found = distinct_texts(rows, "text", "language", salt=salt, hot=hot).mapInPandas(_run(which, columns), schema)
    return spread_join(rows.drop("text").distinct(), found.distinct() if hot else found, ["text_key", "language"], "inner", hot, salt)


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of every file."""
    rows = _joined(files, 0, SYMBOL)
    identity = F.concat_ws("\x00", F.col("generation_id").cast("string"), "path", "qualified_name", "kind", F.col("line_start").cast("string"))
    return rows.select("generation_id", "path", "language", "name", "qualified_name", "kind", "line_start", "line_end", F.concat(F.lit("symbol_"), F.sha2(identity, 256)).alias("id"))


def edges(files: DataFrame) -> DataFrame:
    return _joined(files, 1, EDGE).select("generation_id", F.col("path").alias("source_path"), "source_name", "relation", "target_name", "line", "confidence")
