"""Symbols of source texts: a table function over (language, path, text)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "project_id string, name string, kind string, language string, file_path string, line int, signature string, doc_comment string, body_lines int, parent string, referenced_locally boolean"
_ID = r"([A-Za-z_$][\w$]*)"
_JS = r"(?:(?:export|default|async|declare|abstract|public|private|protected|static|readonly)\s+)*"
_JAVA = r"(?:(?:public|private|protected|static|final|abstract|synchronized|override|virtual|sealed|internal|open|data|async|partial|inline|suspend)\s+)*"
_RUST = r"(?:(?:pub(?:\([^)]*\))?|unsafe|async|default|extern)\s+)*"
_ROUTE = r"(?:app|router|server|this)\.(get|post|put|patch|delete|options|head)\(\s*[^\"']*([\"'])(.*?)\2"
_C_LIKE = [(rf"(?:typedef\s+)?struct\s+{_ID}", "struct"), (rf"class\s+{_ID}", "class"), (rf"enum\s+(?:class\s+)?{_ID}", "enum"), (rf"#define\s+{_ID}", "constant"), (rf"(?!return\b|if\b|for\b|while\b|switch\b|else\b)[A-Za-z_][\w\s\*&:<>,]*?[\s\*&]{_ID}\s*\([^;]*\)\s*(?:const\s*)?\{{?$", "function")]
_JAVA_LIKE = [
    (rf"{_JAVA}(?:class|record|object)\s+{_ID}", "class"), (rf"{_JAVA}interface\s+{_ID}", "interface"), (rf"{_JAVA}enum\s+(?:class\s+)?{_ID}", "enum"), (rf"{_JAVA}struct\s+{_ID}", "struct"), (rf"{_JAVA}fun\s+(?:<[^>]*>\s*)?{_ID}", "function"),
    (rf"{_JAVA}(?!return\b|new\b|if\b|for\b|while\b|switch\b|throw\b|else\b)[\w<>\[\],.?]+\s+{_ID}\s*\([^;]*\)[^;=]*[{{;)]$", "method"),
]
_JS_LIKE = [
    (rf"{_JS}class\s+{_ID}", "class"), (rf"{_JS}interface\s+{_ID}", "interface"), (rf"{_JS}enum\s+{_ID}", "enum"), (rf"{_JS}type\s+{_ID}\s*[=<]", "type"),
    (rf"{_JS}function\s*\*?\s*{_ID}", "function"), (rf"{_JS}(?:const|let|var)\s+{_ID}\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>", "function"),
    (rf"{_JS}(?:const|let|var)\s+{_ID}\s*(?::[^=]+)?=\s*(?:async\s+)?function", "function"), (rf"{_JS}const\s+([A-Z][A-Z0-9_]{{2,}})\s*(?::[^=]+)?=", "constant"),
    (rf"(?!if\b|for\b|while\b|switch\b|return\b|catch\b|function\b){_JS}{_ID}\s*\([^)]*\)\s*(?::[^{{]+)?\{{$", "method"),
]
#: The declarations of each language: pattern over the trimmed line, kind; the first fits.
GRAMMAR: dict[str, list[tuple[str, str]]] = {
    "Python": [(rf"(?:async\s+)?def\s+{_ID}", "function"), (rf"class\s+{_ID}", "class"), (r"([A-Z][A-Z0-9_]{2,})\s*=(?!=)", "constant")],
    "Rust": [
        (rf"{_RUST}(?:struct|union)\s+{_ID}", "struct"), (rf"{_RUST}enum\s+{_ID}", "enum"), (rf"{_RUST}trait\s+{_ID}", "trait"), (rf"{_RUST}fn\s+{_ID}", "function"),
        (rf"{_RUST}type\s+{_ID}", "type"), (rf"impl\s+(?:[^<{{]*\sfor\s+)?{_ID}", "type"), (rf"{_RUST}const\s+{_ID}", "constant"),
    ],
    "Go": [(rf"func\s+\([^)]*\)\s*{_ID}", "method"), (rf"func\s+{_ID}", "function"), (rf"type\s+{_ID}\s.*\binterface\b", "interface"), (rf"type\s+{_ID}\s.*\bstruct\b", "struct"), (rf"type\s+{_ID}", "type")],
    "JavaScript": _JS_LIKE, "TypeScript": _JS_LIKE, "Vue": _JS_LIKE, "Java": _JAVA_LIKE, "Kotlin": _JAVA_LIKE, "C#": _JAVA_LIKE, "C": _C_LIKE, "C++": _C_LIKE,
    "Ruby": [(r"def\s+(?:self\.)?([A-Za-z_]\w*[?!]?)", "function"), (rf"class\s+{_ID}", "class"), (rf"module\s+{_ID}", "class")],
    "PHP": [(rf"{_JAVA}function\s+&?{_ID}", "function"), (rf"{_JAVA}class\s+{_ID}", "class"), (rf"interface\s+{_ID}", "interface"), (rf"trait\s+{_ID}", "trait")],
    "Swift": [(rf"{_JAVA}func\s+{_ID}", "function"), (rf"{_JAVA}class\s+{_ID}", "class"), (rf"{_JAVA}struct\s+{_ID}", "struct"), (rf"{_JAVA}enum\s+{_ID}", "enum"), (rf"{_JAVA}protocol\s+{_ID}", "interface")],
}
_COMPILED = {lang: [(re.compile(p), kind) for p, kind in rules] for lang, rules in GRAMMAR.items()}
_ROUTES = re.compile(_ROUTE)
_MAPPING = re.compile(r"@(Get|Post|Put|Patch|Delete)Mapping\b(?:[^\"']*([\"'])(.*?)\2)?")
_DOC = {
    "Python": re.compile(r"#\s*(\S.*)?$"), "Ruby": re.compile(r"#\s*(.*)$"), "Rust": re.compile(r"//[/!]\s*(.*)$"), "Swift": re.compile(r"//[/!]\s*(.*)$"),
}
_DOC_C = re.compile(r"(?:/\*[*!]+|\*(?!/)|//+)\s*(.*?)\s*(?:\*+/)?$")
_OWNERS = {"class", "struct", "interface", "trait"}
_WORD = re.compile(r"[A-Za-z0-9_$]+")
MOST_SIGNATURE, MOST_HEAD, MOST_DOC = 160, 30, 60


def declaration(language: str, line: str) -> tuple[str, str] | None:
    """(name, kind) if the trimmed line declares something."""
    if language in ("JavaScript", "TypeScript", "Vue") and (m := _ROUTES.match(line)):
        return f"{m[1].upper()} {m[3]}", "api_endpoint"
    if language in ("Java", "Kotlin") and line.startswith("@"):
        m = _MAPPING.match(line)
        return (f"{m[1].upper()} {m[3] or '/'}", "api_endpoint") if m else None
    for pattern, kind in _COMPILED.get(language, ()):
        if m := pattern.match(line):
            name = m[1]
            if kind == "function" and language in ("JavaScript", "TypeScript", "Vue") and name[0].isupper() and not name.isupper():
                kind = "component"
            return name, kind
    return None


def doc_of(language: str, line: str) -> str | None:
    m = _DOC.get(language, _DOC_C).match(line)
    text = m[1] if m else None
    return None if not m or (language == "Python" and not text) else (text or "").strip()


def _docstring(lines: list[str], at: int) -> str | None:
    """The string that opens a Python body; the declaration may span lines."""
    end = next((i for i in range(at, min(at + MOST_HEAD, len(lines))) if lines[i].rstrip().endswith(":")), None)
    if end is None:
        return None
    first = next((i for i in range(end + 1, len(lines)) if lines[i].strip()), None)
    if first is None or not (m := re.match(r"\s*[rRuUbB]?(\"\"\"|''')", lines[first])):
        return None
    out = []
    for i in range(first, min(first + MOST_DOC, len(lines))):
        text = lines[i][m.end() :] if i == first else lines[i]
        if m[1] in text:
            return " ".join([*out, text.split(m[1])[0].strip()]).strip()
        out.append(text.strip())
    return None


class Bodies:
    """How many lines each declaration's body has: it ends before the first line that is not
    deeper; blank lines and comments do not end a body. One pass: the declarations that are
    open stand on a stack, by depth."""

    def __init__(self):
        self.open: list[tuple[int, int]] = []
        self.length: dict[int, int] = {}

    def line(self, at: int, indent: int, text: str) -> None:
        if text and not text.startswith(("//", "#")):
            while self.open and self.open[-1][0] >= indent:
                start = self.open.pop()[1]
                self.length[start] = at - start

    def begin(self, at: int, indent: int) -> None:
        self.open.append((indent, at))

    def end(self, lines: int) -> dict[int, int]:
        return self.length | {start: lines - start for _, start in self.open}


def extract(language: str, path: str, text: str) -> Iterator[tuple]:
    """Rows of SCHEMA without project_id. An unknown language has no symbols."""
    if language not in GRAMMAR:
        return
    lines = text.splitlines()
    uses: dict[str, int] = {}
    for word in _WORD.findall(text):
        uses[word] = uses.get(word, 0) + 1
    docs: list[str] = []
    parent: str | None = None
    bodies, rows = Bodies(), []
    for i, raw in enumerate(lines):
        line = raw.strip()
        bodies.line(i, len(raw) - len(raw.lstrip()), line)
        if (doc := doc_of(language, line)) is not None:
            docs.append(doc)
            continue
        if not line:
            continue
        found = declaration(language, line)
        if not found:
            docs = []
            continue
        name, kind = found
        indent = len(raw) - len(raw.lstrip())
        owner = parent if kind not in _OWNERS and (indent or kind == "method") else None
        kind = "method" if owner and kind == "function" else kind
        comment = " ".join(d for d in docs if d) or (_docstring(lines, i) if language == "Python" and kind != "constant" else None)
        docs = []
        signature = line if len(line) <= MOST_SIGNATURE else line[: MOST_SIGNATURE - 3] + "…"
        bodies.begin(i, indent)
        rows.append((name, kind, language, path, i + 1, signature, comment or None, owner, uses.get(name, 0) > 1))
        if kind in _OWNERS:
            parent = name
        elif indent == 0:
            parent = None
    lengths = bodies.end(len(lines))
    for *head, owner, used in rows:
        yield (*head, lengths[head[4] - 1], owner, used)


#: Rows of symbols that a task holds at once.
SLICE = 2000
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [{"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]] for c in SCHEMA.split(", ")]


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA, a slice at a time."""
    while some := list(islice(rows, SLICE)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), _TYPES, strict=True)], _NAMES)


def _of_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files = (f for b in batches for f in zip(*(b.column(c).to_pylist() for c in ("project_id", "language", "rel_path", "text")), strict=True))
    yield from _batches((p, *row) for p, lang, path, text in files if text for row in extract(lang, path, text))


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of ``files(project_id, language, rel_path, text)``, null texts skipped. A task
    holds a batch of files and a slice of symbols."""
    return files.select("project_id", "language", "rel_path", "text").mapInArrow(_of_files, SCHEMA)


class SymbolTable:
    """The same for SQL, by Arrow batches: ``FROM source_symbols(TABLE(files))``."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield from _of_files(iter([batch]))


class SymbolsOf:
    """The same of one file, for joins: ``FROM files f, LATERAL symbols_of(f.language, f.path,
    f.text) s``. Spark gives laterals no Arrow batches; a call is a whole file."""

    def eval(self, language: str, path: str, text: str) -> Iterator[tuple]:
        yield from extract(language, path, text or "")


def register(spark: SparkSession) -> None:
    """Registers both table functions with the session."""
    spark.udtf.register("source_symbols", F.arrow_udtf(SymbolTable, returnType=SCHEMA).asDeterministic())
    spark.udtf.register("symbols_of", F.udtf(SymbolsOf, returnType=SCHEMA.split(", ", 1)[1]).asDeterministic())
