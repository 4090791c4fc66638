"""Definitions, calls, imports and patterns from source texts.

Python is parsed exactly, by its own parser. Other languages are read with
regular expressions over text without comments and strings, and braces (or
``end``) close definitions: an approximation. ``register`` adds a language, and
``packs_from`` reads packs of expressions from a folder, for new languages or in
place of those here. ``match_lines`` finds patterns in lines of any text.
"""

from __future__ import annotations

import ast
import re
import tomllib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, lang string, loc int, defs array<struct<name:string,kind:string,span_start:int,span_end:int,complexity:int>>, calls array<struct<callee:string,line:int>>, imports array<string>, patterns array<struct<kind:string,line:int>>, skipped boolean"


@dataclass
class Parsed:
    defs: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    patterns: list[dict] = field(default_factory=list)


# Names whose calls count as a pattern in Python, by pattern.
PYTHON_METHODS = {"block_on": "run_until_complete run run_sync", "spawn": "Thread Process submit apply_async start run_in_executor", "lock": "acquire lock"}
PYTHON_NAMES = {"spawn": "Thread Process", "alloc": "list dict set tuple copy deepcopy"}
BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.IfExp, ast.BoolOp, ast.Match)


def parse_python(text: str) -> Parsed:
    out = Parsed()
    tree = ast.parse(text)
    branches: list[tuple[int, int]] = []

    def visit(node: ast.AST, depth: int, in_class: bool) -> None:
        line = getattr(node, "lineno", 0)
        if isinstance(node, BRANCHES):
            branches.append((line, depth))
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "type" if isinstance(node, ast.ClassDef) else "method" if in_class else "function"
            out.defs.append({"name": node.name, "kind": kind, "span_start": line, "span_end": node.end_lineno or line, "complexity": 0})
        elif isinstance(node, ast.Call):
            f = node.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            if name:
                out.calls.append({"callee": name, "line": f.end_lineno or line})
                table = PYTHON_NAMES if isinstance(f, ast.Name) else PYTHON_METHODS
                out.patterns.extend({"kind": k, "line": line} for k, names in table.items() if name in names.split())
        elif isinstance(node, ast.Import):
            out.imports.extend(a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            out.imports.append("." * node.level + (node.module or ""))
        elif isinstance(node, ast.Await):
            out.patterns.append({"kind": "await", "line": line})
        elif isinstance(node, (ast.For, ast.AsyncFor, ast.While)):
            out.patterns.append({"kind": "loop", "line": line})
        for child in ast.iter_child_nodes(node):
            visit(child, depth + 1, isinstance(node, ast.ClassDef))

    visit(tree, 0, False)
    _add_complexity(out, branches)
    return out


def _add_complexity(out: Parsed, branches: list[tuple[int, int]]) -> None:
    """Branches inside the span plus the greatest depth of one of them."""
    for d in out.defs:
        inside = [depth for line, depth in branches if d["span_start"] <= line <= d["span_end"]]
        d["complexity"] = len(inside) + max(inside, default=0)


#: What looks like a call, but is none.
KEYWORDS = ("if", "for", "while", "match", "switch", "return", "catch", "fn", "func", "function", "loop", "else", "in", "new", "sizeof", "synchronized", "super", "impl", "def")


@dataclass(frozen=True)
class Pack:
    """Regular expressions of one language; each has one group, the captured name."""

    defs: tuple[tuple[str, str], ...]
    calls: str = r"(?<![\w])([A-Za-z_]\w*)\s*(?:::<[^<>()]*>)?\("
    imports: tuple[str, ...] = ()
    patterns: tuple[tuple[str, str], ...] = ()
    comment: str = r"//[^\n]*|/\*.*?\*/"
    branch: str = r"\b(if|for|while|match|switch|case|catch|loop|elif|rescue|when)\b"
    words: tuple[str, ...] = KEYWORDS
    ends: str = "brace"
    strings: str = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'"
    #: Bodies whose functions are methods, beside those of types.
    bodies: str = ""


#: What an "end" closes.
ENDED = r"^\s*(?:def|class|module|if|unless|while|until|case|begin|for)\b|\bdo\b"


# What each language's patterns look like.
PACKS: dict[str, Pack] = {
    "rust": Pack(
        (("function", r"\bfn\s+(\w+)"), ("type", r"\b(?:struct|enum|trait|type)\s+(\w+)")),
        bodies=r"^\s*(?:unsafe\s+)?impl\b[^;{]*(?=\{)",
        imports=(r"\buse\s+([\w:]+?)(?:::\{|::\*|::\w+\s*;|\s*;)",),
        patterns=(("alloc", r"\.(to_string|to_owned|clone|collect|into_owned|to_vec|format)\s*(?:::<[^()]*>)?\("), ("lock", r"\.(lock|write|read|try_lock|try_write|try_read)\("), ("await", r"\.(await)\b"), ("block_on", r"\.(block_on)\("), ("spawn", r"::(spawn|spawn_blocking|spawn_local)\("), ("loop", r"\b(loop|while|for)\b(?!\s*<)")),
    ),
    "go": Pack(
        (("method", r"\bfunc\s*\([^)]*\)\s*(\w+)"), ("function", r"\bfunc\s+(\w+)"), ("type", r"\btype\s+(\w+)")),
        imports=(r"\bimport\s+(?:\w+\s+)?\"([^\"]+)\"", r"^[ \t]+(?:\w+[ \t]+)?\"([^\"]+)\"[ \t]*$"),
        patterns=(("spawn", r"\b(go)\s+[\w(]"), ("lock", r"\.(Lock|RLock|TryLock)\("), ("alloc", r"\b(make|new|append)\("), ("chan", r"(<-|\bchan\b)"), ("loop", r"\b(for)\b")),
    ),
    "typescript": Pack(
        (("function", r"\bfunction\s+(\w+)"), ("function", r"\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"), ("method", r"^\s+(?:async\s+|static\s+|public\s+|private\s+)*(?!if|for|while|switch|catch|return)(\w+)\([^)]*\)[^{;=\n]*\{"), ("type", r"\b(?:class|interface|type|enum)\s+(\w+)")),
        strings=r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`",
        words=(*KEYWORDS, "async", "await", "typeof"),
        imports=(r"\bfrom\s+['\"]([^'\"]+)['\"]", r"\brequire\(\s*['\"]([^'\"]+)['\"]"),
        patterns=(("await", r"\b(await)\b"), ("alloc", r"\b(new)\s+\w"), ("timer", r"\b(setTimeout|setInterval|setImmediate)\("), ("spawn", r"\b(Worker|spawn|fork|exec)\("), ("loop", r"\b(for|while|do)\b")),
    ),
    "java": Pack(
        (("type", r"\b(?:class|interface)\s+(\w+)"), ("method", r"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*[\w<>\[\],]*\s*\b(?!if|for|while|switch|catch|return|new)(\w+)\([^)]*\)[^{;=\n]*\{")),
        imports=(r"\bimport\s+(?:static\s+)?([\w.]+)",),
        patterns=(("lock", r"\b(synchronized|lock|tryLock)\b"), ("spawn", r"\.(start|submit|execute|runAsync|supplyAsync)\("), ("alloc", r"\b(new)\s+\w"), ("loop", r"\b(for|while|do)\b")),
    ),
    "ruby": Pack(
        (("method", r"\bdef\s+(?:self\.)?(\w+[?!]?)"), ("type", r"\b(?:class|module)\s+(\w+)")),
        imports=(r"\brequire(?:_relative)?\s+['\"]([^'\"]+)['\"]",),
        patterns=(("spawn", r"\b(Thread\.new|fork|spawn)\b"), ("lock", r"\.(synchronize|lock)\b"), ("alloc", r"\.(new|dup|clone)\b"), ("loop", r"\b(while|until|for|loop|each)\b")),
        comment=r"#[^\n]*",
        strings=r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
        ends="end",
    ),
    "c": Pack(
        (("function", r"^[A-Za-z_][\w \t\*]*?\b(?!if\b|for\b|while\b|switch\b|return\b|else\b)(\w+)\([^;{}()]*\)\s*[{;]"), ("type", r"\b(?:struct|enum|union)\s+(\w+)\s*\{")),
        imports=(r"#\s*include\s*[<\"]([^>\"]+)[>\"]",),
        patterns=(("lock", r"\b(pthread_mutex_lock|mtx_lock|spin_lock)\("), ("alloc", r"\b(malloc|calloc|realloc|strdup)\("), ("spawn", r"\b(pthread_create|fork|thrd_create)\("), ("loop", r"\b(for|while|do)\b")),
    ),
    "bash": Pack((("function", r"^\s*(?:function\s+)?(\w+)\s*\(\)"),), calls=r"^\s*([A-Za-z_]\w*)\b(?!\s*\(\)|=)", imports=(r"^\s*(?:source|\.)\s+(\S+)",), comment=r"(?<![^\s])#[^\n]*", strings=r"\"(?:\\.|[^\"\\])*\"|'[^'\n]*'", words=("if", "then", "else", "elif", "fi", "for", "while", "until", "do", "done", "case", "esac", "in", "function", "return", "local", "export", "source")),
}
PACKS["javascript"] = Pack(
    tuple(d for d in PACKS["typescript"].defs if d[0] != "type") + (("type", r"\b(?:class)\s+(\w+)"),),
    imports=PACKS["typescript"].imports,
    patterns=PACKS["typescript"].patterns,
    strings=PACKS["typescript"].strings,
    words=PACKS["typescript"].words,
)
PACKS["cpp"] = Pack((*PACKS["c"].defs, ("type", r"\b(?:class|namespace)\s+(\w+)")), imports=PACKS["c"].imports, patterns=(("lock", r"\b(lock_guard|unique_lock|scoped_lock|lock)\b"), ("alloc", r"\b(new|make_unique|make_shared|malloc)\b"), ("spawn", r"\b(thread|async|jthread)\b\s*[({]"), ("await", r"\b(co_await)\b"), ("loop", r"\b(for|while|do)\b")))


def _blank(m: re.Match) -> str:
    """As many characters, on as many lines, without their contents."""
    return re.sub(r"[^\n]", " ", m[0])


def parse_with(pack: Pack, text: str) -> Parsed:
    # what comes first decides: a comment mark in a string is none, nor is a quote in a comment
    either = re.compile(f"(?P<string>{pack.strings})|(?:{pack.comment})", re.S if "*" in pack.comment else 0)
    coded = either.sub(lambda m: m[0] if m["string"] else _blank(m), text)
    imports = [m[1] for p in pack.imports for m in re.finditer(p, coded, re.M)]
    plain = either.sub(_blank, text)
    feeds = [m.start() for m in re.finditer("\n", plain)]

    import bisect

    line_of = lambda at: bisect.bisect_left(feeds, at) + 1
    out, named = Parsed(imports=imports), set()
    for kind, pattern in pack.defs:
        for m in re.finditer(pattern, plain, re.M):
            if m.start(1) in named:
                continue
            named.add(m.start(1))
            end = _end_of(plain, m.end(), pack.ends)
            out.defs.append({"name": m[1], "kind": kind, "span_start": line_of(m.start(1)), "span_end": line_of(end), "complexity": 0})
    spans = [(d["span_start"], d["span_end"]) for d in out.defs if d["kind"] == "type"]
    if pack.bodies:
        spans += [(line_of(m.end()), line_of(_end_of(plain, m.end(), pack.ends))) for m in re.finditer(pack.bodies, plain, re.M)]
    for d in out.defs:  # a function inside an impl or class body is a method
        if d["kind"] == "function" and any(a < d["span_start"] <= b for a, b in spans):
            d["kind"] = "method"
    out.calls = [{"callee": m[1], "line": line_of(m.start(1))} for m in re.finditer(pack.calls, plain, re.M) if m[1] not in pack.words and m.start(1) not in named]
    out.patterns = [{"kind": k, "line": line_of(m.start())} for k, p in pack.patterns for m in re.finditer(p, plain, re.M)]
    branches, depth, at = [], 0, 0
    opens, closes = (ENDED, r"\bend\b") if pack.ends == "end" else (r"\{", r"\}")
    for m in re.finditer(pack.branch, plain):
        between = plain[at : m.start()]
        depth += len(re.findall(opens, between, re.M)) - len(re.findall(closes, between, re.M))
        at = m.start()
        branches.append((line_of(at), depth))
    _add_complexity(out, branches)
    return out


def _end_of(plain: str, at: int, style: str) -> int:
    """Where the body that begins after ``at`` closes; a declaration without a body ends at once."""
    if style == "end":
        depth = 1
        for m in re.finditer(ENDED + r"|\bend\b", plain[at:], re.M):
            depth += -1 if m[0].strip() == "end" else 1
            if depth == 0:
                return at + m.end()
        return len(plain)
    depth = 0
    for m in re.finditer(r"[{};]", plain[at - 1 :]):
        if m[0] == ";" and depth == 0:
            return at - 1 + m.start()
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if m[0] == "}" and depth <= 0:
            return at - 1 + m.start()
    return len(plain) - 1 if plain else 0


EXTRACTORS: dict[str, Callable[[str], Parsed]] = {"python": parse_python} | {lang: (lambda text, p=pack: parse_with(p, text)) for lang, pack in PACKS.items()}


def register(lang: str, parse: Callable[[str], Parsed]) -> None:
    EXTRACTORS[lang] = parse


def extended(extra: dict[str, tuple[tuple[str, str], ...]]) -> dict[str, Callable[[str], Parsed]]:
    """Extractors with more pattern expressions appended to some languages' packs."""
    out = dict(EXTRACTORS)
    for lang, more in extra.items():
        pack = PACKS[lang]
        out[lang] = lambda text, p=replace(pack, patterns=(*pack.patterns, *more)): parse_with(p, text)
    return out


def packs_from(folder: str | Path) -> dict[str, Callable[[str], Parsed]]:
    """Extractors with those of a folder's ``LANGUAGE.toml`` files in place of ours or beside them.

    A file holds what a :class:`Pack` holds: ``defs`` and ``patterns`` as lists of
    [kind, expression], ``imports`` as a list of expressions, and the rest as text.
    """
    out = dict(EXTRACTORS)
    for path in sorted(Path(folder).glob("*.toml")):
        spec = tomllib.loads(path.read_text())
        pairs = {k: tuple((str(a), str(b)) for a, b in spec.get(k, [])) for k in ("defs", "patterns")}
        plain = {k: v for k, v in spec.items() if k in ("calls", "comment", "branch", "ends", "strings", "bodies")}
        lists = {k: tuple(spec[k]) for k in ("imports", "words") if k in spec}
        pack = Pack(**pairs, **plain, **lists)
        out[path.stem] = lambda text, p=pack: parse_with(p, text)
    return out


def match_lines(lines: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """Rows of ``lines`` (line, any other columns) with the ``kind`` of each expression that they match."""
    kinds = F.array_compact(F.array(*(F.when(F.col("line").rlike(e), F.lit(k)) for k, e in expressions.items())))
    return lines.withColumn("kind", F.explode(kinds))


def extract(sources: DataFrame, extractors: dict[str, Callable[[str], Parsed]] | None = None) -> DataFrame:
    """One row for each file of (path, lang, text); a file that can't be parsed is ``skipped`` and empty."""
    table = extractors or EXTRACTORS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                text, skipped, parsed = row["text"] or "", False, Parsed()
                try:
                    if row["lang"] in table:
                        parsed = table[row["lang"]](text)
                except (SyntaxError, ValueError, RecursionError):
                    skipped = True
                rows.append({"path": row["path"], "lang": row["lang"], "loc": text.count("\n") + 1, "defs": parsed.defs, "calls": parsed.calls, "imports": parsed.imports, "patterns": parsed.patterns, "skipped": skipped})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return sources.select("path", "lang", "text").mapInArrow(run, SCHEMA)


ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("lang", pa.string()),
        ("loc", pa.int32()),
        ("defs", pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("span_start", pa.int32()), ("span_end", pa.int32()), ("complexity", pa.int32())]))),
        ("calls", pa.list_(pa.struct([("callee", pa.string()), ("line", pa.int32())]))),
        ("imports", pa.list_(pa.string())),
        ("patterns", pa.list_(pa.struct([("kind", pa.string()), ("line", pa.int32())]))),
        ("skipped", pa.bool_()),
    ]
)


def extract_stats(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count_if(~F.col("skipped")).alias("files_processed"), F.sum(F.size("defs")).alias("symbols_found"), F.count_if("skipped").alias("files_skipped"))
