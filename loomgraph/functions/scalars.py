"""Scalar rules as column expressions: languages, test paths, labels, weights, names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and the languages they stand for.
EXTENSIONS = {
    "go": "go",
    "rs": "rust",
    "py": "python",
    "ts": "typescript",
    "tsx": "typescript",
    "js": "javascript",
    "jsx": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "java": "java",
    "rb": "ruby",
    "c": "c",
    "h": "c",
    "cpp": "cpp",
    "cc": "cpp",
    "cxx": "cpp",
    "hpp": "cpp",
    "sh": "bash",
    "bash": "bash",
    "tf": "hcl",
    "hcl": "hcl",
    "yaml": "yaml",
    "yml": "yaml",
}
NOT_SOURCE = ("hcl", "yaml", "unknown")
# Parts of paths by which test files are known.
TEST_INFIXES = ("/test/", "/tests/", "/testdata/", "/__tests__/", "/spec/", "/fixtures/", "/mocks/")
TEST_PREFIXES = ("test/", "tests/", "testdata/", "spec/", "fixtures/")
TEST_SUFFIXES = ("_test.rs", "_test.go", "_test.py", ".test.ts", ".test.tsx", ".test.js", ".spec.ts", ".spec.tsx", ".spec.js", "Test.java", "_spec.rb")
# Words in paths by which security-related files are known.
SECURITY_WORDS = ("auth", "crypto", "token", "secret", "password", "passwd", "jwt", "oauth", "session", "credential", "key", "cert", "tls", "ssl", "permission", "acl", "policy")
# Labels of scores, lowest score first after the floor label.
HEAT = ((0.05, "cool"), (0.2, "mild"), (0.4, "warm"), (0.6, "🔥 hot"), (0.8, "🔥 very hot"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def steps(value: Column, floor: str, labels: tuple[tuple[float, str], ...], strict: bool = False) -> Column:
    """The label of the highest bar that ``value`` reaches (or exceeds)."""
    out = F.lit(floor)
    for bar, label in labels:
        out = F.when(value > bar if strict else value >= bar, label).otherwise(out)
    return out


def extension(path: Column) -> Column:
    """After the last dot of the file name; a name that only begins with a dot has none."""
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def lang_from_path(path: Column) -> Column:
    ext = extension(path)
    table = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.coalesce(table[ext], F.lit("unknown"))


def is_source(lang: Column) -> Column:
    return ~lang.isin(*NOT_SOURCE)


def is_test_path(path: Column) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return any_of([p.contains(x) for x in TEST_INFIXES] + [p.startswith(x) for x in TEST_PREFIXES] + [p.endswith(x) for x in TEST_SUFFIXES])


def is_security_path(path: Column) -> Column:
    return F.lower(path).rlike("|".join(SECURITY_WORDS))


def text_loc(text: Column) -> Column:
    """Line feeds plus one."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def stable_id(path: Column, name: Column, kind: Column) -> Column:
    return F.md5(F.concat_ws("\u0001", path, name, kind))


def heat_label(score: Column) -> Column:
    return steps(score, "cold", HEAT)


def age_label(days: Column) -> Column:
    span = lambda n, unit: F.concat((days / n).cast("bigint").cast("string"), F.lit(" " + unit))
    return F.when(days == 0, "today").when(days == 1, "1 day").when(days < 14, span(1, "days")).when(days < 60, span(7, "wks")).when(days < 730, span(30, "mo")).otherwise(span(365, "yr"))


def dangerous(patterns: Column) -> Column:
    """A lock held across a wait."""
    return F.array_contains(patterns, "lock") & F.array_contains(patterns, "await")


def risk_level(hotspot: Column, complexity: Column, fanin: Column, patterns: Column) -> Column:
    """HIGH, MEDIUM or LOW."""
    signs = (hotspot > 0.6).cast("int") + (complexity > 10).cast("int") + (fanin > 5).cast("int")
    return F.when(dangerous(patterns) | (signs == 3), "HIGH").when(signs == 2, "MEDIUM").otherwise("LOW")


def high_risk(hotspot: Column, complexity: Column, fanin: Column, patterns: Column) -> Column:
    return dangerous(patterns) | ((hotspot > 0.5) & (complexity > 8)) | ((hotspot > 0.7) & (complexity > 3)) | ((fanin > 8) & (complexity > 3))


def safe_id(text: Column, size: int = 30) -> Column:
    return F.substring(F.regexp_replace(text, r"[^\p{L}\p{N}_]", "_"), 1, size)


def weight_bar(weight: Column) -> Column:
    filled = F.least(F.round(weight * 6), F.lit(6)).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit(" "), F.lit(6) - filled))


def folded_count(weight: Column) -> Column:
    return F.greatest(F.round(weight * 1000), F.lit(1)).cast("bigint")


def target_file(target: Column) -> Column:
    """The part before the last colon, if it looks like a path; else null."""
    left = F.regexp_extract(target, r"^(.*):[^:]*$", 1)
    return F.when((left != "") & (left.contains("/") | left.contains(".")), left)


def target_name(target: Column) -> Column:
    return F.when(target_file(target).isNotNull(), F.regexp_extract(target, r":([^:]*)$", 1)).otherwise(target)
