"""Imports narrow what a called name can stand for.

A file is filed under every suffix of its path without extension, and of its folder
(packages): ``src/net/http.py`` under src/net/http, net/http, http, src/net and net. What
an import names, or what is left of it without its last word (a symbol), stands for
the longest of its own suffixes under which some file is filed: suffixes meet
suffixes, each once, so an import is never joined with the many files of a common name.
Names are then looked up within that scope.

A call is looked up in its own file, in what the file imports, in its language, and
anywhere, and stops at the first place that has the name. One symbol there is sure to
a degree that falls with the distance; several are candidates with less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import linking

#: Confidence of one candidate and of one of several, by where the name was found.
FILE, IMPORT = (1.0, 0.5), (0.9, 0.5)
LANGUAGE, ANYWHERE = (linking.UNIQUE_LANG, linking.MANY_LANG), (linking.UNIQUE_ANY, linking.MANY_ANY)
# Files that stand for their folder, words of import paths that name no folder, and endings that imports may have.
WHOLE_FOLDER = ("__init__", "index", "lib", "mod")
NO_FOLDER = ("", "crate", "self", "super", "@", "~", "..", ".")
ENDINGS = r"\.(js|jsx|ts|tsx|mjs|cjs|py|rb|h|hh|hpp|c|cc|cpp|sh)$"


def _suffixes(words: Column) -> Column:
    """All suffixes of a list of words, the longest first."""
    n = F.size(words)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(words, i, n), "/"))).otherwise(F.array().cast("array<string>"))


def file_scopes(files: DataFrame) -> DataFrame:
    """(path, scope): every scope that has the file."""
    words = F.split(F.regexp_replace("path", r"\.[^./]*$", ""), "/")
    last = F.element_at(words, -1)
    folder = F.slice(words, 1, F.size(words) - 1)
    own = F.when(last.isin(*WHOLE_FOLDER), folder).otherwise(words)
    return files.select("path").distinct().select("path", F.explode(F.array_union(_suffixes(own), _suffixes(folder))).alias("scope"))


def import_words(text: Column) -> Column:
    """The words of an import path, whatever stands between them."""
    plain = F.when(text.contains("/"), F.regexp_replace(text, ENDINGS, "")).otherwise(text)
    return F.filter(F.split(F.regexp_replace(plain, r"::|\.(?!\.)|\\", "/"), "/"), lambda w: ~w.isin(*NO_FOLDER))


def import_scopes(imports: DataFrame, scopes: DataFrame) -> DataFrame:
    """(path, import, scope): what each import stands for, the longest match; imports of what no file is filed under have no row."""
    words = import_words(F.col("import"))
    named = imports.select("path", "import").where("import is not null").distinct().select("path", "import", words.alias("w"))
    one = named.select("import", "w").distinct()
    sides = F.concat(_suffixes(F.col("w")), _suffixes(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0)))))
    asked = one.select("import", F.posexplode(sides).alias("at", "scope"))
    met = asked.join(scopes.select("scope").distinct(), "scope", "left_semi")
    # of equally long ones the whole import comes first
    length = F.size(F.split("scope", "/"))
    best = met.groupBy("import").agg(F.max(F.struct(length.alias("length"), (-F.col("at")).alias("at"), "scope")).alias("b")).select("import", F.col("b.scope").alias("scope"))
    return named.select("path", "import").join(best, "import").select("path", "import", "scope")


def link(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(from_id, to_id, kind, confidence, scope, reason) for calls (from_id, callee), symbols (id, name, path, lang) and imports (path, import).

    ``scope``: file, import, language, any or external. ``reason``, where the target is not
    sure: several candidates, another language, or no symbol of that name. Callers that are no
    symbols have neither file nor language.
    """
    own = symbols.select(F.col("id").alias("from_id"), F.col("path").alias("caller_path"), F.col("lang").alias("caller_lang"))
    located = calls.select("from_id", "callee").distinct().join(own, "from_id", "left")
    asked = located.select("caller_path", "caller_lang", "callee").distinct()
    names = symbols.select(F.col("name").alias("callee"), F.col("id").alias("to_id"), F.col("path").alias("to_path"), F.col("lang").alias("to_lang"))
    left = asked

    def found(matches: DataFrame, scope: str, degrees: tuple[float, float]) -> DataFrame:
        """Candidates with their confidence; each (file, language, name) has its candidates once."""
        key = Window.partitionBy("caller_path", "caller_lang", "callee")
        n = F.count("*").over(key)
        return matches.select("caller_path", "caller_lang", "callee", "to_id").distinct().withColumn("n", n).select("caller_path", "caller_lang", "callee", "to_id", F.when(F.col("n") == 1, degrees[0]).otherwise(degrees[1]).alias("confidence"), F.lit(scope).alias("scope"), (F.col("n") > 1).alias("several"))

    def rest(of: DataFrame, done: DataFrame) -> DataFrame:
        d = done.select(F.col("caller_path").alias("dp"), F.col("caller_lang").alias("dl"), F.col("callee").alias("dc")).distinct()
        return of.join(d, (F.col("callee") == F.col("dc")) & F.col("caller_path").eqNullSafe(F.col("dp")) & F.col("caller_lang").eqNullSafe(F.col("dl")), "left_anti")

    in_file = found(left.join(names, (left["callee"] == names["callee"]) & (left["caller_path"] == names["to_path"])).select(left["*"], "to_id"), "file", FILE)
    left = rest(left, in_file)
    scopes = file_scopes(symbols)
    visible = import_scopes(imports, scopes).select(F.col("path").alias("caller_path"), "scope").distinct()
    where = names.join(scopes.withColumnRenamed("path", "to_path"), "to_path").join(visible.select("scope").distinct(), "scope", "left_semi")
    looked = left.join(visible, "caller_path")
    in_import = found(looked.join(where, ["callee", "scope"]).where("caller_lang = to_lang"), "import", IMPORT)
    left = rest(left, in_import)
    in_lang = found(left.join(names, (left["callee"] == names["callee"]) & (left["caller_lang"] == names["to_lang"])).select(left["*"], "to_id"), "language", LANGUAGE)
    left = rest(left, in_lang)
    anywhere = found(left.join(names, "callee"), "any", ANYWHERE)
    outside = rest(left, anywhere).select("caller_path", "caller_lang", "callee", F.concat(F.lit(linking.EXTERNAL), "callee").alias("to_id"), F.lit(0.0).alias("confidence"), F.lit("external").alias("scope"), F.lit(False).alias("several"))
    every = in_file.unionByName(in_import).unionByName(in_lang).unionByName(anywhere).unionByName(outside)
    every = every.select(F.col("caller_path").alias("p"), F.col("caller_lang").alias("l"), F.col("callee").alias("c"), "to_id", "confidence", "scope", "several")
    met = located.join(every, (F.col("callee") == F.col("c")) & F.col("caller_path").eqNullSafe(F.col("p")) & F.col("caller_lang").eqNullSafe(F.col("l")))
    reason = F.when(F.col("scope") == "external", "no symbol of that name").when(F.col("several"), F.concat(F.lit("several candidates: "), "scope")).when(F.col("scope") == "any", "another language")
    return met.select("from_id", "to_id", F.lit("calls").alias("kind"), "confidence", "scope", reason.alias("reason"))
