"""Benchmark decontamination: windows of benchmark words found in documents.

All of it is DataFrame operations. Words are runs of letters and digits (any
non-ASCII character counts as a letter), A-Z lower-cased. A window is ``size``
consecutive words of a benchmark item; an item with fewer words, but not none,
is one window.

Every window is filed under one of its words, its longest (of equally long ones
the first), which is about its rarest. One scan of the documents looks each word
up in that table; where it hits, the words around it are compared with the
windows filed there. The table is broadcast while the benchmark has at most
``MOST_BROADCAST`` windows of ``MOST_BYTES`` together; beyond it, SHA-256 digests of
document windows are joined by shuffle.

Null or empty texts have no words: n_words, n_hit and n_items are 0 and nothing
is contaminated. A null item or an item without words has no window. Rows that
repeat an id are judged each by its own text. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE = 13
MOST_BROADCAST, MOST_BYTES = 200_000, 1 << 26
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What no word holds, in either case.
SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: Filed for every document once, so that documents without hits stay in the result; no word can equal it.
EACH_DOCUMENT = " "


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN_WORDS), "")


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(item_id string, win array<string>) for every window."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, size))).alias("win")).distinct()


def filed(wins: DataFrame) -> DataFrame:
    """(word, before, win, item_id): each window under its longest word; ``before``: words that precede it there."""
    longest = F.array_max(F.transform("win", lambda w, i: F.struct(F.char_length(w).alias("n"), (-i).alias("i"), w.alias("w"))))
    return wins.withColumn("a", longest).select(F.col("a.w").alias("word"), (-F.col("a.i")).alias("before"), "win", "item_id")


def _scan(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """(id, row_key, n_words, start, n, item_id): a row for each hit, and one without start for each document."""
    spark = docs.sparkSession
    table = filed(wins).unionByName(spark.range(1).select(F.lit(EACH_DOCUMENT).alias("word"), F.lit(0).alias("before"), F.lit(None).cast("array<string>").alias("win"), F.lit(None).cast("string").alias("item_id")))
    at = docs.select("id", "row_key", "w", F.posexplode(F.concat(F.array(F.lit(EACH_DOCUMENT)), F.col("w"))).alias("pos", "word"))
    start = F.col("pos") - F.col("before")
    hit = at.join(F.broadcast(table), "word").where(F.col("win").isNull() | ((start >= 1) & (F.slice("w", F.greatest(start, F.lit(1)), F.size("win")) == F.col("win"))))
    return hit.select("id", "row_key", F.size("w").alias("n_words"), F.when(F.col("win").isNotNull(), start).alias("start"), F.size("win").alias("n"), "item_id")


def _shuffled(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """As :func:`_scan`, for a benchmark of any size: digests of all document windows meet those of the benchmark."""
    sizes = [r["n"] for r in wins.select(F.size("win").alias("n")).distinct().collect()]  # at most SIZE numbers
    digest = lambda a: F.sha2(F.concat_ws(" ", a), 256)
    keyed = wins.select(digest(F.col("win")).alias("digest"), F.size("win").alias("n"), "item_id")
    def of_size(n: int) -> Column:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), digest(F.slice(F.col("w"), i, n)).alias("digest")))

    base = docs.select("id", "row_key", F.size("w").alias("n_words"), "w")
    none = base.select("id", "row_key", "n_words", F.lit(None).cast("int").alias("start"), F.lit(-1).alias("n"), F.lit(None).cast("string").alias("item_id"))
    if not sizes:
        return none
    found = base.select("id", "row_key", "n_words", F.explode(F.concat(*map(of_size, sizes))).alias("x")).select("id", "row_key", "n_words", "x.start", "x.digest")
    return none.unionByName(found.join(keyed.hint("shuffle_merge"), "digest").select("id", "row_key", "n_words", "start", "n", "item_id"))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Hits of every document, one row a hit: id, row_key, n_words, start (first word, from 1), n, item_id; and one row without start each."""
    wins = windows(benchmark, size=size)
    size = wins.limit(most_broadcast + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "win"))), F.lit(0)).alias("bytes")).first()
    few = size["n"] <= most_broadcast and size["bytes"] <= MOST_BYTES
    read = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("row_key"), words(F.col(text_col)).alias("w"))
    return (_scan if few else _shuffled)(read, wins)


def _judged(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, size: int, share: int, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """id, row_key, n_words, n_hit, items, contaminated, copies (rows that agree in id and text)."""
    hits = find(docs, benchmark, id_col, text_col, size, most_broadcast)
    covered = F.explode_outer(F.when(F.col("start").isNotNull(), F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)))
    rows = hits.select("id", "row_key", "n_words", "item_id", covered.alias("place"))
    grouped = rows.groupBy("id", "row_key", "n_words").agg(
        F.count_distinct("place").alias("n_hit"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
        F.count(F.when(F.col("item_id").isNull(), 1)).alias("copies"),
    )
    return grouped.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, share: int = 20, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated (``share`` * n_hit >= n_words, some hit)."""
    out = _judged(docs, benchmark, id_col, text_col, size, share, most_broadcast).select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    )
    return out.drop("copy")


def remove_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, with all their columns; of rows that share an id, or have none, those go whose own text is."""
    bad = _judged(docs, benchmark, id_col, text_col, size, share).where("contaminated").select(F.col("id").alias("bad_id"), F.col("row_key").alias("bad_key"))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs[text_col]) == bad["bad_key"]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id, text): each text without its hit words and what separates them from the next word; all else stays as it is."""
    hits = find(docs, benchmark, id_col, text_col, size).where("start is not null")
    places = hits.select("id", "row_key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("place")).distinct()
    # places that follow each other are one span
    run = F.col("place") - F.row_number().over(Window.partitionBy("id", "row_key").orderBy("place"))
    spans = places.withColumn("run", run).groupBy("id", "row_key", "run").agg(F.min("place").alias("a"), F.max("place").alias("b"))
    spans = spans.groupBy("id", "row_key").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    joined = own.join(spans, own["id"].eqNullSafe(spans["id"]) & (own["row_key"] == spans["row_key"]), "left").select(own["id"], own["text"], "spans")
    units = F.regexp_extract_all("text", F.lit(f"([^{SEPARATORS}]+[{SEPARATORS}]*)"), F.lit(1))
    # what stays lies between a span and the next one
    begins = F.concat(F.array(F.lit(1)), F.transform("spans", lambda s: (s["b"] + 1).cast("int")))
    ends = F.concat(F.transform("spans", lambda s: s["a"].cast("int")), F.array(F.size("units") + 1))
    left = F.flatten(F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda g: F.slice(F.col("units"), g["a"], g["b"] - g["a"])))
    rest = F.concat(F.regexp_extract("text", f"^[{SEPARATORS}]*", 0), F.array_join(left, ""))
    joined = joined.withColumn("units", F.when(F.col("spans").isNotNull(), units))
    return joined.select(F.col("id").alias(id_col), F.when(F.col("spans").isNull(), F.col("text")).otherwise(rest).alias("text"))


_WORDS_SQL = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS win
       FROM (SELECT item_id, w, least(len(w), {SIZE}) AS n, unnest(range(1, len(w) - least(len(w), {SIZE}) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (win)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
