"""Chat formatting: messages without their quotations, linked to the messages they quote.

All of it is DataFrame operations. A line's quote level is the number of ``>``
it begins with; a line "... wrote:" right before a quotation belongs to it.
Neighbouring quoted lines of one level are a passage; a blank line ends it. Passages
are normalised (lower case, white space collapsed), and each of their sentences and
each of their lines is hashed and looked up among those of the own passages of earlier
messages of the same conversation, so a quotation is found whether its lines are
those of the original or wrapped anew. The latest message that has it gets a vote of
its length, divided by its level. ``reply_to`` is the turn with
most votes (of equal ones the latest). A message that quotes nothing known
replies to nothing in particular and goes by its turn. ``thread`` is the first
turn of the chain of replies; (conv_id, thread, turn) is the reply order, in
which a message follows what it answers.

Null texts are empty. Messages without conversation or turn keep null links.
Repeated (conv_id, turn) rows are formatted each from its own text and share a
link. Long conversations, and lines that very many messages share, are sorted,
never paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import shared

QUOTE = r"^[ \t]*((?:>[ \t]*)+)"
ATTRIBUTION = r"(?i)\bwrote:[ \t]*$"


def _lines(text: Column) -> Column:
    """(line, level) of every line; the line without its marks."""
    parts = F.split(F.coalesce(text, F.lit("")), "\r?\n")
    return F.transform(parts, lambda x: F.struct(F.regexp_replace(x, QUOTE, "").alias("line"), F.char_length(F.regexp_replace(F.regexp_extract(x, QUOTE, 1), "[^>]", "")).alias("level")))


def _owned(lines: Column) -> Column:
    """Lines that are the writer's own."""
    following = lambda i: F.coalesce(F.try_element_at(lines, i + 2)["level"], F.lit(0))
    return F.filter(lines, lambda x, i: (x["level"] == 0) & ~(x["line"].rlike(ATTRIBUTION) & (following(i) > 0)))


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, content (own lines, trimmed), own, quoted: arrays of lines with their levels."""
    lines = messages.select("conv_id", "turn", "role", _lines(F.col("text")).alias("lines"))
    lines = lines.select("conv_id", "turn", "role", _owned(F.col("lines")).alias("own"), F.filter("lines", lambda x: x["level"] > 0).alias("quoted"))
    return lines.withColumn("content", F.regexp_replace(F.array_join(F.transform("own", lambda x: x["line"]), "\n"), r"^\s+|\s+$", ""))


#: Between passages, and between a passage's level and its text; texts are rid of them.
PASSAGE, LEVEL = "\u0001", "\u0002"
SENTENCE = "[^.!?]+[.!?]*"


def _units(lines: Column) -> Column:
    """(level, line) of all lines and of all sentences of passages, normalised."""
    clean = lambda x: F.translate(x["line"], PASSAGE + LEVEL, "")
    goes_on = lambda x, i: (i > 0) & (F.try_element_at(lines, i)["level"] == x["level"]) & (F.trim(F.try_element_at(lines, i)["line"]) != "") & (F.trim(x["line"]) != "")
    marked = F.transform(lines, lambda x, i: F.concat(F.when(goes_on(x, i), F.lit(" ")).otherwise(F.concat(F.lit(PASSAGE), x["level"].cast("string"), F.lit(LEVEL))), clean(x)))
    passages = F.filter(F.split(F.array_join(marked, ""), PASSAGE), lambda p: p != "")
    level = lambda p: F.substring_index(p, LEVEL, 1).cast("int")
    found = lambda p: F.transform(F.regexp_extract_all(_normal(F.substring_index(p, LEVEL, -1)), F.lit(f"({SENTENCE})"), F.lit(1)), lambda t: F.struct(level(p).alias("level"), F.trim(t).alias("line")))
    return F.concat(F.transform(lines, lambda x: F.struct(x["level"].alias("level"), _normal(clean(x)).alias("line"))), F.flatten(F.transform(passages, found)))


def link(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to): for messages with a quotation that is found."""
    known = parsed.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    line = lambda name: known.where(F.size(name) > 0).select("conv_id", "turn", F.explode(_units(F.col(name))).alias("x")).select("conv_id", "turn", "x.level", "x.line").where("line <> ''").withColumn("key", F.xxhash64("line", F.char_length("line")))
    quoted = line("quoted").groupBy("conv_id", "key", "turn").agg(F.max(F.char_length("line")).alias("weight"), F.min("level").alias("level"))
    own = line("own").select("conv_id", "key", "turn").distinct().join(quoted.select("conv_id", "key").distinct(), ["conv_id", "key"], "left_semi")
    # both kinds of lines in turn order: a quoted one looks back to the last own one (own lines of its own turn don't count)
    both = quoted.select("conv_id", "key", "turn", "weight", "level", F.lit(0).alias("kind")).unionByName(own.select("conv_id", "key", "turn", F.lit(None).cast("int").alias("weight"), F.lit(None).cast("int").alias("level"), F.lit(1).alias("kind")))
    back = Window.partitionBy("conv_id", "key").orderBy("turn", "kind").rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("origin", F.last(F.when(F.col("kind") == 1, F.col("turn")), ignorenulls=True).over(back)).where("kind = 0 and origin is not null")
    votes = seen.groupBy("conv_id", "turn", "origin").agg(F.sum(F.col("weight") / F.col("level")).alias("votes"))
    return votes.groupBy("conv_id", "turn").agg(F.max_by("origin", F.struct("votes", "origin")).alias("reply_to"))


def threads(links: DataFrame) -> DataFrame:
    """Add ``thread``: each message's pointer jumps to its pointer's pointer until none moves, so long chains take few rounds."""
    pointer = shared.materialize(links.withColumn("thread", F.col("reply_to")), "links")
    while True:
        far = pointer.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("further"))
        moved = pointer.join(far, ["conv_id", "thread"], "left")
        if not moved.where("further is not null").limit(1).count():
            return pointer
        before, pointer = pointer, shared.materialize(moved.select("conv_id", "turn", "reply_to", F.coalesce("further", "thread").alias("thread")), "links")
        shared.discard(before)


def format_chats(messages: DataFrame) -> DataFrame:
    """conv_id, thread, turn, role, reply_to, n_quoted (quoted lines), quote_depth, content; sorted by (conv_id, thread, turn) they are in reply order."""
    parsed = parse(messages)
    linked = threads(link(parsed)).withColumnsRenamed({"conv_id": "c", "turn": "t"})
    out = parsed.join(linked, (parsed["conv_id"] == linked["c"]) & (parsed["turn"] == linked["t"]), "left")
    depth = F.coalesce(F.array_max(F.transform("quoted", lambda x: x["level"])), F.lit(0))
    return out.select("conv_id", F.coalesce("thread", "turn").alias("thread"), "turn", "role", "reply_to", F.size("quoted").cast("long").alias("n_quoted"), depth.cast("long").alias("quote_depth"), "content")


ORACLE_SQL = r"""
WITH RECURSIVE l AS (SELECT row_number() OVER () AS m, conv_id, turn, role, string_split_regex(coalesce(text, ''), '\r?\n') AS parts FROM conversations),
p AS (SELECT m, conv_id, turn, role, unnest(range(1, len(parts) + 1)) AS i, parts FROM l),
q AS (SELECT m, conv_id, turn, role, i, regexp_replace(parts[i], '^[ \t]*((?:>[ \t]*)+)', '') AS line,
             length(regexp_replace(regexp_extract(parts[i], '^[ \t]*((?:>[ \t]*)+)', 1), '[^>]', '', 'g')) AS level FROM p),
w AS (SELECT *, coalesce(lead(level) OVER (PARTITION BY m ORDER BY i), 0) AS following FROM q),
k AS (SELECT *, level = 0 AND NOT (regexp_matches(line, '(?i)\bwrote:[ \t]*$') AND following > 0) AS own,
             trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS norm FROM w),
s AS (SELECT *, CASE WHEN own THEN 0 ELSE level END AS lv FROM k WHERE own OR level > 0),
g AS (SELECT *, sum(CASE WHEN prev = lv AND trim(before) <> '' AND trim(line) <> '' THEN 0 ELSE 1 END) OVER (PARTITION BY m, own ORDER BY i) AS passage
      FROM (SELECT *, lag(lv) OVER (PARTITION BY m, own ORDER BY i) AS prev, lag(line) OVER (PARTITION BY m, own ORDER BY i) AS before FROM s)),
pt AS (SELECT m, conv_id, turn, own, min(lv) AS level, trim(regexp_replace(lower(string_agg(line, ' ' ORDER BY i)), '\s+', ' ', 'g')) AS body FROM g GROUP BY m, conv_id, turn, own, passage),
un AS (SELECT conv_id, turn, own, lv AS level, norm FROM s UNION ALL SELECT conv_id, turn, own, level, trim(unnest(regexp_extract_all(body, '[^.!?]+[.!?]*'))) FROM pt),
votes AS (SELECT conv_id, turn, origin, sum(weight) AS votes FROM (
            SELECT a.conv_id, a.turn, a.norm, max(length(a.norm)) / min(a.level) AS weight, max(b.turn) AS origin
            FROM un a JOIN un b ON a.conv_id = b.conv_id AND a.norm = b.norm AND b.own AND b.turn < a.turn
            WHERE a.level > 0 AND a.norm <> '' GROUP BY ALL) GROUP BY ALL),
link AS (SELECT conv_id, turn, max_by(origin, (votes, origin)) AS reply_to FROM votes GROUP BY ALL),
up AS (SELECT conv_id, turn, reply_to, reply_to AS thread FROM link
       UNION ALL SELECT up.conv_id, up.turn, up.reply_to, link.reply_to FROM up JOIN link ON up.conv_id = link.conv_id AND up.thread = link.turn),
top AS (SELECT conv_id, turn, min(reply_to) AS reply_to, min(thread) AS thread FROM up GROUP BY ALL)
SELECT k.conv_id, coalesce(any_value(thread), k.turn) AS thread, k.turn, role, any_value(reply_to) AS reply_to,
       count(*) FILTER (level > 0) AS n_quoted, max(level)::BIGINT AS quote_depth,
       regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (own), ''), '^\s+|\s+$', '', 'g') AS content
FROM k LEFT JOIN top ON k.conv_id = top.conv_id AND k.turn = top.turn GROUP BY m, k.conv_id, k.turn, role
"""
