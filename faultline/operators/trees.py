"""Files of a commit as rows: listings, searches, windows of numbered lines, and texts that hold other texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import patterns as P
from faultline.operators.history import cut
from faultline.operators.rules import spread

#: Bytes of quotes, or of hashes of their windows, that are broadcast, at most.
SMALL_BYTES = 8 << 20
#: Tokens of a window that a quote is looked for by; letters, where a quote has no whole token inside.
WINDOW, GRAMS = 3, (8, 4, 2, 1)


def list_files(files: DataFrame, directory: str, most: int = P.MAX_LISTED) -> DataFrame:
    """total, rank, path: the first paths under a directory ('' for all), in order, beside the number of all."""
    mine = files.where(F.startswith("path", F.lit(f"{directory}/"))) if directory else files
    total = mine.agg(F.count("*").alias("total"))
    # rank among the few that are shown
    shown = mine.select("path").orderBy("path").limit(most)
    return shown.withColumn("rank", F.row_number().over(Window.orderBy("path"))).join(F.broadcast(total)).select("total", "rank", "path")


def search_code(files: DataFrame, pattern: str, directory: str = "", each: int = 3, most: int = 40) -> DataFrame:
    """path, number, text of lines that hold a fixed text: the first few of each file, the first `most` of all by path."""
    if len(pattern.strip()) < P.MIN_PATTERN:
        raise ValueError(f"a pattern has {P.MIN_PATTERN} characters at least")
    mine = files.where(F.startswith("path", F.lit(f"{directory}/"))) if directory else files
    lines = F.transform(F.split("content", "\n"), lambda x, k: F.struct((k + 1).alias("number"), x.alias("text")))
    hits = F.slice(F.filter(lines, lambda x: F.contains(x["text"], F.lit(pattern.strip()))), 1, each)
    found = mine.where(F.contains("content", F.lit(pattern.strip()))).select("path", F.explode(hits).alias("h")).select("path", "h.number", "h.text")
    return found.orderBy("path", "number").limit(most)


def read_window(files: DataFrame, start: str, most_chars: int = P.MAX_READ, most_lines: int = P.MAX_LINES) -> DataFrame:
    """path, first, last, total, body, head: numbered lines from a start (a column; null: the first) as far as the budget goes.

    At least one line is shown. The head names the lines that are really shown and, if more follow, where to go on. Files that hold a NUL in their first 8,000 characters are binary and have no row.
    """
    text = files.where(~F.contains(F.substring("content", 1, 8000), F.lit("\x00")))
    lines = F.split("content", P.LINE_END)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    text = text.select("path", lines.alias("lines"), F.col(start).alias("start")).withColumn("total", F.size("lines"))
    text = text.withColumn("first", F.greatest(F.lit(1), F.least(F.coalesce("start", F.lit(1)).cast("int"), F.greatest("total", F.lit(1)))))
    rows = F.transform(F.slice("lines", F.col("first"), F.lit(most_lines + 1)), lambda x, k: F.concat(F.lpad((k + F.col("first")).cast("string"), 5, " "), F.lit("  "), x))
    text = text.withColumn("rows", rows)
    fits = f"aggregate(rows, struct(0 AS used, 0 AS n, true AS open), (s, x) -> CASE WHEN s.open AND (s.n = 0 OR s.used + length(x) + 1 <= {most_chars}) THEN struct(s.used + length(x) + 1 AS used, s.n + 1 AS n, true AS open) ELSE struct(s.used AS used, s.n AS n, false AS open) END).n"
    text = text.withColumn("n", F.expr(fits))
    text = text.withColumn("last", F.col("first") + F.col("n") - 1)
    more = F.when(F.col("last") < F.col("total"), F.concat(F.lit("; "), (F.col("total") - F.col("last")).cast("string"), F.lit(' more, go on with "start_line": '), (F.col("last") + 1).cast("string")))
    head = F.concat(F.col("path"), F.format_string(" lines %d-%d of %d", "first", "last", "total"), F.coalesce(more, F.lit("")))
    return text.select("path", "first", "last", "total", F.array_join(F.slice("rows", F.lit(1), F.col("n")), "\n").alias("body"), head.alias("head"))


def _tokens(text: str) -> Column:
    """The parts between whitespace, with an empty one before or after whitespace at an end."""
    return F.split(text, r"[\x09-\x0D ]+")


def _windows(tokens: Column, size: int) -> Column:
    """Hashes of each so many consecutive tokens."""
    hashes = F.transform(tokens, lambda x, k: F.xxhash64(F.lit(size), x, *[F.get(tokens, k + j) for j in range(1, size)]))
    return F.slice(hashes, F.lit(1), F.greatest(F.size(tokens) - (size - 1), F.lit(0)))


def _pieces(text: str) -> Column:
    """Runs of whitespace and runs of anything else."""
    return F.regexp_extract_all(text, F.lit(r"[^\x09-\x0D ]+|[\x09-\x0D ]+"), F.lit(0))


def _grams(pieces: Column, size: int) -> Column:
    """Hashes of each so many consecutive letters of a piece."""
    long = F.array_distinct(F.filter(pieces, lambda p: F.length(p) >= size))
    return F.flatten(F.transform(long, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - (size - 1)), lambda k: F.xxhash64(F.lit(-size), p.substr(k, F.lit(size))))))


def _signs(tokens: Column, pieces: Column, sizes: list[int]) -> Column:
    """What a text is found by: windows of tokens (positive sizes) and grams (negative ones), each once."""
    return F.array_distinct(F.concat(*[_windows(tokens, n) if n > 0 else _grams(pieces, -n) for n in sizes]))


def holders(texts: DataFrame, quotes: DataFrame, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """key, quote_key of each text (key, text) that holds a quote (quote_key, quote) letter by letter; empty quotes are in none.

    A quote is looked for by the one of its windows of three whole tokens that fewest texts have, or by its rarest whole
    token. One without a whole token inside is looked for by the first letters of its longest piece. Texts that have
    this sign are held against the quote. Equal quotes are looked for once; a row of texts is answered for itself, also
    where keys repeat or are null. Many texts that share the rarest sign of a quote without holding it are candidates
    all the same.
    """
    inside = F.expr("slice(tokens, 2, greatest(size(tokens) - 2, 0))")
    asked = quotes.where("quote <> ''").select("quote").distinct().withColumn("tokens", _tokens("quote")).withColumn("inside", inside)
    longest = F.reduce(_pieces("quote"), F.lit(""), lambda best, p: F.when(F.length(p) > F.length(best), p).otherwise(best))
    asked = asked.withColumn("piece", F.when(F.size("inside") == 0, longest))
    gram = F.lit(-GRAMS[-1])
    for size in reversed(GRAMS[:-1]):
        gram = F.when(F.length("piece") >= size, -size).otherwise(gram)
    asked = asked.withColumn("kind", F.when(F.size("inside") >= WINDOW, WINDOW).when(F.size("inside") > 0, 1).otherwise(gram))
    first = F.array(F.expr("xxhash64(kind, substring(piece, 1, -kind))"))
    asked = asked.withColumn("signs", F.when(F.col("kind") == WINDOW, _windows(F.col("inside"), WINDOW)).when(F.col("kind") == 1, _windows(F.col("inside"), 1)).otherwise(first))
    known = asked.agg(F.sort_array(F.collect_set("kind")).alias("kinds"), F.sum(F.size("signs") * 8).alias("signs"), F.sum(F.octet_length("quote")).alias("quotes")).first()
    if not known.kinds:
        return texts.select("key").join(quotes.select("quote_key"), F.lit(False))
    small = lambda rows, size: F.broadcast(rows) if size <= small_bytes else rows
    parts = spread(texts.select("key", "text")).select("key", _tokens("text").alias("tokens"), (_pieces("text") if known.kinds[0] < 0 else F.lit(None)).alias("pieces"))
    signs = parts.select("key", F.explode(_signs(F.col("tokens"), F.col("pieces"), known.kinds)).alias("sign"))
    sought = asked.select("quote", F.explode(F.array_distinct("signs")).alias("sign"))
    # texts are cut into signs once; of those only the ones that a quote has go on
    signs = cut(signs.join(small(sought.select("sign").distinct(), known.signs), "sign", "left_semi"))
    counts = signs.groupBy("sign").agg(F.count("*").alias("n"))
    # a sign that no text has tells that no text holds the quote
    rarest = sought.join(counts, "sign", "left").groupBy("quote").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "sign")).alias("best"))
    rarest = rarest.where("best.n > 0").select("quote", F.col("best.sign").alias("sign"))
    maybe = signs.join(small(rarest, known.quotes), "sign").select(F.col("key").alias("found"), "quote").distinct()
    held = texts.select("key", "text").join(maybe, F.col("key").eqNullSafe(F.col("found"))).where(F.contains("text", F.col("quote"))).select("key", "quote")
    return held.join(quotes.select("quote_key", "quote"), "quote").select("key", "quote_key")
