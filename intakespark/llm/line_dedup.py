"""Line dedup over content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines ends a chunk wherever it
divides by ``MODULUS``, so chunk borders follow content and survive lines put
in or taken out elsewhere. A chunk of several lines that occurs more than once
in the whole corpus is removed everywhere but at its first place (least
doc_id, then place), after its bytes have been compared with the kept ones.

Only hashes are grouped over the whole corpus; texts move only for the chunks
whose hash repeats, and to put documents together again.

Chunks find a repeated passage only between two borders. ``remove_repeated_runs``
takes repeated passages whole: every pair of neighbouring lines is an anchor, and
anchors side by side make up a run of any length from two lines on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import Scratch

MODULUS = 3
#: A removable chunk has at least this many lines and characters.
LEAST_LINES, LEAST_CHARS = 2, 40
#: A single repeated line goes by itself if it has more words than this.
LONG_WORDS = 50
_WORD = r"[^\x20\x09-\x0D]+"


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def _bind(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunk_lines(text: Column, modulus: int = MODULUS) -> Column:
    """array<struct<lines int, chunk string>> of a text, in order; joined by line feeds they give the text again.

    Line i ends a chunk where 31 times its hash and the hash of the line before it divide by ``modulus``.
    """

    def cut(lines: Column, hashes: Column) -> Column:
        ends_here = lambda i: (i == F.size(lines) - 1) | (F.pmod(F.get(hashes, i) * 31 + F.coalesce(F.get(hashes, i - 1), F.lit(0)), F.lit(modulus)) == 0)
        return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), ends_here)

    def join(lines: Column, ends: Column) -> Column:
        begin = lambda k: F.when(k == 0, 0).otherwise(F.get(ends, k - 1) + 1)
        return F.transform(ends, lambda e, k: F.struct((e - begin(k) + 1).alias("lines"), F.array_join(F.slice(lines, begin(k) + 1, e - begin(k) + 1), "\n").alias("chunk")))

    # Each step is bound once: an expression that a lambda repeats would be computed again for every line.
    hashed = lambda lines: _bind(F.transform(lines, line_hash), lambda hashes: _bind(cut(lines, hashes), lambda ends: join(lines, ends)))
    return _bind(F.split(text, "\n", -1), hashed)


def _removable(c: Column, least_lines: int, least_chars: int) -> Column:
    return (c["lines"] >= least_lines) & (F.length(c["chunk"]) >= least_chars)


def remove_repeated_chunks(docs: DataFrame, modulus: int = MODULUS, least_lines: int = LEAST_LINES, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Replace ``text`` by what is left of it; add n_lines, n_chunks and n_removed.

    ``docs`` has doc_id and text; other columns and all rows are kept, columns named like the added ones are
    replaced. Rows alike in doc_id and text count as one document and are treated alike, so none of them loses its
    chunks to another. A null text stays null with no lines; null doc_ids come last in order. An empty table gives an
    empty one.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    docs = docs.drop("n_lines", "n_chunks", "n_removed")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("row"), F.col("text").alias("body")).where(F.col("body").isNotNull())
    cut = keyed.select("doc_id", "row", F.posexplode(chunk_lines(F.col("body"), modulus)).alias("at", "c"))
    marked = cut.where(_removable(F.col("c"), least_lines, least_chars)).select("doc_id", "row", "at", F.xxhash64("c.chunk").alias("hash"), "c.chunk")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "at")
    repeated = marked.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("first") < F.col("last"))
    met = scratch.keep(marked.join(repeated.select("hash", "first"), "hash").withColumn("kept", place == F.col("first")))
    firsts = met.where("kept").select("hash", F.col("chunk").alias("original")).distinct()
    gone = met.where(~F.col("kept")).join(firsts, "hash").where(F.col("chunk") == F.col("original"))
    lists = gone.groupBy("doc_id", "row").agg(F.collect_set("at").alias("gone"))

    # The input's columns travel in a struct, so that none of them can clash with those added here.
    d, g = docs.select(F.struct(*docs.columns).alias("own"), "doc_id", F.xxhash64("text").alias("row")).alias("d"), lists.alias("g")
    both = d.join(g, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.row") == F.col("g.row")), "left")
    chunks = F.col("chunks")
    out = both.select("own", F.col("own.text").alias("text"), "g.gone", chunk_lines(F.col("own.text"), modulus).alias("chunks"))
    left = F.filter(F.transform(chunks, lambda c, i: F.struct(c["chunk"].alias("chunk"), i.alias("i"))), lambda c: ~F.array_contains("gone", c["i"]))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda c: c["chunk"]), "\n"))
    return out.select(
        *(text.alias("text") if c == "text" else F.col("own")[c].alias(c) for c in docs.columns),
        F.when(F.col("text").isNull(), 0).otherwise(F.aggregate(chunks, F.lit(0), lambda s, c: s + c["lines"])).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(chunks)).cast("long").alias("n_chunks"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )


def _line_keys(text: Column) -> Column:
    """The key of line i at place 2i (null where it has no word: no rule is about such a line alone) and that of lines i and i + 1 together at place 2i + 1 (null after the last): 128 bits of SHA-256."""
    key = lambda t: F.unhex(F.substring(F.sha2(t.cast("binary"), 256), 1, 32))
    both = lambda lines, x, i: F.when(i < F.size(lines) - 1, key(F.concat_ws("\n", x, F.get(lines, i + 1))))
    return _bind(F.split(text, "\n", -1), lambda lines: F.flatten(F.transform(lines, lambda x, i: F.array(F.when(x.rlike(_WORD), key(x)), both(lines, x, i)))))


def _lines_gone(lines: Column, pairs: Column, singles: Column, elsewhere: Column, least_chars: int, long_words: int) -> Column:
    """Places of the lines to remove, by the places of repeated pairs, of repeated lines and of lines of earlier documents."""

    def of_runs(p: Column) -> Column:
        first = F.filter(p, lambda x, i: F.coalesce(F.get(p, i - 1), F.lit(-2)) != x - 1)
        last = F.filter(p, lambda x, i: F.coalesce(F.get(p, i + 1), F.lit(-2)) != x + 1)
        runs = F.zip_with(first, last, lambda a, b: F.struct(a.alias("a"), (b + 1).alias("b")))
        fit = F.filter(runs, lambda r: F.length(F.array_join(F.slice(lines, r["a"] + 1, r["b"] - r["a"] + 1), "\n")) >= least_chars)
        return F.flatten(F.transform(fit, lambda r: F.sequence(r["a"], r["b"])))

    places = F.sequence(F.lit(0), F.size(lines) - 1)
    worded = F.filter(places, lambda i: F.get(lines, i).rlike(_WORD))
    whole = _bind(worded, lambda w: (F.size(w) > 0) & (F.size(F.array_except(w, elsewhere)) == 0))
    long = F.filter(singles, lambda i: F.regexp_count(F.get(lines, i), F.lit(_WORD)) > long_words)
    return F.when(whole, places).otherwise(F.array_union(_bind(F.array_sort(pairs), of_runs), long))


def remove_repeated_runs(docs: DataFrame, least_chars: int = LEAST_CHARS, long_words: int = LONG_WORDS) -> DataFrame:
    """Replace ``text`` by what is left of it without repeated passages; add n_lines and n_removed, both in lines.

    Out go, by their place in order of doc_id and line,

    * runs of two lines or more, of ``least_chars`` characters, of which every pair of neighbours occurs before,
    * lines of more than ``long_words`` words that occur before,
    * all lines of a document whose every line (blank ones apart) an earlier document has, exact copies among them.

    The first place of a line never goes, so no line is lost to the corpus. Columns and rows are kept as by
    ``remove_repeated_chunks``, and rows alike in doc_id and text count as one document here too.
    """
    docs = docs.drop("n_lines", "n_removed")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("row"), F.col("text").alias("body")).where(F.col("body").isNotNull())
    units = keyed.select("doc_id", "row", F.posexplode(_line_keys(F.col("body"))).alias("at", "key")).where(F.col("key").isNotNull())
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "at")
    repeated = units.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("first") < F.col("last")).select("key", "first")
    met = units.join(repeated, "key").where(place != F.col("first"))
    other = ~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) | (F.col("row") != F.col("first.row"))
    pair, at = F.col("at") % 2 == 1, F.floor(F.col("at") / 2).cast("int")
    lists = met.groupBy("doc_id", "row").agg(F.collect_set(F.when(pair, at)).alias("pairs"), F.collect_set(F.when(~pair, at)).alias("singles"), F.collect_set(F.when(~pair & other, at)).alias("elsewhere"))

    d, g = docs.select(F.struct(*docs.columns).alias("own"), "doc_id", F.xxhash64("text").alias("row")).alias("d"), lists.alias("g")
    both = d.join(g, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.row") == F.col("g.row")), "left")

    def cut(lines: Column) -> Column:
        gone = _lines_gone(lines, F.col("pairs"), F.col("singles"), F.col("elsewhere"), least_chars, long_words)
        left = lambda g: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), g)
        return _bind(gone, lambda g: F.struct(F.array_join(F.transform(left(g), lambda i: F.get(lines, i)), "\n").alias("text"), F.size(g).cast("long").alias("n")))

    out = both.select("own", F.when(F.col("g.pairs").isNotNull() & F.col("own.text").isNotNull(), _bind(F.split("own.text", "\n", -1), cut)).alias("cut"))
    text = F.when(F.col("cut.n") > 0, F.col("cut.text")).otherwise(F.col("own.text"))
    return out.select(
        *(text.alias("text") if c == "text" else F.col("own")[c].alias(c) for c in docs.columns),
        F.when(F.col("own.text").isNull(), 0).otherwise(F.size(F.split("own.text", "\n", -1))).cast("long").alias("n_lines"),
        F.coalesce(F.col("cut.n"), F.lit(0)).cast("long").alias("n_removed"),
    )


OP3_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d
), h AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM l
), b AS (
  SELECT *, CASE WHEN (h * 31 + coalesce(lag(h) OVER w, 0)) % {MODULUS} = 0 THEN 1 ELSE 0 END AS ends FROM h WINDOW w AS (PARTITION BY doc_id, text ORDER BY i)
), n AS (
  SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id, text ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM b
), c AS (
  SELECT doc_id, text, pos, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS chunk FROM n GROUP BY doc_id, text, pos
), r AS (
  SELECT *, lines >= {LEAST_LINES} AND length(chunk) >= {LEAST_CHARS} AS fit,
    row_number() OVER (PARTITION BY chunk, lines >= {LEAST_LINES} AND length(chunk) >= {LEAST_CHARS} ORDER BY doc_id NULLS LAST, text, pos) AS place FROM c
), o AS (
  SELECT doc_id, text, CAST(sum(lines) AS BIGINT) AS n_lines, count(*) AS n_chunks, count(*) FILTER (fit AND place > 1) AS n_removed,
    coalesce(string_agg(chunk, chr(10) ORDER BY pos) FILTER (NOT (fit AND place > 1)), '') AS left_text
  FROM r GROUP BY doc_id, text
)
SELECT s.doc_id, CASE WHEN s.text IS NULL THEN NULL ELSE o.left_text END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_removed, 0) AS n_removed
FROM documents s LEFT JOIN o ON s.doc_id IS NOT DISTINCT FROM o.doc_id AND s.text = o.text
"""
