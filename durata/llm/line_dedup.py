"""Lines that many documents share, as keep bitmaps: native Spark throughout.

Every line that is long enough becomes a row of hashes and numbers.  The rows are
range-partitioned by hash and sorted within by document and position, so one pass
over each range meets a key's first occurrence first and knows the rest of its
rows for repeats.  What comes back is a run-length bitmap per document; the text
itself meets its bitmap only where somebody asks for what is left of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.hot import hot_hashes
from .tables import scratch, stored, unused

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = " \t\x0b\x0c\r"


def lines(text: Column) -> Column:
    """The lines of a whole text, parted at newlines; null and empty texts are one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """What lines are compared by: A-Z lower-cased, blanks stripped at both ends."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.transform(F.split(low, "\n", -1), lambda x: F.btrim(x, F.lit(_BLANKS)))


def _dropped(rows: DataFrame, least_docs: int) -> DataFrame:
    """``(_d, _t, _p)``: rows of keys in ``least_docs`` documents or more, but for those of the largest document.

    Keys with more than one in 500 of all rows are found first.  Their few numbers,
    largest document and count of documents, come from partial aggregates and are
    broadcast (fewer than 500 rows), so their rows stay where they are.
    """
    hot = hot_hashes(rows, ["_h1", "_h2"])
    is_hot = F.xxhash64("_h1", "_h2").isin(hot) if hot else F.lit(False)
    ranged = rows.filter(~is_hot).repartitionByRange("_h1", "_h2")
    key = Window.partitionBy("_h1", "_h2")
    nth = F.dense_rank().over(key.orderBy(F.col("_d").desc_nulls_last()))  # the document's place among those of the key
    cold = ranged.withColumn("_nth", nth).withColumn("_docs", F.max("_nth").over(key)).filter((F.col("_nth") > 1) & (F.col("_docs") >= least_docs)).select("_d", "_t", "_p")
    if not hot:
        return cold
    many = rows.filter(is_hot)
    facts = many.groupBy("_h1", "_h2").agg(F.count_distinct(F.struct("_d")).alias("_docs"), F.max(F.struct("_d")).alias("_top")).filter(F.col("_docs") >= least_docs)
    loses = many.join(F.broadcast(facts), ["_h1", "_h2"]).filter(~F.struct("_d").eqNullSafe(F.col("_top")))
    return cold.unionByName(loses.select("_d", "_t", "_p"))


def line_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """``(id, text_hash, n_dropped, cleared)`` for each document that loses lines: its keep bitmap, run-length coded.

    A line's key is the line, stripped of blanks and with A-Z lower-cased; keys of
    at least ``least_chars`` code points in at least ``least_docs`` documents lose
    all their lines, but for those of the largest document that has them.
    ``cleared`` has the bitmap's runs of zeros, ``(start, length)`` in order, from
    line 0; all other bits are ones.  A document that keeps all has no row here.

    Documents are told apart by id: rows of one id count as one document, a null
    id is a document that comes before all others, and repeated rows (same id and
    text) share one bitmap.  Null and empty texts have no key.  Keys and texts are
    compared by hashes, keys by 128 bits.  Other columns are not read; an empty
    table gives no rows.
    """
    if least_docs < 1:
        raise ValueError("least_docs must be 1 or more")
    docs = df.select(F.col(id_col).alias("_d"), _text_hash(text_col).alias("_t"), line_keys(F.col(text_col)).alias("_ks"))  # once a text, not once a line
    rows = docs.select("_d", "_t", F.posexplode("_ks").alias("_p", "_k")).filter(F.char_length("_k") >= least_chars).select("_d", "_t", "_p", F.xxhash64("_k").alias("_h1"), F.xxhash64(F.lit(1), "_k").alias("_h2"))
    with scratch(df.sparkSession) as keep:
        gone = _dropped(stored(rows), least_docs)
        gone = gone.groupBy("_d", "_t").agg(F.sort_array(F.collect_set("_p")).alias("_gone"))
        out = gone.select(F.col("_d").alias(id_col), F.col("_t").alias("text_hash"), F.size("_gone").cast("long").alias("n_dropped"), F.transform(F.array("_gone"), _runs)[0].alias("cleared"))
        return keep(stored(out))


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _runs(numbers: Column) -> Column:
    """The runs ``(start, length)`` of an ascending array without repeats."""
    first = F.filter(numbers, lambda x, i: (i == 0) | (F.get(numbers, i - 1) != x - 1))
    last = F.filter(numbers, lambda x, i: (i == F.size(numbers) - 1) | (F.get(numbers, i + 1) != x + 1))
    return F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length")))


def kept_lines(text: Column, cleared: Column) -> Column:
    """The text's lines outside the runs of ``cleared``, joined by newlines; all of them where it is null."""
    none = F.array().cast("array<int>")
    first = F.coalesce(F.transform(cleared, lambda r: r["start"]), none)
    after = F.coalesce(F.transform(cleared, lambda r: r["start"] + r["length"]), none)

    def left(own: Column) -> Column:
        parts = F.zip_with(F.concat(F.array(F.lit(0)), after), F.concat(first, F.array(F.size(own))), lambda a, b: F.slice(own, a + 1, b - a))
        return F.array_join(F.flatten(parts), "\n")

    return F.transform(F.array(lines(text)), left)[0]  # one split a text, whatever the number of runs


def without_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """``df`` with ``n_lines``, ``n_dropped``, ``cleared`` and ``kept_text`` by the bitmaps of :func:`line_bitmaps`.

    Texts meet their bitmaps by id and text hash, null ids included.  Names that
    ``df`` has already get an underscore more, in that order, and are added last.
    """
    bits = line_bitmaps(df, id_col, text_col, least_chars, least_docs)
    taken = [unused(c, df.columns) for c in ("n_lines", "n_dropped", "cleared", "kept_text")]
    own = unused("_t", df.columns)
    bits = bits.select(F.col(id_col).alias("_bit_id"), F.col("text_hash").alias("_bit_hash"), F.col("n_dropped").alias("_bit_n"), F.col("cleared").alias("_bit_runs"))
    free = {c: unused(c, [*df.columns, own]) for c in bits.columns}
    bits = bits.withColumnsRenamed(free)
    rows = df.withColumn(own, _text_hash(text_col))
    # bitmaps grow with the documents, so they are never broadcast, however few they are here
    met = rows.join(bits.hint("merge"), rows[id_col].eqNullSafe(bits[free["_bit_id"]]) & (rows[own] == bits[free["_bit_hash"]]), "left")
    runs = F.col(free["_bit_runs"])
    new = (F.size(lines(F.col(text_col))).cast("long"), F.coalesce(free["_bit_n"], F.lit(0)), F.coalesce(runs, F.array().cast("array<struct<start:int,length:int>>")), kept_lines(F.col(text_col), runs))
    return met.select(*df.columns, *[c.alias(name) for c, name in zip(new, taken, strict=True)])
