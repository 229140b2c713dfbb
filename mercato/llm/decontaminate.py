"""Benchmark passages in documents by a prefix-filtered set join.

An item is cut into windows of ``WINDOW`` consecutive words, a window into its
shingles of ``SHINGLE`` words (a shorter window is its own shingle).  A
document holds a window only if it holds all its shingles, so of a window's
shingles, ordered by how often they occur in the documents, the rarest one is
the prefix that a join must meet; windows of which a shingle never occurs are
out at once.  Where the prefix is met, its place in the window tells where the
window would begin: it must lie within the document, and its words must be the
document's words there.

All of it is built-in expressions.  Documents are cut into words twice, once to
count the items' shingles and once to find the prefixes, without a shuffle of
their words: a bitmap of fixed size, made for the shingles looked for, lets
through those and a few more, and only what passes is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import written
from mercato.llm.merkle import lower_ascii

#: What lies between words (of lower-cased text).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 5
#: Bits of the bitmap per shingle, and its least and greatest size as powers of two (8 KB and 4 MB).
BITS, LEAST, MOST = 32, 16, 25


def words_of(text: Column) -> Column:
    """The words of ``text``, A-Z in lower case; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda word: F.xxhash64(word))


def _shingle(hashes: Column, at: Column, size: int) -> Column:
    """The hash of the ``size`` words from place ``at`` (from 0), given the hashes of all words."""
    return F.xxhash64(*(F.get(hashes, at + k) for k in range(size)), F.lit(size))


class Bitmap:
    """A bitmap of hashes, as a scalar subquery of 64-bit words; it may let others through, too."""

    def __init__(self, hashes: DataFrame, count: int):
        power = min(MOST, max(LEAST, (BITS * count).bit_length()))
        self.mask = (1 << power) - 1
        bit = hashes.select(F.col("shingle").bitwiseAND(self.mask).alias("bit"))
        word, one = F.shiftright("bit", 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(63).cast("int"))
        rows = bit.select(word.alias("word"), one.alias("ones"))
        # Every word once, so that its place in the list is its number: 2 ** 19 rows at most.
        rows = rows.unionByName(hashes.sparkSession.range(1 << power - 6).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("ones")))
        rows = rows.groupBy("word").agg(F.bit_or("ones").alias("ones"))
        listed = rows.agg(F.array_sort(F.collect_list(F.struct("word", "ones"))).alias("all"))
        self.words = listed.select(F.col("all.ones")).scalar()

    def has(self, shingle: Column) -> Column:
        bit = shingle.bitwiseAND(self.mask)
        held = F.get(self.words, F.shiftright(bit, 6).cast("int"))
        return F.call_function("shiftright", held, bit.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def item_windows(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``item`` and ``window`` (list of words) of all items that have words: ``WINDOW`` consecutive words, or all if fewer."""
    cut = items.select(items[item].alias("item"), words_of(items[text]).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW, F.lit(0)))
    cut = cut.select("item", "words", F.explode(starts).alias("start"))
    return cut.select("item", F.slice("words", F.col("start") + 1, WINDOW).alias("window")).distinct()


def _places(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, ``hashes`` of ``words`` and each place ``at`` of them; a row with null ``at`` for texts without words."""
    hashed = docs.select(*keep, _hashes(F.col("words")).alias("hashes"))
    return hashed.select(*keep, "hashes", F.posexplode_outer("hashes").alias("at", "hash")).drop("hash")


def _matches(sizes: list[int], bitmap: Bitmap) -> Column:
    """Per place of a document: whether a shingle of one of ``sizes`` that the bitmap has begins there."""
    any_size = F.lit(False)
    for size in sizes:
        fits = F.col("at") + size <= F.size("hashes")
        any_size = any_size | (fits & bitmap.has(_shingle(F.col("hashes"), F.col("at"), size)))
    return any_size


def _shingles_at(sizes: list[int]) -> Column:
    """The shingles of all ``sizes`` at a place, null for those that don't fit.

    No lambda here: it would part the projection from the generator, and all
    places of a document would wait between them with all its words each.
    """
    each = [F.when(F.col("at") + size <= F.size("hashes"), _shingle(F.col("hashes"), F.col("at"), size)) for size in sizes]
    return F.array(*each)


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """Where windows of ``items`` occur in ``docs``.

    A row per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit`` (words inside
    an occurrence of a window), ``item_ids`` (of items with an occurring
    window, as strings, sorted).  Null and empty texts, and items without
    words, have no words.  Items without ``item_id`` mark words but are not
    listed.  Repeated documents are a row each, repeated items count once.
    Empty tables give no rows, or rows without hits.  Other columns of both
    tables are ignored whatever their names.
    """
    spelled = written(item_windows(items), "leak-items")
    windows = written(spelled.select("window").distinct().withColumn("id", F.monotonically_increasing_id()), "leak-windows")
    owners = spelled.filter("item is not null").join(windows, "window").select("id", F.col("item").cast("string").alias("item"))
    length = F.least(F.size("window"), F.lit(SHINGLE))
    sizes = sorted(row["size"] for row in windows.select(length.alias("size")).distinct().collect())  # of 1 to SHINGLE
    docs = docs.select("doc_id", docs[text].alias("text"))
    if not sizes:
        counted = docs.select("doc_id", F.size(words_of(F.col("text"))).alias("n_words"))
        return counted.select("doc_id", F.col("n_words").cast("long"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("item_ids"))

    spread = windows.select("id", "window", length.alias("size"), F.size("window").alias("length"))
    spread = spread.select("*", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("size"))).alias("offset"))
    hashed = F.coalesce(*(F.when(F.col("size") == size, _shingle(_hashes(F.col("window")), F.col("offset"), size)) for size in sizes))
    shingles = written(spread.select("id", "window", "length", "offset", hashed.alias("shingle")), "leak-shingles")

    # How often the items' shingles occur in the documents; those that don't are not listed.
    wanted = shingles.select("shingle").distinct()
    bitmap = Bitmap(wanted, wanted.count())
    places = _places(docs.select(words_of(F.col("text")).alias("words")), [])
    seen = places.filter(_matches(sizes, bitmap)).select(_shingles_at(sizes).alias("shingles")).select(F.explode("shingles").alias("shingle"))
    counts = seen.filter("shingle is not null").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    ranked = shingles.join(counts, "shingle", "left")
    rarest = ranked.groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("least"), F.first("window").alias("window"))
    prefixes = rarest.filter("least.n > 0").select("id", "window", F.size("window").alias("length"), "least.shingle", "least.offset")
    prefixes = written(prefixes, "leak-prefixes")

    # Places where a prefix may begin, with the words around them, and the first place of every document.
    wanted = prefixes.select("shingle").distinct()
    bitmap = Bitmap(wanted, wanted.count())
    reach = WINDOW - sizes[0]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words"))
    places = _places(rows, ["row", "doc_id", "words"])
    met = _matches(sizes, bitmap)
    begin = F.greatest(F.col("at") - reach, F.lit(0))
    places = places.filter(F.col("at").isNull() | (F.col("at") == 0) | met).select(
        "row",
        "doc_id",
        F.size("hashes").cast("long").alias("n_words"),
        "at",
        F.when(met, _shingles_at(sizes)).alias("shingles"),
        begin.alias("begin"),
        F.when(met, F.slice("words", begin + 1, reach + WINDOW)).alias("near"),
    )
    places = written(places, "leak-places")

    start = F.col("at") - F.col("offset")
    inside = (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    same = F.slice("near", F.greatest(start - F.col("begin"), F.lit(0)) + 1, F.col("length")) == F.col("window")
    candidates = places.filter("shingles is not null").select("row", "at", "n_words", "begin", "near", F.explode("shingles").alias("shingle"))
    found = candidates.filter("shingle is not null").join(prefixes, "shingle").filter(inside & same)
    found = written(found.select("row", start.alias("start"), (start + F.col("length")).alias("end"), "id"), "leak-found")

    spans = found.groupBy("row", "start").agg(F.max("end").alias("end"))
    before = F.max("end").over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce("before", F.lit(0))), F.lit(0))
    hits = spans.withColumn("before", before).groupBy("row").agg(F.sum(new).alias("n_hit"))
    held = found.select("row", "id").distinct().join(owners, "id").select("row", "item").distinct()
    held = held.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    rows = places.filter("at is null or at = 0").select("row", "doc_id", "n_words")
    rows = rows.join(hits, "row", "left").join(held, "row", "left")
    none = F.array().cast("array<string>")
    return rows.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"))


def decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` per document; see ``find_leaks``."""
    leaks = find_leaks(docs, items)
    return leaks.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
