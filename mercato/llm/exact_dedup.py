"""Exact deduplication by recursive (Grace) hash partitioning.

Records are partitioned by a hash of their normalised text.  Each partition is
read into an open-addressing table that compares complete texts.  A text that
no longer fits goes, with all its later copies, to spill files, which are
partitioned again by other bits of the hash until every partition fits.  The
spill files are tables in the cluster's shared folder, so a lost executor costs
a task and not the run.  Copies met by the same task are merged by a table of
the same kind before anything is shuffled, so a text with very many copies
sends one record per task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import free_name, frugal, one_space, partitions, written

#: Bytes of distinct texts that a table holds.
TABLE_BYTES = 64 << 20

PARTIAL = "hash long, sha string, content string, keep_id long, size long, done boolean"


class OpenTable:
    """Open addressing with linear probing; equality is that of complete contents.

    ``slots`` holds places in the lists, -1 is free.  ``add`` gives False for
    a content that isn't there when ``limit`` bytes are held.
    """

    def __init__(self, limit: int):
        self.limit, self.bytes = limit, 0
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.shas: list[str] = []
        self.contents: list[str] = []
        self.keep: list[int | None] = []
        self.sizes: list[int] = []

    def _grow(self) -> None:
        mask = len(self.slots) * 4 - 1
        slots = [-1] * (mask + 1)
        for place, code in enumerate(self.hashes):
            at = code & mask
            while slots[at] >= 0:
                at = at + 1 & mask
            slots[at] = place
        self.slots = slots

    def add(self, code: int, sha: str, content: str, keep: int | None, size: int) -> bool:
        slots, mask = self.slots, len(self.slots) - 1
        at = code & mask
        while (place := slots[at]) >= 0:
            if self.hashes[place] == code and self.contents[place] == content:
                self.sizes[place] += size
                if keep is not None and (self.keep[place] is None or keep < self.keep[place]):
                    self.keep[place] = keep
                return True
            at = at + 1 & mask
        if self.contents and self.bytes + len(content) > self.limit:
            return False
        slots[at] = len(self.hashes)
        for column, value in zip((self.hashes, self.shas, self.contents, self.keep, self.sizes), (code, sha, content, keep, size)):
            column.append(value)
        self.bytes += len(content)
        if 2 * len(self.hashes) > len(slots):
            self._grow()
        return True

    def rows(self, with_content: bool, done: bool) -> Iterator:
        import pyarrow as pa

        names = [x.split(" ")[0] for x in PARTIAL.split(", ")]
        at = 0
        while at < len(self.hashes):
            upto, size = at, 0
            while upto < len(self.hashes) and (upto == at or size + len(self.contents[upto]) < 4_000_000) and upto - at < 50_000:
                size += len(self.contents[upto])
                upto += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(self.hashes[at:upto], pa.int64()),
                    pa.array(self.shas[at:upto], pa.string()),
                    pa.array(self.contents[at:upto] if with_content else [None] * (upto - at), pa.string()),
                    pa.array(self.keep[at:upto], pa.int64()),
                    pa.array(self.sizes[at:upto], pa.int64()),
                    pa.array([done] * (upto - at)),
                ],
                names,
            )
            at = upto


def _merge(limit: int, last: bool):
    """Merge the records of a partition; ``last``: those that don't fit are left over, else the table is given out and begun anew."""

    def run(batches):
        table = OpenTable(limit)
        over = OpenTable(limit // 4)  # merges what is left over a little
        for batch in batches:
            for record in zip(*(column.to_pylist() for column in batch.columns[:5])):
                if table.add(*record):
                    continue
                if not last:
                    yield from table.rows(True, False)
                    table = OpenTable(limit)
                    table.add(*record)
                elif not over.add(*record):
                    yield from over.rows(True, False)
                    over = OpenTable(limit // 4)
                    over.add(*record)
        yield from table.rows(not last, last)
        yield from over.rows(True, False)

    return run


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, normalised ``content`` and its ``sha`` (SHA-256, hex)."""
    content = docs.select("doc_id", one_space(text).alias("content"))
    return content.withColumn("sha", F.sha2("content", 256))


def text_groups(docs: DataFrame, text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per distinct normalised text: ``sha``, ``keep_id`` and ``group_size``.

    Runs the levels of the recursion and returns their tables.  A level ends
    at least one text per partition, so the recursion ends.
    """
    spark = docs.sparkSession
    records = keyed(docs, text).select(F.xxhash64("content").alias("hash"), "sha", "content", F.col("doc_id").cast("long").alias("keep_id"), F.lit(1).cast("long").alias("size"))
    records = records.mapInArrow(frugal(_merge(table_bytes // 2, False)), PARTIAL)
    finished, level, n = [], 0, partitions(spark)
    while True:
        # Each level takes other bits: the hash of the hash and the level.
        bucket = F.pmod(F.xxhash64("hash", F.lit(level)), F.lit(n)).cast("int")
        dealt = records.drop("done").repartition(n, bucket)
        level_table = written(dealt.mapInArrow(frugal(_merge(table_bytes, True)), PARTIAL), f"grace-{level}")
        finished.append(level_table.filter("done").select("sha", "keep_id", F.col("size").alias("group_size")))
        records = level_table.filter("not done")
        if records.isEmpty():
            break
        level += 1
    groups = finished[0]
    for more in finished[1:]:
        groups = groups.unionByName(more)
    return groups


def exact_groups(docs: DataFrame, text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """For each row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when they are identical after each run of ASCII whitespace
    became one space; null counts as empty.  The smallest ``doc_id`` of a group
    stays.  Rows without a ``doc_id`` count and are dropped unless no row of
    their group has one; then all are kept, with a null ``keep_id``.  Repeated
    rows are rows of their group each.  An empty table gives no rows; other
    columns are ignored.
    """
    groups = text_groups(docs, text, table_bytes)
    rows = keyed(docs, text).select("doc_id", F.col("sha").alias("text_sha256"))
    joined = rows.join(groups.withColumnRenamed("sha", "text_sha256"), "text_sha256")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they are.

    Repeated rows (the same ``doc_id`` and text) become one.  Only rows of
    groups with copies are looked up, so texts alone in their group aren't
    shuffled again.
    """
    groups = text_groups(docs, text).filter("group_size > 1")
    sha, keep, copies = (free_name(docs, name) for name in ("__sha", "__keep", "__copies"))
    keyed_rows = docs.withColumn(sha, F.sha2(one_space(text), 256))
    groups = groups.select(F.col("sha").alias(sha), F.col("keep_id").alias(keep), F.lit(True).alias(copies))
    joined = keyed_rows.join(groups, sha, "left")
    alone = joined.filter(F.col(copies).isNull()).select(docs.columns)
    chosen = joined.filter(F.col(copies) & docs["doc_id"].eqNullSafe(F.col(keep)))
    return alone.unionByName(chosen.dropDuplicates([sha]).select(docs.columns))
