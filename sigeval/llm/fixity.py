"""Merkle fixity audit of a WARC archive against a replica.

Records are grouped into files and ordered in each; a leaf is a record's SHA-256
with its byte range ``[start, stop)``. Every ``FAN`` neighbouring nodes make a
parent: the hash of their hashes and of the range they cover. The trees of the
files are joined the same way, by file number, up to one root per archive. The
audit compares the roots and descends only into nodes that differ: of a lower level it
scans the table but keeps and compares the children of mismatching nodes alone. At the bottom,
the records of mismatching ranges are matched within their file: those of equal
page id and hash are sound, wherever they stand; of the others, those of equal
page id are damaged, in order of their places, and the rest is lost or added. Sound
records at another place or offset are told apart from the damage.

Each level is a small table in the shared folder; a parent's group has at most
``FAN`` rows. The windows that number records and add up offsets run per file.

Edge cases: a null page id is filed by the hash of its row; null url and html
count as empty; repeated ids are records of their own, in order of their
hashes; an empty archive differs from a non-empty one in every record; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

FAN = 16
FILE_PAGES = 1024
LOST_FILES = 64           # files for records without an id


def record(pages: DataFrame) -> DataFrame:
    """``file, page_id, record`` (the bytes of a WARC response record)."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    lost = -1 - F.pmod(F.xxhash64("url", "html"), F.lit(LOST_FILES))
    return pages.select(
        F.coalesce(F.floor(F.col("page_id") / FILE_PAGES).cast("bigint"), lost).alias("file"),
        F.col("page_id").cast("bigint").alias("page_id"),
        F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
                 F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), url,
                 F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html,
                 F.lit("\r\n\r\n")).alias("record"))


def leaves(records: DataFrame, content: Column, *more: str) -> DataFrame:
    """``file, i, start, stop, digest``: level 0 of the tree over ``content``."""
    hashed = records.select("file", "page_id", F.octet_length(content).cast("bigint").alias("size"),
                            F.sha2(content.cast("binary"), 256).alias("digest"), *more)
    return place(hashed)


def place(hashed: DataFrame) -> DataFrame:
    """Number the records of each file and add up their offsets."""
    order = Window.partitionBy("file").orderBy("page_id", "digest")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum("size").over(before)
    return hashed.select("file", (F.row_number().over(order) - 1).cast("bigint").alias("i"), (stop - F.col("size")).alias("start"),
                         stop.alias("stop"), "digest", "page_id")


def parents(level: DataFrame, in_file: bool) -> DataFrame:
    """The next level up: by neighbouring records, then by neighbouring files."""
    key = (["file", F.floor(F.col("i") / FAN).cast("bigint").alias("i")] if in_file
           else [F.floor(F.col("file") / FAN).cast("bigint").alias("file"), F.lit(0).cast("bigint").alias("i")])
    child = F.col("i") if in_file else F.col("file")
    kids = level.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(child.alias("at"), "digest", "start", "stop"))).alias("kids"))
    first, last = F.col("kids")[0]["start"], F.element_at("kids", -1)["stop"]
    text = F.concat_ws("|", F.transform("kids", lambda c: F.concat_ws(":", c["digest"], c["start"].cast("string"),
                                                                      c["stop"].cast("string"))))
    return kids.select("file", "i", first.alias("start"), last.alias("stop"), F.sha2(text, 256).alias("digest"))


def tree(bottom: DataFrame, in_file: int, over_files: int) -> list[DataFrame]:
    levels = [materialize(bottom, "merkle-0")]
    for n in range(in_file + over_files):
        levels.append(materialize(parents(levels[-1], n < in_file), f"merkle-{n + 1}"))
    return levels


def _steps(span: int) -> int:
    n = 0
    while span > 1:
        span, n = -(-span // FAN), n + 1
    return n


def _matched(one: DataFrame, other: DataFrame) -> DataFrame:
    """Leaves of both sides, paired by file, page id, hash and the turn among
    equal ones: the places ``a`` and ``b``, null where a side lacks the record."""
    place = F.struct("i", "start", "stop").alias("place")
    both = (one.select("file", "page_id", "digest", place, F.lit(True).alias("first"))
            .unionAll(other.select("file", "page_id", "digest", place, F.lit(False).alias("first"))))
    turn = F.row_number().over(Window.partitionBy("file", "page_id", "digest", "first").orderBy("place"))
    return both.withColumn("turn", turn).groupBy("file", "page_id", "digest", "turn").agg(
        F.max(F.when(F.col("first"), F.col("place"))).alias("a"), F.max(F.when(~F.col("first"), F.col("place"))).alias("b"))


def audit(one: DataFrame, other: DataFrame) -> DataFrame:
    """Leaves (:func:`leaves`) of two replicas -> the records that are damaged,
    lost or added: ``file, record_no, page_id, start_offset, end_offset, digest,
    replica_digest`` (null where a side lacks the record; places are those of the
    first side if it has the record)."""
    rest = _matched(*_suspects(one, other)).where("a is null or b is null").select(
        "file", "page_id", F.col("a").isNotNull().alias("first"),
        F.struct(F.coalesce("a", "b").alias("place"), "digest").alias("leaf"))
    turn = F.row_number().over(Window.partitionBy("file", "page_id", "first").orderBy("leaf"))
    pairs = rest.withColumn("turn", turn).groupBy("file", "page_id", "turn").agg(
        F.max(F.when(F.col("first"), F.col("leaf"))).alias("a"), F.max(F.when(~F.col("first"), F.col("leaf"))).alias("b"))
    place = F.coalesce("a", "b")["place"]
    return pairs.select("file", place["i"].alias("record_no"), "page_id", place["start"].alias("start_offset"),
                        place["stop"].alias("end_offset"), F.col("a")["digest"].alias("digest"),
                        F.col("b")["digest"].alias("replica_digest"))


def shifted(one: DataFrame, other: DataFrame) -> DataFrame:
    """The sound records that stand elsewhere in the other replica: ``file,
    page_id, digest, record_no, start_offset, replica_record_no,
    replica_start_offset``."""
    pairs = _matched(*_suspects(one, other))
    return pairs.where("a.i <> b.i or a.start <> b.start").select(
        "file", "page_id", "digest", F.col("a")["i"].alias("record_no"), F.col("a")["start"].alias("start_offset"),
        F.col("b")["i"].alias("replica_record_no"), F.col("b")["start"].alias("replica_start_offset"))


def _suspects(one: DataFrame, other: DataFrame) -> list[DataFrame]:
    """The leaves of both sides that lie in mismatching ranges."""
    one, other = materialize(one, "leaves"), materialize(other, "leaves")
    ends = one.select("file", "i").unionAll(other.select("file", "i")).agg(
        F.max("i").alias("i"), F.min("file").alias("low"), F.max("file").alias("high")).first()
    in_file = _steps((ends["i"] or 0) + 1)
    # enough halvings that all file numbers meet; negative ones stay at -1
    over_files = _steps(max((ends["high"] or 0) + 1, -(ends["low"] or 0)) + 1)
    trees = [tree(x, in_file, over_files) for x in (one, other)]
    wrong = None
    for n in range(in_file + over_files, -1, -1):
        sides = []
        for t, name in zip(trees, ("digest", "replica_digest")):
            level = t[n].select("file", "i", "start", "stop", F.col("digest").alias(name if n else "digest"),
                                *([] if n else ["page_id"]))
            if wrong is not None:
                above = ([F.col("file"), F.floor(F.col("i") / FAN)] if n < in_file
                         else [F.floor(F.col("file") / FAN), F.lit(0)])
                level = (level.withColumns({"_f": above[0].cast("bigint"), "_i": above[1].cast("bigint")})
                         .join(wrong, ["_f", "_i"], "left_semi").drop("_f", "_i"))
            sides.append(level)
        if n == 0:
            return sides
        a, b = sides[0].alias("a"), sides[1].alias("b")
        differ = a.join(b, (F.col("a.file") == F.col("b.file")) & (F.col("a.i") == F.col("b.i")), "full").where(
            ~F.col("digest").eqNullSafe(F.col("replica_digest"))
            | ~F.col("a.start").eqNullSafe(F.col("b.start")) | ~F.col("a.stop").eqNullSafe(F.col("b.stop")))
        file, i = F.coalesce("a.file", "b.file"), F.coalesce("a.i", "b.i")
        wrong = materialize(differ.select(file.alias("_f"), i.alias("_i")), "mismatches")
    raise AssertionError


def audit_damage(pages: DataFrame, damaged: Column, spoiled: Column) -> DataFrame:
    """Audit the archive of ``pages`` against a replica in which the records
    that ``damaged`` picks read as ``spoiled`` (a column over ``record`` and
    ``page_id``). Both sides are hashed in one scan."""
    both = record(pages)
    replica = F.when(damaged, spoiled).otherwise(F.col("record"))
    def digest(c):
        return F.sha2(c.cast("binary"), 256)
    hashed = materialize(both.select("file", "page_id", F.octet_length("record").cast("bigint").alias("size"),
                                     digest(F.col("record")).alias("digest"),
                                     F.octet_length(replica).cast("bigint").alias("size2"),
                                     digest(replica).alias("digest2")), "record-hashes")
    return audit(place(hashed.select("file", "page_id", "size", "digest")),
                 place(hashed.select("file", "page_id", F.col("size2").alias("size"), F.col("digest2").alias("digest"))))


def oracle() -> str:
    """DuckDB SQL of the registered query (non-negative, unique page ids)."""
    return r"""
with r as (select page_id, page_id // 1024 as file, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
  || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
  || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
  || chr(13) || chr(10) || chr(13) || chr(10) as record from pages),
p as (select *, row_number() over w - 1 as record_no, sum(strlen(record)) over w as stop from r
      window w as (partition by file order by page_id))
select file, record_no, page_id, cast(stop - strlen(record) as bigint) as start_offset, cast(stop as bigint) as end_offset,
  sha256(record) as digest, sha256(substr(record, 1, page_id % 8) || '#' || substr(record, page_id % 8 + 2)) as replica_digest
from p where page_id % 97 = 13"""
