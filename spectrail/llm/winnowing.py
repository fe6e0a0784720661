"""Document fingerprints by winnowing, in DataFrame functions alone.

A text's words give rolling hashes of k words each: polynomials in BASE modulo PRIME, each of which follows from the one before
it, less the word that leaves, times BASE, plus the word that comes. Spark has no running fold over an array, so all are
taken from the polynomial at once, which gives the values that rolling gives. Of every window of w consecutive hashes the
smallest is kept, the rightmost of equal ones, with its position. So two texts that share a run of w + k - 1 words share a kept hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import fresh, parts_of, ranges
from .secrets import _let

K = 5
W = 6
#: The largest prime below 2^30: k terms below 2^60 stay within 64 bits. BASE is any number below it.
PRIME, BASE = 1_073_741_789, 742_938_285
SPACE = r"[\x20\x09-\x0D]+"


def kept(text: Column, k: int = K, w: int = W) -> Column:
    """struct<pos: array<int>, hash: array<int>>: the kept hashes of a text and the words at which they begin.

    A text of fewer than k words has the hash of all its words; one without words has none; of fewer than w hashes the
    smallest is kept. k is at most 8.
    """

    def grams(h: Column) -> Column:
        n = F.size(h)

        def at(i: Column) -> Column:
            terms = [F.get(h, i + j) * F.lit(pow(BASE, k - 1 - j, PRIME)).cast("long") for j in range(k)]
            return (reduce(Column.__add__, terms) % F.lit(PRIME)).cast("int")

        whole = F.aggregate(h, F.lit(0).cast("long"), lambda a, x: (a * F.lit(BASE).cast("long") + x) % F.lit(PRIME))
        return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), at)).when(n > 0, F.array(whole.cast("int"))).otherwise(F.array().cast("array<int>"))

    def chosen(h: Column) -> Column:
        n = F.size(h)

        def local(i: Column) -> Column:
            """Whether the stretch around i in which it is the smallest (rightmost of equals) holds a window."""

            def with_x(x: Column) -> Column:
                left, right = F.lit(w - 1), F.lit(w - 1)
                for d in range(w - 1, 0, -1):
                    left = F.when(F.get(h, i - d) >= x, left).otherwise(d - 1)
                    right = F.when(F.get(h, i + d) > x, right).otherwise(d - 1)
                return left + right + 1 >= w

            return with_x(F.get(h, i))

        many = F.filter(F.sequence(F.lit(0), n - 1), local)
        least = F.array_min(h)
        one = F.array(n - F.array_position(F.reverse(h), least).cast("int"))
        return F.when(n > w, many).when(n > 0, one).otherwise(F.array().cast("array<int>"))

    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
    hashes = F.transform(words, lambda x: F.pmod(F.xxhash64(x), F.lit(PRIME)))
    result = lambda h: _let(chosen(h), lambda p: F.struct(p.alias("pos"), F.transform(p, lambda i: F.get(h, i)).alias("hash")))
    return _let(hashes, lambda x: _let(grams(x), result))


def likeness(a: Column, b: Column) -> Column:
    """Shared part of two texts' different kept hashes; two texts without any are alike."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def shown(prints: Column) -> Column:
    """hash@word of the kept hashes, in order."""
    return F.array_join(F.zip_with(prints["hash"], prints["pos"], lambda h, p: F.concat(F.lower(F.right(F.lpad(F.hex(h), 8, "0"), F.lit(8))), F.lit("@"), p.cast("string"))), " ")


def with_next(rows: DataFrame, key: str, carried: list[str], derived: dict[str, Column]) -> DataFrame:
    """Each row with next_<c> of the carried columns: those of the row with the next smaller key (null last; the last row has
    the first's). The derived columns are computed behind the shuffle, so they add nothing to it, and get a next_<c> as well.

    Rows that repeat a key follow by a hash of what is carried, and equal rows by their place in the table, so that a key or a row
    that many share is dealt over ranges like any other. Rows are dealt by ranges of (key, hash, place); the first row of each
    range is also put behind the range before it. The table must give equal rows in the same places each time it is read, as files
    do. An empty table gives an empty result; the other columns pass.
    """
    spark = rows.sparkSession
    at, where, last, guard = fresh(rows.columns, "at", "range", "last", "guard")
    rows = rows.withColumn(at, F.struct(F.col(key).alias("k"), F.xxhash64(*carried).alias("h"), F.monotonically_increasing_id().alias("i")))
    cuts, place = ranges(rows, key, at, parts_of(rows))
    # Range 0 has the largest keys; null is the smallest.
    rows = rows.withColumn(where, cuts - place)
    heads = rows.groupBy(where).agg(F.max(at).alias(at)).collect()  # one key a range
    used = sorted(r[where] for r in heads)
    tops = [(r[at].k, r[at].h, used[used.index(r[where]) - 1]) for r in heads]
    tops = F.broadcast(spark.createDataFrame(tops, StructType([rows.schema[at].dataType["k"], StructField("h", LongType()), StructField(last, IntegerType())])))
    guards = rows.join(tops, F.col(f"{at}.k").eqNullSafe(tops["k"]) & (F.col(f"{at}.h") == tops["h"]))
    guards = guards.groupBy(last).agg(F.min_by(F.struct(*[rows[c] for c in rows.columns]), F.col(f"{at}.i")).alias(guard))
    guards = guards.select(*[F.col(guard).getField(c).alias(c) if c != where else F.col(last).alias(c) for c in rows.columns]).withColumn(guard, F.lit(True))
    both = rows.withColumn(guard, F.lit(False)).unionByName(guards)
    w = Window.partitionBy(where).orderBy(guard, F.col(at).desc())
    both = both.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried}).withColumns(derived)
    return both.withColumns({f"next_{c}": F.lead(c).over(w) for c in derived}).where(~F.col(guard)).drop(guard, where, at)


def fingerprint(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, text and prints (see `kept`) of every row; null texts count as empty, repeated rows each give a row."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("prints", kept(F.col("text"), k, w))


def compare(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars, edited, prints, edited_prints, near_edited, near_next of every document.

    Null texts count as empty; repeated rows each give a row, and one follows the other. The only document is its own next one. An
    empty table gives an empty result; other columns are left behind.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, "doc_id", ["text"], {"prints": kept(F.col("text"), k, w)})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "prints", "next_prints")
    rows = rows.withColumn("edited_prints", kept(F.col("edited"), k, w))
    hashes = lambda c: F.array_distinct(F.col(c)["hash"])
    return rows.withColumn("near_edited", likeness(hashes("prints"), hashes("edited_prints"))).withColumn("near_next", likeness(hashes("prints"), hashes("next_prints")))


def query(spark, sf_dir: str) -> DataFrame:
    rows = compare(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), shown(F.col("prints")).alias("fingerprint"),
        shown(F.col("edited_prints")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
