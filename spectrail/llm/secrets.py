"""Secret scans over a trigram inverted index, in DataFrame functions alone.

From each rule's pattern follow the trigrams that a match can't do without. Postings (trigram, document) are kept for
those; a rule's candidates are the documents whose postings meet in one of its sets, and only they are searched with its
pattern. A rule without mandatory trigrams searches every document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small
from .trigrams import query as trigram_query


@dataclass(frozen=True)
class Rule:
    """pattern: for both Java and Python. A match counts if `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The rules of the contract, in its order. Runs of at least n are the runs of any length that have n: those of hex are
#: maximal, and what is left of a failing run behind another AKIA in it is shorter still.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Public formats of common keys.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("stripe", r"sk_live_[0-9a-zA-Z]{16,}"),
)
RULES = BASE + MORE

SPAN = "struct<start:int,rank:int,end:int>"
#: Trigrams that are asked for of each set: the rarest.
GRAMS = 2
#: Matches whose places are added up in one go; longer lists are added up in blocks of this many.
BLOCK = 256


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """The places of a rule's matches in code points: the lengths of the matches and of what lies between, added up."""
    none = F.array().cast(f"array<{SPAN}>")
    pattern = F.lit(rule.pattern)
    found = F.struct(
        F.split(text, rule.pattern, -1).alias("between"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("all"),
        (F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else F.array().cast("array<string>")).alias("part"),
    )

    def sizes(x: Column) -> Column:
        long = F.lit(rule.least)
        one = lambda m, i: F.struct(F.length(F.get(x["between"], i)).alias("gap"), F.length(m).alias("size"), (F.length(F.get(x["part"], i) if rule.group else m) >= long).alias("keep"))
        return F.transform(x["all"], one)

    def places(x: Column) -> Column:
        total = lambda part: F.aggregate(part, F.lit(0), lambda a, m: a + m["gap"] + m["size"])
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK)))

        def block(sums: Column):
            def of(part: Column, b: Column) -> Column:
                at = F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0), lambda a, n: a + n)
                start = F.struct(at.alias("at"), none.alias("out"))

                def step(a: Column, m: Column) -> Column:
                    begin = a["at"] + m["gap"]
                    span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + m["size"]).alias("end"))
                    return F.struct((begin + m["size"]).alias("at"), F.when(m["keep"], F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

                return F.aggregate(part, start, step, lambda a: a["out"])

            return of

        return _let(blocks, lambda bs: _let(F.transform(bs, total), lambda sums: F.flatten(F.transform(bs, block(sums)))))

    return _let(found, lambda x: F.when(F.size(x["all"]) == 0, none).otherwise(_let(sizes(x), places)))


def postings(rows: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, doc_id, mark): the documents of each of the trigrams, by the number of the trigram. One pass over the texts."""
    low = F.lower("text")
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    return rows.select(F.explode(held).alias("gram"), "doc_id", "mark")


def candidates(index: DataFrame, grams: list[str], queries: dict[int, list[list[str]]]) -> DataFrame:
    """(doc_id, mark, rules): the documents that some rule's query admits, with the rules as bits.

    The postings of each set of trigrams are intersected by counting: a document that is in all of them is a candidate.
    """
    spark = index.sparkSession
    wanted = [(grams.index(g), 1 << rule, n, len(s)) for rule, sets in queries.items() for n, s in enumerate(sets) for g in s]
    wanted = spark.createDataFrame(wanted, "gram int, bit int, part int, need int")
    met = index.join(F.broadcast(wanted), "gram").groupBy("doc_id", "mark", "bit", "part", "need").agg(F.count_distinct("gram").alias("met"))
    return met.where("met = need").groupBy("doc_id", "mark").agg(F.bit_or("bit").alias("rules"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (start, rank of the rule, end; in code points, end exclusive; by start, then rank) of every document.

    Null and empty texts have none. Repeated rows each give a row with its own spans.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern, GRAMS)) is not None}
    grams = sorted({g for sets in queries.values() for s in sets for g in s})
    if queries:
        index = materialize(postings(rows, grams), "postings")
        found = materialize(candidates(index, grams, queries), "candidates")
        n = found.count()
        found = found.withColumnsRenamed({"doc_id": "_d", "mark": "_m"})
        rows = rows.join(small(found, n), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m")), "left").drop("_d", "_m")
    else:
        rows = rows.withColumn("rules", F.lit(0))
    every = []
    for i, rule in enumerate(rules):
        own = spans(F.col("text"), rule, i)
        every.append(F.when(F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(1 << i) != 0, own).otherwise(F.array().cast(f"array<{SPAN}>")) if i in queries else own)
    return rows.select("doc_id", F.array_sort(F.concat(*every)).alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    names = F.array(*[F.lit(r.kind) for r in RULES])
    shown = lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
    text = lambda c: F.array_join(F.transform(c, shown), ",")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    of = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    counts = [of(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The query in DuckDB SQL: places from the lengths of the matches and of what lies between."""
    one = "SELECT r, {i} AS rank, '{k}' AS kind, string_split_regex(t, '{p}') AS p, regexp_extract_all(t, '{p}') AS f, regexp_extract_all(t, '{p}', {g}) AS g, {n} AS least FROM d"
    every = "\n  UNION ALL ".join(one.format(i=i, k=r.kind, p=r.pattern.replace("'", "''"), g=r.group, n=r.least) for i, r in enumerate(RULES))
    text = "string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, rank)"
    counts = ", ".join(f"count(*) FILTER (rank = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({every}),
s AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM m),
spans AS (
  SELECT r, rank, kind, length(f[i]) AS n,
    (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a
  FROM s WHERE length(g[i]) >= least),
found AS (
  SELECT r, {counts}, {text} FILTER (rank < {len(BASE)}) AS base, {text} AS spans FROM spans GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN found USING (r)
"""


SQL = _sql()
