"""How far the sources of a language differ in their words, exactly, by inclusion and exclusion over supports.

Every (language, source) group gives each kept term of its language a smoothed
share, also the terms that it doesn't hold. The divergence of two groups is a sum
over all kept terms, but most terms are held by neither or by one of two groups,
so that no table of groups by terms is ever made:

* all kept terms are first priced as if both counts were zero: one constant for
  each pair of groups;
* a term that one group holds is corrected for that group's count alone. How many
  terms have which count is a histogram of the group, so that a pair costs as many
  steps as there are different counts;
* a term that both hold is corrected once more, from a join of the postings
  (language, term) -> (source, count), the only place where terms meet.

Terms are counted in each task before anything is shuffled, in tables of bounded
size, so that a hot source or a hot word is one row there. A term that stands in more than ``SPLIT``
sources is dealt out in blocks of sources. Shares are quotients of decimals, the
rest is in longs; nothing is rounded but by the floors of the definition.

Defined results: null text, language and source are empty strings. Repeated rows
are documents of their own. Texts without terms count as documents, and their
groups occur. A language without kept terms has divergences of 0 and no term
rows; a language with one source has no pairs; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomframe.llm.common import broadcast_if_small, discard, in_batches, materialise, ships, table

ships(__name__)

#: Documents of a language in which a kept term stands at least.
LEAST = 10
#: Ranks of term rows.
TOP = 10
#: Shares are in units of one to so many.
UNIT = 1_000_000_000
#: Sources of a term above which its postings are joined block by block.
SPLIT = 256

#: Terms of a worker's tables at which they are handed on.
HELD = 300_000
#: Bytes of a text that are cut into terms at once.
PIECE = 1 << 22

#: ASCII letters become lower case, all other ASCII bytes part terms, and the bytes of other characters stay.
_FLAT = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece: runs of ASCII letters and of all characters beyond ASCII, only A-Z lower-cased."""
    raw = text.encode().translate(_FLAT)
    at = 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):
            end = raw.rfind(b" ", at, end) + 1 or raw.find(b" ", end) + 1 or len(raw)
        yield raw[at:end].split()
        at = end


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, n: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (n + 2 * kept)); null without kept terms."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    below = (n + 2 * kept).cast("decimal(20,0)")
    return F.when(kept > 0, 1 + div(above, below))


def far(p: Column, q: Column) -> Column:
    return div((p - q) * (p - q), p + q)


def counted_terms(df: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term."""

    def rows(tables: dict) -> pa.RecordBatch:
        langs, sources, terms, n, docs = [], [], [], [], []
        for (lang, source), (times, within) in tables.items():
            langs.append(pa.repeat(pa.scalar(lang, pa.string()), len(times)))
            sources.append(pa.repeat(pa.scalar(source, pa.string()), len(times)))
            terms.append(pa.array(times.keys(), pa.binary()).cast(pa.string()))
            n.append(pa.array(times.values(), pa.int64()))
            docs.append(pa.array([within[t] for t in times], pa.int64()))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in (langs, sources, terms, n, docs)], ["lang", "source", "term", "n", "docs"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict = {}
        held = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                times, within = tables.setdefault((lang, source), (Counter(), Counter()))
                held -= len(times)
                own: set = set()
                for words in terms_of(text.as_py()):
                    times.update(words)
                    own.update(words)
                within.update(own)
                held += len(times)
                if held >= HELD:
                    yield rows(tables)
                    tables, held = {}, 0
        if held:
            yield rows(tables)

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    told = in_batches(df.select(empty(lang_col), empty(source_col), empty(text_col)), work, "lang string, source string, term string, n long, docs long")
    return told.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def audit(df: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: each other source of the language, by falling divergence.
    Part ``term``: the ``top`` terms that the source uses most beyond its
    language's use. Equal values are ranked by item.
    """
    counted = materialise(counted_terms(df, text_col, lang_col, source_col), "term-counts")
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.count("*").alias("sources")).filter(F.col("docs") >= least)
    kept = materialise(kept.select("lang", "term", "total", "sources"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("all"))
    postings = materialise(counted.select("lang", "source", "term", "n").join(broadcast_if_small(kept), ["lang", "term"]), "postings")
    discard(counted)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    present = df.select(empty(lang_col).alias("lang"), empty(source_col).alias("source")).distinct()
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("held"))
    zero = F.lit(0).cast("long")
    groups = present.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", F.coalesce("held", zero).alias("held"), F.coalesce("kept", zero).alias("kept"), F.coalesce("all", zero).alias("all"))
    groups = materialise(groups.withColumn("none", share(zero, F.col("held"), F.col("kept"))), "groups")
    small = broadcast_if_small(groups)
    priced = postings.join(small, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("held"), F.col("kept")))
    pairs = divergences(priced, groups, small)
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(by)
    terms = priced.withColumn("q", share(F.col("total"), F.col("all"), F.col("kept"))).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), far(F.col("p"), F.col("q")).alias("value"))
    ranked = terms.withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(ranked)


def divergences(priced: DataFrame, groups: DataFrame, small: DataFrame) -> DataFrame:
    """(lang, source, part, item, value) of all ordered pairs of sources of a language.

    ``priced`` (lang, source, term, sources, n, p, none): postings with their
    share and that of an absent term. ``small``: ``groups``, perhaps broadcast.
    """
    other = lambda df: df.select("lang", F.col("source").alias("item"), F.col("none").alias("other"))
    ends = [F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b")]
    # the pairs themselves are the result's rows
    base = groups.join(other(small), "lang").filter("source < item").select("lang", *ends, F.coalesce(F.col("kept") * far(F.col("none"), F.col("other")), F.lit(0)).alias("value"))
    counts = priced.groupBy("lang", "source", "n", "p", "none").agg(F.count("*").alias("m"))
    single = counts.join(other(small), "lang").filter("source <> item").select("lang", *ends, (F.col("m") * (far(F.col("p"), F.col("other")) - far(F.col("none"), F.col("other")))).alias("value"))
    blocks = F.ceil(F.col("sources") / SPLIT).cast("int")
    left = priced.select("lang", "term", "source", "p", "none", F.pmod(F.xxhash64("source"), blocks.cast("long")).cast("int").alias("block"))
    right = priced.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("none").alias("other"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    shared = left.join(right, ["lang", "term", "block"]).filter("source < item")
    p, q, none, away = F.col("p"), F.col("q"), F.col("none"), F.col("other")
    both = shared.select("lang", *ends, (far(p, q) - far(p, away) - far(none, q) + far(none, away)).alias("value"))
    add = lambda rows: rows.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    total = add(add(both).unionByName(add(single)).unionByName(base))
    turned = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return total.select("lang", "value", turned.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP12_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
w AS MATERIALIZED (SELECT lang, source, id, unnest(t) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY 1, 2, 3),
s AS MATERIALIZED (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p FROM (SELECT lang, source, term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term))),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM k),
f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM s JOIN l USING (lang, term) WHERE n > 0 AND p > q),
o AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 10
"""
