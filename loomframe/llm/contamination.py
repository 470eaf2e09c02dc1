"""Benchmark items inside documents, in DataFrame operations only.

A document is contaminated by an item when it holds at least ``threshold`` of
the item's distinct 5-word shingles (lower case). An item of fewer words is one
shingle, its whole word sequence, and is found wherever that stands.

The search is a size-partitioned MinHash index of the items, which are short,
probed by all shingles of the documents, which may be long. Partition ``p``
holds the items of 2 ** p to 2 ** (p + 1) - 1 shingles. Its largest item may
lack so many shingles and still be held; each item's sketch is that many plus
``p + 1`` of its smallest hashes (all it has, if fewer). So the sketches of a
partition have one length, and one containment of them to be reached: a
document that holds enough of the item can lack only so many hashes of the
sketch. An estimate below that is proof, so the search loses nothing, however
long the document is. Documents probe only partitions whose items they can hold
at all. Candidate pairs are verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import broadcast_if_small, let, materialise, table, words_of

WORDS = 5


def shingle_hashes(words: Column, n: int = WORDS) -> Column:
    """A hash for each window of ``n`` words; none where there are fewer."""
    windows = lambda h: F.slice(F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, n)])), 1, F.greatest(F.size(h) - (n - 1), F.lit(0)))
    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def shingle_texts(words: Column, n: int = WORDS) -> Column:
    """The distinct windows of ``n`` words, each joined by a blank."""
    return let(words, lambda w: F.array_distinct(F.slice(F.transform(w, lambda x, i: F.array_join(F.slice(w, i + 1, n), " ")), 1, F.greatest(F.size(w) - (n - 1), F.lit(0)))))


def _words(c: str) -> Column:
    return words_of(F.lower(F.col(c).cast("string")))


def _by_length(words: Column, of: callable) -> Column:
    """``of(words, n)`` with n = ``WORDS``, or the number of words where there are fewer."""
    out = of(words, WORDS)
    for n in range(1, WORDS):
        out = F.when(F.size(words) == n, of(words, n)).otherwise(out)
    return out


def test_items(items: DataFrame, item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, width, shingles, hashes, item_key) of the items that have a word; ``width`` is the words of a shingle."""
    words = F.col("_lf_words")
    taken = items.select(F.col(item_id_col).alias("item_id"), _words(item_text_col).alias("_lf_words")).filter(F.size(words) > 0)
    out = taken.select("item_id", F.least(F.size(words), F.lit(WORDS)).alias("width"), _by_length(words, shingle_texts).alias("shingles"), F.array_distinct(_by_length(words, shingle_hashes)).alias("hashes"))
    return out.withColumn("item_key", F.xxhash64("width", "shingles")).distinct()


def sketches(tests: DataFrame, threshold: float) -> DataFrame:
    """(part, item_key, need, hits, hash): the MinHash index, a row for each hash of each different item's sketch.

    ``need``: shingles that a document must have to hold the item; ``hits``:
    hashes of the sketch that it then can't lack.
    """
    n = F.size("hashes")
    lack = lambda size: size - F.ceil(size * threshold).cast("int")
    part = F.floor(F.log2(n.cast("double"))).cast("int")
    largest = (F.pow(F.lit(2.0), F.col("part") + 1) - 1).cast("int")
    sized = tests.dropDuplicates(["item_key"]).withColumns({"n": n, "part": part})
    sized = sized.withColumn("length", F.least(F.col("n"), lack(largest) + F.col("part") + 1))
    return sized.select("part", "item_key", F.ceil(F.col("n") * threshold).cast("int").alias("need"), (F.col("length") - lack(F.col("n"))).alias("hits"), F.explode(F.slice(F.array_sort("hashes"), F.lit(1), F.col("length"))).alias("hash"))


def _found(docs: DataFrame, items: DataFrame, threshold: float = 0.8, text_col: str = "text", id_col: str = "doc_id", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, key, item_id, n_item, n_shared): pairs of texts and items; key is a hash of the text."""
    tests = materialise(test_items(items, item_id_col, item_text_col), "test-items")
    widths = sorted(r["width"] for r in tests.select("width").distinct().collect())  # 1 to WORDS
    index = materialise(sketches(tests, threshold), "test-sketches")
    taken = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    joined = lambda of, words: F.concat(*[of(words, n) for n in widths]) if widths else F.expr("cast(array() as array<bigint>)")
    probes = taken.select("doc_id", "key", let(_words("text"), lambda w: joined(shingle_hashes, w)).alias("h")).select("doc_id", "key", F.size("h").alias("n"), F.explode("h").alias("hash"))
    # by partition, and in it by item: which sketches are held often enough
    hits = probes.join(broadcast_if_small(index), "hash").filter(F.col("n") >= F.col("need")).select("part", "item_key", "hits", "doc_id", "key", "hash").distinct()
    found = hits.groupBy("part", "item_key", "hits", "doc_id", "key").agg(F.count("*").alias("n_hits")).filter("n_hits >= hits")
    found = materialise(found.select("doc_id", "key", "item_key"), "test-candidates")
    near = broadcast_if_small(found.select(F.col("doc_id").alias("c_id"), F.col("key").alias("c_key")).distinct())
    held = taken.join(near, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("key") == F.col("c_key")), "left_semi").dropDuplicates(["doc_id", "key"])
    texts = F.array_distinct(F.concat(*[shingle_texts(F.col("w"), n) for n in widths])) if widths else F.expr("cast(array() as array<string>)")
    held = held.select("doc_id", "key", _words("text").alias("w")).select("doc_id", "key", F.explode(texts).alias("shingle"))
    wanted = tests.dropDuplicates(["item_key"]).select("item_key", F.size("shingles").alias("n_item"), F.explode("shingles").alias("shingle"))
    shared = held.join(broadcast_if_small(wanted), "shingle").groupBy("doc_id", "key", "item_key", "n_item").agg(F.count("*").alias("n_shared"))
    verified = shared.filter(F.col("n_shared") >= F.col("n_item") * threshold)
    pair = found.withColumnsRenamed({"doc_id": "c_id", "key": "c_key", "item_key": "c_item"})
    verified = verified.join(pair, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("key") == F.col("c_key")) & (F.col("item_key") == F.col("c_item")), "left_semi")
    return verified.join(broadcast_if_small(tests.select("item_id", "item_key")), "item_key")


def find_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, text_col: str = "text", id_col: str = "doc_id", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs (``doc_id``, ``item_id``, ``n_item``, ``n_shared``, ``containment``) with containment of ``threshold`` or more.

    Null texts have no words, and an item without words is found nowhere. An
    item of one to four words is one shingle. Repeated rows give one pair; where
    rows share an id but not the text, the largest containment counts. Rows with
    a null id give pairs with a null id. Empty tables give no pairs. Texts of any
    length are probed whole. Other columns of ``docs`` and ``items`` don't matter.
    """
    found = _found(docs, items, threshold, text_col, id_col, item_id_col, item_text_col)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("c"), F.col("n_item").cast("long").alias("n"), F.col("n_shared").alias("s"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n").alias("n_item"), F.col("b.s").alias("n_shared"), F.round("b.c", 6).alias("containment"))


def without_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose text holds no item; all other rows and columns stay as they are, null and repeated ones too."""
    found = materialise(_found(docs, items, threshold, text_col, id_col).select(F.col("doc_id").alias("_lf_id"), F.col("key").alias("_lf_key")).distinct(), "contaminated")
    same = F.col(id_col).eqNullSafe(F.col("_lf_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("_lf_key"))
    return docs.join(broadcast_if_small(found), same, "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contaminated documents, with the items they hold."""
    return find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
k AS (SELECT DISTINCT least(len(w), 5) AS k FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k)),
bs AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), 5) AS k, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, round(count(*)::DOUBLE / n_item, 6) AS containment
FROM ds JOIN bs USING (k, s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) >= n_item * 0.8::DOUBLE
"""
