"""Personal data and the terms that give it away; DataFrame operations only.

Four kinds of entities are found by pattern: email, ip, card, phone. Patterns
are written so that each is linear in the text: a run of characters is tried
from its start (or from where the last match ended) only, which gives the same
leftmost matches. Offsets are code points: the pieces between the matches give
the starts.

Terms that stand in a document with an entity can reveal it as well. Over the
whole corpus, a term's disclosure of an entity is PMI(term; entity) /
IC(entity), all counts being of whole documents: 1 when the term stands only in
documents with the entity, 0 when it says nothing. In the documents with the
entity, be it a single one, all occurrences of a term are removed where it
discloses ``remove_at`` or more and generalised, to the class that its
characters show (a name, a number, a code, a word), where it discloses
``generalise_at`` or more. (An entity in every document has no information to
disclose.)

Arrays are built block by block, so the work for a text grows with its length
and its number of spans, not with their squares.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import broadcast_if_small, discard, let, materialise, table

KINDS = ("email", "ip", "card", "phone")
#: After the base kinds: terms that are generalised, or removed.
ALL_KINDS = (*KINDS, "general", "removed")
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TERM = r"[\p{L}\p{M}\p{N}_]++"
_SPANS = "array<struct<start:int,kind:int,stop:int,value:string>>"
_TERM_SPANS = "array<struct<term:string,start:int,stop:int>>"
#: What a generalised term becomes: the first class whose pattern it matches.
CLASSES = (("[NUMBER]", r"^\p{N}+$"), ("[CODE]", r"\p{N}"), ("[NAME]", r"^\p{Lu}"), ("[WORD]", ""))
#: Numbers of a block, within which they are run through one by one; characters of a piece of text.
_BLOCK, _PIECE = 128, 2048


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of ints, ``join`` of 0 and all before it; ``join`` is associative."""
    none = F.expr("cast(array() as array<int>)")

    def through(numbers: Column, start: Column) -> Column:
        step = lambda a, x: F.struct(join(a["at"], x).cast("int").alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(numbers, F.struct(start.cast("int").alias("at"), none.alias("out")), step, lambda a: a["out"])

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(v), F.lit(_BLOCK)), lambda i: F.slice(v, i, F.lit(_BLOCK)))

    def whole(b: Column) -> Column:
        totals = F.transform(b, lambda x: F.aggregate(x, F.lit(0), lambda a, y: join(a, y).cast("int")))
        return F.flatten(F.zip_with(b, through(totals, F.lit(0)), through))

    return F.when(F.size(values) == 0, none).otherwise(let(values, lambda v: let(blocks(v), whole)))


def _placed(text: Column, pattern: str, make: Callable[[Column, Column], Column], kind: str) -> Column:
    """``make(match, start)`` for all matches of ``pattern`` in ``text``, leftmost and not overlapping; starts are code points."""

    def place(values: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(values))
        ends = F.zip_with(gaps, values, lambda g, v: F.length(g) + F.length(v))
        starts = F.zip_with(let(ends, lambda e: running(e, lambda x, y: x + y)), gaps, lambda at, g: at + F.length(g))
        return F.when(F.size(values) == 0, F.expr(f"cast(array() as {kind})")).otherwise(F.zip_with(values, starts, make).cast(kind))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def find_spans(text: Column, pattern: str, kind: int) -> Column:
    """All matches of ``pattern``, leftmost and not overlapping, as (start, kind, stop, value)."""
    return _placed(text, pattern, lambda v, at: F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(v)).alias("stop"), v.alias("value")), _SPANS)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, doubled(value(i))).otherwise(value(i))) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the four kinds, by start and kind."""
    none = F.expr(f"cast(array() as {_SPANS})")
    digits = lambda v: F.translate(v, " -+().", "")

    def found(t: Column) -> Column:
        email = F.when(F.contains(t, F.lit("@")), find_spans(t, _PATTERNS["email"], 0)).otherwise(none)
        ip = F.when(F.rlike(t, F.lit(r"[0-9]\.[0-9]")), F.filter(find_spans(t, _PATTERNS["ip"], 1), lambda s: F.rlike(s["value"], F.lit(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$")))).otherwise(none)
        card = F.when(F.rlike(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}")), F.filter(find_spans(t, _PATTERNS["card"], 2), lambda s: F.when(F.length(digits(s["value"])).between(12, 19), _luhn(digits(s["value"]))).otherwise(False))).otherwise(none)
        phone = F.when(F.contains(t, F.lit("+")), F.filter(find_spans(t, _PATTERNS["phone"], 3), lambda s: F.length(digits(s["value"])).between(9, 15))).otherwise(none)
        return F.array_sort(F.concat(email, ip, card, phone))

    return let(text, found)


def _term_spans(text: Column) -> Column:
    """All terms of ``text`` as (term, start, stop), the terms in lower case."""
    return _placed(text, _TERM, lambda v, at: F.struct(F.lower(v).alias("term"), at.alias("start"), (at + F.length(v)).alias("stop")), _TERM_SPANS)


def _taken(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("text"))


def _same(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a`` with the rows of ``b`` for the same document (doc_id and key)."""
    b = b.withColumnsRenamed({"doc_id": "_lf_id", "key": "_lf_key"})
    return a.join(b, F.col("doc_id").eqNullSafe(F.col("_lf_id")) & (F.col("key") == F.col("_lf_key"))).drop("_lf_id", "_lf_key")


def disclosing_terms(found: DataFrame, texts: DataFrame, generalise_at: float, remove_at: float) -> DataFrame:
    """(doc_id, key, start, stop, term, kind) for all occurrences of terms that disclose an entity of their document.

    Counts are of whole documents, over the whole corpus. Entities that stand
    in the same documents are scored as one. A pair's disclosure can't reach
    ``generalise_at`` where the term stands in more than
    rows ** (1 - generalise_at) * n_entity ** generalise_at documents (as
    n_both is n_entity at most), so such pairs aren't made.
    """
    rows = float(found.count())
    # repeated rows are one document here, counted as often as it stands there
    held = found.filter(F.size("spans") > 0).groupBy("doc_id", "key").agg(F.count("*").alias("copies"), F.first("spans").alias("spans"))
    held = held.select("doc_id", "key", "copies", F.explode(F.array_distinct(F.transform("spans", lambda s: F.lower(s["value"])))).alias("entity"))
    mark = lambda seed: F.sum(F.xxhash64("doc_id", "key", F.lit(seed)).cast("decimal(20,0)")).alias(f"mark{seed}")
    names = ["n_entity", "mark1", "mark2"]
    # entities with the same documents have the same marks
    entities = held.groupBy("entity").agg(F.sum("copies").alias("n_entity"), mark(1), mark(2)).filter(F.col("n_entity") < rows)
    share = lambda both, term: F.log(F.lit(rows) * both / (F.col("n_entity") * term)) / F.log(F.lit(rows) / F.col("n_entity"))
    # a little more than the bound, for rounding; the score decides
    bound = F.pow(F.lit(rows), F.lit(1 - generalise_at)) * F.pow(F.col("n_entity").cast("double"), F.lit(generalise_at)) * 1.000001
    groups = held.join(broadcast_if_small(entities), "entity").groupBy("doc_id", "key", *names).agg(F.first("copies").alias("copies")).withColumn("most", bound)
    groups = materialise(groups, "entity-groups")
    # counted before it is joined, so that the join sees a row for each term, not for each of its documents; a semi-join would be pushed below the count
    words = texts.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)), F.lower))).alias("term"))
    limit = groups.agg(F.coalesce(F.max("most"), F.lit(0.0))).first()[0]
    terms = materialise(words.groupBy("term").agg(F.count("*").alias("n_term")).filter(F.col("n_term") <= limit), "terms")
    least = groups.groupBy("doc_id", "key").agg(F.max("most").alias("reach"))
    private = _same(texts, broadcast_if_small(least)).dropDuplicates(["doc_id", "key"])
    spots = private.select("doc_id", "key", "reach", F.explode(_term_spans(F.col("text"))).alias("t")).select("doc_id", "key", "reach", "t.*")
    spots = materialise(spots.join(broadcast_if_small(terms), "term").filter(F.col("n_term") <= F.col("reach")).drop("reach"), "term-spots")
    pairs = _same(spots.select("doc_id", "key", "term", "n_term").distinct(), broadcast_if_small(groups)).filter(F.col("n_term") <= F.col("most"))
    pairs = materialise(pairs.select("doc_id", "key", "term", "n_term", "copies", *names), "term-pairs")
    scored = pairs.groupBy("term", "n_term", *names).agg(F.sum("copies").alias("n_both")).withColumn("disclosure", share(F.col("n_both"), F.col("n_term")))
    scored = scored.filter(F.col("disclosure") >= generalise_at).select("term", *names, F.when(F.col("disclosure") >= remove_at, 5).otherwise(4).alias("kind"))
    kinds = pairs.join(scored, ["term", *names]).groupBy("doc_id", "key", "term").agg(F.max("kind").alias("kind")).withColumnRenamed("term", "named")
    told = materialise(_same(spots, kinds).filter(F.col("term") == F.col("named")).select("doc_id", "key", "start", "stop", "term", "kind"), "disclosing")
    discard(groups, terms, spots, pairs)
    return told


def find_private(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", generalise_at: float = 0.7, remove_at: float = 0.9) -> DataFrame:
    """``doc_id``, ``key`` (hash of the text), ``base`` and ``added``: spans as (start, kind, stop, value).

    One row for each row of ``df``; a null text is an empty one; an empty table
    gives an empty result. Added spans never overlap base spans. Kinds are
    places in ``ALL_KINDS``.
    """
    taken = _taken(df, id_col, text_col)
    found = materialise(taken.select("doc_id", "key", base_spans(F.col("text")).alias("spans")), "entities")
    hits = disclosing_terms(found, taken, generalise_at, remove_at)
    # doc_id and key name a row's text, so repeated rows share what is found for them
    added = hits.groupBy(F.col("doc_id").alias("a_id"), F.col("key").alias("a_key")).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", F.col("term").alias("value")))).cast(_SPANS).alias("added"))
    joined = found.join(added, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("key") == F.col("a_key")), "left")
    outside = F.filter("added", lambda x: ~F.exists("spans", lambda s: (s["start"] < x["stop"]) & (x["start"] < s["stop"])))
    return joined.select("doc_id", "key", F.col("spans").alias("base"), F.coalesce(outside, F.expr(f"cast(array() as {_SPANS})")).alias("added"))


def told(spans: Column) -> Column:
    names = F.array(*map(F.lit, ALL_KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def general(term: Column) -> Column:
    """The mark of the class of a term."""
    out = F.lit(CLASSES[-1][0])
    for mark, pattern in CLASSES[-2::-1]:
        out = F.when(F.rlike(term, F.lit(pattern)), mark).otherwise(out)
    return out


def redact(text: Column, spans: Column) -> Column:
    """The text with each span (sorted by start) replaced: ``[EMAIL]`` and so on, a term's class, or nothing.

    Of spans that overlap, the first one's mark stands for all. A null text
    stays null.
    """
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def run(pieces: Column) -> Column:
        def between(start: Column, stop: Column) -> Column:
            first = F.floor(start / _PIECE).cast("int")
            joined = F.array_join(F.slice(pieces, first + 1, F.ceil(stop / _PIECE).cast("int") - first), "")
            return F.when(stop > start, F.substring(joined, start - first * _PIECE + 1, stop - start)).otherwise("")

        def parts(reached: Column) -> Column:
            """Where a span begins after all before it have ended, what lies between and its mark."""
            marked = lambda s: F.when(s["kind"] < len(KINDS), F.get(marks, s["kind"])).when(s["kind"] == len(KINDS), general(between(s["start"], s["stop"]))).otherwise("")
            head = F.zip_with(spans, reached, lambda s, at: F.when(s["start"] >= at, F.concat(between(at, s["start"]), marked(s))).otherwise(""))
            last = F.array_max(F.transform(spans, lambda s: s["stop"]))
            length = (F.size(pieces) - 1) * _PIECE + F.length(F.element_at(pieces, -1))
            return F.concat(F.array_join(head, ""), between(last, F.greatest(last, length)))

        return let(running(F.transform(spans, lambda s: s["stop"]), lambda x, y: F.greatest(x, y)), parts)

    return F.when((F.size(spans) > 0) & (F.length(text) > 0), let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)), run)).otherwise(text)


def redacted(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``df`` with the private spans of its texts replaced; texts without any, null ones too, stay as they are."""
    found = find_private(df, text_col, id_col).filter((F.size("base") > 0) | (F.size("added") > 0))
    found = materialise(found.select(F.col("doc_id").alias("_lf_id"), F.col("key").alias("_lf_key"), F.array_sort(F.concat("base", "added")).alias("_lf_spans")).dropDuplicates(["_lf_id", "_lf_key"]), "private")
    same = F.col(id_col).eqNullSafe(F.col("_lf_id")) & (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col("_lf_key"))
    # spans are in texts with a base span only: where the join shuffles, the others don't move
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = df.withColumn("_lf_private", F.size(base_spans(text)) > 0)
    joined = marked.filter("_lf_private").join(broadcast_if_small(found), same, "left")
    new = F.when(F.col("_lf_spans").isNotNull(), redact(F.col(text_col).cast("string"), F.col("_lf_spans"))).otherwise(F.col(text_col))
    return joined.withColumn(text_col, new).select(*df.columns).unionByName(marked.filter("NOT _lf_private").select(*df.columns))


def op10_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(count, range(4)), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.array_sort(F.concat("base", "added"))).alias("spans"))
