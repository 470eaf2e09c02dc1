import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from loomframe.llm import private


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(t):
    t, out = t or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{private.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def test_base_against_brute_force(spark):
    r = random.Random(5)
    texts = [None, "", "x", "é a.b@c.de,x@y.z", "a@b.c%d@e.f@g.h", "a@@b@c.d a@b", "1.2.3.4.5.6.7.8 256.1.1.1 007.0255.1.2", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (437) 555-0689 +49-30-1234567x +1", "5" * 5000, "1 " * 6000, "a" * 60_000 + "@", "9." * 3000 + "@+1" + " " * 3000, "\U0001f600 +12345678901 a@b.cc"]
    texts += ["".join(r.choice("0123456789 .-+()@aZ_%é\n") for _ in range(300)) for _ in range(150)]
    texts += ["".join(r.choice("0123456789-. ") for _ in range(400)) for _ in range(50)]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(3, texts[3], None), (None, texts[8], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = private.find_private(df).select("doc_id", "base").collect()
    assert sorted((str(x.doc_id), [(s.start, s.kind, s.stop) for s in x.base]) for x in got) == sorted((str(d), brute(t)) for d, t, _ in rows)
    assert private.find_private(df.limit(0)).count() == 0


def test_terms_that_disclose(spark):
    r = random.Random(6)
    filler = lambda: " ".join(r.choice(("with", "that", "from", "other", "place", "words")) for _ in range(12))
    rows = [(i, f"{filler()} Quillfeather wrote from ann@b.org {filler()}") for i in range(5)] + [(10 + i, filler()) for i in range(60)]
    rows += [(100, "mail ann@b.org alone"), (101, "Quillfeather elsewhere")]
    out = {x.doc_id: [(s.start, s.stop, s.kind) for s in x.added] for x in private.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(5):
        at = rows[i][1].index("Quillfeather")
        assert (at, at + 12, 5) in out[i] or (at, at + 12, 4) in out[i]
        assert not any(rows[i][1][a:b] in ("with", "that", "from") for a, b, _ in out[i])
    assert not out[10] and not out[101]


def test_terms_of_an_entity_in_one_document(spark):
    rows = [(i, "some other words stand here") for i in range(40)] + [(50, "words from Quillfeather at ann@b.org stand here")]
    out = {x.doc_id: [(s.value, s.kind) for s in x.added] for x in private.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert ("quillfeather", 5) in out[50] and "words" not in [v for v, _ in out[50]]
    assert not any(out[i] for i in range(40))


def test_disclosure_over_whole_documents(spark):
    r = random.Random(7)
    common = [f"common{i}" for i in range(8)]
    texts = [" ".join(r.choices(common, k=r.randint(0, 12))) for _ in range(60)]
    for i in range(0, 40, 3):
        texts[i] += " " + " ".join(r.choice(("ann@b.org", "+49 30 1234567", "Bob@c.de")) for _ in range(r.randint(1, 3))) + " x" * 200 + f" Jo {r.choice(('user7', 'zed', 'Ümlaut_9'))} JO rare{i}"
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[6]), (90, None)]
    term = re.compile(r"[^\W]+")
    docs = [(d, t or "", brute(t)) for d, t in rows]
    terms = [{m[0].lower() for m in term.finditer(t)} for _, t, _ in docs]
    entities = [{t[a:b].lower() for a, _, b in s} for _, t, s in docs]
    n = len(docs)
    n_term, n_entity = (Counter(x for d in sets for x in d) for sets in (terms, entities))
    n_both = Counter((e, w) for es, ws in zip(entities, terms, strict=True) for e in es for w in ws)
    score = lambda e, w: math.log(n * n_both[e, w] / (n_entity[e] * n_term[w])) / math.log(n / n_entity[e])
    expected = []
    for (d, t, spans), es in zip(docs, entities, strict=True):
        out = []
        for m in term.finditer(t):
            best = max((score(e, m[0].lower()) for e in es), default=0)
            if best >= 0.7 and not any(a < m.end() and m.start() < b for a, _, b in spans):
                out.append((m.start(), 5 if best >= 0.9 else 4, m.end()))
        expected.append((str(d), out))
    got = private.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(x.doc_id), [(s.start, s.kind, s.stop) for s in x.added]) for x in got) == sorted(expected)
    assert any(len(out) > 2 for _, out in expected)
    # every occurrence, however far away; the places in a long text
    far = "Jo " + "common0 " * 5000 + "ann@z.org Jo"
    out = private.find_private(spark.createDataFrame([(1, far)] + [(i, "common0") for i in range(2, 9)], "doc_id long, text string")).filter("doc_id = 1").first().added
    assert [(s.start, s.stop, s.kind) for s in out] == [(0, 2, 5), (len(far) - 2, len(far), 5)]


def test_redaction(spark):
    df = spark.createDataFrame([("é a@b.cd, +1 (437) 555-0689.",), ("none",), ("",), (None,)], "text string")
    got = [x[0] for x in df.select(private.redact(F.col("text"), private.base_spans(F.col("text")))).collect()]
    assert got == ["é [EMAIL], [PHONE].", "none", "", None]


def redact_brute(t, spans):
    out, at = [], 0
    for start, kind, stop in spans:
        if start >= at:
            term = t[start:stop]
            shape = "[NUMBER]" if term.isdigit() else "[CODE]" if any(c.isdigit() for c in term) else "[NAME]" if term[:1].isupper() else "[WORD]"
            out += [t[at:start], [*(f"[{k.upper()}]" for k in private.KINDS), shape, ""][kind]]
        at = max(at, stop)
    return "".join(out) + t[at:]


def test_many_spans_and_overlaps(spark):
    """Spans of all kinds, ties and overlaps; a text with 16,000 addresses takes seconds, not minutes."""
    import time

    r = random.Random(9)
    rows = []
    for i in range(40):
        t = "".join(r.choice("aZ9 é\U0001f600\n") for _ in range(r.choice((0, 5, 300, 5000))))
        spans = sorted((a, r.randrange(6), min(len(t), a + r.randint(1, 40))) for a in (r.randrange(max(1, len(t))) for _ in range(r.choice((1, 30, 700)))) if t)
        rows.append((i, t, spans))
    kind = "array<struct<start:int,kind:int,stop:int>>"
    df = spark.createDataFrame(rows, f"i int, t string, s {kind}")
    got = {x.i: x[1] for x in df.select("i", private.redact(F.col("t"), F.col("s"))).collect()}
    assert got == {i: redact_brute(t, s) for i, t, s in rows}
    many = " ".join(f"u{k}@host{k % 7}.org" for k in range(16_000))
    began = time.time()
    df = spark.createDataFrame([(1, many)], "i int, t string").withColumn("s", private.base_spans(F.col("t")))
    text, n = df.select(private.redact(F.col("t"), F.col("s")), F.size("s")).first()
    assert text == " ".join(["[EMAIL]"] * 16_000) and n == 16_000
    assert time.time() - began < 20


def test_redacted_rows(spark):
    """Rows keep their number and columns, clashing names included; only what is private changes."""
    rows = [(i, "some other words stand here", "x", 1) for i in range(40)] + [(50, "words from Quillfeather at ann@b.org stand here", "y", 2)] * 2 + [(51, None, "z", 3), (None, "see ann@b.org", "w", 4), (52, "", None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, kind int")
    out = private.redacted(df)
    assert out.columns == df.columns
    got = sorted(map(str, (tuple(x) for x in out.collect())))
    texts = {x.doc_id: x.text for x in out.collect()}
    assert "Quillfeather" not in texts[50] and "[EMAIL]" in texts[50] and texts[None].endswith("[EMAIL]")
    untouched = sorted(map(str, (x for x in rows if x[0] not in (50, None))))
    assert [x for x in got if x in untouched] == untouched and len(got) == len(rows)
    assert private.redacted(df.limit(0)).count() == 0
