import random
import re

from fluxline.llm import decontam


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, gram=10):
    grams = {}
    for item, text in items:
        w = words(text)
        k = min(gram, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + k]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in grams:
                    hit |= set(range(i, i + k))
                    found |= grams[tuple(w[i : i + k])]
        out.append((doc, len(w), sorted(hit), sorted(found)))
    return sorted(out, key=repr)


def planted():
    rng = random.Random(11)
    pick = lambda n: [rng.choice(["Alpha", "beta", "Ünder", "δ", "x1", "77", "go"]) for _ in range(n)]
    items = [(i, " ".join(pick(rng.choice([12, 30])))) for i in range(12)] + [(20, "One, two; THREE"), (21, None), (22, " .. "), (None, "solo-flight"), (0, "a second text of item nought that has enough words now"), (23, "One two three")]
    docs = []
    for i in range(60):
        body = pick(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            w = rng.choice(items)[1] or ""
            at = rng.randrange(len(body) + 1)
            body[at:at] = re.split(r"[ ,;-]+", w.upper() if rng.random() < 0.3 else w)[rng.randrange(3) :]
        docs.append((i, rng.choice([" ", "\n", " - "]).join(body)))
    return docs + [(100, None), (101, ""), (102, "..."), (None, "one TWO three"), (103, "one two three"), (103, "one two three"), (104, "word " * 40_000 + items[0][1])], items


def test_equals_brute_force(spark):
    docs, items = planted()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS items", "3 AS words")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS k")
    for gram, block in ((10, decontam.BLOCK), (10, 7), (4, decontam.BLOCK)):
        got = [(r.doc_id, r.n_words, [p for s in r.spans for p in range(s.start, s.stop)], r["items"]) for r in decontam.occurrences(d, b, gram, block).collect()]
        assert sorted(got, key=repr) == brute(docs, items, gram)


def test_spans_and_documents_go(spark):
    docs, items = planted()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS row", "doc_id AS `spans`", "3 AS n_hit")
    b = spark.createDataFrame(items, "item_id long, text string")
    marks = brute(docs, items)
    kept = decontam.clean(d, b, "documents").collect()
    assert sorted(map(repr, (r.doc_id for r in kept))) == sorted(repr(m[0]) for m in marks if not m[2])
    cut = decontam.clean(d, b)
    assert cut.columns == d.columns and cut.count() == len(docs)
    hit = {i: set(m[2]) for i, m in enumerate(marks)}
    want = sorted((repr(m[0]), [w for p, w in enumerate(words(next(t for x, t in docs if x == m[0]))) if p not in hit[i]]) for i, m in enumerate(marks))
    assert sorted((repr(r.doc_id), words(r.text)) for r in cut.collect()) == want
    clean = {m[0] for m in marks if not m[2]}
    assert all(r.text == dict(docs)[r.doc_id] for r in cut.collect() if r.doc_id in clean)


def test_empty_tables(spark):
    docs, items = planted()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontam.occurrences(d, b.limit(0)).filter("n_hit > 0 OR size(items) > 0").count() == 0
    assert decontam.occurrences(d, b.limit(0)).count() == len(docs) and decontam.occurrences(d.limit(0), b).count() == 0
    assert decontam.clean(d.limit(0), b).count() == 0
