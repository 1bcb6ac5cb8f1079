import hashlib
import random
import re

from pyspark.sql import functions as F

from verdigraph.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, own in items:
        v = words(own)
        n = min(13, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1) if grams else ():
            if tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(str(item))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def fixture(spark):
    rng = random.Random(4)
    lexicon = ["ab", "Cd", "éa", "x1", "ß", "Ünder", "q_q", "n-n", "o o", "z`z"]
    line = lambda n: " ".join(rng.choice(lexicon) for _ in range(n))
    items = [(10, line(20)), (9, line(13)), (2, "only three words"), (None, "not an item at all"), (4, None), (5, " .. "), (10, "One"), (11, line(40))]
    items = [(*x[:1], x[1]) for x in items] + [(12, items[0][1])]
    docs = [(k, line(rng.randint(0, 60)) + rng.choice([" only, three-WORDS ", " " + items[0][1].upper() + " ", " ", items[7][1]]) + line(rng.randint(0, 400))) for k in range(80)]
    docs += [(80, None), (81, ""), (None, "one"), (5, items[0][1]), (5, items[0][1]), (82, "only"), (83, "three words"), (84, line(60000) + " " + items[1][1])]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_digest_against_brute_force_in_one_block_and_in_many(spark):
    docs, items, df, bench = fixture(spark)
    real = [(i, t) for i, t in items if i is not None and t is not None]
    want = sorted((str(i), *brute(t, real)) for i, t in docs)
    got = decontaminate.digest(df.withColumn("n_words", F.lit("clash")).withColumn("__row", F.lit(1)), bench)
    assert sorted((str(r.doc_id), *r[1:]) for r in got.collect()) == want
    many = decontaminate.marked(df, bench, block_bytes=500).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), "contaminated")
    assert sorted((str(r.doc_id), *r[1:]) for r in many.collect()) == want


def test_documents_and_spans_go(spark):
    docs, items, df, bench = fixture(spark)
    real = [(i, t) for i, t in items if i is not None and t is not None]
    df = df.withColumn("items", F.lit("clash"))
    kept = decontaminate.decontaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in docs if not brute(t, real)[4])
    cut = decontaminate.decontaminated(df, bench, "spans").collect()
    assert len(cut) == len(docs)
    assert sum(len(words(r.text)) for r in cut) == sum(brute(t, real)[0] - brute(t, real)[1] for _, t in docs)


def test_empty_tables(spark):
    _, _, df, bench = fixture(spark)
    assert decontaminate.digest(df.limit(0), bench).collect() == []
    assert not any(r.contaminated or r.n_hit for r in decontaminate.digest(df, bench.limit(0)).collect())
