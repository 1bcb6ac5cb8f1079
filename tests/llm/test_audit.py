import re
from itertools import permutations

import pytest

from verdigraph.llm import audit

SCHEMA = "doc_id long, text string, source string, part string, n long, failed int"
LABELS = "doc_id long, quality int, toxic int, text string"


def brute(docs, labels):
    """The contract, document by document."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    fails = []
    for d, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copies = [o for o, u, _ in docs if (u or "") == t and o is not None]
        bad = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and any(o < d for o in copies),
        }
        fails.append((source or "", d, {f for f in bad if bad[f]}))
    out = {}
    for part in {p for p, _, _ in fails}:
        own = [(d, bad) for p, d, bad in fails if p == part]
        share = dict.fromkeys("ABCDE", 0)
        rows = {}
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                share[f] += len(gone)
                failing = [x for x in own if f in x[1]]
                rows[order, step] = [len(left), len(gone), len(failing) - len(gone), sum(x[1] == {f} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
        for (order, step), r in rows.items():
            out[part, order, step] = (*r, share[order[step - 1]])
    return out


def texts():
    words = [f"w{i}" for i in range(80)]
    plain = " ".join(words)
    return [plain, " ".join(words[:10]), " ".join(["again"] * 90), plain.upper(), plain + " #", "", None, " " * 3 + "é\x85x", "A" * 70, plain]


@pytest.fixture(scope="module")
def table():
    docs, k = [], 0
    for source in ("web", None, "", "Web"):
        for t in texts():
            docs.append((k, t, source))
            k += 3
    docs += [(0, texts()[0], "web"), (0, texts()[0], "web"), (None, texts()[0], "web"), (None, None, None), (7, texts()[1], "web")]
    labels = [(d, int(d % 2 == 0), int(d % 5 == 0)) for d in range(0, k, 3)] + [(0, None, None), (3, 1, 1), (None, 1, 1), (999, 1, 1)]
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame([(*d, "x", 5, 1) for d in docs], SCHEMA), spark.createDataFrame([(*x, "y") for x in labels], LABELS)


def test_equals_brute_force(spark, table):
    rows = audit.audit(*frames(spark, *table)).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows} == brute(*table)
    assert len(rows) == 600 * len({r.part for r in rows})


def test_many_parts_are_counted_in_turns(spark, table, monkeypatch):
    docs = [(i, "few words", f"s{i % 9}") for i in range(40)]
    monkeypatch.setattr(audit, "MOST_PARTS", 2)
    rows = audit.audit(*frames(spark, docs, [])).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows} == brute(docs, [])


def test_empty_tables(spark, table):
    docs, labels = frames(spark, *table)
    assert audit.audit(docs.limit(0), labels).collect() == []
    rows = audit.audit(docs, labels.limit(0)).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows} == brute(table[0], [])


def test_a_very_long_text(spark):
    docs = [(1, "word " * 400_000, "s"), (2, " ".join(f"w{i}" for i in range(300_000)), "s")]
    rows = audit.audit(*frames(spark, docs, [])).where("filter_order = 'BACDE' and step = 1").collect()
    assert [(r.removed, r.kept) for r in rows] == [(1, 1)]


def test_the_table_of_first_failures():
    assert audit.FIRST.shape == (32, 120)
    for failed in range(32):
        for k, order in enumerate(audit.ORDERS):
            met = [s for s, f in enumerate(order) if failed >> "ABCDE".index(f) & 1]
            assert audit.FIRST[failed, k] == (met[0] if met else 5)
