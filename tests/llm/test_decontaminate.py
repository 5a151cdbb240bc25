import re

from proplytics.llm import decontaminate
from tests.llm.support import documents, edge_rows


def grams(text, k=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, items):
    out = set()
    for i, t, _ in set(rows):
        for item, body in set(items):
            q = grams(body)
            n = len(q & grams(t))
            if q and 100 * n >= 80 * len(q):
                out.add((i, item, n, len(q)))
    return out


def test_leaks_equal_brute_force(spark):
    rows = edge_rows(7)
    items = [(k, rows[k][1] if k % 2 else " ".join(f"q{k}x{j}" for j in range(14 + k))) for k in range(12)]
    items += [(50, "too few words"), (51, None), (None, rows[9][1]), (items[0][0], items[0][1])]
    long = " ".join(f"z{j}" for j in range(20000))
    for k, body in items[:12:2]:
        w = body.split()
        rows.append((300 + k, f"{long} {body} {long}", "s"))  # inside a long document
        rows.append((320 + k, " ".join([*w[:-1], "changed"]), "s"))  # one word changed at the end
        rows.append((340 + k, " ".join(w[: len(w) // 2]), "s"))  # half of it
        rows.append((360 + k, body.upper().replace(" ", ", "), "s"))  # other case and marks
    got = decontaminate.leaks(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(rows, items)
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got} == want and len(got) == len(want)
    assert {300, 320, 360} <= {w[0] for w in want} and 340 not in {w[0] for w in want}
    docs = documents(spark, rows)
    kept = decontaminate.clean_documents(docs, spark.createDataFrame(items, "item_id long, text string"))
    bad = {w[0] for w in want} - {None}
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, t, _ in rows if i is not None and (i not in bad or i == 5 and not any(
        100 * len(grams(b) & grams(t)) >= 80 * len(grams(b)) > 0 for _, b in items)))


def test_no_rows(spark):
    docs, none = documents(spark, edge_rows()), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs, none).collect() == []
    assert decontaminate.clean_documents(docs, none).count() == docs.count()
    assert decontaminate.leaks(documents(spark, []), none).collect() == []


def test_no_python_in_the_plan(spark):
    docs = documents(spark, edge_rows(), clash=False)
    found = decontaminate.leaks(docs, spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string"))
    plan = found._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))
