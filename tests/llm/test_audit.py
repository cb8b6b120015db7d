import re
from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from releaselode.llm import audit

from .helpers import AWKWARD, documents

ROWS = [*AWKWARD, (None, "again"), (None, "again"), (12, "again"), (11, "again"), (14, "CAPITALS AND More"), (15, "plain words here " * 50), (16, None), (13, " ".join(f"w{i}" for i in range(120))), (17, " ".join(f"w{i}" for i in range(120)))]
LABELS = [(0, 1, 0), (4, 1, 1), (1, 0, 1), (7, 1, 0), (7, 0, 1), (14, None, 1), (15, 1, None), (99, 1, 1), (None, 1, 1), (17, 1, 0)]


def tables(spark, rows=ROWS, labels=LABELS):
    docs = documents(spark, rows).withColumn("lang", F.expr("case when doc_id % 3 = 0 then 'de' when doc_id % 3 = 1 then null else 'en' end"))
    return docs, spark.createDataFrame([(*x, "text") for x in labels], "doc_id long, quality int, toxic int, text string")


def brute(rows, labels):
    """Order by order, document by document."""
    docs = []
    for k, t in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {x for x, y in {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": k is not None and any(j is not None and j < k and (u or "") == t for j, u in rows),
        }.items() if y}
        part = "en" if k is None else ["de", "", "en"][k % 3]
        docs.append((part, fails, k is not None and any(a == k and q == 1 for a, q, _ in labels), k is not None and any(a == k and x == 1 for a, _, x in labels)))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                x, before = order[step - 1], set(order[: step - 1])
                gone = [d for d in own if x in d[1] and not d[1] & before]
                shapley[x] += len(gone)
                out[part, order, step] = [sum(not d[1] & (before | {x}) for d in own), len(gone), sum(x in d[1] and bool(d[1] & before) for d in own), sum(d[1] == {x} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def found(df):
    rows = [(r.part, r.filter_order, r.step, [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]) for r in df.collect()]
    assert len({x[:3] for x in rows}) == len(rows)
    return {x[:3]: x[3] for x in rows}


def test_every_order_by_brute_force(spark):
    docs, labels = tables(spark)
    assert found(audit.audit(docs, labels)) == brute(ROWS, LABELS)


def test_sql_says_the_same(spark):
    docs, labels = tables(spark)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang").toPandas())
    con.register("labels", labels.toPandas().astype({"doc_id": "Int64", "quality": "Int64", "toxic": "Int64"}))
    con.execute("create view d as select try_cast(doc_id as bigint) as doc_id, text, lang from documents")
    sql = audit.ORACLE_SQL.replace("from documents", "from d")
    assert sorted(map(tuple, con.sql(sql).df().values.tolist())) == sorted((*k, *v) for k, v in brute(ROWS, LABELS).items())


def test_matrices_share_out_each_mask():
    kept, removed, redundant, unique = audit.incidence()
    assert kept.shape == (32, 600)
    by_step = [m.reshape(32, 120, 5) for m in (kept, removed, redundant, unique)]
    # what is no longer kept was removed at this or an earlier step
    assert (by_step[0] + by_step[1].cumsum(axis=2) == 1).all()
    assert (by_step[1].sum(axis=2) == (audit.np.arange(32) > 0)[:, None]).all()
    assert not (removed & redundant).any() and not (unique & redundant).any()


def test_no_labels_and_no_documents(spark):
    docs, labels = tables(spark, labels=[])
    assert found(audit.audit(docs, labels)) == brute(ROWS, [])
    docs, labels = tables(spark, rows=[])
    assert audit.audit(docs, labels).count() == 0
